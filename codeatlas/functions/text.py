"""Column functions over text: identifiers, URLs, paths, measures of code. All but ``type_two`` are built-in expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: where identifiers are cut
CAMEL = ("([a-z0-9])([A-Z])", "([A-Z]+)([A-Z][a-z])")
# fixed values: words that say nothing in a query
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "is",
    "are", "was", "be", "by", "as", "it", "this", "that", "with", "how", "does",
    "do", "what", "when", "where", "why", "which", "about", "into", "from",
]
# fixed values: decision points of code, in Python and elsewhere
BRANCHES = {
    "Python": r"\bif\s|\belif\s|\bwhile\s|\bfor\s|\bexcept\b|\band\s|\bor\s",
    "": r"\bif\s*\(|\bwhile\s*\(|\bfor\s*[(]|\bdo\s*[{]|\bcase\s+|\bcatch\s*\(|&&|\|\|",
}
# fixed values: families of credentials
SECRETS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key_block": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "slack_token": r"xox[baprs]-[0-9A-Za-z-]{10,}",
    "github_token": r"gh[pousr]_[0-9A-Za-z]{30,}",
    "env_assigned_secret": r"""(?i)\b(?:SECRET|TOKEN|PASSWORD|PASSWD|API_KEY|ACCESS_KEY|PRIVATE_KEY)\s*[:=]\s*['"]?[^\s'"]{8,}""",
}
# fixed values: the language of each file extension
LANGUAGES = {
    "py": "Python", "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "go": "Go", "rs": "Rust",
    "rb": "Ruby", "java": "Java", "kt": "Kotlin", "kts": "Kotlin", "php": "PHP", "phtml": "PHP", "cs": "C#",
    "cpp": "C++", "cc": "C++", "cxx": "C++", "h": "C++", "hpp": "C++", "c": "C", "swift": "Swift",
    "scala": "Scala", "sc": "Scala", "dart": "Dart", "lua": "Lua", "ex": "Elixir", "exs": "Elixir", "sh": "Bash", "bash": "Bash",
}
# fixed values: paths of test files
TEST_PATHS = [
    r"\.(test|spec)\.(ts|tsx|js|jsx|mjs|cjs)$", r"(^|/)__tests__/", r"(^|/)test_[^/]+\.(ts|js|py)$",
    r"[^/]+_test\.(py|go|cpp|cc|cxx)$", r"(^|/)tests?/[^/]+\.(py|ts|js|rb|php)$",
    r"[A-Z][a-zA-Z0-9]*(Test|Tests|IT)\.(java|kt|scala)$", r"[A-Z][a-zA-Z0-9]*Spec\.(kt|scala|rb)$", r"(^|/)src/test/.*\.(java|kt|scala|groovy)$",
]
# fixed values: words of code that keep their names where identifiers are numbered
KEYWORDS = frozenset(
    "if else elif for while do break continue return switch case default goto fallthrough pass "
    "try catch finally throw raise rescue ensure "
    "function func fn def class struct enum interface module type impl trait "
    "const let var val mut ref move "
    "public private protected static abstract final readonly async await yield override virtual synchronized "
    "pub unsafe extern transient volatile native "
    "new delete this self Self super extends implements "
    "import export from use require include package mod "
    "in is as not and or typeof instanceof void "
    "with match when where select defer go chan "
    "true false null nil None True False undefined "
    "lambda del global nonlocal assert unless until begin end then defined throws "
    "guard repeat inout typealias associatedtype fileprivate open indirect lazy weak unowned convenience "
    "required prefix postfix infix operator precedencegroup some any actor nonisolated isolated rethrows "
    "Protocol Type init deinit subscript willSet didSet get set "
    "nullptr constexpr consteval constinit inline friend mutable explicit noexcept typename template namespace typedef decltype alignof "
    "len make append cap copy map range".split()
)
# fixed values: languages in which `#` begins a comment
HASH_LANGUAGES = (
    "python ruby elixir bash shell sh zsh php perl r powershell coffeescript nim crystal toml yaml dockerfile makefile terraform hcl".split()
)
# fixed values: prefixes that a caller may add to a route's path
API_PREFIXES = ["/api/v1", "/api/v2", "/api/v3", "/api", "/v1", "/v2", "/v3"]


def _cut(word: Column) -> Column:
    """The camel-case parts of a word."""
    return F.split(F.regexp_replace(F.regexp_replace(word, CAMEL[0], "$1 $2"), CAMEL[1], "$1 $2"), " ")


def _chunks(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Lower-case compounds and their camel-case parts, of two characters or more; repeats stay."""

    def pieces(w: Column) -> Column:
        sub = F.transform(_cut(w), F.lower)
        return F.when(F.size(sub) > 1, F.concat(F.array(F.lower(w)), sub)).otherwise(F.array(F.lower(w)))

    return F.filter(F.flatten(F.transform(_chunks(text), pieces)), lambda w: F.length(w) > 1)


def normalize_tokens(text: Column) -> Column:
    """Lower-case camel-case parts of two characters or more that aren't stop words; repeats stay, compounds don't."""
    parts = F.flatten(F.transform(_chunks(text), lambda w: F.transform(_cut(w), F.lower)))
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def normalize_url(url: Column) -> Column:
    """Path with parameters unified: host, query and fragment go, slashes collapse, all lower."""
    x = F.regexp_replace(url, r"\$\{[^}]+\}", ":param")
    x = F.regexp_replace(x, r"^https?://[^/]+", "")
    x = F.regexp_replace(x, r"[?#].*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\{[^}]+\}", ":param"), r"<[^>]+>", ":param")
    x = F.regexp_replace(x, r":[A-Za-z0-9_]+", ":param")
    x = F.regexp_replace(F.concat(F.lit("/"), x), r"/+", "/")
    return F.lower(F.when(F.length(x) > 1, F.regexp_replace(x, "/$", "")).otherwise(x))


def candidate_paths(path: Column) -> Column:
    """The path, and what is left of it without each known prefix."""
    rest = [F.when(path.startswith(p + "/"), F.substring(path, len(p) + 1, 1 << 30)).when(path == p, "/") for p in API_PREFIXES]
    return F.array_distinct(F.array_compact(F.array(path, *rest)))


def cyclomatic(text: Column, language: Column | None = None) -> Column:
    """1 and the number of decision points."""
    count = lambda k: F.regexp_count(text, F.lit(BRANCHES[k])) + 1
    return count("") if language is None else F.when(language == "Python", count("Python")).otherwise(count(""))


def naming_case(name: Column) -> Column:
    """camelCase, PascalCase or snake_case of a name without the underscores at its ends; null if it is none of them."""
    core = F.regexp_replace(F.regexp_replace(name, "^_+", ""), "_+$", "")
    under = F.contains(core, F.lit("_"))
    none = (core == "") | ~core.rlike("^[A-Za-z]") | core.rlike("^[A-Z][A-Z0-9_]*$") | (under & core.rlike("[A-Z]"))
    return F.when(none, F.lit(None)).when(under, "snake_case").when(core.rlike("^[A-Z]"), "PascalCase").when(core.rlike("[a-z0-9][A-Z]"), "camelCase")


def kebab_case(name: Column) -> Column:
    """Lower-case words of letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.array_join(_cut(name), "-")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def detect_language(path: Column) -> Column:
    lower = F.lower(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    out = F.coalesce(F.try_element_at(known, F.element_at(F.split(lower, r"\."), -1)), F.lit("unknown"))
    infra = F.when(lower.endswith(".tf") | lower.endswith(".tfvars") | lower.endswith(".tf.json"), "Terraform").when(lower.endswith(".bicep"), "Bicep")
    return F.coalesce(infra, out)


def is_test_file(path: Column) -> Column:
    own = F.regexp_replace(path, r"\\", "/")
    test = F.lit(False)
    for p in TEST_PATHS:
        test = test | own.rlike(p)
    return test


def is_generated(path: Column) -> Column:
    ends = path.endswith(".d.ts") | path.endswith(".generated.ts") | path.endswith(".generated.js")
    return ends | path.contains("/generated/") | path.contains("/__generated__/")


def token_estimate(text: Column) -> Column:
    """ceil(other characters / 4 + code punctuation / 2)."""
    marks = F.regexp_count(text, F.lit(r"[{}()\[\];:,.<>=+*/&|!-]"))
    return F.ceil((F.length(text) - marks) / 4.0 + marks / 2.0).cast("long")


_QUOTED = "|".join(f"{q}[^{q}\\\\]*+(?:\\\\(?s:.|\\z)[^{q}\\\\]*+)*+(?:{q}|\\z)" for q in ("\"", "'", "`"))
_REMARK = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|{}\"\"\"(?s:.*?)(?:\"\"\"|\z)|'''(?s:.*?)(?:'''|\z)|({})"
#: What a comment is, where `#` begins one and where it doesn't; strings are the first group, which stays.
REMARKS = {True: _REMARK.format(r"#[^\n]*|", _QUOTED), False: _REMARK.format("", _QUOTED)}
#: White space of source text: that of ASCII and of Unicode's separators.
BLANKS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Identifiers, words that begin with a digit, and what is between.
LEXEMES = "[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_]*|[^A-Za-z0-9_]+"


def type_one(text: Column, hash_comments: Column) -> Column:
    """Code without comments and triple-quoted strings, its white space collapsed; other strings stay as they are. What
    isn't closed goes to the end. ``hash_comments``: whether `#` begins a comment."""
    bare = F.when(hash_comments, F.regexp_replace(text, REMARKS[True], "$1")).otherwise(F.regexp_replace(text, REMARKS[False], "$1"))
    return F.trim(F.regexp_replace(bare, BLANKS, " "))


def type_two(code: Column, keywords: frozenset[str] = KEYWORDS, words: str = "[A-Za-z0-9_]+") -> Column:
    """Code with each identifier that isn't a keyword in place of its number in order of first use, one text at a time.
    words: what may be an identifier, unless it begins with a digit."""

    def renamed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            names: dict[str, str] = {}
            name = lambda m: m[0] if m[0] in keywords or m[0][0].isdigit() else names.setdefault(m[0], f"_v{len(names)}")
            return None if text is None else re.sub(words, name, text)

        return texts.map(one)

    return F.pandas_udf(renamed, "string")(code)


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` tokens."""
    runs = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - size), lambda i: F.concat_ws("\x00", *[F.get(t, i + j) for j in range(size)]))
    none = F.array().cast("array<string>")
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= size, F.array_distinct(runs(t))).otherwise(none)), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; of two empty ones, 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.size(F.array_union(a, b)))

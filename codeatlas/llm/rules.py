"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule holds a count against another count: 100 times the first lies between ``least`` and ``most`` times the second, in
whole numbers, so no rounding decides (without a second count, the first itself lies between them). The counts are of
words (runs of other characters than space and \\t to \\r), characters, symbols, stop words and lines of a text. A text
is kept if no rule fails. The same table compiles to DuckDB SQL (``verdict_sql``), where the rules are the same text.

Null text has no words, as an empty one. Equal texts get equal counts; rows that repeat stay. No rows give no rows. Other
columns come through, and where one is named like a result, in whatever case, it gives way. A task holds the words of
one text, and its windows of three words, at a time, so memory follows the longest text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import apart

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()[]"
#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with as are be by this at from have not on you he she we they but or an a "
    "der die das und in den von zu sich mit für des auf ist nicht im dem eine ein als auch es an werden "
    "de la le les des et en un une du que pour est dans qui par au sur pas avec ce il sont "
    "el los las y se del con por para no su al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """100 * count between least * of and most * of; where ``of`` is empty, count between least and most."""

    name: str
    count: str
    of: str = ""
    least: int | None = None
    most: int | None = None


#: A text that fails one of these is never kept.
BASE = (Rule("few_words", "n_words", least=50), Rule("repeated_words", "n_repeat_words", "n_words", most=50))
#: The thresholds, in percent where a rule has a second count.
RULES = (
    *BASE,
    Rule("word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("exclamations", "n_exclamations", "n_words", most=20),
    Rule("capitals", "n_capitals", "n_letters", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=60),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_capitals", "n_letters", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")
RESULTS = (*COUNTS, "failed", "base_failed", "kept")
BULLETS = ("•", "-", "*", "‣", "●")
ELLIPSES = ("...", "…")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """Words in a window of three that the text holds twice or more: windows are sorted, those equal to a neighbour
    keep their places, and what these cover is counted."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"])

    def places(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    return F.when(F.size(words) >= 4, _with(F.sort_array(windows), lambda s: covered(places(s)))).otherwise(0)


def counts(text: Column) -> Column:
    """The counts of a text, as one struct."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    bare = lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION)))
    many = lambda a, test: F.size(F.filter(a, test))
    starts = lambda x, those: F.substring(F.ltrim(x, F.lit(SPACE)), 1, 1).isin(*those)
    ends = lambda x: F.endswith(F.rtrim(x, F.lit(SPACE)), F.lit(ELLIPSES[0])) | F.endswith(F.rtrim(x, F.lit(SPACE)), F.lit(ELLIPSES[1]))

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
        of_words = _with(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("again"), many(w, lambda x: bare(x).isin(*STOP_WORDS)).alias("stop")))
        of_lines = _with(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"), many(x, lambda y: starts(y, BULLETS)).alias("bullets"), many(x, ends).alias("ellipses")))
        chars = F.char_length(t)
        capitals = chars - _without(t, _CAPITALS)
        return F.struct(
            of_words.alias("words"), of_lines.alias("lines"), _without(t, SPACE).alias("word_chars"), (chars - _without(t, SYMBOLS)).alias("n_symbols"),
            (chars - _without(t, "!")).alias("n_exclamations"), capitals.alias("n_capitals"), (capitals + chars - _without(t, _CAPITALS.lower())).alias("n_letters"),
        )

    def named(x: Column) -> Column:
        parts = {"n_words": x["words"]["n"], "n_repeat_words": x["words"]["again"], "n_stop_words": x["words"]["stop"], "n_lines": x["lines"]["n"], "n_dup_lines": x["lines"]["again"], "n_bullet_lines": x["lines"]["bullets"], "n_ellipsis_lines": x["lines"]["ellipses"]}
        return F.struct(*[parts.get(c, x[c] if c not in parts else None).cast("long").alias(c) for c in COUNTS])

    return _with(_with(t, of), named)


def _fails(rule: Rule, x: Column) -> Column:
    count, of = (100 * x[rule.count], x[rule.of]) if rule.of else (x[rule.count], F.lit(1))
    out = F.lit(False)
    if rule.least is not None:
        out = out | (count < rule.least * of)
    if rule.most is not None:
        out = out | (count > rule.most * of)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with the counts (long), ``failed`` (names of the rules that a text fails, in the table's order),
    ``base_failed`` and ``kept``. Rules of ``BASE`` always hold."""
    rules = (*BASE, *[r for r in rules if r not in BASE])
    away, names, back = apart(docs, RESULTS)

    def verdict(x: Column) -> Column:
        failed = F.filter(F.array(*[F.when(_fails(r, x), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull())
        base = _fails(BASE[0], x) | _fails(BASE[1], x)
        return _with(failed, lambda f: F.struct(*[x[c].alias(c) for c in COUNTS], f.alias("failed"), base.alias("base_failed"), (F.size(f) == 0).alias("kept")))

    judged = away.withColumn("_x", _with(counts(F.col(names[text_col])), verdict))
    return back(judged.select(*away.columns, "_x.*"))


def verdict_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB's condition that no rule fails, over columns named like the counts."""
    out = []
    for r in rules:
        count, of = (f"100 * {r.count}", r.of) if r.of else (r.count, "1")
        out += [f"{count} >= {r.least} * {of}"] if r.least is not None else []
        out += [f"{count} <= {r.most} * {of}"] if r.most is not None else []
    return " AND ".join(out)

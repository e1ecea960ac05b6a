"""Secret scans: three patterns, and a battery of randomness tests over every other long token. SQL functions only.

Patterns (spans in code points, end exclusive): *assign* (a credential's name, a sign and a value of 6 characters or
more), *access* (AKIA and capitals or digits, 20 or more), *hex* (24 or more hexadecimal digits). Positions come from
the gaps that splitting by the pattern leaves.

The battery looks at tokens of 20 characters or more that hold a digit and a letter and belong to one of the
``ENCODINGS``, the first whose alphabet holds all their characters. Under uniform symbols of that alphabet it takes four
p values: chi-squared of the symbol counts (Wilson and Hilferty's cube root), Wald and Wolfowitz's runs about the middle
of the alphabet and of the character classes, and the lag-1 serial correlation. The Cauchy combination joins them, which
holds under dependence. A secret is random, so its p is even on (0, 1), while that of a name or a word is near 0: the
number of tokens with p above a half, doubled, tells how many random ones there are in an encoding and length class over
the whole corpus. Tokens are reported (kind *random*) from the largest p down to the least at which what random tokens
can't account for is at most ``rate`` of all reported: the false discoveries among them. The rule needs only how many
tokens have each p, so a histogram of p (``BINS`` steps of its logarithm) is counted, never a list.

Null text is empty and has no spans. Rows are rows of their own, whatever their ids. Columns may have any name; those
named like a result give way to it. An empty table gives an empty result. Texts are scanned whole, and each step takes
time in proportion to a text's length, the number of its matches or a token's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import apart, save

# fixed values: the patterns of the three kinds, the least length of the group that decides, in their order
KINDS = [
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 6),
    ("access", r"AKIA[A-Z0-9]{16,}", None, 20),
    ("hex", r"[0-9a-f]{24,}", None, 24),
]
RANDOM = "random"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
# alphabet of each encoding, in the order of its values
ENCODINGS = [
    ("hex", _DIGITS + "abcdef", r"^[0-9a-f]+$"),
    ("HEX", _DIGITS + "ABCDEF", r"^[0-9A-F]+$"),
    ("base32", _LOWER.upper() + "234567", r"^[A-Z2-7]+$"),
    ("base36", _DIGITS + _LOWER, r"^[0-9a-z]+$"),
    ("BASE36", _DIGITS + _LOWER.upper(), r"^[0-9A-Z]+$"),
    ("base62", _DIGITS + _LOWER.upper() + _LOWER, r"^[0-9A-Za-z]+$"),
    ("base64", _LOWER.upper() + _LOWER + _DIGITS + "+/", r"^[A-Za-z0-9+/]+$"),
    ("base64url", _LOWER.upper() + _LOWER + _DIGITS + "-_", r"^[A-Za-z0-9_-]+$"),
]
#: Steps of -ln p that the histogram tells apart: a step is 1/BINS.
BINS, TOP = 20, 60
#: Steps with a p above about a half.
UPPER = 14
#: Matches of a text whose places are summed up in one go.
BLOCK = 64


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: what a lambda function uses from outside is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, end, kind, value) of the pattern's matches, leftmost first and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    ends = _let(F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: g + F.coalesce(m, F.lit(0))), lambda x: _running(x))
    # there is one gap more than matches
    out = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(out, lambda s: s["value"].isNotNull())).otherwise(none)


def _running(x: Column, op=lambda a, b: a + b) -> Column:
    """Sums (or another operation) of each beginning of an array of positive numbers. A fold copies its state at each
    step, so long arrays go in blocks."""
    none, last = F.array().cast("array<int>"), lambda y: F.coalesce(F.get(y, F.size(y) - 1), F.lit(0))
    fold = lambda y: F.aggregate(y, none, lambda acc, v: F.concat(acc, F.array(op(last(acc), v))))
    starts = F.sequence(F.lit(1), F.greatest(F.size(x), F.lit(1)), F.lit(BLOCK))
    blocks = F.aggregate(starts, none, lambda acc, i: F.concat(acc, F.transform(fold(F.slice(x, i, BLOCK)), lambda v: op(last(acc), v))))
    return F.when(F.size(x) <= BLOCK, fold(x)).otherwise(blocks)


def base_spans(text: Column) -> list[Column]:
    """The spans of the three kinds that are long enough."""
    return [_long_enough(_spans(text, kind, pattern), group, least) for kind, pattern, group, least in KINDS]


def _long_enough(spans: Column, group: str | None, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["value"], group, 1)) >= least) if group else spans


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0 (Abramowitz and Stegun 26.2.17, to 1e-7), with the leading term beyond 6."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.least(F.when(z > 6, density / z).otherwise(density * poly), F.lit(0.5))


def _encoding(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, pattern in reversed(ENCODINGS):
        out = F.when(F.regexp_like(token, F.lit(pattern)), name).otherwise(out)
    return out


def _of(encoding: Column, value) -> Column:
    """``value`` of the encoding's alphabet."""
    out = F.lit(None)
    for name, letters, _ in ENCODINGS:
        out = F.when(encoding == name, F.lit(value(letters))).otherwise(out)
    return out


def _runs(bits: Column, n: Column) -> Column:
    """Two-sided p value of the number of runs in a string of 0 and 1."""
    ones = n - F.length(F.replace(bits, F.lit("1"), F.lit("")))
    zeros = n - ones
    turns = F.regexp_count(bits, F.lit("0+|1+")).cast("double")
    mean = 2 * ones * zeros / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return F.when((ones == 0) | (zeros == 0), F.lit(1e-12)).when(var <= 0, F.lit(1.0)).otherwise(2 * normal_tail(F.abs(turns - mean) / F.sqrt(var)))


def _cauchy(ps: list[Column]) -> Column:
    """Cauchy combination of p values."""
    inside = [F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-9)) for p in ps]
    t = sum((F.tan((0.5 - p) * math.pi) for p in inside), F.lit(0.0)) / len(ps)
    return F.greatest(F.lit(1e-15), F.when(t > 1e5, 1 / (t * math.pi)).otherwise(0.5 - F.atan(t) / math.pi))


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (a column ``token``) with encoding, n, p_chi2, p_runs, p_class, p_serial and their combination p."""
    x = tokens.withColumn("encoding", _encoding(F.col("token"))).filter("encoding is not null")
    x = x.withColumns({"n": F.length("token").cast("double"), "k": _of(F.col("encoding"), lambda a: float(len(a))), "alphabet": _of(F.col("encoding"), lambda a: a)})
    # how often each symbol of the alphabet occurs; those with none count as well
    times = lambda c: F.pow(F.col("n") - F.length(F.replace(F.col("token"), c, F.lit(""))), F.lit(2.0))
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda acc, c: acc + times(c))
    df = F.col("k") - 1
    x = x.withColumn("chi2", squares * F.col("k") / F.col("n") - F.col("n"))
    z = (F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # one pass over the symbols' values: their sum, squares and products with the value before
    number = lambda c: F.call_function("instr", F.col("alphabet"), c).cast("double") - 1
    zero, state = F.lit(0.0), lambda s, ss, sp, last: F.struct(s.alias("s"), ss.alias("ss"), sp.alias("sp"), last.alias("last"))
    x = x.withColumn("sums", F.aggregate(F.split("token", ""), state(zero, zero, zero, zero), lambda a, c: state(a["s"] + number(c), a["ss"] + number(c) * number(c), a["sp"] + a["last"] * number(c), number(c))))
    n, first = F.col("n"), number(F.substring("token", 1, 1))
    mean = F.col("sums.s") / n
    power = F.col("sums.ss") - n * mean * mean
    lag = F.col("sums.sp") - mean * (2 * F.col("sums.s") - first - F.col("sums.last")) + (n - 1) * mean * mean
    r = F.when(power > 1e-9, lag / power).otherwise(F.lit(1.0))
    serial = F.abs(r + 1 / n) * F.sqrt(n)
    halves = _of(F.col("encoding"), lambda a: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2))
    digits = F.translate(F.translate("token", _DIGITS, "0" * 10), _LOWER + _LOWER.upper() + "+/-_", "1" * 56)
    return x.withColumns({
        "p_chi2": F.when(z > 0, normal_tail(z)).otherwise(1 - normal_tail(-z)),
        "p_runs": _runs(F.call_function("translate", F.col("token"), F.col("alphabet"), halves), n),
        "p_class": _runs(digits, n),
        "p_serial": 2 * normal_tail(serial),
    }).withColumn("p", _cauchy([F.col("p_chi2"), F.col("p_runs"), F.col("p_class"), F.col("p_serial")])).drop("alphabet", "sums", "chi2", "k")


def _class(n: Column) -> Column:
    return F.when(n < 24, 20).when(n < 32, 24).when(n < 40, 32).when(n < 64, 40).otherwise(64)


def thresholds(tests: DataFrame, rate: float) -> DataFrame:
    """encoding, length class, and the last step of the histogram (from the largest p) up to which tokens are reported:
    at most ``rate`` of them are more than the random ones account for. None: no row. A few hundred rows at most."""
    from pyspark.sql import Window

    counts = tests.groupBy("encoding", "length", "bin").count()
    key = Window.partitionBy("encoding", "length")
    # at most BINS * TOP rows a class
    random = F.sum(F.when(F.col("bin") < UPPER, F.col("count")).otherwise(0)).over(key) / (1 - math.exp(-UPPER / BINS))
    run = counts.withColumns({"upto": F.sum("count").over(key.orderBy("bin")), "random": random})
    ok = run.filter(F.col("upto") - F.col("random") * (1 - F.exp(-(F.col("bin") + 1) / BINS)) <= rate * F.col("upto"))
    return ok.groupBy("encoding", "length").agg(F.max("bin").alias("last_bin"))


def _scan(docs: DataFrame, text_col: str, keep: list[str], rate: float) -> DataFrame:
    """Columns of docs (whose names clash with nothing), and the spans as columns of their kinds' names."""
    kinds = [k[0] for k in KINDS]
    x = docs.withColumn("t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    x = x.select(*keep, *[s.alias(k) for s, k in zip(base_spans(F.col("t")), kinds, strict=True)], _spans(F.col("t"), RANDOM, TOKEN).alias("tokens"))
    mixed = lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(s["value"], F.lit("[A-Za-z]"))
    x = x.withColumn("tokens", F.filter("tokens", mixed)).withColumn("row", F.monotonically_increasing_id())
    x = save(x, "spans")  # the row numbers are fixed here
    tests = x.select("row", F.explode("tokens").alias("s")).select("row", "s.start", "s.end", F.col("s.value").alias("token"))
    tests = battery(tests).withColumns({"length": _class(F.col("n")), "bin": F.least(F.floor(-F.log("p") * BINS), F.lit(BINS * TOP))})
    tests = save(tests.select("row", "start", "end", "encoding", "length", "bin", "n", "p"), "battery")
    limits = F.broadcast(thresholds(tests, rate))  # one row for each encoding and length class
    random = tests.join(limits, ["encoding", "length"]).filter("bin <= last_bin")
    random = random.groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit(RANDOM).alias("kind"))).alias(RANDOM))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return x.join(random, "row", "left").select(*keep, *[bare(F.col(k)).alias(k) for k in kinds], F.coalesce(RANDOM, none).alias(RANDOM))


def scan(docs: DataFrame, rate: float = 0.05, text_col: str = "text") -> DataFrame:
    """The columns of docs but the text, with ``assign``, ``access``, ``hex``, ``random``: arrays of (start, end, kind)."""
    results = [*[k[0] for k in KINDS], RANDOM]
    away, names, _ = apart(docs)
    keep = [c for c in docs.columns if c != text_col and c.lower() not in results]
    found = _scan(away, names[text_col], [names[c] for c in keep], rate)
    return found.select(*[F.col(names[c]).alias(c) for c in keep], *results)


def _listed(spans: Column) -> Column:
    """kind:start:end by start and then kind as listed, joined by commas."""
    order = F.create_map(*[x for i, k in enumerate([k[0] for k in KINDS] + [RANDOM]) for x in (F.lit(k), F.lit(i))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("b"), s["end"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, how many spans of each kind, the digest of the patterns' spans, and all spans."""
    base = F.concat(*[F.col(k[0]) for k in KINDS])
    return found.select(
        "doc_id", *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, F.col(RANDOM))).alias("spans"),
        F.size(RANDOM).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, rate: float = 0.05, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its texts replaced by the mark; spans that overlap are replaced as one."""
    away, names, back = apart(docs)
    text = F.col(names[text_col])
    found = _scan(away, names[text_col], away.columns, rate)
    spans = F.array_sort(F.concat(*[F.col(k[0]) for k in KINDS], F.col(RANDOM)))
    # what stays lies between the end of all spans before and the start of the next, where that is not before it
    found = found.withColumn("spans", spans).withColumn("ends", _running(F.transform("spans", lambda x: x["end"]), F.greatest))
    reached = lambda i: F.coalesce(F.get(F.col("ends"), i - 1), F.lit(0))
    gaps = F.filter(F.transform("spans", lambda x, i: F.struct(reached(i).alias("a"), x["start"].alias("b"))), lambda g: g["a"] <= g["b"])
    gaps = F.concat(gaps, F.array(F.struct(reached(F.size("spans")).alias("a"), F.length(text).alias("b"))))
    clean = F.array_join(F.transform(gaps, lambda g: F.substring(text, g["a"] + 1, g["b"] - g["a"])), mark)
    found = found.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    return back(found.drop(names[text_col]).withColumnRenamed("clean", names[text_col]))

"""Sharding by an exact uniform shuffle. SQL functions only.

Rows are first written with their place (partition and number within it), so every later step sees the same ones.
How many rows each partition sends to each shard is drawn from the multivariate hypergeometric law, which a uniform
permutation of all rows would give: rows of the matrix sum to the partitions' sizes, columns to the shards', exactly.
The matrix is drawn in two levels, first for groups of about sqrt(partitions) partitions and then within each group in
parallel, each by a fold over the sizes left, so no task handles more than one level's share. Each partition is then
permuted locally (its rows' hashes put them in order, and the counts cut that order into shards), rows are exchanged,
and each shard is permuted again: rows have a random key, shards are cut into buckets of bounded size by it, a bucket
numbers its own rows, and running counts of the buckets make slots gapless.

All draws are hashes of a seed and of their place, so a task that is run again after a lost executor draws the same.

Shards differ by one row at most: the first (rows mod shards) have one more. Nulls are carried along like any value,
rows that repeat are rows of their own, and an empty table gives an empty result. Columns may have any name; ``shard`` and
``slot`` give way to the results. Only places and hashes are shuffled until the end, so long values cost no more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import apart, save


def uniform(*place: Column) -> Column:
    """A number in (0, 1) from a hash of its place."""
    return (F.shiftrightunsigned(F.xxhash64(*place), 11).cast("double") + 0.5) / float(1 << 53)


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8, and eight steps back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among ``draws`` of good + bad, at the quantile u: the law's terms within 9 standard
    deviations of its mean (less than 1e-15 lies beyond), each from the one before, and the first running sum past u."""
    given = F.struct(good.cast("double").alias("good"), bad.cast("double").alias("bad"), draws.cast("double").alias("draws"), u.alias("u"))
    return F.when((good + bad <= 0) | (draws <= 0), F.lit(0).cast("long")).otherwise(_let(given, lambda a: _let(_range(a), lambda b: _walk(a, b)))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _range(a: Column) -> Column:
    """Least and largest number to look at, and the law's term at the least."""
    total = a["good"] + a["bad"]
    mean = a["draws"] * a["good"] / total
    sd = F.sqrt(mean * a["bad"] / total * (total - a["draws"]) / F.greatest(total - 1, F.lit(1.0)))
    ends = F.struct(
        F.greatest(F.lit(0.0), a["draws"] - a["bad"], F.floor(mean - 9 * sd - 9).cast("double")).alias("low"),
        F.least(a["good"], a["draws"], F.ceil(mean + 9 * sd + 9).cast("double")).alias("high"),
    )
    binomial = lambda n, k: _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
    return _let(ends, lambda e: F.struct(e["low"].alias("low"), e["high"].alias("high"), F.exp(binomial(a["good"], e["low"]) + binomial(a["bad"], a["draws"] - e["low"]) - binomial(total, a["draws"])).alias("term")))


def _walk(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), (b["high"] - b["low"]).cast("int"))),
        F.struct(b["low"].alias("x"), b["term"].alias("term"), b["term"].alias("sum")),
        lambda s, _: F.when((s["sum"] >= a["u"]) | (s["x"] >= b["high"]), s).otherwise(_let(s["term"] * (a["good"] - s["x"]) * (a["draws"] - s["x"]) / ((s["x"] + 1) * (a["bad"] - a["draws"] + s["x"] + 1)), lambda t: F.struct((s["x"] + 1).alias("x"), t.alias("term"), (s["sum"] + t).alias("sum")))),
        lambda s: s["x"],
    )


def _draw_row(size: Column, capacity: Column, *place: Column) -> Column:
    """How many of ``size`` rows go to each shard, given the places left in each."""
    done = F.aggregate(
        F.sequence(F.lit(0), F.size(capacity) - 1),
        F.struct(F.array().cast("array<long>").alias("counts"), size.cast("long").alias("left"), F.aggregate(capacity, F.lit(0).cast("long"), lambda a, c: a + c).alias("rest")),
        lambda s, j: _give(s, F.get(capacity, j), uniform(*place, j)),
    )
    return done["counts"]


def _give(s: Column, own: Column, u: Column) -> Column:
    rest = s["rest"] - own
    n = F.when(rest <= 0, F.least(s["left"], own)).otherwise(hypergeometric(own, rest, s["left"], u))
    return _let(n, lambda k: F.struct(F.concat(s["counts"], F.array(k)).alias("counts"), (s["left"] - k).alias("left"), rest.alias("rest")))


def draw_matrix(sizes: Column, capacity: Column, level: Column, seed: int) -> Column:
    """Counts for each of the sizes in turn, an array of arrays, whose columns sum to the capacities."""
    start = F.struct(F.array().cast("array<array<long>>").alias("rows"), capacity.alias("left"))
    done = F.aggregate(
        sizes, start,
        lambda s, n: _let(
            _draw_row(n, s["left"], F.lit(seed), level, F.size(s["rows"])),
            lambda row: F.struct(F.concat(s["rows"], F.array(row)).alias("rows"), F.zip_with(s["left"], row, lambda a, b: a - b).alias("left")),
        ),
    )
    return done["rows"]


def communication(placed: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, counts): how many rows each partition sends to each shard. placed: a table with a column ``part``."""
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    numbered = sizes.withColumn("i", F.row_number().over(Window.orderBy("part")) - 1)  # one light row for each partition
    numbered = save(numbered, "partitions")
    total = numbered.agg(F.sum("n").alias("rows"), F.count("*").alias("parts")).first()
    rows, parts = int(total["rows"] or 0), int(total["parts"])
    width = max(1, math.isqrt(parts))
    capacity = F.array(*[F.lit(rows // shards + (j < rows % shards)).cast("long") for j in range(shards)])
    grouped = numbered.withColumn("g", F.floor(F.col("i") / width).cast("long"))
    by_group = grouped.groupBy("g").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "n"))).alias("members"))
    top = by_group.agg(F.sort_array(F.collect_list(F.struct("g", "n"))).alias("x"))  # sqrt(partitions) numbers
    top = top.select(F.col("x.g").alias("gs"), draw_matrix(F.col("x.n"), capacity, F.lit(-1).cast("long"), seed).alias("rows"))
    top = top.select(F.explode(F.arrays_zip("gs", "rows")).alias("y")).select(F.col("y.gs").alias("g"), F.col("y.rows").alias("capacity"))
    inner = by_group.join(top, "g").select(F.col("members.part").alias("parts"), draw_matrix(F.col("members.n"), F.col("capacity"), F.col("g"), seed).alias("rows"))
    out = inner.select(F.explode(F.arrays_zip("parts", "rows")).alias("y"))
    return out.select(F.col("y.parts").alias("part"), F.col("y.rows").alias("counts"))


def shuffle_into_shards(rows: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = 100_000) -> DataFrame:
    """rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), in place of any such columns."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    away, _, back = apart(rows, ("shard", "slot"))
    placed = save(away.withColumn("uid", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("uid", 33))  # places are fixed by what was written
    counts = save(communication(placed.select("part"), shards, seed), "matrix")
    # permute locally: rank by a hash within the partition; the counts cut the ranks into shards
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("uid", F.lit(seed)), "uid")) - 1
    ends = F.aggregate("counts", F.array().cast("array<long>"), lambda a, c: F.concat(a, F.array(F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(0) + c)))
    light = placed.select("uid", "part").withColumn("rank", rank).join(counts.select("part", ends.alias("ends")), "part")
    light = light.select("uid", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    # permute again: buckets of the shard by a random key, numbered within
    total = placed.count()
    buckets = max(1, math.ceil(total / shards / bucket_rows))
    key = F.xxhash64("uid", F.lit(seed + 1))
    keyed = save(light.select("uid", "shard", key.alias("key"), F.pmod(F.shiftrightunsigned(key, 20), F.lit(buckets)).alias("bucket")), "exchange")
    sizes = keyed.groupBy("shard", "bucket").count()
    before = sizes.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key", "uid")) - 1
    slots = keyed.withColumn("number", number).join(before, ["shard", "bucket"]).select("uid", "shard", (F.col("before") + F.col("number")).alias("slot"))
    return back(placed.join(slots, "uid"))

"""Loops to a fixpoint, and global numbering, over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.session import materialize


def fixpoint(seed: DataFrame, key: list[str], step: Callable[[DataFrame], DataFrame], label: str, rounds: int | None = None) -> DataFrame:
    """seed and all that ``step`` makes of the rows of the round before, until no row has a new ``key`` (or after so many
    rounds). step returns one row for each key; the row of the earliest round stays. Each round joins what is new only."""
    seen = front = materialize(seed, label)
    turn = 0
    while (rounds is None or turn < rounds) and not front.isEmpty():
        front = materialize(step(front).join(seen.select(*key), key, "left_anti").select(*seen.columns), label)
        seen = seen.unionByName(front)
        turn += 1
        if turn % 8 == 0:  # few files to read in each round
            seen = materialize(seen, label)
    return seen


def numbered(rows: DataFrame, order: list[Column], name: str = "i") -> DataFrame:
    """rows with their number from 0 in a total order: sorted in ranges, of which only the sizes meet in one place."""
    part, own = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_own")
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", part, own), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")

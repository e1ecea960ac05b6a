"""Tasks that need and hinder one another: which can run together, and the longest chain. Tables in, tables out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.fixpoint import numbered
from codeatlas.session import materialize

#: Tasks that are placed in one round, by one task of Spark, when all needs point back.
BLOCK = 4096
#: Waves that a number of what a resource has taken tells of.
WORD = 32


def _place(x: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """The wave of each task of a block, in order: the first after its needs in which none of what it holds is taken."""
    taken: dict = {}
    for resource, word, bits in zip(words["resource"], words["word"], words["bits"], strict=True):
        taken[resource] = taken.get(resource, 0) | int(bits) << WORD * int(word)
    wave: dict = {}
    for i, least, needs, held in sorted(zip(x["i"], x["least"], x["needs"], x["held"], strict=True), key=lambda t: t[0]):
        at = max([int(least), *(wave[k] + 1 for k in needs)])
        full = 0
        for r in held:
            full |= taken.get(r, 0)
        full >>= at
        at += (~full & (full + 1)).bit_length() - 1
        for r in held:
            taken[r] = taken.get(r, 0) | 1 << at
        wave[i] = at
    return pd.DataFrame({"i": list(wave.keys()), "wave": list(wave.values())})


def waves_in_order(tasks: DataFrame, needs: DataFrame, holds: DataFrame, block: int | None = None) -> DataFrame:
    """``waves`` where each task (distinct) needs only tasks before it: a task's wave then hangs on tasks before it alone, so
    blocks of them are placed one after the other. A block is given, of what was placed before, the least wave that its
    needs allow and the waves that its resources have taken, as numbers of ``WORD`` bits."""
    size = F.lit(block or BLOCK)
    own = materialize(numbered(tasks.select("task"), [F.col("task")]).withColumn("block", F.floor(F.col("i") / size).cast("long")), "tasks")
    place = own.select("task", "i", "block")
    behind = needs.join(place, "task").join(own.select(F.col("task").alias("needs"), F.col("i").alias("need"), F.col("block").alias("need_block")), "needs")
    behind = materialize(behind.select("block", "i", "need", "need_block"), "pending")
    held = holds.filter("resource is not null").select("task", "resource").distinct().join(place, "task").select("block", "i", "resource")
    # what one task holds hinders none
    held = materialize(held.join(held.groupBy("resource").agg(F.count("*").alias("n")).filter("n > 1").select("resource"), "resource", "left_semi"), "holds")
    kind = held.schema["resource"].dataType.simpleString()
    nothing = own.sparkSession.createDataFrame([], f"resource {kind}, word long, bits long")
    last = own.agg(F.max("block")).first()[0]
    done, taken = own.sparkSession.createDataFrame([], "i long, wave int"), nothing
    for b in range(0 if last is None else last + 1):
        here = F.col("block") == b
        mine = held.filter(here).select("i", "resource")
        x = own.filter(here).select("i").join(mine.groupBy("i").agg(F.collect_list("resource").alias("held")), "i", "left")
        x = x.join(behind.filter(here & (F.col("need_block") == b)).groupBy("i").agg(F.collect_list("need").alias("needs")), "i", "left")
        before = behind.filter(here & (F.col("need_block") < b)).join(done.withColumnRenamed("i", "need"), "need")
        x = x.join(before.groupBy("i").agg((F.max("wave") + 1).alias("least")), "i", "left")
        empty = lambda t: F.array().cast(f"array<{t}>")
        x = x.select(F.lit(0).alias("all"), "i", F.coalesce("least", F.lit(1)).alias("least"), F.coalesce("needs", empty("long")).alias("needs"), F.coalesce("held", empty(kind)).alias("held"))
        words = taken.join(mine.select("resource").distinct(), "resource", "left_semi").select(F.lit(0).alias("all"), "resource", "word", "bits")
        now = materialize(x.groupBy("all").cogroup(words.groupBy("all")).applyInPandas(_place, "i long, wave int"), "waves")
        done = done.unionByName(now)
        new = mine.join(now, "i").select("resource", F.floor(F.col("wave") / WORD).cast("long").alias("word"), F.expr(f"shiftleft(1L, wave % {WORD})").alias("bits"))
        if b < last:
            taken = materialize(taken.unionByName(new).groupBy("resource", "word").agg(F.bit_or("bits").alias("bits")), "taken")
            if b % 8 == 7:
                done = materialize(done, "waves")
    return own.join(done, "i").select("task", "wave")


def apart_tasks(ready: DataFrame, holds: DataFrame) -> DataFrame:
    """The tasks of ``ready`` (task) that a pass in order would let run together: no two hold (task, resource) the same.
    In rounds: a task that is the first on all that it holds runs, and those that share something with it don't."""
    left = materialize(holds.filter("resource is not null").join(ready.select("task"), "task", "left_semi").select("task", "resource").distinct(), "holds")
    done = ready.select("task").join(left.select("task").distinct(), "task", "left_anti")
    while not left.isEmpty():
        first = left.groupBy("resource").agg(F.min("task").alias("first"))
        ahead = left.join(first, "resource").groupBy("task").agg(F.max(F.col("task") != F.col("first")).alias("waits")).filter("not waits").select("task")
        ahead = materialize(ahead, "ahead")
        done = done.unionByName(ahead)
        taken = left.join(ahead, "task", "left_semi").select("resource").distinct()
        out = materialize(left.join(taken, "resource", "left_semi").select("task").distinct(), "out")
        left = materialize(left.join(out, "task", "left_anti"), "holds")
    return materialize(done, "together")


def waves(tasks: DataFrame, needs: DataFrame, holds: DataFrame) -> DataFrame:
    """(task, wave): the wave, from 1, in which each task runs: after all that it needs (task, needs), and apart from those
    that hold the same resource. Null for tasks in a cycle or behind one. A task that needs one that isn't there doesn't
    wait for it. A round for each block of tasks where all need only tasks before them, else for each wave."""
    left = materialize(tasks.select("task").distinct(), "tasks")
    pending = needs.select("task", "needs").filter("task is not null").distinct()
    pending = materialize(pending.join(left, "task", "left_semi").join(left.withColumnRenamed("task", "needs"), "needs", "left_semi"), "pending")
    if pending.filter("needs >= task").isEmpty():
        return waves_in_order(left, pending, holds)
    done, wave = None, 0
    while True:
        ready = left.join(pending.select("task").distinct(), "task", "left_anti")
        now = apart_tasks(ready, holds)
        if now.isEmpty():
            break
        wave += 1
        mine = now.select("task", F.lit(wave).alias("wave"))
        done = mine if done is None else done.unionByName(mine)
        left = materialize(left.join(now, "task", "left_anti"), "tasks")
        pending = materialize(pending.join(now.withColumnRenamed("task", "needs"), "needs", "left_anti"), "pending")
        if wave % 8 == 0:
            done = materialize(done, "waves")
    rest = left.select("task", F.lit(None).cast("int").alias("wave"))
    return rest if done is None else done.unionByName(rest)


def longest_chains(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, total, steps, after): the costliest chain of needs that ends with each task (task, cost), its cost and length,
    and the task before it on that chain (the least of equal ones). Null for tasks in a cycle or behind one."""
    left = materialize(tasks.groupBy("task").agg(F.max("cost").alias("cost")), "tasks")
    pairs = needs.select("task", "needs").distinct().join(left.select("task"), "task", "left_semi").join(left.select(F.col("task").alias("needs")), "needs", "left_semi")
    pairs, none = materialize(pairs, "needs"), F.lit(None)
    kind = left.schema["task"].dataType
    # a task's best chain is known once all that it needs are
    done = materialize(left.join(pairs.select("task").distinct(), "task", "left_anti").select("task", F.col("cost").alias("total"), F.lit(1).alias("steps"), none.cast(kind).alias("after")), "chains")
    front, pending = done, pairs
    best = None
    while not front.isEmpty():
        got = pending.join(front.select(F.col("task").alias("needs"), "total", "steps"), "needs")
        got = got.select("task", F.struct("total", "steps", (-F.col("needs")).alias("m")).alias("x"))
        got = got if best is None else got.unionByName(best)
        best = materialize(got.groupBy("task").agg(F.max("x").alias("x")), "best")
        pending = materialize(pending.join(front.select(F.col("task").alias("needs")), "needs", "left_anti"), "needs")
        ready = best.join(pending.select("task").distinct(), "task", "left_anti").join(left, "task")
        front = materialize(ready.select("task", (F.col("x.total") + F.col("cost")).alias("total"), (F.col("x.steps") + 1).alias("steps"), (-F.col("x.m")).cast(kind).alias("after")), "chains")
        best = materialize(best.join(front.select("task"), "task", "left_anti"), "best")
        done = done.unionByName(front)
    lost = left.join(done.select("task"), "task", "left_anti").select("task", none.cast(done.schema["total"].dataType).alias("total"), none.cast("int").alias("steps"), none.cast(kind).alias("after"))
    return done.unionByName(lost)

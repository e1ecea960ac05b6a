"""Paths and what lies on them: cheapest paths, all simple ones, betweenness. Edges are (src, dst, conf) or (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.operators.graph import bfs, reversed_edges, shortest
from codeatlas.session import materialize


def trace_back(best: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, distance, hops, path) of the targets (ids) that were reached; path: the ids from a seed on. best: see
    ``shortest``. All paths go back a step in each round, along the predecessors."""
    own = best.join(targets.select("id").distinct(), "id", "left_semi")
    left = materialize(own.select("id", "distance", "hops", "predecessor", F.array("id").alias("path")), "trace")
    step = best.select(F.col("id").alias("at"), F.col("predecessor").alias("before"))
    done = None
    while True:
        whole = left.filter("predecessor is null").drop("predecessor")
        done = whole if done is None else done.unionByName(whole)
        left = materialize(left.join(step, F.col("predecessor") == F.col("at")).select("id", "distance", "hops", F.col("before").alias("predecessor"), F.concat(F.array("at"), "path").alias("path")), "trace")
        if left.isEmpty():
            return done


def cheapest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_distance: int = 12, alternates: int = 3) -> DataFrame:
    """(rank, id, distance, hops, path, reached): the cheapest path from any source to any target that isn't a source,
    and the next best ones to other targets, by distance, hops and ids. reached: how many targets there are paths to, so
    that what was left out can be told."""
    best = materialize(shortest(edges, sources, max_distance), "best")
    wanted = targets.select("id").distinct().join(sources.select("id"), "id", "left_anti")
    found = trace_back(best, wanted)
    total = found.agg(F.count("*").alias("reached"))
    first = found.orderBy("distance", "hops", "path", "id").limit(1 + alternates)
    rank = F.row_number().over(Window.orderBy("distance", "hops", "path", "id"))  # a handful of rows
    return first.select(rank.alias("rank"), "id", "distance", "hops", "path").crossJoin(F.broadcast(total))  # one row


def simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 6) -> DataFrame:
    """(path, hops): all paths of at most max_hops edges from a source to a target, without a node twice and without a
    target before the end (a source may be one). What can't reach a target in the hops that are left is given up at
    once, so prefixes don't outgrow what they lead to."""
    near = bfs(reversed_edges(edges.select("src", "dst", F.lit(None).cast("string").alias("conf"))), targets, max_hops)
    near = materialize(near.withColumnRenamed("depth", "rest"), "near")
    pairs = edges.select("src", "dst").filter("src <> dst").distinct().join(near, F.col("dst") == F.col("id")).select("src", "dst", "rest", (F.col("rest") == 0).alias("ends"))
    pairs = materialize(pairs, "pairs")
    front = materialize(sources.select(F.col("id").alias("last"), F.array("id").alias("path")).distinct(), "prefixes")
    done = None
    for hops in range(1, max_hops + 1):
        longer = front.join(pairs, front["last"] == pairs["src"]).filter((F.lit(hops) + F.col("rest") <= max_hops) & ~F.array_contains("path", F.col("dst")))
        longer = materialize(longer.select(F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"), "ends"), "prefixes")
        whole = longer.filter("ends").select("path", F.lit(hops).alias("hops"))
        done = whole if done is None else done.unionByName(whole)
        front = longer.filter("not ends").select("last", "path")
        if longer.isEmpty():
            break
    return done


def best_simple_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_hops: int = 6, most: int = 50) -> DataFrame:
    """The first ``most`` simple paths by hops and ids, with how many there are (``found``)."""
    every = materialize(simple_paths(edges, sources, targets, max_hops), "paths")
    return every.orderBy("hops", "path").limit(most).crossJoin(F.broadcast(every.agg(F.count("*").alias("found"))))  # one row


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "downstream") -> DataFrame:
    """(id, depth, direction) around the seeds: callees (downstream), callers (upstream) or both, each with its own
    depths. Depths beyond 20 are 20."""
    ways = {"downstream": ["downstream"], "upstream": ["upstream"], "both": ["downstream", "upstream"]}[direction]
    plain = edges.select("src", "dst", F.lit(None).cast("string").alias("conf"))
    out = [bfs(plain if w == "downstream" else reversed_edges(plain), seeds, max(1, min(20, depth))).withColumn("direction", F.lit(w)) for w in ways]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def betweenness(edges: DataFrame, sources: DataFrame, rows: int = 50_000_000) -> DataFrame:
    """(id, score): how much of the shortest paths from the sources (ids) goes through each node on them: the sum over
    sources of the dependency on the node. Edges of a pair count as often as they occur: take distinct ones for a
    simple graph; loops don't count.

    All sources of a batch are searched at once, level by level, on rows (source, node) with the number of shortest
    paths; then the levels are gone through backwards. Batches are as large as ``rows`` such rows may be."""
    pairs = materialize(edges.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("ways")), "pairs")
    sources = materialize(sources.select(F.col("id").alias("source")).distinct(), "sources")
    nodes = pairs.select("dst").distinct().count() + 1
    batches = max(1, -(-sources.count() * nodes // rows))
    parts = [_dependencies(pairs, sources.filter(F.pmod(F.xxhash64("source"), F.lit(batches)) == b)) for b in range(batches)]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("id").agg(F.sum("score").alias("score"))


def _dependencies(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    levels = [materialize(sources.select("source", F.col("source").alias("id"), F.lit(1.0).alias("sigma")), "level")]
    seen = levels[0].select("source", "id")
    while True:
        # every shortest path to the next level comes through this one, so its counts are complete
        x = levels[-1].join(pairs, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum(F.col("sigma") * F.col("ways")).alias("sigma"))
        level = materialize(x.join(seen, ["source", "id"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "id"))
        if len(levels) % 8 == 0:
            seen = materialize(seen, "seen")
    below, parts = None, []
    for d in range(len(levels) - 1, 0, -1):
        if below is None:
            own = levels[d].withColumn("delta", F.lit(0.0))
        else:
            give = below.select("source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share")).join(pairs, "dst").select("source", F.col("src").alias("id"), (F.col("share") * F.col("ways")).alias("share"))
            got = give.groupBy("source", "id").agg(F.sum("share").alias("share"))
            own = levels[d].join(got, ["source", "id"], "left").select("source", "id", "sigma", F.coalesce(F.col("sigma") * F.col("share"), F.lit(0.0)).alias("delta"))
        below = materialize(own, "delta")
        parts.append(below.groupBy("id").agg(F.sum("delta").alias("score")))
    if not parts:
        return sources.select(F.col("source").alias("id"), F.lit(0.0).alias("score")).limit(0)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return materialize(total.groupBy("id").agg(F.sum("score").alias("score")), "scores")

"""Graph operators: degrees, labels, traversal to fixpoint, ranking. All take edges (src, dst, conf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.session import materialize
from codeatlas.sources.tables import cost

HUB_FAN_IN, GOD_FAN_OUT = 5, 8


def distinct_calls(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst), without synthesized edges."""
    return edges.filter("conf <> 'synthesized'").select("src", "dst").distinct()


def fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out over distinct calls."""
    calls = distinct_calls(edges)
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.join(into, "id", "left").join(out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def criticality() -> Column:
    """Criticality of a node from its columns fan_in and fan_out."""
    return F.col("fan_in") * 3 + F.col("fan_out") * 1.5


def labels() -> Column:
    """Landmark labels, joined by commas."""
    kinds = [("hub", F.col("fan_in") >= HUB_FAN_IN), ("orchestrator", F.col("fan_out") >= 5), ("chokepoint", (F.col("fan_in") >= 3) & (F.col("fan_out") >= 3)), ("entrypoint", (F.col("fan_in") == 0) & (F.col("fan_out") > 0)), ("dead", (F.col("fan_in") == 0) & (F.col("fan_out") == 0))]
    return F.concat_ws(",", *[F.when(test, F.lit(name)) for name, test in kinds])


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth): least number of edges from any seed (a column id); to the fixpoint if no depth is given."""
    pairs = materialize(edges.select("src", "dst").distinct(), "pairs")
    reached = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "bfs")
    front, depth = reached, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(pairs, front["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        front = materialize(step.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
        if depth % 8 == 0:
            reached = materialize(reached, "bfs")
    return reached


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "conf")


def shortest(edges: DataFrame, seeds: DataFrame, max_distance: int = 12) -> DataFrame:
    """(id, distance, hops, predecessor): least cost from any seed over edges with a cost, the fewest edges among those
    paths, and the least node before it on such a path (null for seeds). Costs are 1 or more, so max_distance rounds do."""
    priced = materialize(edges.withColumn("cost", cost(F.col("conf"))).filter("cost is not null").groupBy("src", "dst").agg(F.min("cost").alias("cost")), "priced")
    none = F.lit(None).cast(priced.schema["src"].dataType)
    best = materialize(seeds.select("id", F.lit(0).alias("distance"), F.lit(0).alias("hops"), none.alias("predecessor")).distinct(), "paths")
    front = best
    label = F.struct("distance", "hops", "predecessor")  # a null predecessor is the least
    for _ in range(max_distance):
        near = front.join(priced, front["id"] == priced["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("cost")).alias("distance"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("predecessor")).filter(F.col("distance") <= max_distance)
        both = best.withColumn("old", F.lit(True)).unionByName(near.withColumn("old", F.lit(False)))
        least = both.groupBy("id").agg(F.min(label).alias("x"), F.min(F.when(F.col("old"), label)).alias("was"))
        now = materialize(least.select("id", "x.*", (F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("x"))).alias("new")), "paths")
        front, best = now.filter("new").drop("new"), now.drop("new")
        if front.isEmpty():
            break
    return best


def pagerank(ids: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): rank = (1 - d)/n + d * sum of rank/out_degree, without what dangling nodes hold, until no rank moves
    by ``tolerance``, in at most ``rounds`` rounds; divided by the largest."""
    pairs = edges.select("src", "dst").distinct()
    ids = materialize(ids.select("id"), "ids")
    n = ids.count()
    pairs = materialize(pairs.join(pairs.groupBy("src").agg(F.count("*").alias("deg")), "src"), "weighted")
    rank = ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        gives = pairs.join(rank, pairs["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        both = rank.withColumnRenamed("rank", "was").join(gives, "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "was")
        both = materialize(both, "rank")
        most = both.agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank = both.drop("was")
        if most is None or most < tolerance:
            break
    most = rank.agg(F.max("rank").alias("most"))
    return rank.crossJoin(F.broadcast(most)).select("id", (F.col("rank") / F.col("most")).alias("rank"))  # one row


def personalized_pagerank(ids: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank): restart at the seeds, where what dangling nodes hold goes as well; until no rank moves by
    ``tolerance``, in at most ``rounds`` rounds."""
    pairs = edges.select("src", "dst").distinct()
    pairs = materialize(pairs.join(pairs.groupBy("src").agg(F.count("*").alias("deg")), "src"), "weighted")
    start = ids.select("id").join(seeds.select("id", F.lit(1.0).alias("s")), "id", "left").na.fill(0.0, ["s"])
    total = start.agg(F.sum("s")).first()[0] or 1.0
    start = materialize(start.withColumn("s", F.col("s") / total), "restart")
    rank = start.select("id", F.col("s").alias("rank"))
    out = pairs.select(F.col("src").alias("id")).distinct()
    for _ in range(rounds):
        dangling = rank.join(out, "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        gives = pairs.join(rank, pairs["src"] == rank["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        now = start.join(gives, "id", "left").crossJoin(F.broadcast(dangling)).select("id", (F.col("s") * (1 - damping) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("s"))).alias("rank"))
        now = materialize(now, "ppr")
        most = now.join(rank.select("id", F.col("rank").alias("was")), "id").agg(F.max(F.abs(F.col("rank") - F.col("was")))).first()[0]
        rank = now
        if most is None or most < tolerance:
            break
    return rank


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes in a cycle's component (2 nodes or more, named by the least), by forward and backward
    colouring until no edges are left: the first node, in an order drawn anew each round, that reaches a node colours
    it, and what reaches its colour's own node within the colour is one. Edges between colours are in no cycle."""
    left = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "scc")
    done, turn = None, 0
    while True:
        # nodes without an edge in or out are in no cycle
        while True:
            kept = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            kept = materialize(kept, "scc")
            same = kept.count() == left.count()
            left = kept
            if same:
                break
        if left.isEmpty():
            break
        colour = least_label(left, F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id"))
        inside = left.join(colour.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b").select("src", "dst")
        inside = materialize(inside, "scc")
        back = bfs(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.filter("id = label.id"))
        found = materialize(back.select("id").join(colour, "id").select("id", "label"), "scc")
        found = found.join(found.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("component")).filter("n > 1").select("label", "component"), "label").select("id", "component")
        done = found if done is None else done.unionByName(found)
        gone = back.select("id")
        left = materialize(inside.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc")
        turn += 1
        if turn % 8 == 0:
            done = materialize(done, "scc")
    return done if done is not None else edges.sparkSession.createDataFrame([], "id long, component long")


def least_label(pairs: DataFrame, order: Column | None = None, both_ways: bool = False) -> DataFrame:
    """(id, label): the least id, or least ``order``, that reaches each node (over either direction, if asked)."""
    if both_ways:
        pairs = pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    label = materialize(pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct().withColumn("label", F.col("id") if order is None else order), "labels")
    while True:
        got = pairs.join(label, pairs["src"] == label["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("got"))
        new = materialize(label.join(got, "id", "left").select("id", F.least("label", F.coalesce("got", "label")).alias("label"), (F.col("got") < F.col("label")).alias("moved")), "labels")
        moved = new.filter("moved").isEmpty()
        label = new.drop("moved")
        if moved:
            return label


def label_rounds(pairs: DataFrame, rounds: int = 15) -> DataFrame:
    """(id, label): synchronous label propagation, each node taking its neighbours' most frequent label (the least, of
    ties), until none changes, in at most ``rounds`` rounds. A deterministic stand-in for the asynchronous rule, whose fixpoint may differ."""
    both = materialize(pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "both")
    label = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(label, both["src"] == label["id"]).groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
        now = materialize(votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("x")).select("id", (-F.col("x.neg")).alias("label")), "communities")
        same = now.join(label.select("id", F.col("label").alias("was")), "id").filter("label <> was").isEmpty()
        label = now
        if same:
            break
    return label


def top(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")

"""What a change did to the nodes of a graph, what nothing needs, and what goes with it. Tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.operators import graph as G
from codeatlas.operators.coordination import ways_to
from codeatlas.session import materialize


def dead_verdicts(nodes: DataFrame, edges: DataFrame, roots: DataFrame, imported: DataFrame | None, ambiguous: DataFrame) -> DataFrame:
    """(id, confidence, reason) of nodes that no root reaches. low: a dynamic language, a module that is imported, or a
    synthesized edge into it; medium: imports aren't known, something calls it, or a call that stayed ambiguous has its
    name; else high. nodes: id, name, file, dynamic; roots: id; imported: file, or None if not known; ambiguous: name."""
    live = G.bfs(edges, roots).select("id")
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.max(F.col("conf") == "synthesized").alias("made"))
    x = nodes.select("id", "name", "file", "dynamic").join(live, "id", "left_anti").join(into, "id", "left")
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    x = x.join(flag(ambiguous, "name", "unsure"), "name", "left")
    x = x.withColumn("used", F.lit(None).cast("boolean")) if imported is None else x.join(flag(imported, "file", "used"), "file", "left")
    reason = F.when(F.col("dynamic"), "dynamic language").when(F.col("used"), "module imported").when(F.col("made"), "synthesized edge")
    reason = reason.when(F.lit(imported is None), "imports not known").when(F.col("callers") > 0, "called by dead code").when(F.col("unsure"), "named in an ambiguous call").otherwise("no caller")
    low = F.col("reason").isin("dynamic language", "module imported", "synthesized edge")
    return x.withColumn("reason", reason).select("id", F.when(low, "low").when(F.col("reason") == "no caller", "high").otherwise("medium").alias("confidence"), "reason")


def delete_impact(edges: DataFrame, roots: DataFrame, gone: DataFrame) -> DataFrame:
    """(id): nodes that roots reach, but wouldn't without those of ``gone`` (id), which aren't told themselves."""
    pairs = materialize(edges.select("src", "dst").distinct(), "pairs")
    drop = lambda df, c: df.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti")
    left = drop(drop(pairs, "src"), "dst").select("src", "dst")
    live = G.bfs(pairs, roots).select("id")
    return drop(live, "id").join(G.bfs(left, drop(roots, "id")).select("id"), "id", "left_anti")


def node_changes(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    """(change, id, other, basis) between two sets of nodes (id, signature, body, shape), told apart by id: ``renamed`` (other:
    the new id) where just one node that went and one that came have the same body, or else the same shape (the body
    without the name); ``ambiguous`` where several have; ``removed``; ``added``; ``signature`` where it is another one;
    ``stale-caller`` (other: the callee): an unchanged node that in the new edges (src, dst) still calls one that was
    removed, was renamed, or has another signature. A null body or shape is like no other."""
    a, b = old.select("id", "signature", "body", "shape"), new.select("id", "signature", "body", "shape")
    gone, came = materialize(a.join(b.select("id"), "id", "left_anti"), "gone"), materialize(b.join(a.select("id"), "id", "left_anti"), "came")

    def alike(basis, x, y):
        """(basis, key): how many of either side have each value, where both do."""
        count = lambda df, n, i: df.filter(F.col(basis).isNotNull()).groupBy(basis).agg(F.count("*").alias(n), F.min("id").alias(i))
        return count(x, "n", "id").join(count(y, "m", "other"), basis)

    one = "n = 1 and m = 1"
    exact = materialize(alike("body", gone, came), "alike")
    sure = exact.filter(one).select("id", "other", F.lit("body").alias("basis"))
    rest_gone, rest_came = gone.join(sure.select("id"), "id", "left_anti"), came.join(sure.select(F.col("other").alias("id")), "id", "left_anti")
    close = materialize(alike("shape", rest_gone, rest_came), "alike")
    renamed = materialize(sure.unionByName(close.filter(one).select("id", "other", F.lit("shape").alias("basis"))), "renamed")
    unsure = rest_gone.join(close.filter(f"not ({one})").select("shape"), "shape", "left_semi").select("id")
    lost = gone.select("id").join(renamed.select("id"), "id", "left_anti")
    both = a.join(b.select("id", F.col("signature").alias("now"), F.col("body").alias("then")), "id")
    other_sign = both.filter(~F.col("signature").eqNullSafe(F.col("now"))).select("id")
    same = both.filter(F.col("signature").eqNullSafe(F.col("now")) & F.col("body").eqNullSafe(F.col("then"))).select("id")
    kind = old.schema["id"].dataType
    row = lambda df, change: df.select(F.lit(change).alias("change"), "id", F.lit(None).cast(kind).alias("other"), F.lit(None).cast("string").alias("basis"))
    out = renamed.select(F.lit("renamed").alias("change"), "id", "other", "basis").unionByName(row(lost.join(unsure, "id", "left_anti"), "removed")).unionByName(row(lost.join(unsure, "id", "left_semi"), "ambiguous"))
    out = out.unionByName(row(came.join(renamed.select(F.col("other").alias("id")), "id", "left_anti"), "added")).unionByName(row(other_sign, "signature"))
    broken = gone.select("id").unionByName(other_sign).withColumnRenamed("id", "dst")
    stale = edges.select("src", "dst").distinct().join(broken, "dst", "left_semi").join(same.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.unionByName(stale.select(F.lit("stale-caller").alias("change"), F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(None).cast("string").alias("basis")))


def select_tests(nodes: DataFrame, edges: DataFrame, changed: DataFrame, tested_by: DataFrame, depth: int = 12) -> DataFrame:
    """(test, confidence, source, path): the tests to run for changed nodes (id), each by its surest way, then the shortest,
    then the least. call: the test reaches a changed node in 1 call (high), up to 3 (medium) or up to ``depth`` (low);
    tested_by: it is known to test one (high) or a node that reaches one (medium); same_file: it tests another node of
    the file of a changed node to which no test was found (low; the path is the test alone). nodes: id, file, is_test;
    edges: src, dst; tested_by: id, test."""
    seeds = materialize(nodes.join(changed.select("id").distinct(), "id").filter("not coalesce(is_test, false)").select("id", "file"), "changed")
    ways = ways_to(seeds.select("id"), edges, depth)
    known = tested_by.select("id", "test").filter("id is not null and test is not null").distinct()
    steps = F.size("path") - 1
    rows = lambda df, rank, source, path: df.select("test", rank.alias("rank"), F.lit(source).alias("source"), path.alias("path"))
    called = ways.filter(steps > 0).join(nodes.filter("is_test").select("id"), "id").withColumnRenamed("id", "test")
    out = rows(called, F.when(steps == 1, 0).when(steps <= 3, 1).otherwise(2), "call", F.col("path"))
    out = out.unionByName(rows(ways.join(known, "id"), F.when(steps == 0, 0).otherwise(1), "tested_by", F.concat(F.array("test"), "path")))
    best = lambda df: df.groupBy("test").agg(F.min(F.struct("rank", F.size("path").alias("n"), "path", "source")).alias("x")).select("test", "x.rank", "x.source", "x.path")
    found = materialize(best(out), "selected")
    bare = seeds.join(found.select(F.element_at("path", -1).alias("id")).distinct(), "id", "left_anti").select("file").filter("file is not null").distinct()
    beside = nodes.select("id", "file").join(bare, "file").join(known, "id").select("test").distinct()
    all_ = best(found.unionByName(rows(beside, F.lit(2), "same_file", F.array("test"))))
    level = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("rank"))
    return all_.select("test", level.alias("confidence"), "source", "path")


def landmark_evidence(fans: DataFrame, churn: DataFrame) -> DataFrame:
    """(id, label, evidence) for each landmark label of each node, with what it rests on. fans: id, file, fan_in, fan_out;
    churn: file, churn (a file that changed 12 times or more is volatile)."""
    x = fans.join(churn.select("file", "churn"), "file", "left")
    n = lambda c: F.col(c).cast("string")
    into, out = F.concat(F.lit("fan-in "), n("fan_in")), F.concat(F.lit("fan-out "), n("fan_out"))
    kinds = [("hub", F.col("fan_in") >= G.HUB_FAN_IN, into), ("orchestrator", F.col("fan_out") >= 5, out), ("chokepoint", (F.col("fan_in") >= 3) & (F.col("fan_out") >= 3), F.concat(into, F.lit(", "), out)),
             ("entrypoint", (F.col("fan_in") == 0) & (F.col("fan_out") > 0), out), ("volatile", F.col("churn") >= 12, F.concat(F.lit("churn "), n("churn"))), ("dead", (F.col("fan_in") == 0) & (F.col("fan_out") == 0), F.lit("no edges"))]
    each = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("label"), why.alias("evidence"))) for name, test, why in kinds]))
    return x.select("id", F.explode(each).alias("x")).select("id", "x.label", "x.evidence")

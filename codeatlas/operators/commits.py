"""A history of commits with merges: ancestry by an index of chains, and what was true as of a commit. Tables in, tables
out.

First parents form trees, cut into chains: a commit goes on the chain of its first parent if it is the last of that
parent's children. All before a commit on its chain are its ancestors, so what a set of commits reaches is one position
for each chain, and rounds follow merges and branches, not commits: a long history without them takes one round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.modules import follow
from codeatlas.session import materialize


def chain_index(commits: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, chain, pos) of all commits, and (chain, pos, to_chain, to_pos) of the parents that aren't the one
    before on the chain. commits: id; parents: id, parent, nth (0: first). Parents that aren't commits count for none."""
    ids = materialize(commits.select("id").distinct(), "commits")
    known = parents.join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi").join(ids, "id", "left_semi").filter("id <> parent")
    known = materialize(known.groupBy("id", "parent").agg(F.min("nth").alias("nth")), "parents")
    first = known.groupBy("id").agg(F.min_by("parent", F.struct("nth", "parent")).alias("parent"))
    chosen = first.groupBy("parent").agg(F.max("id").alias("id"))
    place = follow(ids.join(chosen, "id", "left").select(F.col("id").alias("node"), F.col("parent").alias("next")))
    index = materialize(place.filter("not cyclic").select(F.col("node").alias("id"), F.col("end").alias("chain"), F.col("hops").alias("pos")), "chains")
    to = index.select(F.col("id").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    links = known.join(index, "id").join(to, "parent").filter("chain <> to_chain or pos <> to_pos + 1")
    return index, materialize(links.select("chain", "pos", "to_chain", "to_pos").distinct(), "links")


def _spread(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, chain, upto): the furthest position that each root reaches on each chain, roots being such rows."""
    key = ["root", "chain"]
    best = front = materialize(roots.groupBy(*key).agg(F.max("upto").alias("upto")).withColumn("since", F.lit(None).cast("long")), "reach")
    while not front.isEmpty():
        # only links beyond what was reached before are new
        x = front.join(links, "chain").filter((F.col("pos") <= F.col("upto")) & (F.col("since").isNull() | (F.col("pos") > F.col("since"))))
        got = x.groupBy("root", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("got"))
        both = best.select(*key, "upto").join(got, key, "full_outer")
        now = materialize(both.select(*key, F.greatest("upto", "got").alias("upto"), F.col("upto").alias("since"), F.coalesce(F.col("got") > F.col("upto"), F.col("upto").isNull()).alias("new")), "reach")
        best, front = now.drop("new"), now.filter("new").drop("new")
    return best.select("root", "chain", "upto")


def ancestors(index: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, chain, upto): commits of each chain up to a position are the root (ids) or its ancestors."""
    start = index.join(roots.select("id").distinct(), "id").select(F.col("id").alias("root"), "chain", F.col("pos").alias("upto"))
    return _spread(links, start)


def descendants_of(index: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, chain, since): commits of each chain from a position on are the root or its descendants."""
    back = links.select(F.col("to_chain").alias("chain"), (-F.col("to_pos")).alias("pos"), F.col("chain").alias("to_chain"), (-F.col("pos")).alias("to_pos"))
    start = index.join(roots.select("id").distinct(), "id").select(F.col("id").alias("root"), "chain", (-F.col("pos")).alias("upto"))
    return _spread(back, start).select("root", "chain", (-F.col("upto")).alias("since"))


def _located(facts: DataFrame, index: DataFrame, column: str, reach: DataFrame, within: Column, mark: str) -> DataFrame:
    """facts with ``mark``: whether the commit in a column is within the reach."""
    at = index.select(F.col("id").alias(column), F.col("chain").alias("_chain"), F.col("pos").alias("_pos"))
    x = facts.join(at, column, "left").join(reach.withColumnRenamed("chain", "_chain"), "_chain", "left")
    return x.withColumn(mark, F.coalesce(within, F.lit(False))).select(*facts.columns, mark)


def as_of(facts: DataFrame, index: DataFrame, links: DataFrame, commit: DataFrame) -> DataFrame:
    """The facts (recorded, invalidated: commits) that held at one commit (a row with its id): recorded there or in an
    ancestor, and not invalidated there or in one. Facts of unknown commits didn't hold."""
    reach = ancestors(index, links, commit).drop("root")
    seen = _located(facts, index, "recorded", reach, F.col("_pos") <= F.col("upto"), "_in")
    gone = _located(seen.filter("_in"), index, "invalidated", reach, F.col("_pos") <= F.col("upto"), "_out")
    return gone.filter("not _out").select(*facts.columns)


def changed_since(facts: DataFrame, index: DataFrame, links: DataFrame, commit: DataFrame) -> DataFrame:
    """The facts recorded or invalidated in a commit that comes after one commit by ancestry, with ``change``: added,
    invalidated or both."""
    reach = descendants_of(index, links, commit).drop("root")
    later = F.col("_pos") >= F.col("since")
    root = index.join(commit.select("id"), "id", "left_semi").select(F.col("id").alias("_root"))
    x = _located(_located(facts, index, "recorded", reach, later, "_new"), index, "invalidated", reach, later, "_gone").crossJoin(F.broadcast(root))  # one row
    new, gone = F.col("_new") & ~F.col("recorded").eqNullSafe(F.col("_root")), F.col("_gone") & ~F.col("invalidated").eqNullSafe(F.col("_root"))
    change = F.when(new & gone, "both").when(new, "added").when(gone, "invalidated")
    return x.withColumn("change", change).filter("change is not null").select(*facts.columns, "change")

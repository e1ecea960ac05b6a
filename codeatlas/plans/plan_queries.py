"""Queries over histories with merges and over plans of tasks. Orders stand for commits and their first lines for
what was recorded: of each hundred the last ten are a branch, which every other time is merged. Suppliers stand for tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import commits as H
from codeatlas.operators import waves as V
from codeatlas.plans.graph_queries import maker
from codeatlas.session import materialize
from codeatlas.sources.tables import table

QUERIES, ORACLE_SQL, query = maker()

_HISTORY = """par AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 = 0 THEN o_orderkey - 11 ELSE o_orderkey - 1 END AS parent FROM orders UNION SELECT o_orderkey, o_orderkey - 21 FROM orders WHERE o_orderkey % 200 = 20),
  edge AS MATERIALIZED (SELECT par.id, parent FROM par JOIN orders ON parent = o_orderkey),
  fact AS (SELECT l_orderkey AS memory, l_orderkey AS recorded, CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey + l_suppkey % 50 END AS invalidated FROM lineitem WHERE l_linenumber = 1)"""


def _history(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    k = F.col("id")
    first = o.select("id", F.when(k % 100 == 0, k - 11).otherwise(k - 1).alias("parent"), F.lit(0).alias("nth"))
    second = o.filter(k % 200 == 20).select("id", (k - 21).alias("parent"), F.lit(1).alias("nth"))
    line = table(s, d, "lineitem").filter("l_linenumber = 1")
    facts = line.select(F.col("l_orderkey").alias("memory"), F.col("l_orderkey").alias("recorded"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_orderkey") + F.col("l_suppkey") % 50).alias("invalidated"))
    return o, H.chain_index(o, first.unionByName(second)), facts


_HEAD = "head AS (SELECT max(o_orderkey) AS id FROM orders WHERE o_orderkey % 100 < 90)"


@query(f"WITH RECURSIVE {_HISTORY}, {_HEAD}, anc(id) AS (SELECT id FROM head UNION SELECT parent FROM anc JOIN edge ON edge.id = anc.id) SELECT memory, recorded, invalidated FROM fact LEFT JOIN anc x ON recorded = x.id LEFT JOIN anc y ON invalidated = y.id WHERE x.id IS NOT NULL AND y.id IS NULL")
def memories_as_of(s, d):
    """What held at the last commit of the main line, by ancestry through merges."""
    o, (index, links), facts = _history(s, d)
    return H.as_of(facts, index, links, o.filter("id % 100 < 90").agg(F.max("id").alias("id")))


_MIDDLE = "mid AS (SELECT min(o_orderkey) AS id FROM orders WHERE o_orderkey * 2 >= (SELECT max(o_orderkey) FROM orders))"


@query(f"""WITH RECURSIVE {_HISTORY}, {_MIDDLE}, later(id) AS (SELECT edge.id FROM mid JOIN edge ON parent = mid.id UNION SELECT edge.id FROM later JOIN edge ON parent = later.id)
  SELECT memory, recorded, invalidated, CASE WHEN a AND b THEN 'both' WHEN a THEN 'added' ELSE 'invalidated' END AS change FROM (SELECT *, recorded IN (SELECT id FROM later) AS a, coalesce(invalidated IN (SELECT id FROM later), false) AS b FROM fact) WHERE a OR b""")
def memories_changed_since(s, d):
    """What was recorded or invalidated after the commit in the middle, by ancestry."""
    o, (index, links), facts = _history(s, d)
    most = o.agg(F.max("id").alias("most"))
    middle = o.crossJoin(F.broadcast(most)).filter("id * 2 >= most").agg(F.min("id").alias("id"))  # one row
    return H.changed_since(facts, index, links, middle)


def _tasks(s, d):
    k = F.col("s_suppkey")
    t = table(s, d, "supplier").select(k.alias("task"), (F.floor(F.abs("s_acctbal")) % 90 + 1).cast("long").alias("cost"), "s_nationkey")
    floor = lambda by: F.floor(F.col("task") / by).cast("long").alias("needs")
    needs = t.filter("task >= 2").select("task", floor(2)).unionByName(t.filter("task >= 3 and task % 4 = 0").select("task", floor(3)))
    holds = t.select("task", F.explode(F.array(F.col("s_nationkey").cast("long"), F.col("task") % 40 + 100)).alias("resource"))
    return t, needs, holds


@query()
def task_waves(s, d):
    """The wave in which each task can run: after its needs, apart from what it shares a file with."""
    t, needs, holds = _tasks(s, d)
    return V.waves(t, needs, holds)


_NEEDS = "t AS (SELECT s_suppkey AS task, floor(abs(s_acctbal))::BIGINT % 90 + 1 AS cost FROM supplier), need AS (SELECT task, task // 2 AS needs FROM t WHERE task >= 2 UNION SELECT task, task // 3 FROM t WHERE task >= 3 AND task % 4 = 0), link AS (SELECT n.* FROM need n JOIN t ON t.task = n.needs)"


@query(f"""WITH RECURSIVE {_NEEDS}, walk(task, total, steps, after) AS (SELECT task, cost, 1, NULL::BIGINT FROM t WHERE task NOT IN (SELECT task FROM link) UNION SELECT l.task, total + t.cost, steps + 1, w.task FROM walk w JOIN link l ON l.needs = w.task JOIN t ON t.task = l.task)
  SELECT task, total, steps, after FROM walk QUALIFY row_number() OVER (PARTITION BY task ORDER BY total DESC, steps DESC, after) = 1""")
def critical_path(s, d):
    """The costliest chain of needs up to each task."""
    t, needs, _ = _tasks(s, d)
    return V.longest_chains(t, needs).filter("total is not null")

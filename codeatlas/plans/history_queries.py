"""Queries over history and events: co-change, churn, provenance, telemetry, episodes, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def co_change(pairs, support: int, confidence: float, most: int = 25, first: int = 5):
    """(a, b, support, confidence) of items that change together; pairs: distinct (commit, item). Commits of more than
    ``most`` items are left out, so a commit makes at most most**2 pairs."""
    size = Window.partitionBy("commit")
    kept = pairs.withColumn("n", F.count("*").over(size)).filter(F.col("n") <= most).select("commit", "item")
    churn = kept.groupBy("item").agg(F.count("*").alias("churn"))
    both = kept.withColumnRenamed("item", "a").join(kept.withColumnRenamed("item", "b"), "commit").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("support"))
    x = both.filter(F.col("support") >= support).join(churn, F.col("a") == F.col("item")).withColumn("conf", F.col("support") / F.col("churn")).filter(F.col("conf") >= confidence)
    order = Window.partitionBy("a").orderBy(F.desc("conf"), F.desc("support"), "b")
    return x.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= first).select("a", "b", "support", F.round("conf", 2).alias("confidence"))


def _co_sql(pairs, support, confidence):
    return f"""WITH p AS ({pairs}), k AS (SELECT commit, item FROM (SELECT *, count(*) OVER (PARTITION BY commit) AS n FROM p) WHERE n <= 25), c AS (SELECT item, count(*) AS churn FROM k GROUP BY item),
  b AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM k x JOIN k y ON x.commit = y.commit AND x.item <> y.item GROUP BY 1, 2),
  f AS (SELECT a, b, support, support / churn::DOUBLE AS conf FROM b JOIN c ON a = item WHERE support >= {support} AND support / churn::DOUBLE >= {confidence})
  SELECT a, b, support, round(conf, 2) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY conf DESC, support DESC, b) AS r FROM f) WHERE r <= 5"""


@query(_co_sql("SELECT DISTINCT user_id || '|' || strftime(ts, '%Y-%m-%d') AS commit, event_type AS item FROM events", 3, 0.3))
def change_coupling(s, d):
    e = table(s, d, "events")
    return co_change(e.select(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("commit"), F.col("event_type").alias("item")).distinct(), 3, 0.3)


@query(_co_sql("SELECT DISTINCT l_orderkey AS commit, l_partkey AS item FROM lineitem", 2, 0.05))
def change_coupling_orders(s, d):
    return co_change(table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("item")).distinct(), 2, 0.05)


@query("SELECT item, churn, CASE WHEN churn >= 12 THEN 'high' WHEN churn >= 5 THEN 'medium' ELSE 'low' END AS volatility FROM (SELECT l_partkey AS item, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1)")
def churn(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.countDistinct("l_orderkey").alias("churn"))
    return x.withColumn("volatility", F.when(F.col("churn") >= 12, "high").when(F.col("churn") >= 5, "medium").otherwise("low"))


@query("SELECT l_partkey AS item, max(o_orderdate) AS last_date, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS last_author, count(DISTINCT o_custkey) AS authors FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def provenance(s, d):
    x = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy(F.col("l_partkey").alias("item")).agg(F.max("o_orderdate").alias("last_date"), F.max_by("o_custkey", F.struct("o_orderdate", "o_orderkey")).alias("last_author"), F.countDistinct("o_custkey").alias("authors"))


@query("SELECT conv_id, count(*) AS valid FROM (SELECT conv_id, turn AS valid_from, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS valid_to FROM conversations) WHERE valid_from <= 3 AND (valid_to IS NULL OR valid_to > 3) GROUP BY conv_id")
def bitemporal_as_of(s, d):
    x = table(s, d, "conversations").select("conv_id", F.col("turn").alias("valid_from"), F.lead("turn").over(Window.partitionBy("conv_id", "role").orderBy("turn")).alias("valid_to"))
    return x.filter("valid_from <= 3 and (valid_to is null or valid_to > 3)").groupBy("conv_id").agg(F.count("*").alias("valid"))


@query("SELECT event_type AS tool, count(*) AS calls, floor(avg(value) + 0.5)::BIGINT AS avg_ms, max(value) AS max_ms FROM events GROUP BY event_type")
def tool_stats(s, d):
    return tool_rollup(table(s, d, "events"))


def tool_rollup(events):
    return events.groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"), F.floor(F.avg("value") + 0.5).cast("long").alias("avg_ms"), F.max("value").alias("max_ms"))


@query("SELECT user_id, floor(100.0 * count(*) FILTER (event_type = 'view') / count(*) + 0.5)::BIGINT AS hit_rate FROM events GROUP BY user_id")
def cache_stats(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.floor(100.0 * F.count(F.when(F.col("event_type") == "view", 1)) / F.count("*") + 0.5).cast("long").alias("hit_rate"))


ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def _user_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")



@query(f"WITH x AS (SELECT *, sum((event_type = 'signup')::INT) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS episode FROM events) SELECT user_id, episode::BIGINT AS episode, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM x GROUP BY user_id, episode")
def episodes(s, d):
    """Gaps and islands: a signup begins an episode; the last one is open."""
    x = table(s, d, "events").withColumn("episode", F.sum((F.col("event_type") == "signup").cast("int")).over(_user_order().rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("user_id", F.col("episode").cast("long").alias("episode")).agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("SELECT a.event_id, min(b.ts) AS recovered FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts > a.ts WHERE a.event_type = 'error' GROUP BY a.event_id")
def recovery_latency(s, d):
    """As-of join, forward and strict: the first view of the same user after each error. A window per user over equal
    times together, not a join of all pairs; from the latest back, so that the frame only grows."""
    back = Window.partitionBy("user_id").orderBy(F.desc(F.unix_micros(F.col("ts").cast("timestamp")))).rangeBetween(Window.unboundedPreceding, -1)
    later = F.min(F.when(F.col("event_type") == "view", F.col("ts"))).over(back)
    return table(s, d, "events").withColumn("recovered", later).filter("event_type = 'error'").select("event_id", "recovered")


@query(f"WITH x AS (SELECT *, (event_type <> lag(event_type) OVER ({ORDER}))::INT AS switched FROM events) SELECT event_id, round(coalesce(sum(switched) OVER ({ORDER} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0) / 15, 6) AS density FROM x")
def module_density(s, d):
    x = table(s, d, "events").withColumn("switched", (F.col("event_type") != F.lag("event_type").over(_user_order())).cast("int"))
    return x.select("event_id", F.round(F.coalesce(F.sum("switched").over(_user_order().rowsBetween(-14, 0)), F.lit(0)) / 15, 6).alias("density"))


@query(f"""WITH w AS (SELECT event_id, list(CASE WHEN value > 3 THEN event_type END) OVER ({ORDER} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS raw FROM events), m AS (SELECT event_id, list_filter(raw, lambda x: x IS NOT NULL) AS m FROM w),
  t AS (SELECT event_id, [m[i] for i in range(1, len(m) + 1) if i = 1 OR m[i] <> m[i - 1]] AS t FROM m)
  SELECT event_id, CASE WHEN len(t) < 3 THEN 0 ELSE round(len([i for i in range(3, len(t) + 1) if t[i] = t[i - 2]]) / (len(t) - 2)::DOUBLE, 6) END::DOUBLE AS oscillation FROM t""")
def oscillation(s, d):
    """Of the changes of module within a user's last 15 calls, the share that go back to the module before the last.
    Calls of a small value touch no module and are left out."""
    module = F.when(F.col("value") > 3, F.col("event_type"))
    x = table(s, d, "events").select("event_id", F.collect_list(module).over(_user_order().rowsBetween(-14, 0)).alias("m"))
    x = x.select("event_id", F.filter("m", lambda v, i: (i == 0) | (v != F.get(F.col("m"), i - 1))).alias("t"))
    again = F.size(F.filter("t", lambda v, i: (i >= 2) & (v == F.get(F.col("t"), i - 2))))
    return x.select("event_id", F.when(F.size("t") < 3, 0.0).otherwise(F.round(again / (F.size("t") - 2), 6)).alias("oscillation"))


_LABEL = "array_to_string(list_filter([CASE WHEN n >= 100 THEN 'busy' END, CASE WHEN depth >= 150 THEN 'deep' END, CASE WHEN density >= 20 THEN 'dense' END], lambda x: x IS NOT NULL), ',')"


@query(f"WITH h AS (SELECT user_id, count(*) AS n, max(value) AS depth, round(avg(CASE WHEN value > 1 THEN value END), 3) AS density, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools FROM events GROUP BY user_id) SELECT user_id, n AS events, depth, density, tools, {_LABEL} AS labels FROM h")
def hotspots(s, d):
    """Per module: events, greatest depth, mean density without nulls, its tools in order, and labels."""
    x = table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.max("value").alias("depth"), F.round(F.avg(F.when(F.col("value") > 1, F.col("value"))), 3).alias("density"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("tools"))
    return x.withColumn("labels", F.concat_ws(",", F.when(F.col("events") >= 100, "busy"), F.when(F.col("depth") >= 150, "deep"), F.when(F.col("density") >= 20, "dense")))


@query("SELECT user_id % 7 AS k, coalesce(CASE user_id % 7 WHEN 3 THEN NULL ELSE 'agent' || (user_id % 7) END, 'unknown') AS agent, count(*) AS orients, round(avg(value), 3) AS mean_functions, count(*) FILTER (value < 5) AS empty FROM events WHERE event_type = 'view' GROUP BY 1, 2".replace("user_id % 7 AS k, ", "").replace("GROUP BY 1, 2", "GROUP BY 1"))
def orient_quality(s, d):
    agent = F.coalesce(F.when(F.col("user_id") % 7 != 3, F.concat(F.lit("agent"), (F.col("user_id") % 7).cast("string"))), F.lit("unknown"))
    return table(s, d, "events").filter("event_type = 'view'").groupBy(agent.alias("agent")).agg(F.count("*").alias("orients"), F.round(F.avg("value"), 3).alias("mean_functions"), F.count(F.when(F.col("value") < 5, 1)).alias("empty"))


@query(f"WITH x AS (SELECT *, (event_type <> lag(event_type) OVER ({ORDER}))::INT AS switched FROM events), y AS (SELECT user_id, coalesce(sum(switched) OVER ({ORDER} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0) / 15 AS density FROM x) SELECT user_id, round(avg(density), 6) AS mean_density, round(max(density), 6) AS most, count(*) FILTER (density >= 0.6) AS bursts FROM y GROUP BY user_id")
def trajectory_entropy(s, d):
    x = table(s, d, "events").withColumn("switched", (F.col("event_type") != F.lag("event_type").over(_user_order())).cast("int"))
    x = x.select("user_id", (F.coalesce(F.sum("switched").over(_user_order().rowsBetween(-14, 0)), F.lit(0)) / 15).alias("density"))
    return x.groupBy("user_id").agg(F.round(F.avg("density"), 6).alias("mean_density"), F.round(F.max("density"), 6).alias("most"), F.count(F.when(F.col("density") >= 0.6, 1)).alias("bursts"))


@query("WITH t AS (SELECT event_id, list_concat([event_type], CASE WHEN value > 30 THEN ['burst', event_type] ELSE [] END) AS names, value FROM events), u AS (SELECT unnest(names) AS name, value FROM t) SELECT name, count(*) AS n FROM u WHERE value > 10 GROUP BY name")
def trigger_frequency(s, d):
    """Triggers of both lists of an event, with a positive delta."""
    more = F.when(F.col("value") > 30, F.array(F.lit("burst"), F.col("event_type"))).otherwise(F.array().cast("array<string>"))
    x = table(s, d, "events").select(F.explode(F.concat(F.array("event_type"), more)).alias("name"), "value")
    return x.filter("value > 10").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT (props::JSON ->> '$.k')::INT // 10 AS bin, count(*) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def benchmark_cells(s, d):
    """Medians and extremes by a number inside the events' JSON."""
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")
    return table(s, d, "events").groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) SELECT o_orderkey, was, o_orderstatus AS now FROM x WHERE was IS DISTINCT FROM o_orderstatus")
def ledger_transitions(s, d):
    """Changes of a ledger's state, the first of each included."""
    was = F.lag("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    x = table(s, d, "orders").select("o_orderkey", was.alias("was"), F.col("o_orderstatus").alias("now"))
    return x.filter(~F.col("was").eqNullSafe(F.col("now")))


@query("""WITH x AS (SELECT l_partkey AS item, o_custkey AS author, max(o_orderdate) AS newest FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY newest DESC, author) AS n FROM x)
  SELECT item, string_agg(author::VARCHAR, ',' ORDER BY n) AS authors FROM r WHERE n <= 5 GROUP BY item""")
def newest_authors(s, d):
    """The five authors of each item whose last change is newest; orders in progress stand for merges, which name none."""
    x = table(s, d, "lineitem").join(table(s, d, "orders").filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy(F.col("l_partkey").alias("item"), F.col("o_custkey").alias("author")).agg(F.max("o_orderdate").alias("newest"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("newest"), "author"))).filter("n <= 5")
    names = F.transform(F.sort_array(F.collect_list(F.struct("n", "author"))), lambda a: a["author"].cast("string"))
    return x.groupBy("item").agg(F.array_join(names, ",").alias("authors"))


@query("SELECT event_type, least(count(*), 100) AS returned, greatest(count(*) - 100, 0) AS omitted FROM events GROUP BY event_type")
def truncation_receipt(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.least(F.count("*"), F.lit(100)).alias("returned"), F.greatest(F.count("*") - 100, F.lit(0)).alias("omitted"))


@query("SELECT l_shipdate, l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_shipdate, l_returnflag)".replace("l_shipdate", "l_linestatus"))
def lineitem_cube(s, d):
    return table(s, d, "lineitem").cube("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("started"), "event_type").agg(F.count("*").alias("n"))

"""Queries over the property graph: lookups, metrics, labels, rules, traversal, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import graph as G
from codeatlas.operators.modules import descendants
from codeatlas.sources.tables import edges, nodes, table

N = "node AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_type AS lang, p_size AS cost FROM part)"
E = """edge AS (SELECT a.l_partkey AS src, b.l_partkey AS dst,
  (['import','re_export','same_file','self_cls','http_endpoint','type_inference','type_name','name_only','synthesized','external'])[(a.l_orderkey % 10 + 1)::INT] AS conf
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_returnflag = 'R' AND a.l_linestatus = 'F' AND a.l_quantity > 25 AND a.l_partkey <> b.l_partkey)"""
C = "call AS (SELECT DISTINCT src, dst FROM edge WHERE conf <> 'synthesized')"
FAN = """fan AS (SELECT n.*, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM node n
  LEFT JOIN (SELECT dst, count(*) AS n FROM call GROUP BY dst) i ON n.id = i.dst
  LEFT JOIN (SELECT src, count(*) AS n FROM call GROUP BY src) o ON n.id = o.src)"""
WITH = f"WITH {N}, {E}, {C}, {FAN}"
REC = f"WITH RECURSIVE {N}, {E}, {C}, {FAN}"
LABEL = """concat_ws(',', CASE WHEN fan_in >= 5 THEN 'hub' END, CASE WHEN fan_out >= 5 THEN 'orchestrator' END, CASE WHEN fan_in >= 3 AND fan_out >= 3 THEN 'chokepoint' END,
  CASE WHEN fan_in = 0 AND fan_out > 0 THEN 'entrypoint' END, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'dead' END)"""
CENTS = "(['import','re_export','same_file','self_cls','http_endpoint'])"
COST = f"CASE WHEN list_contains({CENTS}, conf) THEN 1 WHEN conf IN ('type_inference','type_name') THEN 2 WHEN conf = 'name_only' THEN 3 WHEN conf = 'synthesized' THEN 4 END"



def maker():
    """Two dicts of queries and their SQL, and the decorator that fills them."""
    queries, sql_of = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sql_of[f.__name__] = sql
            return f

        return add

    return queries, sql_of, query


QUERIES, ORACLE_SQL, query = maker()


def fans(s, d):
    return G.fan(nodes(s, d), edges(s, d))


@query(f"{WITH} SELECT id, fan_in, fan_out FROM fan")
def fan_in_out(s, d):
    return fans(s, d).select("id", "fan_in", "fan_out")


@query(f"{WITH} SELECT id, name, fan_in, fan_out, {LABEL} AS labels FROM fan WHERE fan_in >= 5")
def hubs(s, d):
    return fans(s, d).filter(F.col("fan_in") >= G.HUB_FAN_IN).select("id", "name", "fan_in", "fan_out", G.labels().alias("labels"))


@query(f"{WITH} SELECT id, name FROM fan WHERE fan_in = 0 AND fan_out > 0")
def entry_points(s, d):
    return fans(s, d).filter("fan_in = 0 and fan_out > 0").select("id", "name")


@query(f"{WITH} SELECT id, name FROM fan WHERE fan_out = 0 AND fan_in > 0")
def leaf_nodes(s, d):
    return fans(s, d).filter("fan_out = 0 and fan_in > 0").select("id", "name")


@query(f"{WITH} SELECT count(*) AS n_nodes, sum(fan_in)::BIGINT AS n_calls, round(avg(fan_in), 6) AS mean_in, max(fan_in) AS max_in, max(fan_out) AS max_out FROM fan")
def graph_stats(s, d):
    return fans(s, d).agg(F.count("*").alias("n_nodes"), F.sum("fan_in").alias("n_calls"), F.round(F.avg("fan_in"), 6).alias("mean_in"), F.max("fan_in").alias("max_in"), F.max("fan_out").alias("max_out"))


@query(f"{WITH} SELECT c.dst AS id, n.name AS caller, n.file AS caller_file FROM call c JOIN node n ON c.src = n.id")
def callers(s, d):
    return G.distinct_calls(edges(s, d)).join(nodes(s, d), F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.col("name").alias("caller"), F.col("file").alias("caller_file"))


@query(f"{WITH} SELECT c.src AS id, n.name AS callee, n.file AS callee_file FROM call c JOIN node n ON c.dst = n.id")
def callees(s, d):
    return G.distinct_calls(edges(s, d)).join(nodes(s, d), F.col("dst") == F.col("id")).select(F.col("src").alias("id"), F.col("name").alias("callee"), F.col("file").alias("callee_file"))


@query(f"{WITH} SELECT src, dst FROM call WHERE dst IN (SELECT id FROM fan WHERE fan_in >= 5)")
def batch_callers(s, d):
    wanted = fans(s, d).filter(F.col("fan_in") >= G.HUB_FAN_IN).select(F.col("id").alias("dst"))
    return G.distinct_calls(edges(s, d)).join(wanted, "dst", "left_semi").select("src", "dst")


@query(f"""{WITH} SELECT file, direction, count(*) AS n FROM (
  SELECT n.file, 'outgoing' AS direction FROM edge e JOIN node n ON e.src = n.id UNION ALL SELECT n.file, 'incoming' FROM edge e JOIN node n ON e.dst = n.id) GROUP BY file, direction""")
def edges_for_file(s, d):
    file = nodes(s, d).select("id", "file")
    ways = [edges(s, d).join(file, F.col(c) == F.col("id")).select("file", F.lit(w).alias("direction")) for c, w in (("src", "outgoing"), ("dst", "incoming"))]
    return ways[0].unionByName(ways[1]).groupBy("file", "direction").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT DISTINCT b.file AS file, a.file AS caller_file FROM call c JOIN node a ON c.src = a.id JOIN node b ON c.dst = b.id WHERE a.file <> b.file")
def caller_files(s, d):
    n = nodes(s, d)
    a, b = n.select(F.col("id").alias("src"), F.col("file").alias("caller_file")), n.select(F.col("id").alias("dst"), "file")
    return G.distinct_calls(edges(s, d)).join(a, "src").join(b, "dst").filter("caller_file <> file").select("file", "caller_file").distinct()


@query(f"{WITH} SELECT id, name FROM node WHERE lower(name) LIKE '%ring%' ORDER BY name, id LIMIT 50")
def search_nodes(s, d):
    return nodes(s, d).filter(F.lower("name").contains("ring")).select("id", "name").orderBy("name", "id").limit(50)


@query(f"{WITH} SELECT (SELECT count(*) FROM node) AS nodes, (SELECT count(DISTINCT file) FROM node) AS files, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM edge WHERE conf = 'external') AS external")
def store_counts(s, d):
    n = nodes(s, d).agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files"))
    e = edges(s, d).agg(F.count("*").alias("edges"), F.count(F.when(F.col("conf") == "external", 1)).alias("external"))
    return n.crossJoin(e)  # one row each


@query(f"{WITH} SELECT DISTINCT n.name AS external_name FROM edge e JOIN node n ON e.dst = n.id WHERE e.conf = 'external'")
def external_names(s, d):
    return edges(s, d).filter("conf = 'external'").join(nodes(s, d), F.col("dst") == F.col("id")).select(F.col("name").alias("external_name")).distinct()


@query(f"{WITH} SELECT min(id) AS id, file || '::' || name || '::' || cost AS stable_id FROM node GROUP BY 2 HAVING count(*) = 1")
def unique_stable_id(s, d):
    return nodes(s, d).groupBy(F.concat_ws("::", "file", "name", F.col("cost").cast("string")).alias("stable_id")).agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("id", "stable_id")


@query(f"{WITH} SELECT conf, count(*) AS n FROM edge GROUP BY conf")
def edge_basis(s, d):
    return edges(s, d).groupBy("conf").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT id, {LABEL} AS labels FROM fan WHERE {LABEL} <> ''")
def landmarks(s, d):
    return fans(s, d).select("id", G.labels().alias("labels")).filter("labels <> ''")


@query(f"{WITH} SELECT id, name, fan_in * 3 + fan_out * 1.5::DOUBLE AS score FROM fan WHERE fan_in >= 5")
def critical_hubs(s, d):
    return fans(s, d).filter(F.col("fan_in") >= G.HUB_FAN_IN).select("id", "name", G.criticality().cast("double").alias("score"))


@query(f"{WITH} SELECT id, name, fan_out FROM fan WHERE fan_out >= 8")
def god_functions(s, d):
    return fans(s, d).filter(F.col("fan_out") >= G.GOD_FAN_OUT).select("id", "name", "fan_out")


@query(f"{WITH} SELECT id, name, fan_in, fan_out FROM fan WHERE fan_in <= 2 AND fan_out <= 3 AND fan_in + fan_out > 0")
def low_risk(s, d):
    return fans(s, d).filter("fan_in <= 2 and fan_out <= 3 and fan_in + fan_out > 0").select("id", "name", "fan_in", "fan_out")


@query(f"{WITH} SELECT max(CASE WHEN r = least(n - 1, ceil(0.99 * (n - 1))) THEN fan_in END) AS threshold FROM (SELECT fan_in, row_number() OVER (ORDER BY fan_in, id) - 1 AS r, count(*) OVER () AS n FROM fan)")
def ambient_threshold(s, d):
    # nearest rank from counts of each fan-in, which are few, not from a sorted list of all nodes
    from pyspark.sql import Window

    counts = fans(s, d).groupBy("fan_in").count()
    run = counts.withColumns({"upto": F.sum("count").over(Window.orderBy("fan_in")), "n": F.sum("count").over(Window.partitionBy())})
    at = F.least(F.col("n") - 1, F.ceil(F.lit(0.99) * (F.col("n") - 1)))
    return run.filter(F.col("upto") > at).agg(F.min("fan_in").alias("threshold"))


@query(f"""{WITH}, r AS (SELECT c.src, c.dst, round((CASE WHEN a.file <> b.file THEN 0.3 ELSE 0 END) + (CASE WHEN a.fan_in + a.fan_out <= 4 AND b.fan_in >= 5 THEN 0.2 ELSE 0 END) + (CASE WHEN a.lang <> b.lang THEN 0.15 ELSE 0 END), 6)::DOUBLE AS score
  FROM call c JOIN fan a ON c.src = a.id JOIN fan b ON c.dst = b.id) SELECT dst, max(score) AS score, count(*) AS n FROM r WHERE score >= 0.5 GROUP BY dst""")
def surprising_connections(s, d):
    f = fans(s, d)
    a = f.select(F.col("id").alias("src"), F.col("file").alias("af"), F.col("lang").alias("al"), (F.col("fan_in") + F.col("fan_out")).alias("deg"))
    b = f.select(F.col("id").alias("dst"), F.col("file").alias("bf"), F.col("lang").alias("bl"), "fan_in")
    part = lambda test, v: F.when(test, v).otherwise(0.0)
    score = part(F.col("af") != F.col("bf"), 0.3) + part((F.col("deg") <= 4) & (F.col("fan_in") >= 5), 0.2) + part(F.col("al") != F.col("bl"), 0.15)
    rows = G.distinct_calls(edges(s, d)).join(a, "src").join(b, "dst").withColumn("score", F.round(score, 6))
    return rows.filter("score >= 0.5").groupBy("dst").agg(F.max("score").alias("score"), F.count("*").alias("n"))


@query(f"{WITH} SELECT id, CASE WHEN fan_in >= 10 THEN 'surprising' WHEN fan_in >= 5 THEN 'hub' WHEN fan_in >= 3 AND fan_out >= 3 THEN 'chokepoint' ELSE 'ordinary' END AS tier FROM fan")
def change_significance(s, d):
    tier = F.when(F.col("fan_in") >= 10, "surprising").when(F.col("fan_in") >= 5, "hub").when((F.col("fan_in") >= 3) & (F.col("fan_out") >= 3), "chokepoint").otherwise("ordinary")
    return fans(s, d).select("id", tier.alias("tier"))


@query(f"""{WITH}, x AS (SELECT a.file AS af, b.file AS bf FROM call c JOIN node a ON c.src = a.id JOIN node b ON c.dst = b.id),
  z AS (SELECT file, count(*) AS n FROM node GROUP BY file), t AS (SELECT file, sum(i)::BIGINT AS internal, sum(1 - i)::BIGINT AS external FROM (
  SELECT af AS file, (af = bf)::INT AS i FROM x UNION ALL SELECT bf, 0 FROM x WHERE af <> bf) GROUP BY file)
  SELECT z.file, n, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, round(coalesce(internal, 0) / (n * (n - 1))::DOUBLE, 6) AS cohesion, round(coalesce(external, 0) / (internal + external)::DOUBLE, 6) AS coupling FROM z LEFT JOIN t ON z.file = t.file WHERE n > 1""")
def directory_clusters(s, d):
    n = nodes(s, d)
    x = G.distinct_calls(edges(s, d)).join(n.select(F.col("id").alias("src"), F.col("file").alias("af")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("bf")), "dst")
    ends = x.select(F.col("af").alias("file"), (F.col("af") == F.col("bf")).cast("int").alias("i")).unionByName(x.filter("af <> bf").select(F.col("bf").alias("file"), F.lit(0).alias("i")))
    t = ends.groupBy("file").agg(F.sum("i").alias("internal"), F.sum(1 - F.col("i")).alias("external"))
    z = n.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1")
    out = z.join(t, "file", "left")
    coupling = F.round(F.col("external") / (F.col("internal") + F.col("external")), 6)
    return out.withColumn("coupling", coupling).na.fill(0, ["internal", "external"]).select("file", "n", "internal", "external", F.round(F.col("internal") / (F.col("n") * (F.col("n") - 1)), 6).alias("cohesion"), "coupling")


@query(f"{WITH} SELECT a.file AS from_file, b.file AS to_file, count(*) AS n FROM call c JOIN node a ON c.src = a.id JOIN node b ON c.dst = b.id WHERE a.file <> b.file GROUP BY a.file, b.file")
def cluster_graph(s, d):
    n = nodes(s, d)
    x = G.distinct_calls(edges(s, d)).join(n.select(F.col("id").alias("src"), F.col("file").alias("from_file")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("to_file")), "dst")
    return x.filter("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count("*").alias("n"))


LAYERS = [("Brand#1", 0), ("Brand#2", 1), ("Brand#3", 2), ("Brand#4", 3), ("Brand#5", 4)]
LAYER_SQL = "CASE " + " ".join(f"WHEN file LIKE '{p}%' THEN {r}" for p, r in LAYERS) + " END"


def _layer(file):
    out = F.lit(None).cast("int")
    for prefix, rank in reversed(LAYERS):  # the first that fits wins
        out = F.when(file.startswith(prefix), rank).otherwise(out)
    return out


@query(f"{WITH}, l AS (SELECT id, {LAYER_SQL} AS r FROM node) SELECT src, dst, a.r AS from_rank, b.r AS to_rank FROM call JOIN l a ON src = a.id JOIN l b ON dst = b.id WHERE a.r > b.r")
def layer_violations(s, d):
    r = nodes(s, d).select("id", _layer(F.col("file")).alias("r"))
    return G.distinct_calls(edges(s, d)).join(r.select(F.col("id").alias("src"), F.col("r").alias("from_rank")), "src").join(r.select(F.col("id").alias("dst"), F.col("r").alias("to_rank")), "dst").filter("from_rank > to_rank").select("src", "dst", "from_rank", "to_rank")


RULES = [("forbidden", "Brand#1", "Brand#2"), ("forbidden", "Brand#3", "Brand#1"), ("forbidden", "Brand#77", "Brand#1")]
RULE_SQL = "rule(kind, a, b) AS (VALUES " + ", ".join(str(x) for x in RULES) + ")"


@query(f"{WITH}, {RULE_SQL} SELECT DISTINCT r.a || '->' || r.b AS rule, src, dst FROM call JOIN node x ON src = x.id JOIN node y ON dst = y.id JOIN rule r ON starts_with(x.file, r.a) AND starts_with(y.file, r.b)")
def arch_rules(s, d):
    n = nodes(s, d)
    rules = F.broadcast(s.createDataFrame(RULES, "kind string, a string, b string"))  # a declared list of rules
    x = G.distinct_calls(edges(s, d)).join(n.select(F.col("id").alias("src"), F.col("file").alias("af")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("bf")), "dst")
    return x.join(rules, F.col("af").startswith(F.col("a")) & F.col("bf").startswith(F.col("b"))).select(F.concat("a", F.lit("->"), "b").alias("rule"), "src", "dst").distinct()


@query(f"{WITH}, {RULE_SQL}, p AS (SELECT a AS prefix FROM rule UNION SELECT b FROM rule) SELECT prefix FROM p WHERE NOT EXISTS (SELECT 1 FROM node WHERE starts_with(file, prefix))")
def rule_typos(s, d):
    prefixes = s.createDataFrame(sorted({(x,) for _, a, b in RULES for x in (a, b)}), "prefix string")
    files = nodes(s, d).select("file").distinct()
    return prefixes.join(files, F.col("file").startswith(F.col("prefix")), "left_anti")


@query(f"{WITH} SELECT DISTINCT dst AS id, a.file AS test_file FROM call JOIN node a ON src = a.id JOIN node b ON dst = b.id WHERE a.lang LIKE 'STANDARD%' AND b.lang NOT LIKE 'STANDARD%'")
def tested_by(s, d):
    """Types that begin with STANDARD stand for test files."""
    n = nodes(s, d)
    a = n.filter("lang like 'STANDARD%'").select(F.col("id").alias("src"), F.col("file").alias("test_file"))
    b = n.filter("lang not like 'STANDARD%'").select(F.col("id").alias("dst"))
    return G.distinct_calls(edges(s, d)).join(a, "src").join(b, "dst").select(F.col("dst").alias("id"), "test_file").distinct()


def _seeds(s, d):
    return fans(s, d).filter("fan_in = 0 and fan_out >= 3").select("id")


SEEDS = "seed AS (SELECT id FROM fan WHERE fan_in = 0 AND fan_out >= 3)"
# DuckDB has no rows of earlier rounds to compare with: more levels than the test tables have
REACH = f"{REC}, {SEEDS}, walk(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT c.dst, depth + 1 FROM walk w JOIN (SELECT DISTINCT src, dst FROM edge) c ON w.id = c.src WHERE depth < 60)"


@query(f"{REACH} SELECT n.id, coalesce(min(depth), -1) AS depth FROM node n LEFT JOIN walk w ON n.id = w.id GROUP BY n.id")
def bfs_depth(s, d):
    """Each node's depth from the entry points; -1 for those that none reaches."""
    return nodes(s, d).select("id").join(G.bfs(edges(s, d), _seeds(s, d)), "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


CLOSED = f"{REC}, {SEEDS}, live(id) AS (SELECT id FROM seed UNION SELECT e.dst FROM live l JOIN edge e ON l.id = e.src)"


@query(f"{CLOSED} SELECT id FROM live")
def reachable(s, d):
    return G.bfs(edges(s, d), _seeds(s, d)).select("id")


@query(f"{CLOSED} SELECT f.id, CASE WHEN fan_in = 0 THEN 'high' ELSE 'medium' END AS confidence FROM fan f WHERE f.id NOT IN (SELECT id FROM live)")
def dead_code(s, d):
    live = G.bfs(edges(s, d), _seeds(s, d)).select("id")
    return fans(s, d).join(live, "id", "left_anti").select("id", F.when(F.col("fan_in") == 0, "high").otherwise("medium").alias("confidence"))


TESTS = f"{REC}, live(id) AS (SELECT id FROM node WHERE lang LIKE 'STANDARD%' UNION SELECT e.dst FROM live l JOIN edge e ON l.id = e.src)"


@query(f"{TESTS} SELECT id, {LABEL} AS labels FROM fan WHERE id NOT IN (SELECT id FROM live) AND fan_in + fan_out > 0")
def coverage_gaps(s, d):
    live = G.bfs(edges(s, d), nodes(s, d).filter("lang like 'STANDARD%'").select("id")).select("id")
    return fans(s, d).filter("fan_in + fan_out > 0").join(live, "id", "left_anti").select("id", G.labels().alias("labels"))


@query(f"""{REC}, t(id, depth) AS (SELECT id, 0 FROM fan WHERE fan_in >= 5 UNION SELECT c.src, depth + 1 FROM t JOIN (SELECT DISTINCT src, dst FROM edge) c ON t.id = c.dst WHERE depth < 12)
  SELECT t.id AS test_id, CASE WHEN min(depth) <= 1 THEN 'high' WHEN min(depth) <= 3 THEN 'medium' ELSE 'low' END AS confidence FROM t JOIN node n ON t.id = n.id WHERE n.lang LIKE 'STANDARD%' GROUP BY t.id""")
def select_tests(s, d):
    changed = fans(s, d).filter("fan_in >= 5").select("id")
    back = G.bfs(G.reversed_edges(edges(s, d)), changed, 12)
    level = F.when(F.col("depth") <= 1, "high").when(F.col("depth") <= 3, "medium").otherwise("low")
    return back.join(nodes(s, d).filter("lang like 'STANDARD%'").select("id"), "id").select(F.col("id").alias("test_id"), level.alias("confidence"))


def _cheapest_sql(rounds):
    """The labels (distance, hops, predecessor) of each node after so many rounds: of a list, the least is the best."""
    steps = [f"w AS MATERIALIZED (SELECT src, dst, min({COST}) AS cost FROM edge WHERE conf <> 'external' GROUP BY src, dst)", "p0 AS MATERIALIZED (SELECT id, [0, 0, -1]::BIGINT[] AS x FROM seed)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT id, min(x) AS x FROM (SELECT * FROM p{i} UNION ALL SELECT w.dst, [p.x[1] + w.cost, p.x[2] + 1, w.src]::BIGINT[] FROM p{i} p JOIN w ON p.id = w.src WHERE p.x[1] + w.cost <= {rounds}) GROUP BY id)")
    return f"{REC}, {SEEDS}, {', '.join(steps)}"


@query(f"{_cheapest_sql(12)} SELECT id, x[1]::INT AS distance, x[2]::INT AS hops, nullif(x[3], -1) AS predecessor FROM p12")
def weighted_path(s, d):
    """The cheapest way from an entry point to each node, up to a cost of 12: its cost, length and last step."""
    return G.shortest(edges(s, d), _seeds(s, d))


_SPREAD = "{0}(id, root, depth) AS (SELECT id, id, 0 FROM fan WHERE fan_in >= 5 UNION SELECT c.{1}, root, depth + 1 FROM {0} JOIN (SELECT DISTINCT src, dst FROM edge) c ON {0}.id = c.{2} WHERE depth < 2)"


@query(f"""{REC}, {_SPREAD.format('up', 'src', 'dst')}, {_SPREAD.format('down', 'dst', 'src')},
  b AS (SELECT root, count(DISTINCT id) - 1 AS blast FROM (SELECT id, root FROM up UNION ALL SELECT id, root FROM down) GROUP BY root)
  SELECT f.id, blast, least(100, floor(4 * fan_in + 2 * fan_out + 20 + 1.5 * blast + 0.5))::BIGINT AS risk FROM fan f JOIN b ON f.id = b.root""")
def impact(s, d):
    """Two levels of callers and of callees of each hub, and the risk they make."""
    e = edges(s, d).select("src", "dst").distinct()
    roots = fans(s, d).filter(F.col("fan_in") >= G.HUB_FAN_IN).select(F.col("id").alias("root"), "fan_in", "fan_out")

    def reach(a, b):
        one = roots.select("root").join(e, F.col("root") == F.col(b)).select("root", F.col(a).alias("id")).distinct()
        return one.unionByName(one.join(e, F.col("id") == F.col(b)).select("root", F.col(a).alias("id")))

    blast = reach("src", "dst").unionByName(reach("dst", "src")).filter("root <> id").distinct().groupBy("root").agg(F.count("*").alias("blast"))
    risk = F.least(F.lit(100), F.floor(4 * F.col("fan_in") + 2 * F.col("fan_out") + 20 + 1.5 * F.coalesce("blast", F.lit(0)) + 0.5))
    return roots.join(blast, "root", "left").select(F.col("root").alias("id"), F.coalesce("blast", F.lit(0)).alias("blast"), risk.cast("long").alias("risk"))


@query("WITH RECURSIVE up(child, ancestor, depth) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier), t AS (SELECT * FROM up UNION ALL SELECT a.child, b.ancestor, 2 FROM up a JOIN up b ON a.ancestor = b.child) SELECT ancestor, depth, count(*) AS n FROM t GROUP BY ancestor, depth")
def hierarchy_closure(s, d):
    n, u = table(s, d, "nation"), table(s, d, "supplier")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    up = n.select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("ancestor")).unionByName(u.select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("ancestor")))
    return descendants(up.withColumnRenamed("ancestor", "parent")).groupBy(F.col("base").alias("ancestor"), "depth").agg(F.count("*").alias("n"))


_W = "w AS (SELECT p.src, p.dst, g.deg FROM (SELECT DISTINCT src, dst FROM edge) p JOIN (SELECT src, count(DISTINCT dst) AS deg FROM edge GROUP BY src) g ON p.src = g.src)"


def _pagerank_sql(rounds):
    """All rounds, of which the first that moves no rank by 1e-6 is taken."""
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM node) AS rank FROM node)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / (SELECT count(*) FROM node) + 0.85 * coalesce(g.got, 0) AS rank FROM node n LEFT JOIN (SELECT w.dst, sum(r.rank / w.deg) AS got FROM w JOIN r{i} r ON w.src = r.id GROUP BY w.dst) g ON n.id = g.dst)")
    moved = " UNION ALL ".join(f"SELECT {i} AS i, (SELECT max(abs(a.rank - b.rank)) FROM r{i} a JOIN r{i - 1} b ON a.id = b.id) AS moved" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, id, rank FROM r{i}" for i in range(1, rounds + 1))
    return f"{WITH}, {_W}, {', '.join(steps)}, stop AS (SELECT coalesce(min(i) FILTER (moved < 1e-6), {rounds}) AS i FROM ({moved})), done AS (SELECT id, rank FROM ({every}) JOIN stop USING (i)) SELECT id, round(rank / (SELECT max(rank) FROM done), 6) AS rank FROM done"


@query(_pagerank_sql(30))
def pagerank(s, d):
    return G.pagerank(nodes(s, d), edges(s, d)).select("id", F.round("rank", 6).alias("rank"))


@query()
def personalized_pagerank(s, d):
    return G.personalized_pagerank(nodes(s, d), edges(s, d), _seeds(s, d)).select("id", F.round("rank", 9).alias("rank"))


@query()
def strong_components(s, d):
    return G.strong_components(edges(s, d))


@query()
def communities(s, d):
    return G.label_rounds(G.distinct_calls(edges(s, d)))


@query(f"""{WITH}, o AS (SELECT DISTINCT src, dst FROM edge WHERE conf IN ('import','re_export')), n2 AS (SELECT DISTINCT src, dst FROM edge WHERE conf IN ('import','type_name'))
  SELECT coalesce(o.src, n2.src) AS src, coalesce(o.dst, n2.dst) AS dst, CASE WHEN o.src IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL OUTER JOIN n2 ON o.src = n2.src AND o.dst = n2.dst WHERE o.src IS NULL OR n2.src IS NULL""")
def structural_diff(s, d):
    e = edges(s, d)
    old = e.filter("conf in ('import','re_export')").select("src", "dst").distinct().withColumn("old", F.lit(1))
    new = e.filter("conf in ('import','type_name')").select("src", "dst").distinct().withColumn("new", F.lit(1))
    return old.join(new, ["src", "dst"], "full_outer").filter("old is null or new is null").select("src", "dst", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"))


@query(f"""{WITH}, o AS (SELECT * FROM node WHERE id % 2 = 0), n2 AS (SELECT * FROM node WHERE id % 2 = 1),
  p AS (SELECT o.id AS old_id, n2.id AS new_id, count(*) OVER (PARTITION BY o.id) AS a, count(*) OVER (PARTITION BY n2.id) AS b FROM o JOIN n2 ON o.file = n2.file AND o.lang = n2.lang AND o.cost = n2.cost)
  SELECT old_id, new_id FROM p WHERE a = 1 AND b = 1""")
def continuity(s, d):
    """Disappeared (even ids stand for them) and appeared nodes with the same body, where the match is unique both ways."""
    from pyspark.sql import Window

    n = nodes(s, d)
    key = ["file", "lang", "cost"]
    old, new = n.filter("id % 2 = 0").select(F.col("id").alias("old_id"), *key), n.filter("id % 2 = 1").select(F.col("id").alias("new_id"), *key)
    # a body that several share on a side matches nothing, so only single ones are joined
    one = lambda x: x.withColumn("n", F.count("*").over(Window.partitionBy(*key))).filter("n = 1").drop("n")
    return one(old).join(one(new), key).select("old_id", "new_id")

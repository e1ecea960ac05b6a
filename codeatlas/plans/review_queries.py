"""Queries on dead code, on what a change did to nodes, and on landmarks. A part's brand, type and size stand for its module
where modules have to be many."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import review as R
from codeatlas.plans.graph_queries import REC, WITH, fans, maker
from codeatlas.sources.tables import edges, nodes, table

QUERIES, ORACLE_SQL, query = maker()

_MODULE = "file || '/' || lang || '/' || cost"
_ROOT = "id % 40 = 0 OR (lang LIKE 'PROMO%' AND id % 4 = 0)"
_LIVE = f"pair AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge), root AS MATERIALIZED (SELECT id FROM node WHERE {_ROOT}), live(id) AS (SELECT id FROM root UNION SELECT pair.dst FROM live JOIN pair ON live.id = pair.src)"


@query(f"""{REC}, {_LIVE}, mod AS (SELECT id, name, {_MODULE} AS file, cost % 10 = 0 AS dynamic FROM node), inn AS (SELECT dst AS id, count(*) AS callers, bool_or(conf = 'synthesized') AS made FROM edge GROUP BY 1),
  used AS (SELECT DISTINCT b.file FROM edge e JOIN mod a ON a.id = e.src JOIN mod b ON b.id = e.dst WHERE conf = 'import' AND a.file <> b.file), amb AS (SELECT DISTINCT name FROM edge e JOIN node ON id = dst WHERE conf = 'name_only' AND e.src % 10 = 0),
  y AS (SELECT m.id, CASE WHEN dynamic THEN 'dynamic language' WHEN file IN (SELECT file FROM used) THEN 'module imported' WHEN made THEN 'synthesized edge' WHEN callers > 0 THEN 'called by dead code' WHEN name IN (SELECT name FROM amb) THEN 'named in an ambiguous call' ELSE 'no caller' END AS reason FROM mod m LEFT JOIN inn USING (id) WHERE m.id NOT IN (SELECT id FROM live))
  SELECT id, CASE WHEN reason IN ('dynamic language', 'module imported', 'synthesized edge') THEN 'low' WHEN reason = 'no caller' THEN 'high' ELSE 'medium' END AS confidence, reason FROM y""")
def dead_code_verdicts(s, d):
    """How sure it is that a function no root reaches is dead, and why."""
    f, e = nodes(s, d), edges(s, d)
    m = f.select("id", "name", F.expr(_MODULE).alias("file"), (F.col("cost") % 10 == 0).alias("dynamic"))
    a, b = m.select(F.col("id").alias("src"), F.col("file").alias("by")), m.select(F.col("id").alias("dst"), "file")
    used = e.filter("conf = 'import'").join(a, "src").join(b, "dst").filter("by <> file").select("file")
    unsure = e.filter("conf = 'name_only' and src % 10 = 0").join(f.select(F.col("id").alias("dst"), "name"), "dst").select("name")
    return R.dead_verdicts(m, e, f.filter(_ROOT).select("id"), used, unsure)


@query(f"""{REC}, {_LIVE}, gone AS MATERIALIZED (SELECT id FROM fan WHERE fan_in >= 3 AND id % 4 <> 0), stay(id) AS (SELECT id FROM root WHERE id NOT IN (SELECT id FROM gone) UNION SELECT pair.dst FROM stay JOIN pair ON stay.id = pair.src WHERE pair.dst NOT IN (SELECT id FROM gone))
  SELECT id FROM live WHERE id NOT IN (SELECT id FROM stay) AND id NOT IN (SELECT id FROM gone)""")
def delete_impact(s, d):
    """What dies with the functions that three or more call, were all but each fourth deleted."""
    gone = fans(s, d).filter("fan_in >= 3 and id % 4 <> 0").select("id")
    return R.delete_impact(edges(s, d), nodes(s, d).filter(_ROOT).select("id"), gone)


_VERSIONS = """old AS MATERIALIZED (SELECT p_partkey AS id, p_size % 4 AS signature, 'b' || p_name || p_size || p_retailprice AS body, 's' || p_size || p_brand AS shape FROM part WHERE p_partkey % 9 <> 0),
  new AS MATERIALIZED (SELECT CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS id, CASE WHEN p_partkey % 11 = 0 THEN 9 ELSE p_size % 4 END AS signature, CASE WHEN p_partkey % 14 = 0 THEN 'new' || p_partkey ELSE 'b' || p_name || p_size || p_retailprice END AS body, 's' || p_size || p_brand AS shape FROM part WHERE p_partkey % 13 <> 0)"""


@query(f"""{WITH}, {_VERSIONS}, gone AS MATERIALIZED (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)), came AS MATERIALIZED (SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)),
  sure AS MATERIALIZED (SELECT g.id, c.id AS other FROM (SELECT body, min(id) AS id FROM gone GROUP BY 1 HAVING count(*) = 1) g JOIN (SELECT body, min(id) AS id FROM came GROUP BY 1 HAVING count(*) = 1) c USING (body)),
  g2 AS MATERIALIZED (SELECT * FROM gone WHERE id NOT IN (SELECT id FROM sure)), c2 AS MATERIALIZED (SELECT * FROM came WHERE id NOT IN (SELECT other FROM sure)),
  close AS MATERIALIZED (SELECT shape, g.n, g.id, c.n AS m, c.id AS other FROM (SELECT shape, count(*) AS n, min(id) AS id FROM g2 GROUP BY 1) g JOIN (SELECT shape, count(*) AS n, min(id) AS id FROM c2 GROUP BY 1) c USING (shape)),
  ren AS MATERIALIZED (SELECT id, other, 'body' AS basis FROM sure UNION ALL SELECT id, other, 'shape' FROM close WHERE n = 1 AND m = 1), sig AS MATERIALIZED (SELECT o.id FROM old o JOIN new USING (id) WHERE o.signature <> new.signature),
  same AS (SELECT o.id FROM old o JOIN new USING (id) WHERE o.signature = new.signature AND o.body = new.body)
  SELECT 'renamed' AS change, id, other, basis FROM ren UNION ALL SELECT CASE WHEN shape IN (SELECT shape FROM close WHERE n > 1 OR m > 1) THEN 'ambiguous' ELSE 'removed' END, id, NULL, NULL FROM g2 WHERE id NOT IN (SELECT id FROM ren)
  UNION ALL SELECT 'added', id, NULL, NULL FROM came WHERE id NOT IN (SELECT other FROM ren) UNION ALL SELECT 'signature', id, NULL, NULL FROM sig
  UNION ALL SELECT DISTINCT 'stale-caller', src, dst, NULL FROM edge WHERE dst IN (SELECT id FROM gone UNION ALL SELECT id FROM sig) AND src IN (SELECT id FROM same)""")
def node_diff(s, d):
    """What became of the nodes between two versions, and who calls what isn't as it was."""
    p, k = table(s, d, "part"), F.col("p_partkey")
    body = F.concat(F.lit("b"), "p_name", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    shape = F.concat(F.lit("s"), F.col("p_size").cast("string"), "p_brand")
    old = p.filter("p_partkey % 9 <> 0").select(k.alias("id"), (F.col("p_size") % 4).alias("signature"), body.alias("body"), shape.alias("shape"))
    new = p.filter("p_partkey % 13 <> 0").select(F.when(k % 7 == 0, k + 1000000).otherwise(k).alias("id"), F.when(k % 11 == 0, 9).otherwise(F.col("p_size") % 4).alias("signature"), F.when(k % 14 == 0, F.concat(F.lit("new"), k.cast("string"))).otherwise(body).alias("body"), shape.alias("shape"))
    return R.node_changes(old, new, edges(s, d))


@query(f"""{WITH}, ch AS (SELECT p_brand || '/' || p_type || '/' || p_size AS file, count(DISTINCT l_orderkey) AS churn FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), x AS (SELECT fan.*, churn FROM fan LEFT JOIN ch ON ch.file = {_MODULE.replace('file', 'fan.file')}),
  l AS (SELECT id, 'hub' AS label, 'fan-in ' || fan_in AS evidence, fan_in >= 5 AS ok FROM x UNION ALL SELECT id, 'orchestrator', 'fan-out ' || fan_out, fan_out >= 5 FROM x UNION ALL SELECT id, 'chokepoint', 'fan-in ' || fan_in || ', fan-out ' || fan_out, fan_in >= 3 AND fan_out >= 3 FROM x
    UNION ALL SELECT id, 'entrypoint', 'fan-out ' || fan_out, fan_in = 0 AND fan_out > 0 FROM x UNION ALL SELECT id, 'volatile', 'churn ' || churn, churn >= 12 FROM x UNION ALL SELECT id, 'dead', 'no edges', fan_in = 0 AND fan_out = 0 FROM x) SELECT id, label, evidence FROM l WHERE ok""")
def landmark_evidence(s, d):
    """Landmark labels, a row for each, with what they rest on."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("file"))
    churn = table(s, d, "lineitem").join(p, "l_partkey").groupBy("file").agg(F.countDistinct("l_orderkey").alias("churn"))
    return R.landmark_evidence(fans(s, d).withColumn("file", F.expr(_MODULE)), churn)


_TESTED = "tb AS MATERIALIZED (SELECT a.id, b.id AS test FROM node a JOIN node b ON b.id = a.id + 1 WHERE a.id % 6 = 1 AND b.lang LIKE 'STANDARD%' AND a.lang NOT LIKE 'STANDARD%')"


@query(f"""{REC}, {_TESTED}, pair AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge WHERE conf NOT IN ('external', 'synthesized')), seed AS MATERIALIZED (SELECT id, file FROM fan WHERE fan_in >= 3 AND lang NOT LIKE 'STANDARD%'),
  level(id, depth) AS (SELECT id, 0 FROM seed UNION SELECT pair.src, depth + 1 FROM level JOIN pair ON level.id = pair.dst WHERE depth < 12), far AS MATERIALIZED (SELECT id, min(depth) AS depth FROM level GROUP BY id),
  nxt AS MATERIALIZED (SELECT pair.src AS id, min(pair.dst) AS nxt FROM pair JOIN far a ON a.id = pair.src JOIN far b ON b.id = pair.dst WHERE b.depth = a.depth - 1 GROUP BY 1),
  way(id, path, tip) AS (SELECT id, [id], id FROM far UNION ALL SELECT way.id, list_append(path, nxt), nxt FROM way JOIN nxt ON nxt.id = way.tip), ways AS MATERIALIZED (SELECT id, path FROM way WHERE tip IN (SELECT id FROM seed)),
  c AS (SELECT w.id AS test, CASE WHEN len(path) = 2 THEN 0 WHEN len(path) <= 4 THEN 1 ELSE 2 END AS rank, 'call' AS source, path FROM ways w JOIN node USING (id) WHERE len(path) > 1 AND lang LIKE 'STANDARD%' UNION ALL SELECT test, CASE WHEN len(path) = 1 THEN 0 ELSE 1 END, 'tested_by', list_prepend(test, path) FROM ways JOIN tb USING (id)),
  best AS MATERIALIZED (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY test ORDER BY rank, len(path), path, source) = 1), bare AS (SELECT DISTINCT file FROM seed WHERE id NOT IN (SELECT path[-1] FROM best)),
  z AS (SELECT * FROM best UNION ALL SELECT DISTINCT test, 2, 'same_file', [test] FROM tb JOIN node USING (id) WHERE file IN (SELECT file FROM bare))
  SELECT test, ['high', 'medium', 'low'][rank + 1] AS confidence, source, list_aggregate(path, 'string_agg', '>') AS path FROM z QUALIFY row_number() OVER (PARTITION BY test ORDER BY rank, len(path), path, source) = 1""")
def test_selection(s, d):
    """The tests to run for the functions that three or more call, by calls, by what they are known to test, by file."""
    f = nodes(s, d).select("id", "file", F.col("lang").like("STANDARD%").alias("is_test"))
    tests = f.filter("is_test").select((F.col("id") - 1).alias("id"), F.col("id").alias("test"))
    known = f.filter("id % 6 = 1 and not is_test").select("id").join(tests, "id")
    x = R.select_tests(f, edges(s, d).filter("conf not in ('external', 'synthesized')"), fans(s, d).filter("fan_in >= 3").select("id"), known)
    return x.withColumn("path", F.array_join(F.transform("path", lambda i: i.cast("string")), ">"))

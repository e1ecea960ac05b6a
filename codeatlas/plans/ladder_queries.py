"""The whole ladder of call resolution. Receivers, types of variables, dotted names and parents of classes are derived from
the projected code by fixed rules, so that every rung occurs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.operators import ladder as L
from codeatlas.plans.code_queries import IDENT_SQL, functions
from codeatlas.plans.graph_queries import E, maker
from codeatlas.sources.tables import edges, table

QUERIES, ORACLE_SQL, query = maker()

_FACTS = f"""{E}, ident AS MATERIALIZED (SELECT p_partkey AS id, {IDENT_SQL} AS base, p_brand AS file, p_type AS cls, CASE WHEN p_partkey % 2 = 0 THEN 'Java' ELSE 'TypeScript' END AS lang, (p_partkey * 37) % 1000 AS first, (p_partkey * 37) % 1000 + p_size * 4 AS last FROM part),
  fn AS MATERIALIZED (SELECT id, CASE WHEN id % 8 = 0 THEN 'app.' || base ELSE base END AS name, file, cls, lang, first, last FROM ident), raw AS MATERIALIZED (SELECT DISTINCT e.src, e.dst, e.conf, b.base, b.cls AS dcls, b.file AS dfile FROM edge e JOIN ident b ON e.dst = b.id),
  call AS MATERIALIZED (SELECT src || ':' || dst || ':' || conf AS call_id, src AS caller, CASE WHEN conf = 'external' THEN 'ext_' || base ELSE base END AS name, CASE conf WHEN 'self_cls' THEN ['self', 'this', 'super'][src % 3 + 1] WHEN 'type_name' THEN dcls WHEN 'type_inference' THEN 'v' || (dst % 5) WHEN 'http_endpoint' THEN 'app' END AS receiver, dst, conf FROM raw),
  vars AS MATERIALIZED (SELECT src AS caller, 'v' || (dst % 5) AS variable, min(dcls) AS type FROM raw WHERE conf = 'type_inference' AND dst % 3 > 0 GROUP BY 1, 2),
  imp AS MATERIALIZED (SELECT file, name, min({{'target': target, 'chained': chained}}) AS lnk FROM (SELECT a.file, raw.base AS name, dfile AS target, conf = 're_export' AS chained FROM raw JOIN ident a ON a.id = src WHERE conf IN ('import', 're_export') UNION ALL SELECT a.file, dcls, dfile, false FROM raw JOIN ident a ON a.id = src WHERE conf = 'type_name' AND src % 5 = 0) GROUP BY 1, 2),
  cls AS (SELECT DISTINCT p_type AS cls FROM part), par AS (SELECT cls, lead(cls) OVER (ORDER BY cls) AS parent FROM cls)"""


def facts(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    first = (k * 37) % 1000
    more = p.select(k.alias("id"), F.when(k % 2 == 0, "Java").otherwise("TypeScript").alias("lang"), first.alias("first"), (first + F.col("p_size") * 4).alias("last"))
    ident = functions(s, d).join(more, "id")
    fn = ident.withColumn("name", F.when(F.col("id") % 8 == 0, F.concat(F.lit("app."), "name")).otherwise(F.col("name")))
    b = ident.select(F.col("id").alias("dst"), F.col("name").alias("base"), F.col("cls").alias("dcls"), F.col("file").alias("dfile"))
    raw = edges(s, d).distinct().join(b, "dst")
    v = F.concat(F.lit("v"), (F.col("dst") % 5).cast("string"))
    own = F.get(F.array(F.lit("self"), F.lit("this"), F.lit("super")), (F.col("src") % 3).cast("int"))
    receiver = F.when(F.col("conf") == "self_cls", own).when(F.col("conf") == "type_name", F.col("dcls")).when(F.col("conf") == "type_inference", v).when(F.col("conf") == "http_endpoint", "app")
    calls = raw.select(F.concat_ws(":", "src", "dst", "conf").alias("call_id"), F.col("src").alias("caller"), F.when(F.col("conf") == "external", F.concat(F.lit("ext_"), "base")).otherwise(F.col("base")).alias("name"), receiver.alias("receiver"))
    variables = raw.filter("conf = 'type_inference' and dst % 3 > 0").select(F.col("src").alias("caller"), v.alias("variable"), F.col("dcls").alias("type"))
    at = raw.join(ident.select(F.col("id").alias("src"), "file"), "src")
    imports = at.filter("conf in ('import', 're_export')").select("file", F.col("base").alias("name"), F.col("dfile").alias("target"), (F.col("conf") == "re_export").alias("chained"))
    imports = imports.unionByName(at.filter("conf = 'type_name' and src % 5 = 0").select("file", F.col("dcls").alias("name"), F.col("dfile").alias("target"), F.lit(False).alias("chained")))
    parents = p.select(F.col("p_type").alias("cls")).distinct().select("cls", F.lead("cls").over(Window.orderBy("cls")).alias("parent"))  # a row for each type
    return calls, fn, imports, parents, variables


@query(f"""WITH RECURSIVE {_FACTS}, anc(cls, tip, level) AS (SELECT cls, cls, 0 FROM cls UNION ALL SELECT anc.cls, par.parent, level + 1 FROM anc JOIN par ON par.cls = anc.tip WHERE par.parent IS NOT NULL),
  x AS MATERIALIZED (SELECT c.*, f.file, f.cls, f.lang, f.first, f.last, f.name AS called FROM call c JOIN fn f ON f.id = c.caller),
  s AS (SELECT call_id, level, f.id, f.file = x.file AS own, f.file = imp.lnk.target AS imp FROM x JOIN anc ON x.cls = anc.cls AND (receiver <> 'super' OR level > 0) JOIN fn f ON f.cls = anc.tip AND f.name = x.name LEFT JOIN imp ON imp.file = x.file AND imp.name = anc.tip WHERE receiver IN ('self', 'this', 'super')),
  s1 AS (SELECT call_id, level, coalesce(min(id) FILTER (own), min(id) FILTER (imp), CASE WHEN count(*) = 1 THEN min(id) END) AS id, count(*) AS n FROM s GROUP BY 1, 2), r1 AS MATERIALIZED (SELECT * FROM s1 QUALIFY level = min(level) OVER (PARTITION BY call_id)),
  t AS (SELECT call_id, f.id, f.file = x.file AS own, f.file = imp.lnk.target AS imp FROM x JOIN fn f ON f.cls = x.receiver AND f.name = x.name LEFT JOIN imp ON imp.file = x.file AND imp.name = x.receiver WHERE x.lang = 'Java' AND regexp_matches(receiver, '^[A-Z]')),
  r2 AS MATERIALIZED (SELECT call_id, coalesce(min(id) FILTER (own), min(id) FILTER (imp), CASE WHEN count(*) = 1 THEN min(id) END) AS id, count(*) AS n FROM t GROUP BY 1),
  r3 AS MATERIALIZED (SELECT call_id, min(f.id) AS id FROM x JOIN fn f ON f.file = x.file AND f.name = receiver || '.' || x.name WHERE x.lang = 'TypeScript' GROUP BY 1), r4 AS MATERIALIZED (SELECT call_id, min(f.id) AS id FROM x JOIN vars v ON v.caller = x.caller AND v.variable = x.receiver JOIN fn f ON f.cls = v.type AND f.name = x.name GROUP BY 1),
  r5 AS MATERIALIZED (SELECT call_id, min(f.id) AS id, bool_or(i.lnk.chained) AS chained FROM x LEFT JOIN imp i ON i.file = x.file AND i.name = x.name LEFT JOIN imp j ON j.file = x.file AND j.name = x.receiver JOIN fn f ON f.file = coalesce(i.lnk.target, j.lnk.target) AND f.name = x.name GROUP BY 1),
  r6 AS MATERIALIZED (SELECT call_id, coalesce(arg_min(f.id, (f.last - f.first, f.id)) FILTER (f.id <> x.caller AND f.first >= x.first AND f.last <= x.last), min(x.caller) FILTER (f.id = x.caller), min(f.id)) AS id FROM x JOIN fn f ON f.file = x.file AND f.name = x.name WHERE receiver IS NULL GROUP BY 1),
  r7 AS MATERIALIZED (SELECT name, min(id) AS id, count(*) AS n FROM fn GROUP BY 1),
  y AS (SELECT x.call_id, r1.id AS c1, r1.n AS n1, r2.id AS c2, r2.n AS n2, r3.id AS c3, r4.id AS c4, r5.id AS c5, chained, r6.id AS c6, CASE WHEN receiver IS NULL THEN r7.n END AS n7, r7.id AS c7 FROM x LEFT JOIN r1 USING (call_id) LEFT JOIN r2 USING (call_id) LEFT JOIN r3 USING (call_id) LEFT JOIN r4 USING (call_id) LEFT JOIN r5 USING (call_id) LEFT JOIN r6 USING (call_id) LEFT JOIN r7 ON r7.name = x.name),
  z AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN 1 WHEN n1 IS NOT NULL THEN 11 WHEN c2 IS NOT NULL THEN 2 WHEN n2 IS NOT NULL THEN 12 WHEN c3 IS NOT NULL THEN 3 WHEN c4 IS NOT NULL THEN 4 WHEN c5 IS NOT NULL THEN 5 WHEN c6 IS NOT NULL THEN 6 WHEN n7 = 1 THEN 7 WHEN n7 > 1 THEN 17 ELSE 0 END AS k FROM y)
  SELECT call_id, CASE k WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 WHEN 4 THEN c4 WHEN 5 THEN c5 WHEN 6 THEN c6 WHEN 7 THEN c7 END AS callee,
  CASE k WHEN 0 THEN 'external' WHEN 1 THEN 'self_cls' WHEN 2 THEN 'type_name' WHEN 3 THEN 'same_file' WHEN 4 THEN 'type_inference' WHEN 5 THEN CASE WHEN chained THEN 're_export' ELSE 'import' END WHEN 6 THEN 'same_file' WHEN 7 THEN 'name_only' ELSE 'ambiguous' END AS basis,
  CASE k WHEN 11 THEN 'self_cls' WHEN 12 THEN 'type_name' WHEN 17 THEN 'name_only' END AS rung, CASE k WHEN 11 THEN n1 WHEN 12 THEN n2 WHEN 17 THEN n7 END AS candidates FROM z""")
def call_ladder(s, d):
    """Each call by the first rung that fits, or the rung at which it stays ambiguous."""
    return L.climb(*facts(s, d))


@query("SELECT rung, candidates, count(*) AS calls FROM (" + ORACLE_SQL["call_ladder"] + ") WHERE rung IS NOT NULL GROUP BY ALL")
def ambiguous_sites(s, d):
    """How many calls stay ambiguous at which rung, by the number of candidates."""
    return call_ladder(s, d).filter("rung is not null").groupBy("rung", "candidates").agg(F.count("*").alias("calls"))

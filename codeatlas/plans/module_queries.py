"""Queries over modules and classes: parts stand for both. Edges of some classes are exports and imports; a class's
parents have a half and a third of its number, and it declares methods by its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import modules as M
from codeatlas.plans.flow_queries import CALLS
from codeatlas.plans.graph_queries import N, maker
from codeatlas.sources.tables import calls, nodes, table

QUERIES, ORACLE_SQL, query = maker()

_EXPORTS = f"""{N}, {CALLS}, ex AS (SELECT id AS module, 'own' AS kind, 'n' || (id % 5) AS name, NULL::BIGINT AS source, 0::BIGINT AS position FROM node WHERE id % 3 = 0
    UNION ALL SELECT src, 'named', 'n' || (o % 5), dst, o FROM raw WHERE conf IN ('re_export', 'import') UNION ALL SELECT src, 'star', NULL, dst, o FROM raw WHERE conf IN ('type_name', 'same_file')),
  shown(module, name) AS (SELECT DISTINCT module, name FROM ex WHERE kind <> 'star' UNION SELECT s.module, h.name FROM shown h JOIN ex s ON s.kind = 'star' AND s.source = h.module),
  own AS (SELECT DISTINCT module, name FROM ex WHERE kind = 'own'),
  via AS (SELECT module, name, 0 AS k, position, source FROM ex WHERE kind = 'named' UNION ALL SELECT s.module, h.name, 1, s.position, s.source FROM ex s JOIN shown h ON s.kind = 'star' AND s.source = h.module),
  nxt AS MATERIALIZED (SELECT module, name, arg_min(source, (k, position, source)) AS source FROM via WHERE (module, name) NOT IN (SELECT module, name FROM own) GROUP BY module, name),
  asked AS (SELECT DISTINCT src AS file, dst AS module, 'n' || (o % 5) AS name FROM raw WHERE conf IN ('import', 're_export', 'self_cls')),
  walk(module, name, spot, hops) AS (SELECT DISTINCT module, name, module, 0::BIGINT FROM asked UNION ALL SELECT w.module, w.name, n.source, hops + 1 FROM walk w JOIN nxt n ON w.spot = n.module AND w.name = n.name WHERE hops < 200),
  ending AS (SELECT w.module, w.name, w.spot, w.hops FROM walk w LEFT JOIN nxt n ON w.spot = n.module AND w.name = n.name WHERE n.module IS NULL)"""


@query(f"WITH RECURSIVE {_EXPORTS} SELECT file, a.module, a.name, e.spot AS definer, e.hops, e.module IS NULL AS cyclic FROM asked a LEFT JOIN ending e ON a.module = e.module AND a.name = e.name")
def import_targets(s, d):
    """What each file imports, and the module that really defines it, through re-exports by name and by star."""
    n, c = nodes(s, d), calls(s, d)
    name = F.concat(F.lit("n"), (F.col("o") % 5).cast("string"))
    none = F.lit(None)
    own = n.filter("id % 3 = 0").select(F.col("id").alias("module"), F.lit("own").alias("kind"), F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("name"), none.cast("long").alias("source"), F.lit(0).cast("long").alias("position"))
    link = lambda kind, confs, named: c.filter(F.col("conf").isin(confs)).select(F.col("src").alias("module"), F.lit(kind).alias("kind"), named.alias("name"), F.col("dst").alias("source"), F.col("o").alias("position"))
    exports = own.unionByName(link("named", ["re_export", "import"], name)).unionByName(link("star", ["type_name", "same_file"], none.cast("string")))
    asked = c.filter(F.col("conf").isin("import", "re_export", "self_cls")).select(F.col("src").alias("file"), F.col("dst").alias("module"), name.alias("name")).distinct()
    return asked.join(M.resolve_exports(exports, asked), ["module", "name"]).select("file", "module", "name", "definer", "hops", "cyclic")


_EXT = "(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs'])"
_PATH = "'src/d' || (p_partkey % 7) || '/' || CASE WHEN p_partkey % 11 = 0 THEN 'e' || (p_partkey % 13) || '/index' ELSE 'f' || p_partkey END || " + _EXT + "[(p_partkey % 3 + 1)::INT]"
_SPEC = """CASE p_partkey % 4 WHEN 0 THEN './f' || (p_partkey - 7) || '.js' WHEN 1 THEN '../d' || ((p_partkey + 1) % 7) || '/f' || (p_partkey + 1) WHEN 2 THEN '../../src/./d' || ((p_partkey - 2) % 7) || '/e' || ((p_partkey - 2) % 13) ELSE 'pkg' || p_partkey END"""


@query(f"""WITH f AS (SELECT DISTINCT {_PATH} AS path FROM part), i AS (SELECT DISTINCT {_PATH} AS file, {_SPEC} AS specifier, regexp_replace({_PATH}, '[^/]*$', '') AS folder FROM part),
  b AS (SELECT file, specifier, CASE WHEN starts_with(specifier, './') THEN folder || substr(specifier, 3) WHEN starts_with(specifier, '../../src/./') THEN regexp_replace(folder, '^src/d[0-9]+/(e[0-9]+/)?$', CASE WHEN folder LIKE '%/e%' THEN 'src/src/' ELSE 'src/' END) || substr(specifier, 13)
      WHEN starts_with(specifier, '../') THEN regexp_replace(folder, '[^/]+/$', '') || substr(specifier, 4) END AS base FROM i),
  c AS (SELECT *, regexp_replace(base, '\\.[^./]*$', '') AS bare FROM b), x AS (SELECT file, specifier, 0 AS k, base AS path FROM c UNION ALL SELECT file, specifier, k, bare || {_EXT}[k] FROM c, range(1, 7) r(k) UNION ALL SELECT file, specifier, k + 6, base || '/index' || {_EXT}[k] FROM c, range(1, 7) r(k)),
  h AS (SELECT file, specifier, arg_min(path, k) AS target FROM x JOIN f USING (path) GROUP BY 1, 2) SELECT i.file, i.specifier, target FROM (SELECT DISTINCT file, specifier FROM i) i LEFT JOIN h ON i.file = h.file AND i.specifier = h.specifier""")
def specifier_files(s, d):
    """The file that each import specifier means: as it stands, with an extension, or a folder's index."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    name = F.when(k % 11 == 0, F.concat(F.lit("e"), text(k % 13), F.lit("/index"))).otherwise(F.concat(F.lit("f"), text(k)))
    path = F.concat(F.lit("src/d"), text(k % 7), F.lit("/"), name, F.get(F.array(*[F.lit(e) for e in M.EXTENSIONS]), (k % 3).cast("int")))
    spec = F.when(k % 4 == 0, F.concat(F.lit("./f"), text(k - 7), F.lit(".js"))).when(k % 4 == 1, F.concat(F.lit("../d"), text((k + 1) % 7), F.lit("/f"), text(k + 1)))
    spec = spec.when(k % 4 == 2, F.concat(F.lit("../../src/./d"), text((k - 2) % 7), F.lit("/e"), text((k - 2) % 13))).otherwise(F.concat(F.lit("pkg"), text(k)))
    x = table(s, d, "part").select(path.alias("file"), spec.alias("specifier"))
    return M.resolve_specifiers(x, x.select(F.col("file").alias("path")))


_CLASSES = f"""{N}, {CALLS}, inh AS (SELECT id AS child, id // 2 AS parent FROM node WHERE id >= 2 UNION SELECT id, id // 3 FROM node WHERE id >= 3 AND id % 5 = 0),
  met AS (SELECT 'f' || id AS id, id AS cls, 'run' || (id % 3) AS name FROM node WHERE id % 2 = 0 UNION ALL SELECT 'g' || id, id, 'go' || (id // 6) FROM node),
  below AS MATERIALIZED (WITH RECURSIVE t(base, sub, depth) AS (SELECT parent, child, 1 FROM inh UNION SELECT base, child, depth + 1 FROM t JOIN inh ON sub = parent) SELECT base, sub, min(depth) AS depth FROM t GROUP BY ALL)"""


def _classes(s, d):
    n = nodes(s, d).select("id")
    k = F.col("id")
    parent = lambda by: F.floor(k / by).cast("long").alias("parent")
    inherits = n.filter("id >= 2").select(k.alias("child"), parent(2)).unionByName(n.filter("id >= 3 and id % 5 = 0").select(k.alias("child"), parent(3)))
    method = lambda df, mark, name: df.select(F.concat(F.lit(mark), k.cast("string")).alias("id"), k.alias("cls"), name.alias("name"))
    methods = method(n.filter("id % 2 = 0"), "f", F.concat(F.lit("run"), (k % 3).cast("string"))).unionByName(method(n, "g", F.concat(F.lit("go"), F.floor(k / 6).cast("string"))))
    return inherits, methods


@query(f"WITH {_CLASSES} SELECT base, count(*) AS n, max(depth)::INT AS deepest, sum(depth)::BIGINT AS depths FROM below GROUP BY base")
def class_descendants(s, d):
    """How many classes lie below each class, how deep at most, and how deep in all."""
    below = M.descendants(_classes(s, d)[0])
    return below.groupBy("base").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.sum("depth").alias("depths"))


@query(f"WITH {_CLASSES} SELECT a.id AS src, b.id AS dst FROM met a JOIN below ON a.cls = base JOIN met b ON b.cls = sub AND b.name = a.name")
def override_edges(s, d):
    """From each method to those that override it, however far below."""
    inherits, methods = _classes(s, d)
    return M.override_edges(M.descendants(inherits), methods)


@query(f"""WITH {_CLASSES}, vc AS (SELECT DISTINCT o || ':' || src AS call, CASE WHEN conf <> 'name_only' THEN dst END AS receiver, CASE WHEN conf = 'type_name' THEN 'run' || (o % 3) ELSE 'go' || (dst // 6) END AS name FROM raw WHERE conf IN ('type_name', 'type_inference', 'name_only')),
  line AS (SELECT sub AS cls, base AS spot, depth FROM below UNION ALL SELECT id, id, 0 FROM node), near AS (SELECT cls, name, depth, min(m.id) AS id, max(m.id) AS other FROM line JOIN (SELECT id, cls AS owner, name FROM met) m ON owner = spot GROUP BY cls, name, depth),
  own AS (SELECT cls, name, id, other FROM near n WHERE depth = (SELECT min(depth) FROM near x WHERE x.cls = n.cls AND x.name = n.name)),
  few AS (SELECT name FROM met GROUP BY name HAVING count(*) <= 8)
  SELECT call, id AS callee, 'declared-type' AS basis FROM vc JOIN own ON receiver = cls AND vc.name = own.name AND id = other
  UNION SELECT call, m.id, 'declared-type' FROM vc JOIN below ON receiver = base JOIN met m ON m.cls = sub AND m.name = vc.name UNION SELECT call, m.id, 'name-only' FROM vc JOIN few USING (name) JOIN met m USING (name) WHERE receiver IS NULL""")
def virtual_dispatch(s, d):
    """Methods that a virtual call may run: by the receiver's class, or by the name alone if few have it."""
    inherits, methods = _classes(s, d)
    name = F.when(F.col("conf") == "type_name", F.concat(F.lit("run"), (F.col("o") % 3).cast("string"))).otherwise(F.concat(F.lit("go"), F.floor(F.col("dst") / 6).cast("string")))
    made = calls(s, d).filter("conf in ('type_name', 'type_inference', 'name_only')").select(F.concat_ws(":", "o", "src").alias("call"), F.when(F.col("conf") != "name_only", F.col("dst")).alias("receiver"), name.alias("name"))
    return M.dispatch(made, inherits, methods)

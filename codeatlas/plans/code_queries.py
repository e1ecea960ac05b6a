"""Queries over code: resolution of calls, routes, ranges, federation, anchors, drift, hazards, similarity, paths of files.

The supplied tables stand in for code as in the graph queries: parts are functions, their brands files; names of
functions vary in case with the id, so that they are identifiers of every convention."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.functions import text as T
from codeatlas.operators import code as C
from codeatlas.operators import graph as G
from codeatlas.plans.graph_queries import C as CALL_SQL
from codeatlas.plans.graph_queries import FAN, E, N, fans
from codeatlas.sources.tables import edges, nodes, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_W = "split_part(p_name, ' ', {})"
_CAP = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_A, _B = _W.format(1), _W.format(2)
IDENT_SQL = f"""CASE p_partkey % 7 WHEN 0 THEN {_A} || '_' || {_B} WHEN 1 THEN {_CAP.format(_A)} || {_CAP.format(_B)} WHEN 2 THEN {_A} || {_CAP.format(_B)}
  WHEN 3 THEN upper({_A} || '_' || {_B}) WHEN 4 THEN '__' || {_A} || '_' || {_B} || '__' WHEN 5 THEN {_A} || '_' || {_CAP.format(_B)} ELSE {_A} END"""
F_SQL = f"func AS (SELECT p_partkey AS id, {IDENT_SQL} AS name, p_brand AS file, p_type AS cls FROM part)"


def functions(s, d):
    """Functions (id, name, file, cls) with names in several conventions."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))
    snake, k = F.concat(a, F.lit("_"), b), F.col("p_partkey") % 7
    name = F.when(k == 0, snake).when(k == 1, F.concat(cap(a), cap(b))).when(k == 2, F.concat(a, cap(b))).when(k == 3, F.upper(snake)).when(k == 4, F.concat(F.lit("__"), snake, F.lit("__"))).when(k == 5, F.concat(a, F.lit("_"), cap(b))).otherwise(a)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("cls"))


CALLS_SQL = f"""{E}, {F_SQL}, raw AS (SELECT e.src, e.dst, e.conf, a.file, a.cls, CASE WHEN e.conf = 'external' THEN 'ext_' || b.name ELSE b.name END AS name, b.cls AS dcls FROM edge e JOIN func a ON e.src = a.id JOIN func b ON e.dst = b.id),
  call AS (SELECT DISTINCT src || ':' || dst || ':' || conf AS call_id, file, cls, name, CASE WHEN conf = 'self_cls' THEN 'self' WHEN conf IN ('type_name', 'type_inference') THEN dcls END AS receiver, conf, dst FROM raw),
  imp AS (SELECT DISTINCT r.file, r.name, b.file AS target FROM raw r JOIN func b ON r.dst = b.id WHERE conf IN ('import', 're_export'))"""


def _calls(s, d):
    f = functions(s, d)
    a = f.select(F.col("id").alias("src"), "file", "cls")
    b = f.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), F.col("cls").alias("dcls"), F.col("file").alias("target"))
    raw = edges(s, d).join(a, "src").join(b, "dst").withColumn("name", F.when(F.col("conf") == "external", F.concat(F.lit("ext_"), "callee_name")).otherwise(F.col("callee_name")))
    receiver = F.when(F.col("conf") == "self_cls", "self").when(F.col("conf").isin("type_name", "type_inference"), F.col("dcls"))
    calls = raw.select(F.concat_ws(":", "src", "dst", "conf").alias("call_id"), "file", "cls", "name", receiver.alias("receiver")).distinct()
    return calls, f, raw.filter("conf in ('import', 're_export')").select("file", "name", "target").distinct()


@query(f"""WITH {CALLS_SQL}, u AS (SELECT name, min(id) AS sole, count(*) AS n FROM func GROUP BY name), t AS (SELECT file, name, min(target) AS target FROM imp GROUP BY 1, 2),
  x AS (SELECT c.call_id, receiver, (SELECT min(id) FROM func f WHERE f.file = c.file AND f.cls = c.cls AND f.name = c.name) AS a, (SELECT min(id) FROM func f WHERE f.cls = c.receiver AND f.name = c.name) AS b,
  (SELECT min(f.id) FROM func f JOIN t ON f.file = t.target AND f.name = t.name WHERE t.file = c.file AND t.name = c.name) AS i, (SELECT min(id) FROM func f WHERE f.file = c.file AND f.name = c.name) AS l, u.sole, u.n FROM call c LEFT JOIN u ON c.name = u.name),
  y AS (SELECT call_id, CASE WHEN receiver = 'self' THEN a END AS a, CASE WHEN receiver <> 'self' THEN b END AS b, CASE WHEN receiver IS NULL THEN i END AS i, CASE WHEN receiver IS NULL THEN l END AS l, CASE WHEN n = 1 THEN sole END AS o, n FROM x)
  SELECT call_id, coalesce(a, b, i, l, o) AS callee, CASE WHEN a IS NOT NULL THEN 'self_cls' WHEN b IS NOT NULL THEN 'type_name' WHEN i IS NOT NULL THEN 'import' WHEN l IS NOT NULL THEN 'same_file' WHEN o IS NOT NULL THEN 'name_only' WHEN n > 1 THEN 'ambiguous' ELSE 'external' END AS basis FROM y""")
def call_resolution(s, d):
    return C.resolve_calls(*_calls(s, d))


@query(f"WITH {F_SQL} SELECT name, file || '::' || name AS qualified, count(*) OVER (PARTITION BY name) AS n_simple, count(*) OVER (PARTITION BY file, name) AS n_qualified, min(id) OVER (PARTITION BY file, name) AS first_id, id FROM func")
def function_registry(s, d):
    f = functions(s, d)
    simple = f.groupBy("name").agg(F.count("*").alias("n_simple"))
    full = f.groupBy("file", "name").agg(F.count("*").alias("n_qualified"), F.min("id").alias("first_id"))
    return f.join(simple, "name").join(full, ["file", "name"]).select("name", F.concat("file", F.lit("::"), "name").alias("qualified"), "n_simple", "n_qualified", "first_id", "id")


_TOK = "regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_CH = "list_filter(regexp_split_to_array({}, '[^A-Za-z0-9]+'), lambda w: w <> '')"
TOKENS_SQL = f"list_filter(flatten(list_transform({_CH}, lambda w: CASE WHEN {_TOK} LIKE '% %' THEN list_concat([lower(w)], string_split(lower({_TOK}), ' ')) ELSE [lower(w)] END)), lambda w: length(w) > 1)"
NORMAL_SQL = f"list_filter(flatten(list_transform({_CH}, lambda w: string_split(lower({_TOK}), ' '))), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(x) for x in T.STOPWORDS)}], w))"


@query(f"WITH {F_SQL}, t AS (SELECT id, unnest({TOKENS_SQL.format(*['name'])}) AS term FROM func) SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM t GROUP BY term")
def identifier_tokens(s, d):
    return functions(s, d).select("id", F.explode(T.tokenize(F.col("name"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("id").alias("df"))


@query(f"SELECT doc_id, list_aggregate(t, 'string_agg', ' ') AS terms FROM (SELECT doc_id, {NORMAL_SQL.format('text')} AS t FROM documents) WHERE len(t) > 0")
def normalized_tokens(s, d):
    return table(s, d, "documents").select("doc_id", T.normalize_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"))


_CORE = "regexp_replace(regexp_replace(name, '^_+', ''), '_+$', '')"


@query(f"""WITH {F_SQL}, c AS (SELECT id, {_CORE} AS core FROM func) SELECT id, CASE WHEN core = '' OR NOT regexp_matches(core, '^[A-Za-z]') OR regexp_matches(core, '^[A-Z][A-Z0-9_]*$') OR (contains(core, '_') AND regexp_matches(core, '[A-Z]')) THEN NULL
  WHEN contains(core, '_') THEN 'snake_case' WHEN regexp_matches(core, '^[A-Z]') THEN 'PascalCase' WHEN regexp_matches(core, '[a-z0-9][A-Z]') THEN 'camelCase' END AS naming FROM c""")
def naming_case(s, d):
    return functions(s, d).select("id", T.naming_case(F.col("name")).alias("naming"))


@query(f"""WITH {F_SQL}, c AS (SELECT file, {_CORE} AS core FROM func), k AS (SELECT file, CASE WHEN NOT regexp_matches(core, '^[A-Za-z]') OR regexp_matches(core, '^[A-Z][A-Z0-9_]*$') OR (contains(core, '_') AND regexp_matches(core, '[A-Z]')) THEN NULL
  WHEN contains(core, '_') THEN 'snake_case' WHEN regexp_matches(core, '^[A-Z]') THEN 'PascalCase' WHEN regexp_matches(core, '[a-z0-9][A-Z]') THEN 'camelCase' END AS naming FROM c),
  n AS (SELECT file, naming, count(*) AS n FROM k WHERE naming IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, naming) AS r FROM n)
  SELECT file, CASE WHEN total >= 12 THEN naming END AS dominant, CASE WHEN total >= 12 THEN round(n / total::DOUBLE, 4) END AS ratio, total::BIGINT AS total FROM t WHERE r = 1""")
def style_rollup(s, d):
    """The dominant naming of each file: ties to the smallest, none below 12 names."""
    n = functions(s, d).select("file", T.naming_case(F.col("name")).alias("naming")).filter("naming is not null").groupBy("file", "naming").agg(F.count("*").alias("n"))
    best = n.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("k"), "naming")).alias("x"), F.sum("n").alias("total"))
    enough = lambda c: F.when(F.col("total") >= 12, c)
    return best.select("file", enough(F.col("x.naming")).alias("dominant"), enough(F.round(-F.col("x.k") / F.col("total"), 4)).alias("ratio"), "total")


@query(f"WITH {F_SQL} SELECT id, trim(regexp_replace(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS kebab FROM func")
def kebab_names(s, d):
    return functions(s, d).select("id", T.kebab_case(F.col("name")).alias("kebab"))


SPAN_SQL = "span AS (SELECT p_partkey AS id, p_brand AS file, (p_partkey * 37) % 1000 AS first, (p_partkey * 37) % 1000 + p_size * 4 AS last FROM part), site AS (SELECT DISTINCT p_brand AS file, (p_partkey * 53) % 1300 AS line FROM part)"


def _spans(s, d):
    p = table(s, d, "part")
    first = (F.col("p_partkey") * 37) % 1000
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), first.alias("first"), (first + F.col("p_size") * 4).alias("last")), p.select(F.col("p_brand").alias("file"), ((F.col("p_partkey") * 53) % 1300).alias("line")).distinct()


@query(f"WITH {SPAN_SQL} SELECT site.file, site.line, arg_min(id, (last - first, id)) AS owner FROM site LEFT JOIN span ON site.file = span.file AND line BETWEEN first AND last GROUP BY 1, 2")
def enclosing_function(s, d):
    spans, sites = _spans(s, d)
    return C.enclosing(sites, spans)


@query(f"""WITH RECURSIVE {SPAN_SQL}, {E}, owner AS (SELECT site.file, site.line, arg_min(id, (last - first, id)) AS id FROM site JOIN span ON site.file = span.file AND line BETWEEN first AND last WHERE line % 50 = 0 GROUP BY 1, 2),
  w(id, depth) AS (SELECT DISTINCT id, 0 FROM owner UNION SELECT e.src, depth + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edge) e ON w.id = e.dst WHERE depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def env_impact(s, d):
    """Functions that read a setting (every 50th line stands for a read) and their callers up to depth 3."""
    spans, sites = _spans(s, d)
    readers = C.enclosing(sites.filter("line % 50 = 0"), spans).filter("owner is not null").select(F.col("owner").alias("id")).distinct()
    return G.bfs(G.reversed_edges(edges(s, d)), readers, 3)


_PATH = "lower(CASE WHEN length({0}) > 1 THEN regexp_replace({0}, '/$', '') ELSE {0} END)"
_URL = "regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\$\\{{[^}}]+\\}}', ':param', 'g'), '^https?://[^/]+', ''), '[?#].*$', ''), '\\{{[^}}]+\\}}', ':param', 'g'), '<[^>]+>', ':param', 'g'), ':[A-Za-z0-9_]+', ':param', 'g'), '/+', '/', 'g')"
NORMAL_URL = lambda c: _PATH.format(_URL.format(c))


@query(f"SELECT page_id, {NORMAL_URL('url')} AS path FROM pages")
def normalize_url(s, d):
    return table(s, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("path"))


_ROUTE = "regexp_replace(url, '/[0-9]+', CASE page_id % 4 WHEN 0 THEN '/{id}' WHEN 1 THEN '/<int:id>' WHEN 2 THEN '/:id' ELSE '/7' END)"
_CALLED = "CASE page_id % 3 WHEN 0 THEN '/api/v1' WHEN 1 THEN '' ELSE '/v2' END || regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '/[0-9]+', CASE page_id % 5 WHEN 0 THEN '/${x}' WHEN 1 THEN '/7' ELSE '/' || (page_id % 9) END)"
_METHOD = "CASE page_id % {} WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'UNKNOWN' END"
_FILE = "'{}' || (page_id % 11)"
_CANDS = "list_distinct(list_filter([path, " + ", ".join(f"CASE WHEN starts_with(path, '{p}/') THEN substr(path, {len(p) + 1}) WHEN path = '{p}' THEN '/' END" for p in T.API_PREFIXES) + "], lambda x: x IS NOT NULL))"


@query(f"""WITH c AS (SELECT DISTINCT {_FILE.format('client')} AS caller_file, {NORMAL_URL(f'({_CALLED})')} AS path, {_METHOD.format(3)} AS cm FROM pages), r AS (SELECT DISTINCT {_FILE.format('server')} AS handler_file, {NORMAL_URL(f'({_ROUTE})')} AS path, {_METHOD.format(4)} AS rm FROM pages),
  x AS (SELECT caller_file, path AS url, cm, unnest({_CANDS}) AS cand FROM c), ok AS (SELECT x.*, r.handler_file, r.rm FROM x JOIN r ON x.cand = r.path AND (cm = 'UNKNOWN' OR rm = 'UNKNOWN' OR cm = rm)),
  direct AS (SELECT caller_file, handler_file, CASE WHEN cm <> 'UNKNOWN' AND rm <> 'UNKNOWN' THEN cm ELSE rm END AS method, cand AS path, CASE WHEN cand <> url THEN 2 WHEN cm <> 'UNKNOWN' AND rm <> 'UNKNOWN' THEN 0 ELSE 1 END AS k FROM ok),
  rest AS (SELECT *, string_split(replace(path, ':param', '*'), '/') AS a FROM c WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.caller_file = c.caller_file AND ok.url = c.path AND ok.cm = c.cm)),
  wild AS (SELECT caller_file, handler_file, CASE WHEN cm <> 'UNKNOWN' THEN cm ELSE rm END AS method, r.path, 2 AS k FROM rest JOIN (SELECT *, string_split(replace(path, ':param', '*'), '/') AS b FROM r) r ON len(a) = len(b) AND (cm = 'UNKNOWN' OR rm = 'UNKNOWN' OR cm = rm)
    WHERE len(list_filter(range(1, len(a) + 1), lambda i: NOT (a[i] = b[i] OR a[i] = '*' OR b[i] = '*'))) = 0)
  SELECT caller_file, handler_file, method, path, ['exact', 'path', 'fuzzy'][min(k) + 1] AS confidence FROM (SELECT * FROM direct UNION ALL SELECT * FROM wild) GROUP BY 1, 2, 3, 4""")
def http_edges(s, d):
    p = table(s, d, "pages")
    k = lambda n: F.col("page_id") % n
    file = lambda name: F.concat(F.lit(name), k(11).cast("string")).alias("file")
    method = lambda n: F.when(k(n) == 0, "GET").when(k(n) == 1, "POST").otherwise("UNKNOWN").alias("method")
    put = lambda text, by: F.concat(F.regexp_substr(text, F.lit("^[^0-9]*?(?=/[0-9])")), by, F.regexp_replace(text, "^[^0-9]*?/[0-9]+", ""))
    bare = F.regexp_replace("url", "^https?://[^/]+", "")
    route = F.when(k(4) == 0, "/{id}").when(k(4) == 1, "/<int:id>").when(k(4) == 2, "/:id").otherwise("/7")
    called = F.when(k(5) == 0, "/${x}").when(k(5) == 1, "/7").otherwise(F.concat(F.lit("/"), k(9).cast("string")))
    prefix = F.when(k(3) == 0, "/api/v1").when(k(3) == 1, "").otherwise("/v2")
    calls = p.select(file("client"), T.normalize_url(F.concat(prefix, put(bare, called))).alias("path"), method(3))
    routes = p.select(file("server"), T.normalize_url(put(F.col("url"), route)).alias("path"), method(4))
    return C.http_edges(calls, routes)


@query("""WITH e AS (SELECT DISTINCT event_type || (user_id % 40) AS channel, user_id AS src FROM events WHERE event_type IN ('click', 'error')), l AS (SELECT DISTINCT event_type || (user_id % 40) AS channel, event_id % 97 AS dst FROM events WHERE event_type IN ('click', 'error') AND value > 40),
  k AS (SELECT channel FROM l GROUP BY channel HAVING count(*) <= 8) SELECT DISTINCT src, dst FROM e JOIN l USING (channel) JOIN k USING (channel) WHERE src <> dst""")
def event_channel_edges(s, d):
    e = table(s, d, "events").filter("event_type in ('click', 'error')").withColumn("channel", F.concat("event_type", (F.col("user_id") % 40).cast("string")))
    return C.channel_edges(e.select("channel", F.col("user_id").alias("src")), e.filter("value > 40").select("channel", (F.col("event_id") % 97).alias("dst")))


@query(f"""WITH {F_SQL}, {E}, pub AS (SELECT DISTINCT id % 3 AS repo, name FROM func), ext AS (SELECT DISTINCT e.src % 3 AS consumer_repo, f.name, e.src AS caller FROM edge e JOIN func f ON e.dst = f.id WHERE conf IN ('external', 'name_only')),
  x AS (SELECT name, repo, consumer_repo, caller, row_number() OVER (PARTITION BY name, repo ORDER BY consumer_repo, caller) AS n FROM pub JOIN ext USING (name) WHERE repo <> consumer_repo) SELECT name, repo, consumer_repo, caller FROM x WHERE n <= 5""")
def federation_consumers(s, d):
    f = functions(s, d)
    names = f.select(F.col("id").alias("dst"), "name")
    external = edges(s, d).filter("conf in ('external', 'name_only')").join(names, "dst").select((F.col("src") % 3).alias("repo"), "name", F.col("src").alias("caller")).distinct()
    return C.federated(f.select((F.col("id") % 3).alias("repo"), "name"), external, 5)


_ANCHOR = "anchor AS (SELECT l_orderkey AS memory, l_partkey AS anchor, 'p' || l_partkey AS stable, l_partkey % 4 AS hash FROM lineitem WHERE l_linenumber = 1)"
_NOW = "now AS (SELECT CASE WHEN p_partkey % 5 < 3 THEN p_partkey ELSE -p_partkey - 1 END AS id, CASE WHEN p_partkey % 5 = 4 THEN 'q' ELSE 'p' END || p_partkey AS stable, CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE p_partkey % 4 END AS hash FROM part WHERE p_partkey % 7 <> 0)"


def _anchors(s, d):
    a = table(s, d, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("memory"), F.col("l_partkey").alias("anchor"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("stable"), (F.col("l_partkey") % 4).alias("hash"))
    k = F.col("p_partkey")
    p = table(s, d, "part").filter("p_partkey % 7 <> 0")
    now = p.select(F.when(k % 5 < 3, k).otherwise(-k - 1).alias("id"), F.concat(F.when(k % 5 == 4, "q").otherwise("p"), k.cast("string")).alias("stable"), F.when(k % 3 == 0, 9).otherwise(k % 4).alias("hash"))
    renames = p.filter("p_partkey % 10 = 4").select(F.concat(F.lit("p"), k.cast("string")).alias("stable"), F.concat(F.lit("q"), k.cast("string")).alias("renamed"))
    return a, now, renames


@query(f"""WITH {_ANCHOR}, {_NOW}, ren AS (SELECT 'p' || p_partkey AS stable, 'q' || p_partkey AS renamed FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 10 = 4)
  SELECT memory, anchor, CASE WHEN h IS NULL THEN 'orphaned' WHEN h = hash THEN 'fresh' ELSE 'drifted' END AS state FROM (SELECT a.*, coalesce(x.hash, y.hash, z.hash) AS h FROM anchor a LEFT JOIN now x ON a.anchor = x.id LEFT JOIN now y ON a.stable = y.stable LEFT JOIN ren ON a.stable = ren.stable LEFT JOIN now z ON ren.renamed = z.stable)""")
def anchor_freshness(s, d):
    return C.anchor_freshness(*_anchors(s, d))


@query("SELECT path, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM (SELECT coalesce(a.path, b.path) AS path, a.h AS o, b.h AS n FROM (SELECT p_partkey AS path, p_size AS h FROM part WHERE p_partkey % 9 <> 0) a FULL JOIN (SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 11 <> 0) b ON a.path = b.path) WHERE o IS DISTINCT FROM n")
def changed_files(s, d):
    """Files to work on again: (path, hash) that differ from what is stored; unchanged ones are skipped."""
    p = table(s, d, "part")
    old = p.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("o"))
    new = p.filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("n"))
    x = old.join(new, "path", "full_outer").filter(~F.col("o").eqNullSafe(F.col("n")))
    return x.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("modified").alias("status"))


SPEC = [("Brand#1", "billing", 1), ("Brand#2", "search", 0), ("Brand#7", "auth", 0), ("Brand#77", "legacy", 0)]
_SPEC = "spec(prefix, domain, touched) AS (VALUES " + ", ".join(str(x) for x in SPEC) + ")"


@query(f"""WITH {_SPEC}, ch AS (SELECT p_brand AS file, sum(p_size)::BIGINT AS lines, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1), own AS (SELECT c.file, c.lines, arg_max(s.domain, length(s.prefix)) AS domain, arg_max(s.touched, length(s.prefix)) AS touched FROM ch c LEFT JOIN spec s ON starts_with(c.file, s.prefix) GROUP BY 1, 2)
  SELECT file, domain, CASE WHEN domain IS NULL THEN 'uncovered' ELSE 'gap' END AS kind, CASE WHEN lines > 400 THEN 'error' WHEN lines > 60 THEN 'warning' ELSE 'info' END AS severity FROM own WHERE domain IS NULL OR touched = 0
  UNION ALL SELECT prefix, domain, 'orphaned-spec', 'error' FROM spec WHERE NOT EXISTS (SELECT 1 FROM part WHERE starts_with(p_brand, prefix)) UNION ALL SELECT prefix, domain, 'stale', 'info' FROM spec WHERE touched = 1 AND EXISTS (SELECT 1 FROM part WHERE starts_with(p_brand, prefix))""")
def spec_drift(s, d):
    """Changed files whose domain's specification didn't change (gap) or that no specification covers; specifications
    of files that are gone, and those that changed."""
    spec = F.broadcast(s.createDataFrame(SPEC, "prefix string, domain string, touched int"))  # a declared list
    part = table(s, d, "part")
    changed = part.filter("p_size > 45").groupBy(F.col("p_brand").alias("file")).agg(F.sum("p_size").alias("lines"))
    own = changed.join(spec, F.col("file").startswith(F.col("prefix")), "left").groupBy("file", "lines").agg(F.max_by(F.struct("domain", "touched"), F.length("prefix")).alias("x"))
    severity = F.when(F.col("lines") > 400, "error").when(F.col("lines") > 60, "warning").otherwise("info")
    rows = own.filter("x.domain is null or x.touched = 0").select("file", F.col("x.domain").alias("domain"), F.when(F.col("x.domain").isNull(), "uncovered").otherwise("gap").alias("kind"), severity.alias("severity"))
    files = part.select("p_brand").distinct()
    gone = spec.join(files, F.col("p_brand").startswith(F.col("prefix")), "left_anti").select(F.col("prefix").alias("file"), "domain", F.lit("orphaned-spec").alias("kind"), F.lit("error").alias("severity"))
    stale = spec.filter("touched = 1").join(files, F.col("p_brand").startswith(F.col("prefix")), "left_semi").select(F.col("prefix").alias("file"), "domain", F.lit("stale").alias("kind"), F.lit("info").alias("severity"))
    return rows.unionByName(gone).unionByName(stale)


REQUIREMENTS = ["Small Ring", "blueBolt", "hot gear handling", "red", "Widget", "cold bolt of red steel"]
_FLAT = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH {F_SQL}, req(requirement) AS (VALUES {', '.join(f"('{r}')" for r in REQUIREMENTS)}), f AS (SELECT min(id) AS id, {_FLAT.format('name')} AS nf, {_WORDS.format('name')} AS nw FROM func GROUP BY name),
  r AS (SELECT requirement, {_FLAT.format('requirement')} AS rf, {_WORDS.format('requirement')} AS rw FROM req), x AS (SELECT requirement, id, round(CASE WHEN nf = rf THEN 1.0 WHEN contains(nf, rf) OR contains(rf, nf) THEN 0.8 ELSE 0.7 * len(list_intersect(nw, rw)) / len(list_distinct(list_concat(nw, rw)))::DOUBLE END, 6)::DOUBLE AS score FROM f, r)
  SELECT requirement, id, score FROM (SELECT *, row_number() OVER (PARTITION BY requirement ORDER BY score DESC, id) AS n FROM x WHERE score >= 0.7) WHERE n <= 2""")
def requirement_mapping(s, d):
    r = s.createDataFrame([(x,) for x in REQUIREMENTS], "requirement string")
    return C.map_requirements(r, functions(s, d))


@query("SELECT id, string_agg(requirement, ',' ORDER BY requirement) AS requirements FROM (" + ORACLE_SQL["requirement_mapping"] + ") GROUP BY id")
def functions_to_requirements(s, d):
    return requirement_mapping(s, d).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("requirement")), ",").alias("requirements"))


_TASK = "l AS (SELECT l_suppkey AS task, l_partkey AS id, p_brand || p_type AS file, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT task, id, min(file) AS file, CASE WHEN min(q) <= 2 THEN 'modify' ELSE 'append' END AS mode FROM l WHERE q <= 3 GROUP BY 1, 2), r AS (SELECT DISTINCT task, id FROM l WHERE q >= 50), c AS (SELECT DISTINCT task, file FROM l WHERE q = 49)"


@query(f"""WITH {_TASK}, x AS (SELECT a.task AS a, b.task AS b, CASE WHEN a.mode = 'modify' OR b.mode = 'modify' THEN 0 ELSE 2 END AS k, a.id::VARCHAR AS v FROM w a JOIN w b ON a.id = b.id AND a.task < b.task
  UNION SELECT least(w.task, r.task), greatest(w.task, r.task), 1, w.id::VARCHAR FROM w JOIN r ON w.id = r.id AND w.task <> r.task UNION SELECT a.task, b.task, 3, a.file FROM w a JOIN w b ON a.file = b.file AND a.task < b.task
  UNION SELECT a.task, b.task, 3, a.id::VARCHAR FROM r a JOIN r b ON a.id = b.id AND a.task < b.task UNION SELECT least(w.task, c.task), greatest(w.task, c.task), 4, w.file FROM w JOIN c ON w.file = c.file AND w.task <> c.task),
  n AS (SELECT a, b, k, count(*) AS n FROM x GROUP BY 1, 2, 3) SELECT a, b, ['WAW', 'RAW', 'shared-append', 'WAR', 'soft-coupling'][min(k) + 1] AS kind, arg_min(n, k) AS n FROM n GROUP BY a, b""")
def hazards(s, d):
    """Suppliers stand for tasks: what they deliver least of they write, most of they read."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("file"))
    x = table(s, d, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("id"), F.col("l_quantity").alias("q")).join(p, "id")
    w = x.filter("q <= 3").groupBy("task", "id").agg(F.min("file").alias("file"), F.when(F.min("q") <= 2, "modify").otherwise("append").alias("mode"))
    return C.hazards(w, x.filter("q >= 50").select("task", "id").distinct(), x.filter("q = 49").select("task", "file").distinct())


_CODE = "regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+')"


@query(f"WITH t AS (SELECT doc_id AS id, {_CODE} AS w FROM documents WHERE text IS NOT NULL) SELECT min(id) AS first_id, count(*) AS copies FROM t WHERE len(w) >= 10 GROUP BY list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') THEN list_position(w, x)::VARCHAR ELSE x END) HAVING count(*) > 1")
def renamed_clones(s, d):
    """Texts that are equal once each identifier stands as the place where it first occurs."""
    long = F.regexp_count("text", F.lit("[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_]+")) >= 10
    x = table(s, d, "documents").filter("text is not null").filter(long).select(F.col("doc_id").alias("id"), T.type_two(F.col("text"), frozenset(), "[A-Za-z_][A-Za-z0-9_]*").alias("form"))
    g = x.groupBy(F.sha2("form", 256).alias("h")).agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return g.filter("copies > 1").select("first_id", "copies")


_ROLE = "CASE WHEN fan_in = 0 AND fan_out > 0 THEN 'entry_point' WHEN fan_in >= 5 THEN 'hub' WHEN fan_out >= 5 THEN 'orchestrator' WHEN fan_in <= 1 THEN 'utility' ELSE 'internal' END"
# fixed values: what a role adds to an insertion point's score
ROLE_BONUS = {"entry_point": 1.0, "orchestrator": 0.8, "hub": 0.6, "internal": 0.4, "utility": 0.3}
_BONUS = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ROLE_BONUS.items()) + " END"


@query(f"WITH {N}, {E}, {CALL_SQL}, {FAN}, r AS (SELECT id, {_ROLE} AS role, greatest(0, least(1, (cost - 3) / 40.0::DOUBLE)) AS sem FROM fan) SELECT id, role, round(0.6::DOUBLE * sem + 0.4::DOUBLE * {_BONUS}, 6) AS score FROM r ORDER BY score DESC, id LIMIT 50")
def insertion_points(s, d):
    """The 50 best places for a feature; the cost of a node stands for how near its meaning is."""
    role = F.when((F.col("fan_in") == 0) & (F.col("fan_out") > 0), "entry_point").when(F.col("fan_in") >= 5, "hub").when(F.col("fan_out") >= 5, "orchestrator").when(F.col("fan_in") <= 1, "utility").otherwise("internal")
    bonus = F.lit(None).cast("double")
    for k, v in ROLE_BONUS.items():
        bonus = F.when(F.col("role") == k, v).otherwise(bonus)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cost") - 3) / 40.0))
    x = fans(s, d).withColumn("role", role)
    return x.select("id", "role", F.round(0.6 * near + 0.4 * bonus, 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


_PATHS = "CASE page_id % 8 WHEN 0 THEN 'src/app' || page_id || '.ts' WHEN 1 THEN 'tests/test_' || page_id || '.py' WHEN 2 THEN 'main' || page_id || '.tf.json' WHEN 3 THEN 'lib/a' || page_id || '_test.go' WHEN 4 THEN 'x/__tests__/y.JS' WHEN 5 THEN 'types/' || page_id || '.d.ts' WHEN 6 THEN 'gen/generated/Model' || page_id || 'Test.java' ELSE 'README' END"


@query(f"WITH p AS (SELECT page_id, {_PATHS} AS path FROM pages) SELECT page_id, CASE WHEN regexp_matches(lower(path), '\\.(tf|tfvars|tf\\.json)$') THEN 'Terraform' WHEN lower(path) LIKE '%.bicep' THEN 'Bicep' ELSE CASE list_extract(string_split(lower(path), '.'), -1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items()) + " ELSE 'unknown' END END AS language, " + " OR ".join(f"regexp_matches(path, '{p}')" for p in T.TEST_PATHS) + " AS is_test, (path LIKE '%.d.ts' OR path LIKE '%/generated/%') AS is_generated FROM p")
def classify_files(s, d):
    k, n = F.col("page_id") % 8, F.col("page_id").cast("string")
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    path = F.when(k == 0, cat("src/app", n, ".ts")).when(k == 1, cat("tests/test_", n, ".py")).when(k == 2, cat("main", n, ".tf.json")).when(k == 3, cat("lib/a", n, "_test.go")).when(k == 4, "x/__tests__/y.JS").when(k == 5, cat("types/", n, ".d.ts")).when(k == 6, cat("gen/generated/Model", n, "Test.java")).otherwise("README")
    p = table(s, d, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", T.detect_language(F.col("path")).alias("language"), T.is_test_file(F.col("path")).alias("is_test"), T.is_generated(F.col("path")).alias("is_generated"))


OPENED = f"""{N}, {E}, surf AS (SELECT id FROM node WHERE lang LIKE 'PROMO%'), o AS (SELECT DISTINCT src, dst FROM edge WHERE conf IN ('import', 're_export', 'same_file')), n2 AS (SELECT DISTINCT src, dst FROM edge WHERE conf IN ('import', 're_export', 'type_name', 'name_only'))"""


@query(f"""WITH RECURSIVE {OPENED}, before(id) AS (SELECT id FROM surf UNION SELECT o.src FROM before b JOIN o ON b.id = o.dst), after(id) AS (SELECT id FROM surf UNION SELECT n2.src FROM after a JOIN n2 ON a.id = n2.dst)
  SELECT src, dst FROM n2 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.src = n2.src AND o.dst = n2.dst) AND dst IN (SELECT id FROM after) AND src NOT IN (SELECT id FROM before)""")
def newly_opened_paths(s, d):
    """Added edges over which a node reaches the surface that didn't before."""
    e = edges(s, d)
    surface = nodes(s, d).filter("lang like 'PROMO%'").select("id")
    old, new = e.filter("conf in ('import', 're_export', 'same_file')"), e.filter("conf in ('import', 're_export', 'type_name', 'name_only')")
    before, after = G.bfs(G.reversed_edges(old), surface).select("id"), G.bfs(G.reversed_edges(new), surface).select("id")
    pairs = lambda x: x.select("src", "dst").distinct()
    added = pairs(new).join(pairs(old), ["src", "dst"], "left_anti")
    return added.join(after.withColumnRenamed("id", "dst"), "dst", "left_semi").join(before.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")


@query(f"WITH {N}, {E}, p AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM edge e JOIN node a ON e.src = a.id JOIN node b ON e.dst = b.id WHERE a.file <> b.file), n AS (SELECT count(DISTINCT file) AS n FROM node) SELECT n AS files, (SELECT count(*) FROM p) AS edges, round((SELECT count(*) FROM p) / (n * (n - 1))::DOUBLE, 6) AS density, round((SELECT count(*) FROM p) / n::DOUBLE, 6) AS mean_degree FROM n")
def file_graph_stats(s, d):
    f = nodes(s, d)
    p = _file_pairs(s, d).agg(F.count("*").alias("edges"))
    n = f.agg(F.countDistinct("file").alias("files"))
    return n.crossJoin(p).select("files", "edges", F.round(F.col("edges") / (F.col("files") * (F.col("files") - 1)), 6).alias("density"), F.round(F.col("edges") / F.col("files"), 6).alias("mean_degree"))  # one row each


def _file_pairs(s, d):
    f = nodes(s, d)
    a, b = f.select(F.col("id").alias("src"), F.col("file").alias("a")), f.select(F.col("id").alias("dst"), F.col("file").alias("b"))
    return edges(s, d).join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


@query(f"""WITH {F_SQL}, x AS (SELECT min(id) AS id, name FROM func GROUP BY name), p AS (SELECT id // 1000 AS part, sha256(string_agg(id || ':' || name, chr(10) ORDER BY id)) AS d, count(*) AS n FROM x GROUP BY 1)
  SELECT sha256(string_agg(d, chr(10) ORDER BY part)) AS digest, sum(n)::BIGINT AS n, CASE WHEN sum(n) >= 20 THEN 'healthy' ELSE 'degraded' END AS verdict FROM p""")
def bundle_digest(s, d):
    """Digest of the distinct names: of a thousand ids at a time, and then of those digests in order."""
    x = functions(s, d).groupBy("name").agg(F.min("id").alias("id"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda r: F.concat_ws(":", r["id"].cast("string"), r["name"]))
    parts = x.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("d"), F.count("*").alias("n"))
    out = parts.agg(F.sort_array(F.collect_list(F.struct("part", "d"))).alias("all"), F.sum("n").alias("n"))
    return out.select(F.sha2(F.array_join("all.d", "\n"), 256).alias("digest"), "n", F.when(F.col("n") >= 20, "healthy").otherwise("degraded").alias("verdict"))


@query(f"WITH {N}, {E} SELECT '  ' || chr(34) || a.file || chr(34) || ' -> ' || chr(34) || b.file || chr(34) || ' [weight=' || count(*) || '];' AS line FROM edge e JOIN node a ON e.src = a.id JOIN node b ON e.dst = b.id WHERE a.file <> b.file GROUP BY a.file, b.file")
def dot_export(s, d):
    f = nodes(s, d)
    a, b = f.select(F.col("id").alias("src"), F.col("file").alias("a")), f.select(F.col("id").alias("dst"), F.col("file").alias("b"))
    n = edges(s, d).join(a, "src").join(b, "dst").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.select(F.format_string('  "%s" -> "%s" [weight=%d];', "a", "b", "n").alias("line"))


_SIG = "sig AS (SELECT p_partkey AS id, string_split(CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'int|string' WHEN 2 THEN 'string' ELSE 'int|null' END, '|') AS o, string_split(CASE p_size % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'string|int' WHEN 2 THEN 'string' WHEN 3 THEN 'int|null|string' ELSE 'null' END, '|') AS n FROM part)"


@query(f"WITH {_SIG}, r AS (SELECT id, len(list_filter(o, lambda x: NOT list_contains(n, x))) AS gone, len(list_filter(n, lambda x: NOT list_contains(o, x))) AS came FROM sig) SELECT id, CASE WHEN gone = 0 AND came = 0 THEN 'same' WHEN gone = 0 THEN 'widened' WHEN came = 0 THEN 'narrowed' ELSE 'incomparable' END AS relation, CASE WHEN gone = 0 AND came = 0 THEN 'none' WHEN gone = 0 THEN 'potentially-breaking' ELSE 'breaking' END AS class FROM r")
def signature_compare(s, d):
    """How the union type of a parameter has changed, and whether callers may break."""
    k, m = F.col("p_size") % 4, F.col("p_size") % 5
    old = F.split(F.when(k == 0, "int").when(k == 1, "int|string").when(k == 2, "string").otherwise("int|null"), r"\|")
    new = F.split(F.when(m == 0, "int").when(m == 1, "string|int").when(m == 2, "string").when(m == 3, "int|null|string").otherwise("null"), r"\|")
    x = table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.size(F.array_except(old, new)) > 0).alias("gone"), (F.size(F.array_except(new, old)) > 0).alias("came"))
    relation = F.when(~F.col("gone") & ~F.col("came"), "same").when(~F.col("gone"), "widened").when(~F.col("came"), "narrowed").otherwise("incomparable")
    level = F.when(~F.col("gone") & ~F.col("came"), "none").when(~F.col("gone"), "potentially-breaking").otherwise("breaking")
    return x.select("id", relation.alias("relation"), level.alias("class"))


@query(f"""WITH {CALLS_SQL}, n AS (SELECT min(id) AS id, name, file FROM func GROUP BY name, file), e AS (SELECT name, file, row_number() OVER (PARTITION BY name ORDER BY file) AS r, count(*) OVER (PARTITION BY name) AS n FROM n)
  SELECT name, max(n) AS files, string_agg(file, ',' ORDER BY file) FILTER (r > 1) AS others, min(file) AS kept FROM e GROUP BY name HAVING max(n) > 1""")
def duplicate_collapse(s, d):
    """Names defined in several files: the first is kept and the others listed."""
    x = functions(s, d).select("name", "file").distinct().groupBy("name").agg(F.sort_array(F.collect_list("file")).alias("files")).filter(F.size("files") > 1)
    return x.select("name", F.size("files").cast("long").alias("files"), F.array_join(F.slice("files", 2, 1 << 20), ",").alias("others"), F.get("files", F.lit(0)).alias("kept"))



ALLOWED = [("Brand#1", "Brand#2"), ("Brand#1", "Brand#3")]
ORDERED = ["Brand#5", "Brand#4", "Brand#3"]
_RANK = "CASE " + " ".join(f"WHEN starts_with({{0}}, '{p}') THEN {i}" for i, p in enumerate(ORDERED)) + " END"


@query(f"""WITH {N}, {E}, p AS (SELECT DISTINCT e.src, e.dst, a.file AS af, b.file AS bf FROM edge e JOIN node a ON e.src = a.id JOIN node b ON e.dst = b.id WHERE conf <> 'synthesized' AND a.file <> b.file)
  SELECT 'layers' AS rule, src, dst FROM p WHERE {_RANK.format('af')} > {_RANK.format('bf')} UNION SELECT 'allowedOnly', src, dst FROM p WHERE af LIKE 'Brand#1%' AND NOT ({' OR '.join(f"bf LIKE '{b}%'" for a, b in ALLOWED)} OR bf LIKE 'Brand#1%')""")
def architecture_layers(s, d):
    """Edges from a lower layer up to a higher one, and edges of a module that may depend on listed modules only."""
    def rank(c):
        out = F.lit(None).cast("int")
        for i, p in reversed(list(enumerate(ORDERED))):
            out = F.when(F.col(c).startswith(p), i).otherwise(out)
        return out

    f = nodes(s, d)
    a, b = f.select(F.col("id").alias("src"), F.col("file").alias("af")), f.select(F.col("id").alias("dst"), F.col("file").alias("bf"))
    p = G.distinct_calls(edges(s, d)).join(a, "src").join(b, "dst").filter("af <> bf")
    may = F.col("bf").startswith("Brand#1")
    for _, target in ALLOWED:
        may = may | F.col("bf").startswith(target)
    one = p.filter(rank("af") > rank("bf")).select(F.lit("layers").alias("rule"), "src", "dst")
    return one.unionByName(p.filter(F.col("af").startswith("Brand#1") & ~may).select(F.lit("allowedOnly").alias("rule"), "src", "dst")).distinct()

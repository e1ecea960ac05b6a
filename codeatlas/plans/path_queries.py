"""Queries over paths between functions, and over files and functions that many paths go through."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeatlas.operators import graph as G
from codeatlas.operators import paths as P
from codeatlas.operators.fixpoint import numbered
from codeatlas.plans.graph_queries import _W, LAYER_SQL, REC, WITH, _cheapest_sql, _layer, _pagerank_sql, _seeds, fans, maker
from codeatlas.session import materialize
from codeatlas.sources.tables import edges, nodes

QUERIES, ORACLE_SQL, query = maker()

# fixed values: what makes a bridge file, how many sources a sampled search has, an untested hotspot's least degree, and
# how many of each kind a health map looks at
BRIDGE, SOURCES, UNTESTED_DEGREE, LIMIT = 0.1, 300, 10, 10


def _back_sql(rounds):
    """Paths back from the targets, a step a round."""
    steps = ["t0 AS (SELECT p.id, x, x[3] AS before, [p.id] AS path FROM p12 p JOIN target t ON p.id = t.id WHERE p.id NOT IN (SELECT id FROM seed))"]
    for i in range(rounds):
        steps.append(f"t{i + 1} AS (SELECT t.id, t.x, coalesce(p.x[3], -1) AS before, CASE WHEN before >= 0 THEN list_prepend(before, path) ELSE path END AS path FROM t{i} t LEFT JOIN p12 p ON t.before = p.id)")
    return ", ".join(steps)


@query(f"""{_cheapest_sql(12)}, target AS (SELECT id FROM fan WHERE fan_out = 0 AND fan_in > 0), {_back_sql(12)}
  SELECT row_number() OVER (ORDER BY x[1], x[2], path, id) AS rank, id, x[1]::INT AS distance, x[2]::INT AS hops, array_to_string(path, '>') AS path, count(*) OVER () AS reached FROM t12 QUALIFY rank <= 4""")
def find_path(s, d):
    """The cheapest path from an entry point to a called leaf, and the next three, to others."""
    sinks = fans(s, d).filter("fan_out = 0 and fan_in > 0").select("id")
    return P.cheapest_paths(edges(s, d), _seeds(s, d), sinks).withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


_ENDS = "a AS (SELECT id FROM fan WHERE fan_in = 0 ORDER BY fan_out DESC, id LIMIT 10), z AS (SELECT id FROM fan ORDER BY fan_in DESC, id LIMIT 5), pair AS (SELECT DISTINCT src, dst FROM edge)"


@query(f"""{REC}, {_ENDS}, walk(path, last, hops) AS (SELECT [id], id, 0 FROM a UNION ALL SELECT list_append(path, dst), dst, hops + 1 FROM walk JOIN pair ON last = src
    WHERE hops < 6 AND NOT list_contains(path, dst) AND (hops = 0 OR last NOT IN (SELECT id FROM z))),
  hit AS (SELECT path, hops FROM walk WHERE hops > 0 AND last IN (SELECT id FROM z)) SELECT array_to_string(path, '>') AS path, hops, (SELECT count(*) FROM hit) AS found FROM hit ORDER BY hops, hit.path LIMIT 50""")
def trace_paths(s, d):
    """Paths without a node twice, of up to six calls, from the widest entry points to the most called functions: the
    first fifty, and how many there are."""
    f = fans(s, d)
    sources, targets = f.filter("fan_in = 0").orderBy(F.desc("fan_out"), "id").limit(10).select("id"), f.orderBy(F.desc("fan_in"), "id").limit(5).select("id")
    return P.best_simple_paths(edges(s, d), sources, targets).withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


_AROUND = "{0}(id, depth) AS (SELECT id, 0 FROM z UNION SELECT {1}, depth + 1 FROM {0} JOIN pair ON id = {2} WHERE depth < 3)"


@query(f"{REC}, {_ENDS}, {_AROUND.format('down', 'dst', 'src')}, {_AROUND.format('up', 'src', 'dst')} SELECT id, min(depth) AS depth, 'downstream' AS direction FROM down GROUP BY id UNION ALL SELECT id, min(depth), 'upstream' FROM up GROUP BY id")
def subgraph(s, d):
    """What lies within three calls of the most called functions, either way."""
    return P.subgraph(edges(s, d), fans(s, d).orderBy(F.desc("fan_in"), "id").limit(5).select("id"), 3, "both")


# breadth-first distances, then the numbers of shortest paths level by level, then the dependencies backwards
_BRANDES = """walk(source, id, depth) AS (SELECT id, id, 0 FROM start UNION SELECT source, dst, depth + 1 FROM walk JOIN way ON id = src WHERE depth < {0}),
  far AS MATERIALIZED (SELECT source, id, min(depth) AS d FROM walk GROUP BY source, id), deepest AS (SELECT max(d) AS d FROM far),
  step AS MATERIALIZED (SELECT a.source, a.id AS v, b.id AS w, a.d, n FROM far a JOIN way ON a.id = src JOIN far b ON b.source = a.source AND b.id = dst AND b.d = a.d + 1),
  sig(source, id, d, sigma) AS (SELECT source, id, 0, 1.0::DOUBLE FROM far WHERE d = 0 UNION ALL SELECT s.source, w, s.d + 1, sum(sigma * n) FROM sig s JOIN step ON step.source = s.source AND v = s.id GROUP BY s.source, w, s.d + 1),
  sigma AS MATERIALIZED (SELECT * FROM sig),
  dep(source, id, d, sigma, delta) AS (SELECT g.source, g.id, g.d, sigma, 0.0::DOUBLE FROM sigma g, deepest WHERE g.d = deepest.d
    UNION ALL SELECT g.source, g.id, g.d, any_value(g.sigma), coalesce(sum(g.sigma * n / x.sigma * (1 + x.delta)), 0) FROM (SELECT max(d) AS d FROM dep) now JOIN sigma g ON g.d = now.d - 1 LEFT JOIN step ON step.source = g.source AND v = g.id LEFT JOIN dep x ON x.source = step.source AND x.id = w GROUP BY g.source, g.id, g.d),
  score AS MATERIALIZED (SELECT id, sum(delta) AS score FROM dep WHERE d > 0 GROUP BY id)"""
_FILES = "ff AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM call JOIN node a ON src = a.id JOIN node b ON dst = b.id WHERE a.file <> b.file AND (a.cost + b.cost) % 17 = 0 AND a.cost < 12), files AS (SELECT DISTINCT file AS id FROM node)"
_FILE_BETWEEN = f"{REC}, {_FILES}, start AS (SELECT id FROM files), way AS (SELECT src, dst, 1 AS n FROM ff), {_BRANDES.format(40)}, between_ AS (SELECT f.id, coalesce(score, 0) / greatest(1, (SELECT max(score) FROM score)) AS betweenness FROM files f LEFT JOIN score USING (id))"


def _file_graph(s, d):
    """Files (id) and the calls between them that some sizes stand for: a sparse graph of files."""
    n = nodes(s, d)
    a = n.select(F.col("id").alias("src"), F.col("file").alias("af"), F.col("cost").alias("ac"))
    b = n.select(F.col("id").alias("dst"), F.col("file").alias("bf"), F.col("cost").alias("bc"))
    x = G.distinct_calls(edges(s, d)).join(a, "src").join(b, "dst").filter("af <> bf and (ac + bc) % 17 = 0 and ac < 12")
    return n.select(F.col("file").alias("id")).distinct(), x.select(F.col("af").alias("src"), F.col("bf").alias("dst")).distinct()


def _scaled(ids, scores):
    """Scores of all ids, over the largest (or 1)."""
    most = scores.agg(F.greatest(F.lit(1.0), F.max("score")).alias("most"))
    return ids.join(scores, "id", "left").crossJoin(F.broadcast(most)).select(*ids.columns, (F.coalesce("score", F.lit(0.0)) / F.col("most")).alias("betweenness"))  # one row


@query(f"{_FILE_BETWEEN} SELECT id, round(betweenness, 6) AS betweenness FROM between_")
def betweenness(s, d):
    """How much of the shortest paths between files goes through each file."""
    files, links = _file_graph(s, d)
    return _scaled(files, P.betweenness(links, files)).select("id", F.round("betweenness", 6).alias("betweenness"))


_SAMPLE = f"""code AS (SELECT id FROM node WHERE lang NOT LIKE 'STANDARD%'), num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM code),
  start AS (SELECT id FROM num WHERE i % greatest(1, n // {SOURCES}) = 0), way AS (SELECT src, dst, count(*) AS n FROM edge WHERE conf <> 'synthesized' AND src IN (SELECT id FROM code) AND dst IN (SELECT id FROM code) GROUP BY src, dst)"""
_BRIDGES = f"{REC}, {_SAMPLE}, {_BRANDES.format(40)}, bridge AS (SELECT id, score / greatest(1, (SELECT max(score) FROM score)) AS b FROM score WHERE score > 0)"


def _bridges(s, d):
    """(id, betweenness) of functions that aren't tests, from every so many of them, over calls between them; calls of a
    pair count as often as they occur."""
    n = materialize(nodes(s, d).filter("lang not like 'STANDARD%'").select("id"), "code")
    step = max(1, n.count() // SOURCES)
    starts = numbered(n, [F.col("id")]).filter(F.col("i") % step == 0).select("id")
    links = edges(s, d).filter("conf <> 'synthesized'").select("src", "dst").join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
    found = P.betweenness(links, starts).filter("score > 0")
    return _scaled(found.select("id"), found)


@query(f"{_BRIDGES} SELECT id, fan_in, fan_out, round(b, 6) AS betweenness FROM bridge JOIN fan USING (id) ORDER BY round(b, 6) DESC, id LIMIT 50")
def bridge_functions(s, d):
    """The fifty functions that most shortest paths from a sample of 300 sources go through."""
    found = _bridges(s, d).join(fans(s, d), "id").select("id", "fan_in", "fan_out", F.round("betweenness", 6).alias("betweenness"))
    return found.orderBy(F.desc("betweenness"), "id").limit(50)


_DEG = "deg AS (SELECT f.id, (SELECT count(*) FROM ff WHERE dst = f.id) AS ind, (SELECT count(*) FROM ff WHERE src = f.id) AS outd FROM files f)"


def _file_rank_sql():
    own = _pagerank_sql(30).removeprefix(WITH).replace("FROM node", "FROM files").replace(_W, "w AS (SELECT src, dst, outd AS deg FROM ff JOIN deg ON src = id)")
    own = f"{_FILE_BETWEEN}, {_DEG}{own}"
    head, tail = own.rsplit(" SELECT id, round(rank", 1)
    return f"{head}, pr AS (SELECT id, round(rank{tail})"


@query(f"""{_file_rank_sql()}, m AS (SELECT id, rank, ind, outd, round(betweenness, 6) AS b, substr(id, 1, 7) AS cluster FROM pr JOIN deg USING (id) JOIN between_ USING (id))
  SELECT id, rank, ind + outd AS connectivity, b AS betweenness, row_number() OVER (ORDER BY rank DESC, id) AS importance, row_number() OVER (ORDER BY ind + outd DESC, id) AS connected, id = first_value(id) OVER (PARTITION BY cluster ORDER BY ind DESC, id) AS center,
  outd > 0 AND ind = 0 AS leaf, b > 0.1 AS bridge, ind + outd = 0 AS orphan FROM m""")
def file_rankings(s, d):
    """Each file's place by rank and by degree, and whether it is its cluster's center (the most called; a brand's first
    digit stands for a directory), a leaf, a bridge or an orphan."""
    from pyspark.sql import Window

    files, links = _file_graph(s, d)
    files, links = materialize(files, "files"), materialize(links, "links")
    into, out = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ind")), links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outd"))
    x = files.join(into, "id", "left").join(out, "id", "left").na.fill(0, ["ind", "outd"])
    x = x.join(G.pagerank(files, links).select("id", F.round("rank", 6).alias("rank")), "id").join(_scaled(files, P.betweenness(links, files)).withColumn("betweenness", F.round("betweenness", 6)), "id")
    degree = F.col("ind") + F.col("outd")
    x = materialize(x.select("*", degree.alias("connectivity"), F.substring("id", 1, 7).alias("cluster")), "measured")
    centers = x.groupBy("cluster").agg(F.min_by("id", F.struct(-F.col("ind"), "id")).alias("head"))
    place = lambda c, name: numbered(x.select("id", c), [F.desc(c), F.col("id")], name).select("id", (F.col(name) + 1).alias(name))
    x = x.join(centers, "cluster").join(place("rank", "importance"), "id").join(place("connectivity", "connected"), "id")
    return x.select("id", "rank", "connectivity", "betweenness", "importance", "connected", (F.col("id") == F.col("head")).alias("center"), ((F.col("outd") > 0) & (F.col("ind") == 0)).alias("leaf"), (F.col("betweenness") > BRIDGE).alias("bridge"), (degree == 0).alias("orphan"))


_TESTED = "direct AS (SELECT DISTINCT dst AS id FROM call JOIN node ON src = id WHERE lang LIKE 'STANDARD%'), tested AS (SELECT id FROM direct UNION SELECT dst FROM call JOIN direct ON src = direct.id)"


@query(f"""{_BRIDGES}, {_TESTED}, lay AS (SELECT id, {LAYER_SQL} AS r FROM node), viol AS (SELECT a.file AS f1, b.file AS f2 FROM call JOIN lay x ON src = x.id JOIN lay y ON dst = y.id JOIN node a ON a.id = src JOIN node b ON b.id = dst WHERE x.r > y.r + 2),
  bad AS (SELECT f1 AS file FROM viol UNION SELECT f2 FROM viol), f AS (SELECT *, fan_in + fan_out AS degree FROM fan WHERE lang NOT LIKE 'STANDARD%'),
  bt AS (SELECT id FROM bridge JOIN f USING (id) ORDER BY round(b, 6) DESC, id LIMIT {LIMIT}), ut AS (SELECT id FROM f WHERE id NOT IN (SELECT id FROM tested) AND degree >= {UNTESTED_DEGREE} ORDER BY degree DESC, id LIMIT {LIMIT}),
  c AS ((SELECT id FROM f WHERE fan_in >= 5 ORDER BY fan_in DESC, id LIMIT {LIMIT}) UNION (SELECT id FROM f WHERE fan_out >= 8 ORDER BY fan_out DESC, id LIMIT {LIMIT}) UNION SELECT id FROM bt UNION SELECT id FROM ut),
  why AS (SELECT id, concat_ws(',', CASE WHEN fan_in >= 5 THEN 'hub' END, CASE WHEN fan_out >= 8 THEN 'god' END, CASE WHEN file IN (SELECT file FROM bad) THEN 'layer' END, CASE WHEN id IN (SELECT id FROM bt) THEN 'bridge' END, CASE WHEN id IN (SELECT id FROM ut) THEN 'untested' END) AS reasons FROM f JOIN c USING (id))
  SELECT id, reasons, CASE WHEN len(string_split(reasons, ',')) >= 3 THEN 'critical' WHEN len(string_split(reasons, ',')) = 2 THEN 'high' ELSE 'medium' END AS severity FROM why""")
def health_map(s, d):
    """The functions most at risk, tests left out: the ten first hubs, god functions, bridges and untested hotspots (of a
    high degree, called by no test nor by what a test calls), all that holds of each (also whether its file breaks the
    layers), and how severe that many reasons are."""
    n, f = nodes(s, d), materialize(fans(s, d).filter("lang not like 'STANDARD%'").withColumn("degree", F.col("fan_in") + F.col("fan_out")), "functions")
    calls = materialize(G.distinct_calls(edges(s, d)), "calls")
    direct = calls.join(n.filter("lang like 'STANDARD%'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    tested = direct.unionByName(calls.join(direct, F.col("src") == F.col("id")).select(F.col("dst").alias("id"))).distinct()
    side = lambda c, r, file: n.select(F.col("id").alias(c), _layer(F.col("file")).alias(r), F.col("file").alias(file))
    broken = calls.join(side("src", "a", "f1"), "src").join(side("dst", "b", "f2"), "dst").filter("a > b + 2")
    bad = broken.select(F.explode(F.array("f1", "f2")).alias("file")).distinct()
    first = lambda x, by: x.orderBy(F.desc(by), "id").limit(LIMIT).select("id")
    bridges = materialize(first(_bridges(s, d).join(f.select("id"), "id", "left_semi").withColumn("b", F.round("betweenness", 6)), "b"), "bridges")
    untested = materialize(first(f.join(tested, "id", "left_anti").filter(F.col("degree") >= UNTESTED_DEGREE), "degree"), "untested")
    looked = first(f.filter(F.col("fan_in") >= G.HUB_FAN_IN), "fan_in").unionByName(first(f.filter(F.col("fan_out") >= G.GOD_FAN_OUT), "fan_out")).unionByName(bridges).unionByName(untested).distinct()
    mark = lambda x, name: F.broadcast(x.withColumn(name, F.lit(True)))  # noqa: E731  of ten rows
    x = f.join(F.broadcast(looked), "id").join(mark(bridges, "bridge"), "id", "left").join(mark(untested, "hot"), "id", "left").join(bad.withColumn("bad", F.lit(True)), "file", "left")
    given = [("hub", F.col("fan_in") >= G.HUB_FAN_IN), ("god", F.col("fan_out") >= G.GOD_FAN_OUT), ("layer", F.col("bad")), ("bridge", F.col("bridge")), ("untested", F.col("hot"))]
    why = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in given]))
    severity = F.when(F.size("why") >= 3, "critical").when(F.size("why") == 2, "high").otherwise("medium")
    return x.select("id", why.alias("why")).select("id", F.array_join("why", ",").alias("reasons"), severity.alias("severity"))

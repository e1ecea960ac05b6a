"""Queries over texts and vectors: retrieval, similarity, measures of code, extraction from pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.functions import text as T
from codeatlas.plans.code_queries import TOKENS_SQL
from codeatlas.sources.tables import nodes, table

QUERIES, ORACLE_SQL = {}, {}
K1, B = 1.2, 0.75


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TOKENS = TOKENS_SQL.format("text")


def bm25(docs, terms: list[str]):
    """(doc_id, score) by BM25 of the query's terms, repeats of a term counted. Lengths and document frequencies are
    of all documents; only rows of the query's terms are shuffled."""
    words = docs.select("doc_id", T.tokenize(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    total = words.agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))])
    tf = words.select("doc_id", "len", F.explode(F.filter("w", lambda x: F.array_contains(wanted, x))).alias("term")).groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    weight = F.log((total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    times = F.lit(0)
    for t in set(terms):
        times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
    score = times * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / total["mean"]))
    return tf.join(F.broadcast(df), "term").groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score"))


QUERY = ["the", "hand", "of", "the"]
BM25_SQL = f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), t AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
  q AS (SELECT unnest(['the','hand','of']) AS term, unnest([2,1,1]) AS times),
  f AS (SELECT doc_id, len(w) AS len, q.term, q.times, len(list_filter(w, lambda x: x = q.term)) AS tf FROM w, q),
  g AS (SELECT * FROM f WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM g GROUP BY term),
  bm AS (SELECT doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM g JOIN df USING (term), t GROUP BY doc_id)"""


@query(BM25_SQL + " SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def bm25_search(s, d):
    return bm25(table(s, d, "documents"), QUERY).orderBy(F.desc("score"), "doc_id").limit(50)


@query(BM25_SQL + " SELECT doc_id, score FROM (SELECT * FROM bm WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 60) JOIN documents USING (doc_id) WHERE lang = 'de' OR n_chars > 1500 ORDER BY score DESC, doc_id LIMIT 20")
def filtered_search(s, d):
    """The filter is above the limit: three times as many are taken first."""
    docs = table(s, d, "documents")
    first = bm25(docs, QUERY).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(60)
    kept = docs.select("doc_id", "lang", "n_chars").join(F.broadcast(first), "doc_id").filter("lang = 'de' or n_chars > 1500")  # 60 rows
    return kept.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query("""WITH l AS (SELECT {'doc': doc_id, 'line': i} AS doc_id, left(lines[i], 1000) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i) WHERE trim(lines[i]) <> ''), """ + BM25_SQL.removeprefix("WITH ").replace("FROM documents", "FROM l") + " SELECT doc_id.doc AS doc_id, doc_id.line AS line, score FROM bm ORDER BY score DESC, bm.doc_id LIMIT 50")
def text_line_search(s, d):
    """BM25 over lines."""
    lines = text_lines(s, d).select(F.struct("doc_id", "line").alias("doc_id"), "text")
    return bm25(lines, QUERY).orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id.doc_id", "doc_id.line", "score")


KNN_SQL = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q.e::DOUBLE[]), 6) AS score FROM embeddings, q)"


def knn(vectors, query_vector: list[float]):
    """(vec_id, score): cosine with one query vector, exactly."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    e = F.col("embedding")
    length = sum(float(x) ** 2 for x in query_vector) ** 0.5
    return vectors.select("vec_id", F.round(dot(e, q) / (F.sqrt(dot(e, e)) * length), 6).alias("score"))


def _query_vector(s, d):
    return table(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(KNN_SQL + " SELECT vec_id, score FROM k ORDER BY score DESC, vec_id LIMIT 20")
def dense_knn(s, d):
    return knn(table(s, d, "embeddings"), _query_vector(s, d)).orderBy(F.desc("score"), "vec_id").limit(20)


@query(BM25_SQL.replace("WITH w", KNN_SQL.replace("q AS", "qv AS").replace(", q)", ", qv)").replace("q.e", "qv.e") + ", w") + """,
  a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS r FROM (SELECT * FROM k ORDER BY score DESC, vec_id LIMIT 50)),
  z AS (SELECT d.doc_id AS id, coalesce(bm.score, 0) AS score FROM documents d LEFT JOIN bm ON d.doc_id = bm.doc_id), b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT * FROM z ORDER BY score DESC, id LIMIT 50)),
  fu AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(1 / (61.0::DOUBLE + a.r), 0) + coalesce(1 / (61.0::DOUBLE + b.r), 0), 6) AS score FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NOT NULL OR b.score > 0)
  SELECT fu.id, fu.score FROM fu JOIN documents d ON fu.id = d.doc_id WHERE d.lang <> 'fr' ORDER BY fu.score DESC, fu.id LIMIT 20""")
def hybrid_rrf(s, d):
    """Reciprocal rank fusion of the 50 first by vectors and by BM25; ranks count from 0. Texts without a score fill the
    second list too and so rank a vector's candidate, but are no candidates themselves. The filter comes last."""
    docs = table(s, d, "documents")
    near = knn(table(s, d, "embeddings"), _query_vector(s, d)).orderBy(F.desc("score"), "vec_id").limit(50)
    a = near.select(F.col("vec_id").alias("id"), (F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")) - 1).alias("ra"))
    scored = docs.select("doc_id").join(bm25(docs, QUERY), "doc_id", "left").na.fill(0.0, ["score"])
    first = scored.orderBy(F.desc("score"), "doc_id").limit(50)
    b = first.select(F.col("doc_id").alias("id"), F.col("score").alias("bm"), (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1).alias("rb"))
    one = lambda c: F.coalesce(1 / (61.0 + F.col(c)), F.lit(0.0))
    x = a.join(b, "id", "full_outer").filter("ra is not null or bm > 0").select("id", F.round(one("ra") + one("rb"), 6).alias("score"))
    kept = docs.select(F.col("doc_id").alias("id"), "lang").join(F.broadcast(x), "id").filter("lang <> 'fr'")  # 100 rows at most
    return kept.select("id", "score").orderBy(F.desc("score"), "id").limit(20)


_SIDE = "SELECT bm.doc_id AS id, '{0}' AS side, score FROM bm JOIN documents d ON bm.doc_id = d.doc_id WHERE d.lang {1} ORDER BY score DESC, bm.doc_id LIMIT 30"


@query(BM25_SQL + f""", code AS ({_SIDE.format('code', "= 'en'")}), spec AS ({_SIDE.format('spec', "<> 'en'")}), link AS (SELECT DISTINCT l_partkey AS code, l_suppkey AS spec FROM lineitem WHERE l_quantity > 48),
  n AS (SELECT 'code' AS side, code AS id, count(*) AS n FROM link GROUP BY code UNION ALL SELECT 'spec', spec, count(*) FROM link GROUP BY spec), u AS (SELECT * FROM code UNION ALL SELECT * FROM spec)
  SELECT u.id, CASE WHEN n > 0 THEN 'both' ELSE u.side END AS kind, round(score + CASE WHEN n > 0 THEN 0.3 + least(0.1 * (n - 1), 0.3) ELSE 0 END, 6)::DOUBLE AS score FROM u LEFT JOIN n ON u.id = n.id AND u.side = n.side ORDER BY 3 DESC, 1 LIMIT 20""")
def unified_search(s, d):
    """Hits in code (English texts) and in specifications (the others), with a boost for those that are linked."""
    docs = table(s, d, "documents")
    hits = bm25(docs, QUERY).join(docs.select("doc_id", "lang"), "doc_id")
    side = lambda name, test: hits.filter(test).orderBy(F.desc("score"), "doc_id").limit(30).select(F.col("doc_id").alias("id"), F.lit(name).alias("side"), "score")
    u = side("code", "lang = 'en'").unionByName(side("spec", "lang <> 'en'"))
    link = table(s, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("spec")).distinct()
    n = link.groupBy(F.col("code").alias("id")).agg(F.count("*").alias("n")).withColumn("side", F.lit("code")).unionByName(link.groupBy(F.col("spec").alias("id")).agg(F.count("*").alias("n")).withColumn("side", F.lit("spec")))
    boost = F.when(F.col("n") > 0, 0.3 + F.least(0.1 * (F.col("n") - 1), F.lit(0.3))).otherwise(0.0)
    x = n.join(F.broadcast(u), ["id", "side"], "right")  # 60 rows
    return x.select("id", F.when(F.col("n") > 0, "both").otherwise(F.col("side")).alias("kind"), F.round(F.col("score") + boost, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


MEMORY = ["small", "ring", "economy", "brand", "gear"]
_TERMS = "[" + ", ".join(f"'{t}'" for t in MEMORY) + "]"
_HIT = "list_sum(list_transform(" + _TERMS + ", lambda t: least(3, len(list_filter({}, lambda w: w = t)))))"
_PART = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 1)"


@query(f"""WITH m AS (SELECT p_partkey AS id, {_PART.format('p_name')} AS sym, {_PART.format('p_type')} AS tag, {_PART.format('p_brand')} AS file, {_PART.format("repeat(p_name || ' ' || p_type || ' ', p_size)")} AS body, lower(p_name || ' ' || p_type || ' ' || p_brand) AS hay FROM part),
  x AS (SELECT id, hay, 4 * {_HIT.format('sym')} + 3 * {_HIT.format('tag')} + 2 * {_HIT.format('file')} + {_HIT.format('body')} + CASE WHEN len(list_filter(sym, lambda w: NOT list_contains({_TERMS}, w))) = 0 THEN 8 ELSE 0 END AS score FROM m)
  SELECT id, CASE WHEN score > 0 THEN score ELSE round(0.1 * len(list_filter({_TERMS}, lambda t: contains(hay, t))), 6) END::DOUBLE AS score FROM x""")
def memory_rank(s, d):
    """Field-weighted scores of memories: the part's name is the anchored symbol, its type the tag, its brand the file."""
    terms = F.array(*[F.lit(t) for t in MEMORY])
    p = table(s, d, "part")
    body = F.expr("repeat(concat(p_name, ' ', p_type, ' '), p_size)")
    x = p.select(F.col("p_partkey").alias("id"), *[T.normalize_tokens(F.lower(c)).alias(n) for c, n in ((F.col("p_name"), "sym"), (F.col("p_type"), "tag"), (F.col("p_brand"), "file"), (body, "body"))], F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("hay"))
    hit = lambda c: F.aggregate(terms, F.lit(0), lambda acc, t: acc + F.least(F.lit(3), F.size(F.filter(c, lambda w: w == t))))
    named = F.when(F.size(F.array_except("sym", terms)) == 0, 8).otherwise(0)
    score = 4 * hit("sym") + 3 * hit("tag") + 2 * hit("file") + hit("body") + named
    x = x.select("id", "hay", score.alias("score"))
    rest = F.round(0.1 * F.size(F.filter(terms, lambda t: F.contains(F.col("hay"), t))), 6)
    return x.select("id", F.when(F.col("score") > 0, F.col("score").cast("double")).otherwise(rest).alias("score"))


@query("SELECT file, count(*) AS kept FROM (SELECT p_brand AS file, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE run <= 200 OR r = 1 GROUP BY file")
def token_budget(s, d):
    w = Window.partitionBy("file").orderBy("id")
    run = nodes(s, d).select("file", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(w).alias("r"))
    return run.filter("run <= 200 or r = 1").groupBy("file").agg(F.count("*").alias("kept"))


_BRANCH = "len(regexp_extract_all(text, '{}'))"


@query(f"SELECT doc_id, 1 + CASE WHEN lang = 'en' THEN {_BRANCH.format(T.BRANCHES['Python'])} ELSE {_BRANCH.format(T.BRANCHES[''])} END AS complexity FROM documents")
def cyclomatic(s, d):
    """English texts stand for Python, whose branching words they hold."""
    language = F.when(F.col("lang") == "en", "Python").otherwise("other")
    return table(s, d, "documents").select("doc_id", T.cyclomatic(F.col("text"), language).cast("long").alias("complexity"))


@query("SELECT doc_id, ceil((length(text) - m) / 4.0 + m / 2.0)::BIGINT AS tokens FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[{}()\\[\\];:,.<>=+*/&|!-]')) AS m FROM documents)")
def token_estimates(s, d):
    return table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, i AS line, left(lines[i], 1000) AS text FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i) WHERE trim(lines[i]) <> ''")
def text_lines(s, d):
    """Lines of text that aren't blank, numbered from 1 and cut at 1,000 characters."""
    x = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "t")).filter(F.trim("t") != "")
    return x.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.substring("t", 1, 1000).alias("text"))


@query("SELECT page_id, i AS number, s[i] AS script FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS s FROM pages), unnest(range(1, len(s) + 1)) AS t(i)")
def inline_scripts(s, d):
    x = table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("i", "script"))
    return x.select("page_id", (F.col("i") + 1).cast("long").alias("number"), "script")


@query("SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) AS {n}" for n, p in T.SECRETS.items()) + " FROM documents")
def secret_families(s, d):
    return table(s, d, "documents").agg(*[F.count(F.when(F.col("text").rlike(p), 1)).alias(n) for n, p in T.SECRETS.items()])


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)<script[^>]*>.*?</script>')) AS n_scripts, len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS n_links FROM pages")
def html_scripts(s, d):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(s, d, "pages").select("page_id", n(r"(?s)<script[^>]*>.*?</script>").alias("n_scripts"), n('href="[^"]*"').alias("n_links"))


@query("WITH l AS (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT target, count(*) AS n FROM l GROUP BY target")
def asset_links(s, d):
    return table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, grouping(lang) + grouping(source) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def documents_rollup(s, d):
    return table(s, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), (F.grouping("lang") + F.grouping("source")).cast("long").alias("level"))


@query("SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6)::DOUBLE AS share FROM documents GROUP BY lang, source")
def capability_pivot(s, d):
    """Languages by sources, all of them: how many, and their share of the language."""
    x = table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    total = x.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("total"))
    return x.join(total, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))

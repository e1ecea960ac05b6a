"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier over features of a text (lengths, classes of characters, repetition) gives each document a
probability. It is fitted on at most ``sample`` labelled rows, the first by a hash of their ids. Grouped sums of the
probabilities over hosts, and over paths within hosts, then give beta posteriors: a host's mean is shrunk toward the
corpus's, a path's toward its host's, each by a strength that the method of moments takes from how much such means
really vary. A document's own share is left out of the evidence about its site. The final log odds are the
document's, moved by how far its path's posterior odds are from the corpus's; sparse sites hardly move them.

Toxic documents are a second target, since most of them read well: a logistic classifier over windows of six bytes,
without the sites' evidence.

Host: ``host_col`` up to its first slash; path: the rest of it, and the columns ``path_cols``. Null keys are empty
strings, null text is empty. Labels of ids that repeat count as they are; rows with null labels or ids are left out.
With labels of one class only, or none, every document gets the smoothed share of good ones. Rows are rows of their
own, and all columns of docs stay, whatever their names, but for those named like a result, which it replaces; an empty
table gives an empty result. Texts are read whole, one at a time, so a very long one takes memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import apart, give_back, save

FEATURES = 16

#: Bytes of a block of numbers in a fit, in the driver.
BLOCK_BYTES = 4 << 20


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a text, each of about unit size."""
    raw = (text or "").encode()
    n = len(raw)
    if not n:
        return np.zeros(FEATURES)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    lower, upper, digit, other = c[97:123].sum(), c[65:91].sum(), c[48:58].sum(), c[128:].sum()
    white = c[32] + c[9:14].sum()
    marks = n - lower - upper - digit - other - white
    stops = c[44] + c[46]
    top = np.sort(c[33:])[::-1]
    different = len(set(words))
    return np.array([
        np.log1p(n) / 8, np.log1p(len(words)) / 6, lower / n, 4 * upper / n, 4 * digit / n, other / n, 4 * white / n,
        8 * (marks - stops) / n, 8 * stops / n, (n - white) / max(1, len(words)) / 8, different / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 4, 4 * top[0] / n, c[124] * 8 / n, np.log1p(len(words)) / 6 * different / max(1, len(words)),
    ])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method: intercept and weights, for raw features."""
    if len(y) == 0 or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return np.concatenate([[np.log(share / (1 - share))], np.zeros(x.shape[1] if x.ndim == 2 else FEATURES)])
    # a block of rows at a time is made into numbers of 64 bits: of the whole sample, that is far more than its packed bits
    size = max(1, BLOCK_BYTES // (8 * (x.shape[1] + 1)))
    blocks = [slice(i, i + size) for i in range(0, len(x), size)]
    mean = x.mean(axis=0, dtype=float)
    sd = np.sqrt(sum(((x[b] - mean) ** 2).sum(axis=0) for b in blocks) / len(x)) + 1e-9
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        bent, slope = np.diag(penalty), -penalty * w
        for b in blocks:
            z = np.concatenate([np.ones((len(y[b]), 1)), (x[b] - mean) / sd], axis=1)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[b] - p)
            bent += (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(bent, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = w[1:] / sd
    return np.concatenate([[w[0] - out @ mean], out])


def _labelled(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, _y) of the rows with a chosen id; of rows that share an id, the one whose text has the least hash, so that
    there are no more than were chosen, the same in each run."""
    own = docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("string").alias("text"))
    found = own.join(F.broadcast(chosen), F.col("_own") == F.col("_id"))
    return found.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("x.text", "_y")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights fitted on at most ``sample`` labelled rows."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    rows = _labelled(docs, chosen, id_col, text_col).select(vector("text").alias("x"), "_y").toPandas()  # the bound is the sample's
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, FEATURES))
    order = np.lexsort(np.concatenate([x.T, rows["_y"].to_numpy(float)[None]])) if len(rows) else []
    return fit(x[order], rows["_y"].to_numpy(float)[order]) if len(rows) else fit(x, np.zeros(0))


#: Windows of a text are told apart by hashes below GRAMS.
WINDOW, GRAMS = 6, 1 << 22
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)], np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Hashes of the windows of six bytes of a text: lower-cased (A-Z), marks and white space as spaces, one at each end."""
    b = np.concatenate([[32], _FOLD[np.frombuffer((text or "").encode(), np.uint8)], [32]]).astype(np.uint64)
    n = len(b) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = (h << np.uint64(8)) | b[j : j + n]
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)


def present(text: str | None, place: np.ndarray, n: int) -> np.ndarray:
    """Which of n chosen windows a text has. place: the number of each hash among them, or n."""
    out = np.zeros(n + 1, bool)
    out[place[grams(text)]] = True
    return out[:n]


def placed(chosen: np.ndarray) -> np.ndarray:
    place = np.full(GRAMS, len(chosen), np.int16)
    place[chosen] = np.arange(len(chosen), dtype=np.int16)
    return place


def train_toxic(docs: DataFrame, labels: DataFrame, sample: int = 20_000, n_windows: int = 512, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(windows, weights) of a logistic classifier fitted on at most ``sample`` labelled rows, over which of the
    ``n_windows`` windows that tell most about the label a text has. The driver gets no texts."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id is not null and _y is not null")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    rows = save(_labelled(docs, chosen, id_col, text_col), "labelled")  # the bound is the sample's

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, bad = np.zeros(GRAMS, np.int32), np.zeros(GRAMS, np.int32)
        for x in frames:
            for t, y in zip(x["text"], x["_y"], strict=True):
                g = np.unique(grams(t))
                n[g] += 1
                if y > 0.5:
                    bad[g] += 1
        g = np.flatnonzero(n)
        for i in range(0, len(g), 1 << 16):
            part = g[i : i + (1 << 16)]
            yield pd.DataFrame({"gram": part, "n": n[part], "bad": bad[part]})
        del n, bad
        give_back()

    of = rows.agg(F.count("*"), F.sum(F.when(F.col("_y") > 0.5, 1).otherwise(0))).first()
    total, toxic = int(of[0]), int(of[1] or 0)
    if not 0 < toxic < total:
        return np.zeros(0, np.int64), fit(np.zeros((total, 0)), np.full(total, float(toxic > 0)))
    told = rows.mapInPandas(count, "gram long, n long, bad long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    expected = F.col("n") * (toxic / total)
    # how far the toxic rows among those that have the window are from their share, in deviations
    told = told.filter("n > 4").withColumn("z", F.round(F.abs(F.col("bad") - expected) / F.sqrt(expected * (1 - toxic / total) * (1 - (F.col("n") - 1) / total) + 1), 6))
    best = np.array(sorted(r["gram"] for r in told.orderBy(F.desc("z"), "gram").limit(n_windows).collect()), np.int64)

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        place = placed(best)
        return pd.Series([np.packbits(present(t, place, len(best))).tobytes() for t in text])

    got = rows.select(vector("text").alias("x"), "_y").toPandas()  # 64 bytes a row of the sample
    got = got.sort_values(["x", "_y"])
    bits = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), -(-len(best) // 8))
    w = fit(np.unpackbits(bits, axis=1, count=len(best)), (got["_y"].to_numpy(float) > 0.5).astype(float), ridge=10.0)
    give_back()
    return best, w


def score_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with p_toxic and toxic: p_toxic of the threshold or more."""
    best, w = model
    away, names, back = apart(docs, ("p_toxic", "toxic"))

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        place = placed(best)
        z = [w[0] + float(w[1:][present(t, place, len(best))].sum()) for t in text]
        give_back()
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), dtype="float64")

    return back(away.withColumn("p_toxic", probability(F.col(names[text_col]).cast("string"))).withColumn("toxic", F.col("p_toxic") >= threshold))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(means: DataFrame, near: Column) -> Column:
    """Prior strength by the method of moments. means: n, s, ss (count, sum, sum of squares of the probabilities) and,
    as ``near``, the mean that each is drawn about. Between 1 and 10,000."""
    m = F.col("s") / F.col("n")
    within = F.greatest(F.col("ss") / F.col("n") - m * m, F.lit(0.0))
    between = F.greatest(F.sum(F.col("n") * (F.pow(m - near, F.lit(2.0)) - within / F.col("n"))) / F.sum("n"), F.lit(1e-9))
    spread = F.sum(F.col("n") * near * (1 - near)) / F.sum("n")
    return F.least(F.greatest(spread / between - 1, F.lit(1.0)), F.lit(1e4))


def score(docs: DataFrame, weights: np.ndarray, host_col: str = "source", path_cols: tuple[str, ...] = ("lang",), text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all, if not given) with p_document, p_site (the path's posterior without the
    document), p_quality and keep. With ``keep`` the classifier's evidence is written with those columns, so that each
    text is read once; all of docs is rather read again than written."""
    w = weights.tolist()

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        z = [w[0] + float(features(t) @ np.array(w[1:])) for t in text]
        give_back()
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), dtype="float64")

    wanted = docs if keep is None else docs.select(*keep)
    _, _, back = apart(wanted, ("p_document", "p_site", "p_quality", "keep"))
    own, names, _ = apart(docs)
    new = dict(zip(wanted.columns, [f"doc{i}_" for i in range(len(wanted.columns))], strict=True))
    key = F.coalesce(F.col(names[host_col]).cast("string"), F.lit(""))
    host = F.substring_index(key, "/", 1)
    path = F.concat_ws("/", F.substring(key, F.length(host) + 1, F.length(key)), *[F.coalesce(F.col(names[c]).cast("string"), F.lit("")) for c in path_cols])
    own = own.select(*[F.col(names[c]).alias(n) for c, n in new.items()], host.alias("host"), path.alias("path"), F.least(F.greatest(probability(F.col(names[text_col]).cast("string")), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("p_document"))
    own = own if keep is None else save(own, "evidence")
    p = F.col("p_document")
    # sums in units of 2**-30, so that their order doesn't matter
    unit = float(1 << 30)
    fixed = lambda c: F.sum(F.round(c * unit).cast("long")).cast("double") / unit
    paths = own.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), fixed(p).alias("s"), fixed(p * p).alias("ss"))
    paths = save(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = paths.agg(F.sum("n"), F.sum("s")).first()
    mu = min(max((total[1] or 0.0) / (total[0] or 1.0), 1e-6), 1 - 1e-6)
    alpha = float(hosts.agg(_strength(hosts, F.lit(mu))).first()[0] or 1.0)
    named = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    near = (alpha * mu + F.col("host_s")) / (alpha + F.col("host_n"))
    beta = float(named.agg(_strength(named, near)).first()[0] or 1.0)
    out = own.join(named.drop("ss"), ["host", "path"])
    host_mean = (alpha * mu + F.col("host_s") - p) / (alpha + F.col("host_n") - 1)
    site = F.least(F.greatest((beta * host_mean + F.col("s") - p) / (beta + F.col("n") - 1), F.lit(1e-6)), F.lit(1 - 1e-6))
    final = 1 / (1 + F.exp(-(_logit(p) + _logit(site) - float(np.log(mu / (1 - mu))))))
    return back(out.withColumns({"p_site": site, "p_quality": final, "keep": final >= threshold}))

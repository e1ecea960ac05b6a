"""Nearest neighbours by largest inner product: vantage-point trees, one per shard.

Vectors get one more coordinate that brings all to the same length, so the largest inner product with a query (whose
own extra coordinate is 0) is the least distance. Pivots, some points of a bounded number, cut the space: a point belongs
to the shard of its nearest pivot (a large one is dealt into several), and each shard's tree, built and written once,
splits its points about vantage points into a ball and the rest. A query searches a shard of its nearest pivot first.
What it finds there bounds its reach; it goes to another shard only if the triangle inequality leaves room for points
within ``factor`` times the reach, and within a tree it leaves out the sides beyond that likewise. Factor 1 searches
exactly; less leaves out more. How much can be left out depends on the data: much where vectors lie in clusters, little
where they fill a sphere of many dimensions evenly. Scores of what is found are computed in double precision on the vectors as
given.

Ties go to the smaller id: all points that rounding can't tell from the k + 1 nearest are kept until their scores are
computed. Equal vectors are one point with the least k + 1 of their ids (no more of them can be among k neighbours), so a
vector that is very common is one point.

Vectors that are null, zero, or hold nulls or numbers that aren't finite take no part, nor do vectors of another
dimension than a query's (they are searched among themselves; there are few dimensions). A row with a null id takes no
part. Rows that repeat an id and its vector are one candidate. Empty tables give no rows. Other columns aren't read,
whatever their names. A vector may be long, as a tree is held with its shard's vectors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import on_group, on_pair, save

#: Most pivots of a dimension; they go to all tasks.
PIVOTS = 1024


class Tree:
    """A vantage-point tree over points (vectors x, least id of each), which are brought to the length ``reach``."""

    def __init__(self, x: np.ndarray, least: np.ndarray, reach: float, leaf: int = 128):
        self.reach, self.leaf = reach, leaf
        self.order = np.arange(len(x))
        self.x, self.extra = x, np.sqrt(np.maximum(reach * reach - (x * x).sum(axis=1), 0))
        self.root = self._build(0, len(x))
        self.x, self.least = x[self.order], least[self.order]
        del self.extra

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inner = self.x[a] @ self.x[b].T + self.extra[a][:, None] * self.extra[b]
        return np.sqrt(np.maximum(2 * (self.reach * self.reach - inner), 0))

    def _build(self, lo: int, hi: int):
        own = self.order[lo:hi]
        if hi - lo <= self.leaf:
            return lo, hi
        # of a few points spread over the node, the one whose distances vary most
        some = own[:: max(1, len(own) // 64)][:64]
        vantage = some[int(self._apart(some[:8], some).std(axis=1).argmax())]
        d = self._apart(np.array([vantage]), own)[0]
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            return lo, hi
        self.order[lo:hi] = np.concatenate([own[inside], own[~inside]])
        cut = lo + int(inside.sum())
        return self.x[vantage].copy(), radius, self._build(lo, cut), self._build(cut, hi)

    def search(self, q: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) of the k best points of each query, ties to the smaller id, and how many inner products it
        took. known: a score that k points elsewhere have at least, for each query."""
        out, cost = [], 0
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            who, row, n = self._some(part, k, factor, np.full(len(part), -np.inf) if known is None else known[i : i + 256])
            score = (self.x[row] * part[who]).sum(axis=1)
            order = np.lexsort((self.least[row], -score, who))
            who, row, score = who[order], row[order], score[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            out.append((i + who[keep], row[keep], score[keep]))
            cost += n
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        return *(np.concatenate(x) for x in zip(*out, strict=True)), cost

    def _some(self, q: np.ndarray, k: int, factor: float, known: np.ndarray):
        squares = (q * q).sum(axis=1)
        size = np.sqrt(squares) + self.reach
        slack = 1e-11 * size * size  # of the rounding of an inner product, and more
        best = np.full((len(q), k), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cost = 0

        def least(who):
            return np.maximum(best[who, 0], known[who])

        def visit(node, who):
            nonlocal cost
            if not len(who):
                return
            if len(node) == 2:
                lo, hi = node
                s = q[who] @ self.x[lo:hi].T
                cost += s.size
                a, b = np.nonzero(s >= (least(who) - slack[who])[:, None])
                found.append((who[a], lo + b, s[a, b]))
                best[who] = np.sort(np.concatenate([best[who], s], axis=1), axis=1)[:, -k:]
                return
            vantage, radius, near, far = node
            cost += len(who)
            total = squares[who] + self.reach * self.reach
            gap = np.sqrt(np.maximum(total - 2 * (q[who] @ vantage), 0)) - radius
            for side, first, second in ((gap <= 0, near, far), (gap > 0, far, near)):
                mine = who[side]
                visit(first, mine)
                with np.errstate(invalid="ignore"):
                    reach = np.sqrt(np.maximum(total[side] - 2 * least(mine), 0))
                visit(second, mine[np.abs(gap[side]) <= factor * reach + 1e-7 * size[mine]])

        visit(self.root, np.arange(len(q)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), cost
        who, row, s = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = s >= least(who) - slack[who]
        return who[keep], row[keep], cost


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in vectors], float)


def _far(x: np.ndarray, pivots: np.ndarray, reach: float, query: bool) -> np.ndarray:
    """Distances from points (or queries) to the pivots."""
    inner, squares = x @ pivots.T, (x * x).sum(axis=1)
    if not query:
        extra = lambda y: np.sqrt(np.maximum(reach * reach - (y * y).sum(axis=1), 0))
        inner, squares = inner + extra(x)[:, None] * extra(pivots), np.full(len(x), reach * reach)
    return np.sqrt(np.maximum(squares[:, None] + reach * reach - 2 * inner, 0))


def _by_dimension(x: pd.DataFrame):
    dims = x["vector"].map(len)
    for dim in sorted(dims.unique()):
        yield int(dim), x[dims == dim]


def _assign(pivots: dict[int, np.ndarray], reach: dict[int, float]):
    """dim, pivot, and the distance to it of each point."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for dim, part in _by_dimension(x):
                d = _far(_matrix(part["vector"]), pivots[dim], reach[dim], False)
                near = d.argmin(axis=1)
                yield part.assign(dim=dim, pivot=near, away=d[np.arange(len(d)), near])

    return run


def _build(x: pd.DataFrame, reach: dict[int, float]) -> pd.DataFrame:
    """A shard's tree, packed, as one row."""
    x = x.iloc[np.argsort([i[0] for i in x["ids"]], kind="stable")]
    ids = [np.asarray(i, np.int64) for i in x["ids"]]
    tree = Tree(_matrix(x["vector"]), np.array([i[0] for i in ids]), reach[int(x["dim"].iat[0])])
    return pd.DataFrame({"dim": x["dim"].iloc[:1], "pivot": x["pivot"].iloc[:1], "part": x["part"].iloc[:1], "tree": [pickle.dumps((tree, [ids[i] for i in tree.order]))]})


def _route(pivots: dict[int, np.ndarray], reach: dict[int, float], parts: dict[int, np.ndarray], radius: dict[int, np.ndarray], factor: float, first: bool):
    """The shards that a query goes to: one of its nearest pivot first; then all others that may hold points near
    enough (a point is no nearer to another pivot than to its own)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for dim, part in _by_dimension(x):
                if dim not in pivots:
                    continue
                for i in range(0, len(part), 512):
                    own = part.iloc[i : i + 512]
                    q = _matrix(own["vector"])
                    d = _far(q, pivots[dim], reach[dim], True)
                    home = np.where(parts[dim] > 0, d, np.inf).argmin(axis=1)
                    mine = own["qid"].to_numpy() % parts[dim][home]
                    if first:
                        yield own[["qid", "vector"]].assign(dim=dim, pivot=home, part=mine, known=-np.inf)
                        continue
                    known = own["known"].to_numpy()
                    squares = (q * q).sum(axis=1)
                    far = np.sqrt(np.maximum(squares + reach[dim] ** 2 - 2 * known, 0))
                    bound = np.maximum(d - radius[dim], (d - d[np.arange(len(d)), home][:, None]) / 2)
                    open_ = bound <= (factor * far + 1e-7 * (np.sqrt(squares) + reach[dim]))[:, None]
                    who, pivot = np.nonzero(open_ & (parts[dim] > 0))
                    times = parts[dim][pivot]
                    who, pivot = np.repeat(who, times), np.repeat(pivot, times)
                    number = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                    other = (pivot != home[who]) | (number != mine[who])
                    who, pivot, number = who[other], pivot[other], number[other]
                    for a in range(0, len(who), 4096):
                        s = slice(a, a + 4096)
                        yield own[["qid", "vector"]].iloc[who[s]].assign(dim=dim, pivot=pivot[s], part=number[s], known=known[who[s]])

    return run


def _search(key, trees: pd.DataFrame, queries: pd.DataFrame, k: int, factor: float) -> pd.DataFrame:
    if not len(trees) or not len(queries):
        return pd.DataFrame([], columns=["qid", "ids", "score"])
    tree, ids = pickle.loads(trees["tree"].iat[0])
    who, row, score, _ = tree.search(_matrix(queries["vector"]), k, factor, queries["known"].to_numpy(float))
    return pd.DataFrame({"qid": queries["qid"].to_numpy()[who], "ids": pd.Series([ids[i] for i in row], dtype=object), "score": score})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 0.2, shard_rows: int = 8192, query_rows: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, without the query itself. queries:
    rows like those of vectors."""
    if k < 1 or not 0 < factor <= 1:
        raise ValueError("k must be at least 1 and factor in (0, 1]")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        x = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        usable = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
        return x.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(usable).distinct()

    # the least k + 1 ids of each vector, cut before the shuffle as well as after it
    number = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    points = clean(vectors).withColumn("number", number).filter(F.col("number") <= k + 1)
    points = save(points.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    asked = save(clean(queries), "asked")
    wanted = save(asked.groupBy("vector").agg(F.min("id").alias("qid")), "wanted")
    dim = F.size("vector").alias("dim")
    squares = F.aggregate("vector", F.lit(0.0), lambda a, e: a + e * e)
    sizes = points.groupBy(dim).agg(F.max(squares).alias("reach"), F.count("*").alias("n")).collect()  # one row for each dimension
    reach = {r["dim"]: float(np.sqrt(r["reach"])) * (1 + 1e-9) for r in sizes}
    # pivots: the first points by a hash, at most PIVOTS of a dimension
    count = {r["dim"]: min(PIVOTS, max(1, -(-r["n"] // shard_rows))) for r in sizes}
    pivots = {}
    for r in sizes:
        chosen = points.filter(F.size("vector") == r["dim"]).orderBy(F.xxhash64("vector"), "ids").limit(count[r["dim"]]).collect()
        pivots[r["dim"]] = _matrix([x["vector"] for x in chosen])
    placed = save(points.mapInPandas(_assign(pivots, reach), "vector array<double>, ids array<long>, dim int, pivot int, away double"), "placed")
    shards = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # at most PIVOTS rows a dimension
    parts = {d: np.zeros(c, np.int64) for d, c in count.items()}
    radius = {d: np.zeros(c) for d, c in count.items()}
    for r in shards:
        parts[r["dim"]][r["pivot"]], radius[r["dim"]][r["pivot"]] = -(-r["n"] // shard_rows), r["radius"]
    own = F.pmod(F.xxhash64("vector", F.lit(7)), F.ceil(F.col("n") / shard_rows)).cast("int").alias("part")
    light = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"))
    dealt = placed.join(light, ["dim", "pivot"]).select("dim", "pivot", own, "vector", "ids")
    shard = ["dim", "pivot", "part"]
    trees = save(dealt.groupBy(*shard).applyInPandas(on_group(_build, reach=reach), "dim int, pivot int, part int, tree binary"), "trees")
    routed = "qid long, vector array<double>, dim int, pivot int, part int, known double"

    def search(asks: DataFrame) -> DataFrame:
        """The best k + 1 points of each query in each shard that it goes to."""
        asks = save(asks, "asks")
        blocks = asks.groupBy(*shard).agg(F.ceil(F.count("*") / query_rows).alias("blocks"))
        copies = trees.join(blocks, shard).select(*shard, "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        given = asks.join(blocks, shard).withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")))
        key = [*shard, "block"]
        found = copies.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(on_pair(_search, k=k + 1, factor=factor), "qid long, ids array<long>, score double")
        return save(found, "found")

    how = (pivots, reach, parts, radius, factor)
    home = search(wanted.mapInPandas(_route(*how, True), routed))
    known = home.groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col("qid").alias("own"), F.when(F.col("n") > k, F.col("low")).otherwise(float("-inf")).alias("known"))
    reached = wanted.join(known, F.col("qid") == F.col("own"), "left").select("qid", "vector", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    found = home.unionByName(search(reached.mapInPandas(_route(*how, False), routed)))
    each = found.select("qid", "score", F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    top = each.withColumn("n", order).filter(F.col("n") <= k + 1)
    lists = top.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near"))
    named = asked.join(wanted.withColumnRenamed("vector", "same"), F.col("vector") == F.col("same")).select("id", "qid").join(lists, "qid")
    near = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("id")), 1, k)
    out = named.select(F.col("id").alias("query_id"), F.posexplode(near).alias("i", "s"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score"))

"""Vector code compression: each vector becomes one byte for each of its consecutive parts, by a codebook for each part.

Components become whole numbers floor(1024 x), so that distances, sums and means are exact and no order of additions
matters. A codebook starts as the parts of the vectors with the least ids. In each round the driver builds a kd-tree of
each codebook (their size is a parameter, whatever the input's) and broadcasts them; tasks search the trees of their
vectors by branch and bound and add up the parts of each entry; Spark adds those sums, and the driver takes their floors.
A side of a node is left out only if its box lies farther than the best entry found: one that lies just as far may hold an
entry of lower index, which wins the tie.

Vectors that are null or hold nulls or numbers that aren't finite take no part, nor do those of another length than the
commonest one (of equally common ones, the longest). A length that the parts don't divide is filled with zeros, which
change no distance. Fewer vectors than entries make shorter codebooks. Rows that repeat are vectors of their own; equal
entries are a tie. A null id is larger than any other. No vectors give no rows. Components beyond 65536 are an error, as
their squared distances would not fit. Other columns aren't read, whatever their names. A label may hold any share of the
rows: its sum is made of sums by salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import give_back, save

SCALE, LARGEST = 1024, 65536


class Node(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    own: np.ndarray | None = None  # a leaf's entries, by index
    dim: int = 0
    cut: float = 0
    left: Node | None = None
    right: Node | None = None


class KdTree:
    """The entries of a codebook, for exact nearest search with ties to the lower index."""

    def __init__(self, entries: np.ndarray, leaf: int = 8):
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray) -> Node:
        e = self.entries[own]
        low, high = e.min(axis=0), e.max(axis=0)
        dim = int((high - low).argmax()) if e.shape[1] else 0
        if len(own) <= self.leaf or not e.shape[1] or low[dim] == high[dim]:
            return Node(low, high, own)
        values = np.sort(e[:, dim])
        cut = values[(len(values) - 1) // 2]
        if cut == values[-1]:  # more than half are at the upper end
            cut = values[values < cut][-1]
        left = e[:, dim] <= cut
        return Node(low, high, None, dim, cut, self._build(own[left]), self._build(own[~left]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each point's nearest entry, and the squared distance to it."""
        most = max([1, *(int(np.abs(x).max()) for x in (points, self.entries) if x.size)])
        # doubles hold the sums exactly as long as they are below 2**53, and are faster
        kind = np.float64 if points.shape[1] * (2 * most) ** 2 < 1 << 52 else np.int64
        points, entries = points.astype(kind), self.entries.astype(kind)
        best = np.full(len(points), np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind)
        index = np.full(len(points), len(entries), np.int64)

        def visit(node: Node, who: np.ndarray) -> None:
            if not len(who):
                return
            if node.own is not None:
                away = points[who][:, None, :] - entries[node.own]
                d = (away * away).sum(axis=2)
                at = d.argmin(axis=1)
                d, e = d[np.arange(len(who)), at], node.own[at]
                better = (d < best[who]) | ((d == best[who]) & (e < index[who]))
                best[who[better]], index[who[better]] = d[better], e[better]
                return
            near = points[who, node.dim] <= node.cut
            for side, first, second in ((near, node.left, node.right), (~near, node.right, node.left)):
                mine = who[side]
                visit(first, mine)
                p = points[mine]
                away = np.maximum(np.maximum(second.low - p, p - second.high), 0)
                visit(second, mine[(away * away).sum(axis=1) <= best[mine]])

        for i in range(0, len(points), 4096):
            visit(self.root, np.arange(i, min(i + 4096, len(points))))
        return index, best.astype(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(trees) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's vectors: how many parts each entry has, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(len(t.entries), np.int64), np.zeros(t.entries.shape, np.int64)) for t in trees.value]
        for batch in batches:
            x = _matrix(batch.column("x"))
            wide = x.shape[1] // len(total)
            for p, (tree, (count, sums)) in enumerate(zip(trees.value, total, strict=True)):
                own = x[:, p * wide : (p + 1) * wide]
                index, _ = tree.nearest(own)
                order = np.argsort(index, kind="stable")
                entry, start = np.unique(index[order], return_index=True)
                count[entry] += np.diff([*start, len(index)])
                sums[entry] += np.add.reduceat(own[order], start, axis=0)
        for p, (count, sums) in enumerate(total):
            used = np.flatnonzero(count)
            if len(used):
                yield pa.record_batch({"part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)), "n": pa.array(count[used]), "sums": pa.array(list(sums[used]), pa.list_(pa.int64()))})
        give_back()

    return run


def _codes(trees) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's code and error, beside its other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            wide = x.shape[1] // len(trees.value)
            found = [tree.nearest(x[:, p * wide : (p + 1) * wide]) for p, tree in enumerate(trees.value)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            rest = {c: batch.column(c) for c in batch.schema.names if c != "x"}
            yield pa.record_batch(rest | {"code": pa.array([r.tobytes().hex() for r in index], pa.string()), "error": pa.array(sum(d for _, d in found))})
        give_back()

    return run


def kept_vectors(vectors: DataFrame, columns: dict[str, str], vector_col: str) -> DataFrame:
    """The usable vectors in whole numbers, ``x``, beside the named columns (new name to old)."""
    real = vectors.select(*[F.col(old).alias(new) for new, old in columns.items()], F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST}")).cast("long"))
    return real.filter(F.col("v").isNotNull() & fine).select(*columns, F.transform("v", whole).alias("x"))


def common_length(kept: DataFrame) -> int:
    """The commonest length of x (there are few lengths), the longest of ties; 0 without rows."""
    found = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found["d"] if found else 0


class Codes(NamedTuple):
    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' components, by part, entry and position."""
        return hashlib.sha256(",".join(str(c) for book in self.codebooks for c in book.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", salt_rows: int = 500_000) -> Codes:
    """rows: vec_id, label, code (two hex digits for each part), error, label_error (the errors of all rows of the label;
    null labels are one); and the codebooks, an array (entry, component) for each part. Without ``label_col`` all rows
    have one null label."""
    if not 0 < entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries must be from 1 to 256, parts 1 or more, rounds 0 or more")
    spark = vectors.sparkSession
    named = {"vec_id": id_col} | ({"label": label_col} if label_col else {})
    kept = save(kept_vectors(vectors, named, vector_col), "vectors")
    length = common_length(kept)
    wide = -(-length // parts)
    filled = kept.filter(F.size("x") == length).withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), wide * parts - length)))
    if not label_col:
        filled = filled.withColumn("label", F.lit(None).cast("int"))
    first = filled.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()  # of bounded number
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, wide)
    books = [start[:, p] for p in range(parts)]
    types = {f.name: f.dataType.simpleString() for f in filled.schema.fields}
    coded = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    if not first:
        return Codes(spark.createDataFrame([], coded + ", label_error long"), books)

    def broadcast():
        return spark.sparkContext.broadcast([KdTree(b) for b in books])  # parts x entries x components numbers

    for _ in range(rounds):
        trees = broadcast()
        partial = filled.select("x").mapInArrow(_sums(trees), "part int, entry int, n long, sums array<long>")
        added = partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        for r in added.collect():  # at most as many rows as the codebooks have components
            books[r["part"]][r["entry"], r["pos"]] = r["s"] // r["n"]  # the floor
        trees.destroy()
    rows = save(filled.select("vec_id", "label", "x").mapInArrow(_codes(broadcast()), coded), "codes")
    return Codes(_with_label_errors(rows, salt_rows), books)


def _with_label_errors(rows: DataFrame, salt_rows: int) -> DataFrame:
    """rows with the sum of their label's errors. Sums by label and salt are added up by label, and go back to the salts
    that a label has: a label that holds most rows is many keys, and a rare one is few."""
    salts = max(32, rows.count() // salt_rows)

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(salts)))
    by_salt = salted.groupBy("label", "_salt").agg(F.sum("error").alias("e"))
    total = by_salt.groupBy(F.col("label").alias("l")).agg(F.sum("e").alias("label_error"))
    back = by_salt.select("label", F.col("_salt").alias("k")).join(total, same(F.col("label"), F.col("l"))).select("l", "k", "label_error")
    return salted.join(back, same(F.col("label"), F.col("l")) & (F.col("_salt") == F.col("k"))).select("vec_id", "label", "code", "error", "label_error")

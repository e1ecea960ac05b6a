"""Embedding whitening: principal components by MLlib's singular value decomposition of centred rows.

Components become whole numbers x = floor(1024 c) + 100000, so that n, the sums S and each row's deviation, the sum of
(n x - S)^2, are exact. Rows (n x - S) / n go to RowMatrix.computeSVD: their right singular vectors are the components,
and a singular value s stands for the variance s^2 / n. The total variance is not the sum of those but comes from the
exact deviations. A row's whitened numbers are its projections over the roots of the variances; their covariance is
computed again from all rows and held against the identity.

All singular vectors are asked for as long as the vectors have at most ``whole`` components, since MLlib then takes
them from a full decomposition of the Gram matrix, which the driver holds (its size depends on the vectors' length, not
on their number). Variances that are below 1e-13 of the largest are rounding and give no component, so there may be fewer
than were asked for: none where all vectors are equal, and then there are no rows. The largest entry of a component is
positive; of equal variances, any basis is right.

Vectors that are null or hold nulls or numbers that aren't finite take no part, nor do those of another length than the
commonest one (of equally common ones, the longest). Rows that repeat count as often as they occur. Rows with a null id
are whitened like others. No vectors give no rows. A deviation that a long can't hold is null; the total is exact
anyhow. Components beyond 65536 are an error. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.codes import _matrix, common_length, kept_vectors
from codeatlas.llm.common import save

SHIFT = 100_000
#: Variances below this share of the largest are rounding.
LEAST = 1e-13
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(axes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Centred rows c as whitened numbers w, beside their other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _matrix(batch.column("c")) @ axes
            rest = {c: batch.column(c) for c in batch.schema.names if c != "c"}
            yield pa.record_batch(rest | {"w": pa.array(list(w), pa.list_(pa.float64()))})

    return run


def _products(middle: np.ndarray, axes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows: the sums of the whitened numbers, less ``middle``, and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((axes.shape[1] + 1, axes.shape[1]))
        for batch in batches:
            w = _matrix(batch.column("c")) @ axes - middle
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.record_batch({"i": pa.array(np.arange(total.size, dtype=np.int32)), "v": pa.array(total.ravel())})

    return run


def _mean_products(centred: DataFrame, n: int, middle: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The mean of the whitened numbers less ``middle`` (first row), and of their products (the others)."""
    k = axes.shape[1]
    rows = centred.select("c").mapInArrow(_products(middle, axes), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # (k + 1) * k numbers
    out = np.zeros((k + 1) * k)
    for r in rows:
        out[r["i"]] = r["v"]
    return out.reshape(k + 1, k) / n


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", whole: int = 1024) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained (of the total variance), identity_error."""
    if components < 1:
        raise ValueError("components must be at least 1")
    kept = kept_vectors(vectors, {"vec_id": id_col}, vector_col).select("vec_id", F.transform("x", lambda c: c + SHIFT).alias("x"))
    kept = save(kept, "vectors")
    length = common_length(kept)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    empty = vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, {RESULT}")
    if not length:
        return empty
    fit = kept.filter(F.size("x") == length)
    sums = {r["pos"]: (r["s"], r["n"]) for r in fit.select(F.posexplode("x").alias("pos", "c")).groupBy("pos").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect()}  # a row for each component
    n = sums[0][1]
    far = F.zip_with("x", F.array(*[F.lit(sums[i][0]) for i in range(length)]), lambda a, b: a * n - b)
    squares = F.aggregate("far", F.lit(Decimal(0)).cast("decimal(38,0)"), lambda a, v: (a + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    centred = fit.withColumn("far", far).select("vec_id", squares.alias("deviation"), F.transform("far", lambda v: v.cast("double") / n).alias("c"))
    centred = save(centred, "centred")
    total = int(centred.agg(F.sum("deviation")).first()[0])  # n**3 times the trace
    if not total:
        return empty
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("c")), "c")
    asked = length if length <= whole else min(components, length)
    found = RowMatrix(rows, n, length).computeSVD(asked, computeU=False, rCond=1e-12)
    variance = np.asarray(found.s.toArray()) ** 2 / n
    axes = found.V.toArray()[:, : len(variance)]
    order = np.argsort(-variance, kind="stable")[:components]
    order = order[variance[order] > LEAST * variance.max()]
    variance, axes = variance[order], axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    scaled = axes / np.sqrt(variance)
    # the mean of the whitened rows is zero but for rounding; it is taken off before they are multiplied
    middle = _mean_products(centred, n, np.zeros(len(order)), scaled)[0]
    products = _mean_products(centred, n, middle, scaled)
    error = float(np.abs(products[1:] - np.outer(products[0], products[0]) - np.eye(len(order))).max())
    shares = [float(v) * n**3 / total for v in variance]
    whitened = centred.select("vec_id", "deviation", "c").mapInArrow(_project(scaled), f"vec_id {id_type}, deviation decimal(38,0), w array<double>")
    each = whitened.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("w").alias("i", "whitened"))
    explained = F.get(F.array(*[F.lit(v) for v in shares]), F.col("i"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

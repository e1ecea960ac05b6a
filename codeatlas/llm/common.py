"""What the operators of this subpackage share: tables in the shared folder, hashing, partition exchange."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of documents holds when an operator deals documents into groups.
GROUP_BYTES = 4 << 20

_U = np.uint64
#: Odd multipliers of the polynomial hashes and of the finalizer (any odd 64-bit constants do).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a temporary one;
    on a cluster that would be another folder on each machine, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeatlas-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def save(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and no executor owns the rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeatlas-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, results: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """docs under names that clash with nothing, the new name of each column, and the way back: to the names as they
    were, with the columns ``results`` after them. Columns of docs that are named like a result, in whatever case, give
    way to it."""
    names = [f"doc{i}_" for i in range(len(docs.columns))]
    taken = {r.lower() for r in results}
    kept = [(c, n) for c, n in zip(docs.columns, names, strict=True) if c.lower() not in taken]
    new = dict(reversed(list(zip(docs.columns, names, strict=True))))
    return docs.toDF(*names), new, lambda x: x.select(*[F.col(n).alias(c) for c, n in kept], *results)


def dealt(docs: DataFrame, id_col: str, text_col: str, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """(pid, doc_id, text as bytes) and the number of groups: each document goes to one of many groups of about
    ``group_bytes`` by a hash of its own contents, so any run deals it alike. Null text is empty; a null id counts
    as larger than any other."""
    light = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"),
        F.col(id_col).isNull().alias("no_id"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"),
    )
    total = light.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    n = max(1, -(-(int(total["n"] or 0) + 64 * int(total["rows"])) // group_bytes))
    return light.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("pid"), "doc_id", "no_id", "text"), n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), in wrapping arithmetic."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(29))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=_U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            out = []
            for b in (self.base, self.inverse):
                p = np.full(size, b, dtype=_U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    """H with H[j] - H[i] = sum of (data[t] + 1) * base**t over i <= t < j."""
    up, _ = powers.to(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of data[start:end] that doesn't depend on where it stands."""
    _, down = powers.to(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(_U))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0 to n-1 from the upper half of each hash."""
    return ((hashes >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def runs(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of each run of a sorted array: the buckets that hold anything."""
    at = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    return list(zip(buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(buckets)], strict=False))


def chunks(lengths: np.ndarray, most: int):
    """Slices of consecutive documents that hold about ``most`` bytes each (one document at least)."""
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(lengths):
        yield at, len(lengths)


def give_back() -> None:
    """Hand memory that is no longer in use back to the system: Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def on_group(f, **kw):
    """f with its settings, as a function of one group."""

    def run(pdf):
        out = f(pdf, **kw)
        give_back()
        return out

    return run


def on_pair(f, **kw):
    """f with its settings, as a function of a key and two groups that share it."""

    def run(key, a, b):
        out = f(key, a, b, **kw)
        give_back()
        return out

    return run

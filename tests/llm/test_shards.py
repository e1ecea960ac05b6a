"""Sharding: the law, slots without gaps, columns of the query, and that the draw is uniform."""

import zlib

import numpy as np

from codeatlas.llm import shard
from codeatlas.llm.queries import QUERIES


def test_query(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 30)) for i in range(530)] + [(3, "again"), (None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_hypergeometric_shards"](spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(got) == len(rows)
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(sizes) == 40 and set(sizes["count"]) == {13, 14} and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all() and (sizes["min"] == 0).all()
    exp = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"].tolist(), got["text_crc32"].tolist(), strict=True)) == exp and set(got.law) == {"rows"} and got.grown_shard.isna().all()


def test_draws_are_uniform(spark):
    # two partitions of 30 rows into 3 shards: the number that goes to each has the hypergeometric mean and variance
    sizes = spark.range(400).selectExpr("array(30L, 30L) as sizes", "array(20L, 20L, 20L) as capacity", "id as level")
    from pyspark.sql import functions as F

    rows = np.array([r.rows for r in sizes.select(shard.draw_matrix(F.col("sizes"), F.col("capacity"), F.col("level"), 5).alias("rows")).collect()])
    assert (rows.sum(axis=1) == 20).all() and (rows.sum(axis=2) == 30).all()
    first = rows[:, 0, :]
    assert abs(first.mean(axis=0) - 10).max() < 0.35 and abs(first.var(axis=0) - 20 * 0.25 * 40 / 59).max() < 0.9

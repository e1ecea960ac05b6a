"""Property-graph tables, and their projection from the supplied star schema.

nodes: id, name, file, lang, cost. edges: src, dst, conf (one of the ten confidence classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: confidence classes and the cost of an edge of each (none: not traversed)
CONFIDENCE = ["import", "re_export", "same_file", "self_cls", "http_endpoint", "type_inference", "type_name", "name_only", "synthesized", "external"]
COST = {"import": 1, "re_export": 1, "same_file": 1, "self_cls": 1, "http_endpoint": 1, "type_inference": 2, "type_name": 2, "name_only": 3, "synthesized": 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("lang"), F.col("p_size").alias("cost"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of an order, from a returned large one: edges with the number of their order, ``o``."""
    line = table(spark, sf_dir, "lineitem")
    a = line.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25)).select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"))
    b = line.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    names = F.array(*[F.lit(c) for c in CONFIDENCE])
    return a.join(b, ["o", "n"]).filter("src <> dst").select("src", "dst", F.get(names, (F.col("o") % 10).cast("int")).alias("conf"), "o")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls as edges: parallel edges stay, self loops don't."""
    return calls(spark, sf_dir).drop("o")


def cost(conf: Column) -> Column:
    """The cost of an edge; null where it isn't traversed."""
    out = F.lit(None).cast("int")
    for name, value in COST.items():
        out = F.when(conf == name, value).otherwise(out)
    return out

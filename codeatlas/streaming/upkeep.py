"""Tables of files, functions, calls and resolved edges that follow a stream of file versions.

What a batch changes is replaced in the buckets of the files it touches, nothing else is rewritten. Files whose edges may
be wrong are put on the table ``stale`` before anything changes, and taken off when their edges are written, so a batch
that broke off and comes again ends like one that didn't. A budget bounds how many callers a batch resolves again; the
rest stay stale and are told apart by it. Once ``drain`` has emptied that table, the edges are those of a full rebuild,
whatever the order in which versions came."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.session import materialize

# fixed value: how many callers a batch resolves again
BUDGET = 40
SCHEMAS = {
    "files": "path string, version long, hash string, deleted boolean, bucket int", "functions": "path string, name string, bucket int",
    "calls": "path string, caller string, callee string, bucket int", "edges": "path string, caller string, callee string, target string, basis string, bucket int", "stale": "path string, bucket int",
}


def resolve(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (path, caller, callee) with target and basis: a function of the file itself, or the only file that has one of
    the name; ambiguous if several have, external if none."""
    own = functions.select("path", F.col("name").alias("callee")).distinct().withColumn("own", F.lit(True))
    known = functions.select("path", "name").distinct().groupBy(F.col("name").alias("callee")).agg(F.min("path").alias("only"), F.count("*").alias("n"))
    x = calls.select("path", "caller", "callee").distinct().join(own, ["path", "callee"], "left").join(known, "callee", "left")
    target = F.when(F.col("own"), F.col("path")).when(F.col("n") == 1, F.col("only"))
    basis = F.when(F.col("own"), "same_file").when(F.col("n") == 1, "name_only").when(F.col("n") > 1, "ambiguous").otherwise("external")
    return x.select("path", "caller", "callee", target.alias("target"), basis.alias("basis"))


class Upkeep:
    """The tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 32, budget: int | None = BUDGET):
        self.spark, self.base, self.buckets, self.budget = spark, base.rstrip("/"), buckets, budget
        for name, schema in SCHEMAS.items():
            # a row without a path keeps a bucket that nothing is left in
            spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket").parquet(f"{self.base}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.base}/{name}").filter("path is not null")

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _touched(self, paths: DataFrame) -> list[int]:
        return [r["bucket"] for r in paths.select(self._bucket().alias("bucket")).distinct().collect()]  # at most as many as there are buckets

    def _replace(self, name: str, gone: DataFrame, rows: DataFrame) -> None:
        """The rows of some paths by others, in the buckets of those paths and of the rows."""
        touched = self._touched(gone.select("path").unionByName(rows.select("path")))
        if not touched:
            return
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        kept = self.read(name).filter(F.col("bucket").isin(touched)).join(gone.select("path").distinct(), "path", "left_anti")
        new = kept.select(columns).unionByName(rows.withColumn("bucket", self._bucket()).select(columns))
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        whole = materialize(new.unionByName(marks, allowMissingColumns=True), f"new-{name}")
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.base}/{name}")

    def apply(self, versions: DataFrame, batch_id: int | None = None) -> None:
        """A batch of versions (path, version, hash, deleted, functions: names, calls: structs of caller and callee). Of a
        path, the latest version counts; one that isn't later than what is known, or has the same hash, changes nothing.
        For foreachBatch; batch_id isn't needed, as a batch that comes again finds nothing new."""
        latest = versions.groupBy("path").agg(F.max_by(F.struct(*versions.columns), "version").alias("x")).select("x.*")
        known = self.read("files").select("path", F.col("version").alias("old"), F.col("hash").alias("old_hash"), F.col("deleted").alias("was_deleted"))
        later = latest.withColumn("deleted", F.coalesce("deleted", F.lit(False))).join(known, "path", "left").filter("old is null or version > old")
        later = materialize(later, "later")
        same = F.coalesce((F.col("hash") == F.col("old_hash")) & (F.col("deleted") == F.col("was_deleted")), F.lit(False))
        changed = materialize(later.filter(~same), "changed")
        if not changed.isEmpty():
            live = changed.filter("not deleted")
            functions = live.select("path", F.explode("functions").alias("name")).distinct()
            before = self.read("functions").join(changed.select("path"), "path", "left_semi").select("path", "name")
            # a name that files come to have, or have no longer, may bind its callers otherwise
            names = functions.exceptAll(before).unionByName(before.exceptAll(functions)).select("name").distinct()
            callers = self.read("calls").join(names.withColumnRenamed("name", "callee"), "callee", "left_semi").select("path")
            self._add_stale(callers.unionByName(changed.select("path")))
            calls = live.select("path", F.explode("calls").alias("c")).select("path", "c.caller", "c.callee").distinct()
            self._replace("calls", changed, calls)
            self._replace("functions", changed, functions)
        self._refresh(changed.select("path"), self.budget)
        self._replace("files", later, later.select("path", "version", "hash", "deleted"))

    def _add_stale(self, paths: DataFrame) -> None:
        new = materialize(paths.distinct().join(self.read("stale").select("path"), "path", "left_anti"), "stale")
        self._replace("stale", new, new)

    def _refresh(self, first: DataFrame, budget: int | None) -> None:
        """Resolve stale files again: those of ``first``, and others up to the budget, in order of their paths."""
        stale = self.read("stale").select("path")
        others = stale.join(first, "path", "left_anti")
        chosen = stale.join(first, "path", "left_semi").unionByName(others if budget is None else others.orderBy("path").limit(budget))
        chosen = materialize(chosen, "chosen")
        if chosen.isEmpty():
            return
        calls = self.read("calls").join(chosen, "path", "left_semi")
        self._replace("edges", chosen, materialize(resolve(calls, self.read("functions")), "resolved"))
        self._replace("stale", chosen, chosen.limit(0))

    def drain(self) -> None:
        """Resolve all that is stale."""
        self._refresh(self.read("stale").select("path").limit(0), None)


def follow_versions(versions: DataFrame, upkeep: Upkeep) -> None:
    """Run a stream of versions over what is there, batch by batch."""
    q = versions.writeStream.foreachBatch(upkeep.apply).option("checkpointLocation", f"{upkeep.base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()

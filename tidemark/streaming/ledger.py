"""Several tables that a micro-batch changes together: partitions by key bucket and batch, and a commit that makes a batch visible.

A batch writes its rows of every table into partitions of its own (stream, batch), replacing what an earlier try left there, and its commit
last. Readers see committed batches alone, so a batch that broke off between two writes is as if it had never begun, and its replay, which the
stream's checkpoint numbers alike, makes the same rows from the same committed state. New keys are found by an anti-join with the key
buckets that the batch touches; other partitions are pruned, and of these only key columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import insert_if_new


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Ledger:
    """Tables under ``path``: name -> (schema, key columns). ``buckets`` stays as it was when a ledger was begun."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, Sequence[str]]], buckets: int = 64) -> None:
        self.spark, self.path, self.tables, self.buckets = spark, path.rstrip("/"), tables, buckets

    def committed(self) -> dict[str, int]:
        """The last committed batch of each stream."""
        if not exists(self.spark, f"{self.path}/commits"):
            return {}
        seen = self.spark.read.schema("stream string, batch long").parquet(f"{self.path}/commits")
        return {r.stream: r.batch for r in seen.groupBy("stream").agg(F.max("batch").alias("batch")).collect()}  # a row per stream

    def bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name][1]), F.lit(self.buckets)).cast("int")

    def read(self, name: str, only: Sequence[int] | None = None) -> DataFrame:
        """The committed rows of a table, of the buckets ``only`` if given."""
        schema, _ = self.tables[name]
        where = f"{self.path}/{name}"
        done = self.committed()
        if not done or not exists(self.spark, where):
            return self.spark.createDataFrame([], schema)
        seen = self.spark.read.schema(f"{schema}, bucket int, stream string, batch long").parquet(where)
        visible = F.lit(False)
        for stream, batch in done.items():
            visible |= (F.col("stream") == stream) & (F.col("batch") <= batch)
        seen = seen.filter(visible)
        return (seen if only is None else seen.filter(F.col("bucket").isin([int(x) for x in only]))).drop("bucket", "stream", "batch")

    def append(self, name: str, rows: DataFrame, stream: str, batch: int) -> DataFrame:
        """Rows written for a batch, which others see once it is committed; read back."""
        label = {"stream": F.lit(stream), "batch": F.lit(batch).cast("long")}
        where = f"{self.path}/{name}"
        rows.withColumn("bucket", self.bucket(name)).withColumns(label).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "stream", "batch").parquet(where)
        schema, _ = self.tables[name]
        if not exists(self.spark, where):
            return self.spark.createDataFrame([], schema)
        own = self.spark.read.schema(f"{schema}, bucket int, stream string, batch long").parquet(where)
        return own.filter((F.col("stream") == stream) & (F.col("batch") == batch)).drop("bucket", "stream", "batch")

    def append_new(self, name: str, rows: DataFrame, order: Sequence[str], stream: str, batch: int) -> DataFrame:
        """The rows whose key no committed batch has, one per key, the first in ``order``."""
        keys = list(self.tables[name][1])
        touched = [r.b for r in rows.select(self.bucket(name).alias("b")).distinct().collect()]  # as many as there are buckets
        return self.append(name, insert_if_new(rows, self.read(name, touched).select(*keys), keys, list(order)), stream, batch)

    def commit(self, stream: str, batch: int) -> None:
        self.spark.createDataFrame([(stream, batch)], "stream string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/of={stream}/at={batch}")

    def apply(self, stream: str, steps: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch: ``steps`` and the commit, nothing for a batch that is committed already."""

        def run(df: DataFrame, batch: int) -> None:
            if batch > self.committed().get(stream, -1):
                df.persist()
                try:
                    steps(df, batch)
                    self.commit(stream, batch)
                finally:
                    df.unpersist()

        return run


CHANGE = "change_id long, monitor_id long, site_id long, kind string, dedupe_key string, detected_at timestamp"
TABLES = {"changes": (CHANGE, ["monitor_id", "dedupe_key"]), "deliveries": ("change_id long, destination_id long", ["change_id", "destination_id"]), "watermarks": ("monitor_id long, mark timestamp", ["monitor_id"])}


def notify(changes: DataFrame, ledger: Ledger, match: Callable[[DataFrame], DataFrame], stream: str, checkpoint: str, after: Callable[[str], None] = lambda step: None):
    """Starts a stream of changes (CHANGE) into changes, deliveries and watermarks, which a batch moves together; stops when all is read.

    ``match`` gives (change_id, destination_id) of the changes that are new. Watermarks are written last and only ever add rows; a monitor's mark is
    the largest. ``after`` is told each step, for tests that break off.
    """

    def steps(df: DataFrame, batch: int) -> None:
        new = ledger.append_new("changes", df, ["detected_at", "change_id"], stream, batch)
        after("changes")
        ledger.append_new("deliveries", match(new), [], stream, batch)
        after("deliveries")
        ledger.append("watermarks", df.groupBy("monitor_id").agg(F.max("detected_at").alias("mark")), stream, batch)
        after("watermarks")

    return changes.writeStream.foreachBatch(ledger.apply(stream, steps)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

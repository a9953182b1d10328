"""Live ingest of a run tracker's metrics: a stream of rows, some late, some delivered again, into tables that a restart doesn't double.

Repeats are dropped within the watermark by run, key and step; each micro-batch is a table under its number, which a replay replaces. compact() folds the
tables up to a number into one snapshot; readers take the newest snapshot and the batches behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "run_id string, key string, value double, timestamp timestamp, step long"
COLUMNS = [c.split()[0] for c in METRICS.split(", ")]


def metrics(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The stream's metric rows, each (run, key, step) once; repeats that come later than `late` behind the newest row are dropped with their watermark."""
    typed = rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("step").cast("long").alias("step"))
    return typed.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["run_id", "key", "step"])


class Store:
    """Metric tables under one folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return lambda rows, batch: rows.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _numbers(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        names = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith(f"{kind}=") and done(s.getPath())]
        return sorted(int(p.getName().split("=")[1]) for p in names)

    def table(self) -> DataFrame:
        """All rows so far."""
        snapshots = self._numbers("snapshot")
        last = snapshots[-1] if snapshots else -1
        paths = [f"{self.path}/snapshot={last}"] * bool(snapshots) + [f"{self.path}/batch={n}" for n in self._numbers("batch") if n > last]
        return self.spark.read.schema(METRICS).parquet(*paths) if paths else self.spark.createDataFrame([], METRICS)

    def compact(self) -> None:
        """Folds all finished batches into a new snapshot; older tables may be deleted afterwards."""
        batches = self._numbers("batch")
        if batches:
            self.table().write.mode("overwrite").parquet(f"{self.path}/snapshot={batches[-1]}")

    def latest(self) -> DataFrame:
        """run_id, key, value, step, timestamp of the newest step of each run and key; ties to the later time, then the larger value."""
        newest = F.max(F.struct("step", "timestamp", "value")).alias("m")
        return self.table().groupBy("run_id", "key").agg(newest).select("run_id", "key", "m.value", "m.step", "m.timestamp")


def run(rows: DataFrame, store: Store, checkpoint: str, late: str = "1 hour"):
    """Takes what the source has now into the store; called again with the same checkpoint it goes on behind it."""
    query = metrics(rows, late).writeStream.foreachBatch(store.sink()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

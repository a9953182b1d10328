"""Tables of iterative jobs, written to the folder that driver and executors share, so that lineage stays short and a lost executor costs a reread."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a temporary folder, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="varve-"))
    return _own[0]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as shuffles have: a few large tasks, into which Spark would join them, hold more rows in their sorts."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Rounds:
    """Tables of one job, deleted with drop() or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, f"{shared_folder(spark)}/varve-{name}-{uuid.uuid4().hex}", 0
        self._path("").getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(self._path(""))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def put(self, df: DataFrame) -> DataFrame:
        name = str(self.made)
        self.made += 1
        with self._tidy():
            df.write.parquet(f"{self.folder}/{name}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        out._varve_round = name
        return out

    @contextmanager
    def _tidy(self) -> Iterator[None]:
        """A write's shuffle files serve no other job, but would stay until the driver collects garbage."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)

    def put_by(self, df: DataFrame, column: str) -> DataFrame:
        """The same in buckets of a column, as many as shuffle partitions, so that joins on it don't shuffle this table again."""
        name, n = str(self.made), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.made += 1
        table = f"varve_{uuid.uuid4().hex}"
        with self._tidy():
            df.repartition(n, column).write.format("parquet").bucketBy(n, column).sortBy(column).option("path", f"{self.folder}/{name}").saveAsTable(table)
        out = self.spark.table(table)
        out._varve_round, out._varve_table = name, table
        return out

    def drop(self, table: DataFrame) -> None:
        """Deletes a table of this job that no plan reads any more."""
        if hasattr(table, "_varve_table"):
            self.spark.sql(f"DROP TABLE {table._varve_table}")
        path = self._path(table._varve_round)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

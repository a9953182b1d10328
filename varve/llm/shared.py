"""Shared-folder tables, Arrow helpers and word rules used by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class of both Java's and Python's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Most rows and bytes of one Arrow batch; they keep a Python worker's memory bounded when texts are long.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}

_own_root: list[str] = []
_worker: list = [None, None]


def worker_cache(owner: str, make: Callable):
    """The cache of the operator that this Python worker serves now, kept from task to task. Workers outlive operators, so another
    operator's cache is dropped first: a worker never holds two."""
    if _worker[0] != owner:
        _worker[:] = [None, None]
        pa.default_memory_pool().release_unused()
        _worker[:] = [owner, make()]
    return _worker[1]


class BoundedCache(dict):
    """Values by key, made when first asked for; starts anew when it holds the given number of entries."""

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        out = self.make(key)
        if len(self) >= self.entries:
            self.clear()
        self[key] = out
        return out


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="varve-"))
    return _own_root[0]


def bounded_batches(spark: SparkSession) -> None:
    """Lowers, never raises, the session's limits of an Arrow batch. They stay lowered, since plans are run after this returns; results don't depend on them."""
    for key, most in BATCH_LIMITS.items():
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


class Stash:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a recomputation. Deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_root(spark)}/varve-{name}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.at}/{self.n}"
        self.n += 1
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._varve_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Deletes a table of this stash that no returned plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table._varve_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def own_columns(df: DataFrame, **columns) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot interfere."""
    return df.select(*(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in columns.items()))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def running_base(totals: DataFrame, key: str, total: str) -> DataFrame:
    """For one row per partition of an earlier pass: the sum of the totals before it. Rows: one per partition, never per document."""
    spark = totals.sparkSession
    rows = sorted((r[key], r[total]) for r in totals.collect())
    out, before = [], 0
    for k, n in rows:
        out.append((k, before))
        before += n
    return spark.createDataFrame(out, f"{key} int, base long")

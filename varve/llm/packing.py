"""Packing by concatenate-and-cut: partition token totals, a prefix sum over them, then fixed windows over the one long stream.

Pass 1 encodes each document once and writes its ids with the running offset in its partition. The prefix sum over
partition totals (one row per partition) turns that into a global offset, so pass 2 cuts every document by itself: no sort, no shuffle.
A document that crosses a window's edge gives one boundary record per window that it touches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stash, bounded_batches, running_base
from .token_codec import encoder

WINDOW = 1024
END_ID = 0
ENCODED = "part int, local_start long, n long, doc_id long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([END_ID], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encode(x.as_py() or "") + end for x in batch.column(1)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(start), pa.array(n), batch.column(0), pa.array(ids, pa.binary())], ["part", "local_start", "n", "doc_id", "ids"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                at = 0
                while at < n:
                    seq, offset = divmod(start + at, window)
                    length = min(window - offset, n - at)
                    rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, seq, offset))
                    at += length
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every sequence but the last is full, so padding is below one window for the whole corpus. Null and empty texts hold the
    end id only; an empty table gives no rows; repeated doc_ids stay separate documents; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    stash = Stash(docs.sparkSession, "pack")
    encoded = stash.put(docs.select("doc_id", "text").mapInArrow(_encode(tokenizer), ENCODED))
    base = running_base(encoded.groupBy("part").agg(F.sum("n").alias("n")), "part", "n")
    placed = encoded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n", "ids")
    return placed.mapInArrow(_cut(window), PIECES)

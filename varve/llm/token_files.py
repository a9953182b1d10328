"""Token-id files: documents in id order as Simple-8b blocks in a table of segments, and its reader.

File format: a Parquet table with one row per segment (whole documents, about SEGMENT_IDS ids): part (file order), seg (order
in the part), seg_start (ids of the part before it), words (little-endian 64-bit Simple-8b words), offsets (first word of each block of
BLOCK_IDS ids), doc_ids and doc_lens (documents in order). Spark's writer commits each part once, so a lost executor leaves no half file.
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
from .token_codec import encoder, simple8b_decode, simple8b_encode

SEGMENT_IDS = 262_144
END_ID = 0
SEGMENTS = "part int, seg int, seg_start long, n_ids long, words binary, offsets array<int>, doc_ids array<long>, doc_lens array<long>"
ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("seg_start", pa.int64()), ("n_ids", pa.int64()), ("words", pa.binary()), ("offsets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64()))])


def _writer(path: str, segment_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([END_ID], "<u4").tobytes()
        part, seg, start = TaskContext.get().partitionId(), 0, 0
        docs, lens, ids, held = [], [], [], 0

        def flush():
            nonlocal seg, start, docs, lens, ids, held
            words, offsets = simple8b_encode(np.frombuffer(b"".join(ids), "<u4"))
            row = [[part], [seg], [start], [held], [words.astype("<u8").tobytes()], [offsets.tolist()], [docs], [lens]]
            seg, start, docs, lens, ids, held = seg + 1, start + held, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                got = encode(text.as_py()) + end
                docs.append(doc.as_py())
                lens.append(len(got) // 4)
                ids.append(got)
                held += lens[-1]
                if held >= segment_ids:
                    yield flush()
        if docs:
            yield flush()

    return write


def write_token_files(docs: DataFrame, stash: Stash, tokenizer: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes doc_id, text (null: empty) in ascending doc_id order (null first; repeated ids by text) and returns the table of segments."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stash.put(ordered.select("doc_id", "text").mapInArrow(_writer(tokenizer, segment_ids), SEGMENTS))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, start, words, docs, lens in zip(*(batch.column(i) for i in range(5)), strict=True):
            data = simple8b_decode(np.frombuffer(words.as_py(), "<u8")).astype("<u4")
            lens = np.array(lens.as_py(), np.int64)
            ends = np.cumsum(lens)
            begin = ends - lens
            crc = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([docs.values, pa.array(base.as_py() + start.as_py() + begin), pa.array(lens), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the decoded segments; start counts the ids of all documents before."""
    base = running_base(segments.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")
    joined = segments.join(F.broadcast(base), "part").select("base", "seg_start", "words", "doc_ids", "doc_lens")
    return joined.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_segment(words: bytes) -> np.ndarray:
    return simple8b_decode(np.frombuffer(words, "<u8"))


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes every document, writes the files and reads them back: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts hold the end id only. An empty table gives no rows. Repeated doc_ids stay separate documents. Other columns are ignored.
    """
    stash = Stash(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs.select("doc_id", "text"), stash, tokenizer))

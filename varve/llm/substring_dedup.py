"""Removes passages that occur more than once, found by fixed-block anchors.

1. chunks: rows become chunks of whole documents, compressed and written once, so that every later pass sees the same chunks.
2. anchors: the non-overlapping blocks of a document (at word 0, B, 2 B, ...) are the index, and every rolling window of B words probes it. With
   B = (SPAN + 1) / 2 each span of SPAN words holds a whole block of its own document, so two equal spans always meet: one's block is the other's
   probe. Blocks and probes are dealt by ranges of their hash; of a probe only 32 bits travel, since a false hit costs time, not rows.
3. extension: each hit is extended to the spans of SPAN words around it. Spans are told apart by 64-bit hashes and counted as classes, never as
   pairs of places: a passage of m documents would give m^2 pairs, and costs m rows here. A span whose class has another place is a repeat.
4. Overlapping spans merge into maximal exact repeats, which leave the text.

A chunk sends each distinct hash once, marked if it occurs in the chunk more than once, so a passage of a third of all rows is one row a chunk.
A task holds one chunk, or one bucket's index; probes stream past it. A single text is held whole, with about ten times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stash, bounded_batches

SPAN = 35
#: Bytes of text in a chunk, and bytes of all text per bucket of hashes; a bucket holds the blocks of its share, that is one hash in B.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 1 << 26, 512
#: What is known of a hash within its chunk: an index entry that occurs again, one that occurs once, and a probe that is no index entry.
REPEATED, ONCE, PROBE = 0, 1, 2
CHUNKS = "chunk long, doc_ids array<long>, sizes array<long>, texts binary"
MESSAGES = "bucket long, kind int, chunk long, base int, hashes binary, slots binary"
HITS = "chunk long, kind int, slots binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

_SEGMENT = 1 << 18
_random = np.random.default_rng(11)
_BYTES = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_MULTIPLIER = int(_random.integers(1 << 62, 1 << 63)) * 2 + 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(of: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, of, np.uint64)])


_UP, _DOWN = _powers(_MULTIPLIER, _SEGMENT), _powers(_INVERSE, _SEGMENT)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a chunk's documents: bytes with one space behind each word, where words start, which document they are of, rolling hashes."""

    def __init__(self, texts: bytes, sizes: np.ndarray):
        """texts: UTF-8 of all documents, each with a line end behind it; sizes: their bytes with it."""
        raw = np.frombuffer(texts, np.uint8)
        white = _WHITE[raw]
        keep = ~white
        keep[1:] |= white[1:] & ~white[:-1]
        ends = np.flatnonzero(keep & white)
        self.data = raw[keep]
        self.data[white[keep]] = 0x20
        del white, keep
        self.first = np.r_[0, np.searchsorted(ends, np.cumsum(sizes))]  # each document's first word, and the number of words
        self.starts = np.r_[0, np.flatnonzero(self.data == 0x20) + 1]
        self.n = len(self.starts) - 1
        counts = np.diff(self.first)
        self.place = np.arange(self.n) - np.repeat(self.first[:-1], counts)  # a word's place in its document
        self.left = np.repeat(self.first[1:], counts) - np.arange(self.n)  # words from it to the document's end
        self.sums, self.down = np.zeros(self.n + 1, np.uint64), np.ones(self.n + 1, np.uint64)
        total = np.zeros(1, np.uint64)
        for a in range(0, len(self.data), _SEGMENT):
            part = self.data[a : a + _SEGMENT]
            running = np.cumsum(_BYTES[part] * _UP[: len(part)], dtype=np.uint64) * np.uint64(pow(_MULTIPLIER, a, 1 << 64)) + total
            i, j = np.searchsorted(self.starts, (a + 1, a + len(part) + 1))
            self.sums[i:j] = running[self.starts[i:j] - a - 1]
            i, j = np.searchsorted(self.starts, (a, a + len(part)))
            self.down[i:j] = _DOWN[self.starts[i:j] - a] * np.uint64(pow(_INVERSE, a, 1 << 64))
            total = running[-1:]

    def windows(self, k: int) -> np.ndarray:
        """Words at which k words of one document start."""
        return np.flatnonzero(self.left >= k)

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        return _mixed((self.sums[at + k] - self.sums[at]) * self.down[at])


def _pack(chunk_bytes: int):
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        press = zstandard.ZstdCompressor(level=1)

        def chunk() -> pa.RecordBatch:
            nonlocal made, size, ids, texts
            row = [[part << 32 | made], [ids], [[len(t) + 1 for t in texts]], [press.compress(b"\n".join([*texts, b""]))]]
            made, size, ids, texts = made + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], ["chunk", "doc_ids", "sizes", "texts"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(text) > chunk_bytes:
                    yield chunk()
                ids.append(doc)
                texts.append(text)
                size += len(text) + 1
        if texts:
            yield chunk()

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Words]]:
    import zstandard

    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "sizes"}
            sizes = batch.column("sizes")[i].values.to_numpy()
            yield row, Words(zstandard.ZstdDecompressor().decompress(row.pop("texts"), max_output_size=int(sizes.sum()) + 1), sizes)


def _messages(chunk: int, values: np.ndarray, kinds: np.ndarray, buckets: int, short: bool, slots: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A message per bucket and kind. values: ascending; a bucket is a range of their upper halves. Without slots, a value's slot is its place within its kind."""
    rows: list[tuple] = []
    for kind in (REPEATED, ONCE, PROBE):
        on = kinds == kind
        v = values[on]
        s = None if slots is None else slots[on].astype(np.uint32)
        bucket = ((v >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket) > 0, True]) if len(v) else np.zeros(1, np.int64)
        sent = v.astype(np.uint32) if short else v
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows.append((int(bucket[a]), kind, chunk, a, sent[a:b].tobytes(), b"" if s is None else s[a:b].tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "kind", "chunk", "base", "hashes", "slots"])


def _blocks(words: Words, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the rolling windows, their distinct hashes, which of these each has, and what the chunk knows of each hash."""
    at = words.windows(block)
    values, inverse, counts = np.unique(words.hashes(at, block), return_inverse=True, return_counts=True)
    entry = np.zeros(len(values), bool)
    entry[inverse[words.place[at] % block == 0]] = True
    return at, values, inverse, np.where(entry, np.where(counts > 1, REPEATED, ONCE), PROBE)


def _deal_anchors(block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _opened(batches):
            _, values, _, kinds = _blocks(words, block)
            yield from _messages(row["chunk"], values, kinds, buckets, True)

    return run


def _deal_spans(span: int, block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _opened(batches):
            at, _, inverse, kinds = _blocks(words, block)
            known = kinds == REPEATED
            for kind in (ONCE, PROBE):
                of = np.flatnonzero(kinds == kind)
                for h in row["hits"] or []:
                    if h["kind"] == kind:
                        known[of[np.frombuffer(h["slots"], np.uint32)]] = True
            hit = np.zeros(words.n + 1, np.int64)
            hit[at[known[inverse]] + 1] = 1
            hit = np.cumsum(hit)
            starts = words.windows(span)
            starts = starts[hit[starts + span - block + 1] > hit[starts]]  # spans that hold a hit
            values, first, counts = np.unique(words.hashes(starts, span), return_index=True, return_counts=True)
            yield from _messages(row["chunk"], values, np.where(counts > 1, REPEATED, ONCE), buckets, False, starts[first])

    return run


def _match(short: bool):
    """Hits of each bucket: index entries that occur again, anywhere, and probes that meet an index entry. Rows come by bucket and kind, the index first."""
    dtype = np.uint32 if short else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        index, total, touched = None, None, None

        def told(chunk: int, kind: int, slots: np.ndarray) -> None:
            if len(slots):
                out.append((chunk, kind, slots.astype(np.uint32).tobytes()))

        def build() -> None:
            nonlocal index, total, touched
            every = np.concatenate([np.zeros(0, dtype), *(h[2] for h in held)])
            weight = np.concatenate([np.zeros(0, np.int64), *(np.full(len(h[2]), 2 if h[1] == REPEATED else 1) for h in held)])
            index, inverse = np.unique(every, return_inverse=True)
            total = np.bincount(inverse, weight, len(index))
            touched = np.zeros(len(index), bool)

        def found(values: np.ndarray) -> np.ndarray:
            return np.minimum(np.searchsorted(index, values), max(0, len(index) - 1))

        def close() -> None:
            nonlocal index, held
            if index is None:
                build()
            for chunk, kind, values, slots in held:
                if kind == ONCE:
                    at = found(values)
                    told(chunk, ONCE, slots[(total[at] > 1) | touched[at]])
            held, index = [], None

        def batch_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "kind", "slots"])

        for batch in batches:
            for bucket, kind, chunk, base, hashes, slots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if now is not None:
                        close()
                    now = bucket
                values = np.frombuffer(hashes, dtype)
                slots = np.frombuffer(slots, np.uint32) if slots else np.arange(base, base + len(values), dtype=np.uint32)
                if kind != PROBE:
                    held.append((chunk, kind, values, slots))
                    continue
                if index is None:
                    build()
                if len(index):
                    at = found(values)
                    on = index[at] == values
                    touched[at[on]] = True
                    told(chunk, PROBE, slots[on])
            yield batch_out()
        if now is not None:
            close()
        yield batch_out()

    return run


def _cut(span: int):
    names = ["doc_id", "n_words", "n_removed", "repeats", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words in _opened(batches):
            starts = words.windows(span)
            _, inverse, counts = np.unique(words.hashes(starts, span), return_inverse=True, return_counts=True)
            edge = np.zeros(words.n + 1, np.int64)
            dup = np.unique(np.concatenate([starts[counts[inverse] > 1], *(np.frombuffer(h["slots"], np.uint32).astype(np.int64) for h in row["hits"] or [])]))
            edge[dup] += 1
            np.subtract.at(edge, dup + span, 1)
            gone = np.cumsum(edge[:-1]) > 0
            begins = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | (words.place == 0))) if words.n else np.zeros(0, np.int64)
            stops = np.flatnonzero(gone & (np.r_[~gone[1:], True] | (words.left == 1))) + 1 if words.n else np.zeros(0, np.int64)
            removed = np.r_[0, np.cumsum(gone)][words.first]
            size = np.diff(words.starts)
            kept = words.data[np.repeat(~gone, size)].tobytes()
            ends = np.r_[0, np.cumsum(np.where(gone, 0, size))][words.first].tolist()
            texts = [kept[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            spans = pa.StructArray.from_arrays([pa.array(words.place[begins]), pa.array(stops - begins)], ["start", "length"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, words.first).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(words.first)), pa.array(np.diff(removed)), lists.cast(SPANS), pa.array(texts, pa.string())], names)

    return run


def without_repeats(docs: DataFrame, span: int = SPAN, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, repeats (maximal runs of words that lie in a repeated span: start, length) and kept (the other words,
    joined by one space) for every row.

    A word goes if it lies in `span` consecutive words of its text that also start at another place, in the same text too; its first
    occurrence goes as well. Texts are compared byte by byte within words, white space between words doesn't matter. Null, empty and
    word-free texts have no words and keep an empty text. Rows that repeat a doc_id are documents of their own. An empty table gives no rows;
    other columns are ignored. Exact up to collisions of 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    block = (span + 1) // 2
    stash = Stash(spark, "repeats")
    chunks = stash.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(chunk_bytes), CHUNKS))
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // bucket_bytes)

    def with_hits(messages: DataFrame, short: bool) -> DataFrame:
        """chunks, each with the hits among what it sent."""
        hits = messages.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_match(short), HITS)
        return chunks.join(hits.groupBy("chunk").agg(F.collect_list(F.struct("kind", "slots")).alias("hits")), "chunk", "left").select("chunk", "doc_ids", "sizes", "texts", "hits")

    anchored = with_hits(chunks.select("chunk", "doc_ids", "sizes", "texts").mapInArrow(_deal_anchors(block, buckets), MESSAGES), True)
    extended = with_hits(anchored.mapInArrow(_deal_spans(span, block, buckets), MESSAGES), False)
    return extended.mapInArrow(_cut(span), "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,length:long>>, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of without_repeats."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle() -> str:
    """The digests by window functions over one row a word."""
    return rf"""
    WITH words AS (
      SELECT d, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i
      FROM (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
    grams AS (
      SELECT *, CASE WHEN count(*) OVER s = {SPAN} THEN string_agg(word, ' ') OVER s END AS gram
      FROM words WINDOW s AS (PARTITION BY d ORDER BY i ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING)),
    marked AS (SELECT d, word, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY gram) > 1 AS again FROM grams),
    cut AS (SELECT d, word, i, bool_or(again) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN {SPAN - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
    told AS (SELECT d, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM cut GROUP BY d)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM (SELECT row_number() OVER () AS d, doc_id FROM documents) LEFT JOIN told USING (d)"""

"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents (MAX_LABELLED rows) is turned into hashed tf-idf vectors and reduced by a truncated
singular value decomposition. Its vectors and labels are broadcast (at most MAX_LABELLED x RANK numbers); every document is then
compared with all of them in blocks by exact cosine, and its nearest neighbours vote with weights that grow with similarity. How many vote, and how fast
weights grow, is chosen on the training rows alone.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BoundedCache, bounded_batches, slices, worker_cache

MAX_LABELLED = 4000
RANK = 64
#: Neighbours that vote and powers of their cosines, of which the training rows choose a pair; cosines from COPY up are copies, which don't take part in the choice.
NEIGHBOURS, SHARPNESS = (9, 15, 25, 41), (4, 8, 16, 40)
COPY = 0.999
THRESHOLD = 0.3
WORDS, SHAPES, STATS = 1024, 768, 256
#: Length of the vector's three parts before the reduction: words, word shapes, whole-text measures.
PART_LENGTHS = (0.35, 1.0, 1.0)
CACHE_ENTRIES = 200_000
BLOCK = 256

_CLASSES = re.compile(r"([A-ZÀ-ÖØ-Þ]+)|([^\W\d_]+)|(\d+)|((.)\5*)", re.DOTALL)


def _shape(word: str) -> str:
    """Runs of upper case, other letters, digits and each repeated sign: 'Thing###' is 'Ul#'."""
    return "".join("U" if m[1] else "l" if m[2] else "9" if m[3] else m[5] for m in _CLASSES.finditer(word))[:12]


def _term(word: str) -> int:
    return xxhash.xxh32_intdigest(word.lower()) % WORDS | xxhash.xxh32_intdigest(_shape(word), 7) % SHAPES << 16


def _stats(text: str, words: list[str]) -> list[int]:
    """Slots of whole-text measures, each measure in 16 steps."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    upper = sum(1 for w in words if w.isupper())
    signs = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')")
    bare = sum(1 for w in words if not any(c.isalnum() for c in w[:3]))
    digits = sum(1 for w in words if w[0].isdigit())
    again = sum(a == b for a, b in itertools.pairwise(words))
    shares = (len(set(words)) / n if n >= 20 else 1.0, upper / n, signs / n, bare / n, digits / n, len(set(lines)) / len(lines), len(words) / chars * 4, sum(1 for w in words if w[-1] in "!?") / n, again / n)
    steps = [min(15, int(16 * s)) for s in shares] + [min(15, n.bit_length())]
    return [WORDS + SHAPES + 16 * i + s for i, s in enumerate(steps)]


def features(texts: list[str]) -> np.ndarray:
    """Raw counts, one row per text."""
    out = np.zeros((len(texts), WORDS + SHAPES + STATS), np.float32)
    code = worker_cache("quality", lambda: BoundedCache(_term, CACHE_ENTRIES)).__getitem__
    for row, text in zip(out, texts, strict=True):
        words = text.split()
        codes = np.fromiter(map(code, words), np.int64, len(words))
        row[:WORDS] = np.bincount(codes & 0xFFFF, minlength=WORDS)
        row[WORDS : WORDS + SHAPES] = np.bincount(codes >> 16, minlength=SHAPES)
        row[_stats(text, words)] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """weighted, block by block, so that the driver holds the counts and the result only."""
    out = np.empty(counts.shape, np.float32)
    for at in range(0, len(counts), BLOCK):
        out[at : at + BLOCK] = weighted(counts[at : at + BLOCK], idf)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled, idf-weighted counts; shapes count by their share of the words, since a text's make-up matters there, not its length."""
    share = counts[:, WORDS : WORDS + SHAPES]
    parts = np.log1p(counts[:, :WORDS]) * idf[:WORDS], np.sqrt(share / np.maximum(share.sum(1, keepdims=True), 1)), counts[:, WORDS + SHAPES :]
    return np.hstack([_unit(p) * w for p, w in zip(parts, PART_LENGTHS, strict=True)]).astype(np.float32)


def votes(sims: np.ndarray, labels: np.ndarray, neighbours: int, sharpness: float, prior: float) -> np.ndarray:
    """Mean label of each row's nearest labelled vectors, weighted by a power of their positive cosines; equal cosines: the first vectors."""
    near = np.argsort(-sims, axis=1, kind="stable")[:, :neighbours] if sims.shape[1] <= 2 * neighbours else _nearest(sims, neighbours)
    weight = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** sharpness
    total = weight.sum(1)
    out = np.full(len(sims), prior)
    some = total > 0
    out[some] = (weight * labels[near]).sum(1)[some] / total[some]
    return np.clip(out, 0, 1)


def _nearest(sims: np.ndarray, k: int) -> np.ndarray:
    """The k largest per row, of which the last ones, where equal, are the first in order."""
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(sims, near, 1).min(1)
    for i in np.flatnonzero((sims >= last[:, None]).sum(1) > k):
        near[i] = np.argsort(-sims[i], kind="stable")[:k]
    return near


class Model:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float, neighbours: int = NEIGHBOURS[0], sharpness: float = SHARPNESS[0]):
        self.idf, self.basis, self.vectors, self.labels, self.prior, self.neighbours, self.sharpness = idf, basis, vectors, labels, prior, neighbours, sharpness

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        return votes(_unit(weighted(features(texts), self.idf) @ self.basis) @ self.vectors.T, self.labels, self.neighbours, self.sharpness, self.prior)


def choose(vectors: np.ndarray, labels: np.ndarray, prior: float) -> tuple[int, float]:
    """The pair of NEIGHBOURS and SHARPNESS with the least log loss over the training rows, each scored by the others without its copies."""
    loss = {(k, p): 0.0 for k in NEIGHBOURS for p in SHARPNESS}
    for at in range(0, len(labels), BLOCK):
        sims = vectors[at : at + BLOCK] @ vectors.T
        sims[sims >= COPY] = -1
        y = labels[at : at + BLOCK]
        for k, p in loss:
            got = np.clip(votes(sims, labels, k, p, prior), 0.01, 0.99)
            loss[k, p] -= float((y * np.log(got) + (1 - y) * np.log(1 - got)).sum())
    return min(loss, key=lambda x: (loss[x], x))


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    n = len(labels)
    if not n:
        return Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), labels, 0.5)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x = weighted_rows(counts, idf)
    rank = min(rank, *x.shape)
    rng = np.random.default_rng(20)
    basis = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)))[0]
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    small = np.linalg.svd(x @ basis, full_matrices=False)[2]
    basis = (basis @ small[:rank].T).astype(np.float32)
    vectors, labels, prior = _unit(x @ basis).astype(np.float32), labels.astype(np.float64), float(labels.mean())
    return Model(idf, basis, vectors, labels, prior, *choose(vectors, labels, prior))


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(by))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learns from at most max_labelled rows of labels (doc_id, quality 0 or 1), chosen by hash, whose id's crc32 mod 5 is not 0."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0))
    chosen = usable.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            told = []
            for r in features(batch.column(0).to_pylist()):
                at = np.flatnonzero(r)
                told.append(at.astype("<u2").tobytes() + r[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.binary()), batch.column(1)], ["counts", "quality"])

    found = rows.mapInArrow(run, "counts binary, quality int").orderBy(F.xxhash64("counts"), "counts", "quality").limit(max_labelled).toArrow()  # about 2 kB a row
    counts = np.zeros((found.num_rows, WORDS + SHAPES + STATS), np.float32)
    for row, told in zip(counts, found.column("counts"), strict=True):
        told = told.as_py()
        k = len(told) // 6
        row[np.frombuffer(told[: 2 * k], "<u2")] = np.frombuffer(told[2 * k :], "<f4")
    return fit(counts, found.column("quality").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs whose names don't clash, with score and predicted (1 if score >= threshold).

    Null and empty texts are scored as texts without words. Without any label every score is 0.5. Repeated rows are scored each.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BLOCK):
            got = shared.value.score([x.as_py() or "" for x in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))

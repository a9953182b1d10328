"""Aligns two tokenizers' tokens by a dangling-suffix transducer.

The transducer's state is which side leads and the bytes by which it leads (the residual). The side behind gives the next token: it shortens the
residual, or turns it over to the other side, or meets it, which closes a group. Transitions depend on state and token only and are
memoised. Neither vocabulary joins characters across the place between a sign and a space after it, so the state is empty there: a text is
the sequence of its units (a space, or several, and what follows to the next such place), and a unit's groups are kept while cached.

A link is a pair of tokens that end together. Then one's bytes end with the other's, so there are at most as many distinct pairs as the two
vocabularies have bytes: the table of pair counts that goes to the executors and through the driver is bounded by the vocabularies, not by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stash, bounded_batches, slices, worker_cache
from .token_codec import byte_alphabet

#: Units of each of a worker's two generations, letters of the longest of these, and the memoised transitions, which start anew when full.
UNITS, UNIT_LETTERS, TRANSITIONS = 200_000, 40, 1_000_000
#: Links that a task counts at once.
HELD_LINKS = 2_000_000
SPACE = "▁"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"
#: No place for a cut: behind white space, or before a space that ends the text (the second tokenizer has no ids for an empty rest).
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_WHITE_THEN_SPACE = re.compile(r"\s ")


class Transducer:
    """Groups of two token sequences with the same bytes."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.sides = (a, b)
        self._start()

    def _start(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {}
        self.leads, self.residuals = [1], [b""]  # state 0: nothing dangles; the first side gives the next token
        self.memo: dict[int, int] = {}  # by state << 32 | token

    def _state(self, lead: int, residual: bytes) -> int:
        if not residual:
            return 0
        at = self.states.get((lead, residual))
        if at is None:
            at = self.states[lead, residual] = len(self.leads)
            self.leads.append(lead)
            self.residuals.append(residual)
        return at

    def _next(self, state: int, token: int) -> int:
        lead, residual = self.leads[state], self.residuals[state]
        new = self.sides[1 - lead][token]
        if residual.startswith(new):
            return self._state(lead, residual[len(new) :])
        if new.startswith(residual):
            return self._state(1 - lead, new[len(residual) :])
        return -1

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int, int, int]] | None:
        """Bounds (i, i', j, j') of the groups a[i:i'], b[j:j']; None if the bytes differ."""
        if len(self.memo) > TRANSITIONS:
            self._start()
        i = j = from_i = from_j = state = 0
        n, m, out, leads, memo = len(a), len(b), [], self.leads, self.memo
        while True:
            if leads[state]:  # the first side is behind
                if i == n:
                    break
                token = a[i]
                i += 1
            else:
                if j == m:
                    break
                token = b[j]
                j += 1
            new = memo.get(state << 32 | token)
            if new is None:
                new = memo[state << 32 | token] = self._next(state, token)
            if not new:
                out.append((from_i, i, from_j, j))
                from_i, from_j = i, j
            elif new < 0:
                return None
            state = new
        return None if state or j < m else out


class Aligner:
    """Encodes units with both tokenizers and aligns them."""

    def __init__(self, bpe: str, pieces: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(bpe), SentencePieceProcessor(model_file=pieces)
        self.first.encode_special_tokens = True
        byte = {chr(c): b for b, c in byte_alphabet().items()}
        a = []
        for i in range(self.first.get_vocab_size()):
            entry = self.first.id_to_token(i) or ""
            a.append(bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode())
        names = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        b = [bytes([int(x[3:5], 16)]) if self.second.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        if any(SPACE in x.lstrip(SPACE) for x in names):
            raise ValueError("a piece joins a word and a space behind it: texts can't be cut into units")
        self.bytes, self.width = (a, b), len(b)
        self.dtype = np.dtype("<u4") if len(a) * len(b) <= 1 << 32 else np.dtype("<u8")
        self.transducer = Transducer(a, b)
        joined = {x[k] for x in names for k in range(1, len(x)) if x[k - 1].isalpha()}
        self.signs: dict[str, tuple] = {}  # units of signs that neither side joins to a letter before them
        for sign in set(",.;:!?") - joined:
            i, j = self.first.encode(sign, add_special_tokens=False).ids, self.second.piece_to_id(sign)
            if len(i) == 1 and b[j] == sign.encode():
                self.signs[sign] = (1 << 32 | 1, f";{i[0]}|{j}", np.array([i[0] * self.width + j], self.dtype).tobytes())
        self.names = [[str(i) for i in range(len(x))] for x in (a, b)]
        self.units: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}  # the generation before: what is asked for again moves over, so frequent units stay

    @staticmethod
    def parts(text: str) -> list[str]:
        """The units of a space and the text, each without its first space."""
        if text[0] != " " and text[-1] != " " and "  " not in text and not _WHITE_THEN_SPACE.search(text):
            return text.split(" ")
        return [u[1:] for u in _CUT.split(" " + text)]

    def _unit(self, part: str, a: list[int], b: list[int]) -> tuple | None:
        """Counts of both sides' tokens in one number, the groups as text, and the links' pair numbers; None where bytes differ."""
        of_a = self.bytes[0]
        if b"".join([of_a[x] for x in a]) != f" {part}".encode():
            return None
        groups = self.transducer.groups(a, b)  # which finds the second side's bytes to be the same
        if groups is None:
            return None
        (name_a, name_b), width, told, links = self.names, self.width, [], []
        for i, k, j, m in groups:
            links.append(a[k - 1] * width + b[m - 1])
            if k - i == 1 == m - j:
                told.append(f"{name_a[a[i]]}|{name_b[b[j]]}")
            else:
                told.append(",".join([name_a[x] for x in a[i:k]]) + "|" + ",".join([name_b[x] for x in b[j:m]]))
        return len(a) << 32 | len(b), ";".join(told), np.array(links, self.dtype).tobytes()

    def align(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, groups, links of each text; zeros where there are no tokens."""
        parts = [self.parts(t) if t and SPACE not in t else [] for t in texts]  # the sign that stands for a space is lost in the second's pieces
        wanted = {p for ps in parts for p in ps}
        if len(self.units) + len(wanted) > UNITS:
            self.units, self.older = {}, self.units
        units, older, fresh, signed = self.units, self.older, set(), []
        for p in wanted - units.keys():
            if p in older:
                units[p] = older[p]
            elif p[-1:] in self.signs and p[-2:-1].isalpha():  # a word and a sign
                signed.append(p)
                if p[:-1] not in units:
                    fresh.add(p[:-1])
            else:
                fresh.add(p)
        new = list(fresh)
        if new:
            ours = self.first.encode_batch_fast([" " + p for p in new], add_special_tokens=False)
            theirs = self.second.encode(new, num_threads=1)
            for p, a, b in zip(new, ours, theirs, strict=True):
                units[p] = self._unit(p, a.ids, b)
        for p in signed:
            word, sign = units[p[:-1]], self.signs[p[-1]]
            units[p] = word and (word[0] + sign[0], word[1] + sign[1], word[2] + sign[2])
        out = []
        for ps in parts:
            got = [units[p] for p in ps]
            if not got or None in got:
                out.append((0, 0, 0, "", b""))
                continue
            counts, told, links = zip(*got)  # noqa: B905
            counts, links = sum(counts), b"".join(links)
            out.append((counts >> 32, counts & 0xFFFFFFFF, len(links) // self.dtype.itemsize, ";".join(told), links))
        for p in (*new, *signed):
            if len(p) > UNIT_LETTERS:
                del units[p]
        return out


def aligner(bpe: str, pieces: str) -> Aligner:
    return worker_cache(f"aligner {bpe} {pieces}", lambda: Aligner(bpe, pieces))


def _align(bpe: str, pieces: str):
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            columns = list(zip(*aligner(bpe, pieces).align(batch.column(1).to_pylist()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return run


def align(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups and links of a space and the text by the byte-level BPE `bpe`, and of the text by the sentencepiece model `pieces`.

    groups: `a1,a2|b1;a3|b2,b3`, ids of both in order. links: packed little-endian numbers a * size of b's vocabulary + b of the tokens that end each group.
    Texts that are null, empty, or whose tokens' bytes differ from a space and the text have no tokens. Special tokens' strings are plain text.
    Rows that repeat a doc_id stay apart; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_align(bpe, pieces), ALIGNED)


def _count(dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            pairs, counts = np.unique(np.frombuffer(b"".join(held), dtype), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for links in batch.column(0):
                held.append(links.as_py())
                size += len(held[-1]) // dtype.itemsize
                if size >= HELD_LINKS:
                    yield told()
                    size = 0
        if held:
            yield told()

    return run


def _score(shared, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            links = [x.as_py() for x in batch.column("links")]
            ends = np.cumsum([0, *(len(x) // dtype.itemsize for x in links)])
            at = np.searchsorted(pairs, np.frombuffer(b"".join(links), dtype).astype(np.int64))
            n_best, total = (np.r_[0, np.cumsum(v[at])][ends] for v in (best, counts))
            columns = {"n_links": np.diff(ends), "n_best": np.diff(n_best), "count_sum": np.diff(total)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(v.astype(np.int64)) for v in columns.values()), batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", *columns, "groups_sha256"])

    return run


def link_scores(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row; see align for texts without tokens, which have zeros and ''.

    A pair's count is the number of links of the corpus that hold it. n_best: links whose count is the highest of their second id, ties included.
    count_sum: the sum of the counts over the row's links.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "alignment")
    model = Aligner(bpe, pieces)
    width, dtype, bound = model.width, model.dtype, sum(map(len, (*model.bytes[0], *model.bytes[1])))
    digest = F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    aligned = stash.put(align(docs, bpe, pieces).select("doc_id", "n_a", "n_b", "n_groups", "links", digest.alias("groups_sha256")))
    counted = aligned.select("links").mapInArrow(_count(dtype), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    if counted.num_rows > bound:
        raise ValueError(f"{counted.num_rows} pairs of ids that end together; the vocabularies allow {bound}")
    pairs, counts = (counted.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, counts = pairs[order].astype(np.int64), counts[order].astype(np.int64)
    most = np.zeros(width, np.int64)
    np.maximum.at(most, pairs % width, counts)
    shared = spark.sparkContext.broadcast((pairs, counts, (counts == most[pairs % width]).astype(np.int64)))
    return aligned.mapInArrow(_score(shared, dtype), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

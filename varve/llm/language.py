"""Language of texts: scripts narrow the candidates of each word, character n-grams score them, and a Viterbi path with a switching
penalty labels spans; the language with the most letters in its spans is the text's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import remainder
from .shared import bounded_batches, slices

#: Expected number of labelled documents per language that are learned from.
DOCS_PER_LANGUAGE = 1500
#: Distinct values of lang at most; more are an error, since a model holds a row of BUCKETS numbers for each.
MOST_LANGUAGES = 512
BUCKETS = 1 << 15
MAX_N = 4
#: Scale and floor of a word's score against its best language, and the price of changing language between two words.
SCALE, FLOOR, SWITCH = 0.35, -6.0, 8.0
#: Share of a script among a language's letters from which words in it may be of that language.
SCRIPT_SHARE = 0.01
CACHE_WORDS = 150_000
CELLS = 1_000_000
#: First code points of Unicode script ranges; letters between one and the next count as that script.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "indic"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF65, "kana"), (0x10000, "other"), (0x20000, "han"))
_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


def letters_of(word: str) -> str:
    return word if word.isalpha() and word.islower() else "".join(c for c in word.lower() if c.isalpha())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every character n-gram of 1 to MAX_N within the words' edges."""
    lengths = np.array([len(w) + 2 for w in words])
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    hashed, buckets, owners = np.zeros(len(points), np.uint64), [], []
    for n in range(1, MAX_N + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] + points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        same = owner[:m] == owner[n - 1 :]
        if n == 1:
            same = same & (points > 3)
        buckets.append((mixed >> np.uint64(49)).astype(np.int64)[same])
        owners.append(owner[:m][same])
    return np.concatenate(buckets), np.concatenate(owners)


def _script_counts(words: list[str], counts: np.ndarray) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1], weights=np.repeat(counts, [len(w) for w in words]), minlength=len(SCRIPT_NAMES))


class Model:
    """Log-probabilities of n-gram buckets per language, and the scripts each language is written in."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray, docs: np.ndarray):
        self.languages = languages
        self.prior = int(docs.argmax()) if len(languages) else -1
        self.logp = np.log((grams.T + 0.05) / (grams.sum(1) + 0.05 * BUCKETS)) if len(languages) else np.zeros((BUCKETS, 0))
        self.may = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE).T if len(languages) else np.zeros((len(SCRIPT_NAMES), 0), bool)
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.languages)))
        self.letters = np.zeros(1024, np.int64)
        self.known = np.zeros(1024, np.int64)  # letters of words that some learned language may have

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "scores", "letters", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def _learn_words(self, tokens: list[str]) -> None:
        """Scores of words not seen before: per language, 0 for the best and less for the others; languages of other scripts get the floor."""
        at = len(self.rows)
        while at + len(tokens) > len(self.letters):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        words = [letters_of(t) for t in tokens]
        self.letters[at : at + len(tokens)] = [len(w) for w in words]
        scores = np.zeros((len(tokens), len(self.languages)))
        if any(words):
            bucket, owner = _grams(words)
            for k in range(len(self.languages)):
                scores[:, k] = np.bincount(owner, weights=self.logp[bucket, k], minlength=len(words))
            points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
            script = _SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1]
            may = np.zeros((len(words), len(self.languages)))
            np.add.at(may, np.repeat(np.arange(len(words)), self.letters[at : at + len(tokens)]), self.may[script])
            may = may * 2 >= np.maximum(self.letters[at : at + len(tokens), None], 1)
            best = np.where(may, scores, -np.inf).max(1, keepdims=True)
            scores = np.where(may, np.maximum(SCALE * (scores - np.where(np.isfinite(best), best, 0)), FLOOR), FLOOR)
            scores[~may.any(1) | (self.letters[at : at + len(tokens)] == 0)] = 0
            self.known[at : at + len(tokens)] = np.where(may.any(1), self.letters[at : at + len(tokens)], 0)
        self.scores[at : at + len(tokens)] = scores
        for i, t in enumerate(tokens):
            self.rows[t] = at + i

    def paths(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(language of each word, letters of each word, those in words of a learned language's script) per text."""
        if len(self.rows) > CACHE_WORDS:
            self.forget()
        split = [t.split() for t in texts]
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.rows))
        if fresh:
            self._learn_words(fresh)
        rows = [np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for words in split]
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(rows[i]))
        while order:
            longest = max(1, len(rows[order[-1]]))
            group = order[-max(1, CELLS // longest) :]
            group = [i for i in group if 2 * len(rows[i]) >= longest] or group[-1:]
            del order[len(order) - len(group) :]
            for i, path in zip(group, self._viterbi([rows[i] for i in group]), strict=True):
                out[i] = path, self.letters[rows[i]], self.known[rows[i]]
        return out

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        steps, n, k = max(map(len, rows)), len(rows), len(self.languages)
        index = np.full((steps, n), -1, np.int64)
        for i, r in enumerate(rows):
            index[: len(r), i] = r
        scores = np.vstack([self.scores[: len(self.rows)], np.zeros((1, k))])
        value, came = np.zeros((n, k)), np.zeros((steps, n), np.uint16)
        stay = np.zeros((steps, n, k), bool)
        for t in range(steps):
            top = value.argmax(1)
            jump = np.take_along_axis(value, top[:, None], 1) - SWITCH
            stay[t], came[t] = value >= jump, top
            value = np.maximum(value, jump) + scores[index[t]]
        state, path, each = value.argmax(1), np.empty((steps, n), np.uint16), np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[t] = state
            state = np.where(stay[t, each, state], state, came[t])
        return [path[: len(r), i] for i, r in enumerate(rows)]


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, most: int = MOST_LANGUAGES) -> Model:
    """Learns from documents with text and lang whose id's crc32 mod 3 is not 1: a sample by hash of about per_language documents of each language.

    More than `most` distinct languages raise a ValueError: the counts and the model's table are bounded by it."""
    usable = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null").filter(remainder(F.col("doc_id"), 3) != 1)
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).toArrow()
    if len(counts) > most:
        raise ValueError(f"more than {most} distinct values of lang")
    counts = docs.sparkSession.createDataFrame(counts)
    sample = usable.join(F.broadcast(counts), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("n") < per_language * 1_000_000).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                words = Counter(w for t in texts for w in map(letters_of, t.split()) if w)
                if lang not in grams:
                    grams[lang] = np.zeros(BUCKETS + len(SCRIPT_NAMES) + 1)
                grams[lang][-1] += len(texts)
                if words:
                    n = np.array(list(words.values()), float)
                    bucket, owner = _grams(list(words))
                    grams[lang][:BUCKETS] += np.bincount(bucket, weights=n[owner], minlength=BUCKETS)
                    grams[lang][BUCKETS:-1] += _script_counts(list(words), n)
        for lang, counts in grams.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "slot", "n"])

    found = sample.mapInArrow(run, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # one row per language and slot
    names = found.column("lang").to_pylist()
    languages = sorted(set(names))
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES) + 1))
    table[[languages.index(x) for x in names], found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:-1], table[:, -1])


def predict(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int]]]]:
    """(language, share of the text's letters that stand in its spans in a script that it uses, spans as (language, words)) per text; `und` and 0 without letters."""
    out = []
    paths = model.paths(texts) if model.languages else [(np.zeros(0, int), np.zeros(1, int), np.zeros(1, int))] * len(texts)
    for path, letters, known in paths:
        total = int(letters.sum())
        if not total or not len(path):
            out.append(("und", 0.0, []))
            continue
        share = np.bincount(path, weights=known, minlength=len(model.languages)) / total
        best = int(share.argmax())
        edges = np.flatnonzero(np.diff(path)) + 1
        spans = [(model.languages[path[a]], int(b - a)) for a, b in zip([0, *edges], [*edges, len(path)], strict=True)]
        out.append((model.languages[best], float(share[best]), spans))
    return out


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs whose names don't clash, with lang_pred, score and spans (array of lang, words, in order).

    Null texts and texts without letters, and all texts where no language was learned, give `und`, score 0 and no spans. A text in a script that no
    learned language uses gets a learned language with score 0. Equal scores: the alphabetically first language. Repeated rows are labelled each.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "spans")
    at = docs.columns.index("text")
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            got = predict(shared.value, [x.as_py() or "" for x in batch.column(at)])
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([[{"lang": a, "words": b} for a, b in g[2]] for g in got], span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType().add("lang", "string").add("words", "integer")))]))

"""Groups spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One edit between two words of at most M letters leaves M - 1 letters of common prefix and suffix together, so one half is intact: they lie in
a block of words with the same first M // 2 letters, or the same last ones. A block is a range of the forward dictionary, or of the reversed one.
Blocks with more than LIMIT words are subdivided: of the open part between the shared prefix and suffix one half is intact again. The
subdivision ends with one open letter, where a block is no larger than the alphabet. A pair goes to the prefix's side if it shares the prefix, else to the
suffix's side, so it is met, verified and counted once. Block sizes are counted in Spark, level by level; a task holds some whole blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stash, bounded_batches

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
LIMIT = 128
#: Distinct words that a task counts before it passes them on; pairs that are verified at once.
HELD_WORDS, TILE = 300_000, 1 << 18
#: A form has at least RATIO times its variant's occurrences, so a path of forms has fewer than 19 steps within a long; five doublings follow 32.
DOUBLINGS = 5
BLOCKS = "block long, m int, a int, b int, cut int, word string, n long"


def _count(least: int, spoil: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    if spoil:
                        h = zlib.crc32(word.encode(), seed)
                        if h % spoil == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    total[word] += n
                if len(total) >= HELD_WORDS:
                    yield told()
        if total:
            yield told()

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, spoil: int = 31) -> DataFrame:
    """word, n: maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, of at least `least` letters and `least_count` occurrences overall.

    spoil: of runs whose crc32 of `<doc_id>:<run>` it divides, the letter at crc32 % length is left out first (0: of none). A null doc_id
    stands as an empty string. Null and empty texts have no words.
    """
    counted = docs.select("doc_id", "text").mapInArrow(_count(least, spoil), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """The block of each row: what words share at both ends. m: letters of the longer word of a pair; a, b: shared letters; cut: pairs share fewer than so many first letters."""
    suffix = F.when(F.col("b") == 0, F.lit("")).otherwise(F.expr("right(word, b)"))
    return rows.withColumn("block", F.xxhash64("m", "a", "b", "cut", F.expr("left(word, a)"), suffix)).select("block", "m", "a", "b", "cut", "word", "n")


def _turns(whole_cut) -> F.Column:
    """Of a block's open part of R letters, the side that shares ceil((R - 1) / 2) more first letters, and that which shares as many more last ones."""
    r = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    first = F.struct((F.col("a") + r).alias("a"), F.col("b").alias("b"), whole_cut.alias("cut"))
    last = F.struct(F.col("a").alias("a"), (F.col("b") + r).alias("b"), F.least(whole_cut, F.col("a") + r).alias("cut"))
    return F.explode(F.array(first, last))


def _split(rows: DataFrame) -> DataFrame:
    out = rows.select("m", "word", "n", _turns(F.col("cut")).alias("t")).select("m", "t.a", "t.b", "t.cut", "word", "n")
    return _keyed(out.filter("a < cut"))  # else no pair can share a letters and fewer than cut


def _lengths(words: list[str]) -> tuple[np.ndarray, list[bytes]]:
    coded = [w.encode("latin-1") for w in words]
    return np.array([len(w) for w in coded], np.int64), coded


def _near(table: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of rows sorted by block, that are near: exactly one letter inserted, deleted or replaced."""
    block, m, a, b, cut = (np.array(table[c], np.int64) for c in ("block", "m", "a", "b", "cut"))
    size, coded = _lengths(table["word"])
    order = np.lexsort((cut, b, a, m, block))
    key = np.stack([block, m, a, b, cut])[:, order]
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    ends = np.repeat(np.r_[starts[1:], len(order)], np.diff(np.r_[starts, len(order)]))
    count = ends - np.arange(len(order)) - 1
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.unique(m).tolist():
        mine = np.flatnonzero((key[1] == k) & (count > 0))
        within = np.flatnonzero(key[1] == k)
        if not len(mine):
            continue
        forward = np.frombuffer(b"".join([coded[i].ljust(k, b"\0") for i in order[within]]), np.uint8).reshape(-1, k)
        backward = np.frombuffer(b"".join([coded[i].rjust(k, b"\0") for i in order[within]]), np.uint8).reshape(-1, k)[:, ::-1]
        row = np.zeros(len(order), np.int64)
        row[within] = np.arange(len(within))
        step = max(1, TILE * 16 // k)
        upto = np.r_[0, np.cumsum(count[mine])]
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + step, "right")) - 1)
            some, c = mine[at:to], count[mine[at:to]]
            i = np.repeat(some, c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            long = np.maximum(size[order[i]], size[order[j]]) == k
            i, j = i[long], j[long]
            x, y = row[i], row[j]
            head, tail = forward[x] != forward[y], backward[x] != backward[y]
            lcp = np.where(head.any(1), head.argmax(1), k)
            lcs = np.where(tail.any(1), tail.argmax(1), k)
            on = (lcp + lcs >= k - 1) & (lcp >= key[2][i]) & (lcs >= key[3][i]) & (lcp < key[4][i]) & (lcp < k)
            left.append(order[i[on]])
            right.append(order[j[on]])
            at = to
    return np.concatenate(left), np.concatenate(right)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, near_n, both ways, of whole blocks; rows come by block."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    held: list[pa.RecordBatch] = []

    def told(table: pa.Table) -> pa.RecordBatch:
        rows = table.to_pydict()
        i, j = _near(rows)
        x, y = np.r_[i, j], np.r_[j, i]
        word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        return pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), n.take(pa.array(y))], ["word", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held, schema=pa.schema([(f.name, f.type) for f in batch.schema])).select(names)
        block = table.column("block").to_numpy()
        last = int(np.flatnonzero(block != block[-1])[-1]) + 1 if (block != block[-1]).any() else 0
        if last:  # the last block may go on in the next batch
            yield told(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield told(pa.Table.from_batches(held).select(names))


def near_words(words: DataFrame, stash: Stash, limit: int = LIMIT) -> DataFrame:
    """word, near, near_n for all pairs, both ways, of distinct words (word, n) of at least three letters that are exactly one edit apart."""
    size = F.length("word")
    top = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m")).withColumns({"a": F.lit(0), "b": F.lit(0), "cut": F.col("m") + 1})
    level, done = stash.put(_split(top)), None
    while True:
        sizes = level.groupBy("block", (F.col("m") - F.col("a") - F.col("b")).alias("open")).agg(F.count("*").alias("c"))
        heavy = stash.put(sizes.filter((F.col("c") > limit) & (F.col("open") > 1)).select("block").distinct())
        light = level.join(heavy, "block", "left_anti")
        done = light if done is None else done.unionByName(light)
        if heavy.isEmpty():
            break
        level = stash.put(_split(level.join(heavy, "block", "left_semi")))
    return done.repartition("block").sortWithinPartitions("block").mapInArrow(_verify, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, spoil: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of word_counts.

    n_near: words exactly one edit apart. form: of these that with the largest n (ties: first in code-point order), where its n is at least
    `ratio` times the word's; else null, as is form_n. root: the last word on the path of forms, the word itself where it has none.
    Null, empty and letter-free texts have no words; repeated rows count each time; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "spelling")
    words = stash.put(word_counts(docs, least, least_count, spoil))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_words(words, stash).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.col("n") * ratio <= -F.col("best.less")
    told = stash.put(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    path = told.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        on = path.select(F.col("word").alias("root"), F.col("root").alias("further"))
        path = stash.put(path.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return told.join(path, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(least: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO, spoil: int = 31) -> str:
    """spelling_variants by the words with one letter left out as join keys; the crc32 bit by bit, eight steps a byte."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, translate(run, '{upper}', '{upper.lower()}') AS w, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= {least} GROUP BY ALL),
    bits AS (
      SELECT w, n, flatten(list_transform(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)), lambda b: [b, 0, 0, 0, 0, 0, 0, 0])) AS b
      FROM runs),
    hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1))), 4294967295::BIGINT) AS h FROM bits),
    spoiled AS (SELECT CASE WHEN h % {spoil} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM hashed),
    words AS (SELECT w, sum(n)::BIGINT AS n FROM spoiled WHERE length(w) >= {least} GROUP BY w HAVING sum(n) >= {least_count}),
    cut AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS k FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
    pairs AS (
      SELECT x.w AS a, y.w AS b FROM cut AS x JOIN cut AS y ON x.i = y.i AND x.k = y.k AND x.w <> y.w
      UNION SELECT x.w, v.w FROM cut AS x JOIN words AS v ON v.w = x.k UNION SELECT v.w, x.w FROM cut AS x JOIN words AS v ON v.w = x.k),
    best AS (SELECT a AS w, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM pairs JOIN words ON words.w = pairs.b GROUP BY a),
    forms AS (SELECT words.w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * words.n THEN b END AS form, CASE WHEN m >= {ratio} * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
    path AS (SELECT w, w AS at, form AS next FROM forms UNION ALL SELECT path.w, path.next, forms.form FROM path JOIN forms ON forms.w = path.next)
    SELECT forms.w AS word, form, path.at AS root, n, n_near, form_n FROM forms JOIN path ON path.w = forms.w AND path.next IS NULL"""

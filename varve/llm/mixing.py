"""Mixing sources to target weights, with DataFrame functions only.

Each source's words form one stream, cut into blocks of BLOCK_WORDS. The mix is a row of output slots in shards of SHARD_SLOTS, the unit of work.
Every slot of a shard draws a source with the sources' shares as probabilities, so a shard's source counts are a multinomial draw. Prefix sums of
the counts over the shards number each source's draws. Draws beyond a source's quota (about the square root of it) are dealt
in order to the sources that were drawn too seldom, so totals meet the quotas. A pseudorandom permutation per source and
epoch maps a source's n-th draw to a block index, and blocks are joined by (source, index). A block comes up once per
epoch, so no word is taken more often than the target's number of epochs, rounded up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD_PATTERN, Stash

BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Documents per chunk of the two-level prefix sum, on average.
CHUNK_DOCS = 512
#: Cells of the lookup of a source by its place among all slots, at least; there are about four a source at most beyond them.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def permuted(x: Column, n: Column, *seed: Column) -> Column:
    """A bijection of 0..n-1 chosen by the seed (n below 2^42): rotations by n alternate with odd multiplication and shift-xor on
    the largest power of two within n. Lambda variables stand for the steps, so that no expression is repeated."""
    bits = F.length(F.bin(n)) - 1
    size, half = F.call_function("shiftleft", F.lit(1).cast("long"), bits), F.floor(bits / 2).cast("int") + 1

    def mixed(y: Column, key: Column) -> Column:
        odd = F.shiftrightunsigned(key, 44).bitwiseOR(F.lit(1).cast("long"))
        stirred = F.transform(F.array((y * odd).bitwiseAND(size - 1)), lambda m: m.bitwiseXOR(F.call_function("shiftright", m, half)))[0]
        return F.when(y < size, stirred).otherwise(y)

    keys = F.array(*(F.xxhash64(*seed, F.lit(turn)) for turn in range(3)))
    return F.aggregate(keys, x, lambda at, key: F.transform(F.array(F.pmod(at + F.pmod(key, n), n)), lambda y: mixed(y, key))[0])


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """skey, source, source_size -> with target: weights by code-point order of source (null last), shared out to a common
    level per weight, where a source stops at cap times its size. One row per source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    full = Window.orderBy("ratio", "skey")
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = w.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    w = w.withColumn("left_over", share * F.sum("source_size").over(every) - (F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most")))
    w = w.withColumn("level", F.col("left_over") / F.sum("w").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(every)["level"]
    return w.withColumn("target", F.least(F.col("most"), F.coalesce(level * F.col("w"), F.col("most")))).select("skey", "source", "source_size", "target")


def _owners(rows: DataFrame, spans: DataFrame, at: Column, total: int, cells: int) -> DataFrame:
    """rows with the columns of the one span (first, quota) that holds `at`, a place below total. The lookup has one row per cell and span in it."""
    width = max(1, -(-total // cells))
    near = spans.filter("quota > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("quota") - 1) / width))))
    return rows.withColumn("cell", F.floor(at / width)).join(near, "cell").filter((at >= F.col("first")) & (at < F.col("first") + F.col("quota"))).drop("cell")


def plan(docs: DataFrame, stash: Stash, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share=SHARE, cap=CAP, keep: Sequence[str] = (), shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, with the columns to keep and with their place in their source's stream, sources with targets and blocks, slots with shard, source and block)."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("body"), *keep)
    chunks = max(1, docs.count() // CHUNK_DOCS)
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "body"), F.lit(chunks)).cast("int"))
    order = Window.partitionBy("skey", "chunk").orderBy("doc_id", "size", "body")
    placed = stash.put(sized.withColumn("r", F.row_number().over(order)).withColumn("local", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")).drop("body"))
    totals = placed.groupBy("skey", "source", "chunk").agg(F.sum("size").alias("words"))
    bases = totals.withColumn("base", F.sum("words").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")).select("skey", "chunk", "base")
    sources = source_targets(totals.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    blocks = F.ceil(F.col("source_size") / block_words)
    sources = sources.withColumn("blocks", blocks).withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), (cap * F.col("blocks")).cast("long"))).otherwise(F.lit(0).cast("long")))
    before = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sources = stash.put(sources.withColumn("first", F.sum("quota").over(before) - F.col("quota")))
    n, names = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    cells = max(CELLS, 4 * names)

    drawn = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64("id", F.lit("draw")), F.lit(max(1, n))).alias("at"))
    drawn = stash.put(_owners(drawn, sources.select("skey", "first", "quota"), F.col("at"), n, cells).select("shard", "slot", "skey", "quota"))
    counts = shard_counts(drawn).withColumn("earlier", F.sum("n").over(Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    inner = F.row_number().over(Window.partitionBy("shard", "skey").orderBy("slot"))
    drawn = drawn.withColumn("inner", inner).join(counts, ["shard", "skey"]).select("shard", "slot", "skey", "quota", (F.col("earlier") + F.col("inner") - 1).alias("nth"))

    met = sources.select("skey", "quota").join(counts.groupBy("skey").agg(F.sum("n").alias("hits")), "skey", "left").select("skey", "quota", F.coalesce("hits", F.lit(0)).alias("hits"))
    gaps = met.withColumn("over", F.greatest(F.col("hits") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("hits"), F.lit(0)))
    gaps = stash.put(gaps.withColumn("over_first", F.sum("over").over(before) - F.col("over")).withColumn("under_first", F.sum("under").over(before) - F.col("under")))
    spare = gaps.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    beyond = drawn.filter("nth >= quota").join(gaps.select("skey", "over_first"), "skey").select("shard", "slot", (F.col("over_first") + F.col("nth") - F.col("quota")).alias("at"))
    lacking = gaps.select("skey", "hits", F.col("under_first").alias("first"), F.col("under").alias("quota"))
    dealt = _owners(beyond, lacking, F.col("at"), spare, cells).select("shard", "slot", "skey", (F.col("hits") + F.col("at") - F.col("first")).alias("nth"))
    slots = drawn.filter("nth < quota").select("shard", "slot", "skey", "nth").unionByName(dealt).join(sources.select("skey", "blocks"), "skey")
    block = permuted(F.pmod("nth", "blocks"), F.col("blocks"), F.col("skey"), F.floor(F.col("nth") / F.col("blocks")))
    return placed.join(bases, ["skey", "chunk"]).withColumn("start", F.col("base") + F.col("local")), sources, slots.select("skey", "shard", "slot", block.alias("block"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """shard, skey, n: how many of each shard's slots each source fills."""
    return slots.groupBy("shard", "skey").agg(F.count("*").alias("n"))


def taken_words(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """placed with taken: each document's words in every drawn block, repeats counted."""
    draws = slots.groupBy("skey", "block").agg(F.count("*").alias("draws"))
    end = F.col("start") + F.col("size")
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words)))))
    pieces = pieces.withColumn("words", F.least((F.col("block") + 1) * block_words, end) - F.greatest(F.col("block") * block_words, F.col("start")))
    return pieces.join(draws, ["skey", "block"], "left").groupBy("skey", "chunk", "r").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.coalesce(F.sum(F.col("words") * F.col("draws")), F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document.

    Null texts and texts without words have size 0 and taken 0; null sources form one source, last in order; repeated rows stay
    separate documents (equal rows may swap places, with equal results as a set); an empty table gives no rows; other columns are ignored.
    """
    stash = Stash(docs.sparkSession, "mix")
    placed, sources, slots = plan(docs.select("doc_id", "source", "text"), stash, block_words, weights, share, cap)
    return taken_words(placed, slots, block_words).join(sources.select("skey", "source_size", "target"), "skey").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """The mix as rows of documents (doc_id, text, lang, source, n_chars): per document one row for each time its blocks are drawn.

    The text of a row is its drawn blocks' words in order, joined by one space; n_chars is its length. Documents of which nothing is drawn give no row.
    Rows are written once with a number; the plan moves numbers and sizes, and texts cross one shuffle, to meet their drawn parts.
    """
    stash = Stash(docs.sparkSession, "mixed")
    rows = stash.put(docs.select("doc_id", "text", "lang", "source").withColumn("row", F.monotonically_increasing_id()))  # written: the numbers must not change
    placed, _, slots = plan(rows, stash, block_words, weights, share, cap, ("row",))
    draws = slots.groupBy("skey", "block").agg(F.count("*").alias("draws"))
    end = F.col("start") + F.col("size")
    pieces = placed.filter("size > 0").select("skey", "row", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    pieces = pieces.withColumn("at", F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")).withColumn("words", F.least((F.col("block") + 1) * block_words, end) - F.col("start") - F.col("at"))
    drawn = pieces.join(draws, ["skey", "block"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "words", "draws"))).alias("parts"))
    copies = rows.join(drawn, "row").withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.col("parts.draws")))))
    words = F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))
    chosen = F.filter("parts", lambda p: p["draws"] >= F.col("turn"))
    text = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(chosen, lambda p: F.slice(w, (p["at"] + 1).cast("int"), p["words"].cast("int")))), " "))[0]
    return copies.select("doc_id", text.alias("text"), "lang", "source").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))

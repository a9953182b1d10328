"""A corpus pipeline: quality, language, near duplicates, mixing, packing. Each stage reads all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import language, mixing, packing, quality, shingle_join
from varve.llm.queries import table, tokenizer_path
from varve.llm.shared import Stash

#: Share of the letters that a document's language has at least.
LEAST_LANGUAGE = 0.25
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score reaches the threshold. Labels come from the labels table and their texts from docs."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model).filter("predicted = 1").select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one learned language has LEAST_LANGUAGE of the letters at least; texts without letters go."""
    return language.detect(docs.select(COLUMNS), language.train(docs)).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id (null last), then text. Rows are told apart by a number of
    their own, not by doc_id, so different texts under one id both stay, and documents without an id can be copies too. Texts without words all stay."""
    rows = Stash(spark, "rows").put(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))  # written: the numbers must not change
    groups = shingle_join.near_documents(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    ranks = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row").alias("rank"))  # before the join: texts stay out of its shuffle
    kept = ranks.join(groups, "row").groupBy("group").agg(F.min("rank")["row"].alias("row"))
    return rows.join(kept, "row").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's drawn words, one row per time they are drawn."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids; see packing.pack for the columns."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Classifiers and tokenizers can't be written in SQL. tests/llm/test_pipeline.py holds each stage's rows against what the stage before it kept (subsets, counts, token sums); the operators' own tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written to the shared folder and read again."""
    stash, docs = Stash(spark, "pipeline"), table(spark, sf_dir, "documents").select(COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

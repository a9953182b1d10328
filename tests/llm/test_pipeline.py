"""The pipeline's stages one by one, and its result against brute force over what the stages kept."""

import zlib

import numpy as np

import corpus_pipeline
from varve.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents").select(corpus_pipeline.COLUMNS)
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    kept = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(kept[-1], docs.schema), SF)
        assert out.columns == corpus_pipeline.COLUMNS
        kept.append(out.collect())
    ids = [{r.doc_id for r in k} for k in kept]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3] and len(ids[3]) < len(ids[2])
    clean = {d for d, q in labels.items() if q == 1 and d in ids[0]}
    assert len(clean & ids[2]) >= 0.98 * len(clean)
    assert len(ids[3]) == len(kept[3])
    rows = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(kept[-1], docs.schema), SF).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    sizes = sorted(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[-1])
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == sizes and sum(r.length for r in rows) == sum(sizes)


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, row long"


def test_stages_with_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, no rows and extra columns with clashing names."""
    docs = queries.table(spark, SF, "documents").limit(60).collect()
    some = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 0.0, 0, 0) for r in docs]
    text = some[0][1]
    odd = [(None,) * 8, (900, None, "en", "s", 0, 0.0, 0, 0), (901, "", "en", "s", 0, 0.0, 0, 0), (902, " \n", None, None, 0, 0.0, 0, 0), (903, text * 50, "en", "s", 0, 0.0, 0, 0), some[1], some[1], (None, text, "en", "s", 0, 0.0, 0, 0), (some[2][0], "a text of its own under an id that another has, with words enough", "en", "s", 0, 0.0, 0, 0)]
    for rows in (some + odd, odd, []):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, spark.createDataFrame(rows, ODD), SF)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= 2 * len(rows) * 70
        pieces = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, ODD), SF)
        assert pieces.filter("start = 0").count() == len(rows)


def test_near_duplicate_stage_tells_rows_not_ids(spark):
    words = queries.table(spark, SF, "documents").first().text
    rows = [(5, words, "en", "a", 1), (5, "another text under the same id that must stay", "en", "a", 1), (7, words, "en", "b", 1), (None, words, "fr", "c", 1), (None, "no id and no copy of this one here", "fr", "c", 1), (8, None, None, None, None), (9, "", "en", "a", 0), (7, words, "en", "b", 1)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, ODD.split(", score")[0]), SF).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([rows[i] for i in (0, 1, 4, 5, 6)], ODD.split(", score")[0]).collect())


def test_language_stage_drops_unknown_scripts(spark):
    docs = queries.table(spark, SF, "documents").select(corpus_pipeline.COLUMNS)
    more = spark.createDataFrame([(10_000, "日本語の文章です", "en", "s", 8), (10_001, "123 456", "en", "s", 7)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), SF).collect()}
    assert not kept & {10_000, 10_001} and kept == {r.doc_id for r in docs.filter("text rlike '[a-zA-Z]'").collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert rows and all(n == 1024 for s, n in total.items() if s != max(total))
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in rows) and zlib.crc32(np.zeros(0, "<u4")) == 0

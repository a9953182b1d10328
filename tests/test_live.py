"""Streams with state, late and repeated rows and restarts against their batch twins; columns chosen against shadows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions.tables import Rounds
from varve.operators import boost, kernel, wrapper
from varve.sources import io
from varve.streaming import conformal, ingest


def series(n=80, keys=("a", "b")):
    rng = np.random.default_rng(1)
    return [(k, i, 1_700_000_000 + 60 * i, None if i == 33 else float(rng.normal()), None if i == 40 else float(rng.normal(0, 0.1))) for k in keys for i in range(n)]


SCHEMA = "k string, i long, s long, y double, p double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("t", F.timestamp_seconds("s"))


def brute(rows, rule):
    """Every row's interval from the residuals before it, recomputed from scratch."""
    out, alpha, past = [], {}, {}
    for k, i, _, y, p in rows:
        a, res = alpha.setdefault(k, rule.target), past.setdefault(k, [])
        kept = sorted(res[-rule.window :])
        r = math.inf if len(kept) < rule.least else kept[min(len(kept), math.ceil((len(kept) + 1) * (1 - a))) - 1]
        out.append((k, i, None if p is None else p - r, None if p is None else p + r, a))
        if y is not None and p is not None:
            if math.isfinite(r):
                alpha[k] = min(0.99, max(0.01, a + rule.gamma * (rule.target - (abs(y - p) > r))))
            res.append(abs(y - p))
    return out


RULE = conformal.Rule(0.2, 0.05, 30, 5)


def test_conformal_stream_equals_its_batch_twin_after_a_restart(spark, tmp_path):
    rows = series()
    source, sink, check = str(tmp_path / "in"), str(tmp_path / "cover"), str(tmp_path / "check")
    got = []

    def both(batch, number):
        got.extend((r.key, r.id, r.low, r.high, r.alpha, r.late) for r in batch.collect())
        conformal.coverage_sink(sink)(batch, number)

    def go():
        stream = conformal.intervals(io.stream(spark, source, frame(spark, rows).schema, files_per_batch=1), "k", "i", "t", "y", "p", RULE)
        stream.writeStream.foreachBatch(both).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    for part in range(2):
        frame(spark, [r for r in rows if r[1] // 20 == part]).coalesce(1).write.mode("append").parquet(source)
    go()
    for part in range(2, 4):
        frame(spark, [r for r in rows if r[1] // 20 == part]).coalesce(1).write.mode("append").parquet(source)
    frame(spark, rows[5:9]).coalesce(1).write.mode("append").parquet(source)  # delivered again, late
    go()
    want = {(k, i): (low, high, a) for k, i, low, high, a in brute(sorted(rows, key=lambda r: r[1]), RULE)}
    fresh = {(k, i): (low, high, a) for k, i, low, high, a, late in got if not late}
    assert {k: pytest.approx(v) for k, v in want.items()} == fresh and sum(x[5] for x in got) == 4
    twin = {(r.key, r.id): (r.low, r.high, r.alpha) for r in conformal.intervals_batch(frame(spark, rows).repartition(3), "k", "i", "t", "y", "p", RULE).collect()}
    assert twin == {k: pytest.approx(v) for k, v in want.items()}
    cover = {r.key: (r.n, r.coverage, r.gap, r.width) for r in conformal.coverage(spark, sink, 0.2).collect()}
    for k in ("a", "b"):
        known = [(y, *want[q, i][:2]) for q, i, _, y, p in rows if q == k and y is not None and p is not None and math.isfinite(want[q, i][1])]
        share = sum(low <= y <= high for y, low, high in known) / len(known)
        assert cover[k] == pytest.approx((len(known), share, share - 0.8, sum(high - low for _, low, high in known) / len(known)))


def test_conformal_rule_at_its_ends():
    rule = conformal.Rule(0.3, 0.1, 10, 1)
    assert rule.radius([], 0.3) == math.inf and rule.radius([2.0], 0.3) == 2.0 and rule.radius([1.0, 2.0, 3.0], 0.5) == 2.0
    assert rule.step(0.05, True) == pytest.approx(0.01) and rule.step(0.95, False) == pytest.approx(0.98) and conformal.Rule(0.3, 0.1).step(0.3, True) == pytest.approx(0.23)


def test_ingest_takes_late_and_repeated_rows_once_and_goes_on(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    store = ingest.Store(spark, "file://" + str(tmp_path / "store"))
    assert store.table().count() == 0 == store.latest().count()
    make = lambda rows: spark.createDataFrame(rows, "run_id string, key string, value double, s long, step long").select("run_id", "key", "value", F.timestamp_seconds("s").alias("timestamp"), "step")
    at = 1_700_000_000
    first = [("r1", "loss", 1.0 / (1 + s), at + 60 * s, s) for s in range(10)] + [("r2", "loss", 5.0, at, 0), ("r2", "acc", None, at, 0)]
    make([*first, first[3], first[3]]).coalesce(1).write.parquet(source)
    read = lambda: io.stream(spark, source, make(first).schema)
    ingest.run(read(), store, check)
    store.compact()
    second = [("r1", "loss", 0.5, at + 60 * 20, 20), ("r1", "loss", 0.7, at + 60 * 4, 11)]  # the second comes late, within the hour
    make([*second, first[2], first[9]]).coalesce(1).write.mode("append").parquet(source)
    ingest.run(read(), store, check)
    got = Counter((r.run_id, r.key, r.value, r.step) for r in store.table().collect())
    assert got == Counter((r[0], r[1], r[2], r[4]) for r in [*first, *second])
    last = {(r.run_id, r.key): (r.value, r.step) for r in store.latest().collect()}
    assert last == {("r1", "loss"): (0.5, 20), ("r2", "loss"): (5.0, 0), ("r2", "acc"): (None, 0)}
    ingest.run(read(), store, check)  # nothing new
    last = [n for n in store._numbers("batch") if spark.read.parquet(f"{store.path}/batch={n}").count()][-1]  # batches that only move the watermark are empty
    store.sink()(make(second), last)  # a replay of the last batch replaces it
    assert Counter((r.run_id, r.key, r.value, r.step) for r in store.table().collect()) == got
    store.compact()
    assert Counter((r.run_id, r.key, r.value, r.step) for r in store.table().collect()) == got


def test_shadows_are_permutations(spark):
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(101)], "a double, b double").repartition(4)
    rows, n = wrapper.numbered(df, Rounds(spark, "t"))
    got = wrapper.shuffled(rows, ["a", "b"], n, 3).collect()
    assert n == 101 and sorted(r._i for r in got) == list(range(101))
    assert sorted(r.shadow_a for r in got) == sorted(r.a for r in got) and sum(r.a == r.shadow_a for r in got) < 20
    assert all(r.shadow_b == r.shadow_a % 5 for r in got)
    assert wrapper.at_least(0, 7) == 1 and wrapper.at_least(7, 7) == 1 / 128 and wrapper.at_least(8, 7) == 0


def test_relevant_columns_are_accepted_and_noise_is_not(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c), float(3 * (a > 0) + b)) for a, b, c in rng.normal(0, 1, (250, 3))]
    df = spark.createDataFrame([*rows, (0.0, 0.0, 0.0, None)], "a double, b double, noise double, y double").repartition(2)
    got = {r.feature: r for r in wrapper.all_relevant(df, ["a", "b", "noise"], "y", 6, 0.1, rounds=3, depth=2, bins=8, rate=0.5).collect()}
    assert got["a"].decision == got["b"].decision == "accepted" and got["a"].hits == 6 and got["noise"].decision != "accepted"
    assert {r.decision for r in wrapper.all_relevant(df.limit(0), ["a"], "y").collect()} == {"tentative"}


def test_elimination_keeps_what_predicts(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b), float(2 * (a > 0.2))) for a, b in rng.normal(0, 1, (200, 2))], "a double, noise double, y double")
    got = wrapper.eliminated(df, ["noise", "a"], "y", folds=2, rounds=2, depth=1, bins=8, rate=0.9).orderBy("size").collect()
    assert [(r.size, r.dropped, r.best) for r in got] == [(1, "a", True), (2, "noise", False)]


def test_binned_columns_give_the_same_trees(spark):
    rows = [(float(i % 7), None if i % 5 == 0 else float(i * 37 % 101), float(i % 7 * 3 + (i * 37 % 101 > 50))) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    edges = dict(zip("ab", boost.bin_edges(df, ["a", "b"], 8), strict=True))
    plain = boost.fit(df, ["a", "b"], "y", rounds=3, depth=3, edges=edges)
    binned = boost.fit(boost.as_bins(df, edges, ["y"]), ["a", "b"], "y", rounds=3, depth=3, edges=edges, binned=True)
    assert [{n: s[:2] for n, s in t.items()} for t in plain.splits] == [{n: s[:2] for n, s in t.items()} for t in binned.splits]
    assert plain.importance() == pytest.approx(binned.importance())


def test_exchanges_share_a_pass(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.standard_normal((90, 3)))], "_i long, x double, y double, z double")
    moved = df
    for k in range(2):
        moved = wrapper.shuffled(moved, ["y"], 90, k, f"shadow{k}_", df)
    scale = {"x": 1.0, "y": 1.3, "z": 0.7}
    got = kernel.exchanged_products(moved, [["x"], ["y"], ["z"]], 2, scale, 8, 1)
    for k in range(2):
        s = kernel.products(moved, [["x"], [f"shadow{k}_y"], ["z"]], scale | {f"shadow{k}_y": 1.3}, 8, 1)[1]
        assert np.allclose(got[k][:8], s[:8, 8:16]) and np.allclose(got[k][8:], s[16:, 8:16])

"""Operators without SQL of their own against brute force: quantiles, chains, calibration, partial autocorrelation, the run store's lists."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions.quantiles import column_percentiles
from varve.operators import calibrate, chain, diagnose, features, generate, mining, signal, tracker


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [1.0, 2.0], np.random.default_rng(1).normal(0, 1, 900).round(2).tolist(), [5.0] * 700 + [1.0, 9.0], [None, 3.0, None, 4.0]])
def test_exact_percentiles(spark, values):
    q = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = column_percentiles(spark.createDataFrame([(v, None) for v in values], "x double, y double").repartition(3), ["x", "y"], q).first()
    assert got.x == pytest.approx(np.quantile([v for v in values if v is not None], q)) and got.y is None


def table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v) if i % 7 else None, float(math.exp(v)), "abc"[i % 3] if i % 5 else None) for i, v in enumerate(rng.normal(1, 2, 300))]
    return spark.createDataFrame(rows, "id long, a double, b double, c string")


def test_chain_learns_from_train_rows_only_and_can_be_undone(spark):
    d = table(spark)
    train = d.filter("id < 200")
    steps = chain.Chain(chain.Impute(["a"], "median"), chain.Log(["b"]), chain.Scale(["a", "b"], "robust"), exclude=["id"]).fit(train)
    a = np.array([r.a for r in train.collect() if r.a is not None])
    fill = np.median(a)
    assert steps.steps[0].state["a"]["fill"] == pytest.approx(fill) and steps.steps[1].state["b"]["on"]
    filled = np.array([fill if r.a is None else r.a for r in train.orderBy("id").collect()])
    lo, mid, hi = np.quantile(filled, [0.05, 0.5, 0.95])
    out = {r.id: r for r in steps.transform(d).collect()}
    for r in d.collect():
        assert out[r.id].a == pytest.approx(((fill if r.a is None else r.a) - mid) / (hi - lo))
    saved = chain.Chain.from_json(steps.to_json())
    back = {r.id: r for r in saved.inverse(saved.transform(d)).collect()}
    low = min(r.b for r in train.collect())
    for r in d.collect():
        assert back[r.id].a == pytest.approx(fill if r.a is None else r.a)
        if r.b >= low:
            assert back[r.id].b == pytest.approx(r.b, rel=1e-6)


def test_chain_refuses_misuse(spark):
    with pytest.raises(ValueError):
        chain.Scale(["a"]).transform(table(spark))
    with pytest.raises(ValueError):
        chain.Chain(chain.Scale(["a"]), exclude=["a"])
    hot = chain.OneHot(["c"]).fit(table(spark))
    assert {c for c in hot.transform(table(spark)).columns if c.startswith("c")} == {"c_a", "c_b", "c_c"}
    with pytest.raises(NotImplementedError):
        hot.inverse(table(spark))
    empty = chain.Chain(chain.Impute(["a"]), chain.Scale(["a"])).fit(table(spark).limit(0))
    assert empty.transform(table(spark)).count() == 300


def test_pacf_equals_the_equations_solution(spark):
    rng = np.random.default_rng(3)
    y = [0.0]
    for e in rng.normal(0, 1, 199):
        y.append(0.7 * y[-1] + e)
    d = np.array(y) - np.mean(y)
    acf = [float(d[k:] @ d[: len(d) - k] / (d @ d)) for k in range(1, 21)]
    want = []
    for k in range(1, 21):
        r = np.array([1.0, *acf])
        want.append(np.linalg.solve(r[np.abs(np.subtract.outer(range(k), range(k)))], r[1 : k + 1])[-1])
    assert diagnose.durbin_levinson(acf) == pytest.approx(want)
    got = diagnose.partial_autocorrelations(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)] + [(2, i, 1.0) for i in range(10)], "k long, i long, y double"), ["k"], ["i"], "y").collect()
    by = {r.k: r for r in got}
    assert by[1].pacf == pytest.approx(want) and by[1].strong == sum(abs(v) > 0.2 for v in want) and by[2].strong == 0


def test_platt_and_temperature(spark):
    rng = np.random.default_rng(4)
    s = rng.normal(0, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * s - 0.5)))
    d = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    a, b = calibrate.platt(d, "s", "y")
    assert a == pytest.approx(1.5, abs=0.15) and b == pytest.approx(-0.5, abs=0.15)
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs(((p - y) * s).sum()) < 1e-3 and abs((p - y).sum()) < 1e-3  # the gradient vanishes
    t = calibrate.temperature(d, "s", "y")
    loss = lambda x: float(np.mean(np.logaddexp(0, s / x) - y * s / x))
    assert loss(t) <= min(loss(t * 1.02), loss(t / 1.02))


@pytest.mark.parametrize("key", tracker.LESS_IS_BETTER)
def test_less_is_better_by_name(spark, key):
    m = spark.createDataFrame([("r1", f"val_{key.upper()}", 2.0, "t", 1), ("r1", f"val_{key.upper()}", 9.0, "t", 0), ("r2", f"val_{key.upper()}", 1.0, "t", 1)], "run_id string, key string, value double, timestamp string, step long")
    runs = spark.createDataFrame([("r1", "a", "FINISHED"), ("r2", "b", "FINISHED")], "run_id string, name string, status string")
    assert tracker.best_runs(m, runs).first().run_id == "r2"


def test_more_is_better_and_preference(spark):
    names = ["accuracy", "latency", "time", "custom"]
    m = spark.createDataFrame([(r, k, v, "t", 1) for k in names for r, v in (("r1", 2.0), ("r2", 1.0))], "run_id string, key string, value double, timestamp string, step long")
    runs = spark.createDataFrame([("r1", "a", "FINISHED"), ("r2", "b", "FINISHED")], "run_id string, name string, status string")
    assert {r.run_id for r in tracker.best_runs(m, runs).collect()} == {"r1"}
    for i, name in enumerate(tracker.PREFERRED):
        rest = spark.createDataFrame([("r", k, 1.0) for k in ("aaa", *tracker.PREFERRED[i:])], "run_id string, key string, value double")
        assert tracker.primary_metric(rest).first().key == name


def test_upsert_keeps_the_last_of_equal_keys(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    new = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 1)], "k string, v long, at long")
    assert sorted(map(tuple, tracker.upsert(old, new, ["k"], "at").collect())) == [("a", 7), ("b", 2), ("c", 9)]


def test_autolog_writes_runs(spark, tmp_path):
    @tracker.autolog(f"file://{tmp_path}", "fit")
    def fit(x, rate=0.1):
        if x < 0:
            raise ValueError
        return {"loss": x * rate}

    assert fit(2) == {"loss": 0.2}
    with pytest.raises(ValueError):
        fit(-1)
    runs = spark.read.parquet(f"file://{tmp_path}/runs")
    assert sorted(r.status for r in runs.collect()) == ["FAILED", "FINISHED"]
    assert spark.read.parquet(f"file://{tmp_path}/metrics").first().value == pytest.approx(0.2) and spark.read.parquet(f"file://{tmp_path}/params").count() == 2


def test_fractal_dimensions():
    flat, noise = np.linspace(0, 1, 200), np.random.default_rng(5).normal(0, 1, 400)
    assert signal.katz(flat) == pytest.approx(1, abs=0.01) and signal.petrosian(flat) == 1 and signal.higuchi(flat) == pytest.approx(1, abs=0.05)
    assert signal.higuchi(noise) == pytest.approx(2, abs=0.1) and 1 < signal.katz(noise) <= 2 and signal.petrosian(noise) > 1
    assert all(f(np.zeros(5)) == 1 for f in (signal.katz, signal.petrosian, signal.higuchi))


def test_copula_mi_of_normals(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 3000)
    y = 0.8 * x + 0.6 * rng.normal(0, 1, 3000)
    got = diagnose.copula_mi(spark.createDataFrame([(float(math.exp(a)), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y").first().mi
    assert got == pytest.approx(-0.5 * math.log(1 - 0.64), abs=0.05)
    z = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.999)], "p double").select(diagnose.gaussian_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in z] == pytest.approx([-3.090232, -2.053749, -0.524401, 0, 1.281552, 3.090232], abs=1e-5)


def test_series_fourier_finds_the_frequency(spark):
    d = spark.createDataFrame([(k, i, math.sin(2 * math.pi * (k + 2) * i / 60)) for k in range(2) for i in range(60)], "k long, i long, y double")
    for r in features.series_fourier(d, ["k"], "i", "y", 1).collect():
        assert r.sin_0 == pytest.approx(math.sin(2 * math.pi * (r.k + 2) * r.i / 60), abs=1e-9)


def test_kmeans_bins_and_regimes(spark):
    d = spark.createDataFrame([(float(v),) for v in [*range(10), *range(100, 110), *range(500, 505)]], "x double")
    assert [tuple(r) for r in features.kmeans_bins(d, "x", 3).groupBy("bin").count().orderBy("bin").collect()] == [(0, 10), (1, 10), (2, 5)]
    a, b = (sorted(map(tuple, generate.regime_panel(spark, 3, 50, 1).repartition(n).collect())) for n in (1, 4))
    assert a == b and len(a) == 150 and {r[2] for r in a} <= {0, 1}


def test_sketches_are_close(spark):
    got = mining.sketches(spark.range(20_000).select(F.col("id").cast("double").alias("x")), ["x"]).first()
    assert abs(got.distinct - 20_000) < 1000 and abs(got.median - 10_000) < 100

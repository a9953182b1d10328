"""Searches and tests across groups and series against brute force and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import conformal, encode, explore, partition, signal


@pytest.mark.parametrize("f", [0.01, 0.3, 1.0, 2.5, 40.0])
def test_f_tail_has_its_closed_forms(f):
    for d in (1, 3, 10, 57):
        assert explore.f_tail(f, 2, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2))
        assert explore.f_tail(1 / f, d, 2) == pytest.approx(1 - (1 + 2 * f / d) ** (-d / 2))
    assert explore.f_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)))
    assert explore.f_tail(f, 7, 7) + explore.f_tail(1 / f, 7, 7) == pytest.approx(1)


def test_change_points_of_series_with_nulls_and_short_ones(spark):
    rows = [("a", i, 1.0 if i < 50 else 4.0) for i in range(100)] + [("a", 200 + i, None) for i in range(5)] + [("b", i, float(i)) for i in range(20)]
    got = partition.change_points(spark.createDataFrame(rows, "k string, i long, v double"), "k", "i", "v").collect()
    assert [tuple(r) for r in got] == [("a", 50, pytest.approx(1.0), pytest.approx(4.0), pytest.approx(3.0))]


@pytest.mark.parametrize("block", [1024, 50])
def test_nearest_windows_and_motifs_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 200)
    x[150:170] = x[30:50]
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("a", 900, None)] + [("b", i, float(v)) for i, v in enumerate(x[:39])] + [("c", i, 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(3)
    z = (x - x.mean()) / x.std()
    every = {(i, j): math.dist(z[i : i + 20], z[j : j + 20]) for i in range(181) for j in range(181) if abs(i - j) >= 20}
    want = {i: min(every[i, j] for j in range(181) if (i, j) in every) for i in range(181)}
    got = {r.i: (r.j, r.d) for r in explore.nearest_windows(df, "k", "i", "v", 20, block=block).collect() if r.k == "a"}
    assert {i: d for i, (_, d) in got.items()} == {i: pytest.approx(d, abs=1e-7) for i, d in want.items()}
    assert all(every[i, j] == pytest.approx(d, abs=1e-7) for i, (j, d) in got.items())
    found = explore.motifs(df, "k", "i", "v").orderBy("rank").collect()
    assert [tuple(r)[:4] for r in found[:1]] == [("a", 1, 30, 150)] and found[0].distance == pytest.approx(0, abs=1e-6) and len(found) in (2, 3)
    taken = [p for r in found for p in (r.at, r.match)]
    assert all(abs(p - q) >= 20 for i, p in enumerate(taken) for q in taken[i + 1 :])
    second = min(d for i, (j, d) in got.items() if all(abs(p - q) >= 20 for p in (i, j) for q in (30, 150)))
    assert found[1].distance == pytest.approx(second)


def test_a_motif_is_found_however_long_the_series(spark):
    rng = np.random.default_rng(12)
    for n in (499, 500, 2101):
        x = rng.normal(0, 1, n)
        x[n - 31 : n - 11] = x[17:37]
        got = explore.motifs(spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double"), "k", "i", "v", top=1).first()
        assert (got.at, got.match) == (17, n - 31)


def test_dispersion_entropy_and_coarse_means():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 500)
    z = (x - x.mean()) / x.std()
    level = [min(3, int((1 + math.erf(v / math.sqrt(2))) / 2 * 4)) for v in z]
    seen: dict = {}
    for p in zip(level, level[1:], strict=False):
        seen[p] = seen.get(p, 0) + 1 / 499
    assert explore.dispersion_entropy(x, 2, 4) == pytest.approx(-sum(p * math.log(p) for p in seen.values()) / math.log(16))
    assert explore.dispersion_entropy(np.ones(50)) == 0 == explore.dispersion_entropy(x[:2])
    assert explore.coarse(np.arange(7.0), 3).tolist() == [1.0, 4.0]


def test_granger_sees_the_direction_that_was_planted(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 300)
    y = np.concatenate([[0, 0], 0.9 * x[:-2]]) + rng.normal(0, 0.3, 300)
    rows = [("a", i, float(x[i]), float(y[i])) for i in range(300)] + [("a", 400, None, 1.0)] + [("b", i, float(i), 1.0) for i in range(10)]
    got = {r.k: r for r in explore.granger(spark.createDataFrame(rows, "k string, i long, x double, y double"), "k", "i", "x", "y").collect()}
    assert got["a"].n == 300 and got["a"].forward_lag == 2 and got["a"].forward_p < 1e-20 and got["a"].backward_p > 1e-4
    assert (got["b"].forward_lag, got["b"].forward_p, got["b"].both_ways) == (0, 1.0, False)


def test_phase_finds_the_shift(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 120)
    rows = [("p", i, float(x[i])) for i in range(120)] + [("q", i, float(x[i + 4] if i < 116 else 0)) for i in range(120)]
    got = explore.phase(spark.createDataFrame(rows, "k string, i long, v double"), "k", "i", "v", 12).collect()
    assert [(r.a, r.b, r.lag, r.aligned) for r in got] == [("p", "q", 4, True)]


def test_copod_of_ties_and_nulls(spark):
    rows = [(i, float(i % 4) if i % 9 else None) for i in range(60)]
    got = {r.i: r.score for r in explore.copod(spark.createDataFrame(rows, "i long, v double").repartition(3), ["v"]).collect()}
    v = np.array([x for _, x in rows if x is not None])
    skew = ((v - v.mean()) ** 3).mean()
    for i, x in rows:
        a, b = (0.0, 0.0) if x is None else (-math.log((v <= x).mean()), -math.log((v >= x).mean()))
        assert got[i] == pytest.approx(max(a, b, a if skew < 0 else b), abs=1e-12)


def test_shimazaki_counts_as_numpy_does(spark):
    v = np.random.default_rng(8).normal(0, 1, 400)
    got = {r.bins: r for r in explore.shimazaki(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 4, 20).collect()}
    cost = {}
    for k in range(4, 21):
        n = np.histogram(v, bins=k)[0]
        cost[k] = (2 * n.mean() - n.var()) / (np.ptp(v) / k) ** 2
        assert got[k].cost == pytest.approx(cost[k])
    assert [k for k, r in got.items() if r.best] == [min(cost, key=cost.get)]
    assert explore.shimazaki(spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double"), "v").count() == 0


def test_welch_anova_and_schemes(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 9.0), ("c", 5.0), ("d", 2.0), ("d", 2.0), (None, None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = explore.welch_anova(d, "g", "v").first()
    a, b = np.array([1.0, 2, 4]), np.array([3.0, 9])
    t = (a.mean() - b.mean()) ** 2 / (a.var(ddof=1) / 3 + b.var(ddof=1) / 2)
    assert (got.k, got.df1) == (2, 1) and got.statistic == pytest.approx(t)
    assert explore.welch_anova(d.filter("g = 'a'"), "g", "v").first().statistic is None
    s = spark.range(30).select("id", (F.col("id") % 7).alias("snip"), F.when(F.col("id") != 4, F.col("id") % 5).alias("params"))
    rows = [("baseline", "snip", 1.0), ("baseline", "params", -0.5), ("signs", "snip", 1.0), ("signs", "params", -1.0), ("only", "params", -0.5)]
    agree = {r.scheme: r for r in explore.scheme_agreement(s, "id", spark.createDataFrame(rows, "scheme string, metric string, weight double"), 5).collect()}
    value = lambda r, w: sum((getattr(r, m) or 0) * v for n, m, v in rows if n == w)
    order = {w: [r.id for r in sorted(s.collect(), key=lambda r: (-value(r, w), r.id))] for w in ("baseline", "signs", "only")}
    for w, ids in order.items():
        place = np.array([[ids.index(i), order["baseline"].index(i)] for i in range(30)])
        assert agree[w].spearman == pytest.approx(np.corrcoef(place.T)[0, 1]) and agree[w].overlap == len({*ids[:5]} & {*order["baseline"][:5]}) / 5


def test_butterworth_has_its_frequency_response():
    t = np.arange(4000)
    for f in (0.02, 0.1, 0.2, 0.35):  # in cycles a step; cut 0.2 is 0.1 cycles a step
        gain = 1 / (1 + (math.tan(math.pi * f) / math.tan(math.pi * 0.1)) ** 6)
        out = signal.butterworth(np.sin(2 * np.pi * f * t))
        assert math.sqrt(2 * (out[500:-500] ** 2).mean()) == pytest.approx(gain, abs=2e-3)  # the amplitude; no sample need hit the peak
    assert signal.butterworth(np.full(9, 3.0)) == pytest.approx(3.0) and signal.butterworth(np.arange(50.0)) == pytest.approx(np.arange(50.0), abs=0.2)
    assert signal.butterworth(np.array([1.0, 4.0])).shape == (2,)


def test_non_local_means_equal_brute_force():
    x = np.random.default_rng(9).normal(0, 1, 60).round(1)
    noise = np.median(np.abs(np.diff(x))) / (0.6745 * math.sqrt(2))
    p = np.pad(x, 2, mode="symmetric")
    want = []
    for i in range(60):
        near = range(max(0, i - 20), min(60, i + 21))
        w = [math.exp(-max(((p[i : i + 5] - p[j : j + 5]) ** 2).mean() - 2 * noise**2, 0) / noise**2) for j in near]
        want.append(np.dot(w, x[list(near)]) / sum(w))
    assert signal.non_local_means(x) == pytest.approx(want)
    assert signal.non_local_means(np.ones(5)).tolist() == [1.0] * 5


def test_encoders_are_chosen_by_categories_and_target(spark):
    d = spark.range(400).select((F.col("id") % 5).alias("few"), (F.col("id") % 40).alias("some"), F.col("id").alias("each"), F.when(F.col("id") % 2 == 0, "x").alias("gap"), (F.col("id") % 40).alias("y"), F.lit(1.0).alias("flat"))
    cols = ["few", "some", "each", "gap"]
    pick = lambda *a, **k: {r.feature: (r.categories, r.strategy) for r in encode.choose(d, cols, *a, **k).collect()}
    assert pick("y") == {"few": (5, "onehot"), "some": (40, "target_kfold"), "each": (400, "target_kfold"), "gap": (2, "onehot")}
    assert pick() == pick("flat") == {"few": (5, "onehot"), "some": (40, "freq"), "each": (400, "freq"), "gap": (2, "onehot")}
    assert pick(tree=True) == {"few": (5, "onehot"), "some": (40, "ordinal"), "each": (400, "freq"), "gap": (2, "onehot")}


def test_aggregated_radius_equals_a_loop(spark):
    rng = np.random.default_rng(10)
    rows = [("a", i, bool(rng.random() < 0.4), float(rng.random())) for i in range(90)] + [("b", 1, None, None), ("c", 1, True, 0.5)]
    got = {r.k: r.radius for r in conformal.aggregated_radius(spark.createDataFrame(rows, "k string, i long, miss boolean, r double").repartition(4), ["k"], ["i"], "miss", "r", 0.1, [0.005, 0.05], 40).collect()}
    held, radii = sorted(r for k, _, _, r in rows[50:90]), []
    for g in (0.005, 0.05):
        alpha = 0.1
        for _, _, miss, _ in rows[:90]:
            alpha = min(0.99, max(0.01, alpha + g * (0.1 - miss)))
        level = min(1, math.ceil(41 * (1 - alpha)) / 40)
        radii.append(held[math.ceil(level * 39)])
    assert got["a"] == pytest.approx(np.mean(radii)) and got["b"] is None and got["c"] == 0.5

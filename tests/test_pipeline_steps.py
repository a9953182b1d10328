"""Feature chains, choice of columns, cluster counts, detectors and ensemble intervals against brute force."""

import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varve.operators import chain, configure, conformal, detector, features, mining, select
from varve.operators.series import Series


def series(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [n, n // 2, 1]), "v": rng.standard_normal(n + n // 2 + 1) + 5})
    frame["t"] = frame.groupby("k").cumcount()
    return frame, spark.createDataFrame(frame)


def numbers(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    a, b, c = rng.standard_normal(n), rng.standard_normal(n), rng.standard_normal(n)
    frame = pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "twin": a * 2 + 0.01 * c, "flat": 1.0, "y": a + 2 * b + 0.1 * rng.standard_normal(n)})
    return frame, spark.createDataFrame(frame)


def test_series_steps_and_their_undoing(spark):
    frame, df = series(spark)
    at = (["k"], ["t"])
    steps = chain.Chain(chain.Smooth(["v"], *at, width=5), chain.Difference(["v"], *at, lag=3), chain.Lags(["v"], *at, lags=[1, 2])).fit(df)
    got = steps.transform(df).toPandas().sort_values(["k", "t"])
    smooth = frame.groupby("k")["v"].transform(lambda s: s.rolling(5, center=True, min_periods=1).mean())
    diff = smooth.groupby(frame["k"]).diff(3)
    assert np.allclose(got["v"], diff, equal_nan=True) and np.allclose(got["v_lag_2"], diff.groupby(frame["k"]).shift(2), equal_nan=True)
    back = steps.inverse(steps.transform(df))
    assert sorted(back.columns) == ["k", "t", "v"]
    assert np.allclose(back.toPandas().sort_values(["k", "t"])["v"], smooth)
    for bad in (lambda: chain.Smooth(["v"], *at, width=4), lambda: chain.Difference(["v"], *at, lag=0)):
        with pytest.raises(ValueError):
            bad()
    assert steps.transform(df.limit(0)).count() == 0


def test_chain_keeps_exclusions_when_saved(spark):
    _, df = numbers(spark)
    steps = chain.Chain(chain.Generate(["a", "b"]), chain.Prune(threshold=0.95), exclude=["id", "y"]).fit(df)
    saved = chain.Chain.from_json(steps.to_json())
    assert saved.exclude == ["id", "y"] and saved.transform(df).columns == steps.transform(df).columns
    assert {"id", "y"} <= set(saved.transform(df).columns) and "id" not in saved.steps[1].state["kept"]
    with pytest.raises(ValueError):
        chain.Chain.from_json(json.dumps({"exclude": ["a"], "steps": json.loads(steps.to_json())["steps"]}))
    old = chain.Chain.from_json(json.dumps(json.loads(chain.Chain(chain.Scale(["a"])).fit(df).to_json())["steps"]))
    assert old.exclude == [] and old.transform(df).count() == 400
    with pytest.raises(NotImplementedError):
        steps.inverse(df)


def test_generated_columns(spark):
    df = spark.createDataFrame([(2.0, 4.0), (3.0, 0.0), (None, 1.0)], "a double, b double")
    steps = chain.Chain(chain.Generate(["a", "b"])).fit(df)
    rows = steps.transform(df).collect()
    assert [(r.a_times_b, r.a_over_b) for r in rows] == [(8.0, 0.5), (0.0, None), (None, None)]
    assert steps.inverse(steps.transform(df)).columns == ["a", "b"]
    parts = chain.Chain(chain.TimeParts(["t"]))
    times = spark.sql("select timestamp'2024-02-29 23:00:00' as t union all select null")
    made = parts.fit_transform(times)
    assert len(made.columns) > 1 and made.count() == 2 and parts.inverse(made).columns == ["t"]


def binned(x, bins):
    cuts = np.unique(np.quantile(x[~np.isnan(x)], [i / bins for i in range(1, bins)]))
    return np.where(np.isnan(x), -1, np.searchsorted(cuts, x, side="left"))


def information(a, b):
    keep = (a >= 0) & (b >= 0)
    a, b = a[keep], b[keep]
    n = len(a)
    table = pd.crosstab(a, b).to_numpy() / n if n else np.zeros((1, 1))
    outer = table.sum(1, keepdims=True) @ table.sum(0, keepdims=True)
    on = table > 0
    return float((table[on] * np.log(table[on] / outer[on])).sum())


def test_relevance_with_folds_equals_tables(spark):
    frame, _ = numbers(spark)
    frame.loc[::7, "c"] = np.nan
    frame["label"] = np.where(frame["b"] > 0.5, "high", np.where(frame["b"] < -0.5, "low", "mid"))
    frame["fold"] = frame["id"] % 4
    df = spark.createDataFrame(frame)
    for target in ("y", "label"):
        got = {r.feature: r for r in select.relevance(df, ["a", "b", "c", "flat"], target, 8, F.col("fold"), 0.1).collect()}
        for c in ("a", "b", "c", "flat"):
            a = binned(frame[c].to_numpy(), 8)
            y = binned(frame["y"].to_numpy(), 8) if target == "y" else frame["label"].astype("category").cat.codes.to_numpy()
            parts = [information(a[frame["fold"] != k], y[frame["fold"] != k]) for k in range(4)]
            assert got[c].mi == pytest.approx(information(a, y), abs=1e-9)
            assert got[c].mean == pytest.approx(np.mean(parts), abs=1e-9) and got[c].low == pytest.approx(min(parts), abs=1e-9)
            assert got[c].stable == np.mean([p >= 0.1 for p in parts])
    assert [r.mi for r in select.relevance(df.limit(0), ["a", "b"], "y").collect()] == [0.0, 0.0]
    assert all(0 <= r.stable <= 1 for r in select.relevance(df, ["a", "b"], "y", folds=3).collect())


def test_prune_keeps_the_preferred_column(spark):
    frame, df = numbers(spark)
    by_variance = chain.Prune(["a", "b", "c", "twin"]).fit(df)
    assert by_variance.kept == ["b", "c", "twin"]  # twin varies more than a
    by_target = chain.Prune(["a", "b", "c", "twin", "flat"], target="y", relation="information", bins=8, threshold=0.8).fit(df)
    mi = {c: information(binned(frame[c].to_numpy(), 8), binned(frame["y"].to_numpy(), 8)) for c in ("a", "twin")}
    lost = min(mi, key=mi.get) if mi["a"] != mi["twin"] else "twin"
    assert set(by_target.kept) == {"a", "b", "c", "twin", "flat"} - {lost}
    pair = {(r.feature_a, r.feature_b): r.value for r in select.dependence(df, ["a", "twin", "flat"], "information", 8).collect()}
    x, y = binned(frame["a"].to_numpy(), 8), binned(frame["twin"].to_numpy(), 8)
    assert pair["a", "twin"] == pytest.approx(information(x, y) / min(information(x, x), information(y, y))) and pair["a", "flat"] == 0
    assert chain.Prune(["a", "b", "c", "twin"], threshold=0.0, least=2).fit(df).kept == ["b", "twin"]


def test_choose_ways(spark):
    _, df = numbers(spark)
    told = chain.Choose("y", ["a", "b", "c", "flat"], k=2).fit(df)
    assert told.kept == ["a", "b"] and told.top(1) == ["b"] and told.transform(df).columns == ["id", "a", "b", "twin", "y"]
    assert chain.Choose("y", ["a", "b", "c"], folds=4, threshold=0.05, bins=4).fit(df).kept == ["a", "b"]
    mrmr = chain.Choose("y", ["a", "b", "twin"], by="mrmr", k=2).fit(df).kept
    assert "b" in mrmr and len(mrmr) == 2 and set(mrmr) != {"a", "twin"}
    model = {"rounds": 4, "depth": 3, "bins": 8}
    least = chain.Choose("y", ["a", "b", "flat"], by="auto", model=model).fit(df)
    assert {"a", "b"} <= set(least.kept) and least.way(df, ["a"]) == "elimination" and least.way(df, ["a"] * 13) == "information"
    assert chain.Choose("y", ["flat"], least=1).fit(df).kept == ["flat"] and chain.Choose("y", ["flat"]).fit(df).kept == []
    with pytest.raises(ValueError):
        chain.Choose("y", by="guess")


def test_silhouettes_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((40, 2)) + m for m in ((0, 0), (8, 0), (0, 8))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["p", "q"]))
    got = {r.k: r for r in select.cluster_counts(df, ["p", "q"], [2, 3, 5]).collect()}
    assert [k for k, r in got.items() if r.best] == [3]
    v = (x - x.mean(0)) / x.std(0, ddof=1)
    c = np.repeat([0, 1, 2], 40)
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    s = []
    for i in range(len(v)):
        a = d[i, (c == c[i])].sum() / 39
        b = min(d[i, c == k].mean() for k in range(3) if k != c[i])
        s.append((b - a) / max(a, b))
    assert got[3].silhouette == pytest.approx(np.mean(s)) and got[3].cost < got[2].cost
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "p double, q double")
    assert select.cluster_counts(same, ["p", "q"], [2]).first().silhouette == 0


def test_clusters_do_not_depend_on_how_rows_are_dealt(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(np.round(rng.random((400, 2)), 2), columns=["p", "q"])
    frame = pd.concat([frame, frame.iloc[:150], frame.iloc[:60]])
    one = select.cluster_counts(spark.createDataFrame(frame).repartition(2), ["p", "q"], [2, 4]).collect()
    other = select.cluster_counts(spark.createDataFrame(frame.iloc[::-1]).repartition(9, "q"), ["p", "q"], [2, 4]).collect()
    for a, b in zip(one, other, strict=True):
        assert (a.k, a.best) == (b.k, b.best) and a.cost == pytest.approx(b.cost, rel=1e-9) and a.silhouette == pytest.approx(b.silhouette, rel=1e-9)
    x = frame.to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    start = min((x[rng.choice(len(x), 4, replace=False)] for _ in range(40)), key=lambda c: ((x[:, None] - c) ** 2).sum(2).min(1).sum())
    for _ in range(20):
        near = ((x[:, None] - start) ** 2).sum(2).argmin(1)
        start = np.array([x[near == k].mean(0) for k in range(4)])
    assert one[1].cost <= ((x[:, None] - start) ** 2).sum(2).min(1).mean() * 1.25


def test_correlations_take_one_pass_of_products(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame(rng.standard_normal((300, 3)), columns=["a", "b", "c"]) * 1e-3 + 1e4
    frame["flat"], frame["late"] = 0.1, [None] * 298 + [1.0, 2.0]
    frame.loc[::7, "b"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double, flat double, late double").repartition(4)
    one = {(r.feature_a, r.feature_b): r.value for r in select.correlations(df, list(frame)).collect()}
    other = {(r.feature_a, r.feature_b): r.value for r in mining.pearson(df, list(frame)).collect()}
    assert one.keys() == other.keys() and all(one[p] == pytest.approx(other[p], abs=1e-6) for p in one)
    plan = select.dependence(df, list(frame))._jdf.queryExecution().toString()
    assert "covar" not in plan  # no aggregate a pair


def brute_detector(frame, width, contamination, z):
    low, mid, high = np.percentile(frame["v"].dropna(), [5, 50, 95])
    windows = {}
    for _, part in frame.groupby("k"):
        v = ((part["v"] - mid) / (high - low)).ffill().to_numpy()
        for i in range(width - 1, len(v)):
            w = v[i - width + 1 : i + 1]
            if not np.isnan(w).any():
                windows[part.index[i]] = w
    x = np.array(list(windows.values()))
    cov = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(int(np.argmax(np.cumsum(values) / values.sum() >= 0.9)) + 1, width - 1)
    centred = x - x.mean(0)
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(len(x)), x[:, :-1]], x[:, -1], rcond=None)
    error = x[:, -1] - np.c_[np.ones(len(x)), x[:, :-1]] @ beta
    scores = {
        "distance": ((centred / x.std(0)) ** 2).mean(1),
        "components": ((centred - centred @ vectors[:, :k] @ vectors[:, :k].T) ** 2).mean(1),
        "forecast": np.abs(error) / np.sqrt((error**2).mean()),
    }
    labels = {}
    for name, s in scores.items():
        m, q = np.median(s), np.quantile(s, 1 - contamination)
        labels[name] = s > max(q, m + z * 1.4826 * np.median(np.abs(s - m)))
    return list(windows), scores, labels


def test_detector_equals_numpy(spark):
    frame, _ = series(spark, 120)
    frame.loc[[5, 6, 50, 125], "v"] = np.nan
    frame.loc[[70, 150], "v"] = 40.0
    fitted = detector.Detector(["k"], ["t"], "v", 5, contamination=0.02).fit(spark.createDataFrame(frame))
    out = detector.Detector.from_json(fitted.to_json()).predict(spark.createDataFrame(frame)).toPandas()
    out = out.merge(frame.reset_index()[["index", "k", "t"]], on=["k", "t"]).set_index("index").sort_index()
    rows, scores, labels = brute_detector(frame, 5, 0.02, 3.5)
    for name in scores:
        assert np.allclose(out.loc[rows, f"score_{name}"], scores[name], atol=1e-6)
        assert (out.loc[rows, f"label_{name}"] == labels[name]).all()
    votes = sum(v.astype(int) for v in labels.values())
    assert (out.loc[rows, "label"] == (votes > 1.5)).all() and out.loc[70, "label"] == 1 and out.loc[150, "label"] == 1
    rest = out.drop(index=rows)
    assert len(rest) == 9 and rest["score_distance"].isna().all() and (rest["label"] == 0).all()  # four starts of two series, the series of one row


def test_detector_registry_and_misuse(spark):
    @detector.register_scorer("level")
    class Level(detector.Scorer):
        def learn(self, n, mean, second):
            return {"at": float(mean.mean())}

        def score(self, x, state):
            return F.abs(x[0] - F.lit(state["at"]))

    try:
        frame, df = series(spark)
        for scale in ("standard", "minmax", "none"):
            assert detector.Detector(["k"], ["t"], "v", 3, ["level"], scale=scale, rule="any").fit_predict(df).filter("score_level is not null").count() == len(frame) - 5
        with pytest.raises(ValueError):
            detector.register_scorer("level")(detector.Distance)
    finally:
        del detector.SCORERS["level"]
    with pytest.raises(ValueError):
        detector.Detector(["k"], ["t"], "v", 3, ["level"])
    with pytest.raises(ValueError):
        detector.Detector(["k"], ["t"], "v", 4).predict(df)
    with pytest.raises(ValueError):
        detector.Detector(["k"], ["t"], "v", 4).fit(df.limit(0))
    flat = spark.createDataFrame([("a", i, 2.0) for i in range(10)], "k string, t int, v double")
    assert detector.Detector(["k"], ["t"], "v", 4).fit_predict(flat).filter("label = 1").count() == 0


def count_of(member, row):
    u = int(hashlib.md5(f"{member}:{row}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(p <= u for p in (sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)))


def test_ensemble_radii_equal_bagged_lines(spark):
    frame, _ = series(spark)
    frame["id"] = range(len(frame))
    members, radii = 6, {}
    for k, part in frame.groupby("k"):
        w = np.array([[count_of(m, r) for r in part["id"]] for m in range(members)])
        lines = [np.polyfit(part["t"], part["v"], 1, w=np.sqrt(w[m])) if len(part) > 1 else [0.0, part["v"].iloc[0]] for m in range(members)]
        guess = np.array([np.polyval(b, part["t"]) for b in lines])
        if len(part) == 1:
            guess[w[:, 0] == 0] = np.nan  # members without rows predict nothing
        res = []
        for i in range(len(part)):
            free = [guess[m, i] for m in range(members) if w[m, i] == 0 and not np.isnan(guess[m, i])] or [g for g in guess[:, i] if not np.isnan(g)]
            res.append(abs(part["v"].iloc[i] - np.mean(free)))
        last = sorted(res[-20:])
        radii[k] = last[min(len(last), math.ceil((len(last) + 1) * 0.8)) - 1]
    d = conformal.bagged_lines(spark.createDataFrame(frame), ["k"], "id", "t", "v", members)
    got = {r.k: r.radius for r in conformal.ensemble_radii(d, ["k"], ["t"], "v", 0.2, 20).collect()}
    assert got == pytest.approx(radii)
    draws = spark.range(20000).select(F.explode(conformal.bag_counts(3, F.col("id"))).alias("c")).agg(F.avg("c").alias("m"), F.var_pop("c").alias("v")).first()
    assert draws.m == pytest.approx(1, abs=0.02) and draws.v == pytest.approx(1, abs=0.03)


@pytest.mark.parametrize("hard", [False, True])
def test_state_radii_equal_brute_force(spark, hard):
    rng = np.random.default_rng(4)
    states = rng.dirichlet([1, 1, 1], 80)
    rows = [("a" if i < 60 else "b", i, states[i].tolist(), float(round(rng.exponential(), 1))) for i in range(80)]  # ties among residuals
    cal = spark.createDataFrame(rows[:50] + rows[60:70], "k string, t int, s array<double>, r double")
    tests = spark.createDataFrame([(k, t, s) for k, t, s, _ in rows[50:60] + rows[70:]] + [("c", 99, [1.0, 0.0, 0.0]), ("a", 98, None)], "k string, t int, s array<double>")
    got = {r.t: r.radius for r in conformal.state_radii(cal, tests, ["k"], ["t"], "s", "r", 0.2, 30, 0.3, hard).collect()}
    assert len(got) == 22 and got[99] is None and got[98] is None
    for k, t, s, _ in rows[50:60] + rows[70:]:
        held = [x for x in rows[:50] + rows[60:70] if x[0] == k][-30:]
        if hard:
            w = np.array([float(np.argmax(x[2]) == np.argmax(s)) for x in held])
            w = w if w.any() else np.ones(len(held))
        else:
            w = np.exp(np.array([np.dot(x[2], s) for x in held]) / 0.3)
        w /= w.sum()
        r = np.array([x[3] for x in held])
        order = np.lexsort((-np.array([x[1] for x in held]), r))
        r, w = r[order], w[order]
        q = min(1.0, math.ceil((len(held) + 1) * 0.8) / len(held))
        reach = np.flatnonzero((np.cumsum(w) - w / 2 >= q) & (w > 0))
        assert got[t] == pytest.approx(r[reach[0]] if len(reach) else r[w > 0][-1])


def test_configured_chain_suits_its_columns(spark):
    rng = np.random.default_rng(6)
    n = 400
    frame = pd.DataFrame({"k": np.repeat(["a", "b"], n // 2), "t": np.tile(range(n // 2), 2), "noise": rng.standard_normal(n), "skewed": np.exp(rng.standard_normal(n)), "flat": np.repeat(rng.standard_normal(n // 20), 20)})
    frame["walk"] = frame.groupby("k")["noise"].cumsum() * 5
    frame.loc[::10, "noise"] = np.nan
    df, s = spark.createDataFrame(frame), Series(("k",), ("t",))
    told = {r.feature: r for r in configure.decided(configure.measures(df, s, ["noise", "skewed", "flat", "walk"])).collect()}
    assert told["noise"].steps == "Impute Smooth Scale" and told["noise"].missing == pytest.approx(0.1)
    assert told["skewed"].steps.startswith("Clip Log") and told["flat"].archetype == "flat" and told["walk"].steps == "Difference Scale"
    p = frame.groupby("k")["walk"].shift(1)
    assert told["walk"].lag1 == pytest.approx(frame["walk"].corr(p))
    steps = configure.configured(df, s, ["noise", "skewed", "flat", "walk"], exclude=["k", "t"]).fit(df)
    assert [type(x).__name__ for x in steps.steps] == ["Impute", "Clip", "Log", "Smooth", "Difference", "Scale", "Scale"]
    out = chain.Chain.from_json(steps.to_json()).transform(df).toPandas()
    assert out["noise"].notna().all() and out["walk"].isna().sum() == 2 and abs(out["walk"].mean()) < 1e-9
    back = steps.inverse(steps.transform(df)).toPandas().sort_values(["k", "t"])
    assert np.allclose(back["walk"], frame["walk"]) and np.allclose(back["flat"], frame["flat"])
    empty = configure.configured(df.limit(0), s, ["noise", "walk"])
    assert empty.fit(df.limit(0)).transform(df).count() == n


def test_transforms_that_serve(spark):
    rng = np.random.default_rng(7)
    x = np.exp(rng.standard_normal(500))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "z": rng.standard_normal(500), "one": 1.0, "y": np.log(x)}))
    steps = chain.Chain(chain.Transforms(["x", "z", "one"], target="y")).fit(df)
    state = steps.steps[0].state
    assert len(state["x"]["chosen"]) == 1 and state["z"]["chosen"] == [] and state["one"] == {"chosen": [], "gain": {}}
    made = features.math_transforms("x")
    values = df.select(*(v.alias(n) for n, v in made.items())).toPandas()

    def shape(v):
        c = v - v.mean()
        return 1 / (1 + abs((c**3).mean() / (c**2).mean() ** 1.5) + abs((c**4).mean() / (c**2).mean() ** 2 - 3) / 2)

    y = np.log(x)
    score = lambda v: shape(v) + abs(np.corrcoef(v, y)[0, 1])
    gain = {n: score(values[n].to_numpy(float)) - score(x) for n in made}
    assert state["x"]["gain"] == pytest.approx(gain) and state["x"]["chosen"] == [max(gain, key=gain.get)]
    out = chain.Chain.from_json(steps.to_json()).transform(df)
    assert len(out.columns) == 5 and steps.inverse(out).columns == ["x", "z", "one", "y"]
    assert chain.Transforms(["x"]).fit(df.limit(0)).state == {"x": {"chosen": [], "gain": {}}}

"""Kernel dependence, Parzen estimates and information of pairs against brute force."""

import math

import numpy as np
import pandas as pd
import pytest

from varve.operators import kernel, search, select


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal(n)
    return pd.DataFrame({"z": z, "x": z + 0.3 * rng.standard_normal(n), "y": z + 0.3 * rng.standard_normal(n), "u": rng.standard_normal(n)})


def test_conditional_hsic_equals_projected_kernels(spark):
    frame, k = table(spark), 16
    df = spark.createDataFrame(frame)
    got = kernel.conditional_hsic(df, ["x"], ["y"], ["z"], k).first()
    n, scale = len(frame), kernel.widths(df, ["x", "y", "z"])
    h = np.eye(n) - 1 / n
    grams = []
    for i, c in enumerate("xyz"):
        assert scale[c] == pytest.approx(np.subtract(*np.percentile(frame[c], [75, 25])) / 1.349)
        phi = kernel.feature_map(frame[[c]].to_numpy() / scale[c], *kernel.weights(1, k, 1, i))
        grams.append(h @ phi @ phi.T @ h)
    r = np.eye(n) - grams[2] @ np.linalg.inv(grams[2] + 1e-3 * np.eye(n))
    assert got.n == n and got.hsic == pytest.approx(np.trace(grams[0] @ grams[1]) / (n * (n - 1)))
    assert got.conditional == pytest.approx(np.trace(r @ grams[0] @ r @ r @ grams[1] @ r) / (n * (n - 1)), rel=1e-5)


def test_conditional_hsic_tells_common_cause_from_link(spark):
    frame = table(spark, 500)
    df = spark.createDataFrame(frame.assign(v=frame["x"] * 2 + frame["u"]))
    apart = kernel.conditional_hsic(df, ["x"], ["y"], ["z"], 32, tries=4).first()
    tied = kernel.conditional_hsic(df, ["x"], ["v"], ["z"], 32, tries=4).first()
    assert apart.conditional < 0.05 * apart.hsic and tied.p == 0.2 and tied.conditional > 3 * apart.conditional


def test_hsic_edges(spark):
    df = spark.createDataFrame([(float(i), 1.0, None if i % 2 else float(i * i)) for i in range(40)], "a double, b double, c double")
    got = {(r.feature_a, r.feature_b): r for r in kernel.hsic_pairs(df, ["a", "b", "c"], 16).collect()}
    assert got["a", "b"].hsic == pytest.approx(0, abs=1e-20) and got["a", "b"].alignment == 0 and got["a", "c"].alignment > 0.5
    assert all(r.hsic == 0 for r in kernel.hsic_pairs(df.limit(0), ["a", "b"], 8).collect())
    assert kernel.conditional_hsic(df.limit(3), ["a"], ["b"], ["c"], 8).first().conditional is None
    with pytest.raises(ValueError):
        kernel.hsic_pairs(df, ["a", "b"], kernel.MOST)


def brute_parzen(trials, candidates, share, cells, bounds, prior):
    limit = np.quantile([t[-1] for t in trials], share)
    out = np.zeros(len(candidates))
    for i, (low, high) in enumerate(bounds):
        cell = lambda v, low=low, high=high: min(max(math.floor((v - low) * cells / (high - low)), 0), cells - 1)
        logs = []
        for side in (True, False):
            o = np.array([cell(t[i]) for t in trials if (t[-1] <= limit) == side], float)
            width = max(1.0, 1.06 * o.std() * len(o) ** -0.2)
            w = np.exp(-0.5 * ((np.arange(cells)[:, None] - o) / width) ** 2)
            logs.append(np.log(((w / w.sum(0)).sum(1) + prior / cells) / (len(o) + prior)))
        out += [(logs[0] - logs[1])[cell(c[i])] for c in candidates]
    names = [{t[2] for t in trials}][0]
    for j, c in enumerate(candidates):
        p = []
        for side in (True, False):
            seen = [t[2] for t in trials if (t[-1] <= limit) == side]
            p.append((seen.count(c[2]) + prior / len(names)) / (len(seen) + prior))
        out[j] += math.log(p[0] / p[1])
    return out


def test_parzen_scores_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    trials = [(float(a), float(b), c, float((a - 3) ** 2 + abs(b) + (c == "y"))) for a, b, c in zip(rng.uniform(0, 10, 200), rng.normal(0, 2, 200), rng.choice(list("xyz"), 200), strict=True)]
    candidates = [(3.0, 0.0, "x"), (9.0, 4.0, "y"), (-5.0, 99.0, "never")]
    t = spark.createDataFrame(trials, "a double, b double, c string, loss double")
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(candidates)], "id long, a double, b double, c string")
    bounds = {"a": (0.0, 10.0), "b": (-8.0, 8.0)}
    got = {r.id: r.score for r in search.score_candidates(t, c, "loss", bounds, ["c"], 0.2, 40, 1.0).collect()}
    assert [got[i] for i in range(3)] == pytest.approx(brute_parzen(trials, candidates, 0.2, 40, list(bounds.values()), 1.0).tolist())
    assert search.suggest(t, c, "loss", bounds, ["c"], 1, "id").first().id == 0


def test_parzen_edges(spark):
    t = spark.createDataFrame([(1.0, "x", 1.0), (None, None, 2.0), (2.0, "y", None), (3.0, "x", float("nan"))], "a double, c string, loss double")
    c = spark.createDataFrame([(0, None, None), (1, 1.0, "x")], "id long, a double, c string")
    got = {r.id: r.score for r in search.score_candidates(t, c, "loss", {"a": (0.0, 4.0)}, ["c"]).collect()}
    assert got[0] == 0 and math.isfinite(got[1])
    assert {r.score for r in search.score_candidates(t.limit(0), c, "loss", {"a": (0.0, 4.0)}, ["c"]).collect()} == {0.0}


def test_information_and_quotient_choice_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b, e = rng.standard_normal((3, 400))
    f = pd.DataFrame({"a": a, "twin": a + 0.1 * e, "b": b, "steps": rng.integers(0, 3, 400).astype(float), "target": a + b})
    names, bins = ["a", "twin", "b", "steps"], 6

    def cut(v):
        return np.searchsorted(np.unique(np.quantile(v, [i / bins for i in range(1, bins)])), v)

    def mi(x, y):
        c = pd.crosstab(cut(f[x]), cut(f[y])).to_numpy() / len(f)
        with np.errstate(all="ignore"):
            return float(np.nansum(c * np.log(c / np.outer(c.sum(1), c.sum(0)))))

    df = spark.createDataFrame(f)
    got = {(r.feature_a, r.feature_b): r.mi for r in select.information_matrix(df, [*names, "target"], bins).collect()}
    assert len(got) == 10 and all(v == pytest.approx(mi(*k), abs=1e-9) for k, v in got.items())
    for scheme in ("difference", "quotient"):
        chosen = []
        while len(chosen) < 3:
            def score(c, chosen=chosen, scheme=scheme):
                mean = np.mean([mi(c, s) for s in chosen]) if chosen else 0
                return mi(c, "target") if not chosen else mi(c, "target") / (mean + 1e-12) if scheme == "quotient" else mi(c, "target") - mean
            chosen.append(max((c for c in names if c not in chosen), key=score))
        assert select.mrmr(df, names, "target", 3, "information", scheme, bins) == chosen
    assert "twin" not in select.mrmr(df, names, "target", 2, "information", "difference", bins)[1:]
    assert select.mrmr(df.limit(0), names, "target", 2, "information") == ["twin", "steps"]

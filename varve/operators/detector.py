"""A detector over windows of series: scorers by name, fitted on one table, thresholds and votes, applied to others.

A window is the last `width` values of a series up to a row, so its score is the row's. Fitting takes a few aggregate jobs: quantiles for the scale, one Gram matrix of
all windows (width squared sums) from which every scorer takes its numbers, exact quantiles of the scores for the thresholds. The fitted state is a small dictionary.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nan_to_null
from ..functions.quantiles import column_percentiles
from .anomaly import vote
from .series import Series, fill_forward

#: The Gram matrix has width^2 / 2 sums, so widths are bounded.
MOST_WIDTH = 48

SCORERS: dict[str, type[Scorer]] = {}


class Scorer:
    """A scorer of windows. `learn` takes the number of windows, their mean and their second moments (width x width, about zero) and gives a state of plain numbers and lists;
    `score` gives a window's score, higher: stranger."""

    def learn(self, n: int, mean: np.ndarray, second: np.ndarray) -> dict:
        raise NotImplementedError

    def score(self, x: Column, state: dict) -> Column:
        raise NotImplementedError


def register_scorer(name: str):
    """Makes a scorer known by name. A known name is an error, so that a saved detector can't change its meaning."""

    def add(cls: type[Scorer]) -> type[Scorer]:
        if SCORERS.get(name, cls) is not cls:
            raise ValueError(f"scorer {name} is already registered")
        SCORERS[name] = cls
        return cls

    return add


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise ValueError(f"no scorer {name}; there are {sorted(SCORERS)}")
    return SCORERS[name]()


def _dot(x: Column, weights: Sequence[float]) -> Column:
    return sum((x[i] * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(0.0))


@register_scorer("distance")
class Distance(Scorer):
    """The mean squared z-value of a window's places; places that don't vary count 0."""

    def learn(self, n, mean, second):
        var = np.maximum(np.diag(second) - mean**2, 0.0)
        return {"mean": mean.tolist(), "inverse": [1.0 / v if v > 1e-12 else 0.0 for v in var]}

    def score(self, x, state):
        z = (((x[i] - F.lit(m)) * (x[i] - F.lit(m)) * F.lit(w)) for i, (m, w) in enumerate(zip(state["mean"], state["inverse"], strict=True)))
        return sum(z, F.lit(0.0)) / len(state["mean"])


@register_scorer("components")
class Components(Scorer):
    """The squared distance of a window to its projection on the principal components that hold 90 % of the variance, over the width."""

    share = 0.9

    def learn(self, n, mean, second):
        values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
        values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
        held = np.cumsum(values) / values.sum() if values.sum() > 0 else np.ones(len(values))
        k = min(int(np.searchsorted(held, self.share - 1e-12)) + 1, len(values) - 1)
        return {"mean": mean.tolist(), "axes": vectors[:, :k].T.tolist()}

    def score(self, x, state):
        mean = state["mean"]
        whole = sum(((x[i] - F.lit(m)) * (x[i] - F.lit(m)) for i, m in enumerate(mean)), F.lit(0.0))
        seen = sum((F.pow(_dot(x, a) - F.lit(float(np.dot(a, mean))), 2) for a in state["axes"]), F.lit(0.0))
        return F.greatest(F.lit(0.0), whole - seen) / len(mean)


@register_scorer("forecast")
class Forecast(Scorer):
    """The error of the last value's least-squares forecast from those before it, in units of its root mean square."""

    def learn(self, n, mean, second):
        cov = second - np.outer(mean, mean)
        past, link = cov[:-1, :-1], cov[:-1, -1]
        ridge = 1e-9 * max(float(np.trace(past)) / max(1, len(past)), 1e-12)
        w = np.linalg.solve(past + ridge * np.eye(len(past)), link) if len(past) else np.zeros(0)
        error = max(float(cov[-1, -1] - 2 * w @ link + w @ past @ w), 0.0)
        return {"weights": w.tolist(), "at": float(mean[-1] - w @ mean[:-1]), "by": error**0.5}

    def score(self, x, state):
        gap = F.abs(x[len(state["weights"])] - _dot(x, state["weights"]) - F.lit(state["at"]))
        return gap / F.lit(state["by"]) if state["by"] > 1e-9 else F.when(gap > 1e-6, F.lit(1e6)).otherwise(0.0)


class Detector:
    """fit, score, predict over series of `value`.

    Gaps take the last value before them; windows with a gap left, or shorter than `width` at a series' start, have no score (null) and label 0. Values are scaled over the
    training table: "robust" (median, 5-95 range), "standard", "minmax", "none"; a constant column becomes 0. A scorer's threshold is the larger of the scores' 1 -
    contamination quantile and median + z * 1.4826 MAD, the quantile alone where the MAD vanishes; a row above it is an anomaly for that scorer, and the scorers vote.
    A training table without whole windows is an error."""

    def __init__(
        self, keys: Sequence[str], order: Sequence[str], value: str, width: int = 8, scorers: Sequence[str] = ("distance", "components", "forecast"), scale: str = "robust",
        contamination: float = 0.01, z: float = 3.5, rule: str = "majority", weights: Sequence[float] | None = None,
    ):
        if not 2 <= width <= MOST_WIDTH:
            raise ValueError(f"width must be 2 to {MOST_WIDTH}")
        if scale not in ("robust", "standard", "minmax", "none") or rule not in ("majority", "any", "all", "weighted"):
            raise ValueError("no such scale or rule")
        for s in scorers:
            scorer(s)
        self.options = {"keys": list(keys), "order": list(order), "value": value, "width": width, "scorers": list(scorers), "scale": scale, "contamination": contamination, "z": z, "rule": rule, "weights": None if weights is None else list(weights)}
        self.series, self.value, self.width, self.scorers, self.scale, self.contamination, self.z, self.rule, self.weights = Series(tuple(keys), tuple(order)), value, width, list(scorers), scale, contamination, z, rule, weights
        self.state: dict | None = None

    def _need(self) -> dict:
        if self.state is None:
            raise ValueError("the detector is not fitted")
        return self.state

    def _learn_scale(self, df: DataFrame) -> dict:
        d = df.select(nan_to_null(self.value).alias("v"))
        if self.scale == "none":
            return {"at": 0.0, "by": 1.0}
        if self.scale == "robust":
            low, mid, high = column_percentiles(d, ["v"], [0.05, 0.5, 0.95]).first()["v"] or (0.0, 0.0, 0.0)
            return {"at": mid, "by": high - low}
        row = d.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("a"), F.max("v").alias("b")).first()
        at, by = (row.m, row.s) if self.scale == "standard" else (row.a, None if row.b is None else row.b - row.a)
        return {"at": at or 0.0, "by": by or 0.0}

    def _windows(self, df: DataFrame, scale: dict) -> DataFrame:
        """df with _x, the window that ends at a row, or null."""
        v = nan_to_null(self.value)
        d = df.withColumn("_v", (v - scale["at"]) / scale["by"] if scale["by"] else F.when(v.isNotNull(), F.lit(0.0)))
        d = d.withColumn("_v", fill_forward(self.series, "_v"))
        held = F.collect_list("_v").over(self.series.rows(-(self.width - 1), 0))  # nulls aren't collected, so a gap makes it short
        return d.withColumn("_x", held).withColumn("_x", F.when(F.size("_x") == self.width, F.col("_x"))).drop("_v")

    def fit(self, df: DataFrame) -> Detector:
        scale, w = self._learn_scale(df), self.width
        windows = self._windows(df.select(*self.series.keys, *self.series.order, self.value), scale).filter(F.col("_x").isNotNull()).select("_x")
        x = F.col("_x")
        sums = windows.agg(F.count("*").alias("n"), F.array(*(F.sum(x[i]) for i in range(w))).alias("m"), F.array(*(F.sum(x[i] * x[j]) for i in range(w) for j in range(i, w))).alias("g")).first()
        if not sums.n:
            raise ValueError("the training table holds no whole window")
        second = np.zeros((w, w))
        second[np.triu_indices(w)] = sums.g
        second = (second + np.triu(second, 1).T) / sums.n
        learnt = {s: scorer(s).learn(sums.n, np.array(sums.m) / sums.n, second) for s in self.scorers}
        scores = windows.select(*(scorer(s).score(x, learnt[s]).alias(s) for s in self.scorers))
        first = column_percentiles(scores, self.scorers, [0.5, 1 - self.contamination]).first()
        spread = column_percentiles(scores.select(*(F.abs(F.col(s) - first[s][0]).alias(s) for s in self.scorers)), self.scorers, [0.5]).first()
        limits = {s: first[s][1] if spread[s][0] <= 1e-8 else max(first[s][1], first[s][0] + self.z * 1.4826 * spread[s][0]) for s in self.scorers}
        self.state = {"scale": scale, "scorers": learnt, "thresholds": limits}
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """df with score_<scorer>."""
        state = self._need()
        return self._windows(df, state["scale"]).withColumns({f"score_{s}": F.when(F.col("_x").isNotNull(), scorer(s).score(F.col("_x"), state["scorers"][s])) for s in self.scorers}).drop("_x")

    def predict(self, df: DataFrame) -> DataFrame:
        """df with score_<scorer>, label_<scorer> and label, each label 0 or 1."""
        limits = self._need()["thresholds"]
        out = self.score(df).withColumns({f"label_{s}": F.coalesce((F.col(f"score_{s}") > limits[s]).cast("int"), F.lit(0)) for s in self.scorers})
        return out.withColumn("label", vote(*(F.col(f"label_{s}") for s in self.scorers), rule=self.rule, weights=self.weights))

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def to_json(self) -> str:
        return json.dumps({"options": self.options, "state": self.state})

    @staticmethod
    def from_json(text: str) -> Detector:
        saved = json.loads(text)
        out = Detector(**saved["options"])
        out.state = saved["state"]
        return out

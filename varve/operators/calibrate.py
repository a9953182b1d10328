"""Calibration of anomaly scores: thresholds from a score's distribution, detector weights, logistic and temperature scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import sigmoid
from ..functions.quantiles import long_percentiles


def score_fits(df: DataFrame, key: str, score: str, z: float = 3.0) -> DataFrame:
    """key and three thresholds: median + z robust deviations, mean + z deviations, and the mean of the 95 and 99 % quantiles."""
    q = long_percentiles(df.select(key, F.col(score).cast("double").alias("value")), [0.5, 0.95, 0.99], key)
    base = df.groupBy(key).agg(F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_std")).join(q, key)
    far = df.join(base.select(key, F.col("q")[0].alias("_med")), key).select(key, F.abs(F.col(score) - F.col("_med")).alias("value"))
    spread = long_percentiles(far, [0.5], key).select(key, F.col("q")[0].alias("_mad"))
    return base.join(spread, key).select(key, (F.col("q")[0] + z * 1.4826 * F.col("_mad")).alias("mad"), (F.col("_mean") + z * F.col("_std")).alias("gaussian"), ((F.col("q")[1] + F.col("q")[2]) / 2).alias("percentile"))


def adaptive_weights(df: DataFrame, detector: str, order: Sequence[str], error: str, last: int = 100, quantile: float = 0.9) -> DataFrame:
    """detector, weight: the reciprocal of the quantile of each detector's last errors, summing to 1 over the detectors (a small table)."""
    w = Window.partitionBy(detector).orderBy(*(F.desc(o) for o in order))
    recent = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    q = recent.groupBy(detector).agg(F.percentile(error, F.lit(quantile)).alias("_q")).withColumn("_w", 1 / (F.col("_q") + 1e-8))  # at most `last` values a detector
    total = q.agg(F.sum("_w").alias("_t"))  # one row
    return q.join(F.broadcast(total)).select(detector, (F.col("_w") / F.col("_t")).alias("weight"))


def _loss(x: Column, y: Column) -> Column:
    """Log loss of sigmoid(x), without overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def platt(df: DataFrame, score: str, label: str, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of the logistic fit of the label (0 or 1) on the score, by Newton's method; each round is one aggregate job."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * s + b)
        w = p * (1 - p)
        g = df.agg(F.sum((p - y) * s), F.sum(p - y), F.sum(w * s * s), F.sum(w * s), F.sum(w)).first()
        if g[0] is None:
            break
        det = g[2] * g[4] - g[3] * g[3]
        if abs(det) < 1e-12:
            break
        da, db = (g[4] * g[0] - g[3] * g[1]) / det, (g[2] * g[1] - g[3] * g[0]) / det
        scale = max(1.0, abs(da) / 5, abs(db) / 5)  # long steps are cut
        a, b = a - da / scale, b - db / scale
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a, b


def temperature(df: DataFrame, score: str, label: str, low: float = 0.01, high: float = 100.0, points: int = 16, rounds: int = 6) -> float:
    """The T within low and high that minimises the log loss of sigmoid(score / T): grids of log T around the best so far, one job each."""
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        grid = [a + (b - a) * i / (points - 1) for i in range(points)]
        loss = df.agg(*(F.avg(_loss(s / math.exp(g), y)) for g in grid)).first()
        if loss[0] is None:
            return 1.0
        at = min(range(points), key=lambda i: loss[i])
        a, b = grid[max(0, at - 1)], grid[min(points - 1, at + 1)]
    return math.exp((a + b) / 2)

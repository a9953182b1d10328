"""Synthetic series as columns over a range: every row is computed by itself, so any number of series runs in parallel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def panel(spark: SparkSession, series: int, length: int, start: str = "2024-01-01") -> DataFrame:
    """series, t and daily time."""
    rows = spark.range(series * length).select((F.col("id") / length).cast("long").alias("series"), (F.col("id") % length).alias("t"))
    return rows.withColumn("time", F.date_add(F.lit(start).cast("date"), F.col("t").cast("int")))


def linear_trend(slope: float, level: float = 0.0) -> Column:
    return level + slope * F.col("t")


def polynomial_trend(*coefficients: float) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * F.col("t") + c
    return out


def piecewise_trend(knots: list[int], slopes: list[float]) -> Column:
    """Slopes change at the knots."""
    out, before = F.lit(0.0), 0.0
    for k, s in zip([0, *knots], slopes, strict=True):
        out = out + (s - before) * F.greatest(F.lit(0), F.col("t") - k)
        before = s
    return out


def seasonality(period: float, amplitude: float, harmonics: int = 1, phase: float = 0.0) -> Column:
    a = 2 * math.pi * F.col("t") / period + phase
    return sum((amplitude / k * F.sin(k * a) for k in range(2, harmonics + 1)), amplitude * F.sin(a))


def noise(scale: float, seed: int) -> Column:
    """Standard normal by hash of (series, t, seed): the same on any partitioning."""
    u = lambda k: (F.pmod(F.xxhash64("series", "t", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return scale * F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1))


def missing_at_random(value: Column, share: float, seed: int) -> Column:
    return F.when(F.pmod(F.xxhash64("series", "t", F.lit(seed)), F.lit(1_000_000)) >= int(share * 1_000_000), value)


def hyperband(max_budget: float, eta: int = 3) -> list[dict[str, float]]:
    """Brackets of successive halving: bracket, round, configurations and budget each."""
    top = int(math.log(max_budget, eta) + 1e-9)
    out = []
    for s in range(top, -1, -1):
        n = math.ceil((top + 1) / (s + 1) * eta**s)
        out += [{"bracket": s, "round": i, "configs": n // eta**i, "budget": max_budget / eta ** (s - i)} for i in range(s + 1)]
    return out


def wide(df: DataFrame, names: list[int]) -> DataFrame:
    """time and one column y_s<k> per series."""
    out = df.groupBy("time").pivot("series", names).agg(F.first("y"))
    return out.select("time", *(F.col(str(k)).alias(f"y_s{k}") for k in names))


def asha_promotions(trials: DataFrame, trial: str, rung: str, loss: str, eta: int = 3) -> DataFrame:
    """Adds promoted: the best floor(n / eta) trials of each rung; ties by trial."""
    w = Window.partitionBy(rung)
    return trials.withColumn("promoted", F.row_number().over(w.orderBy(loss, trial)) <= F.floor(F.count("*").over(w) / eta))


def regime_panel(spark: SparkSession, series: int, length: int, seed: int, ar: float = 0.6, ma: float = 0.3, stay: float = 0.95, arch: tuple[float, float] = (0.2, 0.5)) -> DataFrame:
    """series, i, regime, y: ARMA(1, 1) noise whose shocks have ARCH(1) variances, and whose level jumps with a two-state Markov chain. Reproducible by seed and series."""
    import numpy as np
    import pandas as pd

    def make(frames):
        for frame in frames:
            for s in frame["series"].tolist():
                rng = np.random.default_rng([seed, s])
                shock, before, y, level = 0.0, 0.0, 0.0, 0
                rows = []
                for i in range(length):
                    level = level if rng.random() < stay else 1 - level
                    shock = rng.standard_normal() * np.sqrt(arch[0] + arch[1] * before * before)
                    y = ar * y + shock + ma * before
                    before = shock
                    rows.append((s, i, level, y + 3.0 * level))
                yield pd.DataFrame(rows, columns=["series", "i", "regime", "y"])

    return spark.range(series).select(F.col("id").alias("series")).mapInPandas(make, "series long, i long, regime long, y double")

"""Conformal prediction intervals as aggregates over calibration residuals."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


def conformal_radius(df: DataFrame, keys: list[str], score: str, alpha: float) -> DataFrame:
    """keys, n, radius: the element at index ceil(q n) - 1 with q = ceil((n + 1)(1 - alpha)) / n, at most the largest."""
    w = Window.partitionBy(*keys)
    df = df.select(*keys, F.col(score).alias("_s"), F.row_number().over(w.orderBy(score)).alias("_r"), F.count("*").over(w).alias("n"))
    at = F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))
    return df.filter(F.col("_r") == at).select(*keys, "n", F.col("_s").alias("radius"))


def cqr_score(y: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - y, y - high)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The smallest value whose weight up to its middle reaches q of the total; the largest value if none does."""
    w = Window.partitionBy(*keys)
    run = F.sum(weight).over(w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    mid = (run - F.col(weight) / 2) / F.sum(weight).over(w)
    return df.select(*keys, F.col(value).alias("_v"), mid.alias("_m")).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_m") >= q, F.col("_v"))), F.max("_v")).alias("quantile"))


def coverage(df: DataFrame, keys: list[str], y: str = "y", low: str = "low", high: str = "high") -> DataFrame:
    hit = ((F.col(y) >= F.col(low)) & (F.col(y) <= F.col(high))).cast("double")
    width = F.col(high) - F.col(low)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("covered"), F.min(hit).alias("joint"), F.avg(width).alias("width"), F.min(width).alias("narrowest"), F.max(width).alias("widest"))


def adaptive_alpha(df: DataFrame, keys: list[str], order: list[str], miss: str, target: float, gamma: float) -> DataFrame:
    """keys, n, alpha: the miscoverage rate after every row's update alpha += gamma * (target - miss), held within 0.01 and 0.99, in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(miss).cast("double").alias("_miss")))).alias("_r"))
    step = lambda a, r: F.least(F.lit(0.99), F.greatest(F.lit(0.01), a + gamma * (target - r["_miss"])))
    return rows.select(*keys, F.size("_r").cast("long").alias("n"), F.aggregate("_r", F.lit(target), step).alias("alpha"))


def aggregated_radius(df: DataFrame, keys: list[str], order: list[str], miss: str, residual: str, target: float, gammas: list[float], keep: int = 5000) -> DataFrame:
    """keys, n, radius: the mean over experts, one a gamma, of the residuals' quantile at 1 - alpha, with each expert's alpha after every row's update.

    The quantile is the higher one at ceil((m + 1) (1 - alpha)) / m of the last `keep` rows' m residuals that aren't null; NULL without any. A key's rows are one array."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(miss).cast("double").alias("_miss"), F.col(residual).cast("double").alias("_res")))).alias("_r"))
    held = F.filter(F.transform(F.slice("_r", -F.least(F.size("_r"), F.lit(keep)), keep), lambda r: r["_res"]), lambda r: r.isNotNull())
    rows = rows.select(*keys, F.size("_r").cast("long").alias("n"), "_r", F.array_sort(held).alias("_s"))
    m = F.size("_s")

    def radius(gamma: float):
        step = lambda a, r: F.least(F.lit(0.99), F.greatest(F.lit(0.01), a + F.lit(gamma) * (F.lit(target) - F.coalesce(r["_miss"], F.lit(target)))))
        level = F.least(F.lit(1.0), F.ceil((m + 1) * (1 - F.aggregate("_r", F.lit(target), step))) / m)
        return F.get("_s", F.ceil(level * (m - 1)).cast("int"))

    return rows.select(*keys, "n", F.when(m > 0, sum((radius(g) for g in gammas), F.lit(0.0)) / len(gammas)).alias("radius"))


def local_radii(calibration: DataFrame, tests: DataFrame, keys: list[str], order: str, x: str, residual: str, alpha: float, k: int = 50, window: int = 500) -> DataFrame:
    """tests with radius: the linear 1 - alpha quantile of the residuals of the k calibration rows nearest in x, of each key's last `window` rows.

    A key's window is one array of at most `window` pairs, which every test row of the key is held against."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    held = calibration.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window).groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(order).alias("o"), F.col(residual).cast("double").alias("r"))).alias("_w"))
    near = F.slice(F.array_sort(F.transform("_w", lambda p: F.struct(F.abs(p["x"] - F.col(x)).alias("d"), p["o"].alias("o"), p["r"].alias("r")))), 1, k)
    sized = tests.join(held, keys).withColumn("_n", F.array_sort(F.transform(near, lambda p: p["r"])))
    place = (F.size("_n") - 1) * F.lit(1 - alpha)
    at = lambda p: F.get("_n", p.cast("int"))
    return sized.withColumn("radius", at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * (place - F.floor(place))).drop("_w", "_n")


def cv_plus(df: DataFrame, keys: list[str], prediction: str, residual: str, alpha: float) -> DataFrame:
    """keys, n, low, high of the interval of jackknife+ and CV+: with the predictions of the models that left each row's fold out, the
    floor(alpha (n + 1))-th smallest prediction - residual and the ceil((1 - alpha) (n + 1))-th smallest prediction + residual."""
    w = Window.partitionBy(*keys)
    d = df.select(*keys, (F.col(prediction) - F.col(residual)).alias("_l"), (F.col(prediction) + F.col(residual)).alias("_h"), F.count("*").over(w).alias("n"))
    d = d.withColumn("_a", F.row_number().over(w.orderBy("_l"))).withColumn("_b", F.row_number().over(w.orderBy("_h")))
    n = F.col("n") + 1
    low, high = F.greatest(F.lit(1), F.floor(alpha * n)), F.least(F.col("n"), F.ceil((1 - alpha) * n))
    return d.groupBy(*keys, "n").agg(F.max(F.when(F.col("_a") == low, F.col("_l"))).alias("low"), F.max(F.when(F.col("_b") == high, F.col("_h"))).alias("high"))


def poisson_limits() -> list[float]:
    """P(N <= k) of a Poisson(1) count for k = 0 to 7."""
    return [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bag_counts(members: int, row_id: Column) -> Column:
    """Array: how often a row is in each member's bootstrap sample. Counts of one row are Poisson(1), drawn from a hash of member and id, so that samples of any table need no
    shuffle and reruns agree; draws beyond 7 (one in 10^5) count as 8."""
    limits = np.array(poisson_limits())

    @F.pandas_udf("array<int>")
    def draw(ids: pd.Series) -> pd.Series:
        first = lambda m, i: int.from_bytes(hashlib.md5((f"{m}:{i}" if i is not None else str(m)).encode()).digest()[:4], "big")
        u = np.array([[first(m, i) for m in range(members)] for i in ids], float).reshape(len(ids), members) / 2.0**32
        return pd.Series(list(np.searchsorted(limits, u, side="right").astype(np.int32)), dtype=object)

    return draw(row_id.cast("string"))


def bagged_lines(df: DataFrame, keys: list[str], row_id: str, x: str, y: str, members: int) -> DataFrame:
    """df with counts and predictions: each member is the least-squares line of y on x over its bootstrap sample of a key's rows; a flat line where x doesn't vary.

    All members of all keys come from one aggregate. A member without rows of a key predicts null. Rows without x or y are no one's and are left out."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("counts", bag_counts(members, F.col(row_id)))
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    sums = []
    for m in range(members):
        w = F.col("counts")[m].cast("double")
        sums.append(F.struct(F.sum(w).alias("w"), F.sum(w * u).alias("u"), F.sum(w * v).alias("v"), F.sum(w * u * u).alias("uu"), F.sum(w * u * v).alias("uv")))
    fits = d.groupBy(*keys).agg(F.array(*sums).alias("_fits"))

    def line(f: Column) -> Column:
        slope = F.coalesce(F.try_divide(f["w"] * f["uv"] - f["u"] * f["v"], f["w"] * f["uu"] - f["u"] * f["u"]), F.lit(0.0))
        return F.try_divide(f["v"] - slope * f["u"], f["w"]) + slope * u

    return d.join(fits, keys).withColumn("predictions", F.array(*(line(F.col("_fits")[m]) for m in range(members)))).drop("_fits")


def out_of_bag(predictions: str = "predictions", counts: str = "counts") -> Column:
    """The mean prediction of the members whose sample lacks the row; of all members where there is none."""
    start = F.struct(F.lit(0.0).alias("o"), F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))  # sum and number of those without the row, and of all

    def add(t: Column, z: Column) -> Column:
        here, out = z["p"].isNotNull(), z["p"].isNotNull() & (z["c"] == 0)
        return F.struct((t["o"] + F.when(out, z["p"]).otherwise(0.0)).alias("o"), (t["k"] + out.cast("int")).alias("k"), (t["s"] + F.when(here, z["p"]).otherwise(0.0)).alias("s"), (t["n"] + here.cast("int")).alias("n"))

    return F.aggregate(F.zip_with(predictions, counts, lambda p, c: F.struct(p.cast("double").alias("p"), c.alias("c"))), start, add, lambda t: F.coalesce(F.try_divide(t["o"], t["k"]), F.try_divide(t["s"], t["n"])))


def ensemble_radii(df: DataFrame, keys: list[str], order: list[str], y: str, alpha: float, window: int = 500) -> DataFrame:
    """keys, n, radius of ensemble intervals (EnbPI): over the last `window` rows of a key, the conformal quantile of |y - out-of-bag mean|. df holds predictions and counts per member."""
    r = df.filter(F.col(y).isNotNull() & F.exists("predictions", lambda p: p.isNotNull())).select(*keys, *order, y, "predictions", "counts")
    last = r.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).filter(F.col("_k") <= window)
    return conformal_radius(last.select(*keys, F.abs(F.col(y) - out_of_bag()).alias("_r")), keys, "_r", alpha)


def state_radii(calibration: DataFrame, tests: DataFrame, keys: list[str], order: list[str], states: str, residual: str, alpha: float, window: int = 500, tau: float = 1.0, hard: bool = False) -> DataFrame:
    """tests with radius: the weighted quantile of the residuals of each key's last `window` calibration rows, weighted by how alike their states are to the test row's.

    states: an array of state probabilities. Weights are the softmax of the states' inner products over tau; or with `hard` 1 for rows of the same likeliest state (ties: the
    first), for all rows where none has it. The quantile, at ceil((n + 1) (1 - alpha)) / n, is the least residual whose weight up to its middle reaches it, else the largest.
    A key's window is one array of at most `window` rows. Tests of a key without calibration rows, or without states, have a null radius."""
    top = lambda a: F.array_position(a, F.array_max(a))
    c = calibration.filter(F.col(residual).isNotNull() & F.col(states).isNotNull())
    c = c.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))).filter(F.col("_k") <= window)
    held = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(residual).cast("double").alias("r"), F.col("_k").alias("k"), F.col(states).alias("s")))).alias("_w"))
    d = tests.join(held, keys, "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda t, v: t + v)
    if hard:
        d = d.withColumn("_v", F.transform("_w", lambda p: F.struct(p["r"].alias("r"), (top(p["s"]) == top(F.col(states))).cast("double").alias("w"))))
        d = d.withColumn("_v", F.when(F.exists("_v", lambda p: p["w"] > 0), F.col("_v")).otherwise(F.transform("_w", lambda p: F.struct(p["r"].alias("r"), F.lit(1.0).alias("w")))))
    else:
        d = d.withColumn("_v", F.transform("_w", lambda p: F.struct(p["r"].alias("r"), (dot(p["s"], F.col(states)) / tau).alias("w"))))
        most = F.array_max(F.transform("_v", lambda p: p["w"]))
        d = d.withColumn("_m", most).withColumn("_v", F.transform("_v", lambda p: F.struct(p["r"].alias("r"), F.exp(p["w"] - F.col("_m")).alias("w")))).drop("_m")
    n = F.size("_v")
    total = F.aggregate("_v", F.lit(0.0), lambda t, p: t + p["w"])
    level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1 - alpha)) / n)
    d = d.withColumn("_q", F.when(n > 0, level * total))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("r"))
    found = F.aggregate("_v", start, lambda t, p: F.struct((t["c"] + p["w"]).alias("c"), F.coalesce(t["r"], F.when((p["w"] > 0) & (t["c"] + p["w"] / 2 >= F.col("_q")), p["r"])).alias("r")))
    largest = F.array_max(F.transform(F.filter("_v", lambda p: p["w"] > 0), lambda p: p["r"]))
    return d.withColumn("radius", F.when(F.col(states).isNotNull(), F.coalesce(found["r"], largest))).drop("_w", "_v", "_q")

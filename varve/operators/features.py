"""Row-wise features: dates, mathematics, interactions, row statistics; binning and scaling from one aggregate pass."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import bucket, divide
from ..functions.quantiles import column_percentiles


def date_parts(c: str) -> dict[str, Column]:
    t = F.col(c)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t), "quarter": F.quarter(t), "hour": F.hour(t), "dayofyear": F.dayofyear(t), "isoweek": F.weekofyear(t), "isoyear": F.extract(F.lit("YEAROFWEEK"), t)}


def date_flags(c: str) -> dict[str, Column]:
    d = F.to_date(c)
    first = lambda unit: (d == F.to_date(F.date_trunc(unit, d)))
    last = lambda months: (F.add_months(F.to_date(F.date_trunc({1: "month", 3: "quarter", 12: "year"}[months], d)), months) == F.date_add(d, 1))
    flags = {"is_weekend": F.weekday(d) >= 5, "is_month_start": first("month"), "is_month_end": last(1), "is_quarter_start": first("quarter"), "is_quarter_end": last(3), "is_year_start": first("year"), "is_year_end": last(12)}
    return {k: v.cast("int") for k, v in flags.items()}


def cyclic(name: str, value: Column, period: float) -> dict[str, Column]:
    a = 2 * math.pi * value / period
    return {f"{name}_sin": F.sin(a), f"{name}_cos": F.cos(a)}


def cyclic_dates(c: str) -> dict[str, Column]:
    t = F.col(c)
    return cyclic("hour_of_week", F.weekday(t) * 24 + F.hour(t), 168) | cyclic("day_of_year", F.dayofyear(t), 365.2425) | cyclic("month", F.month(t), 12) | cyclic("isoweek", F.weekofyear(t), 53)


def handler_time_features(c: str) -> dict[str, Column]:
    t = F.col(c)
    return cyclic("month", F.month(t) - 1, 12) | cyclic("day", F.dayofmonth(t) - 1, 31) | cyclic("weekday", F.weekday(t), 7) | cyclic("hour", F.hour(t), 24)


def elapsed(df: DataFrame, time: str, group: str) -> DataFrame:
    """Adds elapsed_s and elapsed_days since the group's first time."""
    first = df.groupBy(group).agg(F.min(time).alias("_t0"))
    s = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 1e6
    return df.join(first, group).withColumn("elapsed_s", s).withColumn("elapsed_days", F.floor(s / 86400)).drop("_t0")


def math_transforms(c: str) -> dict[str, Column]:
    x = F.col(c).cast("double")
    return {"log1p": F.when(x > 0, F.log1p(x)), "sqrt": F.when(x >= 0, F.sqrt(x)), "reciprocal": F.when(F.abs(x) > 1e-8, 1 / x), "signed_log": F.signum(x) * F.log1p(F.abs(x)), "asinh": F.ln(x + F.sqrt(x * x + 1))}


def polynomials(c: str) -> dict[str, Column]:
    x = F.col(c).cast("double")
    clip = lambda v: F.least(F.lit(1e10), F.greatest(F.lit(-1e10), v))
    return {"square": clip(x * x), "cube": clip(x * x * x), "root": F.sqrt(F.abs(x)), "inverse": clip(1 / (F.abs(x) + 1e-8))}


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(z: Column, lam: float) -> Column:
    up = F.exp(z) - 1 if lam == 0 else F.pow(F.when(z >= 0, z * lam + 1).otherwise(F.lit(1.0)), F.lit(1 / lam)) - 1
    down = 1 - F.exp(-z) if lam == 2 else 1 - F.pow(F.when(z < 0, 1 - (2 - lam) * z).otherwise(F.lit(1.0)), F.lit(1 / (2 - lam)))
    return F.when(z >= 0, up).otherwise(down)


def interactions(a: str, b: str) -> dict[str, Column]:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return {"sum": x + y, "diff": x - y, "prod": x * y, "ratio": divide(x, y), "norm_ratio": divide(x - y, F.abs(x) + F.abs(y)), "min": F.least(x, y), "max": F.greatest(x, y), "log_ratio": F.log1p(F.abs(x)) - F.log1p(F.abs(y)), "root_prod": F.sqrt(F.abs(x * y))}


def row_statistics(columns: list[str]) -> dict[str, Column]:
    """Statistics across the present values of a row."""
    v = F.filter(F.array(*(F.col(c).cast("double") for c in columns)), lambda x: x.isNotNull())
    n = F.size(v)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / F.nullif(n, F.lit(0))
    ordered = F.array_sort(v)
    at = lambda q: F.transform(F.array((n - 1) * q), lambda p: F.get(ordered, F.floor(p).cast("int")) + (p - F.floor(p)) * (F.get(ordered, F.ceil(p).cast("int")) - F.get(ordered, F.floor(p).cast("int"))))[0]
    spread = F.sqrt(divide(total(lambda x: x * x) - n * mean * mean, (n - 1).cast("double")))
    low, high = F.array_min(v), F.array_max(v)
    return {"mean": mean, "median": F.when(n > 0, at(0.5)), "std": spread, "min": low, "max": high, "range": high - low, "iqr": F.when(n > 0, at(0.75) - at(0.25)), "present": n.cast("long"), "null_ratio": 1 - n / len(columns)}


def winsorize(df: DataFrame, columns: list[str], p: float) -> DataFrame:
    """Columns clipped to their p and 1 - p quantiles where there are 20 values or more."""
    quantiles = column_percentiles(df, columns, [p, 1 - p]).select(*(F.col(c).alias(f"_q{i}") for i, c in enumerate(columns)))
    cuts = df.agg(*(F.count(c).alias(f"_n{i}") for i, c in enumerate(columns))).join(F.broadcast(quantiles))
    wide = df.join(F.broadcast(cuts))  # cuts: one row
    return wide.withColumns({c: F.when(F.col(f"_n{i}") >= 20, F.least(F.greatest(F.col(c).cast("double"), F.col(f"_q{i}")[0]), F.col(f"_q{i}")[1])).otherwise(F.col(c)) for i, c in enumerate(columns)}).drop(*(f"_{k}{i}" for k in "qn" for i in range(len(columns))))


def selective_log_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, skewed, offset: a log is taken where |skewness| > 1 or excess kurtosis > 5, after lifting the minimum to 1."""
    row = df.agg(*(F.struct(F.skewness(c).alias("s"), F.kurtosis(c).alias("k"), F.min(c).cast("double").alias("m")).alias(f"f{i}") for i, c in enumerate(columns)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("f")) for i, c in enumerate(columns)))).alias("x"))
    return long.select("x.feature", ((F.abs("x.f.s") > 1) | (F.col("x.f.k") > 5)).alias("skewed"), F.greatest(F.lit(0.0), 1 - F.col("x.f.m")).alias("offset"))


def scale(df: DataFrame, keys: list[str], c: str, method: str) -> DataFrame:
    """Adds scaled: standard (population), robust (median over the 5-95 range) or minmax, per key."""
    w = df.groupBy(*keys).agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"), F.percentile(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_q"), F.min(c).alias("_a"), F.max(c).alias("_b"))
    x = F.col(c)
    value = {"standard": divide(x - F.col("_m"), F.col("_s")), "robust": divide(x - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0]), "minmax": divide(x - F.col("_a"), F.col("_b") - F.col("_a"))}[method]
    return df.join(w, keys).withColumn("scaled", F.coalesce(value, F.lit(0.0))).drop("_m", "_s", "_q", "_a", "_b")


def equal_width(df: DataFrame, c: str, rule: str) -> DataFrame:
    """Adds bin of equal-width bins; their number by Freedman-Diaconis, Doane, Sturges or square root, 1 to 100."""
    iqr = column_percentiles(df, [c], [0.25, 0.75]).select((F.col(c)[1] - F.col(c)[0]).alias("_iqr"))
    s = df.agg(F.count(c).alias("_n"), F.min(c).alias("_a"), F.max(c).alias("_b"), F.skewness(c).alias("_g")).join(F.broadcast(iqr))  # one row each
    n = F.col("_n").cast("double")
    k = {
        "fd": F.ceil(F.coalesce(divide((F.col("_b") - F.col("_a")) * F.cbrt(n), 2 * F.col("_iqr")), F.lit(1.0))),
        "doane": F.ceil(1 + F.log2(n) + F.log2(1 + F.abs("_g") / F.sqrt(divide(6 * (n - 2), (n + 1) * (n + 3))))),
        "sturges": F.ceil(F.log2(n)) + 1,
        "sqrt": F.ceil(F.sqrt(n)),
    }[rule]
    k = F.least(F.lit(100), F.greatest(F.lit(1), k)).cast("long")
    return df.join(F.broadcast(s.select("_a", "_b", k.alias("_k")))).withColumn("bin", bucket(F.col(c), F.col("_a"), F.col("_b"), F.col("_k"))).withColumn("bins", F.col("_k")).drop("_a", "_b", "_k")  # s: one row


def quantile_bins(df: DataFrame, c: str, k: int) -> DataFrame:
    """Adds bin by the distinct linear quantile edges; values on an inner edge go up."""
    edges = column_percentiles(df, [c], [i / k for i in range(k + 1)]).select(F.array_distinct(c).alias("_e"))
    inner = F.slice("_e", 2, F.greatest(F.lit(0), F.size("_e") - 2))
    return df.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(c))).cast("long")).drop("_e")  # edges: one row


def best_cut(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the cut of x that gains most class entropy of y, its gain and whether the description length allows it. See partition for cuts of all intervals."""
    from .partition import best_cut as cut

    return cut(df, x, y)


def correlated(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """feature_a, feature_b, value, drop: pairs whose correlation reaches the threshold, and the one with the smaller variance."""
    from .mining import pearson

    pairs = pearson(df, columns).filter(F.abs("value") >= threshold)
    var = df.agg(*(F.var_samp(c).alias(c) for c in columns)).select(F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))).alias("feature", "v"))
    a, b = var.select(F.col("feature").alias("feature_a"), F.col("v").alias("va")), var.select(F.col("feature").alias("feature_b"), F.col("v").alias("vb"))
    return pairs.join(F.broadcast(a), "feature_a").join(F.broadcast(b), "feature_b").select("feature_a", "feature_b", "value", F.when(F.col("va") < F.col("vb"), F.col("feature_a")).otherwise(F.col("feature_b")).alias("drop"))


def pair_names(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def split_gain(df: DataFrame, columns: list[str], gradient: str, bins: int, lam: float = 1.0) -> DataFrame:
    """feature, bin, gain: the best histogram split by gradient sums (unit hessians), one aggregate over all features."""
    spans = df.agg(*(F.min(c).cast("double").alias(f"_a{i}") for i, c in enumerate(columns)), *(F.max(c).cast("double").alias(f"_b{i}") for i, c in enumerate(columns)))
    long = df.join(F.broadcast(spans)).select(F.col(gradient).alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), bucket(F.col(c).cast("double"), F.col(f"_a{i}"), F.col(f"_b{i}"), bins).alias("bin")) for i, c in enumerate(columns)))).alias("x"))  # spans: one row
    hist = long.groupBy("x.feature", "x.bin").agg(F.sum("g").alias("g"), F.count("*").alias("h"))
    w = Window.partitionBy("feature")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = hist.select("feature", "bin", F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"), F.sum("g").over(w).alias("gt"), F.sum("h").over(w).alias("ht")).filter("hl < ht")
    part = lambda g, h: g * g / (h + lam)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
    return s.select("feature", "bin", gain.alias("gain")).groupBy("feature").agg(F.max_by("bin", F.struct(F.round("gain", 4), -F.col("bin"))).alias("bin"), F.max("gain").alias("gain"))


def iqr_clip(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """Columns held within their quartiles less and plus k interquartile ranges."""
    cuts = column_percentiles(df, columns, [0.25, 0.75]).select(*(F.col(c).alias(f"_q{i}") for i, c in enumerate(columns)))  # one row
    q = lambda i, j: F.col(f"_q{i}")[j]
    held = {c: F.least(F.greatest(F.col(c).cast("double"), q(i, 0) - k * (q(i, 1) - q(i, 0))), q(i, 1) + k * (q(i, 1) - q(i, 0))) for i, c in enumerate(columns)}
    return df.join(F.broadcast(cuts)).withColumns(held).drop(*(f"_q{i}" for i in range(len(columns))))


def holiday_flag(df: DataFrame, time: str, calendar: DataFrame) -> DataFrame:
    """Adds is_holiday (0 or 1) by a table of days, which the caller supplies."""
    days = calendar.select(F.col(calendar.columns[0]).cast("date").alias("_day")).distinct().withColumn("is_holiday", F.lit(1))
    return df.withColumn("_day", F.to_date(time)).join(days, "_day", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(0))).drop("_day")


def generator_calendar(c: str) -> dict[str, Column]:
    t = F.col(c)
    turn = lambda x, period: (F.sin(2 * math.pi * x / period), F.cos(2 * math.pi * x / period))
    (ws, wc), (ys, yc) = turn(F.weekday(t), 7), turn(F.dayofyear(t), 365.25)
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "weekofyear": F.weekofyear(t), "week_sin": ws, "week_cos": wc, "year_sin": ys, "year_cos": yc}


def fourier_weights(inputs: int, outputs: int, gamma: float, seed: int) -> list[tuple[list[float], float]]:
    """Weights and phase per output of random Fourier features of the kernel exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    return [([round(float(v), 6) for v in rng.normal(0, math.sqrt(2 * gamma), inputs)], round(float(rng.uniform(0, 2 * math.pi)), 6)) for _ in range(outputs)]


def random_fourier(columns: list[str], weights: list[tuple[list[float], float]]) -> dict[str, Column]:
    """cos(w x + phase) per output: literals in a projection."""
    return {f"rff_{i}": F.cos(sum((F.lit(v) * F.col(c) for v, c in zip(w, columns, strict=True)), F.lit(b))) for i, (w, b) in enumerate(weights)}


def series_fourier(df: DataFrame, keys: list[str], position: str, value: str, terms: int = 3) -> DataFrame:
    """keys, position and cos_k, sin_k of each series' strongest frequencies (0 left out, strongest first). A series is held whole by one task for its
    spectrum only: its values, 8 bytes each."""
    import pandas as pd

    kind = {c: t for c, t in df.dtypes}
    schema = ", ".join(f"{k} {kind[k]}" for k in keys) + ", freqs array<double>"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(position)[value].astype(float)
        x = x.fillna(x.median()).to_numpy()
        power = np.abs(np.fft.rfft(x - x.mean())) if len(x) > 2 and np.ptp(x) > 0 else np.zeros(1)
        best = [int(k) for k in np.argsort(-power, kind="stable")[:terms] if k > 0 and power[k] > 0]
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "freqs": [[k / len(x) for k in best]]})

    freqs = df.select(*keys, position, value).groupBy(*keys).applyInPandas(fit, schema)
    angle = lambda i: 2 * math.pi * F.get("freqs", F.lit(i)) * F.col(position)
    return df.select(*keys, position).join(freqs, keys).select(*keys, position, *(f(angle(i)).alias(f"{n}_{i}") for i in range(terms) for n, f in (("cos", F.cos), ("sin", F.sin))))


def kmeans_bins(df: DataFrame, c: str, k: int, seed: int = 1) -> DataFrame:
    """Adds bin: between the midpoints of the sorted centres of a k-means of the column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=[c], outputCol="_v", handleInvalid="skip").transform(df)
    centres = sorted(float(x[0]) for x in KMeans(k=k, seed=seed, featuresCol="_v").fit(v).clusterCenters())
    edges = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
    return df.withColumn("bin", sum(((F.col(c) >= e).cast("long") for e in edges), F.lit(0).cast("long")))

"""Frame preparation: typing, cleaning, schema enforcement, and rules that choose how to prepare a series."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import divide, nan_to_null
from ..functions.quantiles import column_percentiles
from .mining import numeric_columns
from .series import Series, longest_run


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text as doubles, what isn't a number as NULL; NaN and infinities as NULL."""
    return df.withColumns({c: nan_to_null(F.expr(f"try_cast(`{c}` as double)")) for c in columns})


def drop_constant(df: DataFrame, columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Without those of the columns whose range is within the tolerance; one pass over the rows."""
    row = df.agg(*((F.max(c) - F.min(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).first()
    return df.drop(*(c for i, c in enumerate(columns) if row[i] is None or row[i] <= tolerance))


def long_enough(df: DataFrame, columns: list[str], least: int) -> list[str]:
    row = df.agg(*(F.count(nan_to_null(c)).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[i] >= least]


def enforce_schema(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Exactly the columns of medians, in that order: missing ones are added, gaps take the fitted median, or 0 without one."""
    have = set(df.columns)
    return df.select(*(F.coalesce(nan_to_null(c) if c in have else F.lit(None).cast("double"), F.lit(0.0 if m is None else float(m))).alias(c) for c, m in medians.items()))


def fit_medians(df: DataFrame, columns: list[str] | None = None) -> dict[str, float]:
    columns = columns or numeric_columns(df)
    row = column_percentiles(df.select(*(nan_to_null(c).alias(c) for c in columns)), columns, [0.5]).first()
    return {c: row[c][0] if row[c] else None for c in columns}


def original_columns(columns: list[str], derived: str = r"_(sin|cos|bin|woe|log1p|sqrt|square|cube)$|__") -> list[str]:
    return [c for c in columns if not re.search(derived, c)]


def imputation_plan(df: DataFrame, s: Series, value: str) -> DataFrame:
    """keys, n, missing rate, longest gap and the method that suits them."""
    base = df.groupBy(*s.keys).agg(F.count("*").alias("n"), (1 - F.count(value) / F.count("*")).alias("rate"))
    gaps = longest_run(df, s, F.col(value).isNull(), "gap")
    method = F.when(F.col("rate") == 0, "none").when(F.col("rate") >= 0.5, "mean").when((F.col("rate") <= 0.05) & (F.col("gap") <= 2), "ffill").when(F.col("gap") <= 12, "interpolate").otherwise("hybrid")
    return base.join(gaps, list(s.keys)).select(*s.keys, "n", "rate", "gap", method.alias("method"))


def calibrated_threshold(df: DataFrame, keys: list[str], value: str, base: float, q: float = 0.99) -> DataFrame:
    """keys, threshold: the mean of the base and the q quantile of robust z-scores, within 2.5 and 8."""
    med = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    mad = df.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"), F.first("_m").alias("_m"))
    z = F.coalesce(divide(0.6745 * F.abs(F.col(value) - F.col("_m")), F.col("_d")), F.lit(0.0))
    return df.join(mad, keys).groupBy(*keys).agg(F.percentile(z, F.lit(q)).alias("_q")).select(*keys, F.least(F.lit(8.0), F.greatest(F.lit(2.5), 0.5 * base + 0.5 * F.col("_q"))).alias("threshold"))


def lag_aligned(df: DataFrame, s: Series, target: str, covariate: str, lags: list[int]) -> DataFrame:
    """keys, lag, corr of the target with the covariate lag rows before, all lags in one pass."""
    wide = df.select(*s.keys, F.col(target).alias("_y"), *(F.lag(covariate, k).over(s.by).alias(f"_x{k}") for k in lags))

    def corr(k: int):
        y = F.when(F.col(f"_x{k}").isNotNull(), F.col("_y"))
        x = F.when(F.col("_y").isNotNull(), F.col(f"_x{k}"))
        return F.coalesce(divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))

    row = wide.groupBy(*s.keys).agg(*(corr(k).alias(f"c{k}") for k in lags))
    return row.select(*s.keys, F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"c{k}").alias("corr")) for k in lags))).alias("x")).select(*s.keys, "x.lag", "x.corr")


def align(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of either table whose keys occur in both."""
    return left.join(right.select(*keys), keys, "left_semi"), right.join(left.select(*keys), keys, "left_semi")


def encoding_plan(df: DataFrame, columns: list[str], few: int = 10, many: int = 50) -> DataFrame:
    """feature, n (distinct values), strategy: one_hot up to `few`, target up to `many`, hashing beyond."""
    row = df.agg(*(F.countDistinct(c).alias(f"n{i}") for i, c in enumerate(columns)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    return long.withColumn("strategy", F.when(F.col("n") <= few, "one_hot").when(F.col("n") <= many, "target").otherwise("hashing"))

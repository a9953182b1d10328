"""Safe column expressions: no division by zero under ANSI mode, NumPy's percentile rules, population moments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN and infinities as NULL, so that aggregates skip them."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; 0 where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.coalesce(divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def quantile(c: str | Column, q: float) -> Column:
    """Linear interpolation, as NumPy's default."""
    return F.percentile(col(c), F.lit(q))


def higher_quantile(c: str, q: Column | float) -> Column:
    """The element at index ceil(q n) - 1 of the sorted values."""
    return F.expr(f"percentile_disc({q}) within group (order by {c})")


def mad(c: Column, centre: Column) -> Column:
    return F.median(F.abs(c - centre))


def average_rank(keys: list[str], value: str) -> Column:
    """Ranks from 1, ties averaged, nulls last; one rank per partition, from one sort."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    return F.rank().over(w) + (F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def bucket(c: Column, low: Column, high: Column, k: Column | int) -> Column:
    """0-based equal-width bin; the last bin is closed on the right; all in bin 0 where the range is empty."""
    k = F.lit(k) if isinstance(k, int) else k
    at = F.floor(divide((c - low) * k, high - low))
    return F.least(F.coalesce(at, F.lit(0)), k - 1).cast("long")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def frame(keys: list[str], order: list[str], start: int | None = None, end: int | None = None) -> WindowSpec:
    w = Window.partitionBy(*keys).orderBy(*order)
    if start is None and end is None:
        return w
    return w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)

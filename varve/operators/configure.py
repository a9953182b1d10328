"""Measures of series columns from one job, and the chain of steps that rules of thumb make of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nan_to_null, safe_corr
from . import chain
from .series import Series

#: Limits of the rules, by name; `configured` takes others.
LIMITS = {"skew": 1.0, "excess": 3.0, "flat": 0.5, "drift": 0.95, "turn": -0.4}


def measures(df: DataFrame, s: Series, columns: Sequence[str]) -> DataFrame:
    """feature, n, missing, skew, excess, low, repeated, lag1, turn: a row a column over all series.

    missing: share of nulls (NaN too); skew, excess: population moments, 0 for constants; repeated: share of rows that equal the row before; lag1: correlation with the row
    before; turn: correlation of a change with the change before (-0.5 for noise about a level). Neighbours with a null take no part. Of empty tables all but n and missing are null or 0."""
    d = df.select(*s.keys, *s.order, *(nan_to_null(c).alias(c) for c in columns))
    back = d.select(*columns, *(F.lag(c, k).over(s.by).alias(f"_{k}_{i}") for i, c in enumerate(columns) for k in (1, 2)))

    def told(i: int, c: str):
        x, p, q = F.col(c), F.col(f"_1_{i}"), F.col(f"_2_{i}")
        return F.struct(
            F.lit(c).alias("feature"), F.count("*").alias("n"), F.coalesce(F.avg(x.isNull().cast("double")), F.lit(0.0)).alias("missing"), F.coalesce(nan_to_null(F.skewness(x)), F.lit(0.0)).alias("skew"),
            F.coalesce(nan_to_null(F.kurtosis(x)), F.lit(0.0)).alias("excess"), F.min(x).alias("low"), F.coalesce(F.avg((x == p).cast("double")), F.lit(0.0)).alias("repeated"),
            safe_corr(x, p).alias("lag1"), safe_corr(x - p, p - q).alias("turn"),
        )

    return back.agg(F.array(*(told(i, c) for i, c in enumerate(columns))).alias("m")).select(F.explode("m").alias("m")).select("m.*")


def decided(told: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """The measures with archetype and steps (names in order, joined by a space): what `configured` builds.

    Impute where values miss; Clip for heavy tails; Log for skew; Difference for drift; Smooth for noise about a level; neither of these two for flat columns; Scale always."""
    at = LIMITS | (limits or {})
    heavy, skewed, flat = F.col("excess") > at["excess"], F.abs("skew") > at["skew"], F.col("repeated") >= at["flat"]
    drifts = ~flat & (F.col("lag1") >= at["drift"])
    noisy = ~flat & ~drifts & (F.col("turn") <= at["turn"])
    kind = F.when(flat, "flat").when(drifts, "drifting").when(heavy, "heavy").when(skewed, "skewed").when(noisy, "noisy").otherwise("steady")
    names = [(F.col("missing") > 0, "Impute"), (heavy, "Clip"), (skewed, "Log"), (noisy, "Smooth"), (drifts, "Difference"), (F.lit(True), "Scale")]
    return told.withColumns({"archetype": kind, "steps": F.concat_ws(" ", *(F.when(when, name) for when, name in names))})


def configured(df: DataFrame, s: Series, columns: Sequence[str], limits: dict[str, float] | None = None, exclude: Sequence[str] = ()) -> chain.Chain:
    """The chain, not yet fitted, that suits the columns of a training table; one step of a kind for all columns that need it alike. Imputation and scale are by medians for skewed or heavy columns, else by means."""
    rows = {r.feature: r for r in decided(measures(df, s, columns), limits).collect()}  # a row a column
    at = LIMITS | (limits or {})
    robust = {c for c, r in rows.items() if abs(r.skew) > at["skew"] or r.excess > at["excess"]}
    need = lambda name: [c for c in columns if name in rows[c].steps.split()]
    keys, order = list(s.keys), list(s.order)
    made = [
        chain.Impute([c for c in need("Impute") if c in robust], "median"), chain.Impute([c for c in need("Impute") if c not in robust]), chain.Clip(need("Clip")), chain.Log(need("Log")),
        chain.Smooth(need("Smooth"), keys, order), chain.Difference(need("Difference"), keys, order), chain.Scale([c for c in columns if c in robust], "robust"), chain.Scale([c for c in columns if c not in robust]),
    ]
    return chain.Chain(*(step for step in made if step.columns), exclude=exclude)

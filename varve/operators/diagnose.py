"""Diagnoses of columns and series: missingness that depends on values, collinearity, rank concordance, distribution fits, partial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.expr import divide
from .mining import _pairs, pearson, value_ranks, whole_spearman

#: Rows of a group that a quadratic statistic takes at most; larger groups give NULL.
SMALL = 600


def not_at_random(df: DataFrame, target: str, columns: Sequence[str], least: int = 5) -> DataFrame:
    """feature, missing, t, ks, auc, suspected: whether the target differs where a column is missing.

    Welch's t, the Kolmogorov-Smirnov distance and the rank AUC (the better side) of the target between rows with and without the column; suspected
    where |t| > 1.96, ks passes its 5 % limit or auc > 0.7. Columns with fewer than `least` missing values give no row. Per distinct target value the
    counts are summed first, so ranks and distances come from distinct values."""
    ranks = value_ranks(df.select(F.col(target).cast("double").alias("x")), "x")
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("x"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("m")) for c in columns if c != target))).alias("f")).select("x", "f.feature", "f.m")
    cells = long.groupBy("feature", "x").agg(F.sum(F.col("m").cast("long")).alias("a"), F.sum((~F.col("m")).cast("long")).alias("b")).join(ranks.select("x", "rank"), "x")
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    s = cells.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(x * a).alias("sa"), F.sum(x * b).alias("sb"), F.sum(x * x * a).alias("qa"), F.sum(x * x * b).alias("qb"), F.sum(F.col("rank") * a).alias("ra"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    va, vb = (F.col("qa") - F.col("sa") * F.col("sa") / na) / (na - 1), (F.col("qb") - F.col("sb") * F.col("sb") / nb) / (nb - 1)
    auc = (F.col("ra") - na * (na + 1) / 2) / (na * nb)
    s = s.filter((F.col("na") >= max(2, least)) & (F.col("nb") >= 2)).select("feature", "na", "nb", divide(F.col("sa") / na - F.col("sb") / nb, F.sqrt(va / na + vb / nb)).alias("t"), F.greatest(auc, 1 - auc).alias("auc"))
    w = Window.partitionBy("feature").orderBy("x")
    ks = cells.join(F.broadcast(s.select("feature", "na", "nb")), "feature").withColumn("d", F.abs(F.sum("a").over(w) / F.col("na") - F.sum("b").over(w) / F.col("nb"))).groupBy("feature").agg(F.max("d").alias("ks"))
    limit = 1.358 * F.sqrt((na + nb) / (na * nb))
    return s.join(ks, "feature").select("feature", F.col("na").alias("missing"), "t", "ks", "auc", ((F.abs("t") > 1.96) | (F.col("ks") > limit) | (F.col("auc") > 0.7)).alias("suspected"))


def inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, vif: the diagonal of the inverse correlation matrix (columns squared numbers on the driver); NULL where it is singular."""
    columns = list(columns)
    r = np.eye(len(columns))
    for p in pearson(df, columns).collect():
        i, j = columns.index(p.feature_a), columns.index(p.feature_b)
        r[i, j] = r[j, i] = p.value
    try:
        vif = [float(v) for v in np.diag(np.linalg.inv(r))]
    except np.linalg.LinAlgError:
        vif = [None] * len(columns)
    return df.sparkSession.createDataFrame(list(zip(columns, vif, strict=True)), "feature string, vif double")


def kendall(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, n, tau (tau-b) of groups of at most SMALL rows where both are present; NULL for larger groups, as for constant columns."""
    held = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("_p"))
    sign = lambda f: F.aggregate("_p", F.lit(0.0), lambda s, p: s + F.aggregate("_p", F.lit(0.0), lambda t, q: t + f(F.signum(p["x"] - q["x"]), F.signum(p["y"] - q["y"]))))
    tau = divide(sign(lambda a, b: a * b), F.sqrt(sign(lambda a, b: a * a) * sign(lambda a, b: b * b)))
    return held.select(group, "n", F.when(F.col("n") <= SMALL, tau).alias("tau"))


def correlation_ensemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature_a, feature_b, value: the mean of |Pearson| and |Spearman| over the whole table, by falling value."""
    both = pearson(df, list(columns)).unionByName(whole_spearman(df, list(columns)))
    return both.groupBy("feature_a", "feature_b").agg(F.avg(F.abs("value")).alias("value")).orderBy(F.desc("value"), "feature_a", "feature_b")


def distribution_fits(df: DataFrame, column: str) -> DataFrame:
    """family, aic, best: normal, lognormal and exponential by their closed-form maximum likelihood, over positive values for the latter two."""
    x = F.col(column).cast("double")
    lx = F.when(x > 0, F.ln(x))
    s = df.agg(F.count(x).cast("double").alias("n"), F.var_pop(x).alias("v"), F.count(lx).cast("double").alias("k"), F.avg(lx).alias("lm"), F.var_pop(lx).alias("lv"), F.avg(F.when(x > 0, x)).alias("m"))
    tau = math.log(2 * math.pi)
    aic = {
        "normal": 4 + F.col("n") * (tau + F.ln("v") + 1),
        "lognormal": 4 + F.col("k") * (tau + F.ln("lv") + 1 + 2 * F.col("lm")),
        "exponential": 2 + 2 * F.col("k") * (1 + F.ln("m")),
    }
    rows = s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("family"), v.alias("aic")) for k, v in aic.items()))).alias("r")).select("r.*")
    return rows.withColumn("best", F.row_number().over(Window.orderBy(F.col("aic").asc_nulls_last(), "family")) == 1)  # three rows


def feature_classes(summary: DataFrame) -> DataFrame:
    """feature and flags from a table of mining.distribution: near normal, skewed, heavy-tailed, bimodal, constant, symmetric."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return summary.select(
        "feature",
        flag((F.abs("skew") < 0.5) & (F.abs("excess") < 1)).alias("near_normal"), flag(F.abs("skew") > 1).alias("skewed"), flag(F.col("excess") > 3).alias("heavy_tailed"),
        flag(F.col("bimodality") > 0.555).alias("bimodal"), flag(F.col("low") == F.col("high")).alias("constant"), flag(F.abs(F.col("mean") - F.col("median")) <= 0.1 * F.col("std")).alias("symmetric"),
    )


def durbin_levinson(acf: Sequence[float]) -> list[float]:
    """Partial autocorrelations at lags 1.. of autocorrelations at lags 1.. (Yule-Walker)."""
    r = np.array([1.0, *acf], float)
    out, phi = [], np.zeros(0)
    for k in range(1, len(r)):
        down = 1 - phi @ r[1:k]
        a = (r[k] - phi @ r[k - 1 : 0 : -1]) / down if abs(down) > 1e-12 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(float(a))
    return out


def partial_autocorrelations(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int = 20, limit: float = 0.2) -> DataFrame:
    """keys, n, pacf (array), strong: partial autocorrelations up to min(lags, n // 3) and how many exceed the limit; none for series below 30 values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    present = df.filter(F.col(value).isNotNull())
    centred = present.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    moved = centred.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    stats = moved.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_s"), *(F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, lags + 1)))
    acf = F.array(*(F.coalesce(divide(F.col(f"_c{k}"), F.col("_s")), F.lit(0.0)) for k in range(1, lags + 1)))
    acf = F.when(F.col("n") >= 30, F.slice(acf, 1, F.least(F.lit(lags), F.floor(F.col("n") / 3).cast("int")))).otherwise(F.array().cast("array<double>"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(x):  # at most `lags` numbers a series
        return x.map(lambda v: durbin_levinson(v))

    return stats.select(*keys, "n", solve(acf).alias("pacf")).withColumn("strong", F.size(F.filter("pacf", lambda p: F.abs(p) > limit)).cast("long"))


def last_trends(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, last: int = 20) -> DataFrame:
    """keys, slope, direction (-1, 0, 1) of each series' last values on their position."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    tail = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    return tail.groupBy(*keys).agg(F.regr_slope(value, -F.col("_r")).alias("slope")).withColumn("direction", F.signum(F.round("slope", 9)).cast("int"))


def trend_agreement(trends: DataFrame) -> DataFrame:
    """One row: series, those rising and falling, and the larger of the two shares."""
    up, down = F.sum((F.col("direction") > 0).cast("long")), F.sum((F.col("direction") < 0).cast("long"))
    return trends.agg(F.count("*").alias("series"), up.alias("rising"), down.alias("falling")).withColumn("agreement", divide(F.greatest("rising", "falling").cast("double"), F.col("series").cast("double")))


def by_variance(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """feature, variance of the k columns that vary most; ties by name."""
    row = df.agg(*(F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)))).alias("x")).select("x.*").orderBy(F.col("variance").desc_nulls_last(), "feature").limit(k)


def interaction_pairs(df: DataFrame, columns: Sequence[str], target: str, k: int) -> DataFrame:
    """feature_a, feature_b, value of the k pairs whose product correlates most with the target beyond the better of the two alone."""
    from ..functions.expr import safe_corr

    names = list(combinations(columns, 2))
    y = F.col(target).cast("double")
    alone = lambda c: F.abs(safe_corr(F.col(c).cast("double"), y))
    gain = _pairs(df, names, lambda a, b: F.abs(safe_corr(F.col(a).cast("double") * F.col(b).cast("double"), y)) - F.greatest(alone(a), alone(b)))
    return gain.orderBy(F.desc(F.round("value", 9)), "feature_a", "feature_b").limit(k)


def date_like(df: DataFrame, columns: Sequence[str], share: float = 0.5) -> DataFrame:
    """feature, matched, is_date: the share of a text column's present values that hold a date, and whether it reaches the limit."""
    pattern = r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}"
    row = df.agg(*(F.avg(F.trim(c).rlike(pattern).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)))
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("matched")) for i, c in enumerate(columns)))).alias("x")).select("x.*")
    return long.withColumn("is_date", F.col("matched") >= share)


def gaussian_quantile(p: Column) -> Column:
    """The standard normal's quantile by Acklam's rational approximation (relative error below 1.2e-9)."""
    # The coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(k: Sequence[float], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    def tail(q: Column) -> Column:
        return poly(c, q) / poly(d, q)

    m = p - 0.5
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.ln(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.ln(1 - p)))).otherwise(poly(a, m * m) * m / poly(b, m * m))


def copula_mi(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, mi: -ln(1 - r^2) / 2 of the normal scores of the whole table's average ranks."""
    from .mining import whole_ranks

    n = df.na.drop(subset=[x, y]).agg((F.count("*") + 1).alias("_n"))  # one row
    z = whole_ranks(df, [x, y]).join(F.broadcast(n)).select(gaussian_quantile(F.col(x) / F.col("_n")).alias("a"), gaussian_quantile(F.col(y) / F.col("_n")).alias("b"), F.col("_c").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    s = z.agg(F.sum(c).alias("n"), F.sum(a * c).alias("sa"), F.sum(b * c).alias("sb"), F.sum(a * a * c).alias("qa"), F.sum(b * b * c).alias("qb"), F.sum(a * b * c).alias("p"))
    n = F.col("n")
    cov, va, vb = F.col("p") / n - F.col("sa") * F.col("sb") / (n * n), F.col("qa") / n - (F.col("sa") / n) ** 2, F.col("qb") / n - (F.col("sb") / n) ** 2
    r2 = F.coalesce(divide(cov * cov, va * vb), F.lit(0.0))
    return s.select((-0.5 * F.ln(1 - F.least(r2, F.lit(1 - 1e-12)))).alias("mi"))


def filter_ranking(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, widths: Sequence[int]) -> DataFrame:
    """width, fidelity, roughness, mean_rank of centred moving averages: root mean squared gap to the series, mean absolute step, mean of both ranks (small is good)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    smooth = df.select(*keys, *order, value, *(F.avg(value).over(w.rowsBetween(-(k // 2), k // 2)).alias(f"_y{k}") for k in widths))
    smooth = smooth.select("*", *((F.col(f"_y{k}") - F.lag(f"_y{k}").over(w)).alias(f"_s{k}") for k in widths))
    row = smooth.agg(*(F.struct(F.round(F.sqrt(F.avg((F.col(value) - F.col(f"_y{k}")) ** 2)), 6).alias("fidelity"), F.round(F.avg(F.abs(f"_s{k}")), 6).alias("roughness")).alias(f"m{k}") for k in widths))
    rows = row.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("width"), F.col(f"m{k}.fidelity").alias("fidelity"), F.col(f"m{k}.roughness").alias("roughness")) for k in widths))).alias("x")).select("x.*")
    place = lambda c: F.rank().over(Window.orderBy(c))  # noqa: E731  # one row per filter
    return rows.withColumn("mean_rank", (place("fidelity") + place("roughness")) / F.lit(2.0))

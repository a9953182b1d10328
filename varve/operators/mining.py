"""Profiles of numeric and categorical columns: distribution, dependence, group differences, missingness."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import average_rank, bucket, divide, nan_to_null, safe_corr
from ..functions.quantiles import average_ranks, column_percentiles, long_percentiles
from ..functions.tables import dealt


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def melt(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """keep, feature, value in one pass over the rows."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), nan_to_null(c).alias("value")) for c in columns))).alias("m")).select(*keep, "m.feature", "m.value")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: moments, quartiles, shape, tail ratio, bimodality, Jarque-Bera."""
    v = "value"
    p = [0.05, 0.25, 0.5, 0.75, 0.95]
    long = melt(df, columns).filter("value is not null")
    d = long.groupBy("feature").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("excess"))
    d = d.join(long_percentiles(long, p).withColumnRenamed("q", "_q"), "feature")
    q = {x: F.col("_q")[i] for i, x in enumerate(p)}
    s, k = F.col("skew"), F.col("excess") + 3
    return d.select(
        "feature", "n", "mean", "std", "low", "high", (F.col("high") - F.col("low")).alias("range"), divide(F.col("std"), F.abs("mean")).alias("cv"), "skew", "excess",
        divide(s * s + 1, k).alias("bimodality"), q[0.25].alias("q1"), q[0.5].alias("median"), q[0.75].alias("q3"), (q[0.75] - q[0.25]).alias("iqr"),
        divide(F.col("high") - q[0.95], q[0.05] - F.col("low")).alias("tail_ratio"), (F.col("n") / 6 * (s * s + F.col("excess") * F.col("excess") / 4)).alias("jarque_bera"),
    )


def histogram_entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, bins, entropy in bits over clip(sqrt(n), 10, 80) equal bins."""
    long = melt(df, columns).filter("value is not null")
    span = long.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).withColumn("k", F.least(F.lit(80), F.greatest(F.lit(10), F.floor(F.sqrt("n")))))
    counts = long.join(F.broadcast(span), "feature").withColumn("bin", bucket(F.col("value"), F.col("a"), F.col("b"), F.col("k"))).groupBy("feature", "k", "n", "bin").agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("n")
    return counts.groupBy("feature", F.col("k").alias("bins")).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def far_share(df: DataFrame, columns: list[str], z: float = 3.0) -> DataFrame:
    long = melt(df, columns).filter("value is not null")
    stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return long.join(F.broadcast(stats), "feature").groupBy("feature").agg(F.avg((F.abs(F.col("value") - F.col("m")) > z * F.col("s")).cast("double")).alias("share"))


def _pairs(df: DataFrame, names: list[tuple[str, str]], value) -> DataFrame:
    """feature_a, feature_b, value for many pair aggregates of one job."""
    row = df.agg(*(value(a, b).alias(f"p{i}") for i, (a, b) in enumerate(names)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("value")) for i, (a, b) in enumerate(names)))).alias("x")).select("x.*")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    return _pairs(df, list(combinations(columns, 2)), lambda a, b: safe_corr(nan_to_null(a), nan_to_null(b)))


def ranked_columns(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Average ranks of each column within the groups, as columns of the same names. Ungrouped ranks need all rows in one sort."""
    rows = dealt(df.select(*groups, *columns), *groups) if groups else df
    return rows.select(*groups, *(average_rank(groups, c).alias(c) for c in columns))


def spearman(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Rank correlation per group."""
    r = ranked_columns(df, columns, [group])
    names = list(combinations(columns, 2))
    row = r.groupBy(group).agg(*(safe_corr(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(names)))
    return row.select(group, F.explode(F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"p{i}").alias("value")) for i, (a, b) in enumerate(names)))).alias("x")).select(group, "x.*")


def robust_pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of columns clipped to their 5 and 95 % quantiles."""
    cuts = column_percentiles(df, columns, [0.05, 0.95]).select(*(F.col(c).alias(f"_q{i}") for i, c in enumerate(columns)))
    clipped = df.select(*columns).join(F.broadcast(cuts)).select(*(F.least(F.greatest(F.col(c).cast("double"), F.col(f"_q{i}")[0]), F.col(f"_q{i}")[1]).alias(c) for i, c in enumerate(columns)))  # cuts: one row
    return pearson(clipped, columns)


def chatterjee(df: DataFrame, x: str, y: str, group: str, tie: str) -> DataFrame:
    """group, xi: how far y is a function of x, 1 - 3 sum |step of y's rank in x order| / (n^2 - 1), within 0 and 1."""
    w = Window.partitionBy(group)
    r = df.select(group, x, tie, F.row_number().over(w.orderBy(y, tie)).alias("_r"))
    r = r.withColumn("_d", F.abs(F.col("_r") - F.lag("_r").over(w.orderBy(x, tie))))
    return r.groupBy(group).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(divide(3.0 * F.sum("_d"), (F.count("*") * F.count("*") - 1).cast("double")), F.lit(0.0)))).alias("xi"))


def binned_mi(df: DataFrame, x: str, y: str, bins: int, group: str) -> DataFrame:
    """group, mi: mutual information of rank bins with the Miller-Madow correction, not below 0, in nats."""
    w = Window.partitionBy(group)
    b = average_ranks(df.select(group, x, y), [group], [x, y]).select(group, *(F.least(F.floor((F.col(r) - 1) * bins / F.col("_n")), F.lit(bins - 1)).alias(n) for r, n in (("_r0", "_a"), ("_r1", "_b"))))
    cells = b.groupBy(group, "_a", "_b").agg(F.count("*").alias("c"))

    def entropy(by: list[str], name: str) -> DataFrame:
        c = cells.groupBy(group, *by).agg(F.sum("c").alias("c")) if by != ["_a", "_b"] else cells
        p = F.col("c") / F.sum("c").over(w)
        return c.withColumn("p", p).groupBy(group).agg((-F.sum(F.col("p") * F.ln("p"))).alias(name), F.count("*").alias(f"k{name}"), F.sum("c").alias(f"n{name}"))

    out = reduce(lambda a, c: a.join(c, group), (entropy(["_a"], "hx"), entropy(["_b"], "hy"), entropy(["_a", "_b"], "hxy")))
    bias = (F.col("khxy") - F.col("khx") - F.col("khy") + 1) / (2 * F.col("nhxy"))
    return out.select(group, F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy") - bias).alias("mi"))


def mi_coefficient(mi: Column) -> Column:
    return F.sqrt(1 - F.exp(-2 * mi))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("n"), *(F.count(F.when(nan_to_null(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(columns)))
    return row.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)))).alias("x")).select("x.feature", "x.missing", divide(F.col("x.missing").cast("double"), F.col("n").cast("double")).alias("rate"))


def missing_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature_a, feature_b, corr and jaccard of the missing masks."""
    m = df.select(*(nan_to_null(c).isNull().cast("double").alias(c) for c in columns))
    names = list(combinations(columns, 2))
    both = lambda a, b: F.sum(F.col(a) * F.col(b))
    jac = _pairs(m, names, lambda a, b: F.coalesce(divide(both(a, b), F.sum(a) + F.sum(b) - both(a, b)), F.lit(0.0))).withColumnRenamed("value", "jaccard")
    return _pairs(m, names, lambda a, b: safe_corr(F.col(a), F.col(b))).withColumnRenamed("value", "corr").join(jac, ["feature_a", "feature_b"])


def group_stats(df: DataFrame, group: str, value: str, least: int = 2) -> DataFrame:
    v = value
    return df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile(v, F.lit(0.25)).alias("q1"), F.percentile(v, F.lit(0.75)).alias("q3")).filter(F.col("n") >= least)


def welch(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """One row: Welch's t, its degrees of freedom and Cohen's d (mean of the variances) of flagged against other rows."""
    a, b = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    d = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    gap = F.col("ma") - F.col("mb")
    return d.select(divide(gap, F.sqrt(ea + eb)).alias("t"), divide((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1)).alias("df"), divide(gap, F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("d"))


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: Levene's statistic about the medians."""
    med = df.groupBy(group).agg(F.median(value).alias("_m"))
    z = df.join(med, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("z"))
    g = z.groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    t = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"))
    s = g.join(F.broadcast(t)).agg(F.sum(F.col("n") * (F.col("m") - F.col("mm")) ** 2).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.first("total").alias("total"), F.first("k").alias("k"))  # t: one row
    return s.select(divide((F.col("total") - F.col("k")) * F.col("b"), (F.col("k") - 1) * F.col("w")).alias("levene"))


def kruskal(df: DataFrame, strata: str, group: str, value: str) -> DataFrame:
    """Per stratum: H with tie correction and eta squared, from average ranks."""
    r = df.select(strata, group, F.col(value), average_rank([strata], value).alias("_r"))
    g = r.groupBy(strata, group).agg(F.count("*").alias("n"), F.sum("_r").alias("r"))
    ties = r.groupBy(strata, value).agg(F.count("*").alias("t")).groupBy(strata).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = g.groupBy(strata).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).join(ties, strata)
    n = F.col("n").cast("double")
    h = divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n**3 - n))
    return s.select(strata, "n", "k", h.alias("h"), divide(h - F.col("k") + 1, n - F.col("k")).alias("eta2"))


def mann_whitney(df: DataFrame, strata: str, flag: Column, value: str) -> DataFrame:
    """Per stratum: U of the flagged rows and the rank-biserial correlation."""
    r = df.select(strata, flag.alias("_f"), average_rank([strata], value).alias("_r"))
    g = r.groupBy(strata).agg(F.count(F.when(F.col("_f"), 1)).alias("a"), F.count(F.when(~F.col("_f"), 1)).alias("b"), F.sum(F.when(F.col("_f"), F.col("_r"))).alias("r"))
    u = F.col("r") - F.col("a") * (F.col("a") + 1) / 2
    return g.select(strata, "a", "b", u.alias("u"), (2 * divide(u, (F.col("a") * F.col("b")).cast("double")) - 1).alias("rank_biserial"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi squared of the contingency table and Cramer's V."""
    c = df.groupBy(a, b).agg(F.count("*").alias("o"))
    # Distinct values, not rows, meet in these windows.
    rows, cols = Window.partitionBy(a), Window.partitionBy(b)
    c = c.withColumn("ra", F.sum("o").over(rows)).withColumn("cb", F.sum("o").over(cols))
    n = df.agg(F.count("*").alias("n"))
    s = c.join(F.broadcast(n)).agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.first("n").alias("n"))  # n: one row
    chi = F.col("n") * (F.col("s") - 1)
    return s.select(chi.alias("chi2"), F.sqrt(F.greatest(F.lit(0.0), F.coalesce(divide(chi, (F.col("n") * (F.least("ka", "kb") - 1)).cast("double")), F.lit(0.0)))).alias("v"))


def tail_dependence(df: DataFrame, x: str, y: str, q: float, group: str) -> DataFrame:
    """Per group: share of rows above the q rank of x that are above it in y, and the same below 1 - q."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    r = dealt(df.select(group, x, y), group).select(group, (average_rank([group], x) / n).alias("u"), (average_rank([group], y) / n).alias("v"))
    both = lambda a, b: F.coalesce(divide(F.sum((a & b).cast("double")), F.sum(a.cast("double"))), F.lit(0.0))
    return r.groupBy(group).agg(both(F.col("u") > q, F.col("v") > q).alias("upper"), both(F.col("u") <= 1 - q, F.col("v") <= 1 - q).alias("lower"))


def regime_corr(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """One row: correlation below and above the median of by, their difference, and whether it exceeds 0.3."""
    m = column_percentiles(df, [by], [0.5]).select(F.col(by)[0].alias("_m"))
    d = df.join(F.broadcast(m))  # one row
    low = F.col(by) <= F.col("_m")
    side = lambda on: safe_corr(F.when(on, F.col(x)), F.when(on, F.col(y)))
    return d.agg(side(low).alias("below"), side(~low).alias("above")).withColumn("gap", F.abs(F.col("below") - F.col("above"))).withColumn("differs", F.col("gap") > 0.3)


def form_fits(df: DataFrame, x: str, y: str) -> DataFrame:
    """R squared of y on x, ln x, and of ln y on x, over rows where the logs exist."""
    lx, ly = F.when(F.col(x) > 0, F.ln(x)), F.when(F.col(y) > 0, F.ln(y))
    r2 = lambda a, b: safe_corr(a, b) * safe_corr(a, b)
    return df.agg(r2(F.col(x), F.col(y)).alias("linear"), r2(lx, F.col(y)).alias("logarithmic"), r2(F.col(x), ly).alias("exponential"), r2(lx, ly).alias("power"))


def duplicate_ratio(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("_c")).agg(F.sum("_c").alias("rows"), F.count("*").alias("distinct")).withColumn("ratio", divide(F.col("distinct").cast("double"), F.col("rows").cast("double")))


#: Ordered parts of a column's distinct values; prefix sums run within them in parallel, over their totals in one task.
PARTS = 64


def _cuts(df: DataFrame, c: str) -> list[float]:
    """Values that cut the column's distinct values into about PARTS parts; any cuts give the same ranks."""
    p = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    return sorted(set(df.select(c).distinct().agg(F.percentile_approx(c, p, F.lit(PARTS * 20)).alias("q")).first().q or []))


def _part(c: str, cuts: list) -> Column:
    """How many of the sorted cuts are below c, by bisection."""

    def between(a: int, b: int) -> Column:
        m = (a + b) // 2
        return F.lit(a) if a == b else F.when(F.col(c) > F.lit(cuts[m]), between(m + 1, b)).otherwise(between(a, m))

    return between(0, len(cuts))


def _below(counts: DataFrame, part: str, order: list[str]) -> DataFrame:
    """counts with _below, the sum of _c over the rows before: within the part by a window, over the parts from their totals."""
    totals = counts.groupBy(part).agg(F.sum("_c").alias("_t"))
    base = totals.withColumn("_base", F.sum("_t").over(Window.orderBy(part)) - F.col("_t")).select(part, "_base")  # at most PARTS rows
    w = Window.partitionBy(part).orderBy(*order)
    return counts.withColumn("_in", F.sum("_c").over(w) - F.col("_c")).join(F.broadcast(base), part).withColumn("_below", F.col("_in") + F.col("_base")).drop("_in", "_base", part)


def value_ranks(df: DataFrame, c: str) -> DataFrame:
    """c, _c, rank: each distinct value that isn't null, its count and its average rank in the whole table."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_c"))
    ranked = _below(counts.withColumn("_part", _part(c, _cuts(df, c))), "_part", [c])
    return ranked.select(c, "_c", (F.col("_below") + (F.col("_c") + 1) / 2).alias("rank"))


def whole_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks in the whole table as columns of the same names; of rows where none of the columns is null. Distinct combinations are ranked, with their count _c."""
    out = df.na.drop(subset=columns)
    ranks = [value_ranks(out, c).select(c, F.col("rank").alias(f"_{c}")) for c in columns]
    out = out.groupBy(*columns).agg(F.count("*").alias("_c"))
    for c, r in zip(columns, ranks, strict=True):
        out = out.join(r, c)
    return out.select(*(F.col(f"_{c}").alias(c) for c in columns), "_c")


def whole_spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlations of the whole table."""

    def value(a: str, b: str) -> Column:
        m = F.col("_mid")
        dot = lambda x, y: F.sum((F.col(x) - m) * (F.col(y) - m) * F.col("_c"))
        return F.coalesce(divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))

    r = whole_ranks(df, columns)
    mid = df.na.drop(subset=columns).agg(((F.count("*") + 1) / 2).alias("_mid"))  # one row: the mean of average ranks
    return _pairs(r.join(F.broadcast(mid)), list(combinations(columns, 2)), value)


def _places(df: DataFrame, c: str, tie: str) -> DataFrame:
    """df with _place, 1 to n by c, then by the unique tie. Counts per value and part of the tie are summed, so that no value fills one task."""
    cut, tied = _part(c, _cuts(df, c)), _part(tie, _cuts(df, tie))
    parted = df.withColumn("_part", cut).withColumn("_tied", tied)
    cells = _below(parted.groupBy("_part", c, "_tied").agg(F.count("*").alias("_c")), "_part", [c, "_tied"]).select(c, "_tied", "_below")
    inside = parted.withColumn("_i", F.row_number().over(Window.partitionBy(c, "_tied").orderBy(tie)))
    return inside.join(cells, [c, "_tied"]).withColumn("_place", F.col("_i") + F.col("_below")).drop("_part", "_tied", "_i", "_below")


def whole_chatterjee(df: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """One row: xi of the whole table as the mean of both directions, each within 0 and 1; ties in the order of the unique tie."""
    d = df.na.drop(subset=[x, y]).select(x, y, tie)
    placed = _places(_places(d, x, tie).withColumnRenamed("_place", "_x"), y, tie).select("_x", F.col("_place").alias("_y"))

    def steps(a: str, b: str) -> DataFrame:
        after = placed.select((F.col(a) - 1).alias(a), F.col(b).alias("_next"))
        return placed.join(after, a).agg(F.sum(F.abs(F.col("_next") - F.col(b))).alias(f"d{a}"))

    n = d.agg(F.count("*").cast("double").alias("n"))
    xi = lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(divide(3.0 * F.col(s), F.col("n") * F.col("n") - 1), F.lit(0.0))))
    return n.join(F.broadcast(steps("_x", "_y"))).join(F.broadcast(steps("_y", "_x"))).select(((xi("d_x") + xi("d_y")) / 2).alias("xi"))  # one row each


def whole_binned_mi(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """One row, mi of the whole table: rank bins, Miller-Madow, not below 0, in nats."""
    n = df.na.drop(subset=[x, y]).agg(F.count("*").alias("_n"))
    bin_ = lambda c: F.least(F.floor((F.col(c) - 1) * bins / F.col("_n")), F.lit(bins - 1))
    cells = whole_ranks(df, [x, y]).join(F.broadcast(n)).groupBy(bin_(x).alias("_a"), bin_(y).alias("_b"), "_n").agg(F.sum("_c").alias("c"))

    def entropy(by: list[str], name: str) -> DataFrame:
        p = F.col("c") / F.col("_n")
        return cells.groupBy(*by, "_n").agg(F.sum("c").alias("c")).agg((-F.sum(p * F.ln(p))).alias(name), F.count("*").alias(f"k{name}"))

    out = reduce(lambda a, c: a.join(F.broadcast(c)), (n, entropy(["_a"], "hx"), entropy(["_b"], "hy"), entropy(["_a", "_b"], "hxy")))  # one row each
    bias = (F.col("khxy") - F.col("khx") - F.col("khy") + 1) / (2 * F.col("_n"))
    return out.select(F.greatest(F.lit(0.0), F.col("hx") + F.col("hy") - F.col("hxy") - bias).alias("mi"))


def whole_kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n, k, H with tie correction and eta squared over the whole table."""
    d = df.na.drop(subset=[group, value])
    ranks = value_ranks(d, value)
    g = d.groupBy(group, value).agg(F.count("*").alias("_m")).join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("_m").alias("n"), F.sum(F.col("_m") * F.col("rank")).alias("r"))
    c = F.col("_c").cast("double")
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).join(F.broadcast(ranks.agg(F.sum(c**3 - c).alias("ties"))))  # one row each
    n = F.col("n").cast("double")
    h = divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n**3 - n))
    return s.select("n", "k", h.alias("h"), divide(h - F.col("k") + 1, n - F.col("k")).alias("eta2"))


def whole_mann_whitney(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """One row: U of the flagged rows of the whole table and the rank-biserial correlation."""
    d = df.select(flag.alias("_f"), value).na.drop()
    m = d.groupBy("_f", value).agg(F.count("*").alias("_m")).join(value_ranks(d, value).select(value, "rank"), value)
    g = m.agg(F.coalesce(F.sum(F.when(F.col("_f"), F.col("_m"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~F.col("_f"), F.col("_m"))), F.lit(0)).alias("b"), F.sum(F.when(F.col("_f"), F.col("_m") * F.col("rank"))).alias("r"))
    u = F.col("r") - F.col("a") * (F.col("a") + 1) / 2
    return g.select("a", "b", u.alias("u"), (2 * divide(u, F.col("a").cast("double") * F.col("b")) - 1).alias("rank_biserial"))


def whole_tail_dependence(df: DataFrame, x: str, y: str, q: float) -> DataFrame:
    """One row: of the rows above the q rank of x in the whole table the share above it in y, and the same below 1 - q."""
    n = df.na.drop(subset=[x, y]).agg(F.count("*").alias("_n"))
    r = whole_ranks(df, [x, y]).join(F.broadcast(n)).select((F.col(x) / F.col("_n")).alias("u"), (F.col(y) / F.col("_n")).alias("v"), "_c")
    both = lambda a, b: F.coalesce(divide(F.sum(F.when(a & b, F.col("_c")).otherwise(0)).cast("double"), F.sum(F.when(a, F.col("_c")).otherwise(0)).cast("double")), F.lit(0.0))
    return r.agg(both(F.col("u") > q, F.col("v") > q).alias("upper"), both(F.col("u") <= 1 - q, F.col("v") <= 1 - q).alias("lower"))


def sketches(df: DataFrame, columns: list[str], error: float = 0.05, exact: bool = False) -> DataFrame:
    """feature, distinct, median by sketches that merge (HyperLogLog++, Greenwald-Khanna); with exact, whether both lie within the error instead."""
    out = None
    for c in columns:
        row = df.agg(F.lit(c).alias("feature"), F.approx_count_distinct(c, error / 3).alias("distinct"), F.percentile_approx(c, F.lit(0.5), F.lit(10_000)).cast("double").alias("median"))
        if exact:
            told = df.agg(F.countDistinct(c).alias("_d")).join(F.broadcast(column_percentiles(df, [c], [0.5 - error, 0.5 + error]).select(F.col(c).alias("_q"))))  # one row each
            row = row.join(F.broadcast(told)).select("feature", (F.abs(F.col("distinct") - F.col("_d")) <= error * F.col("_d")).alias("distinct_close"), F.col("median").between(F.col("_q")[0], F.col("_q")[1]).alias("median_close"))
        out = row if out is None else out.unionByName(row)
    return out

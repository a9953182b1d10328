"""Categorical encoders: each fits a small table per category and applies it by a join, or computes it in one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import divide

MISSING = "MISSING"


def token(c: str) -> Column:
    """NULL and empty strings as one token."""
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(MISSING))


def top_k(df: DataFrame, c: str, k: int, out: str, other: str = "OTHER") -> DataFrame:
    """The k most frequent categories, others as one; ties by name."""
    counts = df.groupBy(c).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), c).limit(k).select(c, F.lit(True).alias("_top"))
    return df.join(F.broadcast(counts), c, "left").withColumn(out, F.when(F.col("_top"), F.col(c)).otherwise(other)).drop("_top")


def one_hot(df: DataFrame, c: str, categories: list[str]) -> DataFrame:
    return df.select("*", *((F.coalesce(F.col(c) == v, F.lit(False))).cast("int").alias(f"{c}_{v}") for v in sorted(categories)))


def ordinal_map(df: DataFrame, c: str) -> DataFrame:
    """category, code from 0 in name order. One row per category meets in the window."""
    return df.select(F.col(c).alias("category")).filter("category is not null").distinct().withColumn("code", (F.row_number().over(Window.orderBy("category")) - 1).cast("long"))


def apply_map(df: DataFrame, c: str, mapping: DataFrame, value: str, out: str, default: Column) -> DataFrame:
    """Left join with a default for unseen categories; Spark broadcasts the mapping only below its size threshold."""
    m = mapping.select(F.col("category").alias(c), F.col(value).alias(out))
    return df.join(m, c, "left").withColumn(out, F.coalesce(out, default))


def frequency_map(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(token(c).alias("category")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t"))
    return counts.join(F.broadcast(total)).select("category", divide(F.col("n").cast("double"), F.col("t").cast("double")).alias("freq"))  # total: one row


def hashed(c: str, buckets: int) -> Column:
    return F.pmod(F.hash(token(c)), F.lit(buckets)).cast("long")


def kfold_target(df: DataFrame, c: str, y: str, fold: str, weight: float, out: str) -> DataFrame:
    """Out-of-fold target mean shrunk to the other folds' mean: totals less the row's own fold."""
    per = df.groupBy(c, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    w = Window.partitionBy(c)
    per = per.withColumn("_so", F.sum("_s").over(w) - F.col("_s")).withColumn("_no", F.sum("_n").over(w) - F.col("_n")).drop("_s", "_n")
    folds = df.groupBy(fold).agg(F.sum(y).alias("_fs"), F.count(y).alias("_fn"))
    every = folds.agg(F.sum("_fs").alias("_ts"), F.sum("_fn").alias("_tn"))
    prior = folds.join(F.broadcast(every)).select(fold, divide(F.col("_ts") - F.col("_fs"), (F.col("_tn") - F.col("_fn")).cast("double")).alias("_prior"))  # one row per fold
    enc = F.coalesce(divide(F.col("_so") + weight * F.col("_prior"), F.col("_no") + weight), F.col("_prior"))
    return df.join(per, [c, fold]).join(F.broadcast(prior), fold).withColumn(out, enc).drop("_so", "_no", "_prior")


def leave_one_out(df: DataFrame, c: str, y: str, out: str) -> DataFrame:
    """(sum - y) / (n - 1) of the category; a single row gets the overall mean."""
    per = df.groupBy(c).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    prior = df.agg(F.avg(y).alias("_p"))
    return df.join(per, c).join(F.broadcast(prior)).withColumn(out, F.coalesce(divide(F.col("_s") - F.col(y), (F.col("_n") - 1).cast("double")), F.col("_p"))).drop("_s", "_n", "_p")


def james_stein_map(df: DataFrame, c: str, y: str) -> DataFrame:
    """category, value = (1 - b) prior + b mean, with b = s2 / (s2 + v / n) held within 0 and 1."""
    per = df.groupBy(F.col(c).alias("category")).agg(F.avg(y).alias("m"), F.count(y).alias("n"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"))
    prior = df.agg(F.avg(y).alias("p"), F.var_samp(y).alias("s2"))
    b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(divide(F.col("s2"), F.col("s2") + F.col("v") / F.col("n")), F.lit(0.0))))
    return per.join(F.broadcast(prior)).select("category", ((1 - b) * F.col("p") + b * F.col("m")).alias("value"))  # prior: one row


def woe_map(df: DataFrame, c: str, event: Column, smooth: float = 0.5) -> DataFrame:
    """category, woe, iv_part from smoothed event and non-event shares."""
    per = df.groupBy(token(c).alias("category")).agg(F.sum(event.cast("double")).alias("e"), F.sum((~event).cast("double")).alias("x"))
    every = per.agg(F.sum("e").alias("te"), F.sum("x").alias("tx"), F.count("*").alias("k"))
    pe, px = (F.col("e") + smooth) / (F.col("te") + smooth * F.col("k")), (F.col("x") + smooth) / (F.col("tx") + smooth * F.col("k"))
    return per.join(F.broadcast(every)).select("category", F.ln(pe / px).alias("woe"), ((pe - px) * F.ln(pe / px)).alias("iv_part"))  # one row


def ordered_target(c: str, y: str, order: list[str], prior: float, weight: float) -> Column:
    """Target statistic from the category's earlier rows only."""
    w = Window.partitionBy(c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (F.coalesce(F.sum(y).over(w), F.lit(0.0)) + prior * weight) / (F.count(y).over(w) + weight)


def choose(df: DataFrame, columns: list[str], y: str | None = None, tree: bool = False, least_rows: int = 50, above: int = 10) -> DataFrame:
    """feature, categories (null is one), strategy: onehot, ordinal, freq, hashing or target_kfold.

    For trees up to 8, 255 and 5000 categories the first three, hashing beyond. Otherwise target_kfold where the target's mean differs between more than
    `above` and less than 10,000 categories of at least `least_rows` rows; then onehot up to 12, freq up to 1000, hashing beyond. Counts per category, one pass."""
    target = F.col(y).cast("double") if y else F.lit(None).cast("double")
    long = df.select(target.alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns))).alias("m")).select("_y", "m.*")
    cells = long.groupBy("feature", "v").agg(F.count("*").alias("n"), F.avg("_y").alias("m"))
    s = cells.groupBy("feature").agg(F.count("*").alias("categories"), F.sum("n").alias("n"), F.coalesce(F.max("m") > F.min("m"), F.lit(False)).alias("differs"))
    k = F.col("categories")
    if tree:
        strategy = F.when(k <= 8, "onehot").when(k <= 255, "ordinal").when(k <= 5000, "freq").otherwise("hashing")
    else:
        strategy = F.when(F.col("differs") & (F.col("n") >= least_rows) & (k > above) & (k < 10_000), "target_kfold").when(k <= 12, "onehot").when(k <= 1000, "freq").otherwise("hashing")
    return s.select("feature", "categories", strategy.alias("strategy"))


def group_folds(df: DataFrame, group: str, folds: int, out: str = "fold") -> DataFrame:
    """Adds out: a fold by the group, so that a group's rows share one; groups are numbered in order (strings in the order of a hash), in ordered parts, and dealt in turn."""
    from .mining import _places

    kind = dict(df.dtypes)[group]
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    groups = groups.withColumn("_t", F.xxhash64(group) if kind == "string" else F.col(group))
    fold = F.pmod(F.col("_place") - 1, F.lit(folds)).cast("long")
    return df.join(_places(groups, "_t", "_t").select(group, fold.alias(out)), group, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def time_folds(df: DataFrame, time: str, tie: str, folds: int, out: str = "fold") -> DataFrame:
    """Adds out: 1 to folds for the last folds * (n div (folds + 1)) rows by time, equally many each, and 0 for the rows before; ties by the unique tie."""
    from .mining import _places

    seconds = df.withColumn("_time", F.col(time).cast("timestamp").cast("double"))
    placed = _places(seconds.filter("_time is not null"), "_time", tie).drop("_time")
    n = placed.agg(F.count("*").alias("_n"))  # one row
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / (folds + 1)))
    at = F.floor((F.col("_place") - 1 - (F.col("_n") - folds * size)) / size) + 1
    return placed.join(F.broadcast(n)).withColumn(out, F.greatest(F.lit(0), at).cast("long")).drop("_place", "_n")


def forward_target(df: DataFrame, c: str, y: str, fold: str, weight: float, out: str) -> DataFrame:
    """Adds out: the category's target mean over the folds before the row's own, shrunk by weight to the mean of all rows of those folds. Without rows before, the mean of all rows."""
    w = lambda *by: Window.partitionBy(*by).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  # a row a fold
    per = df.groupBy(c, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    per = per.select(c, fold, F.sum("_s").over(w(c)).alias("_s"), F.sum("_n").over(w(c)).alias("_n"))
    folds = df.groupBy(fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    whole = df.agg(F.avg(y).alias("_all"))  # one row
    prior = folds.select(fold, divide(F.sum("_s").over(w(F.lit(0))), F.sum("_n").over(w(F.lit(0))).cast("double")).alias("_prior")).join(F.broadcast(whole)).select(fold, F.coalesce("_prior", "_all").alias("_prior"))
    enc = F.coalesce(divide(F.coalesce("_s", F.lit(0.0)) + weight * F.col("_prior"), F.coalesce("_n", F.lit(0)) + F.lit(float(weight))), F.col("_prior"))
    return df.join(per, [c, fold], "left").join(prior, fold).withColumn(out, enc).drop("_s", "_n", "_prior")

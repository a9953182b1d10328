"""Ordered-series operators. Every one takes a Series: keys that split rows into independent series and an order within them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.expr import divide


@dataclass(frozen=True)
class Series:
    """Keys spread series over partitions; order must be total within a key (a unique id breaks ties)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def by(self) -> WindowSpec:
        return self.all.orderBy(*self.order)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self.by.rowsBetween(start, end)

    @property
    def past(self) -> WindowSpec:
        return self.by.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def future(self) -> WindowSpec:
        return self.by.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    def position(self) -> Column:
        return (F.row_number().over(self.by) - 1).cast("long")

    def size(self) -> Column:
        return F.count("*").over(self.all)


def sliding_windows(df: DataFrame, s: Series, features: list[str], targets: list[str], width: int, horizon: int) -> DataFrame:
    """keys, start, x (width rows of features), y (horizon rows of targets); N = T - width - horizon + 1 per series."""
    x = F.collect_list(F.array(*features)).over(s.rows(0, width - 1))
    y = F.collect_list(F.array(*targets)).over(s.rows(width, width + horizon - 1)) if horizon else F.array().cast("array<array<double>>")
    return df.select(*s.keys, s.position().alias("start"), s.size().alias("_t"), x.alias("x"), y.alias("y")).filter(F.col("start") <= F.col("_t") - width - horizon).drop("_t")


def strided_windows(df: DataFrame, s: Series, value: str, width: int, stride: int) -> DataFrame:
    """Windows at every stride-th row, with masks of present values."""
    frame = s.rows(0, width - 1)
    out = df.select(*s.keys, s.position().alias("start"), s.size().alias("_t"), F.collect_list(F.coalesce(value, F.lit(0.0))).over(frame).alias("x"), F.collect_list(F.col(value).isNotNull().cast("int")).over(frame).alias("mask"))
    return out.filter((F.col("start") <= F.col("_t") - width) & (F.col("start") % stride == 0)).drop("_t")


def overlap_mean(windows: DataFrame, s: Series, value: str = "x") -> DataFrame:
    """Back to points: the mean over all windows that cover a position."""
    return windows.select(*s.keys, "start", F.posexplode(value).alias("k", "v")).groupBy(*s.keys, (F.col("start") + F.col("k")).alias("i")).agg(F.avg("v").alias("v"), F.count("*").alias("covered"))


def window_to_point(s: Series, score: str, width: int, align: str = "end", reduce: str = "max") -> Column:
    """Scores of windows (by start row) as scores of rows: at the window's end, its centre, or over all windows that cover a row."""
    if align == "end":
        return F.lag(score, width - 1).over(s.by)
    if align == "center":
        return F.lag(score, width // 2).over(s.by)
    return (F.max if reduce == "max" else F.avg)(score).over(s.rows(-(width - 1), 0))


def centred_average(s: Series, value: str, width: int) -> Column:
    half = (width if width % 2 else width + 1) // 2
    return F.avg(value).over(s.rows(-half, half))


def rolling_std(s: Series, value: str, width: int) -> Column:
    frame = s.rows(-(width - 1), 0)
    return F.when(F.count(value).over(frame) == width, F.stddev_samp(value).over(frame))


def first_difference(s: Series, value: str) -> Column:
    return F.coalesce(F.col(value) - F.lag(value).over(s.by), F.lit(0.0))


def seasonal_difference(df: DataFrame, s: Series, value: str, d: int, seasonal: int, period: int) -> DataFrame:
    """d differences of lag 1, then seasonal ones of the period; rows without a full history are dropped."""
    df = df.withColumn("_d", F.col(value)).withColumn("_i", s.position())
    for lag in [1] * d + [period] * seasonal:
        df = df.withColumn("_d", F.col("_d") - F.lag("_d", lag).over(s.by))
    return df.filter(F.col("_i") >= d + seasonal * period).withColumnRenamed("_d", "diff").drop("_i")


def inverse_difference(s: Series, diff: str, start: Column) -> Column:
    """Levels from lag-1 differences and the level before the first."""
    return start + F.sum(diff).over(s.past)


def pct_change(s: Series, value: str) -> Column:
    return divide(F.col(value), F.lag(value).over(s.by)) - 1


def cusum(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Largest |running sum of deviations| over (population std * sqrt n), its row, and whether it exceeds 1.5."""
    df = df.select(*s.keys, *s.order, s.position().alias("_i"), F.avg(value).over(s.all).alias("_m"), F.stddev_pop(value).over(s.all).alias("_s"), s.size().alias("_n"), F.col(value).alias("_v"))
    df = df.withColumn("_c", F.abs(F.sum(F.col("_v") - F.col("_m")).over(s.past)))
    out = df.groupBy(*s.keys).agg(F.max("_c").alias("_top"), F.max_by("_i", F.struct(F.round("_c", 6), -F.col("_i"))).alias("at"), F.first("_s").alias("_s"), F.first("_n").alias("_n"))
    stat = F.coalesce(divide(F.col("_top"), F.col("_s") * F.sqrt("_n")), F.lit(0.0))
    return out.select(*s.keys, stat.alias("cusum"), "at", (stat > 1.5).alias("is_break"))


def drawdown(s: Series, value: str) -> Column:
    """Level against the highest level so far, minus 1."""
    return divide(F.col(value), F.max(value).over(s.past)) - 1


def fill_forward(s: Series, value: str) -> Column:
    return F.last(value, True).over(s.past)


def fill_back(s: Series, value: str) -> Column:
    return F.first(value, True).over(s.future)


def fill_both(s: Series, value: str, last: Column | None = None) -> Column:
    """Forward, then back for the head; what is left (an empty series) takes the last value given."""
    parts = [fill_forward(s, value), fill_back(s, value)]
    return F.coalesce(*parts, *([last] if last is not None else []))


def interpolate(df: DataFrame, s: Series, value: str, out: str) -> DataFrame:
    """Linear in the row index, constant beyond the first and last present value."""
    df = df.withColumn("_i", s.position())
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    df = df.withColumn("_v0", fill_forward(s, value)).withColumn("_v1", fill_back(s, value)).withColumn("_i0", F.last(at, True).over(s.past)).withColumn("_i1", F.first(at, True).over(s.future))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * divide((F.col("_i") - F.col("_i0")).cast("double"), (F.col("_i1") - F.col("_i0")).cast("double"))
    return df.withColumn(out, F.coalesce(value, line, "_v0", "_v1")).drop("_i", "_v0", "_v1", "_i0", "_i1")


def lag_fill(s: Series, value: str, lag: int) -> Column:
    """From the row lag steps before, where that is present (gaps shorter than the lag)."""
    return F.coalesce(F.col(value), F.lag(value, lag).over(s.by))


def mean_fill(s: Series, value: str) -> Column:
    return F.coalesce(F.col(value), F.avg(value).over(s.all), F.lit(0.0))


def hybrid_fill(df: DataFrame, s: Series, value: str, out: str, lag: int = 24) -> DataFrame:
    df = interpolate(df, s, value, "_h")
    df = df.withColumn("_h2", lag_fill(s, "_h", lag))
    return df.withColumn(out, mean_fill(s, "_h2")).drop("_h", "_h2")


def longest_run(df: DataFrame, s: Series, condition: Column, out: str) -> DataFrame:
    """Longest run of rows for which the condition holds, per series."""
    df = df.select(*s.keys, condition.alias("_on"), F.sum(F.when(condition, 0).otherwise(1)).over(s.past).alias("_island"))
    runs = df.groupBy(*s.keys, "_island").agg(F.sum(F.col("_on").cast("long")).alias("_n"))
    return runs.groupBy(*s.keys).agg(F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias(out))


def autocorrelation(df: DataFrame, s: Series, value: str, lags: int) -> DataFrame:
    """keys, lag, acf = sum of (x_t - m)(x_{t+k} - m) over n times the population variance."""
    df = df.select(*s.keys, *s.order, (F.col(value) - F.avg(value).over(s.all)).alias("_c")) if value not in s.order else df
    later = [F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_p{k}") for k in range(1, lags + 1)]
    df = df.select(*s.keys, "_c", *(F.lead("_c", k).over(s.by).alias(f"_l{k}") for k in range(1, lags + 1)))
    sums = df.groupBy(*s.keys).agg(F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_v"), *later)
    long = sums.select(*s.keys, "n", "_v", F.posexplode(F.array(*(F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) for k in range(1, lags + 1)))).alias("_k", "_p"))
    return long.select(*s.keys, "n", (F.col("_k") + 1).cast("long").alias("lag"), F.coalesce(divide(F.col("_p"), F.col("_v")), F.lit(0.0)).alias("acf"))


def ljung_box(acf: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    return acf.filter(F.col("lag") < n).groupBy(*keys).agg((F.max(n * (n + 2)) * F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag")))).alias("q"))


def first_crossing(acf: DataFrame, keys: list[str], level: float) -> DataFrame:
    return acf.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("acf") < level, F.col("lag"))), F.max("lag")).alias("lag"))


def crossing_rate(s: Series, value: str, level: Column) -> Column:
    """1 where the sign about the level changes from the row before; averaged, the crossing rate."""
    now = F.col(value) - level
    return (now * F.lag(now).over(s.by) < 0).cast("int")


def trend(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Least squares on the row index: slope, intercept, R squared and a direction class."""
    df = df.select(*s.keys, s.position().cast("double").alias("_i"), F.col(value).alias("_v"))
    cov, vi, vv = F.covar_pop("_i", "_v"), F.var_pop("_i"), F.var_pop("_v")
    out = df.groupBy(*s.keys).agg(F.coalesce(divide(cov, vi), F.lit(0.0)).alias("slope"), (F.avg("_v") - F.coalesce(divide(cov, vi), F.lit(0.0)) * F.avg("_i")).alias("intercept"), F.coalesce(divide(cov * cov, vi * vv), F.lit(0.0)).alias("r2"))
    return out.withColumn("direction", F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat"))


def rank_normalise(s: Series, value: str, tie: list[str], invert: bool = False) -> Column:
    """Ordinal rank over (n - 1); a single value gives 0.5."""
    r = F.coalesce(divide((F.row_number().over(s.all.orderBy(value, *tie)) - 1).cast("double"), (s.size() - 1).cast("double")), F.lit(0.5))
    return 1 - r if invert else r


def ecdf_rank(s: Series, value: str, tie: list[str]) -> Column:
    return F.row_number().over(s.all.orderBy(value, *tie)) / (s.size() + 1)


def latest(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """The newest row per key; Spark keeps one row per key and task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))).filter("_r = 1").drop("_r")


def rolling_origins(df: DataFrame, s: Series, step: int, train: int, horizon: int) -> DataFrame:
    """Rows with fold and part (train, test): fold f trains on rows f*step .. f*step+train-1 and tests on the next horizon."""
    df = df.withColumn("i", s.position()).withColumn("_n", s.size())
    last = F.floor((F.col("_n") - train - horizon) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - train - horizon + 1) / step))
    high = F.least(last, F.floor(F.col("i") / step))
    folds = df.filter(F.col("_n") >= train + horizon).filter(low <= high).withColumn("fold", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    return folds.withColumn("part", F.when(F.col("i") < F.col("fold") * step + train, "train").otherwise("test")).drop("_n")


def chronological_split(s: Series, train: float, validation: float) -> Column:
    at = s.position() / s.size()
    return F.when(at < train, "train").when(at < train + validation, "val").otherwise("test")


def standardise_on_train(df: DataFrame, s: Series, value: str, is_train: Column) -> DataFrame:
    """mean, std (population, 1 where 0) and the linear trend of the standardised training part, applied to all rows."""
    df = df.withColumn("_i", s.position().cast("double")).withColumn("_tv", F.when(is_train, F.col(value))).withColumn("_ti", F.when(is_train, F.col("_i")))
    df = df.withColumn("mean", F.avg("_tv").over(s.all)).withColumn("std", F.coalesce(F.nullif(F.stddev_pop("_tv").over(s.all), F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("_z", (F.col(value) - F.col("mean")) / F.col("std")).withColumn("_tz", F.when(is_train, F.col("_z")))
    df = df.withColumn("slope", F.coalesce(divide(F.covar_pop("_ti", "_tz").over(s.all), F.var_pop("_ti").over(s.all)), F.lit(0.0)))
    df = df.withColumn("intercept", F.avg("_tz").over(s.all) - F.col("slope") * F.avg("_ti").over(s.all))
    return df.withColumn("scaled", F.col("_z") - F.col("slope") * F.col("_i") - F.col("intercept")).drop("_tv", "_ti", "_z", "_tz").withColumnRenamed("_i", "t")


def restore(scaled: Column) -> Column:
    """The inverse of standardise_on_train, from its columns."""
    return (scaled + F.col("slope") * F.col("t") + F.col("intercept")) * F.col("std") + F.col("mean")


def infer_frequency(df: DataFrame, s: Series, time: str) -> DataFrame:
    """Median absolute step: up to 3 h is 'h', 2 d 'd', 14 d 'w', else 'm'."""
    step = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(F.col(time).cast("timestamp")).over(s.by))) / 1e6
    out = df.select(*s.keys, step.alias("_d")).groupBy(*s.keys).agg(F.median("_d").alias("seconds"))
    return out.withColumn("freq", F.when(F.col("seconds") <= 3 * 3600, "h").when(F.col("seconds") <= 2 * 86400, "d").when(F.col("seconds") <= 14 * 86400, "w").otherwise("m"))


def best_split(df: DataFrame, s: Series, value: str, least: int = 3) -> DataFrame:
    """The row that starts the second part of the split with the largest drop in squared error, with the drop, per series."""
    df = df.select(*s.keys, *s.order, s.position().alias("_i"), s.size().alias("_n"), F.col(value).alias("_v"))
    before = s.by.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_l", F.sum("_v").over(before)).withColumn("_t", F.sum("_v").over(s.all))
    n, at, left, total = F.col("_n"), F.col("_i"), F.col("_l"), F.col("_t")
    df = df.filter((at >= least) & (at <= n - least)).withColumn("gain", left * left / at + (total - left) * (total - left) / (n - at) - total * total / n)
    return df.groupBy(*s.keys).agg(F.max_by("_i", F.struct(F.round("gain", 4), -F.col("_i"))).alias("at"), F.max("gain").alias("gain"))


def block_stability(df: DataFrame, s: Series, value: str, blocks: int) -> DataFrame:
    """Mean and population std of equal blocks of rows, per series and block."""
    return df.select(*s.keys, F.floor(s.position() * blocks / s.size()).cast("long").alias("block"), F.col(value).alias("_v")).groupBy(*s.keys, "block").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def intermittency(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Demand pattern per series of 20 rows or more: activity threshold, mean gap (ADI), squared variation, zero share, longest idle run, class."""
    keys = list(s.keys)
    level = df.groupBy(*keys).agg(F.count("*").alias("n"), F.median(F.when(F.col(value) > 0, F.col(value))).alias("_p"), F.stddev_pop(value).alias("_s"))
    level = level.filter("n >= 20").select(*keys, "n", F.greatest(F.lit(1e-8), 0.05 * F.coalesce("_p", F.lit(0.0)), 0.01 * F.col("_s")).alias("threshold"))
    df = df.select(*keys, *s.order, F.col(value).alias("_v"), s.position().alias("_i")).join(level, keys)
    on = F.abs("_v") > F.col("threshold")
    df = df.withColumn("_on", on).withColumn("_gap", F.when(on, F.col("_i") - F.last(F.when(on, F.col("_i")), True).over(s.by.rowsBetween(Window.unboundedPreceding, -1))))
    idle = longest_run(df, s, ~on, "longest_idle")
    a = F.when(F.col("_on"), F.abs("_v"))
    out = df.groupBy(*keys, "n", "threshold").agg(F.avg("_gap").alias("_g"), F.avg(F.when(F.col("_on"), 0.0).otherwise(1.0)).alias("zero_share"), F.avg(a).alias("_m"), F.stddev_pop(a).alias("_d"), F.count(a).alias("active"))
    out = out.withColumn("adi", F.coalesce("_g", F.when(F.col("active") > 0, F.col("n") / F.col("active")).otherwise(F.col("n")).cast("double"))).withColumn("cv2", F.coalesce(divide(F.col("_d") * F.col("_d"), F.col("_m") * F.col("_m")), F.lit(0.0)))
    kind = F.when((F.col("zero_share") < 0.08) & (F.col("adi") < 1.2), "dense").when((F.col("adi") >= 1.32) & (F.col("cv2") >= 0.49), "lumpy").when(F.col("adi") >= 1.32, "intermittent").when(F.col("cv2") >= 0.49, "erratic").otherwise("smooth")
    return out.withColumn("kind", kind).join(idle, keys).select(*keys, "n", "threshold", "active", "adi", "cv2", "zero_share", "longest_idle", "kind")


def calendar_profile(df: DataFrame, keys: list[str], time: str, value: str, unit: str) -> DataFrame:
    """Per hour, weekday (Monday 0) or month: count, mean and mean as a z-score of all rows of the key."""
    part = {"hour": F.hour(time), "weekday": F.weekday(time), "month": F.month(time)}[unit].cast("long")
    total = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    out = df.groupBy(*keys, part.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(total, keys)
    return out.filter("_n >= 12").select(*keys, "bucket", "n", "mean", F.coalesce(divide(F.col("mean") - F.col("_m"), F.col("_s")), F.lit(0.0)).alias("z"))


def descriptive_features(df: DataFrame, s: Series, value: str) -> DataFrame:
    """Level, spread, shape, lag-1 dependence, crossing rates, longest stretch above the mean and trend, per series."""
    keys = list(s.keys)
    d = df.select(*keys, *s.order, F.col(value).alias("_v"), F.avg(value).over(s.all).alias("_m"), s.position().cast("double").alias("_i"))
    d = d.withColumn("_c", F.col("_v") - F.col("_m")).withColumn("_pv", F.lag("_v").over(s.by)).withColumn("_pc", F.lag("_c").over(s.by))
    c = F.col("_c")
    agg = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.median("_v").alias("median"),
        F.percentile("_v", F.lit(0.25)).alias("q1"), F.percentile("_v", F.lit(0.75)).alias("q3"), F.skewness("_v").alias("skew"), F.kurtosis("_v").alias("kurt"),
        F.coalesce(divide(F.sum(c * F.col("_pc")), F.sum(c * c)), F.lit(0.0)).alias("acf1"),
        F.coalesce(F.avg((c * F.col("_pc") < 0).cast("double")), F.lit(0.0)).alias("mean_crossing"),
        F.coalesce(F.avg(F.abs(F.col("_v") - F.col("_pv"))), F.lit(0.0)).alias("mean_step"), F.sum(F.col("_v") * F.col("_v")).alias("energy"),
        F.coalesce(divide(F.covar_pop("_i", "_v"), F.var_pop("_i")), F.lit(0.0)).alias("slope"),
    )
    return agg.join(longest_run(d, s, F.col("_v") > F.col("_m"), "longest_above"), keys)

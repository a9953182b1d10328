"""Outlier rules, score thresholds, voting and calibration of anomaly scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import bucket, divide, mad, sigmoid
from ..functions.quantiles import column_percentiles
from ..functions.tables import Rounds, dealt
from .mining import _part


def z_scores(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("z", (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8))


def _bounds(df: DataFrame, keys: list[str], value: str, *aggs: Column) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(*aggs), keys)


def iqr_outliers(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """Adds outlier: beyond k interquartile ranges from the quartiles."""
    out = _bounds(df, keys, value, F.percentile(value, F.lit(0.25)).alias("_a"), F.percentile(value, F.lit(0.75)).alias("_b"))
    reach = k * (F.col("_b") - F.col("_a") + 1e-8)
    return out.withColumn("outlier", (F.col(value) < F.col("_a") - reach) | (F.col(value) > F.col("_b") + reach)).drop("_a", "_b")


def mad_outliers(df: DataFrame, keys: list[str], value: str, threshold: float) -> DataFrame:
    """Adds modified_z (0.6745 |x - median| / MAD) and outlier; series whose scores spread more than 3.5 get a threshold higher by 0.5."""
    out = _bounds(df, keys, value, F.median(value).alias("_med"))
    spread = out.groupBy(*keys).agg(mad(F.col(value), F.col("_med")).alias("_mad"))
    out = out.join(spread, keys).withColumn("modified_z", F.coalesce(divide(0.6745 * F.abs(F.col(value) - F.col("_med")), F.col("_mad")), F.lit(0.0)))
    wide = out.groupBy(*keys).agg(F.stddev_pop("modified_z").alias("_w"), F.count(value).alias("_n"))
    limit = F.lit(threshold) + F.when(F.col("_w") > 3.5, 0.5).otherwise(0.0)
    return out.join(wide, keys).withColumn("outlier", (F.col("_n") >= 5) & (F.col("modified_z") > limit)).drop("_med", "_mad", "_w", "_n")


def quantile_outliers(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    out = _bounds(df, keys, value, F.percentile(value, F.lit(share)).alias("_a"), F.percentile(value, F.lit(1 - share)).alias("_b"))
    return out.withColumn("outlier", (F.col(value) < F.col("_a")) | (F.col(value) > F.col("_b"))).drop("_a", "_b")


def hbos(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds score = -ln(density) of the value's histogram bin; bins = sqrt(n), 10 to 50."""
    w = Window.partitionBy(*keys)
    k = F.least(F.lit(50), F.greatest(F.lit(10), F.floor(F.sqrt(F.count(value).over(w)))))
    out = df.withColumn("_n", F.count(value).over(w)).withColumn("_low", F.min(value).over(w)).withColumn("_high", F.max(value).over(w)).withColumn("_k", k)
    out = out.withColumn("_bin", bucket(F.col(value), F.col("_low"), F.col("_high"), F.col("_k")))
    wide = (F.col("_high") - F.col("_low")) / F.col("_k")
    density = divide(F.count(value).over(w.partitionBy(*keys, "_bin")), F.col("_n") * wide)
    return out.withColumn("score", -F.ln(F.coalesce(density, F.lit(1.0)) + 1e-12)).drop("_n", "_low", "_high", "_k", "_bin")


def _tails(out: DataFrame, rows: DataFrame, keys: list[str], v: str, tie: str, cuts: list[float], up: str, down: str) -> DataFrame:
    """out with up and down: each row's place in its key by v, then by the tie, and by falling v, then by the tie. Rows are dealt by key and part of v and sorted there once;
    the sums over the parts before and after come from one row a key and part. rows: those of out, as written. Any cuts give the same places."""
    part, by = _part(v, cuts).alias("_part"), Window.partitionBy(*keys)
    upto = F.sum("_c").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bases = rows.groupBy(*keys, part).agg(F.count("*").alias("_c")).select(*keys, "_part", (upto - F.col("_c")).alias("_below"), (F.sum("_c").over(by) - upto + F.col("_c")).alias("_from"))
    inside, same = Window.partitionBy(*keys, "_part").orderBy(v, tie), Window.partitionBy(*keys, "_part").orderBy(v)
    out = dealt(out.withColumn("_part", part), *keys, "_part").withColumn("_at", F.row_number().over(inside))
    out = out.withColumns({"_first": F.rank().over(same), "_ties": F.count("*").over(same.rangeBetween(Window.currentRow, Window.currentRow))}).join(bases, [*keys, "_part"])
    # on the way down rows of greater v come before, those of equal v still in the order of the tie
    place = F.col("_from") - (F.col("_first") - 1) - F.col("_ties") + F.col("_at") - (F.col("_first") - 1)
    return out.withColumns({up: F.col("_below") + F.col("_at"), down: place}).drop("_part", "_below", "_from", "_at", "_first", "_ties")


def ecod(df: DataFrame, keys: list[str], values: list[str], tie: str, most: int = 50_000) -> DataFrame:
    """Adds score: the larger of the summed left, right and skew-chosen tail surprises over the columns, from ordinal ECDF ranks.

    Keys of more than `most` rows are ranked in ordered parts of about so many, so that no task sorts the rows of a key; rows that share key and value stay together."""
    rows = Rounds(df.sparkSession, "ecod").put(df)
    stats = rows.groupBy(*keys).agg((F.count("*") + 1).alias("_n"), *(F.skewness(v).alias(f"_s{i}") for i, v in enumerate(values)))
    parts = math.ceil((rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) / most)
    p = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    cuts = rows.agg(*(F.percentile_approx(v, p, F.lit(parts * 20)) for v in values)).first() if parts > 1 else [None] * len(values)
    left, right, auto = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    out = rows
    for i, v in enumerate(values):
        out = _tails(out, rows, keys, v, tie, sorted(set(cuts[i] or [])), f"_u{i}", f"_d{i}")
    out = out.join(stats, keys)
    for i in range(len(values)):
        up, down = -F.ln(F.col(f"_u{i}") / F.col("_n")), -F.ln(F.col(f"_d{i}") / F.col("_n"))
        left, right = left + up, right + down
        auto = auto + F.when(F.col(f"_s{i}") < 0, up).otherwise(down)
    return out.withColumn("score", F.greatest(left, right, auto)).drop("_n", *(f"_{p}{i}" for p in "uds" for i in range(len(values))))


def robust_threshold(df: DataFrame, keys: list[str], score: str, contamination: float, z: float) -> DataFrame:
    """keys, threshold = max(quantile, median + z * 1.4826 MAD); the quantile alone where the MAD vanishes."""
    base = df.groupBy(*keys).agg(F.median(score).alias("_m"), F.percentile(score, F.lit(1 - contamination)).alias("_q"))
    spread = df.join(base, keys).groupBy(*keys).agg(mad(F.col(score), F.col("_m")).alias("_d"), F.first("_m").alias("_m"), F.first("_q").alias("_q"))
    return spread.select(*keys, F.when(F.col("_d") <= 1e-8, F.col("_q")).otherwise(F.greatest(F.col("_q"), F.col("_m") + z * 1.4826 * F.col("_d"))).alias("threshold"))


def vote(*labels: Column, rule: str = "majority", weights: list[float] | None = None) -> Column:
    """0 or 1 from detectors' 0 or 1: majority, any, all or weighted."""
    weights = weights if rule == "weighted" and weights else [1.0] * len(labels)
    total = sum((w * x for w, x in zip(weights, labels, strict=True)), F.lit(0.0))
    limit = {"any": 0.0, "all": sum(weights) - 1e-9}.get(rule, sum(weights) / 2)
    return (total > limit).cast("int")


def combine(df: DataFrame, scores: list[str], weights: list[float], keys: list[str]) -> DataFrame:
    """Adds combined: weighted mean of the scores' z-values per key."""
    w = Window.partitionBy(*keys)
    parts = [wt * F.coalesce(divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)) for c, wt in zip(scores, weights, strict=True)]
    return df.withColumn("combined", sum(parts[1:], parts[0]) / sum(weights))


def probability(score: Column, threshold: Column) -> tuple[Column, Column]:
    """(probability, confidence) of a score about its threshold."""
    p = sigmoid(0.5 * (score - threshold))
    return p, 2 * F.abs(p - 0.5)


def roc_j(df: DataFrame, score: str, label: str, quantiles: list[float]) -> DataFrame:
    """q, threshold, tpr, fpr, j for thresholds at the score's quantiles, in two passes over the rows."""
    cuts = column_percentiles(df.select(F.col(score).alias("t")), ["t"], quantiles)
    at = cuts.select(F.posexplode("t").alias("k", "threshold"))
    joined = df.select(F.col(score).alias("_s"), F.col(label).cast("int").alias("_y")).join(F.broadcast(cuts)).select("_y", F.transform("t", lambda c: (F.col("_s") > c).cast("int")).alias("_p"))  # cuts: one row
    sums = joined.agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"), *(F.sum(F.col("_p")[i] * F.col("_y")).alias(f"tp{i}") for i in range(len(quantiles))), *(F.sum(F.col("_p")[i] * (1 - F.col("_y"))).alias(f"fp{i}") for i in range(len(quantiles))))
    long = sums.select("pos", "neg", F.posexplode(F.array(*(F.struct(F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.lit(q).alias("q")) for i, q in enumerate(quantiles)))).alias("k", "c"))
    tpr, fpr = divide(F.col("c.tp"), F.col("pos")), divide(F.col("c.fp"), F.col("neg"))
    return long.join(F.broadcast(at), "k").select("c.q", "threshold", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("j"))


def reciprocal_rank_fusion(df: DataFrame, keys: list[str], scores: list[str], tie: str) -> DataFrame:
    """Adds fused: the sum over scores of 1 / (60 + rank), rank 0 for the highest."""
    w = Window.partitionBy(*keys)
    parts = [1 / (59 + F.row_number().over(w.orderBy(F.desc(c), tie))) for c in scores]
    return df.withColumn("fused", sum(parts[1:], parts[0]))


def ema_states(df: DataFrame, keys: list[str], order: list[str], value: str, decay: float) -> DataFrame:
    """keys, n, ema: exponential mean of the values in order, started at the first."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_r"))
    return rows.select(*keys, F.size("_r").cast("long").alias("n"), F.aggregate(F.slice("_r", 2, F.greatest(F.lit(1), F.size("_r"))), F.col("_r")[0]["_v"], lambda a, r: decay * a + (1 - decay) * r["_v"]).alias("ema"))

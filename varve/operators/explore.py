"""Searches and tests across groups and series: unequal variances, copula tails, bin counts, segments, motifs, causality, phase, scoring schemes."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import bucket, divide, nan_to_null
from ..functions.tables import Rounds
from .mining import value_ranks
from .partition import prefix_sums

def welch_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: k, statistic, df1, df2 of Welch's test of equal means; the weights' sums are taken without the factor (1 - w / W)^2. Groups below two values or without variance are left out; NULL for one group."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).filter((F.col("n") >= 2) & (F.col("v") > 0))
    w = F.col("n") / F.col("v")
    s = g.agg(F.count("*").cast("double").alias("k"), F.sum(w).alias("w"), F.sum(w * F.col("m")).alias("wm"), F.sum(w * F.col("m") * F.col("m")).alias("wmm"), F.sum(w * w / F.col("n")).alias("r"))
    k = F.col("k")
    share = divide(F.col("r"), F.col("w") * F.col("w"))
    between = F.col("wmm") - divide(F.col("wm") * F.col("wm"), F.col("w"))
    enough = k >= 2
    return s.select(k.cast("long").alias("k"), F.when(enough, divide(between, (k - 1) * (1 + 2 * (k - 2) / (k * k - 1) * share))).alias("statistic"), F.when(enough, k - 1).alias("df1"), F.when(enough, divide(k * k - 1, 3 * share)).alias("df2"))


def copod(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds score: the largest of the summed left, right and skew-chosen tail surprises over the columns, from the whole table's empirical
    copula. Ranks come from counts per distinct value; a null adds nothing."""
    stats = df.agg(*(F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)), *(F.skewness(c).alias(f"_s{i}") for i, c in enumerate(columns)))
    out, left, right, chosen = df.join(F.broadcast(stats)), F.lit(0.0), F.lit(0.0), F.lit(0.0)  # stats: one row
    for i, c in enumerate(columns):
        r = value_ranks(df, c).select(c, (F.col("rank") + (F.col("_c") - 1) / 2).alias(f"_to{i}"), (F.col("rank") - (F.col("_c") + 1) / 2).alias(f"_below{i}"))
        out, n = out.join(r, c, "left"), F.col(f"_n{i}")
        a, b = (F.coalesce(-F.ln(x / n), F.lit(0.0)) for x in (F.col(f"_to{i}"), n - F.col(f"_below{i}")))
        left, right, chosen = left + a, right + b, chosen + F.when(F.col(f"_s{i}") < 0, a).otherwise(b)
    return out.select(*df.columns, F.greatest(left, right, chosen).alias("score"))


def shimazaki(df: DataFrame, c: str, least: int = 4, most: int = 128) -> DataFrame:
    """bins, cost and best of every number of equal-width bins: (2 mean - variance of the counts) / width squared, the least is best, then the fewest bins.

    Distinct values are counted first; each then meets every number of bins, and at most most^2 / 2 counts leave a task. No rows for a constant column."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_c"))
    ends = counts.agg(F.min(c).alias("_a"), F.max(c).alias("_b"))
    every = counts.join(F.broadcast(ends)).filter("_b > _a").withColumn("bins", F.explode(F.sequence(F.lit(least).cast("long"), F.lit(most).cast("long"))))  # ends: one row
    cells = every.withColumn("_bin", bucket(F.col(c), F.col("_a"), F.col("_b"), F.col("bins"))).groupBy("bins", "_bin", "_a", "_b").agg(F.sum("_c").alias("_c"))
    s = cells.groupBy("bins", "_a", "_b").agg(F.sum("_c").alias("t"), F.sum(F.col("_c") * F.col("_c")).alias("q"))
    k, mean = F.col("bins"), F.col("t") / F.col("bins")
    wide = (F.col("_b") - F.col("_a")) / k
    s = s.select("bins", ((2 * mean - (F.col("q") / k - mean * mean)) / (wide * wide)).alias("cost"))
    return s.withColumn("best", F.row_number().over(Window.orderBy("cost", "bins")) == 1)  # at most `most` rows


def _blocks(df: DataFrame, key: str, order: str, value: str, width: int, block: int) -> DataFrame:
    """k, b, x: each series' standardised values in blocks of `block` window starts; a block holds the width - 1 values behind it too. Constant series are left out."""
    w = Window.partitionBy("k")
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), nan_to_null(value).alias("v")).filter("v is not null")
    z = rows.select("k", ((F.col("v") - F.avg("v").over(w)) / F.stddev_pop("v").over(w)).alias("z"), (F.row_number().over(w.orderBy("o")) - 1).cast("long").alias("i"), F.stddev_pop("v").over(w).alias("s")).filter("s > 0")
    own = F.floor(F.col("i") / block).cast("long")
    places = F.array_distinct(F.array(own, F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - (width - 1)) / block).cast("long"))))
    dealt = z.select("k", "i", "z", F.explode(places).alias("b"))
    held = dealt.groupBy("k", "b").agg(F.sort_array(F.collect_list(F.struct("i", "z"))).alias("x"))  # at most block + width values
    return held.select("k", "b", F.transform("x", lambda p: p["z"]).alias("x")).filter(F.size("x") >= width)


def _meet(width: int, apart: int, block: int):
    """Of each window of block b the nearest window of block c that starts at least `apart` places away."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, b, c, x, y in zip(*(batch.column(n).to_pylist() for n in ("k", "b", "c", "x", "y")), strict=True):
                u, v = (np.lib.stride_tricks.sliding_window_view(np.array(a), width) for a in (x, y))
                i, j = b * block + np.arange(len(u)), c * block + np.arange(len(v))
                d = np.maximum((u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T, 0)
                d[np.abs(i[:, None] - j[None]) < apart] = np.inf
                at = d.argmin(1)
                best = np.sqrt(((u - v[at]) ** 2).sum(1))
                on = np.isfinite(d[np.arange(len(u)), at])
                rows += [(k, int(p), int(q), float(e)) for p, q, e in zip(i[on], j[at][on], best[on], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("k").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())], ["k", "i", "j", "d"])

    return run


def nearest_windows(df: DataFrame, key: str, order: str, value: str, width: int = 20, apart: int | None = None, block: int = 1024) -> DataFrame:
    """k (the key), i, j, d: each window of a standardised series, the nearest one that starts at least `apart` places away (default: a width, so that they don't overlap), and
    their distance; ties to the earliest. Blocks of windows first meet themselves and the next block, which bounds every window's distance; other blocks meet only where
    the windows' norms allow a smaller one. A task holds two blocks."""
    held = Rounds(df.sparkSession, "windows")
    apart = width if apart is None else apart
    blocks = held.put(_blocks(df, key, order, value, width, block))
    kind = dict(blocks.dtypes)["k"]
    norms = F.transform(F.sequence(F.lit(0), F.size("x") - width), lambda s: F.sqrt(F.aggregate(F.slice("x", s + 1, width), F.lit(0.0), lambda a, v: a + v * v)))
    sized = held.put(blocks.select("k", "b", F.array_min(norms).alias("low"), F.array_max(norms).alias("high")))
    a, b = blocks.select("k", "b", "x"), blocks.select("k", F.col("b").alias("c"), F.col("x").alias("y"))
    schema = f"k {kind}, i long, j long, d double"
    near = a.join(b, "k").filter(F.abs(F.col("c") - F.col("b")) <= 1)
    first = held.put(near.select("k", "b", "c", "x", "y").mapInArrow(_meet(width, apart, block), schema))
    windows = F.size("x") - width + 1
    bound = first.groupBy("k", "i").agg(F.min("d").alias("d")).groupBy("k", F.floor(F.col("i") / block).cast("long").alias("b")).agg(F.max("d").alias("most"), F.count("*").alias("n"))
    bound = blocks.select("k", "b", windows.alias("w")).join(bound, ["k", "b"], "left").select("k", "b", F.when(F.col("n") == F.col("w"), F.col("most")).otherwise(float("inf")).alias("most"))
    pair = sized.join(bound, ["k", "b"]).join(sized.select("k", F.col("b").alias("c"), F.col("low").alias("lo"), F.col("high").alias("hi")), "k")
    gap = F.greatest(F.col("low") - F.col("hi"), F.col("lo") - F.col("high"), F.lit(0.0))
    wanted = pair.filter((F.abs(F.col("c") - F.col("b")) > 1) & (gap <= F.col("most") + 1e-9)).select("k", "b", "c")
    second = wanted.join(a, ["k", "b"]).join(b, ["k", "c"]).select("k", "b", "c", "x", "y").mapInArrow(_meet(width, apart, block), schema)
    return first.unionByName(second).groupBy("k", "i").agg(F.min(F.struct("d", "j")).alias("m")).select("k", "i", "m.j", "m.d")


def motifs(df: DataFrame, key: str, order: str, value: str, width: int = 20, top: int = 3) -> DataFrame:
    """key, rank, at, match, distance: the closest pairs of windows of each series that don't overlap, nearest first; a pair that overlaps a window of one chosen before is
    passed over. Ties go to the earlier start. Nulls are left out; series below two widths and constant ones give none."""
    held = Rounds(df.sparkSession, "motifs")
    left = held.put(nearest_windows(df, key, order, value, width))
    out = None
    for rank in range(1, top + 1):
        best = held.put(left.groupBy("k").agg(F.min(F.struct(F.round("d", 9).alias("r"), "i", "j", "d")).alias("m")).select("k", F.col("m.i").alias("at"), F.col("m.j").alias("match"), F.col("m.d").alias("distance")))
        row = best.select(F.col("k").alias(key), F.lit(rank).cast("long").alias("rank"), "at", "match", "distance")
        out = row if out is None else out.unionByName(row)
        far = lambda x, y: F.abs(F.col(x) - F.col(y)) >= width
        left = left.join(best, "k").filter(far("i", "at") & far("i", "match") & far("j", "at") & far("j", "match")).select("k", "i", "j", "d")
    return out


def dispersion_entropy(x: np.ndarray, order: int = 3, classes: int = 6) -> float:
    """Entropy of patterns of normal-distribution classes, over its maximum; 0 for constant series and for fewer than two patterns."""
    if len(x) - order + 1 < 2 or x.std() < 1e-12:
        return 0.0
    z = (x - x.mean()) / (x.std() + 1e-12) / math.sqrt(2)
    level = np.clip([int((1 + math.erf(v)) / 2 * classes) for v in z], 0, classes - 1)
    codes = np.lib.stride_tricks.sliding_window_view(level, order) @ (classes ** np.arange(order))
    p = np.unique(codes, return_counts=True)[1] / len(codes)
    return float(-(p * np.log(p)).sum() / (order * math.log(classes)))


def coarse(x: np.ndarray, scale: int) -> np.ndarray:
    """Means of runs of `scale` values; a shorter last run is left out."""
    n = len(x) // scale
    return x[: n * scale].reshape(n, scale).mean(axis=1)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom, by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x > (a + 1) / (a + b + 2):
        return 1.0 - f_tail(1 / f, d2, d1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    up, down, total = 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        down = 1 / ((1 + term * down) or 1e-300)
        up = (1 + term / up) or 1e-300
        total *= up * down
        if k and abs(up * down - 1) < 1e-14:
            break
    return min(1.0, max(0.0, front * (total - 1)))


def causes(x: np.ndarray, y: np.ndarray, most: int = 12) -> tuple[int, float]:
    """(lag, p) with the least p of whether lags of x help to predict y beyond its own, for lags 1 to min(most, n // 10); (0, 1) below 50 values."""
    best, n = (0, 1.0), len(x)
    for k in range(1, min(most, n // 10) + 1 if n >= 50 else 1):
        own = np.column_stack([np.ones(n - k), *(y[k - i : n - i] for i in range(1, k + 1))])
        both = np.column_stack([own, *(x[k - i : n - i] for i in range(1, k + 1))])
        r, u = (float(((y[k:] - d @ np.linalg.lstsq(d, y[k:], rcond=None)[0]) ** 2).sum()) for d in (own, both))
        free = n - k - 2 * k - 1
        if u > 0 and free > 0:
            p = f_tail((r - u) / u / k * free, k, free)
            best = (k, p) if p < best[1] else best
    return best


def granger(df: DataFrame, key: str, order: str, x: str, y: str, most: int = 12, level: float = 0.05) -> DataFrame:
    """key, n, forward_lag, forward_p (x helps to predict y), backward_lag, backward_p, both_ways. Rows without both values are left out."""
    schema = f"{key} {dict(df.dtypes)[key]}, n long, forward_lag long, forward_p double, backward_lag long, backward_p double, both_ways boolean"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        a, b = frame[x].to_numpy(float), frame[y].to_numpy(float)
        there, back = causes(a, b, most), causes(b, a, most)
        return pd.DataFrame([(frame[key].iloc[0], len(a), *there, *back, max(there[1], back[1]) < level)], columns=[c.split()[0] for c in schema.split(", ")])

    return df.na.drop(subset=[x, y]).select(key, order, x, y).groupBy(key).applyInPandas(run, schema)


def phase(df: DataFrame, key: str, order: str, value: str, reach: int = 30, strong: float = 0.6) -> DataFrame:
    """a, b, lag, strength, aligned of each pair of series: the largest mean product of standardised values with a's place `lag` after b's, lags up to
    `reach`, of equal strengths the least lag. Divided by a's length. Series meet on their places, so work grows with values x lags x series."""
    w = Window.partitionBy(key)
    z = df.filter(F.col(value).isNotNull()).select(F.col(key).alias("a"), (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("i"), ((F.col(value) - F.avg(value).over(w)) / (F.stddev_samp(value).over(w) + 1e-8)).alias("va"), F.count("*").over(w).alias("n"))
    moved = z.select(F.col("a").alias("b"), F.col("i").alias("_j"), F.col("va").alias("vb"), F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))).alias("lag")).withColumn("i", F.col("_j") + F.col("lag"))
    r = z.join(moved, "i").filter("a < b").groupBy("a", "b", "lag").agg((F.sum(F.col("va") * F.col("vb")) / F.first("n")).alias("strength"))
    best = r.groupBy("a", "b").agg(F.max(F.struct("strength", (-F.col("lag")).alias("back"))).alias("m"))
    return best.select("a", "b", (-F.col("m.back")).alias("lag"), F.col("m.strength").alias("strength"), (F.abs("m.strength") > strong).alias("aligned"))


def last_trend(df: DataFrame, key: str, order: str, value: str, last: int = 20) -> DataFrame:
    """key, direction (-1, 0, 1): the sign of the slope of the last values of each series that has as many."""
    w = Window.partitionBy(key)
    r = df.filter(F.col(value).isNotNull()).select(key, value, F.row_number().over(w.orderBy(F.desc(order))).alias("_r")).filter(F.col("_r") <= last)
    return r.groupBy(key).agg(F.signum(-F.regr_slope(value, F.col("_r").cast("double"))).cast("long").alias("direction"), F.count("*").alias("_n")).filter(F.col("_n") == last).drop("_n")


def scheme_scores(df: DataFrame, key: str, schemes: DataFrame) -> DataFrame:
    """scheme, key, score: each candidate's weighted sum under each scheme. schemes: scheme, metric (a column of df), weight; null scores count as 0."""
    metrics = sorted(r.metric for r in schemes.select("metric").distinct().collect())  # columns of df
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("x")) for m in metrics)))
    long = df.select(F.col(key), cells.alias("m")).select(key, "m.*").join(schemes.select("scheme", "metric", F.col("weight").cast("double").alias("weight")), "metric")
    return long.groupBy("scheme", key).agg(F.sum(F.col("x") * F.col("weight")).alias("score"))


def scheme_agreement(df: DataFrame, key: str, schemes: DataFrame, top: int = 10, base: str = "baseline") -> DataFrame:
    """scheme, spearman, overlap: how the candidates' order by each scheme's scores agrees with the base scheme's, and the share of its best `top` that it shares.

    Equal scores rank by key. Ranks are places within ordered parts of a scheme's scores plus the parts before, so no task sorts all candidates; those of one
    score share a part."""
    scored = Rounds(df.sparkSession, "schemes").put(scheme_scores(df, key, schemes).withColumn("score", -F.col("score")))
    counts = prefix_sums(scored.groupBy("scheme", "score").agg(F.count("*").alias("n")), "scheme", "score", ["n"]).select("scheme", "score", F.col("n").alias("upto"))
    same = Window.partitionBy("scheme", "score")
    ranks = scored.withColumn("_i", F.count("*").over(same) - F.row_number().over(same.orderBy(key))).join(counts, ["scheme", "score"]).select(key, "scheme", (F.col("upto") - F.col("_i")).cast("double").alias("r"))
    both = ranks.join(ranks.filter(F.col("scheme") == base).select(key, F.col("r").alias("q")), key)
    return both.groupBy("scheme").agg(F.coalesce(F.corr("r", "q"), F.lit(0.0)).alias("spearman"), (F.sum(((F.col("r") <= top) & (F.col("q") <= top)).cast("long")) / max(top, 1)).alias("overlap"))

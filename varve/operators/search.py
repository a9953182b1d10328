"""Search by tree-structured Parzen estimates: densities of good and bad trials as tables, candidates scored by their ratio."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.quantiles import column_percentiles


def _cell(name: str, low: float, high: float, cells: int) -> Column:
    """Cell of a value; null where it is null or NaN."""
    x = F.col(name).cast("double")
    held = F.greatest(F.lit(0.0), F.least((x - low) * cells / (high - low), F.lit(float(cells - 1))))
    return F.when(x.isNotNull() & ~F.isnan(x), F.floor(held))


def split_trials(trials: DataFrame, loss: str, share: float = 0.15) -> DataFrame:
    """trials with a loss, and good: the loss is not above its `share` quantile (linear); ties at it are good."""
    d = trials.filter(F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double")))
    limit = column_percentiles(d, [loss], [share]).select(F.col(loss)[0].alias("_limit"))  # one row
    return d.join(F.broadcast(limit)).withColumn("good", F.col(loss) <= F.col("_limit")).drop("_limit")


def numeric_ratios(split: DataFrame, bounds: Mapping[str, tuple[float, float]], cells: int = 128, prior: float = 1.0) -> DataFrame:
    """param, ratios: ln(density of good / density of bad trials) in each of the `cells` equal cells of the parameter's range.

    A trial adds a normal kernel, cut to the range and scaled to weight 1, around its cell; its width in cells is 1.06 sd n^(-1/5) of its side, at least 1. `prior` trials are
    spread evenly. Trials are counted by cell first, so kernels meet cells x cells, however many trials there are."""
    long = split.select("good", F.explode(F.array(*(F.struct(F.lit(c).alias("param"), _cell(c, *b, cells).alias("o")) for c, b in bounds.items()))).alias("x")).select("good", "x.*")
    counts = long.filter("o is not null").groupBy("param", "good", "o").agg(F.count("*").alias("k"))
    o, k, n = F.col("o"), F.col("k"), F.col("n")
    mean = F.sum(o * k) / F.sum("k")
    side = counts.groupBy("param", "good").agg(F.sum("k").alias("n"), F.sqrt(F.greatest(F.lit(0.0), F.sum(o * o * k) / F.sum("k") - mean * mean)).alias("sd"))
    side = side.select("param", "good", "n", F.greatest(F.lit(1.0), 1.06 * F.col("sd") * F.pow(n, F.lit(-0.2))).alias("h"))
    met = counts.join(side, ["param", "good"]).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    u = (F.col("c") - o) / F.col("h")
    met = met.withColumn("w", F.exp(-0.5 * u * u))
    met = met.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("param", "good", "o")))
    density = met.groupBy("param", "good", "c").agg(((F.sum(k * F.col("w")) + prior / cells) / (F.first("n") + prior)).alias("p"))
    at = lambda g: F.coalesce(F.ln(F.max(F.when(F.col("good") == g, F.col("p")))), F.ln(F.lit(1.0 / cells)))
    ratio = density.groupBy("param", "c").agg((at(True) - at(False)).alias("r"))
    return ratio.groupBy("param").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "r"))), lambda s: s["r"]).alias("ratios"))  # `cells` values each


def choice_ratios(split: DataFrame, name: str, prior: float = 1.0) -> DataFrame:
    """value, ratio: the same for a parameter of choices, whose `prior` trials are spread over the values seen; a row with value null tells the ratio of one never seen."""
    d = split.filter(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("value"), "good")
    counts = d.groupBy("value").agg(F.count(F.when(F.col("good"), 1)).alias("a"), F.count(F.when(~F.col("good"), 1)).alias("b"))
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("b"), F.lit(0)).alias("nb"), F.greatest(F.count("*"), F.lit(1)).alias("v"))  # one row
    every = counts.unionByName(total.select(F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).join(F.broadcast(total))
    p = lambda c, n: (F.col(c) + prior / F.col("v")) / (F.col(n) + prior)
    return every.select("value", (F.ln(p("a", "na")) - F.ln(p("b", "nb"))).alias("ratio"))


def score_candidates(trials: DataFrame, candidates: DataFrame, loss: str, bounds: Mapping[str, tuple[float, float]], choices: Sequence[str] = (), share: float = 0.15, cells: int = 128, prior: float = 1.0) -> DataFrame:
    """candidates and score: the summed log ratio of their parameters' densities among good and bad trials; higher is more promising.

    bounds: range of each numeric parameter (values beyond count as its end); choices: the other parameters. A parameter that is null in a candidate adds nothing, one that is null
    in a trial leaves the trial out of that parameter's densities; so does NaN. A column score of the candidates is replaced. Without trials all scores are 0. Candidates aren't shuffled for numeric parameters: their ratios are one row."""
    split = split_trials(trials, loss, share)
    out = candidates.withColumn("score", F.lit(0.0))
    if bounds:
        table = numeric_ratios(split, bounds, cells, prior)
        row = table.agg(*(F.first(F.when(F.col("param") == c, F.col("ratios")), ignorenulls=True).alias(f"_r{i}") for i, c in enumerate(bounds)))
        out = out.join(F.broadcast(row))  # one row of cells x parameters numbers
        found = (F.get(F.col(f"_r{i}"), _cell(c, *b, cells).cast("int")) for i, (c, b) in enumerate(bounds.items()))
        out = out.withColumn("score", sum((F.coalesce(x, F.lit(0.0)) for x in found), F.col("score"))).drop(*(f"_r{i}" for i in range(len(bounds))))
    for c in choices:
        ratios = choice_ratios(split, c, prior)
        unseen = ratios.filter("value is null").select(F.col("ratio").alias("_unseen"))  # one row
        seen = ratios.filter("value is not null").select(F.col("value").alias("_value"), F.col("ratio").alias("_ratio"))
        out = out.join(F.broadcast(unseen)).join(seen, F.col(c).cast("string") == F.col("_value"), "left")
        out = out.withColumn("score", F.col("score") + F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce("_ratio", "_unseen"))).drop("_unseen", "_value", "_ratio")
    return out


def suggest(trials: DataFrame, candidates: DataFrame, loss: str, bounds: Mapping[str, tuple[float, float]], choices: Sequence[str] = (), k: int = 1, tie: str | None = None, **options) -> DataFrame:
    """The k candidates of highest score; ties by the column `tie`."""
    scored = score_candidates(trials, candidates, loss, bounds, choices, **options)
    return scored.orderBy(F.desc("score"), *([tie] if tie else [])).limit(k)

"""Recursive partitioning over prefix sums: cuts by description length, changes of a series' mean, weighted quantiles.

Sums up to each value are taken once, within ordered parts in parallel and over the parts from their totals. Any open interval's sums are then
differences of two of them, so one grouped maximum a level finds the best cut of all open intervals of all columns or series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import nan_to_null
from ..functions.quantiles import PARTS
from ..functions.tables import Rounds

#: Classes of a label at most: each is a column of sums.
CLASSES = 64


def prefix_sums(rows: DataFrame, key: str, value: str, sums: Sequence[str]) -> DataFrame:
    """rows (one per key and value) with each of the sums replaced by its sum up to the value, and _next, the key's next value (null at its end)."""
    p = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    cuts = rows.groupBy(key).agg(F.array_distinct(F.percentile_approx(value, p, F.lit(PARTS * 20))).alias("_cuts"))
    parted = rows.join(cuts, key).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    over = Window.partitionBy(key).orderBy("_part")
    totals = parted.groupBy(key, "_part").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums), F.min(value).alias("_first"))  # at most PARTS rows a key
    base = totals.select(key, "_part", F.lead("_first").over(over).alias("_after"), *((F.sum(f"_t_{s}").over(over) - F.col(f"_t_{s}")).alias(f"_b_{s}") for s in sums))
    inside = Window.partitionBy(key, "_part").orderBy(value)
    run = parted.select("*", F.lead(value).over(inside).alias("_in"), *(F.sum(s).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"_s_{s}") for s in sums))
    return run.join(base, [key, "_part"]).select(*(c for c in rows.columns if c not in sums), *((F.col(f"_s_{s}") + F.col(f"_b_{s}")).alias(s) for s in sums), F.coalesce("_in", "_after").alias("_next"))


def class_sums(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, value, c (array: rows of each class of the label, in order, up to the value), _next. Rows without value or label are left out."""
    labels = sorted((r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().limit(CLASSES + 1).collect()), key=str)
    if len(labels) > CLASSES:
        raise ValueError(f"{label} has more than {CLASSES} classes")
    if not labels:
        return df.sparkSession.createDataFrame([], "feature string, value double, c array<double>, _next double")
    sums = [f"c{i}" for i in range(len(labels))]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), nan_to_null(c).alias("value")) for c in columns)))
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_y"), cells.alias("m")).filter("m.value is not null")
    counted = long.groupBy("m.feature", "m.value").agg(*(F.sum((F.col("_y") == y).cast("long")).alias(s) for s, y in zip(sums, labels, strict=True)))
    return prefix_sums(counted, "feature", "value", sums).select("feature", "value", F.array(*(F.col(s).cast("double") for s in sums)).alias("c"), "_next")


def _plus(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))


def _terms(c: str, n: str, s: str) -> dict[str, Column]:
    """The entropy and the number of classes of counts c (an array with the sum n)."""
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    return {f"_h{s}": F.log2(n) - _plus(F.col(c), plogp) / F.col(n), f"_k{s}": _plus(F.col(c), lambda x: (x > 0).cast("double"))}


def _intervals(bounds: DataFrame) -> DataFrame:
    """bounds (lo, hi: class counts up to both ends) with what their own counts say, so that it is worked out once an interval."""
    t = bounds.withColumn("_t", _less("hi", "lo")).withColumn("_nt", _plus(F.col("_t"), lambda x: x))
    return t.withColumns(_terms("_t", "_nt", "t")).drop("_t")


def _gains(rows: DataFrame) -> DataFrame:
    """rows (c, and an interval's columns) with gain, the fall of entropy by a cut behind the value, and least, what the description length asks for; of cuts with rows on both
    sides. Arrays and lambdas rather than a column a class: the generated code stays small enough to be compiled to machine code."""
    sides = rows.withColumn("_l", _less("c", "lo")).withColumn("_nl", _plus(F.col("_l"), lambda x: x)).withColumn("_nr", F.col("_nt") - F.col("_nl")).filter("_nl > 0 and _nr > 0")
    told = sides.withColumn("_r", _less("hi", "c")).withColumns(_terms("_l", "_nl", "l") | _terms("_r", "_nr", "r"))
    n, ht, hl, hr, kt, kl, kr = (F.col(f"_{c}") for c in ("nt", "ht", "hl", "hr", "kt", "kl", "kr"))
    gain = ht - F.col("_nl") / n * hl - F.col("_nr") / n * hr
    least = (F.log2(F.greatest(n - 1, F.lit(1.0))) + F.log2(F.pow(F.lit(3.0), kt) - 2) - (kt * ht - kl * hl - kr * hr)) / n
    return told.select(*rows.columns, gain.alias("gain"), least.alias("least"))


def _less(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def best_cut(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the cut of x that gains most class entropy of y, its gain and whether the description length allows it; no row where x has fewer than two values."""
    rows = class_sums(df, [x], y)
    whole = _intervals(rows.filter("_next is null").select(F.transform("c", lambda x: x * 0).alias("lo"), F.col("c").alias("hi")))  # one row
    cut = _gains(rows.filter("_next is not null").join(F.broadcast(whole))).select(((F.col("value") + F.col("_next")) / 2).alias("cut"), "gain", (F.col("gain") > F.col("least")).alias("accepted"))
    return cut.orderBy(F.desc(F.round("gain", 9)), "cut").limit(1)


def mdlp_cuts(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """feature, cut: each interval is cut where the label's entropy falls most (ties: lowest cut), as long as the fall exceeds what describing the cut costs.

    The number of jobs is the depth of the deepest cut. Columns without a worthwhile cut give no row; an empty table gives none."""
    held = Rounds(df.sparkSession, "mdlp")
    rows = held.put(class_sums(df, columns, label).withColumn("seg", F.lit(0.0)))  # an interval's number: the rows before it
    bounds = rows.filter("_next is null").select("feature", "seg", F.transform("c", lambda x: x * 0).alias("lo"), F.col("c").alias("hi"))
    found: list[DataFrame] = []
    while True:
        cut = (F.col("value") + F.col("_next")) / 2
        worth = _gains(rows.join(_intervals(bounds), ["feature", "seg"])).filter("gain > least").select("feature", "seg", cut.alias("cut"), "gain", "c", "lo", "hi")
        best = worth.groupBy("feature", "seg").agg(F.max_by(F.struct("cut", "c", "lo", "hi"), F.struct(F.round("gain", 9), -F.col("cut"))).alias("s")).select("feature", "seg", "s.*")
        best = held.put(best)
        found.append(best.select("feature", "cut"))
        if best.isEmpty():
            return reduce(DataFrame.unionByName, found)
        after = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
        bounds = best.select("feature", "seg", "lo", F.col("c").alias("hi")).unionByName(best.select("feature", after.alias("seg"), F.col("c").alias("lo"), "hi"))
        on = best.select("feature", "seg", "cut", after.alias("_after"))
        last = rows
        rows = held.put(rows.join(on, ["feature", "seg"]).select("feature", "value", "_next", "c", F.when(F.col("value") > F.col("cut"), F.col("_after")).otherwise(F.col("seg")).alias("seg")))
        held.drop(last)


def mdlp_bins(df: DataFrame, columns: Sequence[str], label: str, max_bins: int = 50) -> DataFrame:
    """Adds <column>_bin: the number of the column's cuts below the value, null for none. Of more than max_bins - 1 cuts every so many-th stays."""
    from .mining import _part

    cuts: dict[str, list[float]] = {c: [] for c in columns}
    for r in mdlp_cuts(df, columns, label).groupBy("feature").agg(F.sort_array(F.collect_list("cut")).alias("cuts")).collect():  # one row a column
        step = max(1, -(-len(r.cuts) // (max_bins - 1))) if len(r.cuts) + 1 > max_bins else 1
        cuts[r.feature] = list(r.cuts)[::step][: max_bins - 1]
    return df.withColumns({f"{c}_bin": F.when(nan_to_null(c).isNotNull(), (_part(c, cuts[c]) if cuts[c] else F.lit(0)).cast("long")) for c in columns})


def change_points(df: DataFrame, key: str, order: str, value: str, least: int = 20, penalty: float = 4.0) -> DataFrame:
    """key, at, before, after, magnitude: places where a series' mean changes, and the means of the pieces on both sides.

    A piece is split where its squared error falls most (ties: earliest), both sides holding `least` values, while the fall exceeds penalty * ln(n) times the
    noise: half the mean square of the series' steps. Nulls are left out. All pieces of all series are split in one job a level."""
    spark = df.sparkSession
    held = Rounds(spark, "changes")
    w = Window.partitionBy("k")
    x = F.col("x") - F.avg("x").over(w)
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), nan_to_null(value).alias("x")).filter("x is not null").withColumn("x", x)
    step = F.col("x") - F.lag("x").over(w.orderBy("o"))
    run = w.orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("k", "o", "x", F.row_number().over(w.orderBy("o")).cast("long").alias("i"), step.alias("step"))
    means = df.groupBy(F.col(key).alias("k")).agg(F.avg(nan_to_null(value)).alias("mean"))
    rows = rows.select("k", "i", F.sum("x").over(run).alias("s"), F.sum(F.col("x") * F.col("x")).over(run).alias("q"), (F.avg(F.col("step") * F.col("step")).over(w) / 2).alias("noise"), F.lit(0).cast("long").alias("a"))
    rows = held.put(rows)
    zero = F.lit(0.0)
    bounds = rows.groupBy("k", "a").agg(F.max("i").alias("b"), F.max_by("s", "i").alias("sb"), F.max_by("q", "i").alias("qb"), F.first("noise").alias("noise"), F.max("i").alias("n")).select("*", zero.alias("sa"), zero.alias("qa"))
    pieces: list[DataFrame] = []
    while True:
        both = rows.drop("noise").join(bounds, ["k", "a"])
        error = lambda s, q, n: q - s * s / n
        s, q, i, a, b = (F.col(c) for c in ("s", "q", "i", "a", "b"))
        gain = error(F.col("sb") - F.col("sa"), F.col("qb") - F.col("qa"), b - a) - error(s - F.col("sa"), q - F.col("qa"), i - a) - error(F.col("sb") - s, F.col("qb") - q, b - i)
        fit = both.filter((i - a >= least) & (b - i >= least)).select("k", "a", "i", "s", "q", gain.alias("gain"), "noise", "n")
        fit = fit.filter((F.col("gain") > penalty * F.log("n") * F.col("noise")) & (F.col("gain") > 1e-9))
        best = held.put(fit.groupBy("k", "a").agg(F.max_by(F.struct("i", "s", "q"), F.struct(F.round("gain", 7), -F.col("i"))).alias("t")).select("k", "a", "t.*"))
        whole = bounds.join(best.select("k", "a"), ["k", "a"], "left_anti")
        pieces.append(whole.select("k", "a", "b", ((F.col("sb") - F.col("sa")) / (F.col("b") - F.col("a"))).alias("m")))
        if best.isEmpty():
            break
        split = best.join(bounds, ["k", "a"])
        lows = split.select("k", "a", F.col("i").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb"), "noise", "n", "sa", "qa")
        highs = split.select("k", F.col("i").alias("a"), "b", "sb", "qb", "noise", "n", F.col("s").alias("sa"), F.col("q").alias("qa"))
        rows = held.put(rows.join(best.select("k", "a", F.col("i").alias("_at")), ["k", "a"]).select("k", "i", "s", "q", "noise", F.when(F.col("i") > F.col("_at"), F.col("_at")).otherwise(F.col("a")).alias("a")))
        bounds = held.put(lows.unionByName(highs))
    every = reduce(DataFrame.unionByName, pieces)
    joined = every.filter("a > 0").join(every.select("k", F.col("b").alias("a"), F.col("m").alias("before")), ["k", "a"]).join(means, "k")
    return joined.select(F.col("k").alias(key), F.col("a").alias("at"), (F.col("before") + F.col("mean")).alias("before"), (F.col("m") + F.col("mean")).alias("after"), F.abs(F.col("m") - F.col("before")).alias("magnitude"))


def weighted_quantiles(df: DataFrame, columns: Sequence[str], weight: str | Column, q: Sequence[float]) -> DataFrame:
    """feature, q (array): per column the smallest value up to which at least that share of the weight lies. Rows whose weight isn't positive, and missing values, are left out."""
    w = nan_to_null(weight) if isinstance(weight, str) else weight
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), nan_to_null(c).alias("value")) for c in columns)))
    long = df.select(w.alias("w"), cells.alias("m")).filter("m.value is not null and w > 0")
    rows = prefix_sums(long.groupBy("m.feature", "m.value").agg(F.sum("w").alias("w")), "feature", "value", ["w"])
    total = rows.groupBy("feature").agg(F.max("w").alias("total"))
    reach = lambda x: F.min(F.when(F.col("w") >= F.lit(x) * F.col("total") * (1 - 1e-12), F.col("value")))
    return rows.join(total, "feature").groupBy("feature").agg(F.array(*map(reach, q)).alias("q"))


def weighted_bins(df: DataFrame, columns: Sequence[str], weight: str, bins: int) -> DataFrame:
    """Adds <column>_bin: bins of about equal weight, such as the hessians of a boosting round; values on an edge go down, nulls have none."""
    from .mining import _part

    edges = {r.feature: sorted(set(r.q)) for r in weighted_quantiles(df, columns, weight, [i / bins for i in range(1, bins)]).collect()}  # one row a column
    return df.withColumns({f"{c}_bin": F.when(nan_to_null(c).isNotNull(), (_part(c, edges[c]) if edges.get(c) else F.lit(0)).cast("long")) for c in columns})

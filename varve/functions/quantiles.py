"""Exact quantiles without one task that holds all values: counts per distinct value, prefix sums over ordered parts, and the rows at the wanted places.

percentile() keeps every distinct value of a group in one hash map. Here distinct values are counted with partial aggregation, cut into
about PARTS ordered parts by a sketch (any cuts give the same result), summed within each part in parallel, and over the parts from their totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 64


def long_percentiles(long: DataFrame, q: Sequence[float], key: str = "feature", value: str = "value") -> DataFrame:
    """key, q (array of linear quantiles, as NumPy's default) of the values that aren't null. Keys are few: one row each is broadcast."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    p = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    cuts = counts.groupBy(key).agg(F.array_distinct(F.percentile_approx(value, p, F.lit(PARTS * 20))).alias("_cuts"))
    counts = counts.join(F.broadcast(cuts), key).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    inside = Window.partitionBy(key, "_part").orderBy(value)
    totals = counts.groupBy(key, "_part").agg(F.sum("_c").alias("_t"))  # at most PARTS rows a key
    every = Window.partitionBy(key)
    totals = totals.select(key, "_part", (F.sum("_t").over(every.orderBy("_part")) - F.col("_t")).alias("_base"), F.sum("_t").over(every).alias("_n"))
    placed = counts.withColumn("_to", F.sum("_c").over(inside)).join(F.broadcast(totals), [key, "_part"]).select(key, value, "_n", (F.col("_base") + F.col("_to")).alias("_to"), (F.col("_base") + F.col("_to") - F.col("_c")).alias("_from"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_from") <= place) & (place < F.col("_to")), F.col(value)))

    def linear(x: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(x)
        low = at(F.floor(place))
        return low + (at(F.ceil(place)) - low) * F.max(place - F.floor(place))

    return placed.groupBy(key).agg(F.array(*map(linear, q)).alias("q"))


def average_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with _r0, _r1 ...: each column's ranks within the keys, ties averaged, nulls last, and _n: the rows of the keys. As average_rank, but for keys of few
    distinct values and many rows: distinct values are ranked in ordered parts, so that no task sorts the rows of a key."""
    same = lambda a, b, by: reduce(and_, (F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in by))
    p = F.array(*(F.lit(i / PARTS) for i in range(1, PARTS)))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = df.alias("a").join(F.broadcast(sizes).alias("b"), same("a", "b", keys)).select("a.*", "b._n")  # one row a key
    for i, c in enumerate(columns):
        counts = df.groupBy(*keys, c).agg(F.count("*").alias("_c"))
        cuts = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(c, p, F.lit(PARTS * 20))).alias("_cuts"))
        part = F.when(F.col(f"a.{c}").isNull(), PARTS).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col(f"a.{c}"))))  # noqa: B023
        parts = counts.alias("a").join(F.broadcast(cuts).alias("b"), same("a", "b", keys)).select("a.*", part.alias("_part"))
        by = Window.partitionBy(*keys).orderBy("_part")
        bases = parts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t")).withColumn("_base", F.sum("_t").over(by) - F.col("_t"))  # at most PARTS + 1 rows a key
        inside = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(c))
        placed = parts.withColumn("_to", inside).alias("a").join(F.broadcast(bases).alias("b"), same("a", "b", [*keys, "_part"]))
        ranks = placed.select(*(F.col(f"a.{k}") for k in [*keys, c]), (F.col("b._base") + F.col("_to") - F.col("_c") + (F.col("_c") + 1) / 2).alias(f"_r{i}"))
        out = out.alias("a").join(ranks.alias("b"), same("a", "b", [*keys, c])).select("a.*", f"b._r{i}")
    return out


def melted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))).alias("m")).select("m.feature", "m.value")


def column_percentiles(df: DataFrame, columns: Sequence[str], q: Sequence[float]) -> DataFrame:
    """One row: per column an array of its linear quantiles, under the column's name; null for a column without values."""
    found = long_percentiles(melted(df, columns), q)
    return found.agg(*(F.first(F.when(F.col("feature") == c, F.col("q")), ignorenulls=True).alias(c) for c in columns))

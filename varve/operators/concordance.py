"""Kendall's tau-b of a whole table by counting dominated pairs over a grid of ordered parts.

Distinct pairs of values with their counts are cut into strips by x and by y, of about STRIP pairs each. A pair of rows in different strips of both is counted
from the grid's totals; one in the same strip within that strip, by levels of a merge, in a task of its own. No task holds more than a strip.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import divide, nan_to_null
from ..functions.tables import Rounds
from .mining import _part

STRIP = 1 << 16


def dominated(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> int:
    """Sum of c_i c_j over pairs with a_j < a_i and b_j < b_i, by levels of a bottom-up merge."""
    order = np.lexsort((-b, a))  # of equal a the larger b first, so that they don't count
    b, c = np.unique(b, return_inverse=True)[1][order], c[order].astype(float)
    total, width, place = 0.0, 1, np.arange(len(b))
    while width < len(b):
        block, right = place // (2 * width), place // width % 2 == 1
        o = np.lexsort((~right, b, block))  # of equal b the right side first
        left = np.where(right[o], 0.0, c[o])
        seen = np.cumsum(left)
        first = np.searchsorted(block[o], block[o])
        total += float((np.where(right[o], c[o], 0.0) * (seen - np.where(first > 0, seen[first - 1], 0.0))).sum())
        width *= 2
    return round(total)


def _cuts(df: DataFrame, c: str, parts: int) -> list[float]:
    if parts < 2:
        return []
    p = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    return sorted(set(df.agg(F.percentile_approx(c, p, F.lit(parts * 20)).alias("q")).first().q or []))


def _within(rows: DataFrame, strip: str, a: Column, b: Column) -> DataFrame:
    """n: the dominated pairs of each strip, with a and b as coordinates."""

    def run(frame):
        import pandas as pd

        return pd.DataFrame({"n": [dominated(frame["a"].to_numpy(), frame["b"].to_numpy(), frame["c"].to_numpy())]})

    return rows.select(F.col(strip).alias("strip"), a.cast("double").alias("a"), b.cast("double").alias("b"), "c").groupBy("strip").applyInPandas(run, "n long")


def _pairs(rows: DataFrame) -> DataFrame:
    """One row, n: pairs of rows of which one has the greater x and the greater y."""
    grid = rows.groupBy("px", "py").agg(F.sum("c").alias("c"))
    ends = grid.select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("c").alias("d"))
    columns = ends.groupBy("qx", "qy").agg(F.sum("d").alias("d"))
    below = columns.withColumn("upto", F.sum("d").over(Window.partitionBy("qx").orderBy("qy").rowsBetween(Window.unboundedPreceding, Window.currentRow)))  # strips of one strip
    every = rows.select("px").distinct().crossJoin(F.broadcast(rows.select("py").distinct()))  # strips by strips, of which there are rows / STRIP each
    filled = every.join(below, (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy")), "left").select("px", "py", F.coalesce("d", F.lit(0)).alias("d"))
    by_y = Window.partitionBy("px").orderBy("py").rowsBetween(Window.unboundedPreceding, -1)
    by_x = Window.partitionBy("py").orderBy("px").rowsBetween(Window.unboundedPreceding, -1)
    corner = filled.withColumn("s", F.coalesce(F.sum("d").over(by_y), F.lit(0))).withColumn("under", F.coalesce(F.sum("s").over(by_x), F.lit(0)))
    far = corner.agg(F.sum(F.col("d").cast("decimal(19,0)") * F.col("under").cast("decimal(19,0)")).alias("n"))
    near = _within(rows, "px", F.col("x"), F.col("y")).unionByName(_within(rows, "py", F.col("px"), F.col("y")))
    return far.select(F.coalesce("n", F.lit(0)).cast("double").alias("n")).unionByName(near.select(F.col("n").cast("double").alias("n"))).agg(F.sum("n").alias("n"))


def whole_kendall(df: DataFrame, x: str, y: str, strip: int = STRIP) -> DataFrame:
    """One row: n, concordant, discordant (pairs) and tau, tau-b, of the rows where both are present; tau is null where one of them is constant. Counts are exact below 2^53."""
    held = Rounds(df.sparkSession, "kendall")
    d = df.select(nan_to_null(x).alias("x"), nan_to_null(y).alias("y")).filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("c"))
    d = held.put(d)
    parts = max(1, -(-d.count() // strip))
    cx, cy = _cuts(d, "x", parts), _cuts(d, "y", parts)
    rows = held.put(d.withColumn("px", _part("x", cx) if cx else F.lit(0)).withColumn("py", _part("y", cy) if cy else F.lit(0)))
    turned = rows.select("x", (-F.col("y")).alias("y"), "c", "px", (-F.col("py")).alias("py"))
    pairs = lambda c: (F.sum(F.col(c) * (F.col(c) - 1)) / 2).alias("t")
    ties = {s: rows.groupBy(s).agg(F.sum("c").alias("k")).agg(pairs("k")).select(F.coalesce("t", F.lit(0.0)).alias(f"t{s}")) for s in ("x", "y")}
    n = rows.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    row = n.crossJoin(_pairs(rows).select(F.col("n").alias("up"))).crossJoin(_pairs(turned).select(F.col("n").alias("down"))).crossJoin(ties["x"]).crossJoin(ties["y"])  # one row each
    every = F.col("n") * (F.col("n") - 1) / 2
    tau = divide(F.col("up") - F.col("down"), F.sqrt((every - F.col("tx")) * (every - F.col("ty"))))
    return row.select("n", F.col("up").cast("long").alias("concordant"), F.col("down").cast("long").alias("discordant"), tau.alias("tau"))

"""Gradient boosting on histograms, level by level: one grouped sum of gradients and hessians a level finds all its splits.

Columns become bins once, by exact quantiles. A row's place in the growing tree is an expression over its bins, so no level rewrites the table; after
each tree the predictions are written with the rows, which cuts the lineage. What reaches the driver is one row a node.

GOSS: rows with a large gradient all count, of the others a pseudorandom share counts with a weight. Bundles: sparse columns that are never
both away from their usual bin (by a table of conflicts) share one column of the histogram; with no conflicts the sums, and so the trees, stay the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.expr import nan_to_null
from ..functions.quantiles import column_percentiles
from ..functions.tables import Rounds
from .mining import _part

#: Bins that one bundle holds at most.
BUNDLE_BINS = 512


@dataclass
class Booster:
    """edges: per column the ascending upper ends of its bins but the last. trees: node -> (column, bin, gain) of splits; node -> value of leaves. The
    root is 1, the children of n are 2 n (bin at most the split's, nulls too) and 2 n + 1."""

    columns: list[str]
    edges: list[list[float]]
    loss: str
    base: float
    splits: list[dict[int, tuple[int, int, float]]] = field(default_factory=list)
    leaves: list[dict[int, float]] = field(default_factory=list)

    def bins(self) -> list[Column]:
        """0 for null, else 1 + the number of edges below the value."""
        return [F.coalesce(_binned(c, e) + 1, F.lit(0)) for c, e in zip(self.columns, self.edges, strict=True)]

    def tree(self, i: int, bins: Sequence[Column]) -> Column:
        def at(n: int) -> Column:
            if n not in self.splits[i]:
                return F.lit(self.leaves[i][n])
            column, b, _ = self.splits[i][n]
            return F.when(bins[column] <= b, at(2 * n)).otherwise(at(2 * n + 1))

        return at(1)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds out: the target's estimate, a probability with the logistic loss. Rows without values take the lowest bin."""
        held = df.withColumn("_bins", F.array(*self.bins()))
        bins = [F.col("_bins")[i] for i in range(len(self.columns))]
        score = sum((self.tree(i, bins) for i in range(len(self.splits))), F.lit(self.base))
        return held.withColumn(out, 1 / (1 + F.exp(-score)) if self.loss == "logistic" else score).drop("_bins")

    def importance(self) -> dict[str, float]:
        """Each column's share of the gain of all splits."""
        gain = dict.fromkeys(self.columns, 0.0)
        for tree in self.splits:
            for column, _, g in tree.values():
                gain[self.columns[column]] += g
        total = sum(gain.values())
        return {c: g / total if total else 0.0 for c, g in gain.items()}


def _binned(c: str, edges: list[float]) -> Column:
    value = nan_to_null(c)
    return F.when(value.isNotNull(), _part(c, edges)) if edges else F.when(value.isNotNull(), F.lit(0))


def bin_edges(df: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Per column its distinct inner quantiles."""
    row = column_percentiles(df.select(*(nan_to_null(c).alias(c) for c in columns)), columns, [i / bins for i in range(1, bins)]).first()
    return [sorted({float(x) for x in (row[c] or []) if x is not None}) for c in columns]


def as_bins(df: DataFrame, edges: dict[str, list[float]], keep: Sequence[str]) -> DataFrame:
    """Each column's bin under its name, 0 for null, else 1 + the number of edges below the value, and the columns to keep; rows stay where they are."""
    cuts = {c: np.array(e) for c, e in edges.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[: len(cuts)]]
            told = [np.where(np.isnan(v), 0, np.searchsorted(e, v) + 1) for v, e in zip(x, cuts.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in told), *batch.columns[len(cuts) :]], names=[*cuts, *keep])

    kept = df.select(*(nan_to_null(c).alias(f"_b{i}") for i, c in enumerate(cuts)), *keep)
    return kept.mapInArrow(run, StructType([*(StructField(c, IntegerType()) for c in cuts), *(kept.schema[len(cuts) + i] for i in range(len(keep)))]))


def _gradients(loss: str) -> tuple[Column, Column]:
    if loss == "squared":
        return F.col("f") - F.col("y"), F.lit(1.0)
    if loss == "logistic":
        p = 1 / (1 + F.exp(-F.col("f")))
        return p - F.col("y"), p * (1 - p)
    raise ValueError(f"no loss {loss!r}: squared or logistic")


def bundles(rows: DataFrame, sizes: list[int], sparse: float = 0.5) -> list[list[tuple[int, int]]]:
    """Groups of (column, usual bin): columns of which at least the share `sparse` of rows is in one bin, and never two of a group away from it.

    rows: b, the array of bins. Counts of columns and of pairs of columns reach the driver, not of rows."""
    width = len(sizes)
    counts = rows.select(F.posexplode("b").alias("c", "v")).groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"), F.max("n").alias("n"), F.sum("n").alias("t")).collect()
    usual = {r.c: r.v for r in counts if r.n >= sparse * r.t}
    apart = {r.c: r.t - r.n for r in counts}
    if len(usual) < 2:
        return []
    away = F.array_compact(F.array(*(F.when(F.col("b")[c] != v, F.lit(c)) for c, v in sorted(usual.items()))))
    pairs = rows.select(away.alias("a")).filter(F.size("a") > 1).select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y")).filter("x < y").distinct().collect()
    conflict = {(r.x, r.y) for r in pairs}
    out: list[list[tuple[int, int]]] = []
    for c in sorted(usual, key=lambda c: (-apart[c], c)):
        for group in out:
            if all((min(c, d), max(c, d)) not in conflict for d, _ in group) and sizes[c] + sum(sizes[d] for d, _ in group) <= BUNDLE_BINS:
                group.append((c, usual[c]))
                break
        else:
            out.append([(c, usual[c])])
    return [g for g in out if len(g) > 1] if width else []


def _counted(rows: DataFrame, node: Column, sizes: list[int]) -> DataFrame:
    """The histogram of columns alone: a partition sums its batches' rows by node, column and bin, and sends one row a cell."""
    width, most = len(sizes), max(sizes, default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            at, g, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
            cell = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width) + most * np.arange(width)
            for n in np.unique(at):
                own = at == n
                flat, out = cell[own].ravel(), total.setdefault(int(n), np.zeros((3, width * most)))
                for k, v in enumerate((g[own], h[own])):
                    out[k] += np.bincount(flat, np.repeat(v, width), width * most)
                out[2] += np.bincount(flat, minlength=width * most)
        for n, (g, h, c) in total.items():
            on = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), n), pa.int32()), pa.array(on // most, pa.int32()), pa.array(on % most, pa.int32()), pa.array(g[on]), pa.array(h[on])], names=["node", "column", "bin", "g", "h"])

    long = rows.select(node.alias("node"), F.col("g").cast("double").alias("g"), F.col("h").cast("double").alias("h"), "b").filter("node is not null")
    return long.mapInArrow(run, "node int, column int, bin int, g double, h double").groupBy("node", "column", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def _histogram(rows: DataFrame, node: Column, groups: list[list[tuple[int, int]]], sizes: list[int]) -> DataFrame:
    """node, column, bin, g, h: sums of the gradients and hessians of rows in open nodes."""
    if not groups:
        return _counted(rows, node, sizes)
    spark, width = rows.sparkSession, len(sizes)
    bundled = {c for group in groups for c, _ in group}
    alone = [c for c in range(width) if c not in bundled]
    cells, names = [F.struct(F.lit(c).alias("k"), F.col("b")[c].alias("v")) for c in alone], []
    for i, group in enumerate(groups):
        at, value = 1, F.lit(0)
        for c, usual in group:
            value = F.when(F.col("b")[c] != usual, F.col("b")[c] + at).otherwise(value)
            names += [(width + i, at + v, c, v) for v in range(sizes[c]) if v != usual]
            at += sizes[c]
        cells.append(F.struct(F.lit(width + i).alias("k"), value.alias("v")))
    long = rows.select(node.alias("node"), "g", "h", F.explode(F.array(*cells)).alias("e")).filter("node is not null")
    sums = long.groupBy("node", F.col("e.k").alias("k"), F.col("e.v").alias("v")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    plain = sums.filter(F.col("k") < width).select("node", F.col("k").alias("column"), F.col("v").alias("bin"), "g", "h")
    away = sums.join(F.broadcast(spark.createDataFrame(names, "k int, v int, column int, bin int")), ["k", "v"]).select("node", "column", "bin", "g", "h")  # one row a bin of a bundled column
    totals = sums.groupBy("node", "k").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    member = spark.createDataFrame([(width + i, c, u) for i, group in enumerate(groups) for c, u in group], "k int, column int, bin int")
    every = totals.join(F.broadcast(member), "k").select("node", "column", "bin", "g", "h")  # one row a bundled column
    usual = every.unionByName(away.groupBy("node", "column").agg((-F.sum("g")).alias("g"), (-F.sum("h")).alias("h")).withColumn("bin", F.lit(None).cast("int")).select("node", "column", "bin", "g", "h"))
    return plain.unionByName(away).unionByName(usual.groupBy("node", "column").agg(F.max("bin").alias("bin"), F.sum("g").alias("g"), F.sum("h").alias("h")))


def _best(hist: DataFrame, penalty: float, least: float, least_gain: float) -> DataFrame:
    """One row a node: its sums gt, ht and its best split (gain, column, bin, gl, hl), null where none is allowed. Windows hold one column's bins."""
    w = Window.partitionBy("node", "column")
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = hist.select("node", "column", "bin", F.sum("g").over(run).alias("gl"), F.sum("h").over(run).alias("hl"), F.sum("g").over(w).alias("gt"), F.sum("h").over(w).alias("ht"), F.max("bin").over(w).alias("last"))
    part = lambda g, h: F.try_divide(g * g, h + penalty)
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - part(F.col("gt"), F.col("ht"))
    split = F.struct(F.round(gain, 7).alias("gain"), (-F.col("column")).alias("column"), (-F.col("bin")).alias("bin"), "gl", "hl")
    allowed = (F.col("bin") < F.col("last")) & (F.col("hl") >= least) & (F.col("ht") - F.col("hl") >= least) & (gain > least_gain)
    return s.groupBy("node").agg(F.max_by("gt", -F.col("column")).alias("gt"), F.max_by("ht", -F.col("column")).alias("ht"), F.max(F.when(allowed, split)).alias("split"))


def fit(
    df: DataFrame, columns: list[str], target: str, loss: str = "squared", rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, penalty: float = 1.0,
    least: float = 1.0, least_gain: float = 1e-6, goss: tuple[float, float] | None = None, bundled: bool = False, seed: int = 1, edges: dict[str, list[float]] | None = None, binned: bool = False,
) -> Booster:
    """A Booster. penalty: added to hessians; least: hessian that both sides of a split hold; goss: shares of rows with large gradients and of the others drawn
    at random; edges: the columns' bins, where they are known; binned: the columns hold their bins (as_bins). Rows without a target are left out; splits of equal gain (7 digits) go to the first column, then the lowest bin; no rows give no trees."""
    spark = df.sparkSession
    held = Rounds(spark, "boost")
    y = nan_to_null(target)
    model = Booster(list(columns), [edges[c] for c in columns] if edges else bin_edges(df.filter(y.isNotNull()), columns, bins), loss, 0.0)
    rows = held.put(df.filter(y.isNotNull()).select(F.monotonically_increasing_id().alias("id"), y.alias("y"), F.array(*([F.col(c).cast("int") for c in columns] if binned else model.bins())).alias("b")))  # written: the ids must not change
    mean = rows.agg(F.avg("y")).first()[0]
    if mean is None:
        return model
    if loss == "logistic":
        mean = min(1 - 1e-9, max(1e-9, mean))
        mean = math.log(mean / (1 - mean))
    model.base = float(mean)
    rows = rows.withColumn("f", F.lit(model.base))
    sizes = [len(e) + 2 for e in model.edges]
    groups = bundles(rows, sizes) if bundled else []
    gradient, hessian = _gradients(loss)
    bin_of = [F.col("b")[i] for i in range(len(columns))]
    for i in range(rounds):
        now = rows.select("id", "b", gradient.alias("g"), hessian.alias("h"))
        if goss:
            top, other = goss
            cut = now.agg(F.percentile_approx(F.abs("g"), F.lit(1 - top), F.lit(10_000))).first()[0]  # to 1 / 10,000 of the rows: any cut is right, the weights make up for it
            drawn = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 20)) < int(other / (1 - top) * (1 << 20))
            weight = F.when(F.abs("g") >= cut, 1.0).when(drawn, (1 - top) / other)
            now = now.withColumn("_w", weight).filter("_w is not null").select("id", "b", (F.col("g") * F.col("_w")).alias("g"), (F.col("h") * F.col("_w")).alias("h"))
        splits: dict[int, tuple[int, int, float]] = {}
        sums: dict[int, tuple[float, float]] = {}
        nodes = {1}
        for _ in range(depth):

            def place(n: int) -> Column:
                if n in splits:
                    column, b, _ = splits[n]
                    return F.when(bin_of[column] <= b, place(2 * n)).otherwise(place(2 * n + 1))
                return F.lit(n if n in nodes else None).cast("int")  # noqa: B023

            found = _best(_histogram(now, place(1), groups, sizes), penalty, least, least_gain).collect()  # one row a node
            nodes = set()
            for r in found:
                sums[r.node] = (r.gt, r.ht)
                if r.split is not None:
                    n, s = r.node, r.split
                    splits[n] = (-s.column, -s.bin, s.gain)
                    sums[2 * n], sums[2 * n + 1] = (s.gl, s.hl), (r.gt - s.gl, r.ht - s.hl)
                    nodes |= {2 * n, 2 * n + 1}
            if not nodes:
                break
        if not splits:
            break
        model.splits.append(splits)
        model.leaves.append({n: -rate * g / (h + penalty) for n, (g, h) in sums.items() if n not in splits})
        last = rows
        rows = held.put(rows.select("id", "y", "b", (F.col("f") + model.tree(i, bin_of)).alias("f")))
        if hasattr(last, "_varve_round"):
            held.drop(last)
    return model

"""Exact nearest neighbours by pivots, and what rests on them: local outlier factors and imputation.

Every point goes to the cell of its nearest pivot. Of each cell two facts are known: its radius and the k smallest distances to its pivot. They bound
each cell's k-th neighbour distance, and so, by the triangle inequality, which points of which cells can matter to it; only those meet. Cells are dealt as
tiles of bounded blocks, so one dense cell is many tasks, and each tile gives k rows a query point. Equal points are one query, and of equal candidates
only those of the smallest ids can be among the nearest, so copies don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import nan_to_null
from ..functions.quantiles import column_percentiles
from ..functions.tables import Rounds

#: Pivots, a sample of the points by hash: the root of the number of points, between these. They and their distances to one another are known to every task.
PIVOTS, MOST_PIVOTS = 64, 1024
#: Points of a tile's two sides on average.
BLOCK = 2048
POINT = "id long, v array<double>"


def _points(df: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    values = [nan_to_null(c) for c in columns]
    there = F.lit(True)
    for v in values:
        there = there & v.isNotNull()
    return df.filter(there & F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.array(*values).alias("v"))


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.asarray(part.column(1).flatten().to_numpy(), float).reshape(-1, pivots.shape[1])
                d = np.sqrt(sum((x[:, c][:, None] - pivots[:, c][None]) ** 2 for c in range(x.shape[1])))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "cell", "d"])

    return run


def _tile(k: int):
    def run(key, table):
        side = table.column("side").to_numpy()
        ids = table.column("id").to_numpy()
        x = np.array(table.column("v").to_pylist(), float).reshape(len(ids), -1)
        q, s = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        s = s[np.argsort(ids[s], kind="stable")]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 256):
            mine = q[at : at + 256]
            d = np.zeros((len(mine), len(s)))
            for c in range(x.shape[1]):  # by differences, column by column: exact for whole numbers
                d += (x[mine, c][:, None] - x[s, c][None]) ** 2
            order = np.argsort(d, axis=1, kind="stable")[:, :k]  # ties by id
            best = np.take_along_axis(d, order, 1)
            on = np.isfinite(best)
            out.append((np.repeat(ids[mine], on.sum(1)), ids[s][order[on]], best[on]))
        a, b, d2 = (np.concatenate(c) if out else np.zeros(0) for c in (list(zip(*out, strict=True)) if out else [(), (), ()]))
        return pa.table({"id": pa.array(a, pa.int64()), "near": pa.array(b, pa.int64()), "d2": pa.array(d2, pa.float64())})

    return run


def knn_join(left: DataFrame, right: DataFrame, k: int, same: bool = False, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """id, near, distance, rank (from 1): each left point's k nearest right points by Euclidean distance, ties to the smaller id; fewer where right has fewer.

    left, right: id long (unique), v array<double> of one length without nulls. same: a point isn't its own neighbour. No rows on either side give none."""
    spark = left.sparkSession
    held = Rounds(spark, "knn")
    most = k + same  # a place's nearest, of which one may be the query itself
    there = held.put(right.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_r") <= most).drop("_r"))
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, int(there.count() ** 0.5)))
    sample = [r.v for r in there.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    if not sample:
        return spark.createDataFrame([], "id long, near long, distance double, rank int")
    at = np.unique(np.array(sample, float), axis=0)
    schema = f"{POINT}, cell int, d double"
    s = held.put(there.mapInArrow(_cells(at), schema))
    places = held.put(left.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    q = held.put(places.mapInArrow(_cells(at), schema))
    n = len(at)
    between = np.sqrt(sum((at[:, c][:, None] - at[:, c][None]) ** 2 for c in range(at.shape[1])))
    radius, count, far = np.zeros(n), np.zeros(n, int), np.full(n, -np.inf)
    for r in q.groupBy("cell").agg(F.max("d").alias("u"), F.count("*").alias("c")).collect():  # one row a pivot
        radius[r.cell], count[r.cell] = r.u, r.c
    for r in s.groupBy("cell").agg(F.max("d").alias("u")).collect():  # one row a pivot
        far[r.cell] = r.u
    nearest = s.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).filter(F.col("_r") <= most)
    close: list[tuple[int, float]] = [(r.cell, r.d) for r in nearest.select("cell", "d").collect()]  # k + 1 distances a pivot at most
    cell_of, dist = np.array([c for c, _ in close], int), np.array([d for _, d in close])
    bound = np.full(n, np.inf)  # of the k-th neighbour of any query in the cell
    for i in np.flatnonzero(count):
        reach = radius[i] + between[i, cell_of] + dist
        if len(reach) >= most:
            bound[i] = np.partition(reach, most - 1)[most - 1]
    slack = 1e-9 * (1 + np.abs(between).max())
    least = np.where(np.isfinite(bound)[:, None], between - (radius + bound)[:, None] - slack, -1.0)  # a point of cell j matters to cell i only at such a distance from its pivot, or more
    wanted = [(i, j, float(least[i, j])) for i, j in np.argwhere((count > 0)[:, None] & (least <= far[None])).tolist()]
    meets = spark.createDataFrame(wanted, "into int, cell int, least double")  # the cells that meet, PIVOTS^2 at most
    sent = held.put(s.join(F.broadcast(meets), "cell").filter(F.col("d") >= F.col("least")).select(F.col("into").alias("cell"), "id", "v"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / block)).cast("int")
    sizes = q.groupBy("cell").agg(blocks(F.count("*")).alias("qs")).join(sent.groupBy("cell").agg(blocks(F.count("*")).alias("ss")), "cell")
    sizes = F.broadcast(sizes)  # one row a pivot
    mine = q.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "qs").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ss") - 1)).alias("j"), F.lit(0).alias("side"), "id", "v")
    theirs = sent.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "ss").cast("int").alias("j"), F.lit(1).alias("side"), "id", "v")
    found = mine.unionByName(theirs).groupBy("cell", "i", "j").applyInArrow(_tile(most), "id long, near long, d2 double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d2", "near"))).filter(F.col("rank") <= most)
    lists = held.put(ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d2", "near"))).alias("near")))  # k + 1 a place at most
    mine = left.join(places.select("v", F.col("id").alias("place")), "v").select("id", "place").join(lists.withColumnRenamed("id", "place"), "place")
    others = F.slice(F.filter("near", lambda x: x["near"] != F.col("id")) if same else F.col("near"), 1, k)
    return mine.select("id", F.posexplode(others).alias("at", "x")).select("id", "x.near", F.sqrt("x.d2").alias("distance"), (F.col("at") + 1).alias("rank"))


def nearest_rows(df: DataFrame, ident: str, columns: Sequence[str], k: int) -> DataFrame:
    """id, near, distance, rank of each row's k nearest other rows; rows with a null, NaN or infinity in a column take no part."""
    points = _points(df, ident, columns)
    return knn_join(points, points, k, True)


def local_outlier_factor(df: DataFrame, ident: str, columns: Sequence[str], k: int = 20) -> DataFrame:
    """id, lof: the mean density of a row's k nearest rows over its own; around 1 within a cluster. Densities are reciprocals of mean reach distances, the larger of
    the distance and the neighbour's k-distance. A table of up to k rows takes all others; a single row gives none."""
    held = Rounds(df.sparkSession, "lof")
    near = held.put(nearest_rows(df, ident, columns, k))
    reach = near.groupBy("id").agg(F.max("distance").alias("reach"))
    density = held.put(near.join(reach.select(F.col("id").alias("near"), "reach"), "near").groupBy("id").agg((1 / (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("density")))
    theirs = near.join(density.select(F.col("id").alias("near"), "density"), "near").groupBy("id").agg(F.avg("density").alias("around"))
    return theirs.join(density, "id").select("id", (F.col("around") / F.col("density")).alias("lof"))


def lof_outliers(df: DataFrame, ident: str, columns: Sequence[str], k: int = 20, share: float = 0.1) -> DataFrame:
    """id, lof, outlier: factors above the 1 - share quantile of all factors."""
    scored = Rounds(df.sparkSession, "lof-share").put(local_outlier_factor(df, ident, columns, k))
    cut = column_percentiles(scored, ["lof"], [1 - share]).select(F.col("lof")[0].alias("_cut"))  # one row
    return scored.join(F.broadcast(cut)).select("id", "lof", (F.col("lof") > F.col("_cut")).alias("outlier"))


def impute_nearest(df: DataFrame, ident: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """df with each missing value (null, NaN, infinity) of the columns as the mean of its k nearest rows that have it.

    Distances are over the columns that both rows have, times columns / columns that both have; rows that share none are no neighbours. A value
    without neighbours becomes its column's mean, or stays null in a column without values. Rows are met by the pattern of what they lack: for each pair of
    patterns one neighbour join over the shared columns. ident: unique, a long."""
    spark = df.sparkSession
    held = Rounds(spark, "impute")
    cols = list(columns)
    bit = sum(((F.when(nan_to_null(c).isNull(), 1).otherwise(0)) * (1 << i) for i, c in enumerate(cols)), F.lit(0))
    rows = held.put(df.select(F.col(ident).cast("long").alias("id"), *(nan_to_null(c).alias(f"x{i}") for i, c in enumerate(cols)), bit.cast("long").alias("lacks")))
    patterns = sorted(r.lacks for r in rows.select("lacks").distinct().collect())  # at most 2^columns
    found = None
    for p in (p for p in patterns if p):
        for d in patterns:
            shared = [i for i in range(len(cols)) if not (p | d) >> i & 1]
            given = [i for i in range(len(cols)) if p >> i & 1 and not d >> i & 1]
            if not shared or not given:
                continue
            point = lambda m: rows.filter(F.col("lacks") == m).select("id", F.array(*(F.col(f"x{i}") for i in shared)).alias("v"))  # noqa: B023, E731
            near = knn_join(point(p), point(d), k, p == d).select("id", "near", (F.col("distance") * np.sqrt(len(cols) / len(shared))).alias("distance"), F.explode(F.array(*map(F.lit, given))).alias("c"))
            found = near if found is None else found.unionByName(near)
    means = rows.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))))  # one row
    filled = rows.crossJoin(F.broadcast(means))
    if found is not None:
        best = held.put(found).withColumn("_r", F.row_number().over(Window.partitionBy("id", "c").orderBy("distance", "near"))).filter(F.col("_r") <= k)
        given = rows.select(F.col("id").alias("near"), F.array(*(F.col(f"x{i}") for i in range(len(cols)))).alias("v"))
        drawn = best.join(given, "near").groupBy("id").agg(*(F.avg(F.when(F.col("c") == i, F.col("v")[i])).alias(f"k{i}") for i in range(len(cols))))
        filled = filled.join(drawn, "id", "left")
    else:
        filled = filled.select("*", *(F.lit(None).cast("double").alias(f"k{i}") for i in range(len(cols))))
    out = filled.select(F.col("id").alias("_id"), *(F.coalesce(f"x{i}", f"k{i}", f"m{i}").alias(f"_x{i}") for i in range(len(cols))))
    return df.join(out, F.col(ident) == F.col("_id"), "left").drop("_id").withColumns({c: F.col(f"_x{i}") for i, c in enumerate(cols)}).drop(*(f"_x{i}" for i in range(len(cols))))


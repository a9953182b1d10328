"""Feature and candidate selection: greedy choices over small pair tables, clusters and components from pyspark.ml."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import nan_to_null
from ..functions.quantiles import column_percentiles
from ..functions.tables import Rounds
from .mining import value_ranks


def redundancy_pruned(pairs: DataFrame, order: list[str], threshold: float = 0.98) -> list[str]:
    """Columns in order of preference, less those that correlate with a kept one; pairs has one row per pair of columns."""
    close = {(r.feature_a, r.feature_b) for r in pairs.filter(F.abs("value") >= threshold).collect()}
    kept: list[str] = []
    for c in order:
        if not any((c, k) in close or (k, c) in close for k in kept):
            kept.append(c)
    return kept


def information_matrix(df: DataFrame, columns: list[str], bins: int = 16) -> DataFrame:
    """feature_a, feature_b, mi in nats of every pair of columns, cut at their quantiles, over the rows where both are present; one job counts the cells of all pairs.

    A value equal to a cut lies below it; equal cuts are one, so a column of few values has fewer bins. A pair without common rows gives no row."""
    names = list(combinations(columns, 2))
    df = df.select(*(nan_to_null(c).alias(c) for c in columns))
    cuts = column_percentiles(df, columns, [i / bins for i in range(1, bins)]).select(*(F.array_distinct(c).alias(f"_q{i}") for i, c in enumerate(columns)))  # one row

    def place(i: int, c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.size(F.filter(f"_q{i}", lambda q: q < F.col(c)))).alias(f"_b{i}")

    binned = df.select(*columns).join(F.broadcast(cuts)).select(*(place(i, c) for i, c in enumerate(columns)))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_b{columns.index(a)}").alias("a"), F.col(f"_b{columns.index(b)}").alias("b")) for i, (a, b) in enumerate(names)))
    cells = binned.select(F.explode(pairs).alias("p")).select("p.*").na.drop().groupBy("i", "a", "b").agg(F.count("*").cast("double").alias("c"))
    w = lambda *by: F.sum("c").over(Window.partitionBy("i", *by))  # noqa: E731  # bins squared rows a pair
    mi = cells.withColumn("n", w()).withColumn("na", w("a")).withColumn("nb", w("b")).groupBy("i").agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    told = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in names))
    return mi.select(F.get(told, F.col("i")).alias("t"), "mi").select(F.col("t.a").alias("feature_a"), F.col("t.b").alias("feature_b"), F.greatest(F.lit(0.0), "mi").alias("mi"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """As mining.pearson, from one matrix of sums of products a partition instead of several aggregates a pair: feature_a, feature_b, value of every pair, over the rows where both are present."""
    rows, d = df.select(*(nan_to_null(c).alias(f"c{i}") for i, c in enumerate(columns))), len(columns)
    told = rows.agg(*(F.avg(f"c{i}") for i in range(d)), *(F.stddev_pop(f"c{i}") for i in range(d))).first()
    shift, wide = np.array([v or 0.0 for v in told[:d]]), np.array([v or 1.0 for v in told[d:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for batch in batches:
            x = (np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift) / wide
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            total += np.array([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    flat = np.zeros(4 * d * d)
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # 4 rows a pair of columns
        flat[r.i] = r.v
    n, s, q, xy = flat.reshape(4, d, d)  # s and q: of the row's column where the other is present
    n = np.maximum(n, 1)
    var = q / n - (s / n) ** 2
    var = np.where(var > 1e-13 * np.maximum(1e-12, q / n), var, 0.0)  # what rounding leaves of a constant is none
    base = np.sqrt(var) * np.sqrt(var.T)
    value = np.where(base > 0, (xy / n - s * s.T / n**2) / np.where(base > 0, base, 1.0), 0.0)
    return df.sparkSession.createDataFrame([(a, b, float(value[i, j])) for (i, a), (j, b) in combinations(enumerate(columns), 2)], "feature_a string, feature_b string, value double")


def dependence(df: DataFrame, columns: list[str], relation: str = "correlation", bins: int = 16) -> DataFrame:
    """feature_a, feature_b, value of every pair: the correlation, or mutual information of quantile bins over the smaller of both entropies, 0 where that is 0."""
    if relation == "correlation":
        return correlations(df, columns)
    twin = {c: f"_{i}" for i, c in enumerate(columns)}  # information of a column and itself is its entropy
    both = df.select(*columns, *(F.col(c).alias(t) for c, t in twin.items()))
    mi = information_matrix(both, [*columns, *twin.values()], bins)
    own = mi.filter(F.create_map(*(F.lit(x) for p in twin.items() for x in p))[F.col("feature_a")] == F.col("feature_b")).select("feature_a", "mi")  # one row a column
    pairs = mi.filter(F.col("feature_a").isin(columns) & F.col("feature_b").isin(columns))
    out = pairs.join(own.withColumnRenamed("mi", "_a"), "feature_a").join(own.select(F.col("feature_a").alias("feature_b"), F.col("mi").alias("_b")), "feature_b")
    return out.select("feature_a", "feature_b", F.coalesce(F.try_divide("mi", F.least("_a", "_b")), F.lit(0.0)).alias("value"))


def relevance(df: DataFrame, columns: list[str], target: str, bins: int = 16, folds: int | Column = 0, least: float = 0.01) -> DataFrame:
    """feature, mi in nats of each column's quantile bins and the target, over the rows where both are present: all columns in one job, whose cells stay few.

    A numeric target is cut at its quantiles too; of another type, its values are the classes. A value equal to a cut lies below it. With folds (a number: rows dealt by
    their hash; or a column of 0 to 63 that deals them): also mean and low of mi over the samples that leave one fold out, and stable, the share of those with mi >= least.
    Columns without rows have mi 0."""
    numeric = dict(df.dtypes)[target] not in ("string", "boolean", "date", "timestamp")
    cut = [*columns, target] if numeric else list(columns)
    df = df.withColumns({c: nan_to_null(c) for c in cut})
    row = column_percentiles(df, cut, [i / bins for i in range(1, bins)]).first()
    edges = [np.array(sorted(set(row[c] or []))) for c in cut]
    if isinstance(folds, Column):
        fold = folds.cast("int")
    else:
        fold = F.pmod(F.xxhash64(*columns, target), F.lit(folds)).cast("int") if folds else F.lit(0)
    d = len(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by column, bin, class and fold of a partition."""
        total: Counter = Counter()
        for batch in batches:
            *x, b, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if numeric:
                names, code = [str(v) for v in range(len(edges[d]) + 1)], np.where(np.isnan(b.astype(float)), -1, np.searchsorted(edges[d], b))
            else:
                code, names = pd.factorize(b)
            folds_of, code = np.unique(k.astype(float), return_inverse=True), code.astype(int)
            for i, v in enumerate(x):
                v = v.astype(float)
                ok = ~np.isnan(v) & (code >= 0) & ~np.isnan(folds_of[0])[folds_of[1]]
                width, many = len(edges[i]) + 1, max(1, len(names))
                cell = (np.searchsorted(edges[i], v[ok]) * many + code[ok]) * len(folds_of[0]) + folds_of[1][ok]
                c = np.bincount(cell, minlength=width * many * len(folds_of[0]))
                for at in np.flatnonzero(c):
                    f = at % len(folds_of[0])
                    total[i, int(at // len(folds_of[0]) // many), names[at // len(folds_of[0]) % many], int(folds_of[0][f])] += int(c[at])
        if total:
            i, a, b, k = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.string()), pa.array(k, pa.int32()), pa.array(total.values(), pa.int64())], names=["i", "a", "b", "k", "c"])

    rows = df.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)), (F.col(target) if numeric else F.col(target).cast("string")).alias("_y"), fold.alias("_k"))
    cells = rows.mapInArrow(count, "i int, a int, b string, k int, c long").groupBy("i", "a", "b", "k").agg(F.sum("c").alias("c"))
    if not isinstance(folds, int) or folds:
        # a sample leaves fold k out; -1 leaves none
        ks = cells.select("k").distinct()
        whole = cells.groupBy("i", "a", "b").agg(F.sum("c").alias("t"), F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))  # one entry a fold
        every = ks.agg(F.array_sort(F.collect_list("k")).alias("ks"))  # one row
        sample = F.array_union(F.array(F.lit(-1)), F.col("ks"))
        cells = whole.join(F.broadcast(every)).select("i", "a", "b", "t", "m", F.explode(sample).alias("k")).select("i", "a", "b", "k", (F.col("t") - F.coalesce(F.try_element_at("m", F.col("k")), F.lit(0))).alias("c")).filter("c > 0")
    else:
        cells = cells.withColumn("k", F.lit(-1))

    def part(by: list[str], sign: int) -> DataFrame:
        g = cells.groupBy("i", "k", *by).agg(F.sum("c").cast("double").alias("c"))
        return g.select("i", "k", (sign * F.col("c") * F.ln("c")).alias("t"), (F.col("c") if not by else F.lit(0.0)).alias("n"))

    sums = part(["a", "b"], 1).unionByName(part(["a"], -1)).unionByName(part(["b"], -1)).unionByName(part([], 1))
    mi = sums.groupBy("i", "k").agg(F.greatest(F.lit(0.0), F.sum("t") / F.sum("n")).alias("mi"))
    left = F.col("k") >= 0
    out = mi.groupBy("i").agg(F.max(F.when(~left, F.col("mi"))).alias("mi"), F.avg(F.when(left, F.col("mi"))).alias("mean"), F.min(F.when(left, F.col("mi"))).alias("low"), F.avg(F.when(left, (F.col("mi") >= least).cast("double"))).alias("stable"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "i int, feature string")
    return names.join(out, "i", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("stable", F.lit(0.0)).alias("stable"))


def mrmr(df: DataFrame, columns: list[str], target: str, k: int, relation: str = "correlation", scheme: str = "difference", bins: int = 16) -> list[str]:
    """Greedy choice of k columns: relevance to the target less the mean redundancy with those chosen, or (scheme "quotient") over it, plus 1e-12; one pass gives all pairs.

    relation: |correlation|, or "information": mutual information of quantile bins. Ties: the last name."""
    if relation == "information":
        pairs = ((r.feature_a, r.feature_b, r.mi) for r in information_matrix(df, [*columns, target], bins).collect())
    else:
        pairs = ((r.feature_a, r.feature_b, abs(r.value)) for r in correlations(df, [*columns, target]).collect())
    value = {}
    for a, b, v in pairs:
        value[a, b] = value[b, a] = v
    of = lambda a, b: value.get((a, b), 0.0)

    def score(c: str) -> float:
        if not chosen:
            return of(c, target)
        mean = sum(of(c, s) for s in chosen) / len(chosen)
        return of(c, target) / (mean + 1e-12) if scheme == "quotient" else of(c, target) - mean

    chosen: list[str] = []
    while len(chosen) < min(k, len(columns)):
        chosen.append(max((c for c in columns if c not in chosen), key=lambda c: (score(c), c)))
    return chosen


def top_candidates(df: DataFrame, signature: str, score: str, k: int) -> DataFrame:
    """The best score per signature, and of those the k best; ties by signature."""
    return df.groupBy(signature).agg(F.max(score).alias(score)).orderBy(F.desc(score), signature).limit(k)


def good_and_bad(df: DataFrame, group: str, loss: str, tie: str, share: float) -> DataFrame:
    """Adds good: among the best share of its group by loss, at least one."""
    w = Window.partitionBy(group)
    limit = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share))
    return df.withColumn("good", F.row_number().over(w.orderBy(loss, tie)) <= limit)


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the share of the value's variance that lies between groups."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mm"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s"))
    between = F.col("s") - F.col("n") * F.col("mm") * F.col("mm")
    return t.select(F.try_divide(between, between + F.col("within")).alias("eta2"))


def fair_share(durations: list[float], workers: int) -> float:
    """Makespan of longest-first assignment."""
    load = [0.0] * max(1, workers)
    for d in sorted(durations, reverse=True):
        at = load.index(min(load))
        load[at] += d
    return max(load)


def _assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="_v", outputCol="features", withMean=True).fit(v).transform(v).drop("_v")


def clusters(df: DataFrame, columns: list[str], k: int, seed: int = 1) -> DataFrame:
    """Adds cluster and the squared distance to its centre, from standardised columns."""
    from pyspark.ml.clustering import KMeans

    v = _assembled(df, columns)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v).drop("features")


def _passes(points: DataFrame, columns: list[str], scale: list[tuple[float, float]], fold: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The sums over all points of the arrays that fold(x, n) gives, x standardised and n the rows at each point: one sum a partition and cell, summed again by cell."""
    shift, wide = (np.array(v) for v in zip(*scale, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            *x, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for at in range(0, len(n), 8192):
                part = [np.asarray(v, float) for v in fold((np.column_stack([v[at : at + 8192] for v in x]) - shift) * wide, n[at : at + 8192].astype(float))]
                total = part if total is None else [t + v for t, v in zip(total, part, strict=True)]
        if total is not None:
            flat = np.concatenate([v.ravel() for v in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    sums = points.select(*columns, "n").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row a cell
    flat = np.zeros(len(sums))
    for r in sums:
        flat[r.i] = r.v
    out, at = [], 0
    for v in fold(np.zeros((0, len(columns))), np.zeros(0)):
        out.append(flat[at : at + v.size].reshape(v.shape) if len(flat) else np.zeros(v.shape))
        at += v.size
    return out


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1))


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each row's nearest centre, the first of equals."""
    d = (-2 * centres) @ x.T + (centres * centres).sum(1)[:, None]
    best, at = d[0], np.zeros(len(x), int)
    for k in range(1, len(d)):
        less = d[k] < best
        at[less] = k
        best = np.minimum(best, d[k])
    return at


def _starts(points: DataFrame, columns: list[str], scale: list[tuple[float, float]], ks: list[int], seed: int, steps: int = 2) -> dict[int, np.ndarray]:
    """First centres for each k: candidates for the largest k are drawn by their values' hash with odds that grow with rows and squared distance (k-means||), weighed by the
    rows next to them, and cut to k by weighted k-means++ and its moves, the best of ten tries. Equal rows give equal centres however they are dealt."""
    shift, wide = (np.array(v) for v in zip(*scale, strict=True))
    place = lambda rows: (np.array(sorted({tuple(r[c] for c in columns) for r in rows})).reshape(-1, len(columns)) - shift) * wide
    draw = lambda step: F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(step)), F.lit(1 << 52)) / float(1 << 52)
    most, kept = max(ks), points.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(1).collect()
    found = place(kept)
    for step in range(steps):
        (cost,) = _passes(points, columns, scale, lambda x, n, c=found: (np.array([(_squares(x, c).min(1) * n).sum()]),))
        if not cost[0] > 0:
            break

        def drawn(batches: Iterator[pa.RecordBatch], found=found, cost=float(cost[0])) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *x, n, u = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                odds = 2 * most * n * _squares((np.column_stack(x) - shift) * wide, found).min(1) / cost
                yield batch.filter(pa.array(u < odds))

        told = points.select(*columns, "n", draw(step).alias("u"))
        kept += told.mapInArrow(drawn, told.schema).collect()  # about 2 k rows
        found = place(kept)
    (weight,) = _passes(points, columns, scale, lambda x, n, c=found: (np.bincount(_near(x, c), n, len(c)),))
    out = {}
    for k in ks:
        tries = []
        for t in range(10):
            rng = np.random.default_rng([seed, k, t])
            at = [int(rng.choice(len(found), p=weight / weight.sum()))]
            while len(at) < k:
                odds = _squares(found, found[at]).min(1) * weight
                odds[at] = 0
                if not odds.sum() > 0:
                    break
                at.append(int(rng.choice(len(found), p=odds / odds.sum())))
            c = found[at]
            for _ in range(30):
                near = _near(found, c)
                n = np.bincount(near, weight, len(c))
                moved = np.column_stack([np.bincount(near, weight * v, len(c)) for v in found.T]) / np.where(n > 0, n, 1)[:, None]
                c = np.where(n[:, None] > 0, moved, c)
            tries.append(((_squares(found, c).min(1) * weight).sum(), t, c))
        out[k] = min(tries, key=lambda v: v[:2])[2]
    return out


def cluster_counts(df: DataFrame, columns: list[str], ks: list[int], seed: int = 1, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """k, cost, silhouette, best for each number of clusters over standardised columns: the mean silhouette of all rows by squared distances, from sums per cluster and not from pairs.

    cost: the mean squared distance to a row's own centre. best marks the highest silhouette (ties: the smallest k). Rows with a null are left out; a k that finds fewer than two clusters has silhouette 0.
    k-means of all numbers of clusters share each pass, over the distinct points with their counts; rounds and tolerance end it, as in pyspark.ml."""
    held = Rounds(df.sparkSession, "clusters")
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    points = held.put(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("n")))
    told = [(k, float("nan"), 0.0) for k in ks]
    size = points.agg(F.sum("n"), *(F.sum(F.col(c) * F.col("n")) for c in columns)).first()
    if size[0] and ks:
        means = [size[j + 1] / size[0] for j in range(len(columns))]
        spread = points.agg(*(F.sqrt(F.sum((F.col(c) - F.lit(m)) ** 2 * F.col("n")) / F.lit(max(1.0, size[0] - 1))) for c, m in zip(columns, means, strict=True))).first()
        scale = [(m, 1 / d if d else 0.0) for m, d in zip(means, spread, strict=True)]
        centres = _starts(points, columns, scale, ks, seed)

        def sums(centres: dict[int, np.ndarray]) -> list[np.ndarray]:
            """Per k and cluster: rows, sum of squares, sums of the columns."""

            def fold(x, n):
                told = n[:, None] * np.column_stack([np.ones(len(x)), (x * x).sum(1), x])
                near = [_near(x, c) for c in centres.values()]
                return tuple(np.array([(a == k).astype(float) @ told for k in range(len(c))]) for a, c in zip(near, centres.values(), strict=True))

            return _passes(points, columns, scale, fold)

        live = dict(centres)
        for _ in range(rounds):
            for k, s in zip(list(live), sums(live), strict=True):
                full = s[:, :1] > 0
                moved = np.where(full, s[:, 2:] / np.where(full, s[:, :1], 1), live[k])
                still = ((moved - live[k]) ** 2).sum(1).max() <= tolerance**2
                centres[k] = live[k] = moved
                if still:
                    del live[k]
            if not live:
                break
        cells = dict(zip(centres, sums(centres), strict=True))

        def silhouettes(x, n):
            out = []
            for k, c in centres.items():
                s = cells[k]
                near, full = _near(x, c), s[:, 0] > 0
                total = np.maximum(0.0, (x * x).sum(1)[:, None] * s[:, 0] - 2 * (x @ s[:, 2:].T) + s[:, 1])
                at, own = np.arange(len(x)), s[near, 0]
                a = np.where(own > 1, total[at, near] / np.maximum(own - 1, 1), 0.0)
                means = np.where(full, total / np.where(full, s[:, 0], 1), np.inf)
                means[at, near] = np.inf
                b = means.min(1)
                top = np.maximum(a, b)
                ok = (own > 1) & np.isfinite(b) & (top > 0)
                out.append(np.array([(np.where(ok, (np.where(ok, b, 0.0) - a) / np.where(ok, top, 1.0), 0.0) * n).sum()]))
            return tuple(out)

        total = dict(zip(centres, _passes(points, columns, scale, silhouettes), strict=True))
        cost = {k: sum(c[1] - (c[2:] ** 2).sum() / c[0] for c in s if c[0] > 0) / size[0] for k, s in cells.items()}
        told = [(k, cost[k], total[k][0] / size[0] if (cells[k][:, 0] > 0).sum() > 1 else 0.0) for k in ks]
    best = max(told, key=lambda r: (round(r[2], 9), -r[0]), default=(None,))[0]
    return df.sparkSession.createDataFrame([(k, float(c), float(s), k == best) for k, c, s in told], "k long, cost double, silhouette double, best boolean")


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = _assembled(df, columns)
    out = PCA(k=k, inputCol="features", outputCol="_p").fit(v).transform(v).withColumn("_a", vector_to_array("_p"))
    return out.withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(k)}).drop("features", "_p", "_a")


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """Adds calibrated: the pooled-adjacent-violators fit of the label on the score."""
    from pyspark.ml.regression import IsotonicRegression

    v = df.withColumn("_w", F.lit(1.0))
    return IsotonicRegression(featuresCol=score, labelCol=label, weightCol="_w", predictionCol="calibrated").fit(v).transform(v).drop("_w")


def importance(df: DataFrame, columns: list[str], target: str, trees: int = 10, depth: int = 4, seed: int = 1) -> dict[str, float]:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)
    model = RandomForestClassifier(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(v)
    return dict(zip(columns, map(float, model.featureImportances.toArray()), strict=True))


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, mi in nats between rank bins of each column over the whole table and the label, by falling value."""
    out = None
    for c in columns:
        d = df.select(c, label).na.drop()
        n = d.agg(F.count("*").alias("_n"))  # one row
        ranks = value_ranks(d, c).select(c, "rank").join(F.broadcast(n)).select(c, F.least(F.floor((F.col("rank") - 1) * bins / F.col("_n")), F.lit(bins - 1)).alias("_b"))
        cells = d.groupBy(c, label).agg(F.count("*").alias("_m")).join(ranks, c).groupBy("_b", label).agg(F.sum("_m").cast("double").alias("_c"))
        w = lambda *by: F.sum("_c").over(Window.partitionBy(*by))  # noqa: E731  # bins times labels rows
        p = cells.withColumn("_n", w()).withColumn("_nb", w("_b")).withColumn("_ny", w(label))
        row = p.agg(F.sum(F.col("_c") / F.col("_n") * F.ln(F.col("_c") * F.col("_n") / (F.col("_nb") * F.col("_ny")))).alias("mi")).select(F.lit(c).alias("feature"), "mi")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("mi"), "feature")


def top_overlap(df: DataFrame, key: str, a: str, b: str, k: int) -> DataFrame:
    """One row, overlap: the share of the k best by a that are among the k best by b; ties by key."""
    best = lambda c: df.orderBy(F.desc(c), key).limit(k).select(key)
    return best(a).join(best(b), key).agg((F.count("*") / F.lit(float(k))).alias("overlap"))

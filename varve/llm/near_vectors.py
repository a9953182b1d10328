"""Near-duplicate embeddings by an inverted multi-index.

Each vector, scaled to length 1, is cut into halves; a codebook per half, fitted on a bounded sample, makes a grid of cells, and every vector is indexed in
its cell. A vector visits cells by a multi-sequence traversal in the order of a lower bound on the distance to any member, until the bound passes
a limit. The limit is set so that the target recall is met: sample vectors, each moved in a random direction to exactly the
cosine threshold, fall within the limit in TARGET_RECALL of cases; and a pair is met if either vector visits the other's cell. The visitors of a cell meet its
members in pairs of blocks by exact cosine; a pair that both visit counts once. Block pairs return counts and spanning edges, never all pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .shared import Stash, bounded_batches, slices
from .topk import finite

MIN_COSINE = 0.98
TARGET_RECALL = 0.999
#: Vectors that the codebooks are fitted on at most, aimed-at vectors per cell, and codes per half at most (a grid of a million cells).
SAMPLE, CELL, MAX_CODES = 8192, 64, 1024
BLOCK = 256
#: Moved copies of each of so many sample vectors that the limit is set by.
MOVED, MOVED_OF = 8, 2048


def fit_codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """k-means with a fixed start; at least one code."""
    rng = np.random.default_rng(7)
    points = np.unique(points, axis=0)
    centres = points[rng.permutation(len(points))[:codes]].copy()
    for _ in range(rounds):
        own = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(0)
    return centres


def cell_bounds(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code of each point, and squared lower bounds on its distance to any point whose nearest code is another (by the bisecting plane)."""
    d = np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)
    own = d.argmin(1)
    apart = np.sqrt(np.maximum((centres**2).sum(1)[:, None] - 2 * centres @ centres.T + (centres**2).sum(1), 0))
    gap = d - np.take_along_axis(d, own[:, None], 1)
    plane = np.where(apart[own] > 1e-9, gap / (2 * np.maximum(apart[own], 1e-9)), 0)
    return own, np.maximum(plane - 1e-7, 0) ** 2


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in ascending order of a[i] + b[j], while the sum is within limit."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(float(a[ia[0]] + b[ib[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(ia[i]), int(ib[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(a[ia[x]] + b[ib[y]]), x, y))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def visit_limit(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], min_cosine: float, recall: float = TARGET_RECALL) -> float:
    """The bound within which the given share of the sample's vectors, each moved to exactly min_cosine, have the cell of the moved vector. For a recall of 1 it
    is the squared distance of unit vectors at min_cosine: a cell whose lower bound lies beyond it holds no link, whatever the direction."""
    if recall >= 1:
        return 2 - 2 * min_cosine + 1e-9
    rng = np.random.default_rng(11)
    x = np.repeat(points[:MOVED_OF], MOVED, axis=0)
    step = rng.standard_normal(x.shape)
    step -= (step * x).sum(1, keepdims=True) * x
    moved = min_cosine * x + np.sqrt(1 - min_cosine**2) * step / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12)
    bound = np.zeros(len(x))
    for half, other, book in zip(_halves(x), _halves(moved), books, strict=True):
        bound += np.take_along_axis(cell_bounds(half, book)[1], cell_bounds(other, book)[0][:, None], 1)[:, 0]
    return min(2 - 2 * min_cosine, float(np.quantile(bound, recall))) + 1e-9


def _index(books: dict[int, tuple[np.ndarray, np.ndarray]], limits: dict[int, float]):
    """Adds to rows label, rep, mult, vector, dim each vector's cell and the cells that it visits; vectors are scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in batch.column(3)]
            cells, visits = [0] * len(vectors), [[]] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                scaled = unit_rows(np.array([vectors[i] for i in at]))
                for i, row in zip(at, scaled, strict=True):
                    vectors[i] = row
                (own_a, low_a), (own_b, low_b) = (cell_bounds(h, c) for h, c in zip(_halves(scaled), books[dim], strict=True))
                wide = len(books[dim][1])
                for n, i in enumerate(at):
                    cells[i] = int(own_a[n]) * wide + int(own_b[n])
                    visits[i] = [a * wide + b for a, b in multi_sequence(low_a[n], low_b[n], limits[dim])]
            unit = pa.array(vectors, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], unit, *batch.columns[4:], pa.array(cells, pa.int32()), pa.array(visits, pa.list_(pa.int32()))], [*batch.schema.names, "cell", "visits"])

    return run


def _compare(min_cosine: float):
    """Rows: a block of a cell's visitors (v_reps, v_mults, v_cells, v_vectors) and a block of its members (cell, reps, mults, visits, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            a, mult_a, b, mult_b = (np.array(row[c], np.int64) for c in ("v_reps", "v_mults", "reps", "mults"))
            x, y = np.frombuffer(row["v_vectors"]).reshape(len(a), -1), np.frombuffer(row["vectors"]).reshape(len(b), -1)
            i, j = np.nonzero(x @ y.T >= min_cosine)
            came = np.array(row["v_cells"], np.int64)[i]
            both = came == row["cell"]  # within the cell, or the member visits the visitor's cell too
            visits = [set(v) for v in row["visits"]]
            for at in np.flatnonzero(~both).tolist():
                both[at] = int(came[at]) in visits[j[at]]
            on = (a[i] != b[j]) & (~both | (a[i] < b[j]))
            i, j = i[on], j[on]
            if not len(i):
                continue
            nodes, at = np.unique(np.concatenate([a[i], b[j]]), return_inverse=True)
            links = np.bincount(at, weights=np.concatenate([mult_b[j], mult_a[i]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), pa.array(roots(a[i], b[j])[1])], ["rep", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. recall: the share of links at min_cosine, in random directions, that is met at least; with 1 every link is found.

    Vectors are compared only if their labels are equal and not null and their lengths agree. Null ids and vectors that are null, empty, zero or hold
    null or non-finite components link with nothing. Exact copies (told by two 64-bit hashes) are linked with each other and compared once. Rows that repeat an id
    with other vectors are one node, and each of them tells the links of all. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "near")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    largest = F.array_max(F.transform("embedding", F.abs))
    usable = finite("embedding") & (F.size("embedding") > 0) & (largest > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.select("*", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    good = rows.filter("usable").select("vec_id", "label", F.size("embedding").alias("dim"), "embedding", "h1", "h2")
    distinct = stash.put(good.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("embedding").alias("vector")))
    unit = distinct.select("label", "rep", "mult", "vector", "dim")
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    limits: dict[int, float] = {}
    for shape in distinct.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect():
        sample = unit.filter(F.col("dim") == shape.dim).orderBy(F.xxhash64("rep", "label"), "rep").limit(SAMPLE).select("vector").collect()
        codes = int(min(MAX_CODES, max(2, np.sqrt(shape.n / shape.labels / CELL))))
        points = unit_rows(np.array([r.vector for r in sample]))
        books[shape.dim] = tuple(fit_codebook(h, codes) for h in _halves(points)) if shape.dim > 1 else (fit_codebook(points, codes), np.zeros((1, 0)))
        limits[shape.dim] = visit_limit(points, books[shape.dim], min_cosine, recall)
    label = f"label {dict(unit.dtypes)['label']}"
    indexed = stash.put(unit.mapInArrow(_index(books, limits), f"{label}, rep long, mult long, vector array<double>, dim int, cell int, visits array<int>"))
    visitors = indexed.select("label", "dim", F.explode("visits").alias("cell"), F.col("cell").alias("from_cell"), "rep", "mult", "vector")
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).alias("parts")

    def dealt(rows: DataFrame, cells: DataFrame, more: str) -> DataFrame:
        """Blocks of about BLOCK rows of a cell, dealt by hash; one row per block, with `more` as a list."""

        def block(frame: pd.DataFrame) -> pd.DataFrame:
            first = frame.iloc[0]
            return pd.DataFrame({"label": [first.label], "dim": [first.dim], "cell": [first.cell], "part": [first.part], "reps": [frame.rep.tolist()], "mults": [frame.mult.tolist()], "more": [frame.more.tolist()], "vectors": [np.array(frame.vector.tolist(), float).tobytes()]})

        kind = dict(rows.dtypes)[more]
        placed = rows.join(cells, ["label", "dim", "cell"]).select("label", "dim", "cell", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep", "mult", F.col(more).alias("more"), "vector")
        return stash.put(placed.groupBy("label", "dim", "cell", "part").applyInPandas(block, f"{label}, dim int, cell int, part long, reps array<long>, mults array<long>, more array<{kind}>, vectors binary"))

    members = stash.put(indexed.groupBy("label", "dim", "cell").agg(parts))
    guests = stash.put(visitors.join(members.select("label", "dim", "cell"), ["label", "dim", "cell"], "left_semi").groupBy("label", "dim", "cell").agg(parts))
    blocks = dealt(indexed, members, "visits").withColumnRenamed("more", "visits")
    asked = dealt(visitors, guests, "from_cell").select("label", "dim", "cell", F.col("part").alias("v_part"), F.col("reps").alias("v_reps"), F.col("mults").alias("v_mults"), F.col("more").alias("v_cells"), F.col("vectors").alias("v_vectors"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = members.join(guests.withColumnRenamed("parts", "v_parts"), ["label", "dim", "cell"]).withColumn("part", upto("parts")).withColumn("v_part", upto("v_parts")).select("label", "dim", "cell", "part", "v_part")  # numbers only: a hot cell's block pairs are dealt out one by one
    met = pairs.join(blocks, ["label", "dim", "cell", "part"]).join(asked, ["label", "dim", "cell", "v_part"])
    found = stash.put(met.select("cell", "reps", "mults", "visits", "vectors", "v_reps", "v_mults", "v_cells", "v_vectors").mapInArrow(_compare(min_cosine), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), stash)
    told = stash.put(distinct.join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left").select("label", "dim", "h1", "h2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(told, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))

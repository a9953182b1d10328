"""Exact top-k by inner product over a vector-approximation file.

The file holds, per block of BLOCK vectors, cells of CELL_BITS bits per component and, beside them, the exact vectors. Pass 1 scans cells only
and finds each query's k-th highest lower bound. Pass 2 scans cells again and names the (block, row) places whose upper bound reaches it for
some query of a query block; exact vectors are joined to those places alone, and each query reads its own in the order of the bounds, until
no bound left can change its k best. Cells meet queries block by block; survivors are dealt into chunks of about BLOCK a query block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Stash, bounded_batches

BLOCK, QUERY_BLOCK = 2048, 1024
CELL_BITS = 6
SCALE = 1024
READ_AHEAD = 64
_LONG = (1 << 63) - 1


def finite(column: str):
    """Vectors that take part: not null, with finite components only."""
    x = F.col(column)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def _pack(size: int, with_cells: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int, rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            nonlocal made
            exact = np.array([r[1] for r in rows]).reshape(len(rows), dim)
            low, high = exact.min(0), exact.max(0)
            step = np.maximum((high - low) / (1 << CELL_BITS), 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1e-9)
            cells = np.clip(np.floor((exact - low) / step), 0, (1 << CELL_BITS) - 1).astype(np.uint8)
            number = part << 32 | made
            made += 1
            row = [[dim], [number], [[r[0] for r in rows]], [[r.tobytes() for r in exact]], [cells.tobytes() if with_cells else b""], [low.tobytes()], [step.tobytes()]]
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["dim", "number", "ids", "exact", "cells", "low", "step"])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.floor(vector.values.to_numpy(zero_copy_only=False) * SCALE)
                rows = held.setdefault(len(x), [])
                rows.append((vec_id, x))
                if len(rows) == size:
                    yield block(len(x), held.pop(len(x)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return run


BLOCKS = "dim int, number long, ids array<long>, exact array<binary>, cells binary, low binary, step binary"


def _bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products, a little widened for rounding. Rows: queries."""
    base = q @ low
    inner = (q * step) @ cells.T.astype(np.float64) + base[:, None]
    slack = 1e-9 * (np.abs(q) @ (np.abs(low) + (1 << CELL_BITS) * step))[:, None] + 1e-6
    return inner + (np.minimum(q, 0) @ step)[:, None] - slack, inner + (np.maximum(q, 0) @ step)[:, None] + slack


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, as Python or int64 values: exact at any size, held within a long."""
    if float((np.abs(x) @ np.abs(q)).max(initial=0)) < 2.0**52:
        return (x @ q).astype(np.int64)
    return np.array([max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in x], np.int64)


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d, ids, mine = row["dim"], np.array(row["ids"], np.int64), np.array(row["q_ids"], np.int64)
                q = np.frombuffer(b"".join(row["q_exact"])).reshape(len(mine), d)
                lower, _ = _bounds(q, np.frombuffer(row["cells"], np.uint8).reshape(len(ids), d), np.frombuffer(row["low"]), np.frombuffer(row["step"]))
                lower[ids[None, :] == mine[:, None]] = -np.inf
                top = -np.sort(-lower, axis=1)[:, :k] if lower.shape[1] <= k else -np.sort(-(-np.partition(-lower, k - 1, axis=1)[:, :k]), axis=1)
                at, width = np.arange(len(mine)), top.shape[1]
                flat = top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), row["q_number"])), pa.array(np.repeat(at, width).astype(np.int32)), pa.array(flat)], ["q_number", "q_row", "lower"])

    return run


def _least(row: dict, queries: int) -> np.ndarray:
    """Each query's k-th highest lower bound; without k candidates every vector may be one of its best."""
    least = np.full(queries, -np.inf)
    for t in row["taus"] or []:
        least[t["q_row"]] = t["tau"]
    return least


def _survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of a file block that some query of a query block may have among its best, with what their bounds need."""
    for batch in batches:
        for row in batch.to_pylist():
            d, ids, mine = row["dim"], np.array(row["ids"], np.int64), np.array(row["q_ids"], np.int64)
            cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), d)
            _, upper = _bounds(np.frombuffer(b"".join(row["q_exact"])).reshape(len(mine), d), cells, np.frombuffer(row["low"]), np.frombuffer(row["step"]))
            places = np.flatnonzero(((upper >= _least(row, len(mine))[:, None]) & (ids[None, :] != mine[:, None])).any(0))
            n = len(places)
            same = lambda v, t, n=n: pa.array([v] * n, t)
            yield pa.RecordBatch.from_arrays(
                [same(row["q_number"], pa.int64()), same(row["number"], pa.int64()), pa.array(places.astype(np.int32)), pa.array([cells[i].tobytes() for i in places], pa.binary()), same(row["low"], pa.binary()), same(row["step"], pa.binary())],
                ["q_number", "number", "row", "cells", "low", "step"],
            )


def _refine(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d, mine, held = row["dim"], np.array(row["q_ids"], np.int64), row["held"]
                q, exact = np.frombuffer(b"".join(row["q_exact"])).reshape(len(mine), d), np.frombuffer(b"".join(h["exact"] for h in held)).reshape(len(held), d)
                ids = np.array([h["vec_id"] for h in held], np.int64)
                low, step = (np.frombuffer(b"".join(h[c] for h in held)).reshape(len(held), d) for c in ("low", "step"))
                corner = low + step * np.frombuffer(b"".join(h["cells"] for h in held), np.uint8).reshape(len(held), d)
                slack = 1e-9 * (np.abs(q) @ (np.abs(low) + (1 << CELL_BITS) * step).T) + 1e-6
                upper = q @ corner.T + np.maximum(q, 0) @ step.T + slack
                may = (upper >= _least(row, len(mine))[:, None] - slack) & (ids[None, :] != mine[:, None])
                out: list[tuple[int, int, int, int]] = []
                for i in range(len(mine)):
                    order = np.flatnonzero(may[i])
                    order = order[np.argsort(-upper[i, order], kind="stable")]
                    best: list[tuple[int, int]] = []
                    for at in range(0, len(order), READ_AHEAD):
                        if len(best) == k and -best[-1][0] > upper[i, order[at]]:
                            break
                        read = order[at : at + READ_AHEAD]
                        best = sorted(best + list(zip((-_exact(exact[read], q[i])).tolist(), ids[read].tolist(), strict=True)))[:k]
                    out += [(i, int(mine[i]), v, -s) for s, v in best]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out), row["q_number"], np.int64)), *(pa.array(c, pa.int64()) for c in columns)], ["q_number", "q_row", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by every: its k highest inner products of floor(1024 x).

    Ties go to the smaller vec_id. Null ids and vectors that are null or hold null or non-finite components take no part; vectors of
    another length are no candidates; rows that repeat the query's id are its own; a repeated query row is answered
    each time; scores beyond a long are held at its ends. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    stash = Stash(vectors.sparkSession, "va")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & finite("embedding"))
    file = stash.put(rows.mapInArrow(_pack(BLOCK, True), BLOCKS))
    asked = rows.filter(F.col("vec_id") % every == 0).repartition(F.floor(F.col("vec_id") / (QUERY_BLOCK * every)))
    asked = stash.put(asked.mapInArrow(_pack(QUERY_BLOCK, False), BLOCKS)).select("dim", F.col("number").alias("q_number"), F.col("ids").alias("q_ids"), F.col("exact").alias("q_exact"))
    sizes = file.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 2)).cast("int").alias("salts"))  # about two file blocks meet a query block in one task
    numbers = asked.join(sizes, "dim").select("dim", "q_number", "salts")
    spread = file.join(sizes, "dim").withColumn("salt", F.pmod(F.xxhash64("number"), F.col("salts"))).drop("salts")

    def meet(parts: DataFrame, questions: DataFrame) -> DataFrame:
        """Every query block with every file block of its length, dealt out by (query block, salt)."""
        wanted = numbers.select("dim", "q_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"))
        placed = questions.join(wanted, ["dim", "q_number"])
        return parts.join(placed, ["dim", "salt"])

    lower = meet(spread.select("dim", "salt", "ids", "cells", "low", "step"), asked).select("dim", "ids", "cells", "low", "step", "q_number", "q_ids", "q_exact").mapInArrow(_scan(k), "q_number long, q_row int, lower double")
    ranked = lower.withColumn("r", F.row_number().over(Window.partitionBy("q_number", "q_row").orderBy(F.desc("lower")))).filter(F.col("r") <= k)
    taus = ranked.filter(F.col("r") == k).groupBy("q_number").agg(F.collect_list(F.struct("q_row", F.col("lower").alias("tau"))).alias("taus"))  # at most QUERY_BLOCK of them
    questions = stash.put(asked.join(taus, "q_number", "left"))
    near = meet(spread.select("dim", "salt", "number", "ids", "cells", "low", "step"), questions).select("dim", "number", "ids", "cells", "low", "step", "q_number", "q_ids", "q_exact", "taus")
    near = stash.put(near.mapInArrow(_survive, "q_number long, number long, row int, cells binary, low binary, step binary"))
    chunks = near.groupBy("q_number").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))  # a row a query block
    near = near.join(chunks, "q_number").withColumn("chunk", F.pmod(F.xxhash64("number", "row"), F.col("chunks"))).drop("chunks")
    exact = file.select("number", F.posexplode(F.arrays_zip("ids", "exact")).alias("row", "e")).select("number", "row", F.col("e.ids").alias("vec_id"), F.col("e.exact").alias("exact"))
    held = near.join(exact, ["number", "row"]).groupBy("q_number", "chunk").agg(F.collect_list(F.struct("vec_id", "exact", "cells", "low", "step")).alias("held"))  # about BLOCK of them
    wanted = chunks.select("q_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    found = held.join(questions.join(wanted, "q_number"), ["q_number", "chunk"]).select("dim", "held", "q_number", "q_ids", "q_exact", "taus").mapInArrow(_refine(k), "q_number long, q_row long, query_id long, vec_id long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_number", "q_row").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")

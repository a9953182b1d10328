"""Choosing columns by a fitted model: all-relevant columns against shadows, and elimination by cross-validation, on boosted trees."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import Rounds
from . import boost


def numbered(df: DataFrame, held: Rounds) -> tuple[DataFrame, int]:
    """df written with _i, 0 to n - 1 without gaps, and n: a row's place in its partition plus the rows of the partitions before, one count a partition."""
    rows = held.put(df.withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    base = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_base"))  # one row a partition
    out = held.put(rows.withColumn("_p", part).join(F.broadcast(base), "_p").withColumn("_i", F.col("_base") + place).drop("_m", "_p", "_base"))
    return out, out.count()


def shuffled(rows: DataFrame, columns: Sequence[str], n: int, seed: int, name: str = "shadow_", source: DataFrame | None = None) -> DataFrame:
    """rows (with _i) and, from source (default: rows), a copy of each column with its rows exchanged by one pseudorandom bijection of 0 to n - 1, i -> (a i + b) mod n with a and n coprime: one join."""
    r = random.Random(seed)
    a = r.randrange(1, max(2, n))
    while math.gcd(a, n) != 1:
        a = r.randrange(1, n)
    b = r.randrange(n) if n else 0
    i = F.col("_i") if a * n + b < 1 << 63 else F.col("_i").cast("decimal(20,0)")
    to = F.pmod(i * F.lit(a) + F.lit(b), F.lit(max(1, n))).cast("long")
    moved = (rows if source is None else source).select(to.alias("_i"), *(F.col(c).alias(f"{name}{c}") for c in columns))
    return rows.join(moved, "_i")


def at_least(hits: int, n: int) -> float:
    """P(X >= hits) of n fair coins."""
    return sum(math.comb(n, k) for k in range(hits, n + 1)) / 2**n


def all_relevant(df: DataFrame, columns: Sequence[str], target: str, tries: int = 10, level: float = 0.05, seed: int = 1, **model) -> DataFrame:
    """feature, hits, tries, importance (mean), decision: in each try columns and their shuffled shadows are boosted together; a hit is a greater importance than every
    shadow's. Of the tries' fair coins: accepted if so many hits are too unlikely, rejected if so few are (level over the number of columns on each side), else tentative.

    A column that is rejected after a try takes no part in later ones. model: parameters of boost.fit. Rows without a target are left out."""
    held = Rounds(df.sparkSession, "relevant")
    known = df.filter(F.col(target).isNotNull()).select(*columns, target)
    edges = dict(zip(columns, boost.bin_edges(known, list(columns), model.get("bins", 32)), strict=True))
    rows, n = numbered(boost.as_bins(known, edges, [target]), held)  # a row is binned once, and its bins are what is shuffled
    hits, sums, played = dict.fromkeys(columns, 0), dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 0)
    state = dict.fromkeys(columns, "tentative")
    limit = level / max(1, len(columns))
    edges |= {f"shadow_{c}": e for c, e in edges.items()}  # a shadow has its column's values
    for i in range(tries if n else 0):
        live = [c for c in columns if state[c] != "rejected"]
        if not live:
            break
        both = shuffled(rows, live, n, seed * 1000 + i)
        gain = boost.fit(both, [*live, *(f"shadow_{c}" for c in live)], target, edges=edges, binned=True, **model).importance()
        most = max(gain[f"shadow_{c}"] for c in live)
        for c in live:
            hits[c] += gain[c] > most
            sums[c] += gain[c]
            played[c] += 1
            if at_least(hits[c], played[c]) <= limit:
                state[c] = "accepted"
            elif at_least(played[c] - hits[c], played[c]) <= limit:
                state[c] = "rejected"
            else:
                state[c] = "tentative"
    told = [(c, hits[c], played[c], sums[c] / played[c] if played[c] else 0.0, state[c]) for c in columns]
    return df.sparkSession.createDataFrame(told, "feature string, hits long, tries long, importance double, decision string")


def eliminated(df: DataFrame, columns: Sequence[str], target: str, folds: int = 3, least: int = 1, **model) -> DataFrame:
    """size, dropped, error, best: columns are left out one by one, the least important of a model of all rows first (ties: the later one); error is the mean squared error of
    predictions by models of the other folds, folds by place; bins are of all rows. best marks the smallest size among those of the least error (6 digits)."""
    held = Rounds(df.sparkSession, "eliminated")
    rows, _ = numbered(df.filter(F.col(target).isNotNull()).select(*columns, target), held)
    edges = dict(zip(columns, boost.bin_edges(rows, list(columns), model.get("bins", 32)), strict=True))
    fold = F.pmod(F.xxhash64("_i"), F.lit(folds))
    left, told = list(columns), []
    while len(left) >= max(1, least):
        errors = []
        for k in range(folds):
            fitted = boost.fit(rows.filter(fold != k), left, target, edges=edges, **model)
            gap = F.col("prediction") - F.col(target)
            errors.append(fitted.predict(rows.filter(fold == k)).agg(F.sum(gap * gap), F.count("*")).first())
        error = sum(e[0] or 0.0 for e in errors) / max(1, sum(e[1] for e in errors))
        gain = boost.fit(rows, left, target, edges=edges, **model).importance()
        worst = min(left, key=lambda c: (gain[c], -left.index(c)))
        told.append((len(left), worst, float(error)))
        left.remove(worst)
    best = min(told, key=lambda r: (round(r[2], 6), r[0]), default=(0, "", 0.0))[0]
    return df.sparkSession.createDataFrame([(s, d, e, s == best) for s, d, e in told], "size long, dropped string, error double, best boolean")

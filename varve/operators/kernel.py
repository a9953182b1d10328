"""Kernel dependence of columns by random features: one pass sums the products of all features, the rest is linear algebra of the features' number squared."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nan_to_null
from ..functions.quantiles import column_percentiles
from ..functions.tables import Rounds
from .wrapper import numbered, shuffled

#: Features of all blocks together at most: their squared number of sums reaches the driver.
MOST = 2048


def weights(columns: int, features: int, seed: int, block: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (columns x features, standard normal) and phases of a block's feature map."""
    rng = np.random.default_rng([seed, block])
    return rng.standard_normal((columns, features)), rng.uniform(0, 2 * math.pi, features)


def feature_map(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of scaled columns as features whose inner products approach the Gaussian kernel of width 1."""
    return math.sqrt(2 / len(b)) * np.cos(x @ w + b)


def widths(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Kernel width of each column: the interquartile range over 1.349; 1 where it is 0 or the column has no values."""
    row = column_percentiles(df, columns, [0.25, 0.75]).first()
    return {c: (row[c][1] - row[c][0]) / 1.349 or 1.0 if row[c] else 1.0 for c in columns}


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(nan_to_null(c).alias(c) for c in columns)).na.drop()


def products(df: DataFrame, blocks: Sequence[Sequence[str]], scale: dict[str, float], features: int, seed: int) -> tuple[int, np.ndarray]:
    """Rows and the centred sums of products of all features, block after block. Each partition sends one sum a pair of features, summed again by pair."""
    if len(blocks) * features > MOST:
        raise ValueError(f"at most {MOST} features in all blocks together")
    names = [list(b) for b in blocks]
    maps = [(np.array([scale[c] for c in b]), *weights(len(b), features, seed, k)) for k, b in enumerate(names)]
    size = len(names) * features + 1
    upper = np.triu_indices(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for frame in frames:
            for start in range(0, len(frame), 4096):
                part = frame.iloc[start : start + 4096]
                phi = np.column_stack([np.ones(len(part)), *(feature_map(part[c].to_numpy(float) / s, w, b) for c, (s, w, b) in zip(names, maps, strict=True))])
                total += phi.T @ phi
        if total[0, 0]:
            yield pd.DataFrame({"i": upper[0], "j": upper[1], "v": total[upper]})

    sums = df.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros((size, size))
    total[sums["i"], sums["j"]] = total[sums["j"], sums["i"]] = sums["v"]
    n = int(total[0, 0])
    return n, total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:]) / max(1, n)


def hsic_pairs(df: DataFrame, columns: Sequence[str], features: int = 64, seed: int = 1) -> DataFrame:
    """feature_a, feature_b, hsic (biased), alignment (hsic over the root of both columns' own), of the rows where all columns are present; one pass for all pairs.

    Constant columns have hsic and alignment 0; a table without rows gives zeros."""
    columns = list(columns)
    rows = _present(df, columns)
    n, s = products(rows, [[c] for c in columns], widths(rows, columns), features, seed)
    at = lambda i: slice(i * features, (i + 1) * features)
    norm = lambda i, j: float((s[at(i), at(j)] ** 2).sum()) / max(1, n) ** 2
    own = [norm(i, i) for i in range(len(columns))]
    told = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            base = math.sqrt(own[i] * own[j])
            told.append((columns[i], columns[j], norm(i, j), norm(i, j) / base if base > 1e-15 else 0.0))
    return df.sparkSession.createDataFrame(told, "feature_a string, feature_b string, hsic double, alignment double")


def exchanged_products(df: DataFrame, blocks: Sequence[Sequence[str]], tries: int, scale: dict[str, float], features: int, seed: int) -> list[np.ndarray]:
    """Per exchange k the centred sums of products of x's and z's features with those of y's columns under the names shadowk_; blocks in the order x, y, z. One pass for all exchanges."""
    maps = [(list(b), np.array([scale[c] for c in b]), *weights(len(b), features, seed, k)) for k, b in enumerate(blocks)]
    shape = (2 * features + 1, tries * features + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for frame in frames:
            for start in range(0, len(frame), 4096):
                part = frame.iloc[start : start + 4096]
                phi = lambda k, name: feature_map(part[[name + c for c in maps[k][0]]].to_numpy(float) / maps[k][1], *maps[k][2:])  # noqa: B023, E731
                one = np.ones(len(part))
                total += np.column_stack([one, phi(0, ""), phi(2, "")]).T @ np.column_stack([one, *(phi(1, f"shadow{t}_") for t in range(tries))])
        if total[0, 0]:
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    sums = df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # one row a pair of features
    total = np.zeros(shape[0] * shape[1])
    total[sums["i"]] = sums["v"]
    total = total.reshape(shape)
    centred = total[1:, 1:] - np.outer(total[1:, 0], total[0, 1:]) / max(1.0, total[0, 0])
    return [centred[:, t * features : (t + 1) * features] for t in range(tries)]


def residual_norm(s: np.ndarray, features: int, n: int) -> float:
    """The squared norm of x's and y's products with what z explains taken off both, over n (n - 1); blocks in the order x, y, z.

    With R = 1 - Z (Z'Z + tau)^-1 Z' it is |X' R R Y|^2, which equals the trace of the projected n x n kernels' product."""
    x, y, z = (slice(i * features, (i + 1) * features) for i in range(3))
    tau = max(1e-3, 1e-9 * float(np.trace(s[z, z])))
    left = np.linalg.solve(s[z, z] + tau * np.eye(features), s[z, y])
    right = np.linalg.solve(s[z, z] + tau * np.eye(features), s[z, x])
    m = s[x, y] - s[x, z] @ left - right.T @ s[z, y] + right.T @ s[z, z] @ left
    return float((m**2).sum()) / (n * (n - 1))


def conditional_hsic(df: DataFrame, x: Sequence[str], y: Sequence[str], z: Sequence[str], features: int = 64, tries: int = 0, seed: int = 1) -> DataFrame:
    """One row: n, hsic of x and y (over n (n - 1)), conditional (the same given z), p of the conditional one among `tries` exchanges of y's rows (null without tries).

    Of rows where all columns are present; below five rows the numbers are null. Exchanges keep x and z and move y by a pseudorandom bijection, one join each; one pass over the joined rows serves them all."""
    columns = list(dict.fromkeys([*x, *y, *z]))
    rows = _present(df, columns)
    scale = widths(rows, columns)
    n, s = products(rows, [x, y, z], scale, features, seed)
    schema = "n long, hsic double, conditional double, p double"
    if n < 5:
        return df.sparkSession.createDataFrame([(n, None, None, None)], schema)
    plain = float((s[:features, features : 2 * features] ** 2).sum()) / (n * (n - 1))
    found, above = residual_norm(s, features, n), 0
    if tries:
        held = Rounds(df.sparkSession, "exchanges")
        placed, _ = numbered(rows, held)
        moved = placed
        for k in range(tries):
            moved = shuffled(moved, list(y), n, seed * 1000 + k, f"shadow{k}_", placed)
        at = lambda i: slice(i * features, (i + 1) * features)
        for part in exchanged_products(moved, [x, y, z], tries, scale, features, seed):
            s[at(0), at(1)], s[at(2), at(1)] = part[:features], part[features:]  # an exchange changes no other product
            above += residual_norm(s, features, n) >= found
    return df.sparkSession.createDataFrame([(n, plain, found, (1 + above) / (1 + tries) if tries else None)], schema)

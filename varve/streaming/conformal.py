"""Adaptive conformal intervals of streams: each row's interval comes from what its series showed before it, then the row updates the series' state.

State per series: the miss rate alpha that is allowed now, the last `window` absolute residuals and the last row's place. It lies in Spark's state store, so a
restarted stream goes on from its checkpoint. Coverage is kept as one small table a micro-batch, written under the batch's number: a replayed batch
replaces its own rows and counts once.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "key string, id long, y double, prediction double, low double, high double, alpha double, late boolean"
STATE = "alpha double, residuals array<double>, last_t timestamp, last_id long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Rule:
    """target: the miss rate aimed at; gamma: how far one row moves alpha; window: residuals kept; least: residuals before the first interval."""

    target: float = 0.1
    gamma: float = 0.01
    window: int = 200
    least: int = 10

    def radius(self, ordered: list[float], alpha: float) -> float:
        """The residual at ceil((n + 1)(1 - alpha)) of n in ascending order, the largest if there is none; infinite while there are too few."""
        n = len(ordered)
        if n < self.least:
            return math.inf
        return ordered[min(n, max(1, math.ceil((n + 1) * (1 - alpha)))) - 1]

    def step(self, alpha: float, missed: bool) -> float:
        return min(0.99, max(0.01, alpha + self.gamma * (self.target - missed)))


def _play(key: str, rows: pd.DataFrame, state: tuple, rule: Rule) -> tuple[list[tuple], tuple]:
    """Output rows and the state after them. Rows without y or prediction get an interval where they can and change nothing; late ones, too."""
    alpha, residuals, last_t, last_id = state
    held, ordered = list(residuals), sorted(residuals)
    out = []
    for t, i, y, p in rows[["t", "id", "y", "prediction"]].itertuples(index=False):
        late = last_t is not None and (t, i) <= (last_t, last_id)
        r = rule.radius(ordered, alpha)
        none = pd.isna(p)
        out.append((key, i, None if pd.isna(y) else y, None if none else p, None if none else p - r, None if none else p + r, alpha, late))
        if late:
            continue
        last_t, last_id = t, i
        if none or pd.isna(y):
            continue
        gap = abs(y - p)
        if math.isfinite(r):
            alpha = rule.step(alpha, gap > r)
        held.append(gap)
        insort(ordered, gap)
        if len(held) > rule.window:
            ordered.remove(held.pop(0))
    return out, (alpha, held, last_t, last_id)


def _rows(df: DataFrame, key: str, ident: str, time: str, y: str, prediction: str) -> DataFrame:
    number = lambda c: F.col(c).cast("double")
    return df.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("id"), F.col(time).cast("timestamp").alias("t"), number(y).alias("y"), number(prediction).alias("prediction"))


def intervals(df: DataFrame, key: str, ident: str, time: str, y: str, prediction: str, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """key, id, y, prediction, low, high, alpha (before the row), late, of a stream. A micro-batch's rows of a series are taken in order of time and id; a row that isn't behind
    the last one taken is late: it gets an interval and changes nothing, so a row that is delivered twice counts once."""

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (rule.target, [], None, None)
        rows = pd.concat(list(frames)).sort_values(["t", "id"], kind="stable")
        out, now = _play(k[0], rows, now, rule)
        state.update(now)
        yield pd.DataFrame(out, columns=COLUMNS)

    return _rows(df, key, ident, time, y, prediction).groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def intervals_batch(df: DataFrame, key: str, ident: str, time: str, y: str, prediction: str, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The same over a finite table."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["t", "id"], kind="stable")
        return pd.DataFrame(_play(frame["key"].iloc[0], rows, (rule.target, [], None, None), rule)[0], columns=COLUMNS)

    return _rows(df, key, ident, time, y, prediction).groupBy("key").applyInPandas(run, OUT)


def coverage_of(rows: DataFrame) -> DataFrame:
    """key, n, hits, width: counts of finite intervals with a known y, of those that hold it, and the sum of their widths. Late rows don't count."""
    known = rows.filter("not late and y is not null and high < double('infinity')")
    return known.groupBy("key").agg(F.count("*").alias("n"), F.sum((F.col("y").between(F.col("low"), F.col("high"))).cast("long")).alias("hits"), F.sum(F.col("high") - F.col("low")).alias("width"))


def coverage_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the counts of each micro-batch, as a table under its number. Writing one again replaces it."""

    def write(rows: DataFrame, batch: int) -> None:
        coverage_of(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def coverage(spark: SparkSession, path: str, target: float) -> DataFrame:
    """key, n, coverage, gap (coverage less 1 - target), width (mean), of all micro-batches so far."""
    sums = spark.read.schema("key string, n long, hits long, width double, batch long").parquet(path).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "width")))
    share = F.col("hits") / F.col("n")
    return sums.select("key", "n", share.alias("coverage"), (share - (1 - target)).alias("gap"), (F.col("width") / F.col("n")).alias("width"))

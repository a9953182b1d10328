"""Streams: event-time windows with a watermark, latest values by key, and an online detector with state per key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

WARM_UP = 20
DECAY = 0.99


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per key and window; rows later than the watermark are dropped. Times without zone are read as UTC."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(*keys, F.window("_t", size).alias("window")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def latest(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The newest value per key so far (complete or update mode)."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def next_state(state: tuple[int, float, float], x: float) -> tuple[tuple[int, float, float], float, float]:
    """((n, mean, spread), z of x against the state before it, confidence); nothing is flagged while warming up."""
    n, mean, spread = state
    if n == 0:
        return (1, x, 0.0), 0.0, 0.0
    z = abs(x - mean) / (spread + 1e-8) if n >= WARM_UP else 0.0
    decay = min(DECAY, n / (n + 1))
    new = decay * mean + (1 - decay) * x
    return (n + 1, new, decay * spread + (1 - decay) * abs(x - new)), z, 1 - math.exp(-z)


OUT = "key string, id long, value double, z double, confidence double"
STATE = "n long, mean double, spread double"


def detect(events: DataFrame, key: str, ident: str, time: str, value: str) -> DataFrame:
    """key, id, value, z, confidence per event, from an exponential mean and deviation per key; a micro-batch is read in time order."""

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["t", "id"], kind="stable")
        out = []
        for i, x in zip(rows["id"], rows["value"], strict=True):
            if pd.isna(x):
                out.append((k[0], i, None, 0.0, 0.0))
                continue
            now, z, confidence = next_state(now, float(x))
            out.append((k[0], i, float(x), z, confidence))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["key", "id", "value", "z", "confidence"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("id"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def detect_batch(events: DataFrame, key: str, ident: str, time: str, value: str) -> DataFrame:
    """The same over a finite table: one pass per key in time order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        now, out = (0, 0.0, 0.0), []
        for k, i, x in frame.sort_values(["t", "id"], kind="stable")[["key", "id", "value"]].itertuples(index=False):
            z = confidence = 0.0
            if not pd.isna(x):
                now, z, confidence = next_state(now, float(x))
            out.append((k, i, x, z, confidence))
        return pd.DataFrame(out, columns=["key", "id", "value", "z", "confidence"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("id"), F.col(time).cast("timestamp").alias("t"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandas(run, OUT)

"""Experiment-run store and its queries: experiments, runs, params, metrics and tags as tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import dealt

#: Parts of a metric's name for which less is better.
LESS_IS_BETTER = ("loss", "error", "rmse", "mae", "mse", "mape", "nll", "perplexity", "wer", "cer")
#: Metric names preferred, in order, when a run store has several.
PREFERRED = ("val_loss", "valid_loss", "loss", "val_rmse", "rmse", "val_mae", "mae", "mse", "accuracy", "acc", "f1", "auc")


def filter_runs(runs: DataFrame, experiment: int | None = None, status: str | None = None, since: str | None = None, until: str | None = None, text: str | None = None) -> DataFrame:
    """Runs that meet every given condition; text is matched within name or run_id without regard to case."""
    if experiment is not None:
        runs = runs.filter(F.col("experiment_id") == experiment)
    if status is not None:
        runs = runs.filter(F.col("status") == status)
    if since is not None:
        runs = runs.filter(F.col("start_time") >= since)
    if until is not None:
        runs = runs.filter(F.col("start_time") <= until)
    if text is not None:
        runs = runs.filter(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("run_id"), F.lit(text.lower())))
    return runs


def duration(as_of: str | None = None) -> Column:
    """Seconds from start to end; an open run ends at as_of, or has none."""
    end = F.coalesce("end_time", F.lit(as_of).cast("timestamp_ntz")) if as_of else F.col("end_time")
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(max(1, min(500, limit)))


def overview(runs: DataFrame, as_of: str) -> DataFrame:
    status = lambda s: F.count(F.when(F.col("status") == s, 1))
    done = status("FINISHED")
    return runs.agg(F.count("*").alias("runs"), done.alias("finished"), status("FAILED").alias("failed"), status("RUNNING").alias("running"), F.countDistinct("experiment_id").alias("experiments"), F.try_divide(done.cast("double"), (done + status("FAILED")).cast("double")).alias("success_rate"), F.avg(duration(as_of)).alias("mean_seconds"))


def experiments_with_counts(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    counts = runs.groupBy("experiment_id").agg(F.count("run_id").alias("runs"), F.max("start_time").alias("last_start"))
    return experiments.join(counts, "experiment_id", "left").select("experiment_id", "name", F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), "last_start")


def metric_catalog(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.max("step").alias("last_step"))


def param_catalog(params: DataFrame) -> DataFrame:
    number = F.expr("try_cast(value as double)")
    return params.groupBy("key").agg(F.countDistinct("run_id").alias("runs"), F.count(number).alias("numeric"), F.countDistinct("value").alias("different"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The row of the last step, then time, then largest value, per run and key: a maximum with partial aggregation, no sort."""
    last = metrics.groupBy("run_id", "key").agg(F.max(F.struct("step", "timestamp", "value")).alias("m"))
    return last.select("run_id", "key", "m.value", "m.step")


def less_is_better(key: str = "key") -> Column:
    return F.lower(F.col(key)).rlike("|".join(LESS_IS_BETTER))


def best_runs(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """The best run per metric by its latest value; ties go to the smaller run_id."""
    signed = F.when(less_is_better(), F.col("value")).otherwise(-F.col("value"))
    best = latest_metrics(metrics).groupBy("key").agg(F.min(F.struct(signed.alias("s"), F.col("run_id"), F.col("value"))).alias("b"))
    return best.select("key", "b.run_id", "b.value").join(runs.select("run_id", "name", "status"), "run_id")


def primary_metric(metrics: DataFrame) -> DataFrame:
    """One row: the metric logged by most runs, then by preference, then by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED)), F.lower("key")), F.lit(0)), F.lit(len(PREFERRED) + 1))
    return metrics.groupBy("key").agg(F.countDistinct("run_id").alias("runs")).orderBy(F.desc("runs"), place, "key").limit(1)


def compare_runs(metrics: DataFrame, run_ids: list[str]) -> DataFrame:
    """key and one column of latest values per run."""
    return latest_metrics(metrics.filter(F.col("run_id").isin(run_ids))).groupBy("key").pivot("run_id", run_ids).agg(F.first("value"))


def run_maps(params: DataFrame) -> DataFrame:
    """run_id and its params as a map, in one grouped pass."""
    return params.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("params"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """table with rows put in place of those with equal keys. Of new rows with equal keys the last by the column `order` is taken, which then goes;
    without `order` keys of rows must be unique."""
    if order is not None:
        rest = [c for c in rows.columns if c not in keys and c != order]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def delete_runs(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Cascade: call for runs and for every table with a run_id. Large tables meet in as many tasks as shuffle partitions."""
    return table.join(dealt(gone.select("run_id"), "run_id"), "run_id", "left_anti")


def config_key(columns: list[str]) -> Column:
    """Canonical JSON of the columns in name order, with doubles rounded to 12 digits."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def autolog(store: str, name: str, experiment_id: int = 0):
    """Decorator: each call becomes a run of the store (Parquet tables runs, params and metrics, appended): its status, times, the
    arguments as params and, where it returns numbers by name, those as metrics."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def logged(*args, **kwargs):
            spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            run, began, status, out = uuid.uuid4().hex, datetime.now(), "FAILED", None
            try:
                out = f(*args, **kwargs)
                status = "FINISHED"
                return out
            finally:
                params = {**{f"arg{i}": a for i, a in enumerate(args)}, **kwargs}
                numbers = {k: float(v) for k, v in out.items() if isinstance(v, (int, float))} if isinstance(out, dict) else {}
                put = lambda table, rows, schema: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{store}/{table}")
                put("runs", [(run, experiment_id, name, status, began, datetime.now())], "run_id string, experiment_id long, name string, status string, start_time timestamp, end_time timestamp")
                put("params", [(run, k, str(v)[:250]) for k, v in params.items()], "run_id string, key string, value string")
                put("metrics", [(run, k, v, datetime.now(), 0) for k, v in numbers.items()], "run_id string, key string, value double, timestamp timestamp, step long")

        return logged

    return wrap

"""Forecast baselines, their evaluation and ranking over panels (unique_id, ds, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import average_rank, divide

BASELINES = ("drift", "linear", "mean", "median", "moving_average", "naive", "seasonal_naive", "ses")


def daily_panel(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """unique_id, ds, y: the daily sum per key over a gap-free calendar from the first to the last day; days without rows count 0."""
    day = F.to_date(time)
    sums = events.groupBy(F.col(key).alias("unique_id"), day.alias("ds")).agg(F.sum(value).alias("y"))
    spans = events.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = events.select(F.col(key).alias("unique_id")).distinct().join(F.broadcast(spans)).select("unique_id", F.explode(F.sequence("a", "b")).alias("ds"))  # spans: one row
    return days.join(sums, ["unique_id", "ds"], "left").select("unique_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


def folds(panel: DataFrame, horizon: int, count: int, least: int) -> DataFrame:
    """Rows with fold, part and step: fold f tests on the horizon that ends f horizons before the series does, and trains on all before it (least rows or more)."""
    w = Window.partitionBy("unique_id")
    p = panel.withColumn("i", (F.row_number().over(w.orderBy("ds")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    p = p.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("origin", F.col("n") - horizon * (F.col("fold") + 1))
    p = p.filter((F.col("origin") >= least) & (F.col("i") < F.col("origin") + horizon))
    return p.select("unique_id", "ds", "y", "i", F.col("fold").cast("long").alias("fold"), (F.col("i") - F.col("origin") + 1).alias("step"))


def forecasts(rows: DataFrame, period: int, window: int, alpha: float = 0.2) -> DataFrame:
    """unique_id, fold, step, ds, y, model, y_hat for the test rows of folds()."""
    keys = ["unique_id", "fold"]
    train = rows.filter("step <= 0")
    v, at = F.col("y"), F.col("i").cast("double")
    cov = F.coalesce(divide(F.covar_pop(at, v), F.var_pop(at)), F.lit(0.0))
    recent = F.col("step") > -window
    weight = F.when(F.col("i") == 0, F.pow(F.lit(1 - alpha), -F.col("step"))).otherwise(alpha * F.pow(F.lit(1 - alpha), -F.col("step")))
    fit = train.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("y", "i").alias("last"), F.min_by("y", "i").alias("first"), F.avg("y").alias("mean"), F.median("y").alias("median"), F.avg(F.when(recent, v)).alias("moving_average"), F.sum(v * weight).alias("ses"), cov.alias("slope"), (F.avg(v) - cov * F.avg(at)).alias("icept"))
    season = train.filter(F.col("step") > -period).select(*keys, (F.col("step") + period - 1).alias("phase"), F.col("y").alias("seasonal_naive"))
    test = rows.filter("step > 0").join(fit, keys).withColumn("phase", (F.col("step") - 1) % period).join(season, [*keys, "phase"], "left")
    drift = F.col("last") + F.col("step") * F.coalesce(divide(F.col("last") - F.col("first"), (F.col("n") - 1).cast("double")), F.lit(0.0))
    named: dict[str, Column] = {"drift": drift, "linear": F.when(F.col("n") < 3, drift).otherwise(F.col("icept") + F.col("slope") * F.col("i")), "naive": F.col("last")}
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), named.get(m, F.col(m)).alias("y_hat")) for m in BASELINES))).alias("f")
    return test.select("unique_id", "fold", "step", "ds", "y", each).select("unique_id", "fold", "step", "ds", "y", "f.model", "f.y_hat").filter("y_hat is not null")


def metrics(y: str = "y", y_hat: str = "y_hat") -> list[Column]:
    e = F.col(y_hat) - F.col(y)
    small = F.abs(F.col(y)) + F.abs(F.col(y_hat))
    return [F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.abs(e) / (F.abs(F.col(y)) + 1e-8)) * 100).alias("mape"), (F.avg(F.coalesce(divide(2 * F.abs(e), small), F.lit(0.0))) * 100).alias("smape")]


def r_squared(y: str = "y", y_hat: str = "y_hat") -> Column:
    e = F.col(y) - F.col(y_hat)
    return (1 - F.sum(e * e) / (F.count("*") * F.var_pop(y) + 1e-8)).alias("r2")


def ranked(scores: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Adds the average rank of the metric within the keys."""
    return scores.withColumn("rank", average_rank(keys, metric))

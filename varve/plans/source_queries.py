"""Generated series, inspection, splits and the online detector over finite tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate as N
from ..sources import io
from ..streaming import online
from .registry import query, rounded


@query("generate_panel", """
WITH r AS (SELECT x // 60 AS series, x % 60 AS t FROM range(0, 300) AS r(x))
SELECT series, t, (DATE '2024-01-01' + t::INTEGER)::VARCHAR AS time, round(2 + 0.5 * t, 6) AS linear, round(1 + 0.1 * t + 0.02 * t * t, 6) AS poly, round(0.5 * t + (1.5 - 0.5) * greatest(0, t - 20) + (-1 - 1.5) * greatest(0, t - 40), 6) AS piecewise,
  round(3 * sin(2 * pi() * t / 7) + 1.5 * sin(2 * (2 * pi() * t / 7)), 6) AS season FROM r""")
def generated(t):
    p = N.panel(t.spark, 5, 60).withColumn("time", F.col("time").cast("string"))
    return rounded(p.select("series", "t", "time", N.linear_trend(0.5, 2.0).alias("linear"), N.polynomial_trend(1.0, 0.1, 0.02).alias("poly"), N.piecewise_trend([20, 40], [0.5, 1.5, -1.0]).alias("piecewise"), N.seasonality(7, 3.0, 2).alias("season")))


@query("generate_noisy_with_gaps")
def noisy(t):
    p = N.panel(t.spark, 20, 200).withColumn("y", N.linear_trend(0.1) + N.seasonality(7, 2.0) + N.noise(1.0, 1))
    return rounded(p.select("series", "t", "y", N.missing_at_random(F.col("y"), 0.1, 2).alias("observed")))


@query("generate_wide", "WITH r AS (SELECT x // 24 AS s, x % 24 AS t FROM range(0, 48) AS r(x)) SELECT (DATE '2024-01-01' + t::INTEGER)::VARCHAR AS time, max(CASE WHEN s = 0 THEN 0.5::DOUBLE * t END) AS y_s0, max(CASE WHEN s = 1 THEN 0.5::DOUBLE * t + 1 END) AS y_s1 FROM r GROUP BY t")
def wide(t):
    p = N.panel(t.spark, 2, 24).withColumn("y", N.linear_trend(0.5) + F.col("series"))
    return N.wide(p, [0, 1]).withColumn("time", F.col("time").cast("string"))


@query("search_hyperband", "SELECT s AS bracket, i AS round, floor(ceil(5 / (s + 1) * pow(3, s)) / pow(3, i))::BIGINT AS configs, 81 / pow(3, s - i) AS budget FROM range(0, 5) AS a(s), range(0, 5) AS b(i) WHERE i <= s")
def hyperband(t):
    return t.spark.createDataFrame([(r["bracket"], r["round"], r["configs"], r["budget"]) for r in N.hyperband(81, 3)], "bracket long, round long, configs long, budget double")


@query("source_inspect", """
SELECT 'o_orderkey' AS column, count(*) AS rows, 0::BIGINT AS missing, count(*) AS numeric, 0::BIGINT AS dates, 'numeric' AS role FROM orders UNION ALL SELECT 'o_orderdate', count(*), 0, 0, count(*), 'time' FROM orders UNION ALL SELECT 'o_orderpriority', count(*), 0, 0, 0, 'text' FROM orders""")
def inspect(t):
    return io.inspect(t.orders.select(*(F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderdate", "o_orderpriority"))))


@query("source_split_xy", "SELECT l_quantity::FLOAT::DOUBLE AS x0, l_discount::FLOAT::DOUBLE AS x1, l_tax::FLOAT::DOUBLE AS y, count(*) AS n FROM lineitem GROUP BY ALL")
def split_xy(t):
    xy = io.split_xy(t.lineitem.select("l_quantity", "l_discount", "l_tax"))
    return xy.groupBy(F.col("x")[0].cast("double").alias("x0"), F.col("x")[1].cast("double").alias("x1"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n"))


@query("stream_online_detector")
def online_detector(t):
    return rounded(online.detect_batch(t.events, "user_id", "event_id", "ts", "value"))

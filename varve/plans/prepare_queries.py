"""Preparation rules, selection and model-backed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators import select as C
from ..operators import series as S
from ..operators.mining import pearson
from .registry import EV, query, rounded

I = S.Series(("user_id",), ("i",))  # noqa: E741
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("prepare_coerce_numeric", "SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE (event_id * 0.5)::VARCHAR END AS DOUBLE) AS v FROM events")
def coerce(t):
    text = F.when(F.col("event_id") % 4 == 0, "x").otherwise((F.col("event_id") * 0.5).cast("string"))
    return P.coerce_numeric(t.events.select("event_id", text.alias("v")), ["v"])


@query("prepare_drop_constant", "SELECT o_orderkey, o_totalprice FROM orders")
def constant(t):
    return P.drop_constant(t.orders.select("o_orderkey", "o_totalprice", F.lit(3.0).alias("same")), ["o_totalprice", "same"])


@query("prepare_drop_null_rows", EV + " SELECT event_id, vm FROM ev WHERE vm IS NOT NULL")
def null_rows(t):
    return t.ev.select("event_id", "vm").na.drop()


@query("prepare_enforce_schema", "WITH m AS (SELECT median(CASE WHEN event_id % 10 <> 3 THEN value END) AS m FROM events) SELECT round(coalesce(CASE WHEN event_id % 10 <> 3 THEN value END, m), 6) AS vm, 0.0::DOUBLE AS absent, count(*) AS n FROM events, m GROUP BY ALL")
def enforce(t):
    df = t.ev.select("vm")
    medians = P.fit_medians(df, ["vm"]) | {"absent": None}
    return rounded(P.enforce_schema(df, medians)).groupBy("vm", "absent").agg(F.count("*").alias("n"))


@query("prepare_imputation_plan", EV + """,
g AS (SELECT user_id, vm, sum(CASE WHEN vm IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS island FROM ev),
l AS (SELECT user_id, max(k)::BIGINT AS gap FROM (SELECT user_id, island, sum(CASE WHEN vm IS NULL THEN 1 ELSE 0 END) AS k FROM g GROUP BY ALL) GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n, 1 - count(vm) / count(*) AS rate FROM ev GROUP BY user_id)
SELECT user_id, n, round(rate, 6) AS rate, gap, CASE WHEN rate = 0 THEN 'none' WHEN rate >= 0.5 THEN 'mean' WHEN rate <= 0.05::DOUBLE AND gap <= 2 THEN 'ffill' WHEN gap <= 12 THEN 'interpolate' ELSE 'hybrid' END AS method FROM b JOIN l USING (user_id)""")
def plan(t):
    return rounded(P.imputation_plan(t.ev, I, "vm"))


@query("prepare_calibrated_threshold", EV + """,
m AS (SELECT user_id, median(value) AS m FROM ev GROUP BY user_id), d AS (SELECT user_id, median(abs(value - m)) AS d, max(m) AS m FROM ev JOIN m USING (user_id) GROUP BY user_id),
q AS (SELECT user_id, quantile_cont(coalesce(0.6745::DOUBLE * abs(value - m) / nullif(d, 0), 0), 0.99) AS q FROM ev JOIN d USING (user_id) GROUP BY user_id)
SELECT user_id, round(least(8, greatest(2.5, 0.5::DOUBLE * 3.5 + 0.5::DOUBLE * q)), 6) AS threshold FROM q""")
def threshold(t):
    return rounded(P.calibrated_threshold(t.ev, ["user_id"], "value", 3.5))


@query("prepare_lag_alignment", EV + """,
x AS (SELECT user_id, i, value AS y, (event_id % 17)::DOUBLE AS c FROM ev), l AS (SELECT unnest([0, 1, 5]) AS lag),
p AS (SELECT a.user_id, lag, a.y, b.c FROM l CROSS JOIN x a JOIN x b ON b.user_id = a.user_id AND b.i = a.i - lag)
SELECT user_id, lag::BIGINT AS lag, round(coalesce(covar_pop(c, y) / nullif(stddev_pop(c) * stddev_pop(y), 0), 0), 6) AS corr FROM p GROUP BY ALL""")
def lags(t):
    return rounded(P.lag_aligned(t.ev.withColumn("c", (F.col("event_id") % 17).cast("double")), I, "value", "c", [0, 1, 5]))


@query("set_intersect_except", "SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'first', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def sets(t):
    a, b = (t.orders.filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    return a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(a.subtract(b).agg(F.lit("first").alias("part"), F.count("*").alias("n")))


@query("select_top_candidates", "SELECT p_brand, max(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand ORDER BY 2 DESC, 1 LIMIT 10")
def candidates(t):
    return C.top_candidates(t.part, "p_brand", "p_retailprice", 10)


@query("select_good_and_bad", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) <= greatest(1, ceil(count(*) OVER (PARTITION BY p_brand) * 0.15::DOUBLE)) AS good FROM part")
def good_bad(t):
    return C.good_and_bad(t.part, "p_brand", "p_retailprice", "p_partkey", 0.15).select("p_partkey", "good")


@query("select_eta_squared", "WITH g AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS mm FROM g), s AS (SELECT sum(n * pow(m - mm, 2)) AS b, sum(n * v) AS w FROM g, t) SELECT round(b / (b + w), 6) AS eta2 FROM s")
def eta(t):
    return rounded(C.eta_squared(t.part, "p_brand", "p_retailprice"))


def flagged(t):
    return t.lineitem.select("l_orderkey", *COLS, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_returnflag") == "R").cast("double").alias("y"))


@query("select_redundancy")
def redundancy(t):
    d = flagged(t)
    kept = C.redundancy_pruned(pearson(d, [*COLS, "net"]), [*COLS, "net"], 0.9)
    return t.spark.createDataFrame([(c, i) for i, c in enumerate(kept)], "feature string, place long")


@query("select_mrmr")
def mrmr(t):
    return t.spark.createDataFrame([(c, i) for i, c in enumerate(C.mrmr(flagged(t), COLS, "net", 3))], "feature string, place long")


@query("select_forest_importance")
def forest(t):
    return t.spark.createDataFrame(list(C.importance(flagged(t), [*COLS, "net"], "y").items()), "feature string, importance double")


@query("cluster_kmeans")
def kmeans(t):
    return C.clusters(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 4).select("p_partkey", F.col("cluster").cast("long").alias("cluster"))


@query("dimension_pca")
def pca(t):
    return rounded(C.principal_components(flagged(t), [*COLS, "net"], 2).select("l_orderkey", "pc1", "pc2"))


@query("anomaly_isotonic_calibration")
def calibrate(t):
    return rounded(C.isotonic(t.events.select("event_id", "value", (F.col("event_type") == "error").cast("double").alias("y")), "value", "y").select("event_id", "calibrated"))

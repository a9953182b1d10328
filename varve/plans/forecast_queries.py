"""Backtests, conformal intervals and anomaly scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import backtest as B
from ..operators import conformal as C
from .registry import EV, query, rounded

PANEL = """WITH s AS (SELECT event_type AS unique_id, ts::DATE AS ds, sum(value) AS y FROM events GROUP BY ALL),
r AS (SELECT min(ts::DATE) AS a, max(ts::DATE) AS b FROM events),
d AS (SELECT DISTINCT event_type AS unique_id, (a + x.k::INTEGER)::DATE AS ds FROM events, r, unnest(range(0, date_diff('day', a, b) + 1)) AS x(k)),
panel AS (SELECT d.unique_id, d.ds, coalesce(y, 0.0::DOUBLE) AS y FROM d LEFT JOIN s USING (unique_id, ds)),
p AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM panel),
f AS (SELECT unique_id, ds, y, i, k.fold, i - (n - 4 * (k.fold + 1)) + 1 AS step FROM p, unnest(range(0, 3)) AS k(fold) WHERE n - 4 * (k.fold + 1) >= 10 AND i < n - 4 * (k.fold + 1) + 4),
fit AS (SELECT unique_id, fold, count(*) AS n, max_by(y, i) AS last, min_by(y, i) AS first, avg(y) AS mean, median(y) AS median, avg(CASE WHEN step > -5 THEN y END) AS ma,
  sum(y * (CASE WHEN i = 0 THEN pow(0.8::DOUBLE, -step) ELSE 0.2::DOUBLE * pow(0.8::DOUBLE, -step) END)) AS ses, regr_slope(y, i) AS slope, regr_intercept(y, i) AS icept FROM f WHERE step <= 0 GROUP BY ALL),
t AS (SELECT f.*, fit.* EXCLUDE (unique_id, fold), g.y AS seasonal FROM f JOIN fit ON f.unique_id = fit.unique_id AND f.fold = fit.fold
  LEFT JOIN f g ON g.unique_id = f.unique_id AND g.fold = f.fold AND g.step <= 0 AND g.step = (f.step - 1) % 7 - 6 WHERE f.step > 0),
fc AS (SELECT unique_id, fold, step, ds, y, m.model, CASE m.model WHEN 'drift' THEN last + step * (last - first) / (n - 1) WHEN 'linear' THEN icept + slope * i WHEN 'mean' THEN mean WHEN 'median' THEN median WHEN 'moving_average' THEN ma WHEN 'naive' THEN last WHEN 'seasonal_naive' THEN seasonal WHEN 'ses' THEN ses END AS y_hat
  FROM t, unnest(['drift', 'linear', 'mean', 'median', 'moving_average', 'naive', 'seasonal_naive', 'ses']) AS m(model))"""


def panel(t):
    return B.daily_panel(t.events, "event_type", "ts", "value")


def backtest(t):
    return B.forecasts(B.folds(panel(t), 4, 3, 10), 7, 5)


@query("backtest_flagship", PANEL + """,
m AS (SELECT unique_id, model, count(*) AS n, avg((y_hat - y) * (y_hat - y)) AS mse, sqrt(avg((y_hat - y) * (y_hat - y))) AS rmse, avg(abs(y_hat - y)) AS mae, avg(abs(y_hat - y) / (abs(y) + 1e-8::DOUBLE)) * 100 AS mape,
  avg(coalesce(2 * abs(y_hat - y) / nullif(abs(y) + abs(y_hat), 0), 0)) * 100 AS smape FROM fc WHERE y_hat IS NOT NULL GROUP BY ALL)
SELECT unique_id, model, n, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape, round(smape, 4) AS smape,
  rank() OVER (PARTITION BY unique_id ORDER BY round(mse, 4)) + (count(*) OVER (PARTITION BY unique_id, round(mse, 4)) - 1) / 2 AS rank FROM m""")
def flagship(t):
    scores = rounded(backtest(t).groupBy("unique_id", "model").agg(*B.metrics()), 4)
    return B.ranked(scores, ["unique_id"], "mse")


@query("backtest_daily_panel", PANEL + " SELECT unique_id, ds::VARCHAR AS ds, round(y, 4) AS y FROM panel")
def daily(t):
    return rounded(panel(t).withColumn("ds", F.col("ds").cast("string")), 4)


@query("backtest_per_fold_metrics", PANEL + """
SELECT unique_id, fold, model, round(sqrt(avg((y_hat - y) * (y_hat - y))), 4) AS rmse, round(avg(abs(y_hat - y)), 4) AS mae FROM fc WHERE y_hat IS NOT NULL GROUP BY ALL""")
def per_fold(t):
    return rounded(backtest(t).groupBy("unique_id", "fold", "model").agg(*B.metrics()).select("unique_id", "fold", "model", "rmse", "mae"), 4)


@query("backtest_r_squared", PANEL + """
SELECT model, count(*) AS n, round(1 - sum((y - y_hat) * (y - y_hat)) / (count(*) * var_pop(y) + 1e-8::DOUBLE), 6) AS r2 FROM fc WHERE y_hat IS NOT NULL GROUP BY model""")
def r2(t):
    return rounded(backtest(t).groupBy("model").agg(F.count("*").alias("n"), B.r_squared()))


@query("backtest_mean_ranks", PANEL + """,
m AS (SELECT unique_id, fold, model, round(sqrt(avg((y_hat - y) * (y_hat - y))), 4) AS rmse FROM fc WHERE y_hat IS NOT NULL GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY unique_id, fold ORDER BY rmse) + (count(*) OVER (PARTITION BY unique_id, fold, rmse) - 1) / 2 AS rank FROM m)
SELECT model, count(*) AS n, round(avg(rank), 6) AS mean_rank, count(CASE WHEN rank = 1 THEN 1 END) AS wins FROM k GROUP BY model""")
def mean_ranks(t):
    scores = rounded(backtest(t).groupBy("unique_id", "fold", "model").agg(F.sqrt(F.avg((F.col("y_hat") - F.col("y")) ** 2)).alias("rmse")), 4)
    return rounded(B.ranked(scores, ["unique_id", "fold"], "rmse").groupBy("model").agg(F.count("*").alias("n"), F.avg("rank").alias("mean_rank"), F.count(F.when(F.col("rank") == 1, 1)).alias("wins")))


RADII = """,
a AS (SELECT event_type, event_id % 4 AS h, event_id % 10 < 6 AS cal, value AS y, avg(CASE WHEN event_id % 10 < 6 THEN value END) OVER (PARTITION BY event_type) AS y_hat, event_id FROM ev),
s AS (SELECT event_type, h, abs(y - y_hat) AS s, row_number() OVER (PARTITION BY event_type, h ORDER BY abs(y - y_hat)) AS r, count(*) OVER (PARTITION BY event_type, h) AS n FROM a WHERE cal),
q AS (SELECT event_type, h, n, s AS radius FROM s WHERE r = least(n, ceil((n + 1) * 0.9::DOUBLE)))"""


def residuals(t):
    from pyspark.sql.window import Window

    cal = F.col("event_id") % 10 < 6
    a = t.events.select("event_id", "event_type", (F.col("event_id") % 4).alias("h"), cal.alias("cal"), F.col("value").alias("y"))
    return a.withColumn("y_hat", F.avg(F.when(F.col("cal"), F.col("y"))).over(Window.partitionBy("event_type")))


@query("conformal_split_radii", EV + RADII + " SELECT event_type, h, n, round(radius, 6) AS radius FROM q")
def radii(t):
    return rounded(C.conformal_radius(residuals(t).filter("cal").withColumn("s", F.abs(F.col("y") - F.col("y_hat"))), ["event_type", "h"], "s", 0.1))


@query("conformal_coverage", EV + RADII + """,
c AS (SELECT a.event_type, a.h, y, y_hat - radius AS low, y_hat + radius AS high FROM a JOIN q USING (event_type, h) WHERE NOT cal)
SELECT event_type, h, count(*) AS n, round(avg(CASE WHEN y BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS covered, min(CASE WHEN y BETWEEN low AND high THEN 1.0 ELSE 0.0 END)::DOUBLE AS joint, round(avg(high - low), 6) AS width, round(min(high - low), 6) AS narrowest, round(max(high - low), 6) AS widest FROM c GROUP BY ALL""")
def conformal_coverage(t):
    r = residuals(t)
    q = C.conformal_radius(r.filter("cal").withColumn("s", F.abs(F.col("y") - F.col("y_hat"))), ["event_type", "h"], "s", 0.1)
    c = r.filter("not cal").join(q, ["event_type", "h"]).withColumn("low", F.col("y_hat") - F.col("radius")).withColumn("high", F.col("y_hat") + F.col("radius"))
    return rounded(C.coverage(c, ["event_type", "h"]))


@query("conformal_cqr", EV + """,
b AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM ev GROUP BY event_type),
s AS (SELECT event_type, greatest(lo - value, value - hi) AS s FROM ev JOIN b USING (event_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM s)
SELECT event_type, n, round(s, 6) AS radius FROM r WHERE k = least(n, ceil((n + 1) * 0.9::DOUBLE))""")
def cqr(t):
    b = t.events.groupBy("event_type").agg(F.percentile("value", F.lit(0.1)).alias("lo"), F.percentile("value", F.lit(0.9)).alias("hi"))
    s = t.events.join(b, "event_type").withColumn("s", C.cqr_score(F.col("value"), F.col("lo"), F.col("hi")))
    return rounded(C.conformal_radius(s, ["event_type"], "s", 0.1))


@query("conformal_weighted_quantile", EV + """,
w AS (SELECT user_id, value, pow(0.95::DOUBLE, count(*) OVER (PARTITION BY user_id) - 1 - i) AS w FROM ev),
m AS (SELECT user_id, value, (sum(w) OVER (PARTITION BY user_id ORDER BY value, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w / 2) / sum(w) OVER (PARTITION BY user_id) AS m FROM w)
SELECT user_id, coalesce(min(CASE WHEN m >= 0.9::DOUBLE THEN value END), max(value)) AS quantile FROM m GROUP BY user_id""")
def weighted(t):
    from pyspark.sql.window import Window

    w = t.ev.withColumn("w", F.pow(F.lit(0.95), F.count("*").over(Window.partitionBy("user_id")) - 1 - F.col("i")))
    return C.weighted_quantile(w, ["user_id"], "value", "w", 0.9)


@query("conformal_adaptive_alpha", EV + """
SELECT user_id, count(*) AS n, round(list_reduce(list_prepend(0.1::DOUBLE, list((value > 60)::INT::DOUBLE ORDER BY i)), lambda a, m: least(0.99::DOUBLE, greatest(0.01::DOUBLE, a + 0.05::DOUBLE * (0.1::DOUBLE - m)))), 6) AS alpha FROM ev GROUP BY user_id""")
def adaptive(t):
    return rounded(C.adaptive_alpha(t.ev.withColumn("miss", F.col("value") > 60), ["user_id"], ["i"], "miss", 0.1, 0.05))


@query("anomaly_z_score", EV + """
SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-8::DOUBLE), 6) AS z, abs((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-8::DOUBLE)) > 2.5 AS outlier FROM ev""")
def z_score(t):
    return rounded(A.z_scores(t.ev, ["user_id"], "value").select("event_id", "z", (F.abs("z") > 2.5).alias("outlier")))


@query("anomaly_iqr", EV + """,
b AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM ev GROUP BY user_id)
SELECT event_id, value < a - 1.5::DOUBLE * (b - a + 1e-8::DOUBLE) OR value > b + 1.5::DOUBLE * (b - a + 1e-8::DOUBLE) AS outlier FROM ev JOIN b USING (user_id)""")
def iqr(t):
    return A.iqr_outliers(t.ev, ["user_id"], "value", 1.5).select("event_id", "outlier")


@query("anomaly_mad", EV + """,
m AS (SELECT user_id, median(value) AS med FROM ev GROUP BY user_id),
d AS (SELECT user_id, median(abs(value - med)) AS mad FROM ev JOIN m USING (user_id) GROUP BY user_id),
z AS (SELECT user_id, event_id, value, coalesce(0.6745::DOUBLE * abs(value - med) / nullif(mad, 0), 0) AS z FROM ev JOIN m USING (user_id) JOIN d USING (user_id)),
w AS (SELECT user_id, stddev_pop(z) AS w, count(value) AS n FROM z GROUP BY user_id)
SELECT event_id, round(z, 6) AS modified_z, n >= 5 AND z > 3.5::DOUBLE + CASE WHEN w > 3.5 THEN 0.5 ELSE 0 END AS outlier FROM z JOIN w USING (user_id)""")
def mad(t):
    return rounded(A.mad_outliers(t.ev, ["user_id"], "value", 3.5).select("event_id", "modified_z", "outlier"))


@query("anomaly_quantile", EV + """,
b AS (SELECT user_id, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM ev GROUP BY user_id)
SELECT event_id, value < a OR value > b AS outlier FROM ev JOIN b USING (user_id)""")
def quantiles(t):
    return A.quantile_outliers(t.ev, ["user_id"], "value", 0.02).select("event_id", "outlier")


@query("anomaly_hbos", EV + """,
a AS (SELECT event_id, event_type, value, count(*) OVER w AS n, min(value) OVER w AS lo, max(value) OVER w AS hi, least(50, greatest(10, floor(sqrt(count(*) OVER w)))) AS k FROM ev WINDOW w AS (PARTITION BY event_type)),
b AS (SELECT *, least(coalesce(floor((value - lo) * k / nullif(hi - lo, 0)), 0), k - 1) AS bin FROM a)
SELECT event_id, round(-ln(coalesce(count(*) OVER (PARTITION BY event_type, bin) / nullif(n * ((hi - lo) / k), 0), 1) + 1e-12::DOUBLE), 6) AS score FROM b""")
def hbos(t):
    return rounded(A.hbos(t.ev, ["event_type"], "value").select("event_id", "score"))


@query("anomaly_ecod", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_extendedprice AS b, l_orderkey * 1000000 + l_partkey AS id, l_suppkey % 50 AS g FROM lineitem),
r AS (SELECT id, g, a, b, count(*) OVER (PARTITION BY g) + 1 AS n, row_number() OVER (PARTITION BY g ORDER BY a, id) AS ua, row_number() OVER (PARTITION BY g ORDER BY a DESC, id) AS da, row_number() OVER (PARTITION BY g ORDER BY b, id) AS ub, row_number() OVER (PARTITION BY g ORDER BY b DESC, id) AS db FROM (SELECT DISTINCT ON (id) * FROM b ORDER BY id, a, b)),
k AS (SELECT g, avg(pow(a - m, 3)) AS sa, avg(pow(b - o, 3)) AS sb FROM (SELECT *, avg(a) OVER (PARTITION BY g) AS m, avg(b) OVER (PARTITION BY g) AS o FROM r) GROUP BY g)
SELECT id, round(greatest(-ln(ua / n) - ln(ub / n), -ln(da / n) - ln(db / n), CASE WHEN sa < 0 THEN -ln(ua / n) ELSE -ln(da / n) END + CASE WHEN sb < 0 THEN -ln(ub / n) ELSE -ln(db / n) END), 6) AS score FROM r JOIN k USING (g)""")
def ecod(t):
    b = t.lineitem.select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("id"), (F.col("l_suppkey") % 50).alias("g"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    first = b.groupBy("id").agg(F.min(F.struct("a", "b", "g")).alias("x")).select("id", "x.g", "x.a", "x.b")
    return rounded(A.ecod(first, ["g"], ["a", "b"], "id").select("id", "score"))


@query("anomaly_ecod_all", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, l_quantity AS a, l_extendedprice AS b, count(*) OVER g + 1 AS n, row_number() OVER (g ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ua,
  row_number() OVER (g ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS da, row_number() OVER (g ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_quantity) AS ub,
  row_number() OVER (g ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS db FROM lineitem WINDOW g AS (PARTITION BY l_suppkey)),
k AS (SELECT g, avg(pow(a - m, 3)) AS sa, avg(pow(b - o, 3)) AS sb FROM (SELECT *, avg(a) OVER (PARTITION BY g) AS m, avg(b) OVER (PARTITION BY g) AS o FROM r) GROUP BY g)
SELECT l_orderkey, l_linenumber, round(greatest(-ln(ua / n) - ln(ub / n), -ln(da / n) - ln(db / n), CASE WHEN sa < 0 THEN -ln(ua / n) ELSE -ln(da / n) END + CASE WHEN sb < 0 THEN -ln(ub / n) ELSE -ln(db / n) END), 6) AS score FROM r JOIN k USING (g)""")
def ecod_all(t):
    """Every row, by supplier; only rows that are equal in all columns read tie."""
    b = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("tie"))
    return rounded(A.ecod(b, ["l_suppkey"], ["a", "b"], "tie").select("l_orderkey", "l_linenumber", "score"))


THRESHOLD = EV + """,
b AS (SELECT event_type, median(value) AS m, quantile_cont(value, 0.95) AS q FROM ev GROUP BY event_type),
d AS (SELECT event_type, median(abs(value - m)) AS d, max(m) AS m, max(q) AS q FROM ev JOIN b USING (event_type) GROUP BY event_type),
th AS (SELECT event_type, CASE WHEN d <= 1e-8 THEN q ELSE greatest(q, m + 3 * 1.4826::DOUBLE * d) END AS threshold FROM d)"""


@query("anomaly_robust_threshold", THRESHOLD + " SELECT event_type, round(threshold, 6) AS threshold FROM th")
def threshold(t):
    return rounded(A.robust_threshold(t.events, ["event_type"], "value", 0.05, 3.0))


@query("anomaly_probability", THRESHOLD + """
SELECT event_id, round(1 / (1 + exp(-(0.5::DOUBLE * (value - threshold)))), 6) AS p, round(2 * abs(1 / (1 + exp(-(0.5::DOUBLE * (value - threshold)))) - 0.5::DOUBLE), 6) AS confidence FROM ev JOIN th USING (event_type)""")
def probability(t):
    p, c = A.probability(F.col("value"), F.col("threshold"))
    return rounded(t.events.join(A.robust_threshold(t.events, ["event_type"], "value", 0.05, 3.0), "event_type").select("event_id", p.alias("p"), c.alias("confidence")))


@query("anomaly_votes", """
SELECT event_id, CASE WHEN a + b + c > 1.5 THEN 1 ELSE 0 END::BIGINT AS majority, greatest(a, b, c)::BIGINT AS any_one, least(a, b, c)::BIGINT AS every, CASE WHEN 2 * a + b + 0.5 * c > 1.75 THEN 1 ELSE 0 END::BIGINT AS weighted
FROM (SELECT event_id, (value > 50)::INT AS a, (event_id % 3 = 0)::INT AS b, (user_id % 2 = 0)::INT AS c FROM events)""")
def votes(t):
    x = [(F.col("value") > 50).cast("int"), (F.col("event_id") % 3 == 0).cast("int"), (F.col("user_id") % 2 == 0).cast("int")]
    return rounded(t.events.select("event_id", A.vote(*x).alias("majority"), A.vote(*x, rule="any").alias("any_one"), A.vote(*x, rule="all").alias("every"), A.vote(*x, rule="weighted", weights=[2.0, 1.0, 0.5]).alias("weighted")))


@query("anomaly_combined_scores", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((2 * coalesce((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0), 0) + coalesce((l_discount - avg(l_discount) OVER w) / nullif(stddev_pop(l_discount) OVER w, 0), 0)) / 3, 5) AS combined FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def combined(t):
    return rounded(A.combine(t.lineitem, ["l_quantity", "l_discount"], [2.0, 1.0], ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "combined"), 5)


@query("anomaly_roc_j", """
WITH q AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS q),
c AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS q, unnest(quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95])) AS threshold FROM events)
SELECT q, round(threshold, 6) AS threshold, round(avg(CASE WHEN event_type = 'error' THEN (value > threshold)::INT END), 6) AS tpr, round(avg(CASE WHEN event_type <> 'error' THEN (value > threshold)::INT END), 6) AS fpr,
  round(avg(CASE WHEN event_type = 'error' THEN (value > threshold)::INT END) - avg(CASE WHEN event_type <> 'error' THEN (value > threshold)::INT END), 6) AS j FROM events, c GROUP BY q, threshold""")
def roc(t):
    return rounded(A.roc_j(t.events.withColumn("label", F.col("event_type") == "error"), "value", "label", [0.05, 0.25, 0.5, 0.75, 0.95]))


@query("anomaly_rank_fusion", EV + """
SELECT event_id, round(1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)) + 1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id)), 8) AS fused FROM ev""")
def fusion(t):
    return rounded(A.reciprocal_rank_fusion(t.events, ["event_type"], ["value", "user_id"], "event_id").select("event_id", "fused"), 8)


@query("anomaly_ema", EV.replace("WITH ev", "WITH RECURSIVE ev") + """,
r AS (SELECT user_id, i, value AS ema FROM ev WHERE i = 0 UNION ALL SELECT ev.user_id, ev.i, 0.9::DOUBLE * r.ema + 0.1::DOUBLE * ev.value FROM r JOIN ev ON ev.user_id = r.user_id AND ev.i = r.i + 1)
SELECT user_id, max(i) + 1 AS n, round(max_by(ema, i), 6) AS ema FROM r GROUP BY user_id""")
def ema(t):
    return rounded(A.ema_states(t.ev, ["user_id"], ["i"], "value", 0.9))

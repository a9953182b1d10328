"""Ordered-series queries over events: one series per user, in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import series as S
from .registry import EV, query, rounded

U = S.Series(("user_id",), ("ts", "event_id"))
I = S.Series(("user_id",), ("i",))  # noqa: E741


@query("series_sliding_windows", EV + """
SELECT user_id, i AS start, round(list_sum(x), 6) AS x_sum, x[1] AS x_first, x[4] AS x_last, round(list_sum(y), 6) AS y_sum, len(y) AS horizon FROM (
  SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS t,
    list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x,
    list(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 FOLLOWING AND 5 FOLLOWING) AS y FROM ev)
WHERE i <= t - 6""")
def sliding_windows(t):
    w = S.sliding_windows(t.ev, I, ["value"], ["value"], 4, 2)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, r: a + r[0])
    return rounded(w.select("user_id", "start", total("x").alias("x_sum"), F.col("x")[0][0].alias("x_first"), F.col("x")[3][0].alias("x_last"), total("y").alias("y_sum"), F.size("y").alias("horizon")))


@query("series_strided_windows_overlap_mean", EV + """,
w AS (SELECT user_id, i AS start, list(coalesce(vm, 0.0)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x, count(*) OVER (PARTITION BY user_id) AS t FROM ev),
k AS (SELECT * FROM w WHERE start <= t - 8 AND start % 4 = 0),
p AS (SELECT user_id, start + r.g AS i, x[r.g + 1] AS v FROM k, unnest(range(0, 8)) AS r(g))
SELECT user_id, i, round(avg(v), 6) AS v, count(*) AS covered FROM p GROUP BY ALL""")
def strided_windows(t):
    return rounded(S.overlap_mean(S.strided_windows(t.ev, I, "vm", 8, 4), I))


@query("series_window_scores_to_points", EV + """
SELECT user_id, i, round(lag(value, 4) OVER w, 6) AS at_end, round(lag(value, 2) OVER w, 6) AS at_centre,
  round(max(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS highest,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def window_scores(t):
    point = lambda *a: S.window_to_point(I, "value", 5, *a)
    return rounded(t.ev.select("user_id", "i", point("end").alias("at_end"), point("center").alias("at_centre"), point("all", "max").alias("highest"), point("all", "mean").alias("average")))


@query("series_moving_average", EV + """
SELECT user_id, i, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS ma FROM ev""")
def moving_average(t):
    return rounded(t.ev.select("user_id", "i", S.centred_average(I, "value", 5).alias("ma")))


@query("series_rolling_std", EV + """
SELECT user_id, i, round(CASE WHEN count(vm) OVER w = 6 THEN stddev_samp(vm) OVER w END, 6) AS std FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def rolling_std(t):
    return rounded(t.ev.select("user_id", "i", S.rolling_std(I, "vm", 6).alias("std")))


@query("series_first_difference", EV + """
SELECT user_id, i, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY i), 0), 6) AS diff FROM ev""")
def first_difference(t):
    return rounded(t.ev.select("user_id", "i", S.first_difference(I, "value").alias("diff")))


@query("series_seasonal_difference", EV + """,
a AS (SELECT user_id, i, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS d FROM ev)
SELECT user_id, i, round(diff, 6) AS diff FROM (SELECT user_id, i, d - lag(d, 7) OVER (PARTITION BY user_id ORDER BY i) AS diff FROM a) WHERE i >= 8""")
def seasonal_difference(t):
    return rounded(S.seasonal_difference(t.ev, I, "value", 1, 1, 7).select("user_id", "i", "diff"))


@query("series_inverse_difference", EV + """
SELECT user_id, i, round(value, 4) AS level FROM ev""")
def inverse_difference(t):
    d = t.ev.withColumn("d", S.first_difference(I, "value")).withColumn("v0", F.first("value").over(I.past))
    return rounded(d.select("user_id", "i", S.inverse_difference(I, "d", F.col("v0")).alias("level")), 4)


@query("series_pct_change", EV + """
SELECT user_id, i, round(value / nullif(lag(value) OVER (PARTITION BY user_id ORDER BY i), 0) - 1, 6) AS change FROM ev""")
def pct_change(t):
    return rounded(t.ev.select("user_id", "i", S.pct_change(I, "value").alias("change")))


@query("series_cusum_break", EV + """,
c AS (SELECT user_id, i, avg(value) OVER (PARTITION BY user_id) AS m, stddev_pop(value) OVER (PARTITION BY user_id) AS s, count(*) OVER (PARTITION BY user_id) AS n, value FROM ev),
d AS (SELECT user_id, i, s, n, abs(sum(value - m) OVER (PARTITION BY user_id ORDER BY i)) AS c FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(c, 6) DESC, i) AS k, max(c) OVER (PARTITION BY user_id) AS top FROM d)
SELECT user_id, round(coalesce(top / nullif(s * sqrt(n), 0), 0), 6) AS cusum, i AS at, coalesce(top / nullif(s * sqrt(n), 0), 0) > 1.5 AS is_break FROM r WHERE k = 1""")
def cusum(t):
    return rounded(S.cusum(t.ev, I, "value"))


@query("series_drawdown", EV + """
SELECT user_id, round(min(d), 6) AS max_drawdown FROM (SELECT user_id, value / nullif(max(value) OVER (PARTITION BY user_id ORDER BY i), 0) - 1 AS d FROM ev) GROUP BY user_id""")
def drawdown(t):
    return rounded(t.ev.select("user_id", S.drawdown(I, "value").alias("d")).groupBy("user_id").agg(F.min("d").alias("max_drawdown")))


@query("series_fill_forward_back", EV + """
SELECT user_id, i, coalesce(last_value(vm IGNORE NULLS) OVER p, first_value(vm IGNORE NULLS) OVER f, 0.0) AS ffilled, coalesce(first_value(vm IGNORE NULLS) OVER f, last_value(vm IGNORE NULLS) OVER p, 0.0) AS bfilled FROM ev
WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fills(t):
    back = F.coalesce(S.fill_back(I, "vm"), S.fill_forward(I, "vm"), F.lit(0.0))
    return t.ev.select("user_id", "i", S.fill_both(I, "vm", F.lit(0.0)).alias("ffilled"), back.alias("bfilled"))


INTERPOLATED = """,
n AS (SELECT user_id, i, value, vm, last_value(vm IGNORE NULLS) OVER p AS v0, first_value(vm IGNORE NULLS) OVER f AS v1,
  last_value(CASE WHEN vm IS NOT NULL THEN i END IGNORE NULLS) OVER p AS i0, first_value(CASE WHEN vm IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1 FROM ev
  WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT user_id, i, value, vm, coalesce(vm, v0 + (v1 - v0) * ((i - i0)::DOUBLE / nullif(i1 - i0, 0)), v0, v1) AS filled FROM n)"""


@query("series_interpolate", EV + INTERPOLATED + " SELECT user_id, i, round(filled, 6) AS filled FROM h")
def interpolate(t):
    return rounded(S.interpolate(t.ev, I, "vm", "filled").select("user_id", "i", "filled"))


@query("series_lag_and_mean_fill", EV + """
SELECT user_id, i, coalesce(vm, lag(vm, 24) OVER (PARTITION BY user_id ORDER BY i)) AS lagged, round(coalesce(vm, avg(vm) OVER (PARTITION BY user_id), 0), 6) AS mean_filled FROM ev""")
def lag_mean(t):
    return t.ev.select("user_id", "i", S.lag_fill(I, "vm", 24).alias("lagged"), F.round(S.mean_fill(I, "vm"), 6).alias("mean_filled"))


@query("series_hybrid_fill", EV + INTERPOLATED + """,
g AS (SELECT user_id, i, coalesce(filled, lag(filled, 24) OVER (PARTITION BY user_id ORDER BY i)) AS g FROM h)
SELECT user_id, i, round(coalesce(g, avg(g) OVER (PARTITION BY user_id), 0), 6) AS filled FROM g""")
def hybrid(t):
    return rounded(S.hybrid_fill(t.ev, I, "vm", "filled").select("user_id", "i", "filled"))


@query("series_longest_gap", EV + """,
g AS (SELECT user_id, vm, sum(CASE WHEN vm IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS island FROM ev)
SELECT user_id, max(n)::BIGINT AS longest_gap FROM (SELECT user_id, island, sum(CASE WHEN vm IS NULL THEN 1 ELSE 0 END) AS n FROM g GROUP BY ALL) GROUP BY user_id""")
def longest_gap(t):
    return S.longest_run(t.ev, I, F.col("vm").isNull(), "longest_gap")


@query("series_autocorrelation", EV + """,
c AS (SELECT user_id, i, value - avg(value) OVER (PARTITION BY user_id) AS c FROM ev),
v AS (SELECT user_id, count(*) AS n, sum(c * c) AS v FROM c GROUP BY user_id),
l AS (SELECT unnest(range(1, 6)) AS lag)
SELECT v.user_id, n, l.lag, round(coalesce(coalesce(sum(a.c * b.c), 0) / nullif(max(v.v), 0), 0), 6) AS acf
FROM v CROSS JOIN l LEFT JOIN c a ON a.user_id = v.user_id LEFT JOIN c b ON b.user_id = a.user_id AND b.i = a.i + l.lag GROUP BY v.user_id, n, l.lag""")
def autocorrelation(t):
    return rounded(S.autocorrelation(t.ev, I, "value", 5))


ACF10 = EV + """,
c AS (SELECT user_id, i, value - avg(value) OVER (PARTITION BY user_id) AS c FROM ev),
v AS (SELECT user_id, count(*) AS n, sum(c * c) AS v FROM c GROUP BY user_id),
l AS (SELECT unnest(range(1, 11)) AS lag),
acf AS (SELECT v.user_id, n, l.lag, coalesce(coalesce(sum(a.c * b.c), 0) / nullif(max(v.v), 0), 0) AS acf
FROM v CROSS JOIN l LEFT JOIN c a ON a.user_id = v.user_id LEFT JOIN c b ON b.user_id = a.user_id AND b.i = a.i + l.lag GROUP BY v.user_id, n, l.lag)"""


@query("series_ljung_box", ACF10 + " SELECT user_id, round(max(n * (n + 2)) * sum(acf * acf / (n - lag)), 4) AS q FROM acf WHERE lag < n GROUP BY user_id")
def ljung_box(t):
    return rounded(S.ljung_box(S.autocorrelation(t.ev, I, "value", 10), ["user_id"]), 4)


@query("series_acf_first_crossing", ACF10 + " SELECT user_id, coalesce(min(CASE WHEN acf < 0.36787944117144233::DOUBLE THEN lag END), max(lag)) AS lag FROM acf GROUP BY user_id")
def first_crossing(t):
    return S.first_crossing(S.autocorrelation(t.ev, I, "value", 10), ["user_id"], 0.36787944117144233)


@query("series_trend", EV + """
SELECT user_id, round(coalesce(regr_slope(value, i), 0), 6) AS slope, round(avg(value) - coalesce(regr_slope(value, i), 0) * avg(i), 6) AS intercept,
  round(coalesce(covar_pop(i, value) * covar_pop(i, value) / nullif(var_pop(i) * var_pop(value), 0), 0), 6) AS r2,
  CASE WHEN coalesce(regr_slope(value, i), 0) > 0 THEN 'up' WHEN coalesce(regr_slope(value, i), 0) < 0 THEN 'down' ELSE 'flat' END AS direction FROM ev GROUP BY user_id""")
def trend(t):
    return rounded(S.trend(t.ev, I, "value"))


@query("series_ranks", EV + """
SELECT user_id, i, round(coalesce((row_number() OVER (PARTITION BY user_id ORDER BY value, i) - 1)::DOUBLE / nullif(count(*) OVER (PARTITION BY user_id) - 1, 0), 0.5), 6) AS ordinal,
  round(row_number() OVER (PARTITION BY user_id ORDER BY value, i) / (count(*) OVER (PARTITION BY user_id) + 1), 6) AS ecdf,
  rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS average FROM ev""")
def ranks(t):
    return rounded(t.ev.select("user_id", "i", S.rank_normalise(I, "value", ["i"]).alias("ordinal"), S.ecdf_rank(I, "value", ["i"]).alias("ecdf"), X.average_rank(["user_id"], "value").alias("average")))


@query("series_latest_per_key", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest(t):
    return S.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("series_rolling_origins", EV + """,
b AS (SELECT user_id, i, value, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
f AS (SELECT user_id, i, value, r.fold, CASE WHEN i < r.fold * 10 + 40 THEN 'train' ELSE 'test' END AS part FROM b, unnest(range(0, (n // 10) + 1)) AS r(fold)
  WHERE n >= 45 AND r.fold <= floor((n - 45) / 10) AND i >= r.fold * 10 AND i < r.fold * 10 + 45)
SELECT user_id, fold, part, count(*) AS n, round(avg(value), 6) AS mean FROM f GROUP BY ALL""")
def rolling_origins(t):
    f = S.rolling_origins(t.ev.select("user_id", "i", "value"), I, 10, 40, 5)
    return rounded(f.groupBy("user_id", "fold", "part").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("series_chronological_split", EV + """,
p AS (SELECT user_id, i, value, i / count(*) OVER (PARTITION BY user_id) AS pos FROM ev)
SELECT user_id, CASE WHEN pos < 0.7::DOUBLE THEN 'train' WHEN pos < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS part, count(*) AS n, round(sum(value), 4) AS total FROM p GROUP BY ALL""")
def chronological(t):
    return rounded(t.ev.withColumn("part", S.chronological_split(I, 0.7, 0.15)).groupBy("user_id", "part").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("series_standardise_on_train", EV + """,
a AS (SELECT user_id, i::DOUBLE AS t, value, i / count(*) OVER (PARTITION BY user_id) < 0.8::DOUBLE AS tr FROM ev),
b AS (SELECT *, avg(CASE WHEN tr THEN value END) OVER w AS mean, coalesce(nullif(stddev_pop(CASE WHEN tr THEN value END) OVER w, 0), 1) AS std FROM a WINDOW w AS (PARTITION BY user_id)),
c AS (SELECT *, (value - mean) / std AS z FROM b),
d AS (SELECT *, coalesce(covar_pop(CASE WHEN tr THEN t END, CASE WHEN tr THEN z END) OVER w / nullif(var_pop(CASE WHEN tr THEN t END) OVER w, 0), 0) AS slope, avg(CASE WHEN tr THEN z END) OVER w AS mz, avg(CASE WHEN tr THEN t END) OVER w AS mt FROM c WINDOW w AS (PARTITION BY user_id))
SELECT user_id, t, round(z - slope * t - (mz - slope * mt), 5) AS scaled, round(value, 4) AS restored FROM d""")
def standardise(t):
    d = S.standardise_on_train(t.ev, I, "value", I.position() / I.size() < 0.8)
    return d.select("user_id", "t", F.round("scaled", 5).alias("scaled"), F.round(S.restore(F.col("scaled")), 4).alias("restored"))


@query("series_infer_frequency", EV + """,
d AS (SELECT user_id, abs(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY i))) / 1e6::DOUBLE AS d FROM ev),
m AS (SELECT user_id, median(d) AS seconds FROM d GROUP BY user_id)
SELECT user_id, round(seconds, 3) AS seconds, CASE WHEN seconds <= 10800 THEN 'h' WHEN seconds <= 172800 THEN 'd' WHEN seconds <= 1209600 THEN 'w' ELSE 'm' END AS freq FROM m""")
def frequency(t):
    return rounded(S.infer_frequency(t.ev, I, "ts"), 3)


@query("series_best_split", EV + """,
b AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, sum(value) OVER (PARTITION BY user_id) AS t FROM ev),
g AS (SELECT user_id, i, l * l / i + (t - l) * (t - l) / (n - i) - t * t / n AS gain FROM b WHERE i >= 3 AND i <= n - 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(gain, 4) DESC, i) AS k, max(gain) OVER (PARTITION BY user_id) AS top FROM g)
SELECT user_id, i AS at, round(top, 4) AS gain FROM r WHERE k = 1""")
def best_split(t):
    return rounded(S.best_split(t.ev, I, "value"), 4)


@query("series_block_stability", EV + """
SELECT user_id, floor(i * 4 / n)::BIGINT AS block, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM (SELECT user_id, i, value, count(*) OVER (PARTITION BY user_id) AS n FROM ev) GROUP BY user_id, floor(i * 4 / n)::BIGINT""")
def stability(t):
    return rounded(S.block_stability(t.ev, I, "value", 4))


@query("series_intermittency", EV + """,
s AS (SELECT user_id, i, CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END AS v FROM ev),
l AS (SELECT user_id, count(*) AS n, greatest(1e-8::DOUBLE, 0.05::DOUBLE * coalesce(median(CASE WHEN v > 0 THEN v END), 0), 0.01::DOUBLE * stddev_pop(v)) AS threshold FROM s GROUP BY user_id HAVING count(*) >= 20),
a AS (SELECT s.user_id, i, v, n, threshold, abs(v) > threshold AS act FROM s JOIN l USING (user_id)),
g AS (SELECT *, CASE WHEN act THEN i - max(CASE WHEN act THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap, sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS island FROM a),
r AS (SELECT user_id, max(k) AS longest_idle FROM (SELECT user_id, island, sum(CASE WHEN act THEN 0 ELSE 1 END) AS k FROM g GROUP BY ALL) GROUP BY user_id),
o AS (SELECT user_id, n, threshold, count(CASE WHEN act THEN 1 END) AS active, avg(gap) AS gp, avg(CASE WHEN act THEN 0.0 ELSE 1.0 END) AS zero_share, avg(CASE WHEN act THEN abs(v) END) AS m, stddev_pop(CASE WHEN act THEN abs(v) END) AS d FROM g GROUP BY user_id, n, threshold),
q AS (SELECT *, coalesce(gp, CASE WHEN active > 0 THEN n / active ELSE n END) AS adi, coalesce(d * d / nullif(m * m, 0), 0) AS cv2 FROM o)
SELECT user_id, n, round(threshold, 6) AS threshold, active, round(adi, 6) AS adi, round(cv2, 6) AS cv2, round(zero_share, 6) AS zero_share, longest_idle::BIGINT AS longest_idle,
  CASE WHEN zero_share < 0.08 AND adi < 1.2 THEN 'dense' WHEN adi >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' WHEN adi >= 1.32 THEN 'intermittent' WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS kind FROM q JOIN r USING (user_id)""")
def intermittency(t):
    return rounded(S.intermittency(t.ev.withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0)), I, "v"))


@query("series_calendar_profile", """
WITH b AS (SELECT event_type, isodow(ts) - 1 AS bucket, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_type, bucket, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce((avg(value) - max(m)) / nullif(max(s), 0), 0), 6) AS z FROM b WHERE n >= 12 GROUP BY event_type, bucket""")
def calendar(t):
    return rounded(S.calendar_profile(t.events, ["event_type"], "ts", "value", "weekday"))


@query("series_rolling_history", EV + """
SELECT user_id, i, lag(value, 1) OVER w AS lag1, lag(value, 7) OVER w AS lag7, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean7 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def history(t):
    return t.ev.select("user_id", "i", F.lag("value", 1).over(I.by).alias("lag1"), F.lag("value", 7).over(I.by).alias("lag7"), F.round(F.avg("value").over(I.rows(-7, -1)), 6).alias("mean7"))


@query("series_descriptive_features", EV + """,
d AS (SELECT user_id, i, value AS v, avg(value) OVER (PARTITION BY user_id) AS m FROM ev),
e AS (SELECT *, v - m AS c, lag(v) OVER w AS pv, lag(v - m) OVER w AS pc, sum(CASE WHEN v > m THEN 0 ELSE 1 END) OVER w AS island FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)),
l AS (SELECT user_id, max(k)::BIGINT AS longest_above FROM (SELECT user_id, island, sum(CASE WHEN v > m THEN 1 ELSE 0 END) AS k FROM e GROUP BY ALL) GROUP BY user_id)
SELECT user_id, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, round(median(v), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3,
  round(avg(c * c * c) / pow(stddev_pop(v), 3), 6) AS skew, round(kurtosis_pop(v), 6) AS kurt, round(coalesce(sum(c * pc) / nullif(sum(c * c), 0), 0), 6) AS acf1, round(coalesce(avg(CASE WHEN c * pc < 0 THEN 1.0 WHEN pc IS NOT NULL THEN 0.0 END), 0), 6) AS mean_crossing,
  round(coalesce(avg(abs(v - pv)), 0), 6) AS mean_step, round(sum(v * v), 4) AS energy, round(coalesce(regr_slope(v, i), 0), 6) AS slope, max(longest_above) AS longest_above FROM e JOIN l USING (user_id) GROUP BY user_id""")
def descriptive(t):
    d = S.descriptive_features(t.ev, I, "value").withColumn("energy", F.round("energy", 4))
    return rounded(d)

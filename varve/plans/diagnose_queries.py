"""Queries over diagnoses, fitted chains, calibration, selection and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import long_percentiles, melted
from ..operators import calibrate, chain, conformal, diagnose, features, generate, mining, prepare, select
from ..sources import io
from .registry import EV, query, rounded

LINE = ["l_quantity", "l_extendedprice", "l_discount"]


@query("feature_iqr_clip", "WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part) SELECT p_partkey, round(least(greatest(p_retailprice, a - 0.1 * (b - a)), b + 0.1 * (b - a)), 6) AS p_retailprice FROM part, q")
def iqr_clip(t):
    return rounded(features.iqr_clip(t.part.select("p_partkey", "p_retailprice"), ["p_retailprice"], 0.1))


@query("mining_exact_percentiles", """WITH m AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem)
SELECT feature, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM m GROUP BY feature""")
def percentiles(t):
    q = long_percentiles(melted(t.lineitem, LINE), [0.01, 0.5, 0.99])
    return rounded(q.select("feature", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99")))


@query("mining_sketches", """WITH d AS (SELECT count(DISTINCT l_orderkey) AS n, quantile_cont(l_orderkey, 0.45) AS a, quantile_cont(l_orderkey, 0.55) AS b, quantile_disc(l_orderkey, 0.5) AS m, approx_count_distinct(l_orderkey) AS s FROM lineitem)
SELECT 'l_orderkey' AS feature, abs(s - n) <= 0.5 * n AS distinct_close, m BETWEEN a AND b AS median_close FROM d""")
def sketches(t):
    return mining.sketches(t.lineitem, ["l_orderkey"], exact=True)


@query("prepare_align", "SELECT 'left' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'right', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def align(t):
    left, right = prepare.align(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), ["c_custkey"])
    return left.agg(F.lit("left").alias("side"), F.count("*").alias("n")).unionByName(right.agg(F.lit("right").alias("side"), F.count("*").alias("n")))


@query("mining_not_at_random", """WITH d AS (SELECT l_extendedprice AS x, unnest(['a', 'b']) AS feature, unnest([l_quantity > 45 AND l_partkey % 3 = 0, l_linenumber = 7]) AS m FROM lineitem),
r AS (SELECT x, (max(rk) + min(rk)) / 2.0 AS rank FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS rk FROM lineitem) GROUP BY x),
c AS (SELECT feature, x, sum(m::INT) AS a, sum((NOT m)::INT) AS b FROM d GROUP BY ALL),
s AS (SELECT feature, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, sum(x * a) AS sa, sum(x * b) AS sb, sum(x * x * a) AS qa, sum(x * x * b) AS qb, sum(rank * a) AS ra FROM c JOIN r USING (x) GROUP BY feature),
k AS (SELECT feature, max(abs(ca / na - cb / nb)) AS ks FROM (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY x) AS ca, sum(b) OVER (PARTITION BY feature ORDER BY x) AS cb FROM c) JOIN s USING (feature) GROUP BY feature),
f AS (SELECT feature, na::BIGINT AS missing, (sa / na - sb / nb) / sqrt((qa - sa * sa / na) / (na - 1) / na + (qb - sb * sb / nb) / (nb - 1) / nb) AS t, ks, greatest((ra - na * (na + 1) / 2) / (na * nb), 1 - (ra - na * (na + 1) / 2) / (na * nb)) AS auc, 1.358 * sqrt((na + nb) / (na * nb)) AS lim FROM s JOIN k USING (feature))
SELECT feature, missing, round(t, 3) AS t, round(ks, 6) AS ks, round(auc, 6) AS auc, abs(t) > 1.96 OR ks > lim OR auc > 0.7 AS suspected FROM f""")
def not_at_random(t):
    gap = lambda c: F.when(~c, F.lit(1))
    d = t.lineitem.select("l_extendedprice", gap((F.col("l_quantity") > 45) & (F.col("l_partkey") % 3 == 0)).alias("a"), gap(F.col("l_linenumber") == 7).alias("b"))
    return rounded(diagnose.not_at_random(d, "l_extendedprice", ["a", "b"]).withColumn("t", F.round("t", 3)))


@query("mining_vif", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS feature, round((1 - c * c) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 6) FROM d""")
def vif(t):
    return rounded(diagnose.inflation(t.lineitem, LINE))


@query("mining_kendall", """WITH p AS (SELECT a.o_custkey, sign(a.o_totalprice - b.o_totalprice) AS x, sign(a.o_orderkey - b.o_orderkey) AS y FROM orders a JOIN orders b USING (o_custkey))
SELECT o_custkey, sqrt(count(*))::BIGINT AS n, round(sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 6) AS tau FROM p GROUP BY o_custkey""")
def kendall(t):
    return rounded(diagnose.kendall(t.orders, "o_custkey", "o_totalprice", "o_orderkey"))


@query("mining_correlation_ensemble", """WITH r AS (SELECT p_size AS x, p_retailprice AS y, p_partkey AS z, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b, rank() OVER (ORDER BY p_partkey) + (count(*) OVER (PARTITION BY p_partkey) - 1) / 2.0 AS c FROM part)
SELECT 'p_size' AS feature_a, 'p_retailprice' AS feature_b, round((abs(corr(x, y)) + abs(corr(a, b))) / 2, 6) AS value FROM r UNION ALL SELECT 'p_size', 'p_partkey', round((abs(corr(x, z)) + abs(corr(a, c))) / 2, 6) FROM r UNION ALL SELECT 'p_retailprice', 'p_partkey', round((abs(corr(y, z)) + abs(corr(b, c))) / 2, 6) FROM r""")
def ensemble(t):
    return rounded(diagnose.correlation_ensemble(t.part, ["p_size", "p_retailprice", "p_partkey"]))


@query("mining_distribution_fits", """WITH s AS (SELECT count(*) AS n, var_pop(l_extendedprice) AS v, avg(ln(l_extendedprice)) AS lm, var_pop(ln(l_extendedprice)) AS lv, avg(l_extendedprice) AS m FROM lineitem),
f AS (SELECT 'normal' AS family, 4 + n * (ln(2 * pi()) + ln(v) + 1) AS aic FROM s UNION ALL SELECT 'lognormal', 4 + n * (ln(2 * pi()) + ln(lv) + 1 + 2 * lm) FROM s UNION ALL SELECT 'exponential', 2 + 2 * n * (1 + ln(m)) FROM s)
SELECT family, round(aic, 1) AS aic, aic = (SELECT min(aic) FROM f) AS best FROM f""")
def fits(t):
    return diagnose.distribution_fits(t.lineitem, "l_extendedprice").withColumn("aic", F.round("aic", 1))


@query("mining_feature_classes", """WITH m AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS x FROM lineitem),
a AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s, stddev_samp(x) AS std, median(x) AS med, min(x) AS low, max(x) AS high FROM m GROUP BY feature),
d AS (SELECT feature, avg(pow((x - m) / s, 3)) AS g, avg(pow((x - m) / s, 4)) - 3 AS k FROM m JOIN a USING (feature) GROUP BY feature)
SELECT feature, abs(g) < 0.5 AND abs(k) < 1 AS near_normal, abs(g) > 1 AS skewed, k > 3 AS heavy_tailed, (g * g + 1) / (k + 3) > 0.555 AS bimodal, low = high AS constant, abs(m - med) <= 0.1 * std AS symmetric FROM a JOIN d USING (feature)""")
def classes(t):
    return diagnose.feature_classes(mining.distribution(t.lineitem, LINE))


@query("mining_copula_mi")
def copula(t):
    return rounded(diagnose.copula_mi(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice"))


@query("mining_top_variance", """WITH m AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)
SELECT feature, round(var_samp(v), 2) AS variance FROM m GROUP BY feature ORDER BY var_samp(v) DESC, feature LIMIT 2""")
def top_variance(t):
    return diagnose.by_variance(t.lineitem, [*LINE, "l_tax"], 2).withColumn("variance", F.round("variance", 2))


@query("mining_interaction_pairs", """WITH c AS (SELECT abs(corr(l_quantity, l_tax)) AS q, abs(corr(l_extendedprice, l_tax)) AS e, abs(corr(l_discount, l_tax)) AS d, abs(corr(l_quantity * l_extendedprice, l_tax)) AS qe, abs(corr(l_quantity * l_discount, l_tax)) AS qd, abs(corr(l_extendedprice * l_discount, l_tax)) AS ed FROM lineitem),
p AS (SELECT 'l_quantity' AS feature_a, 'l_extendedprice' AS feature_b, qe - greatest(q, e) AS value FROM c UNION ALL SELECT 'l_quantity', 'l_discount', qd - greatest(q, d) FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', ed - greatest(e, d) FROM c)
SELECT feature_a, feature_b, round(value, 6) AS value FROM p ORDER BY round(value, 9) DESC, feature_a, feature_b LIMIT 2""")
def interaction_pairs(t):
    return rounded(diagnose.interaction_pairs(t.lineitem, LINE, "l_tax", 2))


@query("mining_date_like", r"""WITH m AS (SELECT unnest(['day', 'o_orderpriority']) AS feature, unnest([' ' || strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) AS v FROM orders)
SELECT feature, coalesce(avg(regexp_matches(trim(v), '\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}')::INT::DOUBLE), 0) AS matched, coalesce(avg(regexp_matches(trim(v), '\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4}')::INT::DOUBLE), 0) >= 0.5 AS is_date FROM m GROUP BY feature""")
def date_like(t):
    return diagnose.date_like(t.orders.select(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), "o_orderpriority"), ["day", "o_orderpriority"])


@query("series_pacf")
def pacf(t):
    return rounded(diagnose.partial_autocorrelations(t.ev, ["user_id"], ["i"], "vm").select("user_id", "n", "strong"))


TRENDS = EV + ", l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM ev), s AS (SELECT user_id, regr_slope(value, -r) AS slope FROM l WHERE r <= 20 GROUP BY user_id)"


@query("series_last_trends", TRENDS + " SELECT user_id, round(slope, 6) AS slope, sign(round(slope, 9))::BIGINT AS direction FROM s")
def last_trends(t):
    return rounded(diagnose.last_trends(t.ev, ["user_id"], ["i"], "value"))


@query("series_trend_agreement", TRENDS + " SELECT count(*) AS series, count(CASE WHEN round(slope, 9) > 0 THEN 1 END) AS rising, count(CASE WHEN round(slope, 9) < 0 THEN 1 END) AS falling, round(greatest(count(CASE WHEN round(slope, 9) > 0 THEN 1 END), count(CASE WHEN round(slope, 9) < 0 THEN 1 END))::DOUBLE / count(*), 6) AS agreement FROM s")
def trend_agreement(t):
    return rounded(diagnose.trend_agreement(diagnose.last_trends(t.ev, ["user_id"], ["i"], "value")))


@query("feature_holiday_flag", "SELECT o_orderkey, ((month(o_orderdate), day(o_orderdate)) IN ((1, 1), (7, 4), (12, 25)))::BIGINT AS is_holiday FROM orders")
def holiday(t):
    days = t.spark.sql("SELECT explode(sequence(1990, 2030)) AS y").select(F.explode(F.array(*(F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (7, 4), (12, 25))))).alias("day"))
    return rounded(features.holiday_flag(t.orders, "o_orderdate", days).select("o_orderkey", "is_holiday"))


@query("feature_generator_calendar", """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day, isodow(o_orderdate) - 1 AS dayofweek, week(o_orderdate) AS weekofyear,
  round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS week_sin, round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) AS week_cos, round(sin(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS year_sin, round(cos(2 * pi() * dayofyear(o_orderdate) / 365.25), 6) AS year_cos FROM orders""")
def generator_calendar(t):
    return rounded(t.orders.select("o_orderkey", *(v.alias(k) for k, v in features.generator_calendar("o_orderdate").items())))


_RFF = features.fourier_weights(3, 2, 0.5, seed=3)
_TERM = "({b!r} + " + " + ".join("{w[%d]!r} * %s" % (i, c) for i, c in enumerate(("l_quantity / 50", "l_discount * 10", "l_tax * 10"))) + ")"


@query("feature_random_fourier", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(cos({_TERM.format(w=w, b=b)}), 6) AS rff_{i}" for i, (w, b) in enumerate(_RFF)) + " FROM lineitem")
def random_fourier(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 10).alias("c"))
    return rounded(d.select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in features.random_fourier(["a", "b", "c"], _RFF).items())))


@query("feature_series_fourier")
def series_fourier(t):
    return rounded(features.series_fourier(t.ev, ["user_id"], "i", "value", 2))


#: Train rows are those of even line numbers.
CHAIN = """WITH t AS (SELECT * FROM lineitem WHERE l_linenumber % 2 = 0),
f AS (SELECT avg(CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END) AS fill FROM t),
x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity ELSE fill END AS q, ln(l_extendedprice) AS e FROM lineitem, f),
s AS (SELECT avg(q) AS qm, stddev_pop(q) AS qs FROM x WHERE l_linenumber % 2 = 0)"""


def _chain(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("q"), "l_extendedprice")
    steps = chain.Chain(chain.Impute(["q"]), chain.Clip(["l_extendedprice"], 50.0), chain.Scale(["q"]), exclude=["l_orderkey"])
    return d, steps.fit(d.filter("l_linenumber % 2 = 0"))


@query("chain_fit_transform", CHAIN + " SELECT l_orderkey, l_linenumber, round((q - qm) / qs, 6) AS q FROM x, s")
def chain_transform(t):
    d, fitted = _chain(t)
    return rounded(chain.Chain.from_json(fitted.to_json()).transform(d).select("l_orderkey", "l_linenumber", "q"))


@query("chain_inverse", CHAIN + " SELECT l_orderkey, l_linenumber, round(q, 6) AS q, round(exp(e), 2) AS l_extendedprice FROM x")
def chain_inverse(t):
    d, fitted = _chain(t)
    return rounded(fitted.inverse(fitted.transform(d)).select("l_orderkey", "l_linenumber", "q", F.round("l_extendedprice", 2).alias("l_extendedprice")))


@query("select_mutual_information", """WITH m AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature, unnest([l_quantity, l_extendedprice, l_discount]) AS x, l_returnflag AS y FROM lineitem),
r AS (SELECT feature, y, least(9, floor((rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 - 1) * 10 / count(*) OVER (PARTITION BY feature))) AS b FROM m),
c AS (SELECT feature, b, y, count(*)::DOUBLE AS c FROM r GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, b) AS nb, sum(c) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT feature, round(sum(c / n * ln(c * n / (nb * ny))), 6) AS mi FROM w GROUP BY feature""")
def mutual_information(t):
    return rounded(select.mutual_information(t.lineitem, LINE, "l_returnflag", 10))


@query("select_top_overlap", """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS b FROM part)
SELECT count(CASE WHEN a <= 50 AND b <= 50 THEN 1 END) / 50.0::DOUBLE AS overlap FROM r""")
def top_overlap(t):
    return select.top_overlap(t.part, "p_partkey", "p_retailprice", "p_size", 50)


@query("anomaly_score_fits", """WITH m AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS med, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type),
d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type)
SELECT event_type, round(med + 3 * 1.4826 * mad, 6) AS mad, round(mean + 3 * std, 6) AS gaussian, round((p99 + p95) / 2, 6) AS percentile FROM m JOIN d USING (event_type)""")
def score_fits(t):
    return rounded(calibrate.score_fits(t.events, "event_type", "value"))


@query("anomaly_adaptive_weights", """WITH e AS (SELECT event_type, abs(value - 50) AS err, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
q AS (SELECT event_type, quantile_cont(err, 0.9) AS p FROM e WHERE r <= 50 GROUP BY event_type)
SELECT event_type, round((1 / (p + 1e-8)) / sum(1 / (p + 1e-8)) OVER (), 6) AS weight FROM q""")
def adaptive_weights(t):
    return rounded(calibrate.adaptive_weights(t.events.withColumn("err", F.abs(F.col("value") - 50)), "event_type", ["ts", "event_id"], "err", 50))


@query("anomaly_platt")
def platt(t):
    a, b = calibrate.platt(t.lineitem.select((F.col("l_quantity") / 50).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y")), "s", "y")
    return t.spark.createDataFrame([(round(a, 4), round(b, 4))], "slope double, offset double")


@query("anomaly_temperature")
def temperature(t):
    d = t.lineitem.select((F.col("l_quantity") / 10 - 2).alias("s"), (F.col("l_extendedprice") > 30000).cast("int").alias("y"))
    return t.spark.createDataFrame([(round(calibrate.temperature(d, "s", "y"), 4),)], "temperature double")


KNN = EV + """, c AS (SELECT user_id, i, value AS x, abs(value - 50) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
k AS (SELECT a.user_id, a.i, b.r, row_number() OVER (PARTITION BY a.user_id, a.i ORDER BY abs(a.x - b.x), b.i) AS place FROM c a JOIN c b ON a.user_id = b.user_id AND b.i >= b.n - 5 - 40 AND b.i < b.n - 5 WHERE a.i >= a.n - 5)"""


@query("conformal_local_radii", KNN + " SELECT user_id, i, round(quantile_cont(r, 0.9), 6) AS radius FROM k WHERE place <= 10 GROUP BY user_id, i")
def local_radii(t):
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy("user_id"))
    d = t.ev.select("user_id", "i", F.col("value").alias("x"), F.abs(F.col("value") - 50).alias("r"), (F.col("i") >= n - 5).alias("test"))
    got = conformal.local_radii(d.filter("not test"), d.filter("test"), ["user_id"], "i", "x", "r", 0.1, k=10, window=40)
    return rounded(got.select("user_id", "i", "radius"))


@query("conformal_cv_plus", """WITH p AS (SELECT event_type, value, event_id % 5 AS fold, sum(value) OVER (PARTITION BY event_type) AS s, count(*) OVER (PARTITION BY event_type) AS n, sum(value) OVER (PARTITION BY event_type, event_id % 5) AS fs, count(*) OVER (PARTITION BY event_type, event_id % 5) AS fn FROM events),
r AS (SELECT event_type, (s - fs) / (n - fn) AS m, abs(value - (s - fs) / (n - fn)) AS r FROM p),
b AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY m - r) AS lo, m - r AS low, row_number() OVER (PARTITION BY event_type ORDER BY m + r) AS hi, m + r AS high, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, n, round(max(CASE WHEN lo = greatest(1, floor(0.1 * (n + 1))) THEN low END), 6) AS low, round(max(CASE WHEN hi = least(n, ceil(0.9 * (n + 1))) THEN high END), 6) AS high FROM b GROUP BY event_type, n""")
def cv_plus(t):
    folds = t.events.select("event_type", "value", (F.col("event_id") % 5).alias("fold"))
    mean = folds.groupBy("event_type", "fold").agg(F.sum("value").alias("fs"), F.count("*").alias("fn"))
    whole = mean.groupBy("event_type").agg(F.sum("fs").alias("s"), F.sum("fn").alias("n"))
    left_out = mean.join(whole, "event_type").select("event_type", "fold", ((F.col("s") - F.col("fs")) / (F.col("n") - F.col("fn"))).alias("m"))
    d = folds.join(left_out, ["event_type", "fold"]).select("event_type", "m", F.abs(F.col("value") - F.col("m")).alias("r"))
    return rounded(conformal.cv_plus(d, ["event_type"], "m", "r", 0.1))


@query("search_asha", """WITH t AS (SELECT o_custkey AS trial, o_orderkey % 3 AS rung, min(o_totalprice) AS loss FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY loss, trial) AS place, count(*) OVER (PARTITION BY rung) AS n FROM t)
SELECT trial, rung, place <= floor(n / 3) AS promoted FROM r""")
def asha(t):
    d = t.orders.select(F.col("o_custkey").alias("trial"), (F.col("o_orderkey") % 3).alias("rung"), "o_totalprice").groupBy("trial", "rung").agg(F.min("o_totalprice").alias("loss"))
    return generate.asha_promotions(d, "trial", "rung", "loss", 3).select("trial", "rung", "promoted")


@query("encode_auto_strategy", "SELECT unnest(['c_mktsegment', 'c_name', 'c_nationkey']) AS feature, unnest([count(DISTINCT c_mktsegment), count(DISTINCT c_name), count(DISTINCT c_nationkey)]) AS n, unnest(['one_hot', CASE WHEN count(DISTINCT c_name) > 50 THEN 'hashing' ELSE 'target' END, 'target']) AS strategy FROM customer")
def auto_strategy(t):
    return prepare.encoding_plan(t.customer, ["c_mktsegment", "c_name", "c_nationkey"])


FILTERS = EV + """, f AS (SELECT user_id, i, value, unnest([3, 5, 9]) AS width, unnest([avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)]) AS y FROM ev),
s AS (SELECT width, (value - y) * (value - y) AS gap, y - lag(y) OVER (PARTITION BY user_id, width ORDER BY i) AS step FROM f), m AS (SELECT width, round(sqrt(avg(gap)), 6) AS fidelity, round(avg(abs(step)), 6) AS roughness FROM s GROUP BY width)"""


@query("series_filter_ranking", FILTERS + " SELECT width, fidelity, roughness, (rank() OVER (ORDER BY fidelity) + rank() OVER (ORDER BY roughness)) / 2.0::DOUBLE AS mean_rank FROM m")
def filter_ranking(t):
    return rounded(diagnose.filter_ranking(t.ev, ["user_id"], ["i"], "value", (3, 5, 9)))


@query("source_series", "SELECT 'quantity' AS series, l_orderkey * 10 + l_linenumber AS t, l_quantity AS y FROM lineitem UNION ALL SELECT 'price', l_orderkey * 10 + l_linenumber, l_extendedprice FROM lineitem WHERE l_tax > 0.02")
def source_series(t):
    wide = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("price"))
    return io.extract_series(wide, "t", ["quantity", "price"])


@query("source_batches", EV + ", n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev) SELECT user_id, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'val' END AS part, floor((CASE WHEN i < floor(n * 0.8) THEN i ELSE i - floor(n * 0.8) END) / 16)::BIGINT AS batch, count(*) AS rows, round(sum(value), 4) AS total FROM n GROUP BY ALL")
def source_batches(t):
    b = io.batches(t.ev, ["user_id"], "i", 0.8, 16)
    return rounded(b.groupBy("user_id", "part", "batch").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total")))


@query("binning_kmeans")
def kmeans_bins(t):
    return features.kmeans_bins(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", 5)


@query("generate_regimes")
def regimes(t):
    return rounded(generate.regime_panel(t.spark, series=20, length=200, seed=5))

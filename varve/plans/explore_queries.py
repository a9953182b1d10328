"""Queries over searches and tests across groups and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformal, encode, explore, partition, signal
from .forecast_queries import PANEL, panel
from .registry import EV, query, rounded


@query("mining_welch_anova", """WITH g AS (SELECT l_linenumber, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_linenumber),
s AS (SELECT count(*) AS k, sum(n / v) AS w, sum(n / v * m) / sum(n / v) AS y, sum(n / v / v) AS r FROM g),
d AS (SELECT k, w, r, (SELECT sum(n / v * (m - y) * (m - y)) FROM g) AS num FROM s)
SELECT k, round(num / ((k - 1) * (1 + 2.0::DOUBLE * (k - 2) / (k * k - 1) * r / (w * w))), 6) AS statistic, round((k - 1)::DOUBLE, 6) AS df1, round((k * k - 1) / (3 * r / (w * w)), 6) AS df2 FROM d""")
def welch_anova(t):
    return rounded(explore.welch_anova(t.lineitem, "l_linenumber", "l_extendedprice"))


@query("anomaly_copod", """WITH s AS (SELECT skewness(l_quantity) AS a, skewness(l_extendedprice) AS b FROM lineitem),
u AS (SELECT l_orderkey, l_linenumber, -ln(cume_dist() OVER (ORDER BY l_quantity)) AS qa, -ln(cume_dist() OVER (ORDER BY l_quantity DESC)) AS qb,
  -ln(cume_dist() OVER (ORDER BY l_extendedprice)) AS pa, -ln(cume_dist() OVER (ORDER BY l_extendedprice DESC)) AS pb FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(qa + pa, qb + pb, CASE WHEN a < 0 THEN qa ELSE qb END + CASE WHEN b < 0 THEN pa ELSE pb END), 6) AS score FROM u, s""")
def copod(t):
    return rounded(explore.copod(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "score"))


@query("binning_shimazaki", """WITH e AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part),
c AS (SELECT k, a, b, least(floor((p_retailprice - a) * k / (b - a)), k - 1) AS bin, count(*)::DOUBLE AS n FROM part, e, range(4, 129) AS r(k) GROUP BY ALL),
s AS (SELECT k AS bins, (2 * sum(n) / k - (sum(n * n) / k - (sum(n) / k) * (sum(n) / k))) / (((b - a) / k) * ((b - a) / k)) AS cost FROM c GROUP BY k, a, b)
SELECT bins, round(cost, 6) AS cost, row_number() OVER (ORDER BY cost, bins) = 1 AS best FROM s""")
def shimazaki(t):
    return rounded(explore.shimazaki(t.part, "p_retailprice"))


@query("series_change_points")
def change_points(t):
    return rounded(partition.change_points(t.ev, "user_id", "i", "value", 5, 1.0))


@query("series_motifs")
def motifs(t):
    return rounded(explore.motifs(t.ev, "user_id", "i", "value", 12))


@query("signal_entropies")
def entropies(t):
    """Dispersion entropy, and permutation entropy at scales 1 to 3."""

    def every(x):
        return {"dispersion": explore.dispersion_entropy(x, 2, 4), **{f"scale{k}": signal.permutation_entropy(explore.coarse(x, k)) for k in (1, 2, 3)}}

    return rounded(signal.summarise_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", every, ["dispersion", "scale1", "scale2", "scale3"]))


@query("series_granger")
def granger(t):
    gap = t.ev.select("user_id", "i", "value", F.hour("ts").cast("double").alias("hour"))
    return rounded(explore.granger(gap, "user_id", "i", "value", "hour"))


@query("series_phase", PANEL + """,
v AS (SELECT unique_id AS a, i, n, (y - avg(y) OVER (PARTITION BY unique_id)) / (stddev_samp(y) OVER (PARTITION BY unique_id) + 1e-8::DOUBLE) AS y FROM p),
c AS (SELECT l.a, r.a AS b, l.i - r.i AS lag, sum(l.y * r.y) / first(l.n) AS strength FROM v AS l, v AS r WHERE l.a < r.a AND abs(l.i - r.i) <= 10 GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY strength DESC, lag) AS k FROM c)
SELECT a, b, lag, round(strength, 6) AS strength, abs(strength) > 0.6 AS aligned FROM m WHERE k = 1""")
def phase(t):
    return rounded(explore.phase(panel(t), "unique_id", "ds", "y", 10))


@query("series_last_trend", PANEL + " SELECT unique_id, sign(regr_slope(y, i))::BIGINT AS direction FROM p WHERE i >= n - 20 AND n >= 20 GROUP BY unique_id")
def last_trend(t):
    return explore.last_trend(panel(t), "unique_id", "ds", "y")


#: Schemes of a search as the caller's table: (snip, synflow, params) by name. Sums of such weights and whole numbers are exact, so that equal sums stay equal.
SCHEMES = {
    "baseline": (1, 0.5, -0.25), "uniform": (1, 1, -1), "subset_grad": (1, 0, 0), "subset_complexity": (0, 0, -0.25), "subset_synflow": (0, 0.5, 0), "subset_pos_only": (1, 0.5, 0),
    "subset_no_penalties": (1, 0.5, 0), "loo_minus_snip": (0, 0.5, -0.25), "loo_minus_synflow": (1, 0, -0.25), "loo_minus_params": (1, 0.5, 0),
}


@query("search_scheme_agreement", """WITH d AS (SELECT p_partkey, p_size AS params, p_partkey % 17 AS snip, p_partkey % 23 AS synflow FROM part),
w(scheme, a, b, c) AS (VALUES ('baseline', 1, 0.5, -0.25), ('uniform', 1, 1, -1), ('subset_grad', 1, 0, 0), ('subset_complexity', 0, 0, -0.25), ('subset_synflow', 0, 0.5, 0), ('subset_pos_only', 1, 0.5, 0),
  ('subset_no_penalties', 1, 0.5, 0), ('loo_minus_snip', 0, 0.5, -0.25), ('loo_minus_synflow', 1, 0, -0.25), ('loo_minus_params', 1, 0.5, 0)),
r AS (SELECT scheme, p_partkey, row_number() OVER (PARTITION BY scheme ORDER BY a * snip + b * synflow + c * params DESC, p_partkey) AS r FROM d, w),
j AS (SELECT x.scheme, x.r, y.r AS q FROM r AS x JOIN r AS y ON x.p_partkey = y.p_partkey AND y.scheme = 'baseline')
SELECT scheme, round(corr(r, q), 6) AS spearman, round(count(*) FILTER (r <= 10 AND q <= 10) / 10.0::DOUBLE, 6) AS overlap FROM j GROUP BY scheme""")
def scheme_agreement(t):
    d = t.part.select("p_partkey", F.col("p_size").alias("params"), (F.col("p_partkey") % 17).alias("snip"), (F.col("p_partkey") % 23).alias("synflow"))
    rows = [(name, metric, float(w)) for name, weights in SCHEMES.items() for metric, w in zip(("snip", "synflow", "params"), weights, strict=True)]
    return rounded(explore.scheme_agreement(d, "p_partkey", t.spark.createDataFrame(rows, "scheme string, metric string, weight double")))


@query("encode_choose", """WITH m AS (SELECT l_extendedprice AS y, unnest(['l_linenumber', 'l_suppkey', 'l_partkey', 'l_orderkey']) AS feature, unnest([l_linenumber::VARCHAR, l_suppkey::VARCHAR, l_partkey::VARCHAR, l_orderkey::VARCHAR]) AS v FROM lineitem),
c AS (SELECT feature, v, count(*) AS n, avg(y) AS y FROM m GROUP BY ALL),
s AS (SELECT feature, count(*) AS categories, sum(n) AS n, max(y) > min(y) AS differs FROM c GROUP BY feature)
SELECT feature, categories, CASE WHEN differs AND n >= 50 AND categories > 10 AND categories < 10000 THEN 'target_kfold' WHEN categories <= 12 THEN 'onehot' WHEN categories <= 1000 THEN 'freq' ELSE 'hashing' END AS strategy FROM s""")
def choose(t):
    return encode.choose(t.lineitem, ["l_linenumber", "l_suppkey", "l_partkey", "l_orderkey"], "l_extendedprice")


@query("conformal_aggregated_radius", EV + """,
a AS (SELECT user_id, list_sort(list(abs(value - 50))) AS s, count(*) AS m, list((value > 60)::INT::DOUBLE ORDER BY i) AS miss FROM ev GROUP BY user_id),
e AS (SELECT user_id, s, m, list_reduce(list_prepend(0.1::DOUBLE, miss), lambda a, x: least(0.99::DOUBLE, greatest(0.01::DOUBLE, a + g * (0.1::DOUBLE - x)))) AS alpha FROM a, (VALUES (0.001::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE)) AS v(g))
SELECT user_id, m AS n, round(avg(s[1 + ceil(least(1.0::DOUBLE, ceil((m + 1) * (1 - alpha)) / m) * (m - 1))::INT]), 6) AS radius FROM e GROUP BY user_id, m""")
def aggregated_radius(t):
    d = t.ev.withColumn("miss", F.col("value") > 60).withColumn("residual", F.abs(F.col("value") - 50))
    return rounded(conformal.aggregated_radius(d, ["user_id"], ["i"], "miss", "residual", 0.1, [0.001, 0.01, 0.05]))

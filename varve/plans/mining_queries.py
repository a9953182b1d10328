"""Profiling queries over line items, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining as M
from .registry import query, rounded

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = "WITH m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM lineitem" for c in COLS) + ")"
PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]
CORR = "coalesce(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 0)"


@query("mining_distribution", LONG + """,
s AS (SELECT feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, stddev_pop(v) AS sp, min(v) AS low, max(v) AS high, kurtosis_pop(v) AS excess, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.95) AS p95 FROM m GROUP BY feature),
k AS (SELECT m.feature, avg(pow(v - mean, 3)) / pow(max(sp), 3) AS skew FROM m JOIN s USING (feature) GROUP BY m.feature)
SELECT feature, n, round(mean, 4) AS mean, round(std, 4) AS std, low, high, round(high - low, 4) AS range, round(std / nullif(abs(mean), 0), 4) AS cv, round(skew, 4) AS skew, round(excess, 4) AS excess, round((skew * skew + 1) / (excess + 3), 4) AS bimodality,
  round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round((high - p95) / nullif(p5 - low, 0), 4) AS tail_ratio, round(n / 6 * (skew * skew + excess * excess / 4), 2) AS jarque_bera FROM s JOIN k USING (feature)""")
def distribution(t):
    return rounded(M.distribution(t.lineitem, COLS).withColumn("jarque_bera", F.round("jarque_bera", 2)), 4)


@query("mining_histogram_entropy", LONG + """,
s AS (SELECT feature, min(v) AS a, max(v) AS b, count(v) AS n, least(80, greatest(10, floor(sqrt(count(v)))))::BIGINT AS k FROM m GROUP BY feature),
c AS (SELECT feature, k, n, least(coalesce(floor((v - a) * k / nullif(b - a, 0)), 0), k - 1) AS bin, count(*) AS c FROM m JOIN s USING (feature) GROUP BY ALL)
SELECT feature, k AS bins, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM c GROUP BY feature, k""")
def entropy(t):
    return rounded(M.histogram_entropy(t.lineitem, COLS))


@query("mining_far_share", LONG + """, s AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM m GROUP BY feature)
SELECT feature, round(avg(CASE WHEN abs(v - s.m) > 1.5::DOUBLE * s.s THEN 1.0 ELSE 0.0 END), 6) AS share FROM m JOIN s USING (feature) GROUP BY feature""")
def far(t):
    return rounded(M.far_share(t.lineitem, COLS, 1.5))


@query("mining_pearson", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({CORR.format(a, b)}, 6) AS value FROM lineitem" for a, b in PAIRS))
def pearson(t):
    return rounded(M.pearson(t.lineitem, COLS))


RANKED = "WITH r AS (SELECT l_suppkey, " + ", ".join(f"rank() OVER (PARTITION BY l_suppkey ORDER BY {c}) + (count(*) OVER (PARTITION BY l_suppkey, {c}) - 1) / 2 AS {c}" for c in COLS) + " FROM lineitem)"


@query("mining_spearman", RANKED + " " + " UNION ALL ".join(f"SELECT l_suppkey, '{a}' AS feature_a, '{b}' AS feature_b, round({CORR.format(a, b)}, 6) AS value FROM r GROUP BY l_suppkey" for a, b in PAIRS))
def spearman(t):
    return rounded(M.spearman(t.lineitem, COLS, "l_suppkey"))


@query("mining_robust_pearson", "WITH q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS a_{c}, quantile_cont({c}, 0.95) AS b_{c}" for c in COLS) + " FROM lineitem), c AS (SELECT " + ", ".join(f"least(greatest({c}, a_{c}), b_{c}) AS {c}" for c in COLS) + " FROM lineitem, q) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({CORR.format(a, b)}, 6) AS value FROM c" for a, b in PAIRS))
def robust(t):
    return rounded(M.robust_pearson(t.lineitem, COLS))


EVK = "WITH e AS (SELECT event_id, user_id, value, event_id % 97 AS k FROM events)"


@query("mining_chatterjee", EVK + """,
r AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) AS r FROM e),
d AS (SELECT user_id, abs(r - lag(r) OVER (PARTITION BY user_id ORDER BY value, event_id)) AS d FROM r)
SELECT user_id, round(greatest(0, least(1, 1 - coalesce(3.0::DOUBLE * sum(d) / nullif(count(*) * count(*) - 1, 0), 0))), 6) AS xi FROM d GROUP BY user_id""")
def chatterjee(t):
    return rounded(M.chatterjee(t.events.withColumn("k", F.col("event_id") % 97), "value", "k", "user_id", "event_id"))


MI = EVK.replace("user_id", "event_type").replace("WITH e AS (SELECT event_id, event_type", "WITH e AS (SELECT event_id, event_type") + """,
r AS (SELECT event_type, count(*) OVER (PARTITION BY event_type) AS n, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS a, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2 AS b FROM e),
c AS (SELECT event_type, least(floor((a - 1) * 8 / n), 7) AS a, least(floor((b - 1) * 8 / n), 7) AS b, count(*) AS c FROM r GROUP BY ALL),
x AS (SELECT event_type, -sum(p * ln(p)) AS h, count(*) AS k FROM (SELECT event_type, sum(c) / sum(sum(c)) OVER (PARTITION BY event_type) AS p FROM c GROUP BY event_type, a) GROUP BY event_type),
y AS (SELECT event_type, -sum(p * ln(p)) AS h, count(*) AS k FROM (SELECT event_type, sum(c) / sum(sum(c)) OVER (PARTITION BY event_type) AS p FROM c GROUP BY event_type, b) GROUP BY event_type),
z AS (SELECT event_type, -sum(p * ln(p)) AS h, count(*) AS k, sum(c) AS n FROM (SELECT event_type, c, c / sum(c) OVER (PARTITION BY event_type) AS p FROM c) GROUP BY event_type),
mi AS (SELECT event_type, greatest(0, x.h + y.h - z.h - (z.k - x.k - y.k + 1) / (2 * z.n)) AS mi FROM x JOIN y USING (event_type) JOIN z USING (event_type))"""


@query("mining_binned_mi", MI + " SELECT event_type, round(mi, 6) AS mi, round(sqrt(1 - exp(-2 * mi)), 5) AS coefficient FROM mi")
def binned(t):
    m = M.binned_mi(t.events.withColumn("k", F.col("event_id") % 97), "value", "k", 8, "event_type")
    return m.select("event_type", F.round("mi", 6).alias("mi"), F.round(M.mi_coefficient(F.col("mi")), 5).alias("coefficient"))


MISS = "WITH e AS (SELECT CASE WHEN event_id % 10 <> 3 THEN value END AS a, CASE WHEN event_id % 5 <> 3 THEN value END AS b, CASE WHEN event_id % 7 <> 0 THEN value END AS c FROM events)"


def holes(t):
    v = F.col("value")
    return t.events.select(F.when(F.col("event_id") % 10 != 3, v).alias("a"), F.when(F.col("event_id") % 5 != 3, v).alias("b"), F.when(F.col("event_id") % 7 != 0, v).alias("c"))


@query("mining_missing", MISS + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, round((count(*) - count({c}))::DOUBLE / count(*), 6) AS rate FROM e" for c in "abc"))
def missing(t):
    return rounded(M.missing(holes(t), ["a", "b", "c"]))


@query("mining_missing_pairs", MISS.replace("FROM events)", "FROM events), m AS (SELECT (a IS NULL)::INT::DOUBLE AS a, (b IS NULL)::INT::DOUBLE AS b, (c IS NULL)::INT::DOUBLE AS c FROM e)") + " " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({CORR.format(a, b)}, 6) AS corr, round(coalesce(sum({a} * {b}) / nullif(sum({a}) + sum({b}) - sum({a} * {b}), 0), 0), 6) AS jaccard FROM m" for a, b in ("ab", "ac", "bc")))
def missing_pairs(t):
    return rounded(M.missing_pairs(holes(t), ["a", "b", "c"]))


@query("mining_group_stats", "SELECT p_brand, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(stddev_samp(p_retailprice), 6) AS std, min(p_retailprice) AS low, max(p_retailprice) AS high, round(quantile_cont(p_retailprice, 0.25), 6) AS q1, round(quantile_cont(p_retailprice, 0.75), 6) AS q3 FROM part GROUP BY p_brand HAVING count(p_retailprice) >= 2")
def groups(t):
    return rounded(M.group_stats(t.part, "p_brand", "p_retailprice"))


@query("mining_welch_t", """
WITH s AS (SELECT avg(CASE WHEN f THEN v END) AS ma, avg(CASE WHEN NOT f THEN v END) AS mb, var_samp(CASE WHEN f THEN v END) AS va, var_samp(CASE WHEN NOT f THEN v END) AS vb, count(CASE WHEN f THEN v END) AS na, count(CASE WHEN NOT f THEN v END) AS nb FROM (SELECT l_returnflag = 'R' AS f, l_extendedprice AS v FROM lineitem))
SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 3) AS df, round((ma - mb) / sqrt((va + vb) / 2), 6) AS d FROM s""")
def welch(t):
    w = M.welch(t.lineitem, F.col("l_returnflag") == "R", "l_extendedprice")
    return w.select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), F.round("d", 6).alias("d"))


@query("mining_levene", """
WITH m AS (SELECT l_returnflag AS g, median(l_quantity) AS m FROM lineitem GROUP BY 1), z AS (SELECT l_returnflag AS g, abs(l_quantity - m) AS z FROM lineitem JOIN m ON m.g = l_returnflag),
s AS (SELECT g, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY g), t AS (SELECT sum(n) AS N, count(*) AS k, sum(n * m) / sum(n) AS mm FROM s)
SELECT round((max(t.N) - max(k)) * sum(s.n * pow(s.m - mm, 2)) / ((max(k) - 1) * sum(s.n * s.v)), 6) AS levene FROM s, t""".replace("sum(n) AS N", "sum(n) AS tot").replace("max(t.N)", "max(t.tot)"))
def levene(t):
    return rounded(M.levene(t.lineitem, "l_returnflag", "l_quantity"))


@query("mining_kruskal", """
WITH r AS (SELECT l_suppkey AS s, l_returnflag AS g, l_quantity AS v, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS r FROM lineitem),
g AS (SELECT s, g, count(*) AS n, sum(r) AS r FROM r GROUP BY s, g), q AS (SELECT s, sum(pow(t, 3) - t) AS ties FROM (SELECT s, v, count(*) AS t FROM r GROUP BY s, v) GROUP BY s),
k AS (SELECT s, sum(n)::BIGINT AS n, count(*) AS k, sum(r * r / n) AS x FROM g GROUP BY s),
h AS (SELECT s, n, k, (12 / (n::DOUBLE * (n + 1)) * x - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h FROM k JOIN q USING (s))
SELECT s AS l_suppkey, n, k, round(h, 5) AS h, round((h - k + 1) / (n - k), 6) AS eta2 FROM h""")
def kruskal(t):
    k = M.kruskal(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity")
    return rounded(k.withColumn("h", F.round("h", 5)))


@query("mining_mann_whitney", """
WITH r AS (SELECT l_suppkey AS s, l_returnflag = 'R' AS f, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS r FROM lineitem),
g AS (SELECT s, count(CASE WHEN f THEN 1 END) AS a, count(CASE WHEN NOT f THEN 1 END) AS b, sum(CASE WHEN f THEN r END) AS r FROM r GROUP BY s)
SELECT s AS l_suppkey, a, b, r - a * (a + 1) / 2 AS u, round(2 * ((r - a * (a + 1) / 2) / (a * b)) - 1, 6) AS rank_biserial FROM g""")
def mann_whitney(t):
    return rounded(M.mann_whitney(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R", "l_quantity"))


@query("mining_cramers_v", """
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY ALL), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), q AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
s AS (SELECT sum(o * o / (ra * cb)) AS s, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, sum(o) AS n FROM c JOIN r USING (a) JOIN q USING (b))
SELECT round(n * (s - 1), 5) AS chi2, round(sqrt(greatest(0, n * (s - 1) / (n * (least(ka, kb) - 1)))), 6) AS v FROM s""")
def cramers(t):
    return M.cramers_v(t.orders, "o_orderstatus", "o_orderpriority").select(F.round("chi2", 5).alias("chi2"), F.round("v", 6).alias("v"))


@query("mining_tail_dependence", RANKED.replace(" FROM lineitem)", ", count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)") + """
SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_quantity / n > 0.8::DOUBLE AND l_extendedprice / n > 0.8::DOUBLE THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN l_quantity / n > 0.8::DOUBLE THEN 1.0 ELSE 0 END), 0), 0), 6) AS upper,
  round(coalesce(sum(CASE WHEN l_quantity / n <= (1 - 0.8::DOUBLE) AND l_extendedprice / n <= (1 - 0.8::DOUBLE) THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN l_quantity / n <= (1 - 0.8::DOUBLE) THEN 1.0 ELSE 0 END), 0), 0), 6) AS lower FROM r GROUP BY l_suppkey""")
def tails(t):
    return rounded(M.tail_dependence(t.lineitem, "l_quantity", "l_extendedprice", 0.8, "l_suppkey"))


@query("mining_regime_correlation", "WITH m AS (SELECT median(l_quantity) AS m FROM lineitem), s AS (SELECT " + ", ".join(CORR.format(f"CASE WHEN {c} THEN l_extendedprice END", f"CASE WHEN {c} THEN l_quantity END") + f" AS {n}" for c, n in (("l_quantity <= m", "below"), ("l_quantity > m", "above"))) + " FROM lineitem, m) SELECT round(below, 6) AS below, round(above, 6) AS above, round(abs(below - above), 6) AS gap, abs(below - above) > 0.3 AS differs FROM s")
def regime(t):
    return rounded(M.regime_corr(t.lineitem, "l_extendedprice", "l_quantity", "l_quantity"))


def _r2(a, b):
    x, y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    return f"round(pow({CORR.format(x, y)}, 2), 6)"


@query("mining_form_fits", f"WITH e AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, CASE WHEN p_size > 0 THEN ln(p_size) END AS lx, CASE WHEN p_retailprice > 0 THEN ln(p_retailprice) END AS ly FROM part) SELECT {_r2('x', 'y')} AS linear, {_r2('lx', 'y')} AS logarithmic, {_r2('x', 'ly')} AS exponential, {_r2('lx', 'ly')} AS power FROM e")
def forms(t):
    return rounded(M.form_fits(t.part.select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")), "x", "y"))


@query("mining_duplicate_ratio", "SELECT sum(c)::BIGINT AS rows, count(*) AS distinct, round(count(*) / sum(c), 6) AS ratio FROM (SELECT o_orderstatus, o_orderpriority, o_custkey, count(*) AS c FROM orders GROUP BY ALL)")
def duplicates(t):
    return rounded(M.duplicate_ratio(t.orders.select("o_orderstatus", "o_orderpriority", "o_custkey")))


RANKS_ALL = "WITH r AS (SELECT count(*) OVER () AS n, " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in COLS) + ", l_returnflag AS g, l_quantity AS v FROM lineitem)"


@query("mining_spearman_all", RANKS_ALL + " " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({CORR.format(a, b)}, 6) AS value FROM r" for a, b in PAIRS))
def spearman_all(t):
    return rounded(M.whole_spearman(t.lineitem, COLS))


@query("mining_chatterjee_all", EVK + """,
r AS (SELECT row_number() OVER (ORDER BY k, event_id) AS y, row_number() OVER (ORDER BY value, event_id) AS x FROM e),
d AS (SELECT abs(y - lag(y) OVER (ORDER BY x)) AS a, abs(x - lag(x) OVER (ORDER BY y)) AS b FROM r)
SELECT round((greatest(0, least(1, 1 - 3.0::DOUBLE * sum(a) / (count(*)::DOUBLE * count(*) - 1))) + greatest(0, least(1, 1 - 3.0::DOUBLE * sum(b) / (count(*)::DOUBLE * count(*) - 1)))) / 2, 6) AS xi FROM d""")
def chatterjee_all(t):
    return rounded(M.whole_chatterjee(t.events.withColumn("k", F.col("event_id") % 97), "value", "k", "event_id"))


@query("mining_binned_mi_all", EVK + """,
r AS (SELECT count(*) OVER () AS n, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS a, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2 AS b FROM e),
c AS (SELECT n, least(floor((a - 1) * 8 / n), 7) AS a, least(floor((b - 1) * 8 / n), 7) AS b, count(*) AS c FROM r GROUP BY ALL),
x AS (SELECT -sum(p * ln(p)) AS h, count(*) AS k FROM (SELECT sum(c) / max(n) AS p FROM c GROUP BY a)), y AS (SELECT -sum(p * ln(p)) AS h, count(*) AS k FROM (SELECT sum(c) / max(n) AS p FROM c GROUP BY b)),
z AS (SELECT -sum(c / n * ln(c / n)) AS h, count(*) AS k, max(n) AS n FROM c), mi AS (SELECT greatest(0, x.h + y.h - z.h - (z.k - x.k - y.k + 1) / (2 * z.n)) AS mi FROM x, y, z)
SELECT round(mi, 6) AS mi, round(sqrt(1 - exp(-2 * mi)), 5) AS coefficient FROM mi""")
def binned_all(t):
    m = M.whole_binned_mi(t.events.withColumn("k", F.col("event_id") % 97), "value", "k", 8)
    return m.select(F.round("mi", 6).alias("mi"), F.round(M.mi_coefficient(F.col("mi")), 5).alias("coefficient"))


@query("mining_kruskal_all", RANKS_ALL + """,
g AS (SELECT g, count(*) AS n, sum(l_quantity) AS r FROM r GROUP BY g), q AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT v, count(*) AS t FROM r GROUP BY v)),
k AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(r * r / n) AS x FROM g), h AS (SELECT n, k, (12 / (n::DOUBLE * (n + 1)) * x - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h FROM k, q)
SELECT n, k, round(h, 5) AS h, round((h - k + 1) / (n - k), 6) AS eta2 FROM h""")
def kruskal_all(t):
    return rounded(M.whole_kruskal(t.lineitem, "l_returnflag", "l_quantity").withColumn("h", F.round("h", 5)))


@query("mining_mann_whitney_all", RANKS_ALL + """,
g AS (SELECT count(CASE WHEN g = 'R' THEN 1 END) AS a, count(CASE WHEN g <> 'R' THEN 1 END) AS b, sum(CASE WHEN g = 'R' THEN l_quantity END) AS r FROM r)
SELECT a, b, r - a * (a + 1) / 2 AS u, round(2 * ((r - a * (a + 1) / 2) / (a::DOUBLE * b)) - 1, 6) AS rank_biserial FROM g""")
def mann_whitney_all(t):
    return rounded(M.whole_mann_whitney(t.lineitem, F.col("l_returnflag") == "R", "l_quantity"))


@query("mining_tail_dependence_all", RANKS_ALL + """
SELECT round(coalesce(count(*) FILTER (l_quantity / n > 0.8::DOUBLE AND l_extendedprice / n > 0.8::DOUBLE) / nullif(count(*) FILTER (l_quantity / n > 0.8::DOUBLE), 0), 0), 6) AS upper,
  round(coalesce(count(*) FILTER (l_quantity / n <= (1 - 0.8::DOUBLE) AND l_extendedprice / n <= (1 - 0.8::DOUBLE)) / nullif(count(*) FILTER (l_quantity / n <= (1 - 0.8::DOUBLE)), 0), 0), 6) AS lower FROM r""")
def tails_all(t):
    return rounded(M.whole_tail_dependence(t.lineitem, "l_quantity", "l_extendedprice", 0.8))

"""Kernel dependence by random features, search by Parzen estimates, information of all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernel, search, select
from .registry import query, rounded

_COLUMNS, _FEATURES = ["p_size", "p_retailprice", "mixed"], 12


def _hsic_sql() -> str:
    """The same frequencies and phases as a table; covariances of all pairs of features."""
    values = ", ".join(f"('{c}', {k}, {w[0, k]!r}::DOUBLE, {b[k]!r}::DOUBLE)" for i, c in enumerate(_COLUMNS) for w, b in [[x.astype(object) for x in kernel.weights(1, _FEATURES, 1, i)]] for k in range(_FEATURES))
    return f"""WITH w(feature, k, w, b) AS (VALUES {values}),
d AS (SELECT p_partkey AS id, unnest(['p_size', 'p_retailprice', 'mixed']) AS feature, unnest([p_size::DOUBLE, p_retailprice, p_size * p_retailprice]) AS v FROM part),
s AS (SELECT feature, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 AS s FROM d GROUP BY feature),
f AS (SELECT id, feature, k, sqrt(2.0::DOUBLE / {_FEATURES}) * cos(v / s * w + b) AS f FROM d JOIN s USING (feature) JOIN w USING (feature)),
h AS (SELECT a.feature AS a, b.feature AS b, sum(c * c) AS hsic FROM (SELECT x.feature AS fa, y.feature AS fb, covar_pop(x.f, y.f) AS c FROM f AS x JOIN f AS y USING (id) GROUP BY x.feature, x.k, y.feature, y.k) JOIN s AS a ON a.feature = fa JOIN s AS b ON b.feature = fb GROUP BY ALL)
SELECT h.a AS feature_a, h.b AS feature_b, round(h.hsic, 8) AS hsic, round(h.hsic / sqrt(x.hsic * y.hsic), 8) AS alignment FROM h JOIN h AS x ON x.a = h.a AND x.b = h.a JOIN h AS y ON y.a = h.b AND y.b = h.b
WHERE (h.a, h.b) IN (('p_size', 'p_retailprice'), ('p_size', 'mixed'), ('p_retailprice', 'mixed'))"""


@query("mining_hsic_pairs", _hsic_sql())
def hsic_pairs(t):
    d = t.part.select(F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") * F.col("p_retailprice")).alias("mixed"))
    return rounded(kernel.hsic_pairs(d, _COLUMNS, _FEATURES), 8)


@query("mining_conditional_hsic")
def conditional_hsic(t):
    """Discounted price and tax paid given the price, over every line item; see the tests for the n x n kernels that it equals."""
    d = t.lineitem.select("l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))
    return rounded(kernel.conditional_hsic(d, ["net"], ["tax"], ["l_extendedprice"], 32, tries=3))


@query("search_parzen_scores", """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_tax - l_discount + l_quantity / 500 AS loss,
  least(49, greatest(0, floor((l_quantity - 1) * 50 / 50)))::BIGINT AS cq, least(49, greatest(0, floor(l_extendedprice * 50 / 110000.0::DOUBLE)))::BIGINT AS cp FROM lineitem),
s AS (SELECT *, loss <= (SELECT quantile_cont(loss, 0.15) FROM t) AS good FROM t),
k AS (SELECT good, param, o, count(*) AS k FROM (SELECT good, unnest(['q', 'p']) AS param, unnest([cq, cp]) AS o FROM s) GROUP BY ALL),
z AS (SELECT param, good, sum(k) AS n, greatest(1, 1.06::DOUBLE * sqrt(sum(o * o * k) / sum(k) - (sum(o * k) / sum(k)) ** 2) * sum(k) ** -0.2::DOUBLE) AS h FROM k GROUP BY ALL),
m AS (SELECT param, good, o, k, n, c, exp(-0.5::DOUBLE * ((c - o) / h) ** 2) AS w FROM k JOIN z USING (param, good), range(50) AS g(c)),
v AS (SELECT *, w / sum(w) OVER (PARTITION BY param, good, o) AS v FROM m),
p AS (SELECT param, good, c, (sum(k * v) + 1.0::DOUBLE / 50) / (any_value(n) + 1) AS p FROM v GROUP BY param, good, c),
r AS (SELECT param, c, ln(max(p) FILTER (good)) - ln(max(p) FILTER (NOT good)) AS r FROM p GROUP BY param, c),
f AS (SELECT l_returnflag, count(*) FILTER (good) AS a, count(*) FILTER (NOT good) AS b FROM s GROUP BY 1),
x AS (SELECT l_returnflag, ln((a + 1.0::DOUBLE / (SELECT count(*) FROM f)) / ((SELECT sum(a) FROM f) + 1)) - ln((b + 1.0::DOUBLE / (SELECT count(*) FROM f)) / ((SELECT sum(b) FROM f) + 1)) AS r FROM f)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(q.r + p.r + x.r, 6) AS score FROM s JOIN r AS q ON q.param = 'q' AND q.c = cq JOIN r AS p ON p.param = 'p' AND p.c = cp JOIN x USING (l_returnflag)""")
def parzen_scores(t):
    """Every line item as a trial, and each of them scored as a candidate."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", (F.col("l_tax") - F.col("l_discount") + F.col("l_quantity") / 500).alias("loss"))
    scored = search.score_candidates(d, d.drop("loss"), "loss", {"l_quantity": (1.0, 51.0), "l_extendedprice": (0.0, 110000.0)}, ["l_returnflag"], cells=50)
    return rounded(scored.select("l_orderkey", "l_linenumber", "score"))


@query("mining_information_pairs", """WITH d AS (SELECT row_number() OVER () AS id, l_quantity, l_extendedprice, l_discount, l_extendedprice * l_discount AS off FROM lineitem),
m AS (SELECT id, unnest([1, 2, 3, 4]) AS f, unnest([l_quantity, l_extendedprice, l_discount, off]) AS v FROM d),
q AS (SELECT f, quantile_cont(v, [i / 8.0 FOR i IN range(1, 8)]) AS q FROM m GROUP BY f),
b AS (SELECT id, f, len(list_filter(list_distinct(q), lambda e: e < v)) AS b FROM m JOIN q USING (f)),
c AS (SELECT x.f AS i, y.f AS j, x.b AS a, y.b AS b, count(*)::DOUBLE AS c FROM b AS x JOIN b AS y ON x.id = y.id AND x.f < y.f GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY i, j) AS n, sum(c) OVER (PARTITION BY i, j, a) AS na, sum(c) OVER (PARTITION BY i, j, b) AS nb FROM c),
n AS (SELECT unnest([1, 2, 3, 4]) AS f, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'off']) AS name)
SELECT x.name AS feature_a, y.name AS feature_b, round(greatest(0, sum(c / n * ln(c * n / (na * nb)))), 6) AS mi FROM w JOIN n AS x ON x.f = i JOIN n AS y ON y.f = j GROUP BY ALL""")
def information_pairs(t):
    d = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * F.col("l_discount")).alias("off"))
    return rounded(select.information_matrix(d, ["l_quantity", "l_extendedprice", "l_discount", "off"], 8))


@query("select_mrmr_quotient")
def mrmr_quotient(t):
    """Columns of every line item in the order chosen for the net discount, by mutual information and its quotient; see the tests for the same choice by brute force."""
    d = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * F.col("l_discount")).alias("off"))
    chosen = select.mrmr(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "off", 3, "information", "quotient")
    return t.spark.createDataFrame(list(enumerate(chosen)), "place long, feature string")

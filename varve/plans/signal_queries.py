"""Signal queries per user's series; rows and invariants are tested, not SQL, except where SQL is given."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import signal as G
from .registry import EV, query, rounded


def _filter(name: str, sql: str | None = None) -> None:
    @query(f"signal_filter_{name}", sql)
    def run(t):
        return rounded(G.map_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", G.FILTERS[name], "smooth"))


FILTER_SQL = {
    "moving_average": EV + " SELECT user_id, i, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ev",
    "gaussian": EV + """, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
k AS (SELECT user_id, i, exp(-0.5::DOUBLE * (d / 2.0::DOUBLE) * (d / 2.0::DOUBLE)) AS w, CASE WHEN i + d < 0 THEN -(i + d) - 1 WHEN i + d >= n THEN 2 * n - (i + d) - 1 ELSE i + d END AS j FROM n, range(-8, 9) AS r(d) WHERE abs(d) < n)
SELECT k.user_id, k.i, round(sum(w * ev.value) / sum(w), 6) AS smooth FROM k JOIN ev ON k.user_id = ev.user_id AND k.j = ev.i GROUP BY k.user_id, k.i""",
    # orthogonal polynomials on -3..3; the ends take the polynomial of the first and last window, series are at least seven long
    "savgol": EV + """, n AS (SELECT user_id, i, least(greatest(i, 3), count(*) OVER (PARTITION BY user_id) - 4) AS c FROM ev)
SELECT n.user_id, n.i, round(sum((1 / 7.0::DOUBLE + (n.i - c) * s / 28.0::DOUBLE + ((n.i - c) * (n.i - c) - 4) * (s * s - 4) / 84.0::DOUBLE) * ev.value), 6) AS smooth
FROM n, range(-3, 4) AS r(s), ev WHERE ev.user_id = n.user_id AND ev.i = c + s GROUP BY n.user_id, n.i""",
}
for _name in sorted(G.FILTERS):
    _filter(_name, FILTER_SQL.get(_name))


def _summary(name: str, f, names: list[str], sql: str | None = None) -> None:
    @query(f"signal_{name}", sql)
    def run(t):
        return rounded(G.summarise_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", f, names))


COMPLEXITY = EV + """, n AS (SELECT *, count(*) OVER u AS n, first(value) OVER o AS x0, value - lag(value) OVER o AS step, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c FROM ev WINDOW u AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY i) AS earlier FROM n),
k AS (SELECT user_id, max(n) AS n, sum(sqrt(1 + step * step)) AS length, max(sqrt(i * i + (value - x0) * (value - x0))) AS reach, count(CASE WHEN step * earlier < 0 THEN 1 END) AS turns FROM s GROUP BY user_id),
q AS (SELECT user_id, -sum(p * log2(p)) / log2(6) AS entropy FROM (SELECT user_id, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM n WHERE i <= n - 3 GROUP BY user_id, (value <= b)::INT * 4 + (b <= c)::INT * 2 + (value <= c)::INT) GROUP BY user_id),
m AS (SELECT n.user_id, r.k, sum(abs(n.value - e.value)) * (n.n - 1) / (count(*) * r.k * r.k) AS l FROM n, range(1, 11) AS r(k), ev AS e WHERE e.user_id = n.user_id AND e.i = n.i - r.k AND r.k <= n.n // 4 GROUP BY n.user_id, n.n, r.k, n.i % r.k),
h AS (SELECT user_id, -regr_slope(ln(l + 1e-12::DOUBLE), ln(k)) AS d FROM (SELECT user_id, k, avg(l) AS l FROM m GROUP BY ALL) GROUP BY user_id)
SELECT user_id, round(coalesce(entropy, 0), 6) AS permutation_entropy,
  round(CASE WHEN n < 10 THEN 1 ELSE least(2, greatest(1, log10(n - 1) / (log10(n - 1) + log10(reach / length)))) END, 6) AS katz,
  round(CASE WHEN n < 10 OR turns = 0 THEN 1 ELSE least(2, greatest(1, log10(n) / (log10(n) + log10(n / (n + 0.4::DOUBLE * turns))))) END, 6) AS petrosian,
  round(CASE WHEN n < 20 THEN 1 ELSE least(2, greatest(1, d)) END, 6) AS higuchi FROM k LEFT JOIN q USING (user_id) LEFT JOIN h USING (user_id)"""
_summary("spectrum", G.spectrum, ["dominant", "flatness", "peak_share"])
_summary("complexity", lambda x: {"permutation_entropy": G.permutation_entropy(x), "katz": G.katz(x), "petrosian": G.petrosian(x), "higuchi": G.higuchi(x)}, ["permutation_entropy", "katz", "petrosian", "higuchi"], COMPLEXITY)
_summary("stationarity", lambda x: {"kpss": G.kpss(x), "adf": G.adf(x)}, ["kpss", "adf"])
_summary("dependence", lambda x: {"ksg": G.ksg_mi(x[:-1], x[1:]), "dcor": G.distance_correlation(x[:-1], x[1:]), "hsic": G.hsic(x[:-1], x[1:])}, ["ksg", "dcor", "hsic"])
_summary("arima_forecast", lambda x: {f"h{k + 1}": v for k, v in enumerate(G.auto_arima(x, 3, 7)[0])}, ["h1", "h2", "h3"])
_summary("bayesian_block_count", lambda x: {"blocks": len(G.bayesian_blocks(x)) - 1}, ["blocks"])


@query("signal_permutation_entropy", EV + """,
w AS (SELECT user_id, value AS a, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c, row_number() OVER o AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY i)),
p AS (SELECT user_id, (a <= b)::INT * 4 + (b <= c)::INT * 2 + (a <= c)::INT AS p, count(*) AS k FROM w WHERE r <= n - 2 GROUP BY ALL),
q AS (SELECT user_id, k / sum(k) OVER (PARTITION BY user_id) AS p FROM p)
SELECT user_id, round(-sum(p * log2(p)) / log2(6), 6) AS entropy FROM q GROUP BY user_id""")
def permutation_entropy(t):
    """The ordinal patterns of three by windows alone, without a grouped function."""
    from ..operators.series import Series

    s = Series(("user_id",), ("i",))
    a, b, c = F.col("value"), F.lead("value", 1).over(s.by), F.lead("value", 2).over(s.by)
    w = t.ev.select("user_id", ((a <= b).cast("int") * 4 + (b <= c).cast("int") * 2 + (a <= c).cast("int")).alias("p"), s.position().alias("_i"), s.size().alias("_n")).filter("_i < _n - 2")
    k = w.groupBy("user_id", "p").agg(F.count("*").alias("k"))
    total = k.groupBy("user_id").agg(F.sum("k").alias("t"))
    p = F.col("k") / F.col("t")
    return rounded(k.join(total, "user_id").groupBy("user_id").agg((-F.sum(p * F.log2(p)) / float(np.log2(6))).alias("entropy")))


@query("signal_stl")
def stl(t):
    return rounded(G.decompose_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", lambda x: np.array(G.stl(x, 7))))


@query("signal_vmd")
def vmd(t):
    return rounded(G.decompose_batches(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", lambda x: G.vmd_batch(x, 3)))


@query("signal_emd")
def emd(t):
    return rounded(G.decompose_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", G.emd))


@query("signal_isolation_forest")
def isolation(t):
    return rounded(G.map_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", lambda x: G.isolation_scores(x[:, None]), "score"))


@query("signal_augmentations")
def augmentations(t):
    def every(x):
        return np.array([f(x, np.random.default_rng(k)) for k, f in enumerate(G.AUGMENTATIONS.values())])

    return rounded(G.decompose_series(t.ev.select("user_id", "i", "value"), "user_id", "i", "value", every))

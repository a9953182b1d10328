"""Feature pipelines that create, prune and choose; detectors; intervals of ensembles and of states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain, configure, conformal, detector, select
from ..operators.series import Series
from .registry import EV, query, rounded

_BASE = ["l_quantity", "l_extendedprice", "l_discount"]
_MADE = [f"{a}_{k}_{b}" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")) for k in ("times", "over")]
_ALL = _BASE + _MADE


def _features_sql() -> str:
    """Nine columns in long form; greedy pruning as a recursion over the columns in order of variance; information with the line's tax."""
    values = _BASE + [x for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")) for x in (f"{a}::DOUBLE * {b}", f"{a}::DOUBLE / nullif({b}, 0)")]
    return f"""WITH w AS (SELECT l_orderkey, l_linenumber, l_tax, {", ".join(f"{v} AS {c}" for v, c in zip(values, _ALL, strict=True))} FROM lineitem),
d AS (SELECT row_number() OVER () AS id, * FROM w),
m AS (SELECT id, l_orderkey, l_linenumber, l_tax, unnest({list(range(len(_ALL)))}) AS f, unnest([{", ".join(f"{c}::DOUBLE" for c in _ALL)}]) AS v FROM d),
o AS (SELECT f, row_number() OVER (ORDER BY var_pop(v) DESC, f) AS o FROM m GROUP BY f),
c AS (SELECT a.f AS a, b.f AS b, corr(a.v, b.v) AS r FROM m AS a JOIN m AS b USING (id) WHERE a.f <> b.f GROUP BY ALL),
k AS (WITH RECURSIVE g(o, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.o + 1, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.a = o.f AND list_contains(g.kept, c.b) AND abs(c.r) >= 0.9) THEN g.kept ELSE list_append(g.kept, o.f) END FROM g JOIN o ON o.o = g.o + 1) SELECT unnest(kept) AS f FROM g WHERE o = {len(_ALL)}),
q AS (SELECT f, list_distinct(quantile_cont(v, [i / 16.0 FOR i IN range(1, 16)])) AS q FROM m WHERE v IS NOT NULL GROUP BY f),
t AS (SELECT list_distinct(quantile_cont(l_tax::DOUBLE, [i / 16.0 FOR i IN range(1, 16)])) AS q FROM lineitem),
b AS (SELECT f, len(list_filter(q.q, lambda e: e < v)) AS a, len(list_filter(t.q, lambda e: e < l_tax)) AS y FROM m JOIN q USING (f), t WHERE v IS NOT NULL),
n AS (SELECT f, a, y, count(*)::DOUBLE AS c FROM b GROUP BY ALL),
i AS (SELECT f, greatest(0, sum(c / n * ln(c * n / (na * ny)))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY f) AS n, sum(c) OVER (PARTITION BY f, a) AS na, sum(c) OVER (PARTITION BY f, y) AS ny FROM n) GROUP BY f),
s AS (SELECT f, mi, {_ALL!r}[f + 1] AS feature FROM i JOIN k USING (f) ORDER BY mi DESC, feature LIMIT 3)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, feature, round(v, 4) AS value, round(mi, 6) AS mi FROM m JOIN s USING (f)"""


@query("chain_features", _features_sql())
def chain_features(t):
    """Products and ratios of all pairs, pruned by correlation, the three that tell most of the tax, for every line item; the fitted chain is applied as saved."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", *_BASE)
    steps = chain.Chain(chain.Generate(_BASE), chain.Prune(threshold=0.9), chain.Choose("l_tax", by="information", k=3, threshold=0.0), exclude=["l_orderkey", "l_linenumber", "l_tax"]).fit(d)
    chosen = steps.steps[-1]
    out = chain.Chain.from_json(steps.to_json()).transform(d)
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 4).alias("value"), F.lit(round(chosen.state["scores"][c], 6)).alias("mi")) for c in chosen.kept)))
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), told.alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@query("chain_series_steps", EV + """,
f AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM ev),
d AS (SELECT *, s - lag(s, 2) OVER (PARTITION BY user_id ORDER BY i) AS d, lag(s) OVER (PARTITION BY user_id ORDER BY i) AS s1 FROM f)
SELECT event_id, round(d, 6) AS value, round(CASE WHEN i < 2 THEN s END, 6) AS value_start, round(lag(d) OVER (PARTITION BY user_id ORDER BY i), 6) AS value_lag_1 FROM d""")
def chain_series_steps(t):
    """Every user's events smoothed, differenced at lag 2 and given the difference before."""
    at = (["user_id"], ["i"])
    steps = chain.Chain(chain.Smooth(["value"], *at, width=3), chain.Difference(["value"], *at, lag=2), chain.Lags(["value"], *at, lags=[1]), exclude=["event_id", "i"])
    return rounded(steps.fit_transform(t.ev.select("event_id", "user_id", "i", "value")).select("event_id", "value", "value_start", "value_lag_1"))


@query("chain_series_inverse", EV + """ SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS value FROM ev""")
def chain_series_inverse(t):
    """The steps undone but for the smoothing, whose values come back."""
    at = (["user_id"], ["i"])
    steps = chain.Chain(chain.Smooth(["value"], *at, width=3), chain.Difference(["value"], *at, lag=2), chain.Lags(["value"], *at, lags=[1]))
    d = t.ev.select("event_id", "user_id", "i", "value")
    return rounded(steps.fit(d).inverse(steps.transform(d)).select("event_id", "value"), 4)


@query("select_stable_information", """WITH d AS (SELECT row_number() OVER () AS id, l_returnflag AS y, l_orderkey % 5 AS k, l_quantity, l_extendedprice, l_discount, epoch(l_shipdate::TIMESTAMP) / 86400 AS day FROM lineitem),
m AS (SELECT y, k, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'day']) AS feature, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_discount::DOUBLE, floor(day)::DOUBLE]) AS v FROM d),
q AS (SELECT feature, list_distinct(quantile_cont(v, [i / 8.0 FOR i IN range(1, 8)])) AS q FROM m GROUP BY feature),
b AS (SELECT feature, y, k, len(list_filter(q, lambda e: e < v)) AS a FROM m JOIN q USING (feature)),
s AS (SELECT feature, g.s, a, y, count(*)::DOUBLE AS c FROM b JOIN (SELECT unnest(range(-1, 5)) AS s) AS g ON g.s <> k GROUP BY ALL),
i AS (SELECT feature, s, greatest(0, sum(c / n * ln(c * n / (na * ny)))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY feature, s) AS n, sum(c) OVER (PARTITION BY feature, s, a) AS na, sum(c) OVER (PARTITION BY feature, s, y) AS ny FROM s) GROUP BY ALL)
SELECT feature, round(max(mi) FILTER (s = -1), 6) AS mi, round(avg(mi) FILTER (s >= 0), 6) AS mean, round(min(mi) FILTER (s >= 0), 6) AS low, round(avg((mi >= 0.01)::INT) FILTER (s >= 0), 6) AS stable FROM i GROUP BY feature""")
def stable_information(t):
    d = t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", F.unix_date(F.col("l_shipdate").cast("date")).alias("day"))
    return rounded(select.relevance(d, ["l_quantity", "l_extendedprice", "l_discount", "day"], "l_returnflag", 8, F.col("l_orderkey") % 5))


@query("cluster_counts")
def cluster_counts(t):
    """Clusters of all line items; the tests hold the silhouettes against all pairs."""
    return rounded(select.cluster_counts(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [2, 3, 4, 5]))


@query("anomaly_detector")
def anomaly_detector(t):
    """Every event scored by three scorers over windows of its user's last six values; the tests hold it against NumPy. The fitted detector is applied as saved."""
    d = t.ev.select("event_id", "user_id", "i", "vm")
    fitted = detector.Detector(["user_id"], ["i"], "vm", 6, contamination=0.02).fit(d)
    return rounded(detector.Detector.from_json(fitted.to_json()).predict(d).drop("vm", "i"))


_MEMBERS = 12
_LIMITS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in conformal.poisson_limits()) + "]"


@query("conformal_ensemble_radii", EV + f""", m AS (SELECT user_id, i, value AS y, event_id, unnest(range({_MEMBERS})) AS m FROM ev WHERE value IS NOT NULL),
w AS (SELECT *, len(list_filter({_LIMITS}, lambda p: p <= ('0x' || substr(md5(m || ':' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE))::DOUBLE AS w FROM m),
f AS (SELECT user_id, m, sum(w) AS sw, sum(w * i) AS u, sum(w * y) AS v, sum(w * i * i) AS uu, sum(w * i * y) AS uv FROM w GROUP BY ALL),
l AS (SELECT *, CASE WHEN sw * uu - u * u = 0 THEN 0 ELSE (sw * uv - u * v) / (sw * uu - u * u) END AS b FROM f WHERE sw > 0),
p AS (SELECT user_id, i, any_value(y) AS y, avg((v - b * u) / sw + b * i) FILTER (w = 0) AS o, avg((v - b * u) / sw + b * i) AS a FROM w JOIN l USING (user_id, m) GROUP BY ALL),
r AS (SELECT user_id, abs(y - coalesce(o, a)) AS r FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) <= 50),
k AS (SELECT user_id, r, row_number() OVER (PARTITION BY user_id ORDER BY r) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM r)
SELECT user_id, n, round(r, 5) AS radius FROM k WHERE k = least(n, ceil((n + 1) * 0.9::DOUBLE))""")
def ensemble_radii(t):
    """Every user's events against an ensemble of trends over bootstrap samples."""
    d = conformal.bagged_lines(t.ev.select("user_id", "i", "event_id", "value"), ["user_id"], "event_id", "i", "value", _MEMBERS)
    return rounded(conformal.ensemble_radii(d, ["user_id"], ["i"], "value", 0.1, 50), 5)


@query("conformal_state_radii", EV + """, s AS (SELECT user_id, i, event_id, abs(value - lag(value) OVER w) AS r, 1 / (1 + exp(-(lag(value) OVER w - avg(value) OVER (PARTITION BY user_id)) / 50)) AS p, count(*) OVER (PARTITION BY user_id) AS t FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY i)),
c AS (SELECT user_id, i, r, p FROM s WHERE i < t // 2 AND r IS NOT NULL AND p IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) <= 40),
j AS (SELECT s.event_id, c.r, c.i, exp((s.p * c.p + (1 - s.p) * (1 - c.p)) / 0.2::DOUBLE) AS w FROM s JOIN c USING (user_id) WHERE s.i >= s.t // 2 AND s.p IS NOT NULL),
k AS (SELECT event_id, r, sum(w) OVER (PARTITION BY event_id ORDER BY r, i DESC ROWS UNBOUNDED PRECEDING) - w / 2 AS mid, sum(w) OVER (PARTITION BY event_id) AS t, count(*) OVER (PARTITION BY event_id) AS n FROM j),
q AS (SELECT event_id, coalesce(min(r) FILTER (mid >= least(1.0, ceil((n + 1) * 0.8::DOUBLE) / n) * t), max(r)) AS radius FROM k GROUP BY event_id)
SELECT event_id, round(radius, 6) AS radius FROM s LEFT JOIN q USING (event_id) WHERE i >= t // 2""")
def state_radii(t):
    """The later half of every user's events, with radii from the earlier half, weighted by how alike the levels before them are."""
    from pyspark.sql.window import Window

    every, w = Window.partitionBy("user_id"), Window.partitionBy("user_id").orderBy("i")
    before = F.lag("value").over(w)
    p = 1 / (1 + F.exp(-(before - F.avg("value").over(every)) / 50))
    d = t.ev.select("user_id", "i", "event_id", F.abs(F.col("value") - before).alias("r"), p.alias("p"), F.count("*").over(every).alias("t")).withColumn("state", F.when(F.col("p").isNotNull(), F.array("p", 1 - F.col("p"))))
    early = F.col("i") < F.floor(F.col("t") / 2)
    return rounded(conformal.state_radii(d.filter(early), d.filter(~early).select("user_id", "event_id", "state"), ["user_id"], ["i"], "state", "r", 0.2, 40, 0.2).select("event_id", "radius"))


@query("prepare_configured", EV + """, d AS (SELECT user_id, i, unnest(['value', 'vm', 'square', 'run']) AS feature, unnest([value, vm, value * value, sum(value) OVER (PARTITION BY user_id ORDER BY i)]) AS x FROM ev),
l AS (SELECT *, lag(x) OVER w AS p, lag(x, 2) OVER w AS q, avg(x) OVER (PARTITION BY feature) AS m FROM d WINDOW w AS (PARTITION BY feature, user_id ORDER BY i)),
a AS (SELECT feature, count(*) AS n, avg((x IS NULL)::INT) AS missing, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5::DOUBLE AS skew, avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 AS excess, avg((x = p)::INT) AS repeated, corr(x, p) AS lag1, corr(x - p, p - q) AS turn FROM l GROUP BY feature),
k AS (SELECT *, repeated >= 0.5 AS f, repeated < 0.5 AND lag1 >= 0.95 AS dr, repeated < 0.5 AND lag1 < 0.95 AND turn <= -0.4 AS no FROM a)
SELECT feature, n, round(missing, 6) AS missing, round(skew, 6) AS skew, round(excess, 6) AS excess, round(repeated, 6) AS repeated, round(lag1, 6) AS lag1, round(turn, 6) AS turn,
  CASE WHEN f THEN 'flat' WHEN dr THEN 'drifting' WHEN excess > 3 THEN 'heavy' WHEN abs(skew) > 1 THEN 'skewed' WHEN no THEN 'noisy' ELSE 'steady' END AS archetype,
  concat_ws(' ', CASE WHEN missing > 0 THEN 'Impute' END, CASE WHEN excess > 3 THEN 'Clip' END, CASE WHEN abs(skew) > 1 THEN 'Log' END, CASE WHEN no THEN 'Smooth' END, CASE WHEN dr THEN 'Difference' END, 'Scale') AS steps FROM k""")
def prepare_configured(t):
    """What the events' values, with gaps, squared and summed up along each user's series, are told to need."""
    s = Series(("user_id",), ("i",))
    d = t.ev.select("user_id", "i", "value", "vm", (F.col("value") * F.col("value")).alias("square"), F.sum("value").over(s.past).alias("run"))
    return rounded(configure.decided(configure.measures(d, s, ["value", "vm", "square", "run"])).drop("low"))

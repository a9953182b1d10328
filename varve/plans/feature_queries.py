"""Encoders, date and row features, binning, selection and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import features as X
from ..operators import graph as G
from ..operators import mining as M
from .registry import ORACLES, query, rounded


@query("encode_top_k", """
WITH k AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 8)
SELECT CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'OTHER' END AS brand, count(*) AS n FROM part GROUP BY 1""")
def top_k(t):
    return E.top_k(t.part, "p_brand", 8, "brand").groupBy("brand").agg(F.count("*").alias("n"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("encode_one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::BIGINT AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def one_hot(t):
    return rounded(E.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS).drop("c_mktsegment"))


@query("encode_ordinal", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def ordinal(t):
    return E.apply_map(t.orders, "o_orderpriority", E.ordinal_map(t.orders, "o_orderpriority"), "code", "code", F.lit(-1)).select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("encode_frequency", "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 6) AS freq FROM part")
def frequency(t):
    return rounded(E.apply_map(t.part, "p_brand", E.frequency_map(t.part, "p_brand"), "freq", "freq", F.lit(0.0)).select("p_partkey", "freq"))


@query("encode_hashing")
def hashing(t):
    return t.part.select("p_partkey", E.hashed("p_brand", 16).alias("slot"))


LABELLED = "WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus || (l_suppkey % 20)::VARCHAR AS c, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS y, l_orderkey % 5 AS fold FROM lineitem)"


def labelled(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.concat("l_linestatus", (F.col("l_suppkey") % 20).cast("string")).alias("c"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), (F.col("l_orderkey") % 5).alias("fold"))


@query("encode_kfold_target", LABELLED + """,
p AS (SELECT c, fold, sum(y) AS s, count(y) AS n FROM r GROUP BY ALL),
o AS (SELECT c, fold, sum(s) OVER (PARTITION BY c) - s AS so, sum(n) OVER (PARTITION BY c) - n AS no FROM p),
f AS (SELECT fold, (sum(sum(y)) OVER () - sum(y)) / (sum(count(y)) OVER () - count(y)) AS prior FROM r GROUP BY fold)
SELECT c, fold, count(*) AS n, round(max(coalesce((so + 10 * prior) / (no + 10), prior)), 6) AS encoded FROM r JOIN o USING (c, fold) JOIN f USING (fold) GROUP BY c, fold""")
def kfold(t):
    e = E.kfold_target(labelled(t), "c", "y", "fold", 10.0, "encoded")
    return rounded(e.groupBy("c", "fold").agg(F.count("*").alias("n"), F.max("encoded").alias("encoded")))


@query("encode_leave_one_out", LABELLED + """,
e AS (SELECT c, y, coalesce((sum(y) OVER (PARTITION BY c) - y) / nullif(count(y) OVER (PARTITION BY c) - 1, 0), avg(y) OVER ()) AS e FROM r)
SELECT c, y, count(*) AS n, round(avg(e), 6) AS encoded FROM e GROUP BY c, y""")
def loo(t):
    return rounded(E.leave_one_out(labelled(t), "c", "y", "encoded").groupBy("c", "y").agg(F.count("*").alias("n"), F.avg("encoded").alias("encoded")))


@query("encode_james_stein", LABELLED + """,
g AS (SELECT c, avg(y) AS m, count(y) AS n, coalesce(var_samp(y), 0) AS v FROM r GROUP BY c), p AS (SELECT avg(y) AS p, var_samp(y) AS s2 FROM r)
SELECT c AS category, round((1 - b) * p + b * m, 6) AS value FROM (SELECT *, least(1, greatest(0, coalesce(s2 / nullif(s2 + v / n, 0), 0))) AS b FROM g, p)""")
def james_stein(t):
    return rounded(E.james_stein_map(labelled(t), "c", "y"))


@query("encode_woe", LABELLED + """,
g AS (SELECT c AS category, sum(y) AS e, sum(1 - y) AS x FROM r GROUP BY c), s AS (SELECT sum(e) AS te, sum(x) AS tx, count(*) AS k FROM g),
q AS (SELECT category, (e + 0.5::DOUBLE) / (te + 0.5::DOUBLE * k) AS pe, (x + 0.5::DOUBLE) / (tx + 0.5::DOUBLE * k) AS px FROM g, s)
SELECT category, round(ln(pe / px), 6) AS woe, round((pe - px) * ln(pe / px), 8) AS iv_part FROM q""")
def woe(t):
    w = E.woe_map(labelled(t), "c", F.col("y") == 1)
    return w.select("category", F.round("woe", 6).alias("woe"), F.round("iv_part", 8).alias("iv_part"))


@query("encode_ordered_target", LABELLED + """
SELECT c, count(*) AS n, round(avg(e), 6) AS mean FROM (SELECT c, (coalesce(sum(y) OVER w, 0) + 0.3::DOUBLE * 5) / (count(y) OVER w + 5) AS e FROM r
WINDOW w AS (PARTITION BY c ORDER BY l_orderkey, l_partkey, l_linenumber, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY c""")
def ordered_target(t):
    e = labelled(t).withColumn("e", E.ordered_target("c", "y", ["l_orderkey", "l_partkey", "l_linenumber", "y"], 0.3, 5.0))
    return rounded(e.groupBy("c").agg(F.count("*").alias("n"), F.avg("e").alias("mean")))


@query("feature_date_parts", """
SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, day(o_orderdate)::BIGINT AS day, (isodow(o_orderdate) - 1)::BIGINT AS weekday, quarter(o_orderdate)::BIGINT AS quarter, hour(o_orderdate)::BIGINT AS hour,
  dayofyear(o_orderdate)::BIGINT AS dayofyear, weekofyear(o_orderdate)::BIGINT AS isoweek, isoyear(o_orderdate)::BIGINT AS isoyear FROM orders""")
def date_parts(t):
    return rounded(t.orders.select("o_orderkey", *(v.alias(k) for k, v in X.date_parts("o_orderdate").items())))


@query("feature_date_flags", """
WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, (isodow(d) >= 6)::BIGINT AS is_weekend, (day(d) = 1)::BIGINT AS is_month_start, (d = last_day(d))::BIGINT AS is_month_end, (day(d) = 1 AND month(d) IN (1, 4, 7, 10))::BIGINT AS is_quarter_start,
  (d = last_day(d) AND month(d) IN (3, 6, 9, 12))::BIGINT AS is_quarter_end, (day(d) = 1 AND month(d) = 1)::BIGINT AS is_year_start, (day(d) = 31 AND month(d) = 12)::BIGINT AS is_year_end FROM d""")
def date_flags(t):
    return rounded(t.orders.select("o_orderkey", *(v.alias(k) for k, v in X.date_flags("o_orderdate").items())))


def _cyc(name, value, period):
    return f"round(sin(2 * pi() * ({value}) / {period}), 6) AS {name}_sin, round(cos(2 * pi() * ({value}) / {period}), 6) AS {name}_cos"


@query("feature_cyclic_dates", "SELECT event_id, " + ", ".join((_cyc("hour_of_week", "(isodow(ts) - 1) * 24 + hour(ts)", 168), _cyc("day_of_year", "dayofyear(ts)", "365.2425::DOUBLE"), _cyc("month", "month(ts)", 12), _cyc("isoweek", "weekofyear(ts)", 53))) + " FROM events")
def cyclic_dates(t):
    return rounded(t.events.select("event_id", *(v.alias(k) for k, v in X.cyclic_dates("ts").items())))


@query("feature_handler_time", "SELECT event_id, " + ", ".join((_cyc("month", "month(ts) - 1", 12), _cyc("day", "day(ts) - 1", 31), _cyc("weekday", "isodow(ts) - 1", 7), _cyc("hour", "hour(ts)", 24))) + " FROM events")
def handler_time(t):
    return rounded(t.events.select("event_id", *(v.alias(k) for k, v in X.handler_time_features("ts").items())))


@query("feature_elapsed", "SELECT event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6::DOUBLE, 3) AS elapsed_s, floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6::DOUBLE / 86400)::BIGINT AS elapsed_days FROM events")
def elapsed(t):
    return X.elapsed(t.events, "ts", "user_id").select("event_id", F.round("elapsed_s", 3).alias("elapsed_s"), F.col("elapsed_days").cast("long").alias("elapsed_days"))


@query("feature_math_transforms", "WITH e AS (SELECT event_id, value - 20 AS x FROM events) SELECT event_id, round(CASE WHEN x > 0 THEN ln(1 + x) END, 6) AS log1p, round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS sqrt, round(CASE WHEN abs(x) > 1e-8 THEN 1 / x END, 6) AS reciprocal, round(sign(x) * ln(1 + abs(x)), 6) AS signed_log, round(ln(x + sqrt(x * x + 1)), 6) AS asinh FROM e")
def maths(t):
    return rounded(t.events.withColumn("x", F.col("value") - 20).select("event_id", *(v.alias(k) for k, v in X.math_transforms("x").items())))


@query("feature_polynomials", "SELECT p_partkey, p_size * p_size::DOUBLE AS square, p_size * p_size * p_size::DOUBLE AS cube, round(sqrt(abs(p_size)), 6) AS root, round(1 / (abs(p_size) + 1e-8::DOUBLE), 6) AS inverse FROM part")
def polynomials(t):
    return rounded(t.part.select("p_partkey", *(v.alias(k) for k, v in X.polynomials("p_size").items())))


@query("feature_yeo_johnson", "WITH e AS (SELECT event_id, value - 20 AS x FROM events) SELECT event_id, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 6) AS z, round(x, 6) AS x FROM e")
def yeo_johnson(t):
    e = t.events.select("event_id", X.yeo_johnson(F.col("value") - 20, 0.5).alias("z"))
    return rounded(e.withColumn("x", X.yeo_johnson_inverse(F.col("z"), 0.5)))


@query("feature_interactions", """
WITH e AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS x, l_discount AS y FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, round(x + y, 6) AS sum, round(x - y, 6) AS diff, round(x * y, 6) AS prod, round(x / nullif(y, 0), 6) AS ratio, round((x - y) / nullif(abs(x) + abs(y), 0), 6) AS norm_ratio, least(x, y) AS min, greatest(x, y) AS max,
  round(ln(1 + abs(x)) - ln(1 + abs(y)), 6) AS log_ratio, round(sqrt(abs(x * y)), 6) AS root_prod FROM e""")
def interactions(t):
    return rounded(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", *(v.alias(k) for k, v in X.interactions("l_quantity", "l_discount").items())))


@query("feature_row_statistics", """
WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, CASE WHEN vec_id % 3 <> 0 THEN embedding[2]::DOUBLE END AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
l AS (SELECT vec_id, unnest([a, b, c, d]) AS v FROM e)
SELECT vec_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, count(v) AS present, round(1 - count(v) / 4, 6) AS null_ratio FROM l GROUP BY vec_id""")
def row_statistics(t):
    e = t.embeddings.select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abcd"))).withColumn("b", F.when(F.col("vec_id") % 3 != 0, F.col("b")))
    return rounded(e.select("vec_id", *(v.alias(k) for k, v in X.row_statistics(list("abcd")).items())))


@query("feature_winsorize", "WITH q AS (SELECT quantile_cont(l_quantity, 0.05) AS a, quantile_cont(l_quantity, 0.95) AS b FROM lineitem) SELECT least(greatest(l_quantity, a), b) AS l_quantity, count(*) AS n FROM lineitem, q GROUP BY 1")
def winsorize(t):
    return X.winsorize(t.lineitem, ["l_quantity"], 0.05).groupBy("l_quantity").agg(F.count("*").alias("n"))


def _log_state(c):
    return f"SELECT '{c}' AS feature, abs(avg(pow({c} - m, 3)) / pow(max(s), 3)) > 1 OR kurtosis_pop({c}) > 5 AS skewed, round(greatest(0, 1 - min({c})), 6) AS \"offset\" FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)"


@query("feature_selective_log", " UNION ALL ".join(map(_log_state, ("l_quantity", "l_extendedprice", "l_discount"))))
def selective_log(t):
    return rounded(X.selective_log_state(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query("feature_scale_robust", "WITH q AS (SELECT user_id, quantile_cont(value, 0.05) AS a, median(value) AS m, quantile_cont(value, 0.95) AS b FROM events GROUP BY user_id) SELECT event_id, round(coalesce((value - m) / nullif(b - a, 0), 0), 6) AS scaled FROM events JOIN q USING (user_id)")
def scale(t):
    return rounded(X.scale(t.events, ["user_id"], "value", "robust").select("event_id", "scaled"))


@query("feature_scale_standard", "SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def standard(t):
    return rounded(X.scale(t.events, ["user_id"], "value", "standard").select("event_id", "scaled"))


BINS = """WITH s AS (SELECT count(value) AS n, min(value) AS a, max(value) AS b, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
k AS (SELECT a, b, least(100, greatest(1, {0}))::BIGINT AS k FROM s)
SELECT least(coalesce(floor((value - a) * k / nullif(b - a, 0)), 0), k - 1)::BIGINT AS bin, k AS bins, count(*) AS n FROM events, k GROUP BY ALL"""


@query("binning_freedman_diaconis", BINS.format("ceil((b - a) * cbrt(n) / (2 * iqr))"))
def fd(t):
    return X.equal_width(t.events, "value", "fd").groupBy("bin", "bins").agg(F.count("*").alias("n"))


@query("binning_sturges", BINS.format("ceil(log2(n)) + 1"))
def sturges(t):
    return X.equal_width(t.events, "value", "sturges").groupBy("bin", "bins").agg(F.count("*").alias("n"))


@query("binning_quantile", "WITH e AS (SELECT unnest(quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS e FROM events), b AS (SELECT event_id, count(CASE WHEN e <= value THEN 1 END) AS bin FROM events, e GROUP BY event_id) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def quantile_bins(t):
    return X.quantile_bins(t.events, "value", 8).groupBy("bin").agg(F.count("*").alias("n"))


@query("binning_entropy_cut", """
WITH p AS (SELECT l_quantity AS x, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p FROM lineitem GROUP BY 1),
r AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS l, sum(p) OVER (ORDER BY x) AS lp, sum(n) OVER () AS t, sum(p) OVER () AS tp FROM p),
q AS (SELECT *, lp / l AS ql, (tp - lp) / (t - l) AS qr, tp / t AS q FROM r WHERE nx IS NOT NULL),
h AS (SELECT *, -(q * log2(q) + (1 - q) * log2(1 - q)) AS h, -CASE WHEN ql > 0 AND ql < 1 THEN ql * log2(ql) + (1 - ql) * log2(1 - ql) ELSE 0 END AS hl, -CASE WHEN qr > 0 AND qr < 1 THEN qr * log2(qr) + (1 - qr) * log2(1 - qr) ELSE 0 END AS hr FROM q),
g AS (SELECT *, h - l / t * hl - (t - l) / t * hr AS gain, (log2(t - 1) + log2(7) - (2 * h - ((lp > 0)::INT + (lp < l)::INT) * hl - ((tp - lp > 0)::INT + (tp - lp < t - l)::INT) * hr)) / t AS cost FROM h)
SELECT (x + nx) / 2 AS cut, round(gain, 9) AS gain, gain > cost AS accepted FROM g ORDER BY round(gain, 9) DESC, cut LIMIT 1""")
def entropy_cut(t):
    c = X.best_cut(t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int")), "l_quantity", "y")
    return rounded(c, 9)


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PRICE = "WITH e AS (SELECT l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


@query("select_correlated", PRICE + """,
p AS (SELECT 'l_extendedprice' AS feature_a, 'net' AS feature_b, corr(l_extendedprice, net) AS value, var_samp(l_extendedprice) AS va, var_samp(net) AS vb FROM e UNION ALL SELECT 'l_quantity', 'net', corr(l_quantity, net), var_samp(l_quantity), var_samp(net) FROM e UNION ALL SELECT 'l_discount', 'net', corr(l_discount, net), var_samp(l_discount), var_samp(net) FROM e
  UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice), var_samp(l_quantity), var_samp(l_extendedprice) FROM e UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount), var_samp(l_quantity), var_samp(l_discount) FROM e UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount), var_samp(l_extendedprice), var_samp(l_discount) FROM e)
SELECT feature_a, feature_b, round(value, 6) AS value, CASE WHEN va < vb THEN feature_a ELSE feature_b END AS drop FROM p WHERE abs(value) >= 0.5""")
def correlated(t):
    e = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return rounded(X.correlated(e, ["l_quantity", "l_extendedprice", "l_discount", "net"], 0.5))


@query("select_split_gain", """
WITH r AS (SELECT min(l_quantity) AS qa, max(l_quantity) AS qb, min(l_extendedprice) AS pa, max(l_extendedprice) AS pb FROM lineitem),
x AS (SELECT 'l_quantity' AS feature, least(floor((l_quantity - qa) * 16 / (qb - qa)), 15)::BIGINT AS bin, l_tax - 0.04::DOUBLE AS g FROM lineitem, r UNION ALL SELECT 'l_extendedprice', least(floor((l_extendedprice - pa) * 16 / (pb - pa)), 15)::BIGINT, l_tax - 0.04::DOUBLE FROM lineitem, r),
h AS (SELECT feature, bin, sum(g) AS g, count(*) AS h FROM x GROUP BY ALL),
s AS (SELECT feature, bin, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM h WINDOW w AS (PARTITION BY feature ORDER BY bin)),
k AS (SELECT feature, bin, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM s WHERE hl < ht)
SELECT feature, bin, round(gain, 4) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 4) DESC, bin) AS r FROM k) WHERE r = 1""")
def split_gain(t):
    d = t.lineitem.select("l_quantity", "l_extendedprice", (F.col("l_tax") - 0.04).alias("g"))
    return rounded(X.split_gain(d, ["l_quantity", "l_extendedprice"], "g", 16), 4)


EDGES = "WITH e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT o_custkey % 300 AS a, o_orderkey % 211 + 300 AS b FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_custkey % 300, (o_orderkey * 7) % 300 FROM orders WHERE o_orderkey % 5 = 0) WHERE a <> b)"


def edges(t):
    """Two fifths of the orders, on at most 511 nodes, as EDGES has them; edges_all has every row and key."""
    o = t.orders
    a = o.filter("o_orderkey % 4 = 0").select((F.col("o_custkey") % 300).alias("src"), (F.col("o_orderkey") % 211 + 300).alias("dst"))
    b = o.filter("o_orderkey % 5 = 0").select((F.col("o_custkey") % 300).alias("src"), ((F.col("o_orderkey") * 7) % 300).alias("dst"))
    return G.undirected(a.unionByName(b))


@query("graph_degrees", EDGES + " SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node")
def degrees(t, edges=edges):
    return G.degrees(edges(t))


@query("graph_clustering", EDGES + """,
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY src),
t AS (SELECT x.src AS node, count(*) AS triangles FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN e ON e.src = x.dst AND e.dst = y.dst GROUP BY x.src)
SELECT node, degree, coalesce(triangles, 0) AS triangles, round(coalesce(2 * coalesce(triangles, 0) / nullif(degree * (degree - 1), 0), 0), 6) AS clustering FROM d LEFT JOIN t USING (node)""")
def clustering(t, edges=edges):
    return rounded(G.clustering(edges(t)))


@query("graph_message_passing", EDGES + ", n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT n.node, coalesce(sum(e.src % 10)::DOUBLE, 0) AS message FROM n LEFT JOIN e ON e.dst = n.node GROUP BY n.node")
def messages(t, edges=edges):
    e = edges(t)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("v", (F.col("node") % 10).cast("double"))
    return G.message_passing(e, nodes, "v")


@query("graph_gcn_weights", EDGES + """,
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), s AS (SELECT src, dst FROM b UNION ALL SELECT DISTINCT src, src FROM b), d AS (SELECT src AS node, count(*) AS d FROM s GROUP BY src)
SELECT s.src, s.dst, round(1 / sqrt(x.d * y.d), 6) AS weight FROM s JOIN d x ON x.node = s.src JOIN d y ON y.node = s.dst""")
def gcn(t, edges=edges):
    return rounded(G.gcn_weights(edges(t)))


#: Customer, order and part keys as nodes 3 key, 3 key + 1 and 3 key + 2, of every order and line item.
EDGES_ALL = """WITH l AS (SELECT o_custkey * 3 AS c, o_orderkey * 3 + 1 AS o, l_partkey * 3 + 2 AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT NULL, l_orderkey * 3 + 1, l_partkey * 3 + 2 FROM lineitem),
e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT c AS a, o AS b FROM l UNION ALL SELECT o, p FROM l UNION ALL SELECT c, p FROM l) WHERE a IS NOT NULL AND b IS NOT NULL)"""


def edges_all(t):
    return G.undirected(links(t))


def links(t):
    """Customer and order, order and part, customer and part of all rows, on their real keys; each line item closes a triangle. Repeated, for operators that
    take the distinct ones themselves."""
    c, o, p = F.col("o_custkey") * 3, F.col("o_orderkey") * 3 + 1, F.col("l_partkey") * 3 + 2
    orders, lines = t.orders, t.lineitem.select("l_orderkey", "l_partkey")
    own = orders.select(c.alias("src"), o.alias("dst"))
    holds = lines.select((F.col("l_orderkey") * 3 + 1).alias("src"), p.alias("dst"))
    buys = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(c.alias("src"), p.alias("dst"))
    return own.unionByName(holds).unionByName(buys)


for _name, _f in (("graph_degrees", degrees), ("graph_clustering", clustering), ("graph_message_passing", messages), ("graph_gcn_weights", gcn)):
    query(f"{_name}_all", ORACLES[_name].replace(EDGES, EDGES_ALL))(lambda t, f=_f: f(t, edges_all))


@query("graph_page_rank")
def page_rank(t):
    return rounded(G.page_rank(edges_all(t), 5))


CORR = "coalesce(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0), 0)"


@query("graph_threshold_network", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS dst, round(abs({CORR.format(a, b)}), 6) AS weight FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :]) + ") WHERE weight >= 0.004")
def network(t):
    return rounded(G.threshold_network(M.pearson(t.lineitem, COLS), 0.004))


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS dst, 1 - abs(corr({a}, {b})) AS d FROM lineitem" for i, a in enumerate(COLS) for b in COLS[i + 1 :])


@query("graph_nearest_columns", f"""WITH p AS ({PAIRS}), e AS (SELECT src, dst, d FROM p UNION ALL SELECT dst, src, d FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS k FROM e)
SELECT src, dst, round(1 / (1 + d), 6) AS weight FROM r WHERE k <= 2""")
def nearest(t):
    return rounded(G.nearest(M.pearson(t.lineitem, COLS).withColumn("value", 1 - F.abs("value")), 2))


@query("window_sessions", """
WITH g AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, value, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def sessions(t):
    s = t.events.groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("window_tumbling", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(t):
    s = t.events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))

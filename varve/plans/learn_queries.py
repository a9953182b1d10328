"""Boosting, nearest neighbours, recursive partitions, graph structure and streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import shared_folder
from ..operators import boost, concordance, encode, graph, neighbours, partition, wrapper
from ..streaming import conformal, ingest
from .feature_queries import EDGES_ALL, edges_all, links
from .registry import query, rounded


@query("select_boosted")
def boosted(t):
    """Net price of each line item from four columns and its supplier's balance, by boosted trees; see the tests for the booster that it equals."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", (F.col("l_partkey") % 97).cast("double").alias("part"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    columns = ["l_quantity", "l_discount", "l_tax", "part"]
    return rounded(boost.fit(d, columns, "net", rounds=3, rate=0.3, bins=16).predict(d).select("l_orderkey", "l_linenumber", "prediction"), 4)


#: Parts as points of whole numbers, so that squared distances are exact and ties are ties.
POINTS = "WITH p AS (SELECT p_partkey AS id, (p_size * 2000)::DOUBLE AS a, round(p_retailprice * 100) AS b FROM part), n AS (SELECT l.id, r.id AS near, (l.a - r.a) * (l.a - r.a) + (l.b - r.b) * (l.b - r.b) AS d2, row_number() OVER (PARTITION BY l.id ORDER BY (l.a - r.a) * (l.a - r.a) + (l.b - r.b) * (l.b - r.b), r.id) AS rank FROM p AS l JOIN p AS r ON l.id <> r.id)"


def points(t):
    return t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2000).cast("double").alias("a"), F.round(F.col("p_retailprice") * 100).alias("b"))


@query("neighbours_nearest", POINTS + " SELECT id, near, round(sqrt(d2), 6) AS distance, rank FROM n WHERE rank <= 5")
def nearest(t):
    return rounded(neighbours.nearest_rows(points(t), "id", ["a", "b"], 5))


@query("neighbours_lof", POINTS + """,
k AS (SELECT id, near, sqrt(d2) AS d, max(sqrt(d2)) OVER (PARTITION BY id) AS reach FROM n WHERE rank <= 20),
r AS (SELECT DISTINCT id AS near, reach FROM k),
l AS (SELECT k.id, 1 / (avg(greatest(k.d, r.reach)) + 1e-10::DOUBLE) AS lrd FROM k JOIN r USING (near) GROUP BY k.id)
SELECT k.id, round(avg(x.lrd) / any_value(y.lrd), 6) AS lof FROM k JOIN l AS x ON x.id = k.near JOIN l AS y ON y.id = k.id GROUP BY k.id""")
def lof(t):
    return rounded(neighbours.local_outlier_factor(points(t), "id", ["a", "b"], 20))


@query("neighbours_impute", """WITH p AS (SELECT p_partkey AS id, (p_size * 2000)::DOUBLE AS a, CASE WHEN p_partkey % 5 <> 0 THEN round(p_retailprice * 100) END AS b FROM part),
n AS (SELECT l.id, r.b, row_number() OVER (PARTITION BY l.id ORDER BY abs(l.a - r.a), r.id) AS rank FROM p AS l JOIN p AS r ON l.b IS NULL AND r.b IS NOT NULL),
f AS (SELECT id, avg(b) AS b FROM n WHERE rank <= 5 GROUP BY id)
SELECT id, round(coalesce(p.b, f.b), 6) AS b FROM p LEFT JOIN f USING (id)""")
def impute(t):
    return rounded(neighbours.impute_nearest(points(t).withColumn("b", F.when(F.col("id") % 5 != 0, F.col("b"))), "id", ["a", "b"]).select("id", "b"))


@query("binning_mdlp")
def mdlp(t):
    """Cuts of three columns by the discount's value in classes, over every line item; see the tests for the recursion that they equal."""
    d = t.lineitem.select("l_extendedprice", "l_discount", "l_quantity", F.least(F.floor(F.col("l_extendedprice") * F.col("l_discount") / 800), F.lit(5)).alias("class"))
    return rounded(partition.mdlp_cuts(d, ["l_extendedprice", "l_discount", "l_quantity"], "class"))


@query("binning_weighted", """WITH r AS (SELECT l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS w, sum(w) OVER () AS t FROM r)
SELECT q.i AS edge, round(min(v), 6) AS value FROM c, range(1, 16) AS q(i) WHERE w >= q.i / 16.0::DOUBLE * t * (1 - 1e-12::DOUBLE) GROUP BY q.i""")
def weighted(t):
    q = partition.weighted_quantiles(t.lineitem, ["l_extendedprice"], "l_quantity", [i / 16 for i in range(1, 16)])
    return rounded(q.select(F.posexplode("q").alias("edge", "value")).select((F.col("edge") + 1).alias("edge"), "value"))


@query("graph_components", EDGES_ALL.replace("WITH l", "WITH RECURSIVE l") + """,
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
r AS (SELECT 0 AS i, src AS node, src AS c FROM b GROUP BY src UNION ALL SELECT r.i + 1, b.dst, least(min(r.c), b.dst) FROM r JOIN b ON b.src = r.node WHERE r.i < 24 GROUP BY r.i, b.dst)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def components(t):
    return graph.components(links(t))


@query("graph_topology", EDGES_ALL.replace("WITH l", "WITH RECURSIVE l") + """,
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), d AS (SELECT src AS node, count(*) AS k FROM b GROUP BY src),
r AS (SELECT 0 AS i, src AS node, src AS c FROM b GROUP BY src UNION ALL SELECT r.i + 1, b.dst, least(min(r.c), b.dst) FROM r JOIN b ON b.src = r.node WHERE r.i < 24 GROUP BY r.i, b.dst),
p AS (SELECT c, count(*) AS n FROM (SELECT node, min(c) AS c FROM r GROUP BY node) GROUP BY c),
t AS (SELECT count(*) AS t FROM e AS x JOIN e AS y ON x.dst = y.src JOIN e AS z ON z.src = x.src AND z.dst = y.dst),
s AS (SELECT count(*) AS n, sum(k)::DOUBLE / 2 AS m, sum(k * (k - 1))::DOUBLE / 2 AS w FROM d)
SELECT n AS nodes, m::BIGINT AS edges, round(2 * m / (n * (n - 1)::DOUBLE), 6) AS density, round(2 * m / n, 6) AS mean_degree, (SELECT count(*) FROM p) AS components, (SELECT max(n) FROM p) AS largest, t AS triangles, round(3 * t / w, 6) AS transitivity FROM s, t""")
def topology(t):
    return rounded(graph.topology(links(t)))


@query("graph_communities")
def communities(t):
    """Over every customer, order and part, until no level gains; see the tests for planted communities and their modularity."""
    return graph.communities(edges_all(t))


@query("graph_betweenness")
def betweenness(t):
    """From eight sources to every node; see the tests for all sources against brute force."""
    return rounded(graph.betweenness(edges_all(t), 8))


@query("select_all_relevant")
def all_relevant(t):
    """Of four columns of every line item those that bear on the net price, against shuffled shadows."""
    d = t.lineitem.select("l_quantity", "l_discount", "l_extendedprice", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    return rounded(wrapper.all_relevant(d, ["l_quantity", "l_discount", "l_extendedprice", "l_tax"], "net", 3, 0.5, rounds=2, depth=3, bins=16, rate=0.5).select("feature", "hits", "tries", "decision"))


@query("select_eliminated")
def eliminated(t):
    d = t.part.select("p_size", (F.col("p_partkey") % 13).cast("double").alias("noise"), F.floor(F.col("p_partkey") / 10).cast("double").alias("tens"), "p_retailprice")
    return rounded(wrapper.eliminated(d, ["p_size", "noise", "tens"], "p_retailprice", 2, rounds=2, depth=2, bins=16, rate=0.5), 2)


def forecasts(t):
    """Each event with the mean of its user's events before it as prediction."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("user_id", "event_id", "ts", "value", F.avg("value").over(w).alias("prediction"))


@query("stream_conformal")
def stream_conformal(t):
    """Intervals of every event, each from what its user's events showed before it; see the tests for the stream, its restart and brute force."""
    return rounded(conformal.intervals_batch(forecasts(t), "user_id", "event_id", "ts", "value", "prediction"))


@query("stream_coverage")
def stream_coverage(t):
    rows = conformal.intervals_batch(forecasts(t), "user_id", "event_id", "ts", "value", "prediction")
    return rounded(conformal.coverage_of(rows))


@query("stream_ingest_latest", "SELECT user_id::VARCHAR AS run_id, event_type AS key, round(arg_max(value, event_id), 6) AS value, max(event_id) AS step FROM events GROUP BY 1, 2")
def stream_ingest_latest(t):
    """Every event as a metric row through the live ingest into a fresh store, and the newest value of each run and key."""
    folder = f"{shared_folder(t.spark)}/varve-ingest-{uuid.uuid4().hex}"
    rows = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{t.folder}/events.parquet")
    store = ingest.Store(t.spark, f"{folder}/store")
    shaped = rows.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("key"), "value", F.col("ts").alias("timestamp"), F.col("event_id").alias("step"))
    ingest.run(shaped, store, f"{folder}/checkpoint", "365 days")
    return rounded(store.latest().select("run_id", "key", "value", "step"))


@query("mining_kendall_all", """WITH s AS (SELECT sign(l.p_size - r.p_size) AS a, sign(l.p_retailprice - r.p_retailprice) AS b FROM part AS l JOIN part AS r ON l.p_partkey < r.p_partkey)
SELECT (SELECT count(*) FROM part) AS n, count(*) FILTER (a * b > 0) AS concordant, count(*) FILTER (a * b < 0) AS discordant, round(sum(a * b) / sqrt(sum(abs(a))::DOUBLE * sum(abs(b))::DOUBLE), 6) AS tau FROM s""")
def kendall_all(t):
    return rounded(concordance.whole_kendall(t.part, "p_size", "p_retailprice"))


@query("encode_time_folds", """WITH o AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
f AS (SELECT *, greatest(0, floor((i - (n - 4 * floor(n / 5))) / floor(n / 5)) + 1)::BIGINT AS fold FROM o),
g AS (SELECT c, fold, sum(y) AS s, count(*) AS k FROM f GROUP BY ALL),
p AS (SELECT c, fold, coalesce(sum(s) OVER w, 0) AS s, coalesce(sum(k) OVER w, 0) AS k FROM g WINDOW w AS (PARTITION BY c ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT fold, sum(sum(s)) OVER w / sum(sum(k)) OVER w AS prior FROM g GROUP BY fold WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, fold, round((s + 5 * coalesce(prior, (SELECT avg(y) FROM o))) / (k + 5), 4) AS encoded FROM f JOIN p USING (c, fold) JOIN h USING (fold)""")
def encode_time_folds(t):
    d = encode.time_folds(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"), "o_orderdate", "o_orderkey", 4)
    return rounded(encode.forward_target(d, "o_orderpriority", "o_totalprice", "fold", 5.0, "encoded").select("o_orderkey", "fold", "encoded"), 4)


@query("encode_group_folds", """WITH o AS (SELECT o_orderkey, o_orderpriority AS c, o_totalprice AS y, (dense_rank() OVER (ORDER BY o_custkey) - 1) % 5 AS fold FROM orders),
g AS (SELECT c, fold, sum(y) AS s, count(*) AS k FROM o GROUP BY ALL),
p AS (SELECT c, fold, sum(s) OVER (PARTITION BY c) - s AS s, sum(k) OVER (PARTITION BY c) - k AS k FROM g),
h AS (SELECT fold, (sum(sum(s)) OVER () - sum(s)) / (sum(sum(k)) OVER () - sum(k)) AS prior FROM g GROUP BY fold)
SELECT o_orderkey, fold, round((s + 5 * prior) / (k + 5), 4) AS encoded FROM o JOIN p USING (c, fold) JOIN h USING (fold)""")
def encode_group_folds(t):
    d = encode.group_folds(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey"), "o_custkey", 5)
    return rounded(encode.kfold_target(d, "o_orderpriority", "o_totalprice", "fold", 5.0, "encoded").select("o_orderkey", "fold", "encoded"), 4)

"""Run-store queries: experiments from nations, runs from orders, metrics and params from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import dealt
from ..operators import tracker as T
from .registry import ORACLES, query, rounded

VIEWS = """WITH experiments AS (SELECT n_nationkey::BIGINT AS experiment_id, n_name AS name FROM nation),
runs AS (SELECT 'r' || o_orderkey AS run_id, o_custkey % 25 AS experiment_id, 'Run ' || o_orderpriority AS name, CASE o_orderstatus WHEN 'F' THEN 'FINISHED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, o_orderdate AS start_time,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 5000) END AS end_time FROM orders),
metrics AS (SELECT 'r' || l_orderkey AS run_id, k.key, CASE k.key WHEN 'loss' THEN l_discount WHEN 'accuracy' THEN l_tax ELSE l_quantity END AS value, l_shipdate AS timestamp, l_linenumber::BIGINT AS step FROM lineitem, unnest(['loss', 'accuracy', 'batch']) AS k(key)),
params AS (SELECT DISTINCT 'r' || l_orderkey AS run_id, 'p' || l_linenumber AS key, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE (l_partkey % 7)::VARCHAR END AS value FROM lineitem WHERE l_suppkey % 10 = 0)"""


def experiments(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("experiment_id"), F.col("n_name").alias("name"))


def runs(t):
    status = F.when(F.col("o_orderstatus") == "F", "FINISHED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    end = F.when(F.col("o_orderstatus") != "O", F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 5000)"))
    return t.orders.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"), (F.col("o_custkey") % 25).alias("experiment_id"), F.concat(F.lit("Run "), "o_orderpriority").alias("name"), status.alias("status"), F.col("o_orderdate").alias("start_time"), end.alias("end_time"))


def metrics(t, spread=False):
    """spread: in as many tasks as shuffle partitions, a run's rows in one, before a line item becomes three rows."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("loss", "l_discount"), ("accuracy", "l_tax"), ("batch", "l_quantity"))))).alias("m")
    lines = t.lineitem.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_linenumber").cast("long").alias("step"), "l_discount", "l_tax", "l_quantity")
    return (dealt(lines, "run_id") if spread else lines).select("run_id", "timestamp", "step", each).select("run_id", "m.key", "m.value", "timestamp", "step")


def params(t):
    """Those of every tenth supplier's line items, as the view in VIEWS has them; params_all has every line item's."""
    return _params(t.lineitem.filter(F.col("l_suppkey") % 10 == 0))


def params_all(t):
    return _params(t.lineitem)


def _params(lines):
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise((F.col("l_partkey") % 7).cast("string"))
    return lines.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("key"), value.alias("value")).distinct()


@query("tracker_filter_runs", VIEWS + " SELECT run_id, experiment_id, status FROM runs WHERE experiment_id = 3 AND status = 'FINISHED' AND start_time >= '1996-01-01' AND (name ILIKE '%HIGH%' OR run_id ILIKE '%HIGH%')")
def filter_runs(t):
    return T.filter_runs(runs(t), 3, "FINISHED", since="1996-01-01", text="high").select("run_id", "experiment_id", "status")


@query("tracker_overview", VIEWS + """
SELECT count(*) AS runs, count(CASE WHEN status = 'FINISHED' THEN 1 END) AS finished, count(CASE WHEN status = 'FAILED' THEN 1 END) AS failed, count(CASE WHEN status = 'RUNNING' THEN 1 END) AS running, count(DISTINCT experiment_id) AS experiments,
  round(count(CASE WHEN status = 'FINISHED' THEN 1 END)::DOUBLE / nullif(count(CASE WHEN status IN ('FINISHED', 'FAILED') THEN 1 END), 0), 6) AS success_rate, round(avg(epoch(coalesce(end_time, TIMESTAMP '2002-01-01')) - epoch(start_time)), 3) AS mean_seconds FROM runs""")
def overview(t):
    return T.overview(runs(t), "2002-01-01 00:00:00").withColumn("success_rate", F.round("success_rate", 6)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query("tracker_status_histogram", VIEWS + " SELECT status, count(*) AS n FROM runs GROUP BY status")
def status(t):
    return runs(t).groupBy("status").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("tracker_experiments", VIEWS + " SELECT e.experiment_id, e.name, count(run_id) AS runs, max(start_time)::VARCHAR AS last_start FROM experiments e LEFT JOIN runs r ON r.experiment_id = e.experiment_id GROUP BY e.experiment_id, e.name")
def experiment_counts(t):
    return T.experiments_with_counts(experiments(t), runs(t)).withColumn("last_start", F.date_format("last_start", "yyyy-MM-dd HH:mm:ss"))


@query("tracker_metric_catalog", VIEWS + " SELECT key, count(*) AS n, count(DISTINCT run_id) AS runs, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, max(step) AS last_step FROM metrics GROUP BY key")
def metric_catalog(t):
    return rounded(T.metric_catalog(metrics(t, spread=True)))


@query("tracker_param_catalog", VIEWS + " SELECT key, count(DISTINCT run_id) AS runs, count(try_cast(value AS DOUBLE)) AS numeric, count(DISTINCT value) AS different, min(try_cast(value AS DOUBLE)) AS low, max(try_cast(value AS DOUBLE)) AS high, round(avg(try_cast(value AS DOUBLE)), 6) AS mean FROM params GROUP BY key")
def param_catalog(t, params=params):
    return rounded(T.param_catalog(params(t)))


LATEST = VIEWS + ", latest AS (SELECT run_id, key, value, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY step DESC, timestamp DESC, value DESC) AS r FROM metrics) WHERE r = 1)"


@query("tracker_latest_metrics", LATEST + " SELECT * FROM latest")
def latest(t):
    return T.latest_metrics(metrics(t))


@query("tracker_metrics_with_runs", VIEWS + " SELECT r.status, m.key, count(*) AS n, round(avg(value), 6) AS mean FROM metrics m JOIN runs r USING (run_id) GROUP BY ALL")
def metrics_runs(t):
    return rounded(metrics(t).join(runs(t).select("run_id", "status"), "run_id").groupBy("status", "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("tracker_best_runs", LATEST + """,
s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN key IN ('loss') THEN value ELSE -value END, run_id) AS r FROM latest WHERE true)
SELECT key, run_id, value, name, status FROM (SELECT * FROM s JOIN runs USING (run_id)) WHERE r = 1""")
def best(t):
    return T.best_runs(metrics(t), runs(t)).select("key", "run_id", "value", "name", "status")


@query("tracker_primary_metric", VIEWS + " SELECT key, count(DISTINCT run_id) AS runs FROM metrics GROUP BY key ORDER BY runs DESC, CASE key WHEN 'loss' THEN 2 WHEN 'accuracy' THEN 5 ELSE 6 END, key LIMIT 1")
def primary(t):
    return T.primary_metric(metrics(t))


@query("tracker_recent_runs", VIEWS + " SELECT run_id, e.name AS experiment, start_time::VARCHAR AS start_time FROM runs JOIN experiments e USING (experiment_id) ORDER BY runs.start_time DESC, run_id LIMIT 12")
def recent(t):
    r = runs(t).join(F.broadcast(experiments(t).withColumnRenamed("name", "experiment")), "experiment_id")
    return T.page(r, [F.desc("start_time"), F.col("run_id")], 12, 0).select("run_id", "experiment", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"))


@query("tracker_page_by_duration", VIEWS + " SELECT run_id, epoch(coalesce(end_time, start_time)) - epoch(start_time) AS seconds FROM runs ORDER BY seconds DESC, run_id LIMIT 20 OFFSET 40")
def by_duration(t):
    r = runs(t).withColumn("seconds", F.coalesce(T.duration(), F.lit(0.0)))
    return T.page(r, [F.desc("seconds"), F.col("run_id")], 20, 40).select("run_id", "seconds")


@query("tracker_compare_runs", LATEST + ' SELECT key, max(CASE WHEN run_id = \'r1\' THEN value END) AS r1, max(CASE WHEN run_id = \'r2\' THEN value END) AS r2, max(CASE WHEN run_id = \'r3\' THEN value END) AS r3 FROM latest WHERE run_id IN (\'r1\', \'r2\', \'r3\') GROUP BY key')
def compare(t):
    return T.compare_runs(metrics(t), ["r1", "r2", "r3"])


@query("tracker_upsert_params", VIEWS + """,
u AS (SELECT run_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY value) AS r FROM params) WHERE r = 1),
n AS (SELECT run_id, key, 'new' AS value FROM u WHERE key = 'p1')
SELECT value, count(*) AS n FROM (SELECT * FROM u WHERE key <> 'p1' UNION ALL SELECT * FROM n) GROUP BY value""")
def upsert(t, params=params):
    u = params(t).groupBy("run_id", "key").agg(F.min("value").alias("value"))
    return T.upsert(u, u.filter("key = 'p1'").withColumn("value", F.lit("new")), ["run_id", "key"]).groupBy("value").agg(F.count("*").alias("n"))


@query("tracker_insert_new_experiments", VIEWS + " SELECT name, experiment_id FROM experiments UNION ALL SELECT r_name, r_regionkey::BIGINT + 100 FROM region WHERE r_name NOT IN (SELECT name FROM experiments)")
def insert_new(t):
    return T.insert_new(experiments(t), t.region.select((F.col("r_regionkey") + 100).cast("long").alias("experiment_id"), F.col("r_name").alias("name")), ["name"])


@query("tracker_cascade_delete", VIEWS + " SELECT key, count(*) AS n FROM metrics WHERE run_id NOT IN (SELECT run_id FROM runs WHERE status = 'FAILED') GROUP BY key")
def cascade(t):
    return T.delete_runs(metrics(t), runs(t).filter("status = 'FAILED'")).groupBy("key").agg(F.count("*").alias("n"))


@query("tracker_run_maps", VIEWS + ", u AS (SELECT run_id, key, min(value) AS value FROM params GROUP BY ALL) SELECT run_id, count(*) AS n, string_agg(key || '=' || value, ',' ORDER BY key) AS params FROM u GROUP BY run_id")
def maps(t, params=params):
    m = T.run_maps(params(t).groupBy("run_id", "key").agg(F.min("value").alias("value")))
    text = F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("run_id", F.size("params").cast("long").alias("n"), text.alias("params"))


@query("tracker_config_hash", "SELECT p_partkey, md5('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') AS hash FROM part")
def config_hash(t):
    return t.part.select("p_partkey", F.md5(T.config_key(["p_size", "p_brand"])).alias("hash"))


#: The same three over the params of all line items.
for _name, _f in (("tracker_param_catalog", param_catalog), ("tracker_upsert_params", upsert), ("tracker_run_maps", maps)):
    query(f"{_name}_all", ORACLES[_name].replace(" WHERE l_suppkey % 10 = 0)", ")"))(lambda t, f=_f: f(t, params_all))

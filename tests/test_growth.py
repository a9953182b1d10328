"""Steps whose cost per task or row must not grow faster than the input."""

from pyspark.sql import functions as F

from varve.operators import conformal, tracker


def _unjoined(spark):
    """No broadcasts: as with large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def _joined(spark):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_deleted_runs_meet_in_every_shuffle_partition(spark):
    _unjoined(spark)
    try:
        runs = spark.range(1000).select(F.concat(F.lit("r"), "id").alias("run_id"), "id")
        got = tracker.delete_runs(runs, runs.filter("id % 3 = 0")).withColumn("part", F.spark_partition_id()).cache()
        assert got.count() == 666 and got.select("part").distinct().count() == 4  # not joined to one
        got.unpersist()
    finally:
        _joined(spark)


def test_bag_counts_hash_a_row_once_a_member(spark):
    import hashlib

    d = spark.range(300)
    got = d.select("id", conformal.bag_counts(3, F.col("id")).alias("c"))
    for r in got.collect():
        u = [int(hashlib.md5(f"{m}:{r.id}".encode()).hexdigest()[:8], 16) / 2.0**32 for m in range(3)]
        assert r.c == [sum(p <= x for p in conformal.poisson_limits()) for x in u]
    plan = d.withColumn("c", conformal.bag_counts(3, F.col("id"))).agg(*(F.sum(F.col("c")[m] * k) for m in range(3) for k in range(1, 5)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("draw(") == 1  # drawn once a row, however many sums read it


def test_metric_catalog_counts_runs_without_a_partial_table_of_all(spark):
    from varve.plans.tracker_queries import metric_catalog
    from varve.plans.registry import Tables

    _unjoined(spark)
    try:
        plan = metric_catalog(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key" in plan and ", run_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning(key" in x)  # pairs of key and run meet where the rows were dealt
    finally:
        _joined(spark)

"""Hand-computed cases and invariants of the library's operators."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import anomaly, backtest, conformal, encode, features, generate, graph, mining, series, signal, tracker
from varve.sources import io
from varve.streaming import online

S = series.Series(("k",), ("i",))


def frame(spark, values, name="x"):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], f"k string, i long, {name} double")


def column(df, c="out"):
    return [r[c] for r in df.orderBy("k", "i").collect()]


def test_windows_of_a_ramp(spark):
    ramp = spark.createDataFrame([("a", t, float(2 * t), float(2 * t + 1)) for t in range(10)], "k string, i long, c0 double, c1 double")
    w = series.sliding_windows(ramp, S, ["c0", "c1"], ["c0", "c1"], 3, 2).orderBy("start").collect()
    assert len(w) == 6 and w[0].x == [[0, 1], [2, 3], [4, 5]] and w[0].y == [[6, 7], [8, 9]]
    assert series.sliding_windows(ramp, S, ["c0"], ["c0"], 9, 2).count() == 0


def test_fills(spark):
    df = frame(spark, [None, 1, None, None, 4, None])
    assert column(series.interpolate(df, S, "x", "out")) == [1, 1, 2, 3, 4, 4]
    assert column(df.withColumn("out", series.fill_both(S, "x"))) == [1, 1, 1, 1, 4, 4]
    assert column(series.hybrid_fill(frame(spark, [None, None]), S, "x", "out")) == [0, 0]
    assert [r.n for r in series.longest_run(df, S, F.col("x").isNull(), "n").collect()] == [2]


def test_inverse_of_differences(spark):
    df = frame(spark, [4, 5, 6])
    assert column(df.withColumn("out", series.inverse_difference(S, "x", F.lit(16.0)))) == [20, 25, 31]
    seasonal = series.seasonal_difference(frame(spark, [10, 20, 11, 21, 12, 22]), S, "x", 0, 1, 2)
    assert [r["diff"] for r in seasonal.orderBy("i").collect()] == [1, 1, 1, 1]


def test_window_scores(spark):
    df = frame(spark, [1, 5, 2, 0, 0])
    assert column(df.withColumn("out", series.window_to_point(S, "x", 3, "end"))) == [None, None, 1, 5, 2]
    assert column(df.withColumn("out", series.window_to_point(S, "x", 3, "all", "max"))) == [1, 5, 5, 5, 2]


def test_rolling_origins(spark):
    rows = series.rolling_origins(frame(spark, range(12)), S, 2, 6, 2).collect()
    folds = {f: sorted((r.i, r.part) for r in rows if r.fold == f) for f in {r.fold for r in rows}}
    assert set(folds) == {0, 1, 2} and all(len(v) == 8 and [p for _, p in v] == ["train"] * 6 + ["test"] * 2 for v in folds.values()) and folds[2][0][0] == 4


def test_standardise_and_restore(spark):
    d = series.standardise_on_train(frame(spark, [3, 5, 4, 8, 9, 30]), S, "x", F.col("i") < 4)
    assert column(d.withColumn("out", F.round(series.restore(F.col("scaled")), 9))) == [3, 5, 4, 8, 9, 30]


def test_target_encoding_never_sees_its_fold(spark):
    df = spark.createDataFrame([("same", g, y) for g, y in (("a", 0.0), ("a", 0.0), ("b", 10.0), ("b", 10.0))], "c string, g string, y double")
    got = encode.kfold_target(df, "c", "y", "g", 0.0, "e").collect()
    assert {(r.g, r.e) for r in got} == {("a", 10.0), ("b", 0.0)}


def test_encoders_take_missing_categories(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), (None, 1), ("", 0)], "c string, y int")
    assert {r.category: r.n for r in df.groupBy(encode.token("c").alias("category")).agg(F.count("*").alias("n")).collect()} == {"x": 2, "MISSING": 2}
    assert sum(r.freq for r in encode.frequency_map(df, "c").collect()) == 1
    m = encode.ordinal_map(df.filter("c = 'x'"), "c")
    assert sorted(r.code for r in encode.apply_map(df, "c", m, "code", "code", F.lit(-1)).collect()) == [-1, -1, 0, 0]


def test_hbos_and_rules(spark):
    df = frame(spark, [0, 0.1, 0.2, 0.3, 0.4, 15, 16])
    scores = column(anomaly.hbos(df, ["k"], "x"), "score")
    assert min(scores[5:]) > max(scores[:5])
    flags = column(anomaly.mad_outliers(df, ["k"], "x", 3.5), "outlier")
    assert flags == [False] * 5 + [True] * 2
    constant = frame(spark, [2, 2, 2, 2, 2, 2])
    assert not any(column(anomaly.mad_outliers(constant, ["k"], "x", 3.5), "outlier"))


@pytest.mark.parametrize(("labels", "rule", "want"), [((1, 1, 0), "majority", 1), ((1, 0, 0), "majority", 0), ((1, 0, 0), "any", 1), ((1, 1, 0), "all", 0), ((1, 1, 1), "all", 1)])
def test_votes(spark, labels, rule, want):
    assert spark.range(1).select(anomaly.vote(*map(F.lit, labels), rule=rule)).first()[0] == want


def test_split_conformal(spark):
    df = frame(spark, [0, 1, 2, 3, 4])
    assert [r.radius for r in conformal.conformal_radius(df, ["k"], "x", 0.5).collect()] == [2.0]
    assert conformal.level(5, 0.5) == pytest.approx(0.6)
    many = [float(v) for v in np.random.default_rng(0).normal(size=101)]
    got = conformal.conformal_radius(frame(spark, many), ["k"], "x", 0.1).first().radius
    assert got == sorted(many)[int(np.ceil(102 * 0.9)) - 1]


def test_adaptive_alpha(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True)], "k string, i long, miss boolean")
    assert conformal.adaptive_alpha(df, ["k"], ["i"], "miss", 0.3, 0.1).first().alpha == pytest.approx(0.16)


def test_baselines_on_a_line(spark):
    panel = spark.createDataFrame([("a", d, float(d)) for d in range(30)], "unique_id string, ds int, y double")
    fc = backtest.forecasts(backtest.folds(panel, 4, 2, 10), 7, 5)
    error = {r.model: r.mse for r in fc.groupBy("model").agg(*backtest.metrics()).collect()}
    assert error["drift"] == pytest.approx(0) and error["linear"] == pytest.approx(0) and error["naive"] == pytest.approx((1 + 4 + 9 + 16) / 4)


def test_profiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (3.0, None), (5.0, 2.0)], "a double, b double")
    got = {r.feature: r for r in mining.distribution(df, ["a", "b"]).collect()}
    assert got["a"].n == 3 and got["a"]["mean"] == 3 and got["b"].n == 3
    assert mining.pearson(df.withColumn("a", F.lit(1.0)), ["a", "b"]).first().value == 0


def test_entropy_cut_and_bins(spark):
    df = spark.createDataFrame([(float(v), int(v > 4)) for v in range(10)], "x double, y int")
    cut = features.best_cut(df, "x", "y").first()
    assert cut.cut == 4.5 and cut.gain == pytest.approx(1) and cut.accepted
    two = spark.createDataFrame([(0.0,)] * 60 + [(1.0,)] * 60, "x double")
    assert {r.bin for r in features.equal_width(two, "x", "sturges").collect()} == {0, 7}
    assert {r.bin for r in features.quantile_bins(two, "x", 4).collect()} == {0, 1} or features.quantile_bins(two, "x", 4).select("bin").distinct().count() == 2


@pytest.mark.parametrize("lam", [0.0, 0.5, 1.0, 2.0])
def test_power_transform_round_trip(spark, lam):
    df = frame(spark, [-3, -0.5, 0, 0.2, 7])
    z = df.withColumn("z", features.yeo_johnson(F.col("x"), lam)).withColumn("out", features.yeo_johnson_inverse(F.col("z"), lam))
    assert column(z) == pytest.approx([-3, -0.5, 0, 0.2, 7])


def test_row_statistics_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (2.0, 2.0, 2.0)], "a double, b double, c double")
    rows = df.select(*(v.alias(k) for k, v in features.row_statistics(["a", "b", "c"]).items())).collect()
    assert rows[0]["mean"] == 2 and rows[0]["median"] == 2 and rows[0].present == 2 and rows[1]["mean"] is None and rows[2].iqr == 0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3)], "src long, dst long")
    got = {r.node: (r.degree, r.triangles, round(r.clustering, 3)) for r in graph.clustering(edges).collect()}
    assert got == {1: (2, 1, 1.0), 2: (2, 1, 1.0), 3: (3, 1, 0.333), 4: (1, 0, 0.0)}
    sums = graph.gcn_weights(edges).filter("src = dst").collect()
    assert len(sums) == 4


def test_tracker(spark):
    runs = spark.createDataFrame([("r1", 1, "Alpha", "FINISHED", "2024-01-01", "2024-01-02"), ("r2", 1, "beta", "RUNNING", "2024-01-03", None)], "run_id string, experiment_id long, name string, status string, start_time string, end_time string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "end_time")})
    assert [r.run_id for r in tracker.filter_runs(runs, text="ALP").collect()] == ["r1"]
    assert tracker.overview(runs, "2024-01-04").first().mean_seconds == 86400
    table = spark.createDataFrame([("r1", "lr", "1"), ("r2", "lr", "2")], "run_id string, key string, value string")
    new = spark.createDataFrame([("r1", "lr", "9"), ("r3", "lr", "3")], "run_id string, key string, value string")
    assert sorted((r.run_id, r.value) for r in tracker.upsert(table, new, ["run_id", "key"]).collect()) == [("r1", "9"), ("r2", "2"), ("r3", "3")]
    assert sorted(r.value for r in tracker.insert_new(table, new, ["run_id", "key"]).collect()) == ["1", "2", "3"]
    assert tracker.delete_runs(table, runs.filter("run_id = 'r1'")).count() == 1


WAVE = np.sin(np.arange(200) / 5) + 0.3 * np.random.default_rng(1).normal(size=200)


@pytest.mark.parametrize("name", sorted(signal.FILTERS))
def test_filters_smooth_and_keep_length(name):
    out = signal.FILTERS[name](WAVE)
    assert out.shape == WAVE.shape and np.isfinite(out).all() and np.abs(np.diff(out)).sum() < np.abs(np.diff(WAVE)).sum()
    assert signal.FILTERS[name](np.array([2.0])).shape == (1,)


def test_decompositions_add_up():
    trend, season, rest = signal.stl(WAVE, 7)
    assert np.allclose(trend + season + rest, WAVE) and np.allclose(signal.emd(WAVE).sum(0), WAVE)
    assert signal.vmd(WAVE, 3).shape == (3, 200)


def test_batches_of_series_equal_each_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in range(60) for i, v in enumerate(rng.standard_normal((1, 2, 7, 8, 8, 150)[k % 6]))]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(5)
    one = {tuple(r[:3]): r.part for r in signal.decompose_series(df, "k", "i", "v", lambda x: signal.vmd(x, 3)).collect()}
    many = signal.decompose_batches(df.coalesce(1), "k", "i", "v", lambda x: signal.vmd_batch(x, 3)).collect()
    assert len(many) == len(one) and all(r.part == pytest.approx(one[tuple(r[:3])], abs=1e-9) for r in many)
    frames = np.array([rng.standard_normal(9) for _ in range(20)])
    calls = signal.vmd_batch(frames, 3)
    assert calls.shape == (20, 3, 9) and all(np.allclose(c, signal.vmd(x, 3)) for c, x in zip(calls, frames, strict=True))


def test_signal_measures():
    ramp = np.arange(50.0)
    assert signal.permutation_entropy(ramp) == 0 and signal.distance_correlation(ramp, 2 * ramp) == pytest.approx(1)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=300), rng.normal(size=300)
    assert signal.ksg_mi(x, x + 0.1 * y) > 1 and signal.ksg_mi(x, y) < 0.2 and signal.hsic(x, y) < signal.hsic(x, x)
    assert signal.kpss(np.cumsum(x)) > signal.kpss(x) and signal.adf(x) < signal.adf(np.cumsum(x))
    assert np.allclose(signal.arima_css(ramp, 1, 1, 3), [50, 51, 52])
    steps = np.concatenate([np.linspace(0, 1, 30), np.linspace(1.01, 1.1, 60)])
    assert len(signal.bayesian_blocks(steps)) == 3
    far = signal.isolation_scores(np.concatenate([rng.normal(size=200), [12.0]])[:, None])
    assert far.argmax() == 200


def test_isolation_trees_of_one_column_equal_the_general_walk_in_a_fraction_of_its_time():
    import time

    def seconds(x):
        start = time.process_time()
        for _ in range(5):
            got = signal.isolation_scores(x)
        return got, time.process_time() - start

    for seed, n in enumerate((1, 2, 67, 300)):
        x = np.random.default_rng(seed).normal(size=(n, 1)).round(1)
        one, fast = seconds(x)
        both, slow = seconds(np.hstack([x, np.zeros((n, 1))]))  # a constant column takes the general walk and is never cut
        assert np.array_equal(one, both)
        assert n < 67 or fast < slow / 3


def test_generators(spark):
    p = generate.panel(spark, 3, 10)
    assert p.count() == 30 and p.select(F.countDistinct("series", "t")).first()[0] == 30
    noisy = p.withColumn("y", generate.noise(1.0, 3))
    assert sorted(r.y for r in noisy.collect()) == sorted(r.y for r in noisy.repartition(3).collect())
    assert [(r["bracket"], r["configs"]) for r in generate.hyperband(27, 3) if r["round"] == 0] == [(3, 27), (2, 12), (1, 6), (0, 4)]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('time;feat1;"feat;2";target\n1;2.5;3;0\n2;3.5;;1\n')
    df = io.read_csv(spark, str(path))
    assert df.columns == ["time", "feat1", "feat;2", "target"] and df.count() == 2
    xy = io.split_xy(df.withColumnRenamed("feat;2", "feat2"), time="time").collect()
    assert xy[0].x == [2.5, 3.0] and xy[1].y == 1.0 and xy[1].t == 2.0
    assert [io.detect_delimiter(h) for h in ("a,b", "a\tb\tc", 'a|"b,c"')] == [",", "\t", "|"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456789)], "b long, a double")
    io.write_results(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first().a == 0.123457
    io.write_json_lines(df, str(tmp_path / "j"))
    line = "".join(f.read_text() for f in (tmp_path / "j").glob("part*.json")).strip()  # some parts are empty
    assert list(json.loads(line)) == ["a", "b"] and io.read_json_lines(spark, str(tmp_path / "j")).count() == 1
    assert io.read_blobs(spark, str(tmp_path / "j")).count() >= 1


def stream_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 2}", f"2024-01-01 0{i // 40}:{i % 40:02d}:00", 100.0 if i == 90 else float(i % 5)) for i in range(120)], "id long, u string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(3):
        rows.filter(f"id >= {40 * k} and id < {40 * k + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = stream_rows(spark, tmp_path)
    source = io.stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=10)
    got = run_stream(online.detect(source, "u", "id", "ts", "v"), "detected", "append")
    batch = online.detect_batch(rows, "u", "id", "ts", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.orderBy(F.desc("z")).first().id == 90
    counts = run_stream(online.windowed(source, "ts", ["u"], "v", "1 hour"), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == 120
    last = run_stream(online.latest(source, ["u"], "id", "v"), "last", "complete")
    assert {(r.u, r.id) for r in last.collect()} == {("u0", 118), ("u1", 119)}


def test_state_warms_up():
    state, zs = (0, 0.0, 0.0), []
    for x in itertools.chain([1.0, 2.0] * 20, [50.0]):
        state, z, c = online.next_state(state, x)
        zs.append(z)
        assert 0 <= c <= 1
    assert not any(zs[: online.WARM_UP]) and zs[-1] == max(zs) > 10


def test_average_ranks_take_one_sort_and_no_task_of_a_whole_key(spark):
    from varve.functions.expr import average_rank
    from varve.functions.quantiles import average_ranks

    df = spark.range(400).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * 7 % 50).cast("double").alias("x"), (F.col("id") * 13 % 101).alias("y"), "id")
    want = df.select("id", average_rank(["g"], "x").alias("x"), average_rank(["g"], "y").alias("y"))
    plan = df.select(average_rank(["g"], "x"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    rows = df.toPandas()
    brute = rows.assign(x=rows.x.fillna(1e9)).groupby(rows.g.fillna(-1))[["x", "y"]].rank()
    got = {r.id: (r.x, r.y) for r in want.collect()}
    assert got == {i: tuple(v) for i, v in zip(rows.id, brute.itertuples(index=False), strict=True)}
    other = average_ranks(df, ["g"], ["x", "y"])
    assert {r.id: (r._r0, r._r1) for r in other.collect()} == got
    mi = mining.binned_mi(df, "x", "y", 4, "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in mi and "_part" in mi


def test_ecod_rows_are_dealt_in_as_many_tasks_as_shuffles_have(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 50).cast("double").alias("a"))
    scored = anomaly.ecod(df, ["g"], ["a"], "id")
    assert scored.columns == ["g", "id", "a", "score"] and scored.count() == 60
    assert "REPARTITION_BY_NUM" in scored._jdf.queryExecution().executedPlan().toString()


def test_ecod_ranks_keys_in_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(i % 3 > 0), float(a), None if i % 17 == 5 else float(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 6, 500), rng.random(500).round(2), strict=True))]
    df = spark.createDataFrame(rows, "id long, g int, a double, b double")
    score = lambda **x: {r.id: r.score for r in anomaly.ecod(df, ["g"], ["a", "b"], "id", **x).collect()}
    whole, parts = score(), score(most=20)
    assert whole == parts and len(parts) == 500
    for g in (0, 1):
        own = [r for r in rows if r[1] == g]
        n = len(own) + 1
        least = lambda v: -np.inf if v is None else v
        places = [({r[0]: k for k, r in enumerate(sorted(own, key=lambda r: (least(r[c]), r[0])), 1)}, {r[0]: k for k, r in enumerate(sorted(own, key=lambda r: (-least(r[c]), r[0])), 1)}) for c in (2, 3)]
        for r in own:
            (ua, da), (ub, db) = ((-np.log(u[r[0]] / n), -np.log(d[r[0]] / n)) for u, d in places)
            assert parts[r[0]] >= max(ua + ub, da + db) - 1e-9 and parts[r[0]] == pytest.approx(max(ua + ub, da + db, *((x + y) for x in (ua, da) for y in (ub, db) if abs(x + y - parts[r[0]]) < 1e-9)))

"""Queries that cover every row of their tables."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from varve.operators import mining, signal
from varve.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_params_of_every_line_item(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    runs, keys = lines.select("l_orderkey").distinct().count(), lines.select("l_orderkey", "l_linenumber").distinct().count()
    assert QUERIES["tracker_run_maps_all"](spark, SF).agg(F.count("*"), F.sum("n")).first()[:] == (runs, keys)
    assert QUERIES["tracker_upsert_params_all"](spark, SF).agg(F.sum("n")).first()[0] == keys
    seen = {r.key: r.runs for r in QUERIES["tracker_param_catalog_all"](spark, SF).collect()}
    assert seen == {f"p{r.l_linenumber}": r.n for r in lines.groupBy("l_linenumber").agg(F.countDistinct("l_orderkey").alias("n")).collect()}
    assert not any("% 10 = 0" in ORACLES[f"tracker_{q}_all"] for q in ("param_catalog", "upsert_params", "run_maps"))


def real_edges(spark):
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    lines = [(r.l_orderkey, r.l_partkey) for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect()]
    out = {(3 * c, 3 * o + 1) for o, c in orders.items()} | {(3 * o + 1, 3 * p + 2) for o, p in lines} | {(3 * orders[o], 3 * p + 2) for o, p in lines if o in orders}
    return {(min(e), max(e)) for e in out}


def test_graph_of_all_orders_and_line_items(spark):
    near = defaultdict(set)
    for a, b in real_edges(spark):
        near[a].add(b)
        near[b].add(a)
    assert {r.node: r.degree for r in QUERIES["graph_degrees_all"](spark, SF).collect()} == {k: len(v) for k, v in near.items()}
    closed = {k: sum(len(v & near[x]) for x in v) // 2 for k, v in near.items()}
    assert sum(closed.values()) > 0 and {r.node: r.triangles for r in QUERIES["graph_clustering_all"](spark, SF).collect()} == closed
    sent = {k: float(sum(x % 10 for x in v if x < k)) for k, v in near.items()}
    assert {r.node: r.message for r in QUERIES["graph_message_passing_all"](spark, SF).collect()} == sent
    weights = {(a, b): round(((len(near[a]) + 1) * (len(near[b]) + 1)) ** -0.5, 6) for a in near for b in near[a] | {a}}
    got = {(r.src, r.dst): r.weight for r in QUERIES["graph_gcn_weights_all"](spark, SF).collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - w) < 2e-6 for k, w in weights.items())


def test_page_rank_of_all_orders_and_line_items(spark):
    edges = real_edges(spark)
    out = defaultdict(int)
    for a, _ in edges:
        out[a] += 1
    rank = {x: 1.0 for e in edges for x in e}
    for _ in range(5):
        new = dict.fromkeys(rank, 0.15)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r.node: r.rank for r in QUERIES["graph_page_rank"](spark, SF).collect()}
    assert got.keys() == rank.keys() and all(abs(got[k] - v) < 2e-6 for k, v in rank.items())


def test_arima_has_moving_average_and_seasonal_terms():
    e = np.random.default_rng(1).normal(size=4001)
    ma = e[1:] + 0.8 * e[:-1]
    assert abs(signal.arima_css(ma, 0, 0, 1, q=1)[0] - 0.8 * e[-1]) < 0.1
    assert np.allclose(signal.arima_css(ma, 0, 0, 4, q=1)[1:], 0, atol=0.1)
    far = np.convolve(e, np.r_[1, np.zeros(6), 0.7])[: len(e)]
    assert np.allclose(signal.arima_css(far, 0, 0, 7, seasonal=(0, 0, 1, 7)), 0.7 * e[-7:], atol=0.15)
    season = np.tile([0.0, 5, 1, 7, 2, 9, 4], 30) + 0.01 * e[:210]
    assert np.allclose(signal.arima_css(season, 0, 0, 7, seasonal=(0, 1, 0, 7)), [0, 5, 1, 7, 2, 9, 4], atol=0.1)
    y = np.zeros(len(e))
    for t in range(8, len(e)):
        y[t] = 0.5 * y[t - 1] + 0.6 * y[t - 7] - 0.3 * y[t - 8] + e[t]
    want = 0.5 * y[-1] + 0.6 * y[-7] - 0.3 * y[-8]
    assert abs(signal.arima_css(y, 1, 0, 1, seasonal=(1, 0, 0, 7))[0] - want) < 0.2


def test_arima_orders_by_aicc():
    e = np.random.default_rng(2).normal(size=3001)
    p, d, q, P, Q = signal.auto_arima(np.cumsum(e[1:] + 0.8 * e[:-1]), 3)[1]
    assert d == 1 and q >= 1 and (P, Q) == (0, 0)
    far = np.convolve(e, np.r_[1, np.zeros(6), 0.7])[: len(e)]
    assert signal.auto_arima(far, 3, 7)[1][3:] != (0, 0)
    for n in range(1, 60):
        assert np.isfinite(signal.auto_arima(e[:n], 3, 7)[0]).all() and np.isfinite(signal.auto_arima(np.arange(n) * 1.0, 3, 7)[0]).all()


def test_ranks_of_the_whole_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), "xyz"[c]) for i, (a, b, c) in enumerate(zip(rng.integers(0, 9, 400), rng.normal(size=400), rng.integers(0, 3, 400), strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, g string")
    a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    place = lambda x: np.argsort(np.lexsort((np.arange(len(x)), x)))
    for parts in (2, 7):
        monkeypatch.setattr(mining, "PARTS", parts)
        assert {r.a: r.rank for r in mining.value_ranks(df, "a").collect()} == dict(zip(a, rank(a), strict=True))
        assert abs(mining.whole_spearman(df, ["a", "b"]).first().value - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-9
        xi = lambda x, y: 1 - 3 * np.abs(np.diff(y[np.argsort(x)])).sum() / (len(x) ** 2 - 1)
        both = (np.clip(xi(place(a), place(b)), 0, 1) + np.clip(xi(place(b), place(a)), 0, 1)) / 2
        assert abs(mining.whole_chatterjee(df, "a", "b", "id").first().xi - both) < 1e-9
        u = mining.whole_mann_whitney(df, F.col("g") == "x", "b").first()
        x, y = np.array([r[2] for r in rows if r[3] == "x"]), np.array([r[2] for r in rows if r[3] != "x"])
        assert u.u == (x[:, None] > y[None]).sum()

"""Boosting, nearest neighbours, recursive partitions and graphs against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions.tables import Rounds
from varve.operators import boost, concordance, encode, graph, neighbours, partition


def brute_booster(x, y, edges, loss, rounds, depth, rate, penalty, least):
    """Histogram boosting of a NumPy matrix, node by node; the same rules in plain loops."""
    b = np.array([[0 if math.isnan(v) else 1 + sum(e < v for e in edges[c]) for c, v in enumerate(row)] for row in x])
    f = np.full(len(y), y.mean() if loss == "squared" else math.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        g, h = (f - y, np.ones(len(y))) if loss == "squared" else ((p := 1 / (1 + np.exp(-f))) - y, p * (1 - p))

        def grow(rows, level, g=g, h=h):
            score = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
            best = None
            for c in range(b.shape[1] if level < depth else 0):
                for cut in range(b[rows, c].min(initial=0), b[rows, c].max(initial=0)):
                    lo, hi = rows[b[rows, c] <= cut], rows[b[rows, c] > cut]
                    if not len(lo) or not len(hi) or h[lo].sum() < least or h[hi].sum() < least:
                        continue
                    gain = score(lo) + score(hi) - score(rows)
                    if gain > 1e-6 and (best is None or round(gain, 7) > best[0]):
                        best = (round(gain, 7), lo, hi)
            if best is None:
                return [(rows, -rate * g[rows].sum() / (h[rows].sum() + penalty))]
            return grow(best[1], level + 1) + grow(best[2], level + 1)

        for rows, value in grow(np.arange(len(y)), 0):
            f[rows] = f[rows] + value
    return f if loss == "squared" else 1 / (1 + np.exp(-f))


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(0, 1, n), rng.integers(0, 6, n), rng.uniform(0, 1, n)])
    x[rng.random((n, 3)) < 0.05] = np.nan
    clean = np.nan_to_num(x)
    y = 2 * (clean[:, 0] > 0.3) + clean[:, 1] * 0.5 - clean[:, 2] + rng.normal(0, 0.1, n)
    rows = [(i, *(None if math.isnan(v) else float(v) for v in x[i]), float(y[i]), float(y[i] > 1.5)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 1.0, 1.0, 1.0, None, None)], "id long, a double, b double, c double, y double, flag double"), x, y


@pytest.mark.parametrize(("loss", "target"), [("squared", "y"), ("logistic", "flag")])
def test_boosting_equals_a_numpy_booster(spark, loss, target):
    df, x, y = table(spark)
    model = boost.fit(df, ["a", "b", "c"], target, loss, rounds=4, depth=3, rate=0.3, bins=8, least=2.0)
    want = brute_booster(x, y if loss == "squared" else (y > 1.5).astype(float), model.edges, loss, 4, 3, 0.3, 1.0, 2.0)
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, abs=1e-6)
    assert got[len(x)] is not None and sum(model.importance().values()) == pytest.approx(1) and model.importance()["c"] < model.importance()["a"]


def test_bundles_of_exclusive_columns_give_the_same_trees(spark):
    n = 300
    rows = [(float(i % 7), float(i % 5 if i % 3 == 0 else 0), float(i % 4 if i % 3 == 1 else 0), float((i * 7) % 11 + 3 * (i % 3 == 0) * (i % 5))) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, s double, t double, y double").repartition(3)
    plain = boost.fit(df, ["a", "s", "t"], "y", rounds=3, bins=16)
    both = boost.fit(df, ["a", "s", "t"], "y", rounds=3, bins=16, bundled=True)
    held = df.select(F.array(*plain.bins()).alias("b"))
    assert [sorted(c for c, _ in g) for g in boost.bundles(held, [len(e) + 2 for e in plain.edges])] == [[1, 2]]
    assert both.splits == plain.splits
    assert [sorted(t.items()) for t in both.leaves] == [[(k, pytest.approx(v)) for k, v in sorted(t.items())] for t in plain.leaves]


def test_goss_keeps_large_gradients_and_learns(spark):
    df, x, y = table(spark)
    model = boost.fit(df, ["a", "b", "c"], "y", rounds=6, rate=0.5, goss=(0.2, 0.3))
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert np.mean([(got[i] - y[i]) ** 2 for i in range(len(y))]) < 0.2 * y.var()


def test_boosting_without_rows_values_or_splits(spark):
    df, _, _ = table(spark, 20)
    assert boost.fit(df.limit(0), ["a"], "y").splits == []
    same = boost.fit(df.withColumn("k", F.lit(1.0)).withColumn("z", F.lit(None).cast("double")), ["k", "z"], "y", rounds=2)
    assert same.splits == [] and same.importance() == {"k": 0.0, "z": 0.0}
    with pytest.raises(ValueError, match="no loss"):
        boost.fit(df, ["a"], "y", "absolute")


def points(n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 1, (n // 2, 2)), rng.normal(6, 0.3, (n // 4, 2)), np.full((n // 4, 2), 3.0)]).round(2)
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]


def brute_nearest(rows, k):
    out = {}
    for i, a, b in rows:
        out[i] = sorted(((a - c) ** 2 + (b - d) ** 2, j) for j, c, d in rows if j != i)[:k]
    return out


@pytest.mark.parametrize(("pivots", "block"), [(64, 2048), (7, 20), (1, 11)])
def test_nearest_neighbours_equal_brute_force(spark, pivots, block):
    rows = points()
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, float("nan"), 1.0)], "id long, a double, b double").repartition(5)
    p = neighbours._points(df, "id", ["a", "b"])
    got = {}
    for r in neighbours.knn_join(p, p, 5, True, pivots, block).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.distance, r.near))
    want = {i: [(pytest.approx(math.sqrt(d)), j) for d, j in near] for i, near in brute_nearest(rows, 5).items()}
    assert got == want


def test_nearest_neighbours_of_few_points(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "id long, a double")
    assert sorted((r.id, r.near, r.rank) for r in neighbours.nearest_rows(df, "id", ["a"], 9).collect()) == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 2), (3, 2, 1)]
    assert neighbours.nearest_rows(df.limit(0), "id", ["a"], 2).count() == 0 == neighbours.nearest_rows(df.filter("id = 1"), "id", ["a"], 2).count()
    left, right = (neighbours._points(df.filter(f), "id", ["a"]) for f in ("id = 1", "id > 1"))
    assert [(r.id, r.near) for r in neighbours.knn_join(left, right, 1).collect()] == [(1, 2)]


def test_copies_of_points_meet_as_one(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    tile = neighbours._tile

    def counted(*a):
        run = tile(*a)

        def inner(key, table):
            seen.add(table.num_rows)
            return run(key, table)

        return inner

    monkeypatch.setattr(neighbours, "_tile", counted)
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    got = {}
    for r in neighbours.nearest_rows(df, "id", ["a", "b"], 2).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.near, r.distance, r.rank))
    assert got == {i: [(n, 0.0, k + 1) for k, n in enumerate([j for j in range(i % 21, 3000, 21) if j != i][:2])] for i in range(3000)}
    assert seen.value < 3000  # 21 places with three candidates each, in cells that meet


def test_local_outlier_factors_equal_brute_force(spark):
    rows, k = points(120), 10
    near = brute_nearest(rows, k)
    reach = {i: math.sqrt(n[-1][0]) for i, n in near.items()}
    density = {i: 1 / (np.mean([max(math.sqrt(d), reach[j]) for d, j in n]) + 1e-10) for i, n in near.items()}
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: (r.lof, r.outlier) for r in neighbours.lof_outliers(df, "id", ["a", "b"], k, 0.05).collect()}
    want = {i: np.mean([density[j] for _, j in n]) / density[i] for i, n in near.items()}
    cut = np.quantile(list(want.values()), 0.95)
    for i, v in want.items():
        assert got[i][0] == pytest.approx(v) and got[i][1] == (v > cut + 1e-12 * cut)


def test_imputation_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (60, 3)).round(3)
    x[rng.random((60, 3)) < 0.25] = np.nan
    x[7] = np.nan
    df = spark.createDataFrame([(i, "keep", *(None if math.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id long, note string, a double, b double, c double")
    got = {r.id: (r.a, r.b, r.c) for r in neighbours.impute_nearest(df, "id", ["a", "b", "c"], 4).collect()}
    for i in range(60):
        for c in range(3):
            want = x[i, c]
            if math.isnan(want):
                near = []
                for j in range(60):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                    if j != i and both.any() and not math.isnan(x[j, c]):
                        near.append((math.sqrt(3 / both.sum() * ((x[i] - x[j])[both] ** 2).sum()), j))
                want = np.mean([x[j, c] for _, j in sorted(near)[:4]]) if near else np.nanmean(x[:, c])
            assert got[i][c] == pytest.approx(want)


def test_imputation_without_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None)], "id long, a double, b double")
    assert sorted(map(tuple, neighbours.impute_nearest(df, "id", ["a", "b"]).collect())) == [(1, None, 2.0), (2, None, 2.0)]
    assert neighbours.impute_nearest(df.limit(0), "id", ["a", "b"]).count() == 0


def brute_mdlp(x, y):
    classes = sorted(set(y))

    def entropy(v):
        p = [v.count(c) / len(v) for c in set(v)]
        return -sum(q * math.log2(q) for q in p)

    def cut(rows):
        k = len({c for _, c in rows})
        values, best = sorted({v for v, _ in rows}), None
        every = [c for _, c in rows]
        for a, b in zip(values, values[1:], strict=False):
            left, right = [c for v, c in rows if v <= a], [c for v, c in rows if v > a]
            gain = entropy(every) - len(left) / len(rows) * entropy(left) - len(right) / len(rows) * entropy(right)
            delta = math.log2(3**k - 2) - (k * entropy(every) - len(set(left)) * entropy(left) - len(set(right)) * entropy(right))
            if gain > (math.log2(max(1, len(rows) - 1)) + delta) / len(rows) and (best is None or round(gain, 9) > best[0]):
                best = (round(gain, 9), (a + b) / 2)
        if best is None:
            return []
        return [*cut([r for r in rows if r[0] <= best[1]]), best[1], *cut([r for r in rows if r[0] > best[1]])]

    assert classes
    return cut(list(zip(x, y, strict=True)))


def test_mdlp_cuts_equal_a_recursive_reference(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 600).round(2)
    y = np.digitize(x, [-1, -0.2, 0.9]) % 3
    noisy = np.where(rng.random(600) < 0.1, rng.integers(0, 3, 600), y)
    rows = [(float(a), float(b), f"k{c}") for a, b, c in zip(x, rng.normal(0, 1, 600), noisy, strict=True)] + [(None, 1.0, "k0"), (float("nan"), None, "k1"), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, z double, y string").repartition(4)
    got = {}
    for r in partition.mdlp_cuts(df, ["x", "z"], "y").collect():
        got.setdefault(r.feature, []).append(r.cut)
    want = brute_mdlp(x.tolist(), [f"k{c}" for c in noisy])
    assert sorted(got["x"]) == pytest.approx(want) and len(want) >= 3 and "z" not in got
    bins = partition.mdlp_bins(df, ["x", "z"], "y").filter("y is not null").collect()
    assert all(r.x_bin == sum(c < r.x for c in want) for r in bins if r.x is not None and not math.isnan(r.x)) and {r.x_bin for r in bins if r.x is None or math.isnan(r.x)} == {None}
    assert partition.mdlp_cuts(df.limit(0), ["x"], "y").count() == 0 == partition.mdlp_cuts(df.filter("y = 'k0'"), ["x"], "y").count()
    thin = partition.mdlp_bins(df, ["x"], "y", 3)
    assert thin.agg(F.max("x_bin")).first()[0] <= 2


def test_weighted_quantiles_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(float(v), float(w)) for v, w in zip(rng.integers(0, 200, 500), rng.uniform(0, 2, 500), strict=True)] + [(None, 1.0), (5.0, None), (7.0, -1.0), (9.0, 0.0)]
    df = spark.createDataFrame(rows, "v double, w double").repartition(3)
    held = sorted((v, w) for v, w in rows if v is not None and w is not None and w > 0)
    total = sum(w for _, w in held)
    want = []
    for q in (0.1, 0.5, 0.9, 1.0):
        at = 0.0
        for v, w in held:
            at += w
            if at >= q * total * (1 - 1e-12):
                want.append(v)
                break
    assert partition.weighted_quantiles(df, ["v"], "w", [0.1, 0.5, 0.9, 1.0]).first().q == want
    sums = partition.weighted_bins(df.filter("v is not null and w > 0"), ["v"], "w", 4).groupBy("v_bin").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 4 and all(r.w == pytest.approx(total / 4, rel=0.1) for r in sums)
    assert partition.weighted_quantiles(df.limit(0), ["v"], "w", [0.5]).count() == 0


def test_changes_of_planted_steps_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    x = np.repeat([0.0, 5.0, -3.0, 8.0], [100, 70, 130, 100]) + rng.normal(0, 0.5, 400)

    def pieces(a, b):
        noise = (np.diff(x) ** 2).mean() / 2
        error = lambda v: ((v - v.mean()) ** 2).sum()
        options = [(round(error(x[a:b]) - error(x[a:i]) - error(x[i:b]), 7), -i) for i in range(a + 20, b - 19)]
        if not options or max(options)[0] <= 4 * math.log(len(x)) * noise:
            return []
        at = -max(options)[1]
        return [*pieces(a, at), at, *pieces(at, b)]

    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("a", 1000 + i, None) for i in range(5)] + [("b", i, 1.0) for i in range(90)] + [("c", i, float(i)) for i in range(30)]
    got = partition.change_points(spark.createDataFrame(rows, "k string, i long, v double").repartition(3), "k", "i", "v").orderBy("k", "at").collect()
    want = pieces(0, 400)
    assert [(r.k, r.at) for r in got] == [("a", i) for i in want] and want == [100, 170, 300]
    cuts = [0, *want, 400]
    for r, a, b, c in zip(got, cuts, cuts[1:], cuts[2:], strict=False):
        assert (r.before, r.after) == (pytest.approx(x[a:b].mean()), pytest.approx(x[b:c].mean()))


def random_graph(seed=4, n=60, m=70):
    rng = np.random.default_rng(seed)
    return sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b} | {(100, 100), (7, 200), (200, 7)} | {(300 + i, 301 + i) for i in range(40)})


def test_components_and_topology_equal_brute_force(spark):
    edges = random_graph()
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {v: find(v) for v in parent}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    wedges = sum(len(v) * (len(v) - 1) // 2 for v in near.values())
    tri = sum(1 for a in near for b in near[a] for c in near[a] & near[b] if a < b < c)
    t = graph.topology(df).first()
    n, m = len(near), sum(map(len, near.values())) // 2
    assert (t.nodes, t.edges, t.triangles) == (n, m, tri) and t.density == pytest.approx(2 * m / n / (n - 1)) and t.transitivity == pytest.approx(3 * tri / wedges)
    assert graph.components(df.limit(0)).count() == 0 and graph.topology(df.limit(0)).first().edges == 0


def test_communities_of_joined_cliques(spark):
    cliques = [[10 * c + i for i in range(6)] for c in range(5)]
    edges = [(a, b) for q in cliques for a in q for b in q if a < b] + [(10 * c, 10 * ((c + 1) % 5)) for c in range(5)] + [(3, 3)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = {r.node: r.community for r in graph.communities(df).collect()}
    assert got == {v: q[0] for q in cliques for v in q}
    member = graph.communities(df)
    m, inside = len(edges), sum(got[a] == got[b] for a, b in edges)
    strength = {c: sum((got[a] == c) + (got[b] == c) for a, b in edges) for c in set(got.values())}
    weighted = df.withColumn("weight", F.lit(1.0))
    assert graph.modularity(weighted, member) == pytest.approx(inside / m - sum(s * s for s in strength.values()) / (4 * m * m))
    assert graph.communities(df.limit(0)).count() == 0


def test_communities_keep_no_earlier_round_and_tables_by_column_are_not_shuffled_again(spark, monkeypatch):
    import os

    made = []
    start = Rounds.__init__
    monkeypatch.setattr(Rounds, "__init__", lambda self, *a: (start(self, *a), made.append(self))[0])
    edges = spark.createDataFrame(random_graph(7, 60, 150), "src long, dst long")
    got = graph.communities(edges, rounds=3, levels=2)
    assert got.count() == edges.select(F.explode(F.array("src", "dst"))).distinct().count()
    left = [n for n in os.listdir(made[0].folder.removeprefix("file://")) if not n.startswith(".")]
    assert made[0].made > 8 and len(left) <= 5
    by = made[0].put_by(edges, "dst")
    plan = by.hint("merge").join(edges.groupBy("dst").count(), "dst")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    made[0].drop(by)
    assert not spark.catalog.tableExists(by._varve_table)


def test_communities_do_not_depend_on_the_number_of_blocks(spark, monkeypatch):
    from varve.operators import moves

    edges = [*random_graph(3, 80, 200), (900, 901), (902, 902)]
    df = spark.createDataFrame([(a, b, float(1 + (a * b) % 3)) for a, b in edges], "src long, dst long, weight double")
    once = {r.node: r.community for r in graph.communities(df).collect()}
    monkeypatch.setattr(moves, "ONCE", 150)
    monkeypatch.setattr(moves, "BLOCK", 150)
    before = spark.conf.get(moves.PARTS)
    assert {r.node: r.community for r in graph.communities(df).collect()} == once and spark.conf.get(moves.PARTS) == before


def test_registered_communities_leave_no_two_whose_union_gains(spark):
    from varve.plans import QUERIES
    from varve.plans.feature_queries import edges_all
    from varve.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    of = {r.node: r.community for r in QUERIES["graph_communities"](spark, folder).collect()}
    edges = [(of[r.src], of[r.dst]) for r in edges_all(Tables(spark, folder)).collect()]
    between, strength = {}, {}
    for a, b in edges:
        for c in (a, b):
            strength[c] = strength.get(c, 0) + 1
        if a != b:
            between[min(a, b), max(a, b)] = between.get((min(a, b), max(a, b)), 0) + 1
    assert not [p for p, w in between.items() if w - strength[p[0]] * strength[p[1]] / (2 * len(edges)) > 1e-8 * len(edges)]


def test_betweenness_equals_all_shortest_paths(spark):
    edges = [(a, b) for a, b in random_graph(5, 14, 24) if b < 50]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w] / 2
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == pytest.approx(want)


def test_betweenness_writes_a_row_a_node_and_level_for_all_sources(spark, monkeypatch):
    made = []
    put = Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: (made.append(put(self, df)), made[-1])[1])
    leaves = 60
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame([(0, i) for i in range(1, leaves + 1)], "src long, dst long"), 8).collect()}
    assert got[0] == pytest.approx(leaves * (leaves - 1) / 2, rel=0.2) and not any(v for n, v in got.items() if n)
    assert max(t.count() for t in made) <= leaves + 1


@pytest.mark.parametrize("strip", [1 << 16, 17])
def test_whole_kendall_equals_all_pairs(spark, strip):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b)) for a, b in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300) * 1.5, strict=True)] + [(float(i), float(-i)) for i in range(60)] + [(None, 1.0), (1.0, float("nan"))]
    held = [r for r in rows if r[0] is not None and not math.isnan(r[1])]
    sign = lambda v: (v > 0) - (v < 0)
    s = [(sign(a - c), sign(b - d)) for i, (a, b) in enumerate(held) for c, d in held[:i]]
    up, down = sum(a * b > 0 for a, b in s), sum(a * b < 0 for a, b in s)
    got = concordance.whole_kendall(spark.createDataFrame(rows, "x double, y double").repartition(3), "x", "y", strip).first()
    assert (got.n, got.concordant, got.discordant) == (len(held), up, down)
    assert got.tau == pytest.approx((up - down) / math.sqrt(sum(a != 0 for a, _ in s) * sum(b != 0 for _, b in s)))
    none = concordance.whole_kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    flat = concordance.whole_kendall(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y").first()
    assert (none.n, none.tau, flat.tau) == (0, None, None)


def test_folds_by_group_and_time_keep_targets_out(spark):
    df = spark.createDataFrame([("same", g, y) for g, y in (("a", 0.0), ("a", 0.0), ("b", 10.0), ("b", 10.0))], "cat string, g string, y double")
    got = encode.kfold_target(encode.group_folds(df, "g", 2), "cat", "y", "fold", 0.0, "v").orderBy("g").collect()
    assert [r.v for r in got] == [10, 10, 0, 0]
    days = spark.createDataFrame([(i, f"2024-01-0{i + 1}", "same", float(9 * (i > 2))) for i in range(6)], "id long, day string, cat string, y double").withColumn("t", F.to_timestamp("day"))
    v = [r.v for r in encode.forward_target(encode.time_folds(days, "t", "id", 3), "cat", "y", "fold", 0.0, "v").orderBy("id").collect()]
    assert v[3] < v[4] < v[5] and v[3] < 1 and v[5] < 9 and v == pytest.approx([4.5, 4.5, 4.5, 0, 2.25, 3.6])


def test_components_write_the_edges_once(spark, monkeypatch):
    edges = list(random_graph(11, 400, 900)) + [(3, 3), (10_000, 10_000), (10_002, 10_001), (10_001, 10_002)]
    df = spark.createDataFrame(edges + edges[:50], "src long, dst long")
    rows = []
    put = graph.Rounds.put

    def counted(self, table):
        out = put(self, table)
        rows.append(out.count() if out.columns == ["src", "dst"] else 0)
        return out

    monkeypatch.setattr(graph.Rounds, "put", counted)
    got = {r.node: r.component for r in graph.components(df).collect()}
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least
    assert sum(rows) < 2 * len(edges)


def test_pairs_of_ends_that_close_no_triangle_stay_in_their_task(spark):
    rng = np.random.default_rng(12)
    pairs = {(int(a), 1000 + int(b)) for a, b in zip(rng.integers(0, 60, 1500), rng.integers(0, 400, 1500), strict=True)} | {(0, 1), (1, 2), (0, 2), (2, 3)}
    u = spark.createDataFrame(sorted(pairs), "src long, dst long")
    told = []
    wedges = graph._wedges
    graph._wedges = lambda e: told.append((wedges(e).count(), e.alias("x").join(e.alias("y"), "a").filter("x.b < y.b").count())) or wedges(e)
    try:
        got = {r.node: r.triangles for r in graph.clustering(u).collect() if r.triangles}
    finally:
        graph._wedges = wedges
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {n: sum(x < y and y in near[x] for x in near[n] for y in near[n]) for n in near}
    assert got == {n: k for n, k in want.items() if k}
    assert told[0][0] < told[0][1] / 4


def test_page_rank_reads_the_edges_once(spark):
    edges = [(a, b) for a, b in random_graph(13) if a != b]
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    df = spark.createDataFrame(edges, "src long, dst long").mapInPandas(counted, "src long, dst long")
    got = {r.node: r.rank for r in graph.page_rank(df, 3).collect()}
    out = {a: sum(x == a for x, _ in edges) for a, _ in edges}
    rank = {n: 1.0 for e in edges for n in e}
    for _ in range(3):
        rank = {n: 0.15 + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == n) for n in rank}
    assert got == pytest.approx(rank)
    assert read.value == len(edges)


def test_distinct_edges_are_dealt_to_all_shuffle_partitions(spark):
    u = graph.undirected(spark.range(5000).selectExpr("id % 70 AS src", "id % 90 AS dst"))
    assert u.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert u.count() == len({(min(i % 70, i % 90), max(i % 70, i % 90)) for i in range(5000) if i % 70 != i % 90})

"""Graphs as edge tables (src, dst, weight): networks from pairs, topology, message passing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import divide
from ..functions.tables import Rounds, dealt
from . import moves


def threshold_network(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.filter(F.abs("value") >= threshold).select(F.col("feature_a").alias("src"), F.col("feature_b").alias("dst"), F.abs("value").alias("weight"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """src, dst, weight = 1 / (1 + distance) of each node's k nearest by distance in value; ties by name."""
    both = pairs.select(F.col("feature_a").alias("src"), F.col("feature_b").alias("dst"), "value").unionByName(pairs.select(F.col("feature_b").alias("src"), F.col("feature_a").alias("dst"), "value"))
    r = both.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("value", "dst")))
    return r.filter(F.col("_r") <= k).select("src", "dst", (1 / (1 + F.col("value"))).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller end first, no loops; in as many tasks as shuffle partitions, so that a task holds no more than its share."""
    return dealt(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src != dst"), "src", "dst").distinct()


def _both(edges: DataFrame) -> DataFrame:
    """src, dst of edges in both directions, from one pass."""
    return edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """node, triangles: wedges run from the end with fewer edges, so a hub's edges are not squared."""
    held = Rounds(edges.sparkSession, "triangles")
    u = held.put(undirected(edges))
    return _triangles(held, u, held.put(degrees(u)))


#: Longs of a node's signature.
WORDS = 4


def _triangles(held: Rounds, u: DataFrame, d: DataFrame) -> DataFrame:
    e = u.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"), F.greatest("ds", "dd").alias("n"))
    slot = F.pmod(F.xxhash64("b"), F.lit(64 * WORDS))
    e = held.put(e.withColumns({"word": F.floor(slot / 64).cast("int"), "bit": F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))}))
    closed = _wedges(e).join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"])
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def _wedges(e: DataFrame) -> DataFrame:
    """a, b, c: pairs of ends of the edges e (a, b, n: b's edges, word and bit: b's place in a signature), which run from the node with fewer edges. Only pairs leave whose c may be
    an end of b by b's signature, a bit for each end: nodes with few ends of their own, as hubs have, pass hardly any pair that is no triangle."""
    signature = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"s{w}") for w in range(WORDS)]
    first = e.select("a", "b", "n").join(e.groupBy(F.col("a").alias("b")).agg(*signature), "b")
    second = e.select("a", F.col("b").alias("c"), F.col("n").alias("m"), "word", "bit")
    of_b = reduce(lambda got, w: F.when(F.col("word") == w, F.col(f"s{w}")).otherwise(got), range(1, WORDS), F.col("s0"))
    later = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("b") < F.col("c")))
    return first.join(second, "a").filter(later & (of_b.bitwiseAND(F.col("bit")) != 0)).select("a", "b", "c")


def clustering(edges: DataFrame) -> DataFrame:
    held = Rounds(edges.sparkSession, "clustering")
    u = held.put(undirected(edges))
    d = held.put(degrees(u))
    n = F.col("degree")
    return d.join(_triangles(held, u, d), "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce(divide(2.0 * F.coalesce("triangles", F.lit(0)), (n * (n - 1)).cast("double")), F.lit(0.0)).alias("clustering"))


def message_passing(edges: DataFrame, nodes: DataFrame, value: str, how: str = "sum") -> DataFrame:
    """node, message: sum or mean of the sources' values over incoming edges; nodes without edges get 0."""
    m = edges.join(nodes.select(F.col("node").alias("src"), F.col(value).alias("_v")), "src").groupBy(F.col("dst").alias("node")).agg((F.sum if how == "sum" else F.avg)("_v").alias("message"))
    return nodes.select("node").join(m, "node", "left").select("node", F.coalesce("message", F.lit(0.0)).alias("message"))


def gcn_weights(edges: DataFrame) -> DataFrame:
    """Edges in both directions with self loops, weighted 1 / sqrt(d_src d_dst)."""
    u = undirected(edges)
    both = u.unionByName(u.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = both.select(F.col("src").alias("node")).distinct()
    both = both.unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    d = both.groupBy("src").agg(F.count("*").alias("d"))
    return both.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """node, rank after the rounds; rank of nodes without outgoing edges is not passed on. The edges are written once, in buckets of their source; a round shuffles what
    the nodes get and is written as a row a node."""
    held = Rounds(edges.sparkSession, "rank")
    e = held.put_by(edges.select("src", "dst"), "src")
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    nodes = out.select(F.col("src").alias("node"), "n").unionByName(e.select(F.col("dst").alias("node"), F.lit(0).cast("long").alias("n")).distinct())
    now = held.put(nodes.groupBy("node").agg(F.max("n").alias("n")).withColumn("rank", F.lit(1.0)))
    for _ in range(rounds):
        sent = e.join(now.filter("n > 0").select(F.col("node").alias("src"), (F.col("rank") * (1 / F.col("n"))).alias("_v")), "src")
        got = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("_v").alias("_g"))
        before, now = now, held.put(now.join(got, "node", "left").select("node", "n", (1 - damping + damping * F.coalesce("_g", F.lit(0.0))).alias("rank")))
        held.drop(before)
    held.drop(e)
    return now.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node reaches; of undirected edges, loops and repeats allowed. Nodes must be of one ordered type.

    A round hangs each node under its least neighbour, if that is less, takes each node to the root of its tree, and puts roots for nodes in the edges, of which those within a tree
    and repeats go. A root without a tree of its own has a smaller neighbour in the next round, so trees halve in two rounds; on graphs with hubs the first leaves few. Tables of a
    round are written and those before it dropped."""
    held = Rounds(edges.sparkSession, "components")
    now, label = held.put(edges.select("src", "dst")), None
    while True:
        up = _roots(held, _both(now).filter("src is not null").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")).select("node", F.least("node", "least").alias("up")))
        before, label = label, up if label is None else held.put(label.join(up.select(F.col("node").alias("up"), F.col("up").alias("higher")), "up", "left").select("node", F.coalesce("higher", "up").alias("up")))
        if before is not None:
            held.drop(before)
        a, b = up.select(F.col("node").alias("src"), F.col("up").alias("_a")), up.select(F.col("node").alias("dst"), F.col("up").alias("_b"))
        rest = held.put(now.filter("src != dst").join(a, "src").join(b, "dst").filter("_a != _b").select(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).distinct())
        held.drop(now)
        if label is not up:
            held.drop(up)
        if rest.isEmpty():
            return label.select("node", F.col("up").alias("component"))
        now = rest


def _roots(held: Rounds, up: DataFrame) -> DataFrame:
    """node, up (a smaller node, or itself) with up's root in place of up: paths shorten to half in each round."""
    now = held.put(up)
    while True:
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"))
        after = held.put(now.join(above, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")))
        held.drop(now)
        now = after.select("node", "up")
        now._varve_round = after._varve_round
        if after.filter("moved").isEmpty():
            return now


def topology(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean_degree, components, largest (its nodes), triangles, transitivity (closed wedges over all wedges)."""
    held = Rounds(edges.sparkSession, "topology")
    u = held.put(undirected(edges))
    d = held.put(degrees(u))
    wedges = d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("wedges"))
    tri = _triangles(held, u, d).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("triangles"))
    parts = components(u).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    n, m = F.col("nodes").cast("double"), F.col("edges").cast("double")
    row = wedges.crossJoin(tri).crossJoin(parts)  # one row each
    density, mean = F.coalesce(divide(2 * m, n * (n - 1)), F.lit(0.0)), F.coalesce(divide(2 * m, n), F.lit(0.0))
    return row.select("nodes", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"), density.alias("density"), mean.alias("mean_degree"), "components", "largest", "triangles", F.coalesce(divide(3.0 * F.col("triangles"), F.col("wedges").cast("double")), F.lit(0.0)).alias("transitivity"))


def modularity(edges: DataFrame, member: DataFrame) -> float:
    """Of undirected edges src, dst, weight (a loop's weight counts twice in its node's strength) with member: node, community."""
    a, b = member.select(F.col("node").alias("src"), F.col("community").alias("ca")), member.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    e = edges.join(a, "src").join(b, "dst")
    m = F.col("weight")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("s"))
    total, inside = e.agg(F.sum(m), F.sum(F.when(F.col("ca") == F.col("cb"), m).otherwise(0.0))).first()
    if not total:
        return 0.0
    return inside / total - (ends.agg(F.sum(F.col("s") * F.col("s"))).first()[0] / (4 * total * total))


def communities(edges: DataFrame, rounds: int | None = None, levels: int | None = None, gamma: float = 1.0) -> DataFrame:
    """node, community: modularity by local moves and contraction. edges: src, dst (longs), optional weight; parallel edges add up.

    A level moves nodes, half of them in a round, until none wants to or four rounds (each node twice) gain nothing; then communities become nodes and their edges' weights add up. It
    ends when a level gains nothing, nor with fewer nodes a round. rounds, levels: at most so many, for tries; None: to the end. A community's number is its smallest node's. Rounds go over blocks of nodes (see
    moves), as many as a level's edges fill, and are written as a row a block; tables of earlier rounds are deleted. Three numbers a round reach the driver."""
    spark, held = edges.sparkSession, Rounds(edges.sparkSession, "communities")
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    now = held.put(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    final, level = None, 0
    while True:
        loop = F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)
        n, total, loops = now.agg(F.count("*"), F.sum("weight"), F.sum(loop)).first()
        if not total:
            return held.put(now.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.col("node")))
        with moves.blocks(spark, 2 * n) as ids:
            static = moves.placed(held, now, ids)
            state, gained = _settled(held, static, ids, rounds, total, loops, gamma)
            # named by its least node; the state's names are nodes of other communities where those have left
            member = moves.members(static, state)
            member = held.put(member.join(member.groupBy("community").agg(F.min("node").alias("least")), "community").select("node", F.col("least").alias("community")))
            for t in (static, state):
                held.drop(t)
        if final is None:
            final = member
        elif gained:
            before, final = final, held.put(final.select("node", F.col("community").alias("c")).join(member.select(F.col("node").alias("c"), "community"), "c").select("node", "community"))
            held.drop(before)
        level += 1
        if not gained or level == levels:
            break
        a, b = member.select(F.col("node").alias("src"), F.col("community").alias("ca")), member.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
        before, now = now, held.put(now.join(a, "src").join(b, "dst").groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight")))
        held.drop(before)
        if member is not final:
            held.drop(member)
    least = final.groupBy("community").agg(F.min("node").alias("least"))
    return final.join(least, "community").select("node", F.col("least").alias("community"))


def _settled(held: Rounds, static: DataFrame, ids: list[int], rounds: int | None, total: float, loops: float, gamma: float) -> tuple[DataFrame, bool]:
    """The level's best state, whether modularity rose. A round tells the modularity of the state that it starts from."""
    if len(ids) == 1:
        state = held.put(moves.settled_at_once(static, rounds, total, loops, gamma))
        start, best = state.select("start", "best").first()
        return state, best > start + 1e-9

    def step(state: DataFrame, turn: int, share: int) -> tuple:
        after = held.put(moves.moved(static, state, ids, turn, share, total, gamma))
        own, squares, n = after.agg(F.sum("own"), F.sum("squares"), F.sum("wish")).first()
        return after, (own, squares), n

    state, start, best = moves.settled(moves.alone(held, static), step, lambda own, squares: (own / 2 + loops) / total - gamma * squares / (4 * total * total), rounds, held.drop)
    return state, best > start + 1e-9


#: Sources whose numbers go in one row.
WIDE = 8


def betweenness(edges: DataFrame, sources: int | None = None, most: int | None = None) -> DataFrame:
    """node, betweenness: shortest paths between other nodes through each node, over undirected unweighted edges, halved. sources: from so many nodes (by hash) only, scaled
    up; None: from all. most: levels; None: all there are.

    WIDE sources (a group, g) share a row: a level sends a row along each edge of its nodes, with the path counts of the group's sources that are at this level, and is written as a
    row a node. Levels of all groups go in one job each: path counts forward, dependencies back. The edges are written once, in buckets of their source."""
    held = Rounds(edges.sparkSession, "betweenness")
    both = held.put_by(_both(undirected(edges)), "src")
    nodes = held.put(both.select(F.col("src").alias("node")).distinct())
    start = nodes if sources is None else nodes.orderBy(F.xxhash64("node"), "node").limit(sources)
    paths, sent = [f"p{i}" for i in range(WIDE)], [f"x{i}" for i in range(WIDE)]
    to = lambda f, names: both.join(f.withColumnRenamed("node", "src"), "src").groupBy("g", F.col("dst").alias("node")).agg(*(F.sum(c).alias(c) for c in names))
    mask = reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.col(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(paths)))
    slot = F.col("slot")
    first = held.put(start.withColumn("slot", F.monotonically_increasing_id()))  # written, so that a lost task changes no slot
    levels = [held.put(first.select(F.floor(slot / WIDE).alias("g"), "node", *(F.when(slot % WIDE == i, F.lit(1.0)).alias(c) for i, c in enumerate(paths))))]
    seen = levels[0].select("g", "node", mask.alias("m"))
    while most is None or len(levels) <= most:
        known = seen.groupBy("g", "node").agg(F.bit_or("m").alias("m"))
        step = to(levels[-1], paths).join(known, ["g", "node"], "left")
        new = lambda i: F.coalesce(F.col("m"), F.lit(0)).bitwiseAND(1 << i) == 0
        fresh = held.put(step.select("g", "node", *(F.when(new(i), F.col(c)).alias(c) for i, c in enumerate(paths))).filter(F.coalesce(*paths).isNotNull()))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("g", "node", mask.alias("m")))
        if len(levels) % 8 == 0:
            seen = held.put(seen.groupBy("g", "node").agg(F.bit_or("m").alias("m")))
    # a source itself has no part in its own paths, so that level 0 is left out
    every, due = nodes.select("node", F.lit(0.0).alias("b")), None
    for level in reversed(levels[1:]):
        now = level if due is None else level.join(to(due, sent), ["g", "node"], "left")
        delta = lambda i: F.lit(0.0) if due is None else F.coalesce(F.col(paths[i]) * F.col(sent[i]), F.lit(0.0))  # noqa: E731, B023
        owed = (F.when(F.col(c).isNotNull(), (1 + delta(i)) / F.col(c)).alias(sent[i]) for i, c in enumerate(paths))
        due = held.put(now.select("g", "node", *owed, reduce(lambda x, y: x + y, map(delta, range(WIDE))).alias("b")))
        every, due = every.unionByName(due.select("node", "b")), due.drop("b")
    scale = F.lit(1.0) if sources is None else nodes.count() / F.lit(max(1, min(sources, nodes.count())))
    return every.groupBy("node").agg(F.sum("b").alias("b")).select("node", (F.col("b") / 2 * scale).alias("betweenness"))

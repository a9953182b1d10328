"""Moves of a graph's nodes between communities, in blocks of nodes: a block's edges are written once as arrays, a round exchanges an array for each pair of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Rounds

#: Edges of a level that one task settles, and of a block of larger ones, in both directions.
ONCE, BLOCK = 1 << 22, 1 << 20
PARTS = "spark.sql.shuffle.partitions"
STATIC = "block int, nodes binary, k binary, peers binary, needed binary, sent binary, who binary, at binary, need binary, w binary"
STATE = "block int, com binary, k binary, wish long, own double, squares double"
MAIL = "block int, peer int, a binary, b binary"


@contextmanager
def blocks(spark: SparkSession, edges: int) -> Iterator[list[int]]:
    """Numbers of as many blocks as the edges fill, each of which Spark deals to a task of its own while this lasts."""
    n, before = 1 if edges <= ONCE else -(-edges // BLOCK), spark.conf.get(PARTS)
    ids = spark.range(40 * n).select(F.col("id").cast("int").alias("id"))
    made = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id"))
    spark.conf.set(PARTS, str(n))
    try:
        yield sorted(r.id for r in made.collect())
    finally:
        spark.conf.set(PARTS, before)


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _longs(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32)


def _doubles(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64)


def settled(state, step: Callable, quality: Callable, rounds: int | None, drop: Callable = lambda s: None) -> tuple:
    """The best state, the first one's quality and the best. step(state, turn, share) gives the state after a round, what tells the quality of the one before and how many wanted to
    move. Ends when none did in two rounds, or four gained nothing; where nothing has gained at all, since nodes moved at once, half as many of them try next, down to one a block."""
    best = kept = start = None
    turn = idle = still = share = wanted = 0
    while True:
        after, told, wish = step(state, turn, share)
        q, still, wanted = quality(*told), 0 if wish else still + 1, max(wanted, wish)
        if best is None or q > best + 1e-9:
            if kept is not None:
                drop(kept)
            start, best, kept, idle = q if start is None else start, q, state, 0
        else:
            if state is not kept:
                drop(state)
            idle += 1
        again = idle == 4 and best <= start + 1e-9 and 1 << share < wanted
        if still == 2 or turn == rounds or (idle == 4 and not again):
            drop(after)
            return kept, start, best
        if again:
            drop(after)
            after, idle, share, wanted = kept, -1, share + 1, 0
        state, turn = after, turn + 1


def placed(held: Rounds, now: DataFrame, ids: list[int]) -> DataFrame:
    """A row a block: its nodes, their strengths k, edges (who: the node's place, need: the other end's place among the needed nodes, sorted by the block that has them and number) and
    the places of the nodes that each of those blocks needs, which are its nodes with an edge to there. now: src, dst, weight, each edge once; loops count for k alone."""
    labels = F.array(*(F.lit(i) for i in ids))
    block = lambda c: F.element_at(labels, (F.pmod(F.xxhash64(c), F.lit(len(ids))) + 1).cast("int"))
    ends = F.explode(F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst", (2 * F.col("weight")).alias("weight")))).otherwise(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))))
    rows = now.select(ends.alias("e")).select(block("e.src").alias("block"), F.col("e.src").alias("node"), block("e.dst").alias("peer"), F.col("e.dst").alias("other"), "e.weight")

    def build(d: pd.DataFrame) -> pd.DataFrame:
        node, other, peer, w = (d[c].to_numpy() for c in ("node", "other", "peer", "weight"))
        nodes, who = np.unique(node, return_inverse=True)
        k = np.bincount(who, w, len(nodes))
        on = node != other
        who, other, peer, w = who[on], other[on], peer[on], w[on]
        o = np.lexsort((other, peer))
        first = np.r_[True, (other[o][1:] != other[o][:-1]) | (peer[o][1:] != peer[o][:-1])][: len(o)]
        need = np.empty(len(o), np.int64)
        need[o] = np.cumsum(first) - 1
        peers, needed = np.unique(peer[o][first], return_counts=True)
        pairs = np.unique(np.searchsorted(peers, peer) * len(nodes) + who)
        sent = np.bincount(pairs // len(nodes), minlength=len(peers))
        o = np.argsort(who, kind="stable")
        cells = (nodes, k, peers.astype(np.int32), needed.astype(np.int32), sent.astype(np.int32), (pairs % len(nodes)).astype(np.int32), who[o].astype(np.int32), need[o].astype(np.int32), w[o])
        return pd.DataFrame({"block": d["block"].iloc[:1], **dict(zip(("nodes", "k", "peers", "needed", "sent", "at", "who", "need", "w"), ([c.tobytes()] for c in cells), strict=True))})[[c.split()[0] for c in STATIC.split(", ")]]

    return held.put_by(rows.groupBy("block").applyInPandas(build, STATIC), "block")


def alone(held: Rounds, static: DataFrame) -> DataFrame:
    """Each node as a community."""
    return held.put(static.select("block", F.col("nodes").alias("com"), "k", F.lit(0).cast("long").alias("wish"), F.lit(0.0).alias("own"), F.lit(0.0).alias("squares")))


def members(static: DataFrame, state: DataFrame) -> DataFrame:
    """node, community."""
    run = lambda s, t: pd.DataFrame({"node": _longs(s["nodes"][0]), "community": _longs(t["com"][0])})
    return static.select("block", "nodes").groupBy("block").cogroup(state.select("block", "com").groupBy("block")).applyInPandas(run, "node long, community long")


def _block(s: pd.DataFrame) -> tuple[np.ndarray, ...]:
    return _longs(s["nodes"][0]), _doubles(s["k"][0]), _ints(s["who"][0]), _ints(s["need"][0]), _doubles(s["w"][0])


def _best(block: tuple[np.ndarray, ...], com: np.ndarray, tot: np.ndarray, c: np.ndarray, t: np.ndarray, turn: int, share: int, total: float, gamma: float) -> tuple[np.ndarray, int, float, float]:
    """The nodes' communities after a round, how many wanted to move, weights towards their own ones and strengths times their communities', both before it. tot: strengths of com; c, t:
    communities of the needed nodes and their strengths."""
    nodes, k, who, need, w = block
    squares = float((k * tot).sum())
    if not len(who):
        return com, 0, 0.0, squares
    u, first, i = np.unique(c, return_index=True, return_inverse=True)
    t = t[first]
    own = np.bincount(who, w * (c[need] == com[who]), len(nodes))
    stay = np.round(own - gamma * k * (tot - k) / (2 * total), 9)
    on = ((_mixed(nodes, turn // 2) & np.uint64(1)) == np.uint64(turn % 2))[who]
    key = who[on].astype(np.int64) * len(u) + i[need[on]]
    o = np.argsort(key)
    key, weight = key[o], w[on][o]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    if not len(at):
        return com, 0, float(own.sum()), squares
    key, weight = key[at], np.add.reduceat(weight, at)
    v, to = key // len(u), key % len(u)
    gain = np.where(u[to] == com[v], -np.inf, np.round(weight - gamma * k[v] * t[to] / (2 * total), 9))
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    most = np.maximum.reduceat(gain, at)
    place = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[at, len(v)])))
    place = place[np.r_[True, v[place][1:] != v[place][:-1]]]  # the least community of those that are best
    place = place[gain[place] > stay[v[place]]]
    out, wish = com.copy(), len(place)
    if share:
        place = place[np.argsort(_mixed(nodes[v[place]], turn + 1000))[: -(-wish // (1 << share))]]
    out[v[place]] = u[to[place]]
    return out, wish, float(own.sum()), squares


def settled_at_once(static: DataFrame, rounds: int | None, total: float, loops: float, gamma: float) -> DataFrame:
    """Of a level in one block the same rounds in one task: block, com, start, best."""

    def run(s: pd.DataFrame) -> pd.DataFrame:
        b, at = _block(s), _ints(s["at"][0])

        def step(com: np.ndarray, turn: int, share: int) -> tuple:
            u, i = np.unique(com, return_inverse=True)
            tot = np.bincount(i, b[1], len(u))[i]
            out, n, own, squares = _best(b, com, tot, com[at], tot[at], turn, share, total, gamma)
            return out, (own, squares), n

        com, start, best = settled(b[0], step, lambda own, squares: (own / 2 + loops) / total - gamma * squares / (4 * total * total), rounds)
        return pd.DataFrame({"block": s["block"], "com": [com.tobytes()], "start": [start], "best": [best]})

    return static.groupBy("block").applyInPandas(run, "block int, com binary, start double, best double")


def moved(static: DataFrame, state: DataFrame, ids: list[int], turn: int, share: int, total: float, gamma: float) -> DataFrame:
    """The state after a round, in which half of the nodes (by hash; the other half in the next one) go to the best community among their neighbours' by gain of modularity (9 digits;
    ties: their own, then the least), or a 2^share-th of those that gain; with how many do; own and squares are of the state before. Strengths of communities are summed in the block that a community's hash names."""
    labels = np.array(ids, np.int32)

    def parts(batches):
        for d in batches:
            for b, com, k in zip(d["block"], d["com"], d["k"], strict=True):
                u, i = np.unique(_longs(com), return_inverse=True)
                s, home = np.bincount(i, _doubles(k), len(u)), _mixed(u) % np.uint64(len(labels))
                o = np.argsort(home, kind="stable")
                at, cut = np.unique(home[o], return_index=True)
                us, ss = np.split(u[o], cut[1:]), np.split(s[o], cut[1:])
                yield pd.DataFrame({"block": labels[at.astype(np.int64)], "peer": np.int32(b), "a": [x.tobytes() for x in us], "b": [x.tobytes() for x in ss]})

    def totals(d: pd.DataFrame) -> pd.DataFrame:
        u, i = np.unique(np.concatenate([_longs(x) for x in d["a"]]), return_inverse=True)
        s = np.bincount(i, np.concatenate([_doubles(x) for x in d["b"]]), len(u))[i]
        cut = np.cumsum([len(x) // 8 for x in d["a"]])[:-1]
        return pd.DataFrame({"block": d["peer"], "peer": d["block"], "a": d["a"], "b": [x.tobytes() for x in np.split(s, cut)]})

    def letters(s: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        own = d["peer"] < 0
        com = _longs(d["a"][own].iloc[0])
        c, t = np.concatenate([_longs(x) for x in d["a"][~own]]), np.concatenate([_doubles(x) for x in d["b"][~own]])
        o = np.argsort(c)
        tot = t[o][np.searchsorted(c[o], com)]
        peers, cut, at = _ints(s["peers"][0]), np.cumsum(_ints(s["sent"][0]))[:-1], _ints(s["at"][0])
        cs, ts = (np.split(x[at], cut) if len(peers) else [] for x in (com, tot))
        me = s["block"][0]
        return pd.DataFrame({"block": [*peers, me], "peer": [*[me] * len(peers), -1], "a": [*(x.tobytes() for x in cs), com.tobytes()], "b": [*(x.tobytes() for x in ts), tot.tobytes()]})

    def go(s: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("peer")
        b, com, tot = _block(s), _longs(d["a"].iloc[0]), _doubles(d["b"].iloc[0])
        c, t = np.concatenate([_longs(b"".join(d["a"].iloc[1:])), com[:0]]), np.concatenate([_doubles(b"".join(d["b"].iloc[1:])), tot[:0]])
        out, n, own, squares = _best(b, com, tot, c, t, turn, share, total, gamma)
        return pd.DataFrame({"block": s["block"], "com": [out.tobytes()], "k": [s["k"][0]], "wish": [n], "own": [own], "squares": [squares]})

    mail = state.select("block", "com", "k").mapInPandas(parts, MAIL).groupBy("block").applyInPandas(totals, MAIL)
    mail = mail.unionByName(state.select("block", F.lit(-1).alias("peer"), F.col("com").alias("a"), F.lit(None).cast("binary").alias("b")))
    sent = static.select("block", "peers", "sent", "at").groupBy("block").cogroup(mail.groupBy("block")).applyInPandas(letters, MAIL)
    return static.select("block", "nodes", "k", "who", "need", "w").groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(go, STATE)

"""Exact Jaccard self-join of documents on word shingles: size-banded tiles, bitmap bounds, sorted-array intersection.

1. heavy: the most frequent shingles of all documents (HEAVY of them at most, 24 bytes each) put last in one global order of shingles.
2. sketch: per document the set's size, digest, parity bitmap, min-hash keys and its prefix in that order; equal sets become one.
3. stars: sets that share a min-hash key are tied to the key's leaders where the bitmap bound allows a link. Each key has
   leaders of its own, so a set in a loose group is held against many members.
4. tiles: two linked sets share a prefix shingle. Per shingle, sets of different ties within each other's size band, whose places in the
   prefixes leave room for the needed overlap, form pairs; pairs that the bitmap bound allows are tied too. So every link lies within one
   tie. Bitmaps grow with their sets, so they meet the distinct pairs instead of travelling with every shingle; only a prefix shingle with more
   than SPLIT holders, which is dealt to (group, group) tiles, takes its sets' bitmaps along, folded to 256 bits.
5. links: each tie's texts meet in tiles of blocks; the bitmap bound and then the intersection of sorted arrays decide; sets already
   connected are skipped. First every block meets itself and the tie's first block, which connects a group of near copies at a cost
   linear in its size; then only sets outside the tie's largest component meet the tie's other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BoundedCache, Stash, bounded_batches, slices, worker_cache

SHINGLE = 5
#: A link: NUMERATOR * union <= DENOMINATOR * intersection, that is, similarity of at least 0.75.
NUMERATOR, DENOMINATOR = 75, 100
HEAVY = 1 << 20
BANDS, ROWS, LEADERS = 8, 2, 3
#: Documents, and shingles, that a task holds at once at most.
CHUNK, CHUNK_SHINGLES = 8000, 2_000_000
#: Prefix shingles per bucket on average, and holders of one shingle beyond which they are split over (group, group) tiles.
BUCKET, SPLIT = 1 << 18, 1 << 16
#: 64-bit words of the folded bitmaps of split shingles.
FOLDED = 4
#: Documents, and shingles, per block of a tie.
BLOCK, BLOCK_SHINGLES = 1024, 400_000
#: Rows, and pairs, that a tile looks at in one step; pairs held before they are made distinct.
TILE, PAIRS, FOLD = 256, 1 << 21, 1_000_000
CACHE_WORDS = 200_000
_MULTIPLIERS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of the text with A-Z lower-cased; fewer words: one of them all; no word: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    word = worker_cache("shingles", lambda: BoundedCache(xxhash.xxh64_intdigest, CACHE_WORDS)).__getitem__
    h = np.fromiter(map(word, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = total + h[i : i + n] * _MULTIPLIERS[i]
    return np.unique(_mixed(total))


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least intersection of linked sets of n and m elements."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of 2^k bits, at least 2 bits per element and 256 in all; as 64-bit words."""
    bits = max(256, 1 << (2 * max(1, len(s)) - 1).bit_length())
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap cut to fewer words: parities of the halves add up."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def may_link(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether the bitmaps allow a link: each differing bit stands for an element that only one of the sets has."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    k = min(len(x), len(y))
    apart = int(np.bitwise_count(fold(x, k) ^ fold(y, k)).sum())
    return (n + m - apart) // 2 >= needed(n, m)


def _heavy_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    on = counts >= 2
    return values[on], counts[on]


def _count_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: list[np.ndarray] = []
    size = 0

    def told() -> pa.RecordBatch:
        nonlocal size
        values, counts = _heavy_of(sets)
        sets.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

    for batch in batches:
        for x in batch.column(0):
            sets.append(shingle_set(x.as_py()))
            size += len(sets[-1])
            if len(sets) == CHUNK or size >= CHUNK_SHINGLES:
                yield told()
    if sets:
        yield told()


def heavy_shingles(docs: DataFrame, stash: Stash, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand out in some chunk of the documents, sorted, and their ranks from rare to frequent; `most` at most. Which ones are found decides
    the order alone: links don't depend on it, and hot elements of prefixes are counted by themselves."""
    found = stash.put(docs.select("text").filter("text is not null").mapInArrow(_count_heavy, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2("n") * 16).cast("int")  # any order of shingles gives the same links, so whole steps of counts are cut
    cut, held = 1 << 30, 0
    for row in found.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():  # under 1024 rows
        held += row.rows
        if held > most:
            break
        cut = row.step
    table = found.filter(step >= cut).orderBy("n", "token").toArrow()
    stash.drop(found)
    tokens = np.asarray(table.column("token").to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.arange(1, len(tokens) + 1, dtype=np.uint64)[order]


def prefix(s: np.ndarray, heavy: tuple[np.ndarray, ...]) -> np.ndarray:
    """The first elements of a set in the global order, of which any linked set has one: heavy ones last, others by hash."""
    key = s >> np.uint64(1)
    tokens, ranks = heavy
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        hit = tokens[at] == s
        key[hit] = np.uint64(1 << 63) + ranks[at[hit]]
        key.sort()
    return key[: len(s) - (-(-NUMERATOR * len(s) // DENOMINATOR)) + 1]


def _sketch(heavy):
    names = ["doc_id", "n", "h1", "h2", "bitmap", "folded", "bands", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            rows = []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or "")
                if not len(s):
                    rows.append((0, 0, 0, b"", b"", [], b""))
                    continue
                low = np.array([(s * m).min() for m in _MULTIPLIERS[: BANDS * ROWS]]).reshape(BANDS, ROWS)
                bands = _mixed((low * _MULTIPLIERS[32 : 32 + ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                bits = bitmap(s)
                rows.append((len(s), int(digest[0]), int(digest[1]), bits.tobytes(), fold(bits, FOLDED).tobytes(), bands.tolist(), prefix(s, heavy.value).tobytes()))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    return run


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v, a, b, n, m = (batch.column(i).to_pylist() for i in range(6))
        on = [may_link(*x) for x in zip(a, b, n, m, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, o in zip(u, on, strict=True) if o], pa.int64()), pa.array([x for x, o in zip(v, on, strict=True) if o], pa.int64())], ["u", "v"])


def bounded_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs u, v that the bitmaps of their sets (rep, n, bitmap) allow to be linked."""
    a = sets.select(F.col("rep").alias("u"), F.col("bitmap").alias("a"), F.col("n").alias("n"))
    b = sets.select(F.col("rep").alias("v"), F.col("bitmap").alias("b"), F.col("n").alias("m"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", "n", "m").mapInArrow(_bound, "u long, v long")


def _count_slots(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            tok = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            counts += np.bincount((_mixed(tok) % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    return run


def _count_elements(slots: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            values, counts = np.unique(tok[np.isin((_mixed(tok) % np.uint64(slots)).astype(np.int64), hot)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["token", "n"])

    return run


def hot_elements(prefixes: DataFrame, elements: int, split: int = SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """Elements with more than `split` holders among the prefixes (one column of packed elements), sorted, and their holders: elements / split of them at most.

    Slots of a hash are counted first, about eight for each element that could be hot; then exactly the elements of the slots that are over the limit."""
    slots = 1 << max(10, (8 * elements // split).bit_length())
    found = prefixes.mapInArrow(_count_slots(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") > split)
    hot = np.asarray(found.select("slot").toArrow().column(0).to_numpy(), np.int64)
    if not len(hot):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counted = prefixes.mapInArrow(_count_elements(slots, hot), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > split).toArrow()
    tokens = np.asarray(counted.column("token").to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.asarray(counted.column("n").to_numpy(), np.int64)[order]


def _deal(buckets: int, hot, split: int = SPLIT):
    """Prefix elements as one row of packed arrays per bucket of element hashes, so that a shuffle moves few rows. A hot element (of more than
    `split` holders) is dealt as one element per pair of groups of them: group g meets itself, and as one of two sides every other group.
    Those have buckets of their own, sized alike, and take along the folded bitmaps of their sets."""

    def told(parts: list[tuple[np.ndarray, ...]], first: int, buckets: int) -> pa.RecordBatch:
        tok, rep, place, comp, *folded = (np.concatenate(c) for c in zip(*parts, strict=True))
        bucket = (tok % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
        columns = [c[order] for c in (tok, rep, place, comp, *folded)]
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        packed = [pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns]
        packed += [pa.array([b""] * len(spans), pa.binary())] * (5 - len(packed))
        return pa.RecordBatch.from_arrays([pa.array(first + bucket[order][cuts[:-1]]), *packed], ["bucket", "tok", "rep", "place", "comp", "folded"])

    def packed(held: list[tuple[int, int, int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        tokens = [np.frombuffer(x[3], np.uint64) for x in held]
        size = np.array([len(t) for t in tokens])
        tok = np.concatenate(tokens)
        rep, n, comp = (np.repeat(np.array([x[i] for x in held], np.int64), size) for i in range(3))
        place = n << 32 | (np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)) << 2 | 2  # size, place in the prefix, side
        elements, holders = hot.value
        groups = np.ones(len(tok), np.int64)
        if len(elements):
            at = np.minimum(np.searchsorted(elements, tok), len(elements) - 1)
            groups = np.where(elements[at] == tok, -(-holders[at] // split), 1)
        tok = _mixed(tok)
        one = groups == 1
        if one.any():
            yield told([(tok[one], rep[one], place[one], comp[one])], 0, buckets)
        many = np.flatnonzero(~one)
        if not len(many):
            return
        folded = np.frombuffer(b"".join(x[4] for x in held), np.uint64).reshape(-1, FOLDED)
        doc = np.repeat(np.arange(len(held)), size)
        tiles = max(1, int((holders * -(-holders // split)).sum()) // BUCKET)
        parts, count = [], 0
        for k in np.unique(groups[many]).tolist():
            at = many[groups[many] == k]
            g = (_mixed(rep[at].view(np.uint64)) % np.uint64(k)).astype(np.int64)
            for h in range(k):
                low, high = np.minimum(g, h), np.maximum(g, h)
                side = np.where(low == high, 2, (g == high).astype(np.int64))
                parts.append((_mixed(tok[at] + (low * k + high + 1).astype(np.uint64)), rep[at], place[at] & ~3 | side, comp[at], folded[doc[at]]))
                count += len(at)
                if count >= FOLD:
                    yield told(parts, buckets, tiles)
                    parts, count = [], 0
        if parts:
            yield told(parts, buckets, tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(row)
                size += len(row[3]) // 8
                if size >= CHUNK_SHINGLES // 8:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns, of rows sorted by them."""
    held, last = [], None
    for batch in batches:
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        cuts = [i for i in range(len(values)) if values[i] != (values[i - 1] if i else last)]
        for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if a in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
        last = values[-1] if values else last
    if held:
        yield pa.Table.from_batches(held)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket: sets with a shared element, of different ties, whose sizes and places allow a link; repeats occur."""
    for table in _groups(batches, 1):
        yield from _tile(table)


def _tile(table: pa.Table) -> Iterator[pa.RecordBatch]:
    tok, rep, place, comp = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("tok", "rep", "place", "comp"))
    order = np.lexsort((place, tok))
    tok, rep, place, comp = tok[order], rep[order], place[order], comp[order]
    folded = np.frombuffer(b"".join(table.column("folded").to_pylist()), np.uint64).reshape(-1, FOLDED)
    folded = folded[order] if len(folded) else None
    n, at, side = place >> 32, place >> 2 & (1 << 30) - 1, place & 3
    starts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    ends = np.r_[starts[1:], len(tok)]
    mixed = np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)
    reps, local = np.unique(rep, return_inverse=True)
    found, fresh, size = np.zeros(0, np.int64), [], 0  # pairs as one number each, made distinct whenever FOLD of them are held

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(reps[found // len(reps)]), pa.array(reps[found % len(reps)])], ["u", "v"])

    for a, b in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        reach = np.searchsorted(n[a:b], n[a:b] * DENOMINATOR // NUMERATOR, "right")  # sorted by size: a set's band ends there
        count = reach - np.arange(1, b - a + 1)
        step = max(1, min(TILE, PAIRS // (b - a)))
        for t in range(0, b - a, step):
            c = count[t : t + step]
            left = np.repeat(np.arange(t, t + len(c)), c)
            right = a + left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            left += a
            room = np.minimum(n[left] - at[left], n[right] - at[right])  # if this is their first common element, no more can be common
            on = (comp[left] != comp[right]) & (room >= needed(n[left], n[right])) & ((side[left] != side[right]) | (side[left] == 2))
            left, right = left[on], right[on]
            if folded is not None:
                apart = np.bitwise_count(folded[left] ^ folded[right]).sum(1).astype(np.int64)
                on = (n[left] + n[right] - apart) // 2 >= needed(n[left], n[right])
                left, right = left[on], right[on]
            x, y = local[left], local[right]
            fresh.append(np.minimum(x, y) * len(reps) + np.maximum(x, y))
            size += len(x)
            if size >= FOLD:
                found, fresh, size = np.unique(np.concatenate([found, *fresh])), [], 0
                if len(found) >= FOLD:
                    yield told()
                    found = found[:0]
    found = np.unique(np.concatenate([found, *fresh]))
    yield told()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, 3):
        edges = _tile_links(table)
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])


def _tile_links(table: pa.Table) -> list[tuple[int, int]]:
    """A spanning forest of the links between a tile's two blocks (or within its one block), beyond what is known to be connected."""
    ids, side = table.column("doc_id").to_pylist(), np.array(table.column("side").to_pylist())
    comp = np.unique(table.column("known").to_numpy(), return_inverse=True)[1]
    within = bool((side == side[0]).all())
    if comp.max() == 0:
        return []
    sets = [shingle_set(t or "") for t in table.column("text").to_pylist()]
    size = np.array([len(s) for s in sets])
    maps = [bitmap(s) for s in sets]
    words = np.array([len(m) for m in maps])
    edges: list[tuple[int, int]] = []
    for k in sorted(set(words.tolist())):
        at = np.flatnonzero(words >= k)
        rows = np.array([fold(maps[i], k) for i in at])  # bitmaps of at least so many words, cut to it
        for i in np.flatnonzero(words == k).tolist():
            may = (at != i) & (comp[at] != comp[i]) & (within | (side[at] != side[i])) & ((size[at] > size[i]) | ((size[at] == size[i]) & (at > i)) | (words[at] > k))
            cand = at[may]
            if not len(cand):
                continue
            apart = np.bitwise_count(rows[may] ^ fold(maps[i], k)).sum(1).astype(np.int64)
            cand = cand[(size[i] + size[cand] - apart) // 2 >= needed(size[i], size[cand])]
            for j in cand.tolist():
                if comp[i] == comp[j]:
                    continue
                small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                found = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if int((large[found] == small).sum()) >= needed(int(size[i]), int(size[j])):
                    edges.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
    return edges


def tie_links(docs: DataFrame, members: DataFrame, stash: Stash) -> DataFrame:
    """Edges u, v that connect the linked sets of each tie. docs: doc_id, text; members: doc_id, n, component (the tie)."""

    def met(dealt: DataFrame) -> DataFrame:
        """dealt: component, doc_id, known, block, others (blocks that it meets)."""
        tiles = docs.join(dealt.withColumn("other", F.explode("others")), "doc_id").select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "doc_id", "known", "text")
        return tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_links, "u long, v long")

    size = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    dealt = stash.put(members.join(members.groupBy("component").agg(size.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = stash.put(met(dealt.select("component", "doc_id", F.col("doc_id").alias("known"), "block", F.when(F.col("block") == 0, every).otherwise(F.array(F.lit(0).cast("long"), F.col("block"))).alias("others"))))
    known = stash.put(components(first, stash))

    wide = dealt.filter("blocks > 1").join(known, F.col("doc_id") == F.col("node"), "left").select(dealt["component"].alias("tie"), "doc_id", "n", F.coalesce(known["component"], "doc_id").alias("known"))
    parts = wide.groupBy("tie", "known").agg(F.count("*").alias("c"))
    main = parts.groupBy("tie").agg(F.max_by("known", F.struct("c", "known")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("tie", "main")
    apart = wide.join(main, "tie").select("tie", "doc_id", "n", "known", (F.col("known") != F.col("main")).alias("rest"))
    sizes = apart.groupBy("tie", "rest").agg(size.alias("blocks")).groupBy("tie").agg(F.sum(F.when(F.col("rest"), F.col("blocks"))).alias("rests"), F.sum("blocks").alias("blocks"))
    placed = apart.join(sizes, "tie").withColumn("block", F.when(F.col("rest"), F.pmod(F.xxhash64("doc_id"), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64("doc_id"), F.col("blocks") - F.col("rests"))))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("rest"), F.col("blocks")).otherwise(F.col("rests")) - 1)
    second = met(placed.select(F.col("tie").alias("component"), "doc_id", "known", "block", others.alias("others")))
    return first.unionByName(second)


def near_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for every row.

    Null, empty and word-free texts have no shingles and link with nothing; equal sets are linked. Rows that repeat a doc_id are
    one node, linked if any of their texts is. Null doc_ids link with nothing. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "shingles")
    docs = docs.select("doc_id", "text")
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, stash, HEAVY))
    sketch = stash.put(docs.mapInArrow(_sketch(heavy), "doc_id long, n int, h1 long, h2 long, bitmap binary, folded binary, bands array<long>, tokens binary"))
    usable = "n > 0 and doc_id is not null"
    ids = stash.put(sketch.select("doc_id", "n", "h1", "h2"))
    equal = stash.put(ids.filter(usable).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))  # written, so that the joins below are not dealt by the hot digest of many copies
    reps = stash.put(sketch.filter(usable).join(equal.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"]).dropDuplicates(["h1", "h2"]).withColumnRenamed("doc_id", "rep"))
    stash.drop(sketch)

    keys = reps.select("rep", "n", F.explode("bands").alias("key"))
    chosen = [F.min(F.struct(F.xxhash64("rep", "key", F.lit(i)), F.col("rep").alias("v"), F.col("n").alias("m"))).alias(f"l{i}") for i in range(LEADERS)]
    leaders = keys.groupBy("key").agg(F.count("*").alias("c"), *chosen).filter("c > 1").select("key", F.explode(F.array_distinct(F.array(*(F.struct(f"l{i}.v", f"l{i}.m") for i in range(LEADERS))))).alias("l"))
    stars = keys.join(leaders, "key").select(F.least("rep", "l.v").alias("u"), F.greatest("rep", "l.v").alias("v"), "n", "l.m")
    stars = stars.filter(f"u != v and least(n, m) * {DENOMINATOR} >= greatest(n, m) * {NUMERATOR}").select("u", "v").distinct()
    ties = stash.put(components(bounded_pairs(stars, reps), stash))

    elements = reps.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    hot = spark.sparkContext.broadcast(hot_elements(reps.select("tokens"), int(elements), SPLIT))
    placed = reps.select("rep", "n", "tokens", "folded").join(ties, F.col("rep") == F.col("node"), "left").select("rep", F.col("n").cast("long").alias("n"), F.coalesce("component", "rep").alias("comp"), "tokens", "folded")
    dealt = placed.mapInArrow(_deal(max(1, int(elements) // BUCKET), hot, SPLIT), "bucket long, tok binary, rep binary, place binary, comp binary, folded binary")
    pairs = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tiles, "u long, v long").distinct()
    more = bounded_pairs(pairs, reps)
    ties = stash.put(components(more.unionByName(ties.select(F.col("node").alias("u"), F.col("component").alias("v"))), stash))

    members = stash.put(ties.join(reps.select("rep", "n"), F.col("node") == F.col("rep")).select(F.col("node").alias("doc_id"), "n", "component"))
    stash.drop(reps)
    several = stash.put(ids.filter(usable).groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).filter("low != high").select("doc_id"))
    own = several.join(ids.filter(usable), "doc_id").join(equal, ["h1", "h2"]).select("doc_id", "rep")  # of ids with several texts
    same = own.join(own.groupBy("doc_id").agg(F.min("rep").alias("u")), "doc_id").select("u", F.col("rep").alias("v")).filter("u != v")
    linked = components(tie_links(docs, members, stash).unionByName(same), stash)

    told = equal.join(linked, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    some = ids.filter(usable).join(told, ["h1", "h2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = ids.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)

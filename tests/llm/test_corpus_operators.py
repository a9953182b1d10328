"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats, no rows and extra columns."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from varve.llm import components as comp
from varve.llm import html_text, language, license_scan, mixing, near_vectors, packing, quality, queries, shingle_join, token_codec, token_files, topk
from varve.llm.shared import Stash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, seg int, score double, rank int, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "the of and river stone house walk light paper winter garden machine signal copper".split()


def sentence(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def documents(spark, rows):
    return spark.createDataFrame([(*r, None, -1, -1, -1.0, -1, -1) for r in rows], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    base = sentence(1, 120)
    rows = [(i, sentence(i, 5 + 3 * i), ("en", "fr", None)[i % 3], f"s{i % 3}") for i in range(20)]
    rows += [(20, None, None, None), (21, "", "en", None), (22, " \t\n ", "en", "s0"), (23, "one", "en", "s0"), (24, "one two  three\n\nfour", "fr", "s1")]
    rows += [(25, base, "en", "big"), (26, base, "en", "big"), (27, base.upper(), "en", "big"), (28, base + " extra words here", "en", "big"), (29, base.replace("river", "lake"), "en", "big")]
    rows += [(30, " ".join([base] * 60), "en", "big"), (31, "héllo wörld \x1c odd   spaces　here <|endoftext|> it's", "fr", "s2"), (5, sentence(5, 20), "en", "s0"), (None, "no id at all here now", "en", "s1")]
    return documents(spark, rows)


def plain(df):
    return [tuple(r) for r in df.collect()]


def tokens(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


@pytest.mark.parametrize("ids", [[], [0], [0] * 700, list(range(300)), [1 << 59, (1 << 60) - 1, 1 << 60, (1 << 64) - 1, 3, 0, 2 << 60], [50256, 7, 1 << 63, 1 << 63, 5]])
def test_simple8b_round_trip(ids):
    words, offsets = token_codec.simple8b_encode(np.array(ids, np.uint64), block=64)
    assert token_codec.simple8b_decode(words).tolist() == ids
    for k, at in enumerate(offsets):  # each block can be decoded alone
        end = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert token_codec.simple8b_decode(words[at:end]).tolist() == ids[64 * k : 64 * k + 64]


def test_simple8b_random_round_trip():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << rng.integers(1, 62, 5000).astype(np.uint64), dtype=np.uint64)
    words, _ = token_codec.simple8b_encode(ids, block=512)
    assert (token_codec.simple8b_decode(words) == ids).all()


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", "a   b", "a\n\nb", " a ", "a\tb  c", "\n", "a\n b", "x <|endoftext|> y", "don't we'll 12,5%", "a\x1cb", "　a b\xa0c", "é" * 5 + "  \n \n", "a \n", "日本語 текст", "퟿ a"])
def test_chunked_encoding_equals_the_library(text):
    assert np.frombuffer(token_codec.encoder(queries.tokenizer_path()).encode(text), "<u4").tolist() == tokens([text])[0][:-1].tolist()


def test_token_files(spark, docs):
    got = plain(token_files.token_files(docs, queries.tokenizer_path()))
    rows = sorted(((r.doc_id is not None, r.doc_id), r.doc_id, r.text) for r in docs.collect() if r.doc_id != 5)
    want = Counter()
    got_at = {}
    for doc, start, n, crc in got:
        want[doc] += 1
        got_at[start] = (doc, n, crc)
    assert want[5] == 2 and want[None] == 1 and len(got) == docs.count()
    at = 0
    seen = []
    while at in got_at:  # starts are gapless and ids ascend
        seen.append(got_at[at])
        at += got_at[at][1]
    assert len(seen) == len(got) and [(s[0] is not None, s[0] or 0) for s in seen] == sorted((s[0] is not None, s[0] or 0) for s in seen)
    by_id = {s[0]: s for s in seen}
    for _, doc, text in rows:
        ids = tokens([text])[0]
        assert by_id[doc][1:] == (len(ids), zlib.crc32(ids.tobytes()))
    assert plain(token_files.token_files(docs.limit(0), queries.tokenizer_path())) == []


def test_packing(spark, docs):
    got = packing.pack(docs, queries.tokenizer_path(), window=64).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in docs.filter("doc_id is null or doc_id != 5").collect():
        ids, at = tokens([r.text])[0], 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    lengths = []
    for _, pieces in itertools.groupby(sorted(got, key=lambda p: (p.sequence_id, p.offset)), key=lambda p: p.sequence_id):
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        lengths.append(at)
    assert all(n == 64 for n in lengths[:-1]) and 0 < lengths[-1] <= 64
    assert packing.pack(docs.limit(0), queries.tokenizer_path()).collect() == []


def fill(sizes, weights):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped, t = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        t |= {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 2 * sizes[s] + 1e-9}
        t |= {s: 2.0 * sizes[s] for s in over}
        if not over:
            return t
        capped |= over


def test_mixing(spark, docs):
    assert mixing.mix(docs).count() == docs.count()
    docs = docs.filter("doc_id is null or doc_id != 5")
    got = mixing.mix(docs, block_words=4).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    size = {(r.doc_id, len(WORD.findall(r.text or ""))) for r in rows}
    assert {(r.doc_id, r["size"]) for r in got} == size
    sizes, source = Counter(), {}
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        source[r.doc_id] = r.source
    want, taken = fill(sizes, (3, 1, 2)), Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 12 + 0.03 * want[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), block_words=4).collect()))
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixing_slots_are_dealt_once(spark, docs):
    _, sources, slots = mixing.plan(docs, Stash(spark, "t"), block_words=4, shard_slots=64)
    quota = {r.skey: (r.blocks, r.quota) for r in sources.collect()}
    rows = slots.collect()
    drawn = Counter((r.skey, r.block) for r in rows)
    assert len({r.slot for r in rows}) == len(rows) == sum(n for _, n in quota.values()) and all(r.shard == r.slot // 64 for r in rows)
    for key, (blocks, n) in quota.items():
        mine = {b: c for (k, b), c in drawn.items() if k == key}
        assert sum(mine.values()) == n and all(0 <= b < blocks for b in mine) and (not mine or max(mine.values()) <= -(-n // blocks))


def test_mixing_shards_are_multinomial_draws(spark):
    """Counts per shard vary as a multinomial's do: the variance of a source's share over the shards is n p (1 - p)."""
    d = documents(spark, [(i, sentence(i, 600), "en", f"s{i % 3}") for i in range(60)])
    _, sources, slots = mixing.plan(d, Stash(spark, "t"), block_words=4, shard_slots=100)
    quota = {r.skey: r.quota for r in sources.collect()}
    counts = mixing.shard_counts(slots).collect()
    total, last = sum(quota.values()), max(r.shard for r in counts)
    for key, q in quota.items():
        per, p = np.array([r.n for r in counts if r.skey == key and r.shard < last]), q / total
        assert abs(per.mean() - 100 * p) < 3 and 0.5 < per.var() / (100 * p * (1 - p)) < 1.7


def test_taken_words_equal_those_of_the_drawn_slots(spark, docs):
    """taken, recomputed word by word: each document's words in its source's stream, by the number of draws of their block."""
    some = docs.filter("doc_id is null or doc_id != 5")
    placed, _, slots = mixing.plan(some, Stash(spark, "t"), block_words=4)
    draws = Counter((r.skey, r.block) for r in slots.collect())
    stream = {}
    for r in placed.collect():
        for w in range(r.start, r.start + r["size"]):
            assert (r.skey, w) not in stream
            stream[r.skey, w] = r.doc_id
    for key in {k for k, _ in stream}:  # streams are gapless
        assert sorted(w for k, w in stream if k == key) == list(range(sum(k == key for k, _ in stream)))
    want = Counter()
    for (key, w), doc in stream.items():
        want[doc] += draws[key, w // 4]
    got = {r.doc_id: r.taken for r in mixing.mix(some, block_words=4).collect()}
    assert {d: n for d, n in got.items() if n} == {d: n for d, n in want.items() if n}


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 5, 64, 1000, 1023):
        x = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k"))).collect()]
        assert sorted(x) == list(range(n))


def test_mixed_documents(spark, docs):
    some = docs.filter("doc_id != 5")
    out = mixing.mixed_documents(some, block_words=4)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    taken = {r.doc_id: r.taken for r in mixing.mix(some, block_words=4).collect()}
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split(" "))
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(words)


def brute_links(rows):
    sets = {}
    for doc, text in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in (text or "")))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_family(seed, count, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    for _ in range(count):
        text = list(base)
        for at in rng.integers(0, words, rng.integers(0, edits + 1)):
            text[at] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(text)


def test_shingle_join_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id is not null and doc_id != 5").collect()]
    texts = [*near_family(1, 30, 200, 6), *near_family(2, 40, 60, 3), *near_family(3, 10, 900, 30), *(sentence(100 + i, 40) for i in range(30))]
    rows += [(1000 + i, t) for i, t in enumerate(texts)]
    got = shingle_join.near_documents(documents(spark, [(d, t, None, None) for d, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(rows) and len(got) == len(rows)


def test_shingle_join_in_small_tiles_and_blocks(spark, monkeypatch):
    """Hot shingles split over (group, group) tiles, ties of many blocks, pairs told in pieces."""
    for name, value in (("SPLIT", 8), ("BUCKET", 500), ("BLOCK", 8), ("BLOCK_SHINGLES", 3000), ("FOLD", 50), ("LEADERS", 1), ("BANDS", 2), ("HEAVY", 300), ("TILE", 4)):
        monkeypatch.setattr(shingle_join, name, value)
    chain = [f"c{i}" for i in range(200)]
    texts = [*near_family(11, 60, 100, 9), *near_family(12, 50, 80, 8), *(" ".join(chain[i : i + 90]) for i in range(0, 110, 3)), *(sentence(1, 40) + " " + sentence(300 + i, 12) for i in range(40))]
    rows = list(enumerate(texts))
    got = shingle_join.near_documents(documents(spark, [(d, t, None, None) for d, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(rows) and len(got) == len(rows)


def test_shingle_join_counts_holders_across_chunks(spark):
    """An element that occurs once in each of 40 partitions is hot; its holders are dealt to tiles of bounded groups in which each pair meets once."""
    rng = np.random.default_rng(8)
    common = np.uint64(77)
    prefixes = [np.sort(np.append(rng.integers(1 << 20, 1 << 62, 5, dtype=np.uint64), common)) for _ in range(40)]
    df = spark.createDataFrame([(p.tobytes(),) for p in prefixes], "tokens binary").repartition(40)
    elements, holders = shingle_join.hot_elements(df, 240, 8)
    assert elements.tolist() == [77] and holders.tolist() == [40]
    assert [len(x) for x in shingle_join.hot_elements(df, 240, 40)] == [0, 0] and len(shingle_join.hot_elements(df.limit(0), 0)[0]) == 0

    class Sent:
        value = elements, holders

    rows = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([6] * 40, pa.int64()), pa.array(range(40), pa.int64()), pa.array([p.tobytes() for p in prefixes]), pa.array([bytes(32)] * 40)], ["rep", "n", "comp", "tokens", "folded"])
    runs, cold = defaultdict(list), 0
    for batch in shingle_join._deal(1, Sent, 8)(iter([rows])):
        for bucket, tok, rep, place, _, folded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cold += len(tok) // 8 if bucket == 0 else 0
            assert bool(folded) == (bucket > 0)
            for t, r, at in zip(np.frombuffer(tok, np.uint64).tolist(), np.frombuffer(rep, np.int64).tolist(), np.frombuffer(place, np.int64).tolist(), strict=True):
                if bucket > 0:
                    runs[t].append((r, at & 3))
    assert cold == 200 and max(map(len, runs.values())) < 40 and sum(map(len, runs.values())) == 40 * 5
    met = Counter(tuple(sorted((a, b))) for run in runs.values() for (a, x), (b, y) in itertools.combinations(run, 2) if x != y or x == 2)
    assert len(met) == 40 * 39 // 2 and set(met.values()) == {1}


def test_shingle_join_with_no_heavy_shingle(spark, monkeypatch):
    """Passages that many texts share are split by the holders of prefix elements alone, also where no chunk sees them twice."""
    for name, value in (("SPLIT", 8), ("BUCKET", 400), ("HEAVY", 0), ("LEADERS", 1), ("BANDS", 2)):
        monkeypatch.setattr(shingle_join, name, value)
    shared = sentence(9, 45)
    rows = list(enumerate([*(shared + " " + sentence(500 + i, 14) for i in range(50)), *near_family(21, 40, 120, 10), *(sentence(700 + i, 30) + " " + shared for i in range(30))]))
    got = shingle_join.near_documents(documents(spark, [(d, t, None, None) for d, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(rows) and len(got) == len(rows)


def test_shingle_join_of_repeated_ids(spark):
    """A repeated id is one node: it links whatever any of its texts links, equal texts of other ids included."""
    a, b, c = sentence(1, 40), sentence(2, 40), sentence(3, 40)
    rows = [(1, a), (2, b), (7, a), (7, b), (5, c), (6, c), (9, c + " x"), (9, sentence(4, 40)), (8, sentence(5, 40)), (8, sentence(6, 40)), (8, None)]
    alone = brute_links(list(enumerate(t for _, t in rows)))  # links between texts; then texts of one id are joined
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, _) in enumerate(rows):
        x, y = find(d), find(rows[alone[i][1]][0])
        root[max(x, y)] = min(x, y)
    want = sorted((d, alone[i][0], find(d)) for i, (d, _) in enumerate(rows) if rows[i][1])
    got = shingle_join.near_documents(documents(spark, [(d, t, None, None) for d, t in rows])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.n_shingles) == want and len(got) == len(rows)
    assert {r[2] for r in want if r[0] in (1, 2, 7)} == {1} and {r[2] for r in want if r[0] in (5, 6, 9)} == {5}


def test_shingle_join_edge_cases(spark, docs):
    got = {r.doc_id: r for r in shingle_join.near_documents(docs).collect()}
    assert got[None].component_id is None and got[20].n_shingles == got[21].n_shingles == got[22].n_shingles == 0
    assert got[20].component_id == 20 and got[27].component_id == got[26].component_id == 25
    assert shingle_join.near_documents(docs.limit(0)).collect() == []


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    heavy = (np.sort(rng.integers(0, 1 << 63, 20, dtype=np.uint64)), np.arange(20, dtype=np.uint64))
    for _ in range(200):
        n = int(rng.integers(1, 80))
        common = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), heavy[0][: rng.integers(0, 20)]]))
        k = len(common)
        extra = lambda: rng.integers(0, 1 << 63, int(rng.integers(0, k // 3 + 1)), dtype=np.uint64)
        a, b = np.unique(np.concatenate([common, extra()])), np.unique(np.concatenate([common, extra()]))
        linked = 100 * k >= 75 * len(np.union1d(a, b))
        if linked:
            assert len(np.intersect1d(shingle_join.prefix(a, heavy), shingle_join.prefix(b, heavy)))
            assert shingle_join.may_link(shingle_join.bitmap(a).tobytes(), shingle_join.bitmap(b).tobytes(), len(a), len(b))


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100)] + [(200, x) for x in range(201, 240)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    for at_once in (comp.AT_ONCE, 0):  # in one task, and by star rounds alone
        got = {r.node: r.component for r in comp.components(spark.createDataFrame(edges, "u long, v long").repartition(5), Stash(spark, "t"), at_once).collect()}
        assert got == {x: find(x) for x in root if x not in loops}
    assert comp.components(spark.createDataFrame([], "u long, v long"), Stash(spark, "t")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, dim int, rep long, number long, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, -1, -1, -1, 0.0) for r in rows], VECTORS)


@pytest.fixture(scope="session")
def embeddings(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).astype("float32").tolist(), i % 3 if i % 7 else None) for i in range(330)]
    base = rng.standard_normal(8)
    rows += [(1000 + i, (base + 0.05 * rng.standard_normal(8)).astype("float32").tolist(), 1) for i in range(60)]
    rows += [(2000 + i, base.astype("float32").tolist(), 1) for i in range(10)] + [(2100, base.astype("float32").tolist(), 2)]
    rows += [(3000, None, 1), (3100, [1.0, None] + [0.0] * 6, 1), (3200, [float("nan")] * 8, 1), (3300, [float("inf")] * 8, 1), (3400, [0.0] * 8, 1), (3500, [1.0, 2.0], 1), (3501, [1.0, 2.0], 1), (3600, [], 1), (None, base.astype("float32").tolist(), 1)]
    return rows


def whole(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_topk_equals_brute_force(spark, embeddings, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rows = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v, _ in embeddings if i is not None and whole(v)]
    want = []
    for q, x in rows:
        if q % 100 == 0:
            scores = sorted((-int(x @ y), i) for i, y in rows if i != q and len(y) == len(x))[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert sorted(plain(topk.top_k(vectors(spark, embeddings)))) == sorted(want)
    assert plain(topk.top_k(vectors(spark, embeddings).limit(0))) == []


def test_topk_large_components_and_ties(spark):
    rows = [(i, [1.0, 1.0] if i % 2 else [2e9, 1e6], 0) for i in range(0, 25)] + [(100, [3.0e9, 1.0], 0)]
    got = sorted(plain(topk.top_k(vectors(spark, rows))))
    first = [g for g in got if g[0] == 0]
    assert [g[2] for g in first] == list(range(2, 21, 2)) and {g[3] for g in first} == {(1 << 63) - 1}  # all are held at a long's end, so ids decide


def test_near_vectors_equal_brute_force(spark, embeddings):
    rows = [(i, np.array(v, float), c) for i, v, c in embeddings if i is not None and whole(v) and len(v) and any(v) and c is not None]
    links, root = Counter(), {i: i for i, _, _ in embeddings if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x, c), (b, y, d) in itertools.combinations(rows, 2):
        if c == d and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = near_vectors.near_vectors(vectors(spark, embeddings)).collect()
    assert len(got) == len(embeddings)  # recall is 1 here: every link of brute force is found
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == {i: (links[i], find(i), find(i) == i) for i in root}
    assert near_vectors.near_vectors(vectors(spark, embeddings).limit(0)).collect() == []


def test_near_vectors_recall_and_visits(spark, monkeypatch):
    """Links at or just above the threshold, in many cells: recall of at least 0.99, no false link, and a small part of the grid visited."""
    monkeypatch.setattr(near_vectors, "CELL", 4)
    rng = np.random.default_rng(9)
    base = near_vectors.unit_rows(rng.standard_normal((700, 32)))
    step = rng.standard_normal(base.shape)
    step = near_vectors.unit_rows(step - (step * base).sum(1, keepdims=True) * base)
    cos = rng.uniform(0.98, 0.985, (len(base), 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.vstack([base, cos * base + np.sqrt(1 - cos**2) * step]))]
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = near_vectors.unit_rows(np.array([r[1] for r in rows]))
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))
    books = tuple(near_vectors.fit_codebook(h, 18) for h in near_vectors._halves(x))
    limit = near_vectors.visit_limit(x, books, 0.98)
    (_, low_a), (_, low_b) = (near_vectors.cell_bounds(h, b) for h, b in zip(near_vectors._halves(x), books, strict=True))
    assert np.mean([len(list(near_vectors.multi_sequence(a, b, limit))) for a, b in zip(low_a, low_b, strict=True)]) < 0.25 * 18 * 18


def test_near_vectors_of_recall_one_finds_every_link(spark, monkeypatch):
    """Vectors moved along few axes and towards other vectors, not at random: with a recall of 1 links and components equal brute force."""
    monkeypatch.setattr(near_vectors, "CELL", 4)
    rng = np.random.default_rng(12)
    base = near_vectors.unit_rows(rng.standard_normal((250, 16)))
    along = base.copy()
    along[np.arange(250), rng.integers(0, 16, 250)] += rng.uniform(0.15, 0.25, 250)
    towards = base + rng.uniform(0.1, 0.2, (250, 1)) * base[rng.permutation(250)]
    x = near_vectors.unit_rows(np.vstack([base, along, towards]))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=1.0).collect()}
    near = x @ x.T >= 0.98
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(near, root[None, :], len(x)).min(1)
        if (new == root).all():
            break
        root = new
    assert near.sum() > len(x) + 200 and got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(x))}


def test_near_vectors_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0)]
    got = sorted(plain(near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_multi_sequence_is_in_order():
    a, b = np.array([0.3, 0.0, 0.7]), np.array([0.2, 0.1, 0.9, 0.4])
    got = list(near_vectors.multi_sequence(a, b, 0.9))
    want = sorted(((a[i] + b[j], i, j) for i in range(3) for j in range(4) if a[i] + b[j] <= 0.9))
    assert [round(a[i] + b[j], 9) for i, j in got] == [round(w[0], 9) for w in want] and set(got) == {w[1:] for w in want}


PAGE = """<html class="no-js"><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header><h2>Site name</h2></header>
<nav><ul><li>Home</li><li>About</li></ul></nav><div class="cookie-notice">We use cookies.</div><aside>Side</aside>
<article><h1>Title &amp; more</h1><p>First  paragraph
 with <b>bold</b> and <a href="x">a link</a> in it, and more words to read.<p>Second&nbsp;paragraph: x &lt; y.<br>After break.<div class="ad">Buy now</div><ul><li>item one</li><li>item two</li></ul>
<form><input value="q"><button>Go</button></form><p>Last.</p></article><section id="comments"><p>Nice post, thank you very much for all of it!</p></section><footer>&copy; me</footer></body></html>"""


def test_html_text():
    assert html_text.main_text(PAGE) == "Title & more First paragraph with bold and a link in it, and more words to read. Second paragraph: x < y. After break. item one item two Last."


def test_html_without_article():
    page = "<body><div class=menu><a href=a>A</a><a href=b>B</a></div><div><p>" + "Long text of the page. " * 8 + "</p><p>Short.</p><p>" + "More text of it. " * 9 + "</p></div><div id=footer>End</div>"
    text = html_text.main_text(page)
    assert text.startswith("Long text") and text.endswith("More text of it.") and "Short." in text and "End" not in text


def test_html_threshold_decides():
    texts = [html_text.main_text(PAGE, threshold=t) for t in (0, 0.25, 1.2, 2, 9)]
    assert texts[1].startswith("Title") and len({len(t) for t in texts}) >= 3
    assert all(len(a) >= len(b) for a, b in itertools.pairwise(texts)) and texts[-1]  # the densest region always stays


def test_html_doubtful_names_are_weighed():
    long = "with many words in it, so that its text is dense and it reads like a part of the article."
    page = f"<body><header><h2>Site</h2></header><article><header class=entry-header><h1>Title</h1></header><p>First {long}</p><div class='share-price'><p>Prices {long}</p></div><section class=related><p>Related {long}</p></section><div class=share><a href=x>Share</a></div><div class=cookie-notice>Cookies {long}</div><div id=comments><p>Comment {long}</p></div></article><div class=share><a href=x>Share</a></div></body>"
    assert html_text.main_text(page) == f"Title First {long} Prices {long} Related {long}"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</x>" * 20_000, "<!--" * 20_000, "<b><div>" * 20_000 + "</b>" * 20_000, "<![CDATA[" * 20_000, "</ " * 30_000, "<article>" * 20_000 + "</div>" * 20_000, "<script>" * 20_000, "<a b='" * 20_000, "<" * 80_000])
def test_html_hostile_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 2


def test_html_odd_markup():
    text = html_text.main_text
    assert text("<p>a <!-- <p>gone</p> --> b</p><script>'<!--'</script><p>c</p>") == "a b c"
    assert text("<p>x</p><?php echo ?><!DOCTYPE x><p>y</p></ >") == "x y" and text("<p>2 &lt; 3 &amp; 4 < 5</p>") == "2 < 3 & 4 < 5"
    assert text("<p>kept</p><a href='never closed") == "kept" and text("plain") == "plain" and text("") == ""


def test_html_against_the_rows_template(spark):
    """The article of every page, read by its own markup: its elements' text is all that the extraction gives."""
    import html as entities

    pages = queries.table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r.text for r in queries.op2(spark, "/root/testdata/sf0.01").collect()}
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"<(?!/?(?:b|i|a|em|strong|span)[ >])[^>]*>", article)
        plain = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert got[r.page_id] == " ".join(x for x in plain if x)


def test_html_table(spark):
    rows = [(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (4, "u", "plain text only", 0), (5, "u", "<p>" * 3000 + "deep", 0), (6, "u", "<b>open <i>never closed <p>x</b> y", 0), (6, "u", "<!-- c --><script>x", 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    text = {(r.page_id, r.text) for r in got}
    assert {(2, ""), (3, ""), (4, "plain text only"), (5, "deep"), (6, "")} <= text
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def junk(i):
    return sentence(i, 60).upper().replace(" ", "!! ") if i % 2 else " | ".join(sentence(i, 60).split())


def test_quality(spark):
    rows = [(i, sentence(i, 80) if i % 3 else junk(i), "en", "s") for i in range(300)] + [(400, None, None, None), (401, "", None, None), (402, "x" * 200_000, None, None)]
    d = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0, 1) for i in range(300)] + [(999, 1, 0, 1), (1, None, 0, 1), (None, 1, 0, 1)], "doc_id long, quality int, toxic int, score int")
    model = quality.train(d, labels)
    got = quality.score(d.select("doc_id", "text", "score"), model).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.95
    used = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5}
    assert len(model.labels) == len(used)
    none = quality.train(d, labels.limit(0))
    assert {r.score for r in quality.score(d, none).collect()} == {0.5}
    assert quality.score(d.limit(0), model).collect() == []
    assert len(quality.train(d, labels, max_labelled=50).labels) == 50


def test_quality_votes_equal_brute_force(spark):
    """Every score from its definition: the nearest labelled vectors by exact cosine, ties to the first, weighted by a power of the cosine."""
    texts = [sentence(i, 40 + i) if i % 3 else junk(i) for i in range(90)] + [sentence(1, 41)] * 3 + ["", "x"]
    counts = quality.features(texts)
    model = quality.fit(counts, np.array([i % 2 for i in range(len(texts))], float))
    z = quality._unit(quality.weighted(counts, model.idf) @ model.basis)
    for text, row, got in zip(texts, z, model.score(texts), strict=True):
        sims = [float(np.float32(row @ v)) for v in model.vectors]
        near = sorted(range(len(sims)), key=lambda j: (-round(sims[j], 5), j))[: model.neighbours]
        weight = [max(sims[j], 0) ** model.sharpness for j in near]
        edge = sorted(sims)[-model.neighbours]
        if sum(abs(s - edge) < 1e-5 for s in sims) == 1:  # no near-tie at the last place
            assert got == pytest.approx(sum(w * model.labels[j] for w, j in zip(weight, near, strict=True)) / sum(weight), abs=1e-3), text
    sims = np.array([[0.5, 0.9, 0.5, 0.5, 0.1, 0.5] + [0.0] * 30], np.float32)
    assert quality.votes(sims, np.array([0, 1, 1, 0, 1, 1] + [0] * 30, float), 3, 1, 0.5)[0] == pytest.approx((0.9 + 0.5) / 1.9)


def test_quality_settings_come_from_training_rows_only(spark):
    rows = [(i, sentence(i, 50) if i % 3 else junk(i), "en", "s") for i in range(200)]
    labels = [(i, int(i % 3 != 0)) for i in range(200)]
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (quality.train(documents(spark, rows), spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert (a.neighbours, a.sharpness) == (b.neighbours, b.sharpness) and (a.vectors == b.vectors).all() and (a.labels == b.labels).all()


SYLLABLES = {"aa": "ka ri to mu ne".split(), "bb": "sch ung lich ter ein".split(), "рр": "при ста ово ние лка".split()}


def speech(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 5))) for _ in range(n))


def test_language(spark):
    langs = list(SYLLABLES)
    rows = [(i, speech(langs[i % 3], i, 40), langs[i % 3], "s") for i in range(240)]
    rows += [(500, None, "aa", None), (501, "", "aa", None), (502, "12 34 !? ...", "aa", None), (503, speech("aa", 1, 90) + " " + speech("bb", 2, 30), None, None), (504, "a" * 300_000, None, None), (505, "日本", None, None)]
    d = documents(spark, rows)
    model = language.train(d)
    assert model.languages == sorted(langs)
    got = {r.doc_id: r for r in language.detect(d.select("doc_id", "text", "score"), model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == langs[i % 3] for i in held]) > 0.98
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502)) and got[505].lang_pred in langs and got[505].score == 0
    assert [(s.lang, s.words) for s in got[503].spans] == [("aa", 90), ("bb", 30)] and got[503].lang_pred == "aa"
    with pytest.raises(ValueError):
        language.train(d, most=2)
    none = language.train(d.filter("lang is null"))
    assert {r.lang_pred for r in language.detect(d, none).collect()} == {"und"}
    assert language.detect(d.limit(0), model).collect() == []


def test_viterbi_equals_plain_recursion(spark):
    model = language.train(documents(spark, [(i, speech(x, i, 40), x, "s") for i in range(60) for x in [list(SYLLABLES)[i % 3]]]))
    texts = [speech("aa", 7, 9) + " " + speech("bb", 8, 5) + " 12 " + speech("aa", 9, 6), "", "x"]
    for text, (path, *_) in zip(texts, model.paths(texts), strict=True):
        e = np.array([model.scores[model.rows[w]] for w in text.split()]).reshape(-1, 3)
        score = lambda p: sum(e[t, s] for t, s in enumerate(p)) - language.SWITCH * sum(a != b for a, b in itertools.pairwise(p))
        best, arg = np.zeros(3), []
        for row in e:
            step = best[None, :] - language.SWITCH * (1 - np.eye(3))
            arg.append(step.argmax(1))
            best = step.max(1) + row
        assert not len(path) or score(path) == pytest.approx(best.max())


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["mit-text"]
    words = mit.split()
    changed = " ".join(words[:40] + ["something", "else"] + words[42:])
    rows = [(1, sentence(1, 50) + " Licensed under the Apache License, Version 2.0. " + sentence(2, 30)), (2, "RELEASED under the\nMIT license!"), (3, sentence(3, 200) + " " + mit + " " + sentence(4, 30)), (4, sentence(5, 11) + changed), (5, None), (6, ""), (7, sentence(8, 500)), (8, " ".join(words[:20])), (2, "RELEASED under the\nMIT license!")]
    d = documents(spark, [(a, b, None, None) for a, b in rows])
    got = {(r.doc_id, r.license): r for r in license_scan.scan(d).collect()}
    assert set(got) == {(1, "apache-2.0"), (2, "mit"), (3, "mit-text"), (4, "mit-text")}
    assert got[3, "mit-text"].containment == 1 and 0.75 <= got[4, "mit-text"].containment < 1 and got[1, "apache-2.0"].first_word == 50
    assert license_scan.scan(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        license_scan.scan(d, {"short": "two words"})


def test_license_scan_recall_of_edited_notices(spark):
    """Long notices with words exchanged all over: all whose exact containment reaches the limit are retrieved."""
    rng = np.random.default_rng(6)
    rows, want = [(None, license_scan.TEMPLATES["apache-2.0-header"], None, None)], {(None, "apache-2.0-header"), (None, "apache-2.0")}
    words_of = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    for k in range(240):
        name = ("mit-text", "apache-2.0-header", "bsd-2-clause", "gpl-3.0-header")[k % 4]
        words = words_of(license_scan.TEMPLATES[name])
        for at in rng.integers(0, len(words), rng.integers(0, 6)):
            words[at] = f"edit{at}"
        text = words_of(sentence(k, 30)) + words + words_of(sentence(k + 1, 30))
        have = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        for other, body in license_scan.TEMPLATES.items():
            w = words_of(body)
            need = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            if len(need & have) >= 0.75 * len(need):
                want.add((k, other))
        rows.append((k, " ".join(text), None, None))
    got = {(r.doc_id, r.license) for r in license_scan.scan(documents(spark, rows)).collect()}
    assert len(want) > 150 and got == want


def test_near_contents_at_production_settings(spark):
    sf = "/root/testdata/sf0.001"
    pytest.importorskip("pyarrow")
    d = queries.table(spark, sf, "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8(spark, sf).collect()}
    assert got == brute_links([(r.doc_id, r.text) for r in d.collect()])

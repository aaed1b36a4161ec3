"""Near duplicates, embedding links and long repeats against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.llm import embeddings, minhash, repeats, suffixes
from veritally.llm.components import components


def reach(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = top(a), top(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_brute(texts, similar):
    sets = {d: shingles(t) for d, t in texts if d is not None}
    where = defaultdict(list)
    for d, x in sets.items():
        for g in x:
            where[g].append(d)
    links = []
    for d, x in sets.items():
        for e, n in Counter(e for g in x for e in where[g] if e < d).items():
            if 100 * n >= similar * (len(x) + len(sets[e]) - n):
                links.append((d, e))
    return sets, reach(links, sets)


def test_components_of_a_long_path_and_loops(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 100), (7, 3), (200, 201), (201, 200), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {**{k: 0 for k in range(41)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("which,similar,tile", [("small", 85, 1024), ("small", 80, 2), ("edge", 85, 1024), ("nothing", 85, 8)])
def test_near_duplicates(request, texts_of, which, similar, tile):
    docs = request.getfixturevalue(which)
    rows = minhash.near_duplicates(docs, settings=minhash.Settings(similar=similar, tile=tile)).collect()
    sets, component = near_brute(texts_of(docs), similar)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), component[r.doc_id], component[r.doc_id] == r.doc_id)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for d in range(300):
        own = list(words)
        for k in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            own[k] = f"x{rng.integers(1_000_000)}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, settings=minhash.Settings(similar=85, tile=64)).collect()}
    assert got == near_brute(rows, 85)[1]


def test_odd_sketches_estimate_the_similarity():
    rng = np.random.default_rng(2)
    s = minhash.Settings()
    for share in (0.7, 0.85, 0.95):
        both = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
        n = int(2000 * (1 - share) / (1 + share))
        a = np.concatenate([both, rng.integers(0, 1 << 63, n).astype(np.uint64)])
        b = np.concatenate([both, rng.integers(0, 1 << 63, n).astype(np.uint64)])
        x = minhash.odd_sketch(minhash.signature([a, b], s), s).view(np.uint64)
        bits = 64 * s.sketch_longs
        differ = -bits / 2 * math.log(1 - 2 * int(np.bitwise_count(x[0] ^ x[1]).sum()) / bits)
        assert abs(1 - differ / (2 * s.samples) - 2000 / (2000 + 2 * n)) < 0.12


def test_keep_one_passes_columns_through(edge, texts_of):
    kept = minhash.keep_one(edge)
    assert kept.schema == edge.schema
    ids = [r.doc_id for r in kept.collect()]
    _, component = near_brute(texts_of(edge), 80)
    assert sorted(i for i in ids if i is not None) == sorted({d for d, c in component.items() if d == c})
    assert ids.count(None) == 2


def covered_brute(texts, length):
    """Per row: id, bytes, and which of them (with one more, kept) a repeated string covers."""
    seen = Counter()
    for _, t in texts:
        x = (t or "").encode()
        seen.update(x[i : i + length] for i in range(len(x) - length + 1))
    for d, t in texts:
        x = (t or "").encode()
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        yield d, x, gone


def texts_left(texts, length):
    """Rows (id, text) without the characters of which all bytes are covered."""
    out = []
    for (_, t), (d, x, gone) in zip(texts, covered_brute(texts, length)):
        ends = np.cumsum([len(c.encode()) for c in t or ""])
        left = "".join(c for c, e in zip(t or "", ends.tolist()) if not gone[e - len(c.encode()) : e].all())
        out.append((d, None if t is None else left))
    return out


def removed_brute(texts, length):
    out = []
    for d, x, gone in covered_brute(texts, length):
        kept = bytes(b for b, g in zip(x, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(x) else 0
        out.append((d, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(docs, s):
    rows = repeats.report(docs, settings=s).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


@pytest.mark.parametrize(
    "which,s",
    [
        ("small", repeats.Settings()),
        ("small", repeats.Settings(length=60, gram=8, hot_bytes=400, shard_bytes=3000)),
        ("nothing", repeats.Settings()),
    ],
)
def test_long_repeats(request, texts_of, which, s):
    docs = request.getfixturevalue(which)
    assert removed(docs, s) == removed_brute(texts_of(docs), s.length)


def test_long_repeats_of_odd_texts(edge, texts_of):
    docs = edge.filter(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    s = repeats.Settings(length=100, gram=16, hot_bytes=500)
    assert removed(docs, s) == removed_brute(texts_of(docs), 100)
    one = removed(edge.filter("doc_id = 14"), repeats.Settings())  # one byte over and over
    assert one[0][1:4] == (300_000, 300_000, 1)


def test_segments_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    s = repeats.Settings(length=50, gram=8)
    whole = {k for _, _, _, a, b in repeats.cells_of(data, np.array([0, 5000]), s) for k in range(a, b + 1)}
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = [(a, b) for _, _, _, a, b in repeats.cells_of(data, np.array([0, 5000]), s)]
    assert whole == set(range(4951)) and sorted(k for a, b in parts for k in range(a, b + 1)) == list(range(4951))


def test_removing_keeps_characters_whole(edge):
    rows = {r.doc_id: r for r in repeats.remove(edge, settings=repeats.Settings(length=99, gram=16)).collect()}
    assert repeats.remove(edge).schema == edge.schema
    assert rows[0].text is None and rows[19].text == "" and rows[20].text == "!"


def test_suffix_arrays_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        parts = [rng.integers(2, 2 + rng.integers(1, 5), rng.integers(0, 20)) for _ in range(rng.integers(1, 5))]
        t = np.concatenate([x for p in parts for x in (p, [1])] + [[0]]).astype(np.int64)
        room = np.concatenate([x for p in parts for x in (np.arange(len(p), 0, -1), [0])] + [[0]]).astype(np.int64)
        sa = suffixes.suffix_array(t)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == want
        before, shared = suffixes.permuted_prefixes(t, sa, room)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < min(room[a], room[b]) and t[a + n] == t[b + n]:
                n += 1
            assert (before[b], shared[b]) == (a, n)


def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((20, 16))
    rows = []
    for k in range(260):
        x = base[k % 20] + rng.standard_normal(16) * (0.02 if k % 20 < 10 else 0.22)
        rows.append((k, x.astype(np.float32).tolist(), 0))
    rows += [(300, rows[0][1], 1), (300, rows[0][1], 1), (301, rows[1][1], 1), (302, None, 0), (303, [], 0), (304, [0.0] * 16, 0), (305, [float("nan")] * 16, 0)]
    rows += [(306, [1.0, None], 0), (307, [float("inf")] * 16, 0), (308, rows[0][1][:8], 0), (None, rows[0][1], 0), (309, [2 * x for x in rows[0][1]], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("tile", [1024, 7])
def test_embedding_links(spark, tile):
    rows, table = vectors(spark)
    good = {d: np.array(v, float) for d, v, _ in rows if d is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = []
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links.append((a, b))
    count = Counter(d for pair in links for d in pair)
    component = reach(links, [d for d, _, _ in rows if d is not None])
    got = embeddings.link_vectors(table, settings=embeddings.Settings(tile=tile)).collect()
    assert len(got) == len(rows)
    wrong = 0
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert r.n_links <= count[r.vec_id] and r.kept == (r.vec_id == r.component_id)
            wrong += (r.n_links, r.component_id) != (count[r.vec_id], component[r.vec_id])
    assert wrong <= 3 and embeddings.link_vectors(table.limit(0)).count() == 0


def test_chance_to_meet():
    s = embeddings.Settings()
    projections, tables = embeddings.shape(50_000, s)
    near = embeddings.meet(math.sqrt(0.1), s.step) ** projections
    assert 1 - (1 - near) ** tables >= s.recall and embeddings.meet(s.far, s.step) ** projections * 50_000 < 0.1

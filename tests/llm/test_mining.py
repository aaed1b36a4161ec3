"""Phrases, hard negatives and shards against brute force, on ordinary, odd and skewed tables."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritally.llm import negatives, phrases, sharding


def gram_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, words[i : i + k]] += 1
    return counts, total


def phrases_brute(rows, least, top):
    counts, total = gram_counts(rows)
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in often.items():
        inside = [f for (other, longer), f in often.items() if other == lang and len(longer) > len(words) and words in (longer[:2], longer[1:])]
        if any(100 * f >= 50 * a for f in inside):
            continue
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks, ranked = Counter(), []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= top:
            ranked.append((row[0], ranks[row[0]], *row[1:]))
    return ranked


@pytest.mark.parametrize("which", ["edge", "small", "nothing"])
@pytest.mark.parametrize(
    "settings",
    [phrases.Settings(least=3, top=50), phrases.Settings(least=2, top=70, code_bits=9, hot_words=64, salts=3, shard_words=500, batch_edges=200)],
    ids=["plain", "shared codes, hot words, many shards"],
)
def test_phrases(request, which, settings):
    docs = request.getfixturevalue(which)
    if which == "edge":  # the longest texts have too many grams for the brute force
        docs = docs.filter("text is null or length(text) < 20000")
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(docs, settings=settings).collect()]
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    want = phrases_brute(rows, settings.least, settings.top)
    assert sorted(got) == sorted(want)


def test_phrases_of_a_very_long_text(edge):
    counts, _ = gram_counts([(r.lang, r.text) for r in edge.select("lang", "text").collect()])
    g = phrases.build(edge, settings=phrases.Settings(least=2, shard_words=5000))
    known = {r.code: (r.lang, r.word) for r in g.words.collect()}
    assert {known[r.code]: r.f for r in g.words.collect()} == {(lang, w[0]): n for (lang, w), n in counts.items() if len(w) == 1 and n >= 2}
    nodes = {(known[r.c1][0], (known[r.c1][1], known[r.c2][1])): r.flow for r in g.nodes.collect()}
    assert nodes == {k: n for k, n in counts.items() if len(k[1]) == 2 and n >= 2}


def test_paths_hold_every_edge_once(spark):
    texts = ["a b c d e f g", "x b c d e f y", "a b c d e f g", "q q q q q", "one two three", "one two three", "u v"]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    g = phrases.build(docs, settings=phrases.Settings(least=1, shard_words=7))
    word = {r.code: r.word for r in g.words.collect()}
    found = [(tuple(word[c] for c in r.codes), r.n) for r in phrases.paths(g).collect()]
    counts, _ = gram_counts([("en", t) for t in texts])
    edges = Counter()
    for words, n in found:
        for i in range(len(words) - 2):
            edges[words[i : i + 3]] += n
    assert edges == {w: n for (_, w), n in counts.items() if len(w) == 3}
    assert (("b", "c", "d", "e", "f"), 3) in found and (("one", "two", "three"), 2) in found


def test_phrases_of_one_common_pair(spark):
    rows = [("en", "hot pair w%d and hot pair w%d" % (k % 40, k % 7)) for k in range(400)] + [("de", "hot pair")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, settings=phrases.Settings(hot_words=16, salts=4, shard_words=100)).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == sorted(phrases_brute(rows, 10, 2000))


# --- hard negatives ---------------------------------------------------------------------


def negatives_brute(rows, every, s):
    points = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            points[i] = label, [math.floor(s.scale * x) for x in v]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for a, (label, v) in points.items():
        if a % every:
            continue
        others = [(i, own, dot(v, w)) for i, (own, w) in points.items() if i != a and len(w) == len(v)]
        first = sorted((-x, i) for i, own, x in others if own == label)[: s.positives]
        for score, p in first:
            hit = sorted((-x, i) for i, own, x in others if own != label and s.low * -score <= 100 * x <= s.high * -score)
            out += [(a, p, k + 1, i, -score, -x) for k, (x, i) in enumerate(hit[: s.negatives])]
    return sorted(out)


def vectors(kind: str) -> list[tuple]:
    rng = np.random.default_rng(11)
    if kind == "spread":  # lengths over three orders
        base = rng.standard_normal((400, 6)) * 10 ** rng.uniform(-2, 1, (400, 1))
    elif kind == "near":
        base = rng.standard_normal((5, 16))[rng.integers(0, 5, 400)] + 0.3 * rng.standard_normal((400, 16))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
    elif kind == "hot":
        base = rng.standard_normal((400, 8))
        base[::3] = base[0]
        base[7] = 0
    else:  # beyond exact doubles
        base = rng.standard_normal((60, 3)) * 1e6
    return [(k, v.tolist(), int(k * 7 % 5 if k % 3 else 0)) for k, v in enumerate(base)]


@pytest.mark.parametrize("kind", ["spread", "near", "hot", "large"])
@pytest.mark.parametrize("s", [negatives.Settings(), negatives.Settings(bucket_rows=20, anchor_rows=3, focus=2, positives=3, negatives=4)], ids=["plain", "many buckets"])
def test_negatives(spark, kind, s):
    rows = vectors(kind)
    rows += [(1000, None, 1), (1010, [], 1), (1020, [1.0, None], 1), (1030, [math.nan] * 6, 2), (1040, [1.0, 2.0], 1), (1050, [2.0, 1.0], 2), (1060, [1.0, 1.0], 1), (1070, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows.append(rows[20])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.withColumns({"id": F.lit("other"), "vector": F.lit(1), "score": F.lit(None)})
    got = negatives.mine(df, F.col("id") % 10 == 0, settings=s).collect()
    want = negatives_brute(rows, 10, s)
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df, F.col("id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(alone, F.col("id") % 10 == 0).count() == 0


def test_feasible_ranges_lose_nothing():
    rng = np.random.default_rng(2)
    rows = rng.integers(-200, 200, (3000, 5))
    bucket = negatives.Bucket(rows, 3)
    pruned = 0
    for anchor, bound in product(rng.integers(-200, 200, (20, 5)), (1, 20_000, 60_000, 10**9)):
        found = bucket.feasible(anchor, bound)
        assert set(np.flatnonzero(rows @ anchor >= bound)) <= set(found.tolist())
        pruned += len(found) < len(rows) / 2
    assert pruned > 30


# --- shards -------------------------------------------------------------------------------


def shards_hold(rows, found, shards, spread):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, homes, load = defaultdict(list), defaultdict(set), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())
    groups = Counter()
    for r in found:
        groups[r.text_crc32, r.size] += r.size
    even = sum(load.values()) / shards
    big = [n for n in groups.values() if n > even]
    rest = (sum(load.values()) - sum(big)) / max(1, shards - len(big))
    light = sorted(load[k] for k in range(shards))[: shards - len(big)]
    assert max(light, default=0) - min(light, default=0) <= spread * rest + max((n for n in groups.values() if n <= even), default=0) * (spread == 0)


@pytest.mark.parametrize("s", [sharding.Settings(shards=4), sharding.Settings(shards=4, block_items=32, last_items=200, bundles_a_shard=8, finer=8, fine_every=4)], ids=["one level", "levels"])
@pytest.mark.parametrize("which", ["edge", "small", "nothing", "hot"])
def test_shards(request, spark, which, s):
    if which == "hot":
        rows = [(k, "copy " * 50 if k % 3 == 0 else f"text {k} " * (k % 13)) for k in range(3000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    else:
        docs = request.getfixturevalue(which)
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = sharding.shard(docs.withColumns({"shard": F.lit("x"), "item": F.lit(1), "size": F.lit(0)}), settings=s).collect()
    shards_hold(rows, found, s.shards, 0 if which == "edge" else 0.02)


def test_shards_do_not_depend_on_partitions(small):
    s = sharding.Settings(shards=3, block_items=16, last_items=60, bundles_a_shard=8)
    a, b = (sorted((r.doc_id, r.shard) for r in sharding.shard(small.repartition(n), settings=s).collect()) for n in (2, 7))
    assert a == b

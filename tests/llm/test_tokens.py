"""Encoding, decoding and packing against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from veritally.llm import bpe, packing
from veritally.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def expected(library, texts):
    out = []
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((doc, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["edge", "small", "nothing"])
def test_encode_and_decode_like_the_library(request, library, texts_of, which):
    docs = request.getfixturevalue(which)
    rows = bpe.encode(docs, vocabulary(), decode=True).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in rows), key=repr) == expected(library, texts_of(docs))


def test_decode_is_the_same_from_ids(edge, library, texts_of):
    encoded = bpe.encode(edge, vocabulary())
    got = sorted(((r.doc_id, r.decoded) for r in bpe.decode(encoded, vocabulary()).collect()), key=repr)
    assert got == sorted(((d, x) for d, _, x in expected(library, texts_of(edge))), key=repr)


def test_cuts_are_forced():
    own = bpe.Encoder(open(vocabulary(), encoding="utf-8").read())
    cut = own.fragment("qxzjvw" + chr(ord("k") + bpe.END))
    assert " " in cut and cut.replace(" ", "") == "qxzjvw" + chr(ord("k") + bpe.END)


def test_known_words_come_back(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 1000)
    own = bpe.Encoder(open(vocabulary(), encoding="utf-8").read())
    first = None
    for words in ([b"alpha", b"beta"], [b"gamma", b"delta", b"beta"], [b"alpha", b"beta"], [b"alpha"]):
        own.learn(set(words))
        ids = own.encode(words)
        first = first or ids
    own.learn({b"alpha", b"beta"})
    assert own.encode([b"alpha", b"beta"]) == first
    texts = [b"alpha beta", b"gamma, delta beta's 42", "Größe alpha beta".encode(), b"alpha beta"]
    for _ in range(3):
        assert [own.encoded([t])[0] for t in texts] == own.encoded(texts) and own.encoded(texts)[0][0] == first


ODD = ["it's 'S don't we'LL", "a\x1cb\x85c\xa0d \x00\x7f\x01e", "\u0132\u0149 ĿÀ e\u0301 E\u0301x İstanbul ŉ", "½²³ª º №5 ١٢", "<|endoftext|>tail", "ﬁne ſo Straße ΑΒΓ", "  ", "a<|b", "x" * 5000 + "é" * 300, "œuvre Ǆ ǆ ɐ"]


def test_odd_texts_like_the_library(spark, library):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    rows = bpe.encode(docs, vocabulary(), decode=True).collect()
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in rows), key=repr) == expected(library, enumerate(ODD))


@pytest.mark.parametrize("which", ["edge", "small"])
def test_pieces_hold_every_id_once(request, library, texts_of, which):
    docs = request.getfixturevalue(which)
    rows = packing.pack(docs, vocabulary()).collect()
    whole = defaultdict(list)
    for doc, text in texts_of(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        whole[doc].append(np.array(ids, "<u4").tobytes())
    # repeated rows and rows without id share an id: compare the pieces as a multiset
    found = sorted(((r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    want = []
    for doc, parts in whole.items():
        for raw in parts:
            n = len(raw) // 4
            starts = [(r.start, r.length) for r in rows if r.doc_id == doc and r.doc_tokens == n]
            spans = sorted(set(starts))
            assert [a for a, _ in spans] == [0, *np.cumsum([b for _, b in spans])[:-1].tolist()] and sum(b for _, b in spans) == n
            want += [(doc, n, a, b, zlib.crc32(raw[4 * a : 4 * (a + b)])) for a, b in spans]
    assert found == sorted(want, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([b for _, b in parts])[:-1].tolist()]
        assert sum(b for _, b in parts) <= 2048
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * tokens / 2048 + 1


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_differencing_balances_and_the_count_rises():
    sizes = np.random.default_rng(3).integers(1, 257, 900)
    window, k = packing.windows(sizes, 2048)
    sums = np.bincount(window, sizes, minlength=k)
    assert sums.max() <= 2048 and sums.max() - sums.min() < 32 and k <= -(-sizes.sum() // 2048) + 2
    window, k = packing.windows(np.array([5, 5, 5]), 8)
    assert k == 3 and sorted(window.tolist()) == [0, 1, 2]

"""Byte-pair encoding and decoding with forced boundaries.

The vocabulary file (tokenizers JSON, byte-level BPE with a word-end suffix) is
read once on the driver and broadcast: its size doesn't depend on the data.

A text is cut into the pieces of the vocabulary's word pattern, which no token
can reach across. Inside a piece, two neighbouring bytes that occur next to each
other in no vocabulary token can't be merged by any order of merges, so the
piece is cut there for certain: the fragments are encoded on their own and their
ids concatenated. A byte that ends a piece counts as another symbol than the
same byte inside, since the word-end suffix belongs to it. Pieces repeat, so
each worker keeps a bounded table of pieces it has encoded. Texts of Latin
letters are cut at once; others (and texts that hold special strings) are first
cut at ASCII white space, and each word by the library's splitter.

Defined results: a null or empty text has no ids and decodes to the empty
string. Rows are encoded alone, so repeated rows give the same ids and an empty
table an empty result. Only the id and text columns of the input are read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, compress
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.words import pieces, utf8, without_cycles

SUFFIX = "</w>"
END = 0x0400  # added to a symbol's code point when it ends a word; byte symbols lie below
CACHED_BYTES = 200_000_000  # of one generation of known words; there are two at most
WORD_COST = 400  # bytes that a known word, its pieces and fragments take in tables besides their own
PIECE_COST = 220
MOST_FRAGMENTS = 800_000
PRINTABLE = re.compile(rb"[!-~]+").fullmatch
# Fixed value: the word pattern of the vocabulary file, for lower-case ASCII. The byte alphabet shows printable ASCII as itself.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
# The same pattern for Latin letters with marks, whose classes no Unicode version changes.
LATIN = 0x250
LATIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+").findall


def byte_alphabet() -> dict[int, str]:
    """How the byte alphabet of the vocabulary shows each byte: printable ones as themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + k) for k, b in enumerate(rest)}


HIDDEN = byte_alphabet()
NONE = partial(is_, None)


def latin(kind: str) -> str:
    """Characters with marks below ``LATIN`` whose class begins with ``kind``, for a pattern's set."""
    return "".join(chr(c) for c in range(0x80, LATIN) if unicodedata.category(chr(c)).startswith(kind))


# The same pattern over whole texts, of ASCII and of Latin letters, normalised and lower-cased. What a piece begins with tells
# its kind, so the commonest kind is asked for first.
SHORT = "'(?:[stmd]|re|ve|ll)"
ASCII_TEXT = re.compile(rf"[a-z]+|[0-9]|{SHORT}|[^\x09-\x0d\x20a-z0-9]+").findall
LATIN_TEXT = re.compile(rf"[a-zA-Z{latin('L')}]+|[0-9{latin('N')}]|{SHORT}|[^\x09-\x0d\x20\x85\xa0a-zA-Z0-9{latin('L')}{latin('N')}]+").findall
BEYOND = re.compile("[^\\x00-\\u024f]").search


class Encoder:
    """Encodes words; built once per Python worker from the vocabulary file's text. Decoded words are kept on request."""

    def __init__(self, spec: str, decoding: bool = True):
        from tokenizers import Tokenizer, models

        self.decoding = decoding
        loaded = json.loads(spec)
        model = loaded["model"]
        full = Tokenizer.from_str(spec)
        self.normalizer, self.splitter = full.normalizer, full.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in loaded["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        vocab = {marked(token): i for token, i in model["vocab"].items()}
        merges = [tuple(marked(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.fragments = models.BPE(vocab, merges, cache_capacity=0)
        self.together = np.zeros((2 * END, 2 * END), bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                self.together[ord(a), ord(b)] = True
        top = max(*model["vocab"].values(), *self.special.values()) + 1
        self.strings = [b""] * top
        for token, i in (model["vocab"] | self.special).items():
            self.strings[i] = token.encode()
        self.fragment_ids: dict[str, bytes] = {"\n": b""}
        self.known: dict = {}
        self.old_known: dict = {}
        self.size = self.piece_size = 0
        self.piece_ids: dict[str, bytes] = {}
        self.piece_text: dict[str, bytes] = {}
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}

    def fragment(self, marked_words: str) -> str:
        """Cuts at every byte pair that no vocabulary token holds. Words end with a marked symbol; a line break stands between words."""
        codes = np.frombuffer(marked_words.encode("utf-16-le"), np.uint16)
        a, b = codes[:-1], codes[1:]
        cut = (a > 32) & (b > 32) & ~self.together[a, b]
        at = np.flatnonzero(cut) + 1
        return np.insert(codes, at, 32).tobytes().decode("utf-16-le") if len(at) else marked_words

    def cut(self, words: list[str]) -> list[list[str]]:
        """Pieces of words without white space, NUL or special strings, by the library's normaliser and its splitter's pattern."""
        if not words:
            return []
        out = []
        for word in self.normalizer.normalize_str(" \0 ".join(words)).split(" \0 "):
            if max(word, default="") < chr(LATIN):
                out.append([p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(HIDDEN) for p in LATIN_PIECES(word)])
            else:
                out.append([p for p, _ in self.splitter.pre_tokenize_str(word)])
        return out

    def cut_odd(self, word: str) -> list[str]:
        """Pieces of a word that may hold special strings, NUL or non-ASCII white space; special strings stay whole."""
        out = []
        for part in self.specials.split(word) if self.specials else [word]:
            if part in self.special:
                out.append(part)
            elif part:
                out += [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def learn_pieces(self, found: set[str]) -> None:
        new = list(found.difference(self.piece_ids))
        tokens, known = self.fragments.tokenize, self.fragment_ids
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            cut = self.fragment(" \n ".join([p[:-1] + chr(ord(p[-1]) + END) for p in part]))
            for f in set(cut.split(" ")).difference(known):
                ids = array("I", [t.id for t in tokens(f)])
                if sys.byteorder == "big":
                    ids.byteswap()
                known[f] = ids.tobytes()
            get, join = known.__getitem__, b"".join
            self.piece_ids.update(zip(part, [join(map(get, f.split(" "))) if " " in f else get(f) for f in cut.split(" \n ")]))
            if self.decoding:
                self.piece_text.update((p, self.decode(np.frombuffer(self.piece_ids[p], "<u4").tolist())) for p in part)

    def learn(self, words: set[bytes]) -> None:
        """Adds words to the tables. A full table becomes the older one, from which words in use come back."""
        if self.size > CACHED_BYTES:
            self.older = self.ids, self.decoded
            self.ids, self.decoded, self.piece_ids, self.piece_text = {}, {}, {}, {}
            self.fragment_ids, self.size = {"\n": b""}, 0
        ids, decoded = self.ids, self.decoded
        missing = words.difference(ids)
        self.size += (WORD_COST * len(missing) + 3 * sum(map(len, missing))) << self.decoding
        known, shown = self.older
        back = missing.intersection(known)
        for w in back:
            ids[w] = known[w]
        if self.decoding:
            for w in back:
                decoded[w] = shown[w]
        missing -= back
        for t, i in self.special.items():
            self.piece_ids[t], self.piece_text[t] = np.array([i], "<u4").tobytes(), t.encode()
        plain = [w for w in missing if PRINTABLE(w)]
        if b"<|" in b" ".join(plain):
            plain = [w for w in plain if b"<|" not in w]
        cut = [ASCII_PIECES(w.lower().decode()) for w in plain]
        other = [w for w in missing.difference(plain)]
        odd = [w for w in other if b"<|" in w or b"\0" in w or not is_plain(w.decode())]
        even = list(set(other).difference(odd))
        cut += [self.cut_odd(w.decode()) for w in odd]
        cut += self.cut([w.decode() for w in even])
        self.learn_pieces(set(chain.from_iterable(cut)))
        found = plain + odd + even
        get, join = self.piece_ids.__getitem__, b"".join
        for w, ps in zip(found, cut):
            ids[w] = get(ps[0]) if len(ps) == 1 else join(map(get, ps))
        if self.decoding:
            get, join = self.piece_text.__getitem__, b" ".join
            for w, ps in zip(found, cut):
                decoded[w] = get(ps[0]) if len(ps) == 1 else join(map(get, ps))

    def decode(self, ids) -> bytes:
        strings = self.strings
        return b" ".join([strings[i] for i in ids])

    def encode(self, words: list[bytes]) -> bytes:
        """Ids of a text cut at white space, as little-endian 32-bit integers; its words were learned."""
        return b"".join(map(self.ids.__getitem__, words))

    def pieces_of(self, text: str) -> list[str] | None:
        """Pieces of a whole text, or None if it must be cut word by word."""
        if any(t in text for t in self.special):
            return None
        if text.isascii():
            return ASCII_TEXT(text.lower())
        text = unicodedata.normalize("NFC", text).lower()
        return None if BEYOND(text) else LATIN_TEXT(text)

    def know(self, pieces: set[str]) -> None:
        """Adds pieces to the table of pieces as they stand in texts; a full table becomes the older one."""
        if self.piece_size > CACHED_BYTES:
            self.old_known, self.known, self.piece_size = self.known, {}, 0
        for p in pieces.intersection(self.old_known):
            self.known[p] = self.old_known[p]
        new = list(pieces.difference(self.known))
        shown = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(HIDDEN) for p in new]
        self.piece_size += (PIECE_COST * len(new) + 3 * sum(map(len, new))) << self.decoding
        self.piece_ids, self.piece_text, self.fragment_ids = {}, {}, self.fragment_ids if len(self.fragment_ids) < MOST_FRAGMENTS else {"\n": b""}
        self.learn_pieces(set(shown))
        get = self.piece_ids.__getitem__
        if self.decoding:
            text = self.piece_text.__getitem__
            self.known.update(zip(new, zip(map(get, shown), map(text, shown))))
        else:
            self.known.update(zip(new, map(get, shown)))

    def encoded(self, texts: list[bytes]) -> list:
        """Ids of texts, with ``decoding`` pairs of ids and decoded text; pieces that aren't known are learned."""
        cut = [self.pieces_of(t.decode()) for t in texts]
        get = self.known.get
        found = [None if pieces is None else list(map(get, pieces)) for pieces in cut]
        missing: set[str] = set()
        for pieces, own in zip(cut, found):
            if own is not None and None in own:
                missing.update(compress(pieces, map(NONE, own)))
        if missing:
            self.know(missing)  # may start a new table; what was found before stays right
            get = self.known.__getitem__
            for pieces, own in zip(cut, found):
                if own is not None and None in own:
                    for k in [k for k, x in enumerate(own) if x is None]:
                        own[k] = get(pieces[k])
        return [self.by_words(t) if own is None else self.joined(own) for t, own in zip(texts, found)]

    def joined(self, own: list):
        if not self.decoding:
            return b"".join(own)
        return b"".join([x for x, _ in own]), b" ".join([y for _, y in own])

    def by_words(self, text: bytes):
        words = text.split()
        self.learn(set(words))
        ids = self.encode(words)
        return (ids, self.text(words)) if self.decoding else ids

    def text(self, words: list[bytes]) -> bytes:
        return b" ".join(filter(None, map(self.decoded.__getitem__, words)))


def marked(token: str) -> str:
    """A token with its word-end suffix folded into its last symbol."""
    return token[: -len(SUFFIX) - 1] + chr(ord(token[-len(SUFFIX) - 1]) + END) if token.endswith(SUFFIX) and token != SUFFIX else token


def is_plain(word: str) -> bool:
    """Whether a word starts its own normal form and holds no white space."""
    return not unicodedata.combining(word[0]) and len(word.split()) == 1 and word.strip() == word


@lru_cache(maxsize=2)
def encoder(spec: str, decoding: bool) -> Encoder:
    return Encoder(spec, decoding)


def shared_vocabulary(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def whole_texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs [a, b) of rows and their texts."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        raw = data[offsets[a] : offsets[b]].tobytes()
        at = (offsets[a : b + 1] - offsets[a]).tolist()
        yield a, b, [raw[x:y] for x, y in zip(at, at[1:])]


def texts_as_words(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Runs [a, b) of rows and their texts cut at ASCII white space."""
    data, offsets = utf8(column)
    for a, b in pieces(offsets):
        raw = data[offsets[a] : offsets[b]].tobytes()
        at = (offsets[a : b + 1] - offsets[a]).tolist()
        yield a, b, [raw[x:y].split() for x, y in zip(at, at[1:])]


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids) per row, and with ``decode`` also the decoded text.

    ``ids`` are little-endian unsigned 32-bit integers in a binary column, four bytes a token.
    """
    spec = shared_vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value, decode)
        for batch in batches:
            for a, b, texts in whole_texts(batch.column(1)):
                with without_cycles():
                    found = own.encoded(texts)
                columns = [batch.column(0).slice(a, b - a), pa.array([x for x, _ in found] if decode else found, pa.binary())]
                if decode:
                    columns.append(pa.array([y for _, y in found], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids"] + ["decoded"] * decode
    schema = "doc_id long, ids binary" + ", decoded string" * decode
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, decoded) of a table that ``encode`` made; null ids decode to the empty string."""
    spec = shared_vocabulary(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value, True)
        for batch in batches:
            texts = [own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")

"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A run of letters, with a mark before it, has the probability that the forward
algorithm sums over all ways to cut it into pieces; a text's score is the
product over its runs. The probabilities are learned by expectation
maximisation from the labelled texts, started from how often each piece occurs.

The fit reads at most ``sample_texts`` texts a language, those with the
smallest hashes of the id, of at most ``sample_bytes`` each: a documented bound.
Prediction reads every whole text. Words repeat, so each worker keeps a bounded
table of words it has scored.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if no labelled text was learned from. Equal scores go to the
language first in the alphabet. Rows are judged alone, by their text only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.bpe import texts_as_words
from veritally.llm.common import written
from veritally.llm.words import mix, seeds, without_cycles

MARK = "▁"
LETTERS = regex.compile(r"\p{L}+").findall
LONGEST_RUN = 32  # a longer run of letters is scored in parts
CACHED_WORDS = 800_000


@dataclass(frozen=True)
class Settings:
    sample_texts: int = 500
    sample_bytes: int = 1 << 16
    rounds: int = 2
    longest_piece: int = 16  # the longest of the vocabulary
    smoothing: float = 0.01
    unknown: float = 1e-7


def read_pieces(path: str, s: Settings) -> list[str]:
    """Lower-case pieces of letters, with or without the mark, of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    good = regex.compile(rf"{MARK}?\p{{L}}+|{MARK}").fullmatch
    return sorted(p for p in found if len(p) <= s.longest_piece and good(p))


class Pieces:
    """Finds all pieces in a batch of letter runs."""

    def __init__(self, pieces: list[str], s: Settings):
        self.n, self.longest = len(pieces), s.longest_piece
        self.base = seeds(1, 11)[0]
        hashes = np.zeros(self.n, np.uint64)
        for k, p in enumerate(pieces):
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in p:
                    x = x * self.base + np.uint64(ord(c) + 1)
            hashes[k] = x
        hashes = mix(hashes)
        # open addressing, so that a look-up is a few gathers
        self.mask = np.uint64((1 << 18) - 1)
        self.slots = np.full(1 << 18, -1, np.int64)
        self.probes = 1
        for k, h in enumerate(hashes.tolist()):
            at, tries = h & int(self.mask), 1
            while self.slots[at] >= 0:
                at, tries = (at + 1) & int(self.mask), tries + 1
            self.slots[at] = k
            self.probes = max(self.probes, tries)
        self.keys = np.where(self.slots >= 0, hashes[self.slots], np.uint64(0))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; n where there is none."""
        out = np.full(hashes.shape, self.n, np.int64)
        left = np.arange(hashes.size)
        flat, found = hashes.ravel(), out.ravel()
        at = flat & self.mask
        for _ in range(self.probes):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[at] == flat[left])
            found[left[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            left, at = left[go], (at[go] + np.uint64(1)) & self.mask
            if not len(left):
                break
        return out

    def lattice(self, runs: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for l = 1, 2, ... the piece of length l that ends at each place, as (run, place)."""
        lengths = np.array([len(r) for r in runs])
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        wide = np.zeros((len(runs), lengths.max()), np.uint64)
        wide[np.arange(wide.shape[1]) < lengths[:, None]] = codes
        ends, rolling = [], np.zeros_like(wide)
        for l in range(1, self.longest + 1):
            before = np.zeros_like(rolling)
            before[:, 1:] = rolling[:, :-1]
            rolling = before * self.base + wide
            found = np.full(wide.shape, self.n, np.int64)
            if l <= wide.shape[1]:
                found[:, l - 1 :] = self.look_up(mix(rolling[:, l - 1 :]))
            if l == 1:
                found[found == self.n] = self.n + 1
            ends.append(found)
        return lengths, ends


def table_of(p: np.ndarray, s: Settings) -> np.ndarray:
    """Piece probabilities with a row for no piece and one for an unknown character."""
    return np.vstack([p, np.zeros((1, p.shape[1])), np.full((1, p.shape[1]), s.unknown)])


def forward(lengths: np.ndarray, ends: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of the first i characters, as (i, run, language)."""
    places = ends[0].shape[1]
    alpha = np.zeros((places + 1, len(lengths), p.shape[1]))
    alpha[0] = 1
    for i in range(1, places + 1):
        for l in range(1, min(len(ends), i) + 1):
            alpha[i] += alpha[i - l] * p[ends[l - 1][:, i - 1]]
    return alpha


def backward(lengths: np.ndarray, ends: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    places = ends[0].shape[1]
    beta = np.zeros((places + 1, len(lengths), p.shape[1]))
    beta[lengths, np.arange(len(lengths))] = 1
    for i in range(places - 1, -1, -1):
        for l in range(1, min(len(ends), places - i) + 1):
            beta[i] += beta[i + l] * p[ends[l - 1][:, i + l - 1]]
    return beta


def runs_of(word: bytes) -> list[str]:
    out = []
    for run in LETTERS(word.decode().lower()):
        run = MARK + run
        out += [run[k : k + LONGEST_RUN] for k in range(0, len(run), LONGEST_RUN)]
    return out


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # (piece, language)
    settings: Settings


class Scorer:
    """Log probabilities of words in every language, with a table of words seen."""

    def __init__(self, model: Model):
        self.finder = Pieces(model.pieces, model.settings)
        self.p = table_of(model.p, model.settings)
        self.k = len(model.languages)
        self.empty()

    def empty(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.values = np.zeros((1 << 12, self.k + 1))

    def learn(self, words: set[bytes]) -> None:
        if len(self.rows) + len(words) > CACHED_WORDS and self.rows:
            self.empty()
        new = list(words.difference(self.rows))
        for at in range(0, len(new), 20_000):
            self.add(new[at : at + 20_000])

    def add(self, words: list[bytes]) -> None:
        cut = [runs_of(w) for w in words]
        runs = sorted({r for rs in cut for r in rs}, key=len)
        number = {r: k for k, r in enumerate(runs)}
        logs = np.zeros((len(runs) + 1, self.k))
        for at in range(0, len(runs), 5_000):
            part = runs[at : at + 5_000]
            lengths, ends = self.finder.lattice(part)
            alpha = forward(lengths, ends, self.p)
            logs[at : at + len(part)] = np.log(alpha[lengths, np.arange(len(part))])
        first = len(self.rows)
        while len(self.values) < first + len(words):
            self.values = np.vstack([self.values, np.zeros_like(self.values)])
        flat = np.array([number[r] for rs in cut for r in rs], np.int64)
        owner = np.repeat(np.arange(len(words)), [len(rs) for rs in cut])
        block = self.values[first : first + len(words)]
        for j in range(self.k):
            block[:, j] = np.bincount(owner, logs[flat, j], minlength=len(words))
        block[:, self.k] = np.bincount(owner, minlength=len(words))
        self.rows.update(zip(words, range(first, first + len(words))))

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Per text the log probability in each language, and how many letter runs it has."""
        self.learn(set().union(*texts))
        get = self.rows.__getitem__
        sizes = np.array([len(t) for t in texts])
        rows = np.fromiter((get(w) for t in texts for w in t), np.int64, int(sizes.sum()))
        sums = np.zeros((len(rows) + 1, self.k + 1))
        np.cumsum(self.values[rows], axis=0, out=sums[1:])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return sums[edges[1:]] - sums[edges[:-1]]


def sample(docs: DataFrame, text: str, lang: str, order: str, s: Settings) -> DataFrame:
    """At most ``s.sample_texts`` texts of each language.

    Texts are thinned by hash to about three times as many before they are ranked, so few texts travel however many there are.
    """
    key = F.xxhash64(F.col(f"`{order}`").cast("string"))
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), key.alias("key"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # as many rows as languages
    if sizes:
        most = [x for k, n in sizes.items() for x in (F.lit(k), F.lit(min((1 << 63) - 1, -(1 << 63) + (3 * s.sample_texts << 64) // n)))]
        rows = rows.filter(F.col("key") <= F.element_at(F.create_map(*most), F.col("lang")))
    pick = Window.partitionBy("lang").orderBy("key", "text")
    rows = rows.filter(F.octet_length("text") <= s.sample_bytes)
    return rows.withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= s.sample_texts).select("text", "lang")


def count_runs(texts: DataFrame) -> DataFrame:
    """(lang, run, times) of the letter runs of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for a, b, parts in texts_as_words(batch.column(0)):
                for lang, words in zip(batch.column(1).slice(a, b - a).to_pylist(), parts):
                    counts.update((lang, r) for w in words for r in runs_of(w))
            rows = [(lang, r, n) for (lang, r), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)], ["lang", "run", "times"])

    kinds = (pa.string(), pa.string(), pa.int64())
    found = texts.mapInArrow(run, "lang string, run string, times long")
    return found.groupBy("lang", "run").agg(F.sum("times").alias("times"))


def expected(runs: DataFrame, model, first: bool) -> DataFrame:
    """(lang, piece, weight): expected uses of each piece, or at first its plain occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        finder = Pieces(m.pieces, m.settings)
        p = table_of(m.p, m.settings)
        total = np.zeros((len(m.pieces) + 2, len(m.languages)))
        at = {lang: k for k, lang in enumerate(m.languages)}
        for batch in batches:
            for a in range(0, batch.num_rows, 5_000):
                part = batch.slice(a, 5_000)
                strings = part.column(1).to_pylist()
                which = np.array([at[x] for x in part.column(0).to_pylist()])
                times = np.asarray(part.column(2), float)
                lengths, ends = finder.lattice(strings)
                if not first:
                    alpha, beta = forward(lengths, ends, p), backward(lengths, ends, p)
                    rows = np.arange(len(strings))
                    z = alpha[lengths, rows, which]
                for l, found in enumerate(ends, 1):
                    run_, place = np.nonzero((found != len(m.pieces)) & (np.arange(found.shape[1]) < lengths[:, None]))
                    piece = found[run_, place]
                    weight = times[run_]
                    if not first:
                        k = which[run_]
                        weight = weight * alpha[place + 1 - l, run_, k] * p[piece, k] * beta[place + 1, run_, k] / z[run_]
                    np.add.at(total, (piece, which[run_]), weight)
        piece, lang = np.nonzero(total[: len(m.pieces)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.languages[k] for k in lang.tolist()], pa.string()), pa.array(piece, pa.int32()), pa.array(total[piece, lang])], ["lang", "piece", "weight"]
        )

    found = runs.select("lang", "run", "times").mapInArrow(run, "lang string, piece int, weight double")
    return found.groupBy("lang", "piece").agg(F.sum("weight").alias("weight"))


def fit(labelled: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", order: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Piece probabilities of every language of ``labelled``; the model's size is pieces times languages."""
    s = settings
    pieces = read_pieces(vocabulary, s)
    runs = written(count_runs(sample(labelled, text, lang, order, s)), "runs")
    languages = sorted(r.lang for r in runs.select("lang").distinct().collect())
    model = Model(languages, pieces, np.zeros((len(pieces), len(languages))), s)
    at = {x: k for k, x in enumerate(languages)}
    for step in range(s.rounds + 1 if languages else 0):
        counts = expected(runs, runs.sparkSession.sparkContext.broadcast(model), step == 0).toArrow()
        weights = np.full(model.p.shape, s.smoothing)
        which = [at[x] for x in counts["lang"].to_pylist()]
        weights[np.asarray(counts["piece"]), which] += np.round(np.asarray(counts["weight"]), 6)
        model = Model(languages, pieces, weights / weights.sum(axis=0), s)
    return model


@lru_cache(maxsize=2)
def scorer(model) -> Scorer:
    return Scorer(model.value)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row; the score is the language's share of all languages' probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared)
        k = len(names) - 1
        for batch in batches:
            for a, b, texts in texts_as_words(batch.column(1)):
                with without_cycles():
                    sums = own.score(texts)
                some = (sums[:, k] > 0) & (k > 0)
                best, share = np.full(b - a, k), np.zeros(b - a)
                if k:
                    logs = sums[:, :k]
                    top = logs.argmax(axis=1)
                    best[some] = top[some]
                    share[some] = (1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1))[some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")

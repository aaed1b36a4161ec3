"""Phrase collocations from a weighted de Bruijn graph of word trigrams.

Texts are split into pieces at punctuation and line ends, pieces into words. Two
neighbouring words are a node, three are an edge between the overlapping nodes
(a b) and (b c), weighted by how often they occur. A piece also ends: its last
two words give an edge (b c) -> end, its last word an edge (c end) -> end. Only
these longest grams are gathered. A node's flow, the sum of its outgoing edges
with the corrections of piece ends among them, is the count of its two words;
the flow of all nodes that start with a word is the count of that word.

A node whose flow comes by one edge and leaves by one edge lies inside a unary
path. Paths are compacted by doubling pointers: a path is one row of words with
one weight. No such path can be a circle, as every piece ends. Candidates are
the trigrams of the paths and the nodes where paths end; a node inside a path is
always covered by a longer phrase of the same count.

1. Words are counted by language and text. They get codes of ``code_bits`` bits
   from a hash; words that share a code, known from this exact table, get numbers
   of their own. Their expected count is V * V / 2 ** (code_bits + 1) for V words, and
   it is checked before they are broadcast. Words with more than 1 / ``hot_words``
   of all occurrences, ``hot_words`` at most, are broadcast too.
2. A task folds the edges of its texts in batches and deals them to shards of
   about ``shard_words`` by their first word; nodes of a hot word by both words,
   and those of two hot words also by ``salts`` parts of the third, so that no
   shard grows with a common word or pair.
3. A shard gives edges and nodes that occur ``least`` times and the flows of its words.

Defined results: a null or empty text has no words; a null language is ``und``;
rows that repeat count each; an empty table gives no rows. Only text and language
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.common import written
from veritally.llm.words import byte_values, mix, pieces, powers, utf8

CODE = 42  # bits of a code, of which the highest tells numbered words
LOW = CODE // 2
MOST_SHARED = 4_000_000


@dataclass(frozen=True)
class Settings:
    """``least`` occurrences make a candidate; ``share`` is in hundredths of a candidate's count."""

    least: int = 10
    share: int = 50
    top: int = 2000
    code_bits: int = 41
    hot_words: int = 65_536
    salts: int = 4096
    shard_words: int = 300_000
    batch_edges: int = 1_000_000
    parts: int = 16


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and which end a piece."""
    inside, ends = np.ones(256, bool), np.zeros(256, bool)
    ends[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
    inside[ends] = False
    inside[[0x20, 0x09]] = False
    return inside, ends


INSIDE, ENDS = kinds()


def words_of(data: np.ndarray, offsets: np.ndarray, tongue: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, hashes, texts and piece numbers of all words; ``tongue`` has a hash of each text's language."""
    inside = INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * up[: len(data)], out=sums[1:])
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    piece = np.concatenate([[0], np.cumsum(ENDS[data])])[starts] + text
    return starts, ends, mix(hashes + tongue[text]), text, piece


def code_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return np.maximum(hashes >> np.uint64(64 - bits), np.uint64(1)).astype(np.int64)  # 0 is the end of a piece


def tongues(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Languages and a 64-bit hash of each."""
    names = column.to_pylist()
    known = {x: int.from_bytes(x.encode()[:8].ljust(8, b"\0"), "little") for x in set(names)}
    for x in known:
        for at in range(8, len(x.encode()), 8):
            part = int.from_bytes(x.encode()[at : at + 8].ljust(8, b"\0"), "little")
            known[x] = (known[x] * 0x9E3779B97F4A7C15 + part) % (1 << 64)
    return names, mix(np.array([known[x] for x in names], np.uint64) + np.uint64(1))


def source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))


def counted_words(docs: DataFrame, text: str, lang: str, s: Settings) -> DataFrame:
    """(lang, word, code, n) of all words, by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = tongues(batch.column(0))
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, own, text, _ = words_of(part, at, hashes[a:b])
                own, first, n = np.unique(own, return_index=True, return_counts=True)
                raw = part.tobytes().lower()
                found = [raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())]
                columns = [pa.array([names[a + k] for k in text[first].tolist()], pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(code_of(own, s.code_bits)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "code", "n"])

    rows = source(docs, text, lang).mapInArrow(run, "lang string, word string, code long, n long")
    return rows.groupBy("lang", "word").agg(F.min("code").alias("code"), F.sum("n").alias("n"))


def coded_words(docs: DataFrame, text: str, lang: str, s: Settings) -> tuple[DataFrame, dict[int, dict[tuple[str, bytes], int]]]:
    """All words with codes of their own, and for each code that a hash gives to several words what it stands for."""
    words = written(counted_words(docs, text, lang, s), "words")
    shared = words.groupBy("code").agg(F.count("*").alias("k")).filter("k > 1").select("code")
    shared = written(words.join(shared, "code", "left_semi").select("code", "lang", "word"), "shared")
    count = shared.count()
    if count > MOST_SHARED:
        raise ValueError(f"{count} words share codes of {s.code_bits} bits: take more bits")
    apart: dict[int, dict[tuple[str, bytes], int]] = {}
    if count:
        rows = sorted((r.code, r.lang, r.word) for r in shared.collect())
        for k, (code, tongue, word) in enumerate(rows):
            apart.setdefault(code, {})[tongue, word.encode()] = (1 << (CODE - 1)) + k
        numbers = [(tongue, word, (1 << (CODE - 1)) + k) for k, (_, tongue, word) in enumerate(rows)]
        numbers = docs.sparkSession.createDataFrame(numbers, "lang string, word string, number long")
        words = written(words.join(numbers, ["lang", "word"], "left").select("lang", "word", F.coalesce("number", "code").alias("code"), "n"), "coded")
    return words, apart


def folded(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a, b) in order, with the sums of n."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def joined(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three codes in two integers, in their order."""
    return (c1 << LOW) | (c2 >> LOW), ((c2 & ((1 << LOW) - 1)) << CODE) | c3


def parted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return a >> LOW, ((a & ((1 << LOW) - 1)) << LOW) | (b >> CODE), b & ((1 << CODE) - 1)


def edges_of(code: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges that start at each word: its code, the next, the one after; 0 beyond the piece."""
    nothing = np.zeros(2, np.int64)
    far = np.concatenate([code, nothing])
    own = np.concatenate([piece, nothing - 1])
    n = len(code)
    return code, np.where(own[1 : n + 1] == piece, far[1 : n + 1], 0), np.where(own[2 : n + 2] == piece, far[2 : n + 2], 0)


def dealt(a: np.ndarray, b: np.ndarray, hot: np.ndarray, shards: int, s: Settings) -> np.ndarray:
    """The shard of each edge."""
    c1, c2, c3 = parted(a, b)
    first = np.isin(c1, hot)
    both = first & np.isin(c2, hot)
    key = mix(c1.astype(np.uint64)) + np.where(first, mix(c2.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    key += np.where(both, mix((c3 % s.salts).astype(np.uint64) + np.uint64(2)), np.uint64(0))
    return (mix(key) % np.uint64(shards)).astype(np.int64)


def graph(docs: DataFrame, words: DataFrame, apart: dict, text: str, lang: str, s: Settings) -> DataFrame:
    """(kind, c1, c2, c3, n): edges (3) and nodes (2) that occur often enough, and flows of words (1).

    Nodes of hot words and flows of hot words come in parts, whatever their count.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = words.filter(F.col("n") * s.hot_words > total).select("code")  # fewer than hot_words rows
    hot = np.sort(np.array([r.code for r in hot.collect()], np.int64))
    shards = max(1, -(-total // s.shard_words))
    given = docs.sparkSession.sparkContext.broadcast((hot, apart))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, apart = given.value
        odd = np.array(sorted(apart), np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            a, b = (np.concatenate(x) for x in zip(*waiting))
            a, b, n = folded(a, b, np.ones(len(a), np.int64))
            waiting.clear()
            for at in range(0, len(a), 1 << 16):
                x, y, z = (c[at : at + (1 << 16)] for c in (a, b, n))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (dealt(x, y, hot, shards, s), x, y, z)], ["shard", "a", "b", "n"])

        for batch in batches:
            names, hashes = tongues(batch.column(0))
            data, offsets = utf8(batch.column(1))
            for x, y in pieces(offsets):
                part, at = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                starts, ends, own, text, piece = words_of(part, at, hashes[x:y])
                code = code_of(own, s.code_bits)
                if len(odd):
                    raw = part.tobytes().lower()
                    for k in np.flatnonzero(np.isin(code, odd)).tolist():
                        code[k] = apart[int(code[k])][names[x + text[k]], raw[starts[k] : ends[k]]]
                waiting.append(joined(*edges_of(code, piece)))
                size += len(code)
                if size >= s.batch_edges:
                    yield from sent()
                    size = 0
        if size:
            yield from sent()

    def reduced(table: pa.Table) -> pa.Table:
        hot, _ = given.value
        a, b, n = folded(*(np.asarray(table[c]) for c in ("a", "b", "n")))
        c1, c2, c3 = parted(a, b)
        solid = np.flatnonzero((n >= s.least) & (c3 > 0))
        node = np.flatnonzero(np.concatenate([[True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]))
        flow, n1, n2 = np.add.reduceat(n, node), c1[node], c2[node]
        word = np.flatnonzero(np.concatenate([[True], n1[1:] != n1[:-1]]))
        total, w = np.add.reduceat(flow, word), n1[word]
        often = np.flatnonzero((n2 > 0) & ((flow >= s.least) | (np.isin(n1, hot) & np.isin(n2, hot))))
        known = np.flatnonzero((total >= s.least) | np.isin(w, hot))
        nothing = lambda x: np.zeros(len(x), np.int64)
        parts = [
            (nothing(solid) + 3, c1[solid], c2[solid], c3[solid], n[solid]),
            (nothing(often) + 2, n1[often], n2[often], nothing(often), flow[often]),
            (nothing(known) + 1, w[known], nothing(known), nothing(known), total[known]),
        ]
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("kind", "c1", "c2", "c3", "n"), zip(*parts))})

    raw = source(docs, text, lang).mapInArrow(run, "shard long, a long, b long, n long")
    return raw.groupBy("shard").applyInArrow(reduced, "kind long, c1 long, c2 long, c3 long, n long")


@dataclass(frozen=True)
class Graph:
    """Edges (c1, c2, c3, n), nodes (c1, c2, flow, out, into: the heaviest edge out and in), words (code, lang, word, f)."""

    edges: DataFrame
    nodes: DataFrame
    words: DataFrame
    sizes: DataFrame


def build(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Graph:
    """The graph of all grams that occur ``least`` times, and ``sizes`` (lang, n): how many words there are."""
    s = settings
    words, apart = coded_words(docs, text, lang, s)
    found = written(graph(docs, words, apart, text, lang, s), "graph")
    edges = found.filter("kind = 3").select("c1", "c2", "c3", "n")
    flows = found.filter("kind = 2").groupBy("c1", "c2").agg(F.sum("n").alias("flow")).filter(F.col("flow") >= s.least)
    out = edges.groupBy("c1", "c2").agg(F.max("n").alias("out"))
    into = edges.groupBy(F.col("c2").alias("c1"), F.col("c3").alias("c2")).agg(F.max("n").alias("into"))
    nodes = flows.join(out, ["c1", "c2"], "left").join(into, ["c1", "c2"], "left").fillna(0, ["out", "into"])
    f = found.filter("kind = 1").groupBy(F.col("c1").alias("code")).agg(F.sum("n").alias("f")).filter(F.col("f") >= s.least)
    known = words.select("code", "lang", "word").join(f, "code")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return Graph(edges, written(nodes, "nodes"), written(known, "known"), sizes)


INNER = "flow = out and flow = into"


def paths(g: Graph) -> DataFrame:
    """(codes, n): the compacted graph, each unary path as its words in order, three at least, and its weight."""
    inner = g.nodes.filter(INNER).select("c1", "c2")
    tail = g.edges.join(inner, ["c1", "c2"], "left_semi")  # the one edge that leaves each inner node
    head = inner.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"))
    entering = written(g.edges.join(head, ["c2", "c3"], "left_semi"), "entering")  # the one edge that enters it
    before = inner.select("c1", "c2", F.lit(1).alias("inside"))
    # each inner node points to the inner node before it, or is the first of its path
    jump = entering.join(before, ["c1", "c2"], "left").select(
        F.col("c2").alias("v1"), F.col("c3").alias("v2"),
        F.when(F.col("inside") == 1, F.col("c1")).otherwise(F.col("c2")).alias("p1"),
        F.when(F.col("inside") == 1, F.col("c2")).otherwise(F.col("c3")).alias("p2"),
        F.coalesce("inside", F.lit(0)).cast("long").alias("steps"),
    )
    while True:
        jump = written(jump, "jump")
        further = jump.filter("steps > 0").select(F.col("v1").alias("p1"), F.col("v2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("steps").alias("more"))
        pending = jump.filter("steps > 0").join(further, ["p1", "p2"], "left_semi")
        if pending.isEmpty():
            break
        jump = jump.join(further, ["p1", "p2"], "left").select("v1", "v2", F.coalesce("q1", "p1").alias("p1"), F.coalesce("q2", "p2").alias("p2"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    steps = tail.join(jump.select(F.col("v1").alias("c1"), F.col("v2").alias("c2"), "p1", "p2", "steps"), ["c1", "c2"])
    steps = steps.select("p1", "p2", F.struct("steps", F.col("c3").alias("code")).alias("step"), "n")
    starts = entering.select(F.col("c2").alias("p1"), F.col("c3").alias("p2"), "c1").join(jump.filter("steps = 0").select(F.col("v1").alias("p1"), F.col("v2").alias("p2")), ["p1", "p2"], "left_semi")
    rest = steps.groupBy("p1", "p2").agg(F.array_sort(F.collect_list("step")).alias("rest"), F.max("n").alias("n"))
    long = starts.join(rest, ["p1", "p2"]).select(F.concat(F.array("c1", "p1", "p2"), F.col("rest.code")).alias("codes"), "n")
    alone = g.edges.join(inner, ["c1", "c2"], "left_anti").join(head, ["c2", "c3"], "left_anti")
    return written(long.unionByName(alone.select(F.array("c1", "c2", "c3").alias("codes"), "n")), "paths")


def named(df: DataFrame, words: DataFrame, columns: list[str]) -> DataFrame:
    """Adds word and count (w_, f_) of each code column."""
    for c in columns:
        df = df.join(words.select(F.col("code").alias(c), F.col("word").alias(f"w_{c}"), F.col("f").alias(f"f_{c}")), c)
    return df


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two or three words of each language."""
    s = settings
    g = build(docs, text, lang, s)
    at = F.expr("explode(sequence(0, size(codes) - 3))").alias("at")
    three = paths(g).select("codes", "n", at).select(*[F.expr(f"codes[at + {k}]").alias(f"c{k + 1}") for k in range(3)], F.col("n").alias("a"))
    flow = lambda x, y, name: g.nodes.select(F.col("c1").alias(x), F.col("c2").alias(y), F.col("flow").alias(name))
    three = three.join(flow("c1", "c2", "left"), ["c1", "c2"]).join(flow("c2", "c3", "right"), ["c2", "c3"])
    three = named(three, g.words.drop("lang"), ["c2", "c3"]).join(g.words.select(F.col("code").alias("c1"), "lang", F.col("word").alias("w_c1"), F.col("f").alias("f_c1")), "c1")
    # a node is dropped if a trigram that holds it occurs often enough; one inside a path always is
    two = g.nodes.filter(100 * F.greatest("out", "into") < s.share * F.col("flow")).select("c1", "c2", F.col("flow").alias("a"))
    two = named(two, g.words.drop("lang"), ["c2"]).join(g.words.select(F.col("code").alias("c1"), "lang", F.col("word").alias("w_c1"), F.col("f").alias("f_c1")), "c1")

    exact = lambda c: F.col(c).cast("decimal(19,0)")

    def cut(left: str, right: str):
        # the quotient is a million at most
        score = F.expr(f"(cast(1000000 as decimal(38,0)) * (cast(a as decimal(19,0)) * cast(a as decimal(19,0)))) div (cast(`{left}` as decimal(19,0)) * cast(`{right}` as decimal(19,0)))")
        return F.struct(score.alias("score"), exact(left).cast("long").alias("l"), exact(right).cast("long").alias("r"))

    first, second = cut("f_c1", "right"), cut("left", "f_c3")
    three = three.select("lang", F.concat_ws(" ", "w_c1", "w_c2", "w_c3").alias("phrase"), "a", F.when(first.score <= second.score, first).otherwise(second).alias("cut"))
    two = two.select("lang", F.concat_ws(" ", "w_c1", "w_c2").alias("phrase"), "a", cut("f_c1", "f_c2").alias("cut"))
    every = reduce(DataFrame.unionByName, [three, two]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # the first of each part of a language, then of the parts: at most parts * top rows come together, whatever the size
    part = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(s.parts)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= s.top)
    best = part.drop("part", "place").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= s.top)
    return best.join(g.sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Packing of token sequences by multiway Karmarkar-Karp differencing.

A document's tokens (with an end token) fill whole windows first; what is left
is cut into parts of at most ``part`` tokens. The parts of all documents are
dealt by hash to blocks of about ``block_windows`` windows of tokens, whatever
the input's size. In a block every part starts as a partition of its own; the
two partitions with the widest spread are merged again and again, the fullest
windows of one onto the emptiest of the other, until one partition with nearly
equal windows is left. The number of windows starts at the fewest that could
hold the block and rises while a window exceeds the capacity.

Defined results: a null or empty text is the end token alone; rows that repeat
are packed each; an empty table gives no pieces. Only id and text are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.bpe import encoder, shared_vocabulary, whole_texts
from veritally.llm.common import written
from veritally.llm.words import without_cycles


@dataclass(frozen=True)
class Settings:
    capacity: int = 2048
    part: int = 256
    block_windows: int = 256
    end_token: int = 1


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
OWN = 1 << 62  # windows that one piece fills are numbered from here


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, by the largest differencing method for k windows."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # a node is an item (below n) or two nodes that share a window
    joined: list[tuple[int, int]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def opened(i: int) -> tuple[np.ndarray, np.ndarray]:
        if i in parts:
            return parts.pop(i)
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = sizes[i], i
        return sums, nodes

    fresh = n
    made = n
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        a, x = opened(i)
        b, y = opened(j)
        sums, y = a + b[::-1], y[::-1]
        nodes = np.maximum(x, y)  # an empty window is -1
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            joined += zip(x[both].tolist(), y[both].tolist())
            nodes[both] = np.arange(made, made + len(both))
            made += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[-1]
        parts[fresh] = sums, nodes
        heapq.heappush(heap, (-int(sums[0]), fresh))
        fresh += 1
    window = np.full(made, -1, np.int64)
    if heap:
        _, nodes = opened(heap[0][1])
        window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for at in range(len(joined) - 1, -1, -1):
        x, y = joined[at]
        window[x] = window[y] = window[n + at]
    return window[:n]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and how many windows there are; no window exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        over = int(np.bincount(window, sizes, minlength=k).max()) if len(sizes) else 0
        if over <= capacity:
            return window, k
        k += 1


def cut(docs: DataFrame, vocabulary: str, doc_id: str, text: str, s: Settings) -> DataFrame:
    """All pieces; a piece that fills a window has its sequence id, the others a number to deal them by."""
    spec = shared_vocabulary(docs, vocabulary)
    end = np.array([s.end_token], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value, False)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, texts in whole_texts(batch.column(1)):
                with without_cycles():
                    encoded = own.encoded(texts)
                rows: list[tuple] = []
                for doc, found in zip(batch.column(0).slice(a, b - a).to_pylist(), encoded):
                    ids = memoryview(found + end)
                    total = len(ids) // 4
                    full = total - total % s.capacity
                    at = 0
                    while at < total:
                        length = s.capacity if at < full else min(s.part, total - at)
                        rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, number))
                        at += length
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=shape)

    shape = pa.schema([(c.split()[0], pa.int64()) for c in (PIECE + ", number long").split(", ")])
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, PIECE + ", number long")


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per piece: where it comes from, and its ``sequence_id`` and ``offset`` there."""
    s = settings
    pieces = written(cut(docs, vocabulary, doc_id, text, s), "pieces")
    whole = F.col("length") == s.capacity
    rest = pieces.filter(~whole)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(tokens / (s.capacity * s.block_windows)))

    def run(table: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("start", "ascending"), ("number", "ascending")]
        table = table.sort_by(order)
        sizes = np.asarray(table["length"])
        with without_cycles():
            window, _ = windows(sizes, s.capacity)
        by = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[by])
        first = np.searchsorted(window[by], window[by])
        offset = np.empty(len(sizes), np.int64)
        offset[by] = ends - sizes[by] - (ends - sizes[by])[first]
        sequence = window + (table["block"][0].as_py() << 24)
        return table.drop_columns(["number", "block"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    block = F.pmod(F.xxhash64("number", "doc_id", "start"), F.lit(blocks)).alias("block")
    packed = rest.select("*", block).groupBy("block").applyInArrow(run, PIECE + ", sequence_id long, offset long")
    own = pieces.filter(whole).withColumns({"sequence_id": F.col("number") + F.lit(OWN), "offset": F.lit(0).cast("long")}).drop("number")
    return own.unionByName(packed)

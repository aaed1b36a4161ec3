"""Links between embedding vectors by Euclidean p-stable hashing and exact cosines.

Vectors are scaled to length one, where a cosine is a distance. In each of many
tables a vector's bucket is the cell of ``projections`` random projections,
cut to steps of ``step``. The number of projections grows with the logarithm of
the number of vectors, so that unrelated vectors share few buckets; the number
of tables follows from the wanted recall at the threshold itself.

Vectors that are equal component by component are one node. As most links lie
within dense groups, nodes get a label, the smallest node that they reach over
two shared buckets: all pairs of a label are compared, in tiles of bounded size
that return counts and a spanning set of links, not pairs. Pairs that share a
bucket but no label are compared in tiles of the bucket.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component links with nothing; so does one of another dimension, and
a row without id, which keeps a null component and is kept. Rows that repeat an
id and its vector are one vector; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import written
from veritally.llm.components import components
from veritally.llm.minhash import in_tiles, lists
from veritally.llm.words import mix, seeds


@dataclass(frozen=True)
class Settings:
    """``recall`` is the chance to find a pair that is just similar enough; closer pairs are found more surely."""

    cosine: float = 0.95
    step: float = 2.0
    recall: float = 0.998
    far: float = math.sqrt(2)
    tile: int = 1024
    seed: int = 7


def meet(distance: float, step: float) -> float:
    """Chance that two vectors at a distance share the cell of one projection."""
    r = step / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, s: Settings) -> tuple[int, int]:
    """Projections a table and tables, for ``n`` vectors."""
    near = meet(math.sqrt(2 - 2 * s.cosine), s.step)
    projections = max(4, math.ceil(math.log(16 * max(n, 2)) / -math.log(meet(s.far, s.step))))
    return projections, math.ceil(math.log(1 - s.recall) / math.log(1 - near**projections))


def bucket_keys(vectors: np.ndarray, projections: int, tables: int, s: Settings) -> np.ndarray:
    """One 64-bit bucket key per vector and table; the rows of ``vectors`` have length one."""
    n, width = vectors.shape
    source = np.random.default_rng([s.seed, width])
    keys = np.empty((n, tables), np.int64)
    weights = seeds(projections, 12)
    names = seeds(tables, 13) + np.uint64(width)
    for t in range(tables):
        directions = source.standard_normal((width, projections))
        cells = np.floor((vectors @ directions + source.uniform(0, s.step, projections)) / s.step).astype(np.int64)
        keys[:, t] = mix(mix(cells.view(np.uint64) * weights).sum(axis=1) + names[t]).view(np.int64)
    return keys


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def hashed(nodes: DataFrame, projections: int, tables: int, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(np.asarray(batch.column(1).offsets))
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                vectors = matrix(part.column(1))
                unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(bucket_keys(unit, projections, tables, s))], ["node", "keys"])

    return nodes.select("node", "vector").mapInArrow(run, "node long, keys array<long>")


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left @ right.T / (np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect all that the pairs (a, b) of 0 to n - 1 connect; at most n - 1."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def counted(node: np.ndarray, copies: np.ndarray, linked: np.ndarray, left: np.ndarray, right: np.ndarray, own: bool) -> pa.Table:
    """Rows (a, b, links) of a linked-or-not matrix: with b null, how many vectors a links to; else a link of a spanning set."""
    links = np.zeros(len(node), np.int64)
    links[left] = linked @ copies[right]
    if not own:
        links[right] += linked.T @ copies[left]
    x, y = np.nonzero(linked)
    pairs = spanning(left[x], right[y], len(node))
    some = np.flatnonzero(links)
    a = [*node[some].tolist(), *(int(node[p]) for p, _ in pairs)]
    b = [None] * len(some) + [int(node[q]) for _, q in pairs]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*links[some].tolist(), *[0] * len(pairs)], pa.int64())})


def linked_by_label(members: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """``counted`` over all pairs of each label of the members (label, node)."""

    def run(table: pa.Table) -> pa.Table:
        tile = np.asarray(table["tile"])
        low, high = table["t"][0].as_py(), table["u"][0].as_py()
        vectors = matrix(table["vector"])
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        linked = cosines(vectors[left], vectors[right]) >= s.cosine
        if low == high:
            np.fill_diagonal(linked, False)
        return counted(np.asarray(table["node"]), np.asarray(table["copies"]), linked, left, right, low == high)

    cut = in_tiles(members, "label", s.tile).join(nodes, "node").select("label", "t", "u", "tile", "node", "copies", "vector")
    return cut.groupBy("label", "t", "u").applyInArrow(run, "a long, b long, links long")


def linked_by_key(members: DataFrame, nodes: DataFrame, hashes: DataFrame, s: Settings) -> DataFrame:
    """``counted`` over the pairs of members (key, node, label) that share a bucket but no label, each in the first bucket that it shares."""

    def run(table: pa.Table) -> pa.Table:
        tile = np.asarray(table["tile"])
        low, high, here = table["t"][0].as_py(), table["u"][0].as_py(), table["key"][0].as_py()
        node, label, vectors = np.asarray(table["node"]), np.asarray(table["label"]), matrix(table["vector"])
        keys = np.asarray(table["keys"].combine_chunks().flatten()).reshape(len(node), -1)
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        linked = (cosines(vectors[left], vectors[right]) >= s.cosine) & (label[left][:, None] != label[right])
        for i, row in zip(left.tolist(), linked):
            js = np.flatnonzero(row)
            if len(js):
                same = keys[right[js]] == keys[i]
                row[js[keys[i][same.argmax(axis=1)] != here]] = False
        return counted(node, np.asarray(table["copies"]), linked, left, right, low == high)

    cut = in_tiles(members, "key", s.tile).join(hashes, "node").join(nodes, "node")
    cut = cut.select("key", "t", "u", "tile", "node", "label", "copies", "keys", "vector")
    return cut.groupBy("key", "t", "u").applyInArrow(run, "a long, b long, links long")


def link_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    s = settings
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    real = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    good = rows.filter(F.coalesce(real, F.lit(False)))
    nodes = good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))
    nodes = written(nodes, "vectors")
    projections, tables = shape(nodes.count(), s)

    hashes = written(hashed(nodes, projections, tables, s), "keys")
    keys = hashes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead < top").drop("top")
    keys = written(keys.join(shared, "key"), "buckets")
    lead = keys.groupBy("node").agg(F.min("lead").alias("lead"))
    lead = keys.select("key", "node").join(lead, "node").groupBy("key").agg(F.min("lead").alias("lead"))
    label = written(keys.select("key", "node").join(lead, "key").groupBy("node").agg(F.min("lead").alias("label")), "labels")

    spread = keys.select("key", "node").join(label, "node")
    mixed = spread.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    apart = spread.join(mixed, "key", "left_semi")
    links = written(linked_by_label(label, nodes, s).union(linked_by_key(apart, nodes, hashes, s)), "links")
    groups = components(links.filter("b is not null").select("a", "b"))
    counts = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    found = nodes.join(counts, "node", "left").join(groups, "node", "left")
    found = found.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    linked = good.join(found, "vector").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter(~F.coalesce(real, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

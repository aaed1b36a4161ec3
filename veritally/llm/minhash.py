"""Near duplicates by MinHash, odd sketches and exact checks.

1. A text's distinct word shingles give ``bands * rows`` MinHash samples. The
   samples are folded into an odd sketch: each flips one bit of a bitmap, so
   the XOR of two bitmaps counts the samples that differ.
2. Texts with the same shingle set are one node, named by their smallest id.
3. Nodes that share a band are candidates. A node's label is the smallest node
   it reaches over two shared bands; nodes of a label meet in tiles of bounded
   size, where sketches rule pairs out and full shingle sets decide. Pairs that
   are connected already are passed over, so a tile gives fewer links than it
   has members, however many of its pairs are alike.
4. The few pairs that share a band but no label are compared sketch against
   sketch in tiles of their band and then checked on their full sets.

Defined results: a null or empty text has no shingles and links with nothing;
fewer words than a shingle are one shingle; a row without id links with nothing
and is kept with a null component; rows that repeat an id get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import written
from veritally.llm.components import components
from veritally.llm.words import mix, pieces, seeds, shingle_sets, utf8

BATCH_ROWS = 512


@dataclass(frozen=True)
class Settings:
    """``similar`` is a Jaccard similarity in hundredths.

    With 28 bands of 5 samples a pair at 0.80 is missed with probability 2e-5, one
    at 0.85 with 1e-7. ``slack`` is how far below the threshold a sketch estimate
    may lie for the exact check to be made: over four standard errors.
    """

    words: int = 5
    similar: int = 80
    bands: int = 28
    rows: int = 5
    sketch_longs: int = 8
    slack: float = 0.16
    tile: int = 1024
    tile_shingles: int = 1 << 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Largest XOR count of two sketches that may still be similar enough."""
        bits = 64 * self.sketch_longs
        differ = 2 * self.samples * (1 - (self.similar / 100 - self.slack))
        return int(bits / 2 * (1 - np.exp(-2 * differ / bits)))


def signature(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """MinHash samples, one row per set; the sets are not empty."""
    factors, flips = seeds(s.samples, 3), mix(seeds(s.samples, 4))
    out = np.empty((len(sets), s.samples), np.uint64)
    for k, values in enumerate(sets):
        best = None
        for at in range(0, len(values), 2048):
            low = ((values[at : at + 2048, None] ^ flips) * factors).min(axis=0)
            best = low if best is None else np.minimum(best, low)
        out[k] = best
    return out


def band_keys(samples: np.ndarray, s: Settings) -> np.ndarray:
    weights = seeds(s.samples, 5)
    return mix((mix(samples) * weights).reshape(len(samples), s.bands, s.rows).sum(axis=2) + seeds(s.bands, 6)).view(np.int64)


def odd_sketch(samples: np.ndarray, s: Settings) -> np.ndarray:
    bits = 64 * s.sketch_longs
    place = mix(samples + seeds(s.samples, 7)) % np.uint64(bits)
    flat = (place + (np.arange(len(samples), dtype=np.uint64) * np.uint64(bits))[:, None]).ravel().astype(np.int64)
    odd = (np.bincount(flat, minlength=len(samples) * bits) & 1).astype(np.uint8).reshape(-1, bits)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64).reshape(len(samples), s.sketch_longs)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list array."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def describe(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Per row: id, size of its shingle set, digest of the set, band keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], s.words)
                sizes = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(sizes)
                samples = signature([sets[k] for k in some], s)
                full = np.zeros((b - a, s.bands + s.sketch_longs), np.int64)
                full[some, : s.bands] = band_keys(samples, s)
                full[some, s.bands :] = odd_sketch(samples, s)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                columns = [ids.slice(a, b - a), pa.array(sizes), pa.array(digests, pa.binary()), lists(full[:, : s.bands]), lists(full[:, s.bands :])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "sketch"])

    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, schema)


def shingles_of(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Per row: id and its sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            for a, b in pieces(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], s.words)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    return docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for k in range(batch.num_rows):
                x = np.frombuffer(left[k].as_buffer(), np.uint64)
                y = np.frombuffer(right[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.similar * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    side = lambda c, name: sets.select(F.col("node").alias(c), F.col("shingles").alias(name))
    joined = pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def in_tiles(members: DataFrame, by: str, size: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """Members (``by``, node, ...) dealt to tiles of about ``size``, once for each pair of tiles that their own belongs to.

    A tile's sum of ``weight`` is about ``most`` at most, but for a member that weighs more alone.

    Pass slim rows and join what is wide afterwards, by node: then a hot group is spread before its bytes travel.
    """
    tiles = F.ceil(F.count("*") / size)
    if weight:
        tiles = F.greatest(tiles, F.ceil(F.sum(weight) / most))
    sizes = written(members.groupBy(by).agg(tiles.cast("int").alias("tiles")), "tiles")
    cut = members.join(sizes, by).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    cut = cut.select("*", other).withColumns({"t": F.least("tile", "other"), "u": F.greatest("tile", "other")})
    return cut.drop("tiles", "other")


def sketches_of(table: pa.Table, s: Settings) -> np.ndarray:
    return np.asarray(table["sketch"].combine_chunks().flatten()).view(np.uint64).reshape(-1, s.sketch_longs)


def linked_in_tiles(members: DataFrame, sketch: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) among the members (label, node) of each label, enough to connect what is linked.

    Sketches rule pairs out, then full sets are compared; pairs that links already connect are passed over. A tile
    pair gives fewer links than it has members.
    """

    def run(table: pa.Table) -> pa.Table:
        node, tile = np.asarray(table["node"]), np.asarray(table["tile"])
        low, high = table["t"][0].as_py(), table["u"][0].as_py()
        sketch = sketches_of(table, s)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"].combine_chunks()]
        sizes = np.array([len(x) for x in sets])
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(dense, np.cumsum(sizes)[:-1])
        own = np.zeros(int(dense.max()) + 1, bool)
        group = np.arange(len(node))
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        found = []
        for i in left.tolist():
            js = right[right > i] if low == high else right
            js = js[group[js] != group[i]]
            # a union of two sets is at least as large as the larger one
            fits = 100 * np.minimum(sizes[js], sizes[i]) >= s.similar * np.maximum(sizes[js], sizes[i])
            js = js[fits]
            js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1) <= s.most_bits]
            if not len(js):
                continue
            own[ids[i]] = True
            both = np.add.reduceat(own[np.concatenate([ids[j] for j in js])].astype(np.int64), np.cumsum(sizes[js]) - sizes[js])
            own[ids[i]] = False
            for j in js[100 * both >= s.similar * (sizes[js] + sizes[i] - both)].tolist():
                if group[j] != group[i]:
                    found.append((node[i], node[j]))
                    group[group == group[j]] = group[i]
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    weighed = members.join(sets.select("node", (F.octet_length("shingles") / 8).alias("weight")), "node")
    cut = in_tiles(weighed, "label", s.tile, "weight", s.tile_shingles).drop("weight").join(sketch, "node").join(sets, "node")
    cut = cut.select("label", "t", "u", "tile", "node", "sketch", "shingles")
    return cut.groupBy("label", "t", "u").applyInArrow(run, "a long, b long")


def close_in_tiles(members: DataFrame, sketch: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that share a key, but neither label nor component, and whose sketches are close."""

    def run(table: pa.Table) -> pa.Table:
        tile = np.asarray(table["tile"])
        low, high = table["t"][0].as_py(), table["u"][0].as_py()
        node, group, label = (np.asarray(table[c]) for c in ("node", "component", "label"))
        sketch = sketches_of(table, s)
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        found = [np.zeros((0, 2), np.int64)]
        for i in left.tolist():
            js = right[(group[right] != group[i]) & (label[right] != label[i])]
            js = js[node[js] > node[i]] if low == high else js
            near = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1) <= s.most_bits]
            found.append(np.column_stack([np.full(len(near), node[i]), node[near]]))
        out = np.concatenate(found)
        out.sort(axis=1)
        return pa.table({"a": pa.array(out[:, 0], pa.int64()), "b": pa.array(out[:, 1], pa.int64())})

    cut = in_tiles(members, "key", s.tile).join(sketch, "node")
    cut = cut.select("key", "t", "u", "tile", "node", "component", "label", "sketch")
    return cut.groupBy("key", "t", "u").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    s = settings
    rows = written(describe(docs, doc_id, text, s), "described")
    real = rows.filter("n_shingles > 0 and doc_id is not null")
    names = written(real.groupBy("digest").agg(F.min("doc_id").alias("node")), "names")  # a table, so that Spark may split a hot digest in joins
    nodes = written(real.join(names, "digest").filter("doc_id = node").dropDuplicates(["node"]).select("node", "bands", "sketch"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top")).filter("lead < top").drop("top")
    banded = written(banded.join(shared, "key"), "banded")

    # a node's label: the smallest node that it reaches over two shared bands
    lead = banded.groupBy("node").agg(F.min("lead").alias("lead"))
    lead = banded.select("key", "node").join(lead, "node").groupBy("key").agg(F.min("lead").alias("lead"))
    label = written(banded.select("key", "node").join(lead, "key").groupBy("node").agg(F.min("lead").alias("label")), "labels")
    sketch = nodes.select("node", "sketch")

    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(label.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi")
    sets = written(shingles_of(texts, "id", "text", s).dropDuplicates(["node"]), "shingles")
    members = label.union(label.select("label", "label")).distinct()
    links = written(linked_in_tiles(members, sketch, sets, s), "links")
    groups = components(links)

    # pairs that share a band but no label
    spread = banded.select("key", "node").join(label, "node").join(groups, "node", "left")
    spread = written(spread.select("key", "node", "label", F.coalesce("component", "node").alias("component")), "spread")
    apart = [F.min(c).alias(f"{c}_a") for c in ("label", "component")] + [F.max(c).alias(f"{c}_b") for c in ("label", "component")]
    mixed = spread.groupBy("key").agg(*apart).filter("label_a < label_b and component_a < component_b").select("key")
    later = written(close_in_tiles(spread.join(mixed, "key", "left_semi"), sketch, s), "later")
    if not later.isEmpty():
        links = links.union(confirmed(later, sets, s))
        groups = components(links)

    found = names.join(groups, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = rows.drop("bands", "sketch").join(found, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest id; rows without id stay."""
    found = written(near_duplicates(docs, doc_id, text, settings).select("doc_id", "kept"), "kept")
    name = f"`{doc_id}`"
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = written(gone, "gone").hint("merge")  # texts are dealt alike at every size
    rest = docs.join(gone, F.col(name).cast("long") == F.col("__gone"), "left_anti")
    again = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again")
    again = written(again, "again")
    if again.isEmpty():
        return rest
    on = F.col(name).cast("long") == F.col("__again")
    return rest.join(again, on, "left_anti").unionByName(rest.join(again, on, "left_semi").dropDuplicates([doc_id, text]))

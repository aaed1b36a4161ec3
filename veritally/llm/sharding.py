"""Shards of near equal bytes by Karmarkar-Karp differencing of indivisible groups.

Rows with equal text are a group and stay together. In the differencing method
each group starts as a partition of its own; the two partitions with the widest
spread are merged again and again, the fullest shards of one onto the emptiest
of the other. One task can't hold all groups of a large table, so it is done in
levels of the same step: items (groups at first) are dealt by hash to blocks of
about ``block_items``, and a block is differenced into bundles of about equal
size, which are the next level's items. An item as large as a bundle stays as it
is. Every ``fine_every``-th block gives bundles that are ``finer`` times smaller:
they fill what equal bundles would leave uneven. Once ``last_items`` or fewer are
left they are differenced into the shards. The driver sees two sums a level.

A group larger than a shard's even share gets a shard that holds little else,
and the other shards are even among themselves.

Defined results: a null text has size ``overhead``, CRC 0 and the group of the
empty text; rows that repeat are a group and get a slot each; rows without id
are treated like others; an empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.common import written
from veritally.llm.packing import differencing
from veritally.llm.repeats import text_key


@dataclass(frozen=True)
class Settings:
    """``bundles_a_shard`` sets the size of a bundle; the rest bounds what one task holds."""

    shards: int = 24
    overhead: int = 8
    bundles_a_shard: int = 64
    finer: int = 64
    fine_every: int = 32
    block_items: int = 4096
    last_items: int = 16_384


def sized(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """Per row: id, size, CRC of the text and the key of its group."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.octet_length(raw) + s.overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        text_key(F.col(f"`{text}`")).alias("item"),
    )


def in_blocks(items: DataFrame, n: int, target: float, level: int, s: Settings) -> DataFrame:
    """(item, size, parent): the bundle of each item, differenced block by block."""
    blocks = -(-n // s.block_items)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        sizes = np.asarray(table["size"])
        block = table["block"][0].as_py()
        aim = target / s.finer if block % s.fine_every == 0 else target
        bundles = min(len(sizes), max(1, round(int(sizes.sum()) / aim)))
        own = np.arange(len(sizes)) if bundles == len(sizes) else differencing(sizes, bundles)
        parent = pa.array([b"%d:%d:%d" % (level, block, k) for k in own.tolist()], pa.binary())
        return pa.table({"item": table["item"], "size": table["size"], "parent": parent})

    shape = "item binary, size long, parent binary"
    light = items.filter(F.col("size") < target).withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
    heavy = items.filter(F.col("size") >= target).select("item", "size", F.col("item").alias("parent"))
    return light.groupBy("block").applyInArrow(run, shape).unionByName(heavy)


def assigned(groups: DataFrame, s: Settings) -> DataFrame:
    """(item, shard) of all groups (item, size)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        own = differencing(np.asarray(table["size"]), s.shards)
        return pa.table({"item": table["item"], "shard": pa.array(own, pa.int32())})

    levels, items = [], groups
    while True:
        n, total = items.agg(F.count("*"), F.sum("size")).first()
        if n <= s.last_items:
            break
        level = written(in_blocks(items, n, total / (s.shards * s.bundles_a_shard), len(levels), s), "bundles")
        levels.append(level)
        items = level.groupBy(F.col("parent").alias("item")).agg(F.sum("size").alias("size"))
    # at most last_items rows: one task
    found = written(items.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "item binary, shard int"), "shards")
    for level in reversed(levels):
        found = level.select("item", "parent").join(found.withColumnRenamed("item", "parent"), "parent").select("item", "shard")
    return written(found, "assigned") if levels else found


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``slot``, gapless from 0 in their shard: numbers inside a task, moved by the rows of earlier tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = np.asarray(batch.column(batch.schema.get_field_index("shard")))
            counts = np.bincount(shard, minlength=len(seen))
            seen = np.concatenate([seen, np.zeros(len(counts) - len(seen), np.int64)])
            order = np.argsort(shard, kind="stable")
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen = seen + counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at)], [*batch.schema.names, "part", "at"])

    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    rows = written(rows.mapInArrow(run, f"{shape}, part int, at long"), "numbered")  # a table: numbers and counts are of the same rows
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = written(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "first")
    return rows.join(moved, ["shard", "part"]).withColumn("slot", F.col("at") + F.col("first")).drop("part", "at", "first")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    s = settings
    rows = written(sized(docs, doc_id, text, s), "sized")
    groups = written(rows.groupBy("item").agg(F.sum("size").alias("size")), "groups")
    found = assigned(groups, s)
    return numbered(rows.join(found.hint("merge"), "item").drop("item")).select("doc_id", "size", "text_crc32", "shard", "slot")

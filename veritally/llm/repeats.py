"""Long repeated byte strings, found with suffix arrays over shards.

A byte goes if some string of ``length`` bytes that covers it also starts
anywhere else in the corpus. Equal strings must meet in one shard, so each
window of ``length`` bytes belongs to its anchor: the ``gram`` bytes in it with
the smallest hash, the leftmost of equals. Equal windows have equal anchors.

1. Each text gives its cells: runs of window starts with the same anchor, with
   the anchor's hash and a digest of the run's bytes.
2. Anchors that occur once are dropped. Cells with the same digest are folded;
   a cell that occurs twice is repeated from end to end.
3. Anchors that still have different cells go to shards of about
   ``shard_bytes``. A shard's cells are laid side by side; its suffix array is
   built by induced sorting, and the permuted common prefixes say which window
   starts share ``length`` bytes with a neighbour in suffix order.
4. An anchor with more than ``hot_bytes`` of different cells isn't collected:
   its cells are cut into narrower runs of starts, keyed by the bytes that all
   windows of a run share, folded again, and so on down to single windows.

Every step is exact at every size. Defined results: a null or empty text has no
bytes; texts shorter than ``length`` keep all; repeated rows are repeats of each
other; rows without id are treated like others. Result rows are those of the
input, whatever its other columns are called.
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
from veritally.llm.suffixes import permuted_prefixes, suffix_array
from veritally.llm.words import mix, pieces, powers, seeds, utf8

PLACE_BITS = 22
SEGMENT = 1 << 20


@dataclass(frozen=True)
class Settings:
    length: int = 400
    gram: int = 32
    shard_bytes: int = 1 << 20
    hot_bytes: int = 1 << 19
    narrower: tuple[int, ...] = (32, 4, 1)


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys."""
    span, low = 1, keys
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def cells_of(data: np.ndarray, offsets: np.ndarray, s: Settings) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, anchor hash, anchor place, first start, last start) of all cells; places count from the piece's start.

    A long text is taken in overlapping segments. A cell may be cut where segments meet, which changes how
    windows are grouped but not which windows there are.
    """
    total = len(data)
    gram_values = seeds(256, 9)
    for at in range(0, max(total - s.length + 1, 0), SEGMENT):
        part = data[at : at + SEGMENT + s.length - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(gram_values[part] * up[: len(part)], out=sums[1:])
        n = len(part) - s.gram + 1
        grams = mix((sums[s.gram :] - sums[:-s.gram]) * down[:n])
        keys = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(n, dtype=np.uint64)
        owner = (smallest(keys, s.length - s.gram + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        starts = np.arange(at, at + len(owner))
        text = np.searchsorted(offsets, starts, side="right") - 1
        valid = np.flatnonzero(starts + s.length <= offsets[text + 1])
        if not len(valid):
            continue
        own = owner[valid]
        cut = np.flatnonzero((own[1:] != own[:-1]) | (np.diff(valid) > 1)) + 1
        first = valid[np.concatenate([[0], cut])]
        last = valid[np.concatenate([cut - 1, [len(valid) - 1]])]
        anchor = owner[first]
        yield from zip(
            text[first].tolist(), grams[anchor].view(np.int64).tolist(), (anchor + at).tolist(), (first + at).tolist(), (last + at).tolist()
        )


def digest(content, shift: int = 0) -> bytes:
    return hashlib.blake2b(content, digest_size=16, salt=shift.to_bytes(4, "little")).digest()


def text_key(text) -> F.Column:
    """What tells texts apart: 128 bits of SHA-256; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


CELLS = "anchor long, cell binary, doc long, own binary, low int, high int, place int"


def emit(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """All cells of all texts, in places of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in pieces(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                raw = part.tobytes()
                starts = at.tolist()
                docs_, own = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                rows = [
                    (anchor, digest(raw[low : high + s.length], place - low), docs_[k], own[k], low - starts[k], high - starts[k], place - starts[k])
                    for k, anchor, place, low, high in cells_of(part, at, s)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    shape = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in CELLS.split(", "))])
    source = docs.select(known(F.col(f"`{doc_id}`")), text_key(F.col(f"`{text}`")), F.col(f"`{text}`"))
    return source.mapInArrow(run, CELLS)


def known(doc_id) -> F.Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def with_bytes(docs: DataFrame, doc_id: str, text: str, cells: DataFrame, s: Settings) -> DataFrame:
    """``cells`` (own, doc, low, high, ...) with the bytes from their first start to the end of their last window."""
    wanted = cells.groupBy("own", "doc").agg(F.collect_list(F.struct("anchor", "cell", "n", "low", "high", "place")).alias("wanted"))
    texts = docs.select(known(F.col(f"`{doc_id}`")).alias("doc"), text_key(F.col(f"`{text}`")).alias("own"), F.col(f"`{text}`").cast("binary").alias("text"))
    found = texts.join(wanted.hint("merge"), ["own", "doc"]).select("own", "text", F.explode("wanted").alias("w"))
    found = found.select("own", "w.*", F.col("text").substr(F.col("w.low") + 1, F.col("w.high") - F.col("w.low") + s.length).alias("bytes"))
    return found.dropDuplicates(["cell"])


def sharded(cells: DataFrame, shards: int, s: Settings) -> DataFrame:
    """(own, low, high) runs of repeated starts among cells that occur once; other cells only lend their bytes."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [x.as_buffer() for x in table["bytes"].combine_chunks()]
        sizes = np.array([len(x) for x in blobs], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        t = np.ones(int(sizes.sum()) + len(sizes) + 1, np.int64)  # 1 stands between cells, 0 ends all
        room = np.zeros(len(t), np.int64)
        for at, size, blob in zip(begins.tolist(), sizes.tolist(), blobs):
            t[at : at + size] = np.frombuffer(blob, np.uint8).astype(np.int64) + 2
            room[at : at + size] = np.arange(size, 0, -1)
        t[-1] = 0
        before, shared = permuted_prefixes(t, suffix_array(t), room)
        hit = shared >= s.length
        hit[before[np.flatnonzero(hit)]] = True
        once = np.asarray(table["n"]) == 1
        own, low = table["own"].to_pylist(), table["low"].to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for k in np.flatnonzero(once).tolist():
            starts = np.flatnonzero(hit[begins[k] : begins[k] + sizes[k] - s.length + 1])
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                for x, y in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()):
                    out[0].append(own[k])
                    out[1].append(low[k] + x)
                    out[2].append(low[k] + y)
        return pa.table({"own": pa.array(out[0], pa.binary()), "low": pa.array(out[1], pa.int32()), "high": pa.array(out[2], pa.int32())})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    return cells.select("own", "n", "low", "bytes", shard).groupBy("shard").applyInArrow(run, "own binary, low int, high int")


def narrowed(cells: DataFrame, width: int, s: Settings) -> DataFrame:
    """Cells cut into runs of at most ``width`` starts, keyed by the bytes that the run's windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, n, low, high, place, anchor, raw in zip(*(batch.column(c).to_pylist() for c in ("own", "n", "low", "high", "place", "anchor", "bytes"))):
                # runs are cut where the distance to the anchor passes a multiple of the width, so equal windows fall in like runs
                first = (place - high) // width
                for k in range(first, (place - low) // width + 1):
                    x, y = max(low, place - (k + 1) * width + 1), min(high, place - k * width)
                    core_from, core_to = place - k * width, place - (k + 1) * width + 1 + s.length
                    core = raw[core_from - low : core_to - low]
                    part = raw[x - low : y - low + s.length]
                    key = int.from_bytes(digest(anchor.to_bytes(8, "little", signed=True) + core, k)[:8], "little", signed=True)
                    rows.append((key, digest(part, place - x), own, n, x, y, place, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 8, shape)], schema=shape)

    shape = pa.schema([("anchor", pa.int64()), ("cell", pa.binary()), ("own", pa.binary()), ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("place", pa.int32()), ("bytes", pa.binary())])
    return cells.mapInArrow(run, "anchor long, cell binary, own binary, n long, low int, high int, place int, bytes binary")


def repeated_starts(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """(own, low, high): runs of starts of repeated windows, by key of the text."""
    cells = emit(docs, doc_id, text, s)
    cells = written(cells, "cells")
    # tables of their own, so that Spark may split the join where one anchor has very many cells
    seen = written(cells.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"), "seen")
    cells = written(cells.join(seen, "anchor", "left_semi"), "repeated")

    one = F.struct("doc", "own", "low", "high", "place")
    folded = written(cells.groupBy("cell").agg(F.min("anchor").alias("anchor"), F.count("*").alias("n"), F.min(one).alias("one")), "folded")
    many = folded.filter("n > 1").select("cell")
    out = [cells.join(many, "cell", "left_semi").select("own", "low", "high")]

    differ = written(folded.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor"), "differ")
    wanted = folded.join(differ, "anchor", "left_semi").select("anchor", "cell", "n", "one.*")
    open_cells = written(with_bytes(docs, doc_id, text, wanted, s), "open")
    for width in (*s.narrower, 0):
        weight = open_cells.groupBy("anchor").agg(F.sum(F.octet_length("bytes")).alias("size"))
        hot = weight.filter(F.col("size") > s.hot_bytes).select("anchor")
        cool = open_cells.join(hot, "anchor", "left_anti")
        size = cool.agg(F.sum(F.octet_length("bytes"))).first()[0]
        if size:
            out.append(sharded(cool, max(1, -(-size // s.shard_bytes)), s))
        if not width or hot.isEmpty():
            break
        # a folded cell lends its bytes; only cells that occur once are still open
        parts = written(narrowed(open_cells.join(hot, "anchor", "left_semi"), width, s), "narrowed")
        one = F.struct("own", "low", "high", "place", "bytes")
        folded = parts.groupBy("cell").agg(F.min("anchor").alias("anchor"), F.sum("n").alias("n"), F.min(one).alias("one"))
        folded = written(folded, "folded")
        out.append(parts.filter("n = 1").join(folded.filter("n > 1").select("cell"), "cell", "left_semi").select("own", "low", "high"))
        differ = folded.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("anchor")
        open_cells = written(folded.join(differ, "anchor", "left_semi").select("anchor", "cell", "n", "one.*"), "open")
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def covered(docs: DataFrame, doc_id: str, text: str, s: Settings) -> DataFrame:
    """The rows of ``docs`` with ``runs``: the starts of their repeated windows, null if there are none."""
    starts = repeated_starts(docs, doc_id, text, s)
    runs = written(starts.distinct().groupBy("own").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("__runs")), "runs")
    keyed = docs.withColumn("__own", text_key(F.col(f"`{text}`")))
    return keyed.join(runs.withColumnRenamed("own", "__own").hint("merge"), "__own", "left").drop("__own")


def removed_spans(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [from, to) of sorted runs of window starts."""
    out: list[tuple[int, int]] = []
    for r in runs or ():
        a, b = r["low"], r["high"] + length
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed runs [from, to) and the remaining bytes of every row."""
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [x or b"" for x in batch.column(1).to_pylist()]
            spans = [removed_spans(r, s.length) for r in batch.column(2).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in raws], pa.int64()),
                pa.array([[{"from": a, "to": b} for a, b in x] for x in spans], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                pa.array([kept_bytes(x, y) for x, y in zip(raws, spans)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = covered(source, "doc_id", "text", s).select("doc_id", F.col("text").cast("binary"), "__runs")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")


def cut_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """What remains as text: a character goes only if all its bytes do."""
    whole = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b))
    return kept_bytes(raw, whole).decode()


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with repeated strings cut from the text; all rows and columns stay, a null text stays null."""
    s = settings
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for x, r in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                spans = removed_spans(r, s.length)
                new.append(cut_text(x.encode(), spans) if spans else x)
            arrays = list(batch.columns[:-1])
            arrays[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names[:-1])

    return covered(docs, doc_id, text, s).select(*[F.col(f"`{c}`") for c in docs.columns], "__runs").mapInArrow(run, docs.schema)

"""Bootstrap intervals.

``poisson`` gives every row an independent Poisson(1) weight per replicate.
``exact`` draws n_y rows with replacement inside each outcome class. Both start
from the same Poisson weights, which any task can compute from a row's key:
given their sum T they are T draws with replacement, so adding n_y - T draws, or
taking T - n_y of the drawn ones back at random, gives exactly n_y draws. Only
those changes, about sqrt(n_y) a class and replicate, are rows of their own;
no table has a row for each row and replicate.

Replicate metrics never build one sorted table per replicate. Rows are cut into
score blocks once; a block holds its rows times all replicates as one matrix and
returns a few sums per replicate.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.functions.columns import EPS
from veritally.functions.hashing import PRIME, key_hash, key_residues, polynomial, replicate_coefficients
from veritally.operators.bounded import bounded, shuffle_partitions, stored
from veritally.operators.discrimination import METRICS, ladder_metrics
from veritally.operators.ladder import add_bucket, balanced_edges, score_cells, score_ladder
from veritally.operators.row_index import stratified_index

# Rows x replicates handled at a time, rows per score block, and most blocks.
MATRIX_CELLS = 2_000_000
TILE_CELLS = 32_768  # drawn at a time, so that the steps of a draw stay in a core's cache
COMMON_CUTS = 8  # counts up to this are compared everywhere; one draw in a million has more
EVENT_ROWS = 64  # rows that running sums are taken over by one small product
BLOCK_ROWS = 20_000
MAX_BLOCKS = 65_536


# --- draws -----------------------------------------------------------------------


def poisson_cuts(mean: float = 1.0, bits: int = 31) -> list[float]:
    """Cumulative Poisson probabilities up to the resolution of the draws."""
    cuts, total, term, k = [], 0.0, math.exp(-mean), 0
    while 1.0 - total > 2.0**-bits and k < 40:
        total += term
        cuts.append(total)
        k += 1
        term *= mean / k
    return cuts


def _positions(rows: DataFrame, stratum: str, row_id: str, seed: int, stratified: bool) -> DataFrame:
    group = F.col(stratum) if stratified else F.lit(0)
    return stored(stratified_index(rows.select(row_id, group.alias("_s")), ["_s"], row_id, seed, "boot-index"))


class _Poisson:
    """Poisson(1) counts of rows, from their residues."""

    def __init__(self, n_resamples: int, seed: int):
        self.n = n_resamples
        self.c = self.table(n_resamples, seed, "poisson")
        self.cuts = _whole_cuts(poisson_cuts())

    @staticmethod
    def table(n: int, seed: int, purpose: str) -> dict[str, np.ndarray]:
        rows = replicate_coefficients(seed, purpose, n)
        return {k: np.array([r[k] for r in rows], dtype="int64") for k in rows[0] if k != "rep"} if rows else {}

    def counts(self, h1: np.ndarray, h2: np.ndarray, low: int, high: int) -> np.ndarray:
        """Rows x replicates low + 1 to high."""
        cuts, common = self.cuts, COMMON_CUTS
        out = np.empty((len(h1), high - low), "uint8")
        for start, end, x in _value_tiles(h1, h2, {k: v[low:high] for k, v in self.c.items()}):
            part = out[start:end]
            np.greater_equal(x, cuts[0], out=part.view("bool"))
            for cut in cuts[1:common]:
                part += (x >= cut).view("uint8")
            if x.max(initial=0) >= cuts[common]:
                rare = np.flatnonzero(x >= cuts[common])
                part.reshape(-1)[rare] = np.searchsorted(cuts, x.reshape(-1)[rare], side="right")
        return out


def _whole_cuts(cuts: list[float]) -> np.ndarray:
    """For each probability the smallest v with v / PRIME >= it, by the same division that SQL does."""
    found = []
    for cut in cuts:
        v = max(0, math.floor(cut * PRIME) - 2)
        while v / float(PRIME) < cut:
            v += 1
        found.append(v)
    return np.array(found, "int32")


LIMB = 15  # residues are cut here, so that products and their sums are whole numbers that doubles hold exactly
PER_PRIME = (1.0 + 2.0**-51) / PRIME  # a little more than the quotient, so that multiples of the prime aren't rounded down


def _value_tiles(h1: np.ndarray, h2: np.ndarray, c: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end, ``polynomial`` of those rows x all coefficients) for small runs of rows.

    The polynomial is a product of (h1, h1^2, h2, 1) and the coefficients. With the former in limbs of 15 and 16 bits
    and the shift of the upper ones put into the coefficients, a sum stays below 2^50: one matrix product of doubles is
    exact. Its quotient by the prime is below 2^19, and a remainder is 2^-31 of the prime at least, so rounding can't
    reach the next whole quotient.
    """
    terms = (h1, h1 * h1 % PRIME, h2)
    by = [c[k].astype("int64") for k in ("a1", "a2", "a3")]
    rows = np.stack([*(x >> LIMB for x in terms), *(x & (2**LIMB - 1) for x in terms), np.ones_like(h1)], axis=1).astype("float64")
    columns = np.stack([*((a << LIMB) % PRIME for a in by), *by, c["a0"]]).astype("float64")
    width = columns.shape[1]
    step = max(1, TILE_CELLS // max(1, width))
    first, second = (np.empty((step, width)) for _ in range(2))
    whole = np.empty((step, width), "int32")
    for start in range(0, len(h1), step):
        end = min(len(h1), start + step)
        x, y, found = first[: end - start], second[: end - start], whole[: end - start]
        np.matmul(rows[start:end], columns, out=x)
        np.multiply(x, PER_PRIME, out=y)
        np.floor(y, out=y)
        y *= float(PRIME)
        x -= y
        found[:] = x
        yield start, end, found  # overwritten by the next run


COPY = 1_000_003  # residues of a row's second, third ... draw lie so far from those of the one before


def _removed_key(h1: np.ndarray, h2: np.ndarray, copy: int, c: dict) -> np.ndarray:
    """What orders the draws of a class and replicate when some are taken back."""
    return polynomial((h1 + copy * COPY) % PRIME, h2, c)


DENSE_COPIES = 3  # draws of a row whose keys are made for all rows; later draws are rare


def _taken_back(draws: _Poisson, ball: dict, h1: np.ndarray, h2: np.ndarray, reps: np.ndarray, limit: np.ndarray) -> Iterator[tuple]:
    """(copy, rows, replicates, keys) of the draws whose key is below the limit of their replicate.

    Few keys are, so those are found first and only then is it looked up whether such a draw was made.
    """
    for copy in range(1, DENSE_COPIES + 1):
        found = []
        for start, _, x in _value_tiles((h1 + copy * COPY) % PRIME, h2, {k: v[reps] for k, v in ball.items()}):
            at, j = np.divmod(np.flatnonzero(x < limit), len(reps))
            if len(at):
                drawn = polynomial(h1[at + start], h2[at + start], {k: v[reps[j]] for k, v in draws.c.items()})
                made = np.searchsorted(draws.cuts, drawn, side="right") >= copy
                found.append((at[made] + start, reps[j[made]], x[at[made], j[made]].astype("int64")))
        if found:
            yield copy, *(np.concatenate(c) for c in zip(*found))
    often, j = [], []
    for start, _, x in _value_tiles(h1, h2, {k: v[reps] for k, v in draws.c.items()}):
        at, k = np.divmod(np.flatnonzero(x >= draws.cuts[DENSE_COPIES]), len(reps))
        often.append(at + start)
        j.append(k)
    often, j = np.concatenate(often), np.concatenate(j)
    rep = reps[j]
    times = np.searchsorted(draws.cuts, polynomial(h1[often], h2[often], {k: v[rep] for k, v in draws.c.items()}), side="right")
    for copy in range(DENSE_COPIES + 1, int(times.max(initial=0)) + 1):
        more = np.flatnonzero(times >= copy)
        key = _removed_key(h1[often[more]], h2[often[more]], copy, {k: v[rep[more]] for k, v in ball.items()})
        hit = key < limit[j[more]]
        yield copy, often[more][hit], rep[more][hit], key[hit]


def _pandas(rows: DataFrame, schema: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    return rows.mapInPandas(run, schema)


def _changes(positions: DataFrame, row_id: str, n_resamples: int, seed: int) -> DataFrame:
    """row_id, rep: the signed replicates in which a row is drawn once more (+) or once less (-) than its Poisson count.

    ``positions`` are row_id, _s, idx, stratum_n, h1, h2. There are few strata: outcome classes, or one.
    """
    draws = _Poisson(n_resamples, seed)
    kind = dict(positions.dtypes)
    # few bytes but much work: as with blocks, an explicit count keeps the rows apart
    spread = stored(positions.select("_s", row_id, "h1", "h2").repartition(2 * shuffle_partitions(positions), row_id))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for rows in batches:
            for stratum, part in rows.groupby("_s", dropna=False):
                own = total.setdefault(stratum, np.zeros(n_resamples, "int64"))
                step = max(1, MATRIX_CELLS // len(part))
                for low in range(0, n_resamples, step):
                    high = min(n_resamples, low + step)
                    counts = draws.counts(part["h1"].to_numpy(), part["h2"].to_numpy(), low, high).astype("float32")
                    own[low:high] += (np.ones(len(part), "float32") @ counts).astype("int64")  # far below 2^24 each
        for stratum, own in total.items():
            yield pd.DataFrame({"_s": stratum, "rep": np.arange(1, n_resamples + 1, dtype="int32"), "drawn": own})

    drawn = _pandas(spread.select("_s", "h1", "h2"), f"_s {kind['_s']}, rep int, drawn bigint", sums)
    drawn = drawn.groupBy("_s", "rep").agg(F.sum("drawn").alias("drawn"))
    sizes = positions.groupBy("_s").agg(F.max("stratum_n").alias("n"))
    lacking = stored(drawn.join(sizes, "_s").select("_s", "rep", "drawn", "n", (F.col("n") - F.col("drawn")).alias("lack")))

    number = F.explode(F.sequence(F.lit(1), F.col("lack").cast("int"))).alias("d")
    more = lacking.where("lack > 0").repartition(shuffle_partitions(positions), "_s", "rep").select("_s", "rep", "n", number)
    more = more.select("_s", (key_hash(seed, "boot-add", "_s", "rep", "d") % F.col("n") + 1).alias("idx"), "rep")
    # ``more`` comes of a small file but is large: its estimated size must not make it a broadcast through the driver
    added = more.hint("merge").join(positions.select("_s", "idx", row_id), ["_s", "idx"]).select(row_id, "rep")

    less = lacking.where("lack < 0").collect()  # at most one row a class and replicate
    ball = _Poisson.table(n_resamples, seed, "boot-ball")
    widen = 1.0
    while less:
        limits: dict = {}
        for r in less:
            k = -r["lack"]
            reach = min(1.0, widen * (k + 8 * math.sqrt(k) + 20) / r["drawn"])
            limits.setdefault(r["_s"], np.zeros(n_resamples, "int64"))[r["rep"] - 1] = math.ceil(reach * PRIME)

        def near(batches: Iterator[pd.DataFrame], limits=limits) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for stratum, part in rows.groupby("_s", dropna=False):
                    if stratum not in limits:
                        continue
                    limit = limits[stratum]
                    reps = np.flatnonzero(limit)
                    limit = np.minimum(limit, PRIME).astype("int32")
                    ids, h1, h2 = (part[c].to_numpy() for c in (row_id, "h1", "h2"))
                    step = max(1, MATRIX_CELLS // len(part))
                    for low in range(0, len(reps), step):
                        own = reps[low : low + step]
                        for copy, at, rep, key in _taken_back(draws, ball, h1, h2, own, limit[own]):
                            if len(at):
                                yield pd.DataFrame({"_s": stratum, row_id: ids[at], "rep": (rep + 1).astype("int32"), "key": key, "copy": np.int32(copy)})

        schema = f"_s {kind['_s']}, `{row_id}` {kind[row_id]}, rep int, key bigint, copy int"
        found = stored(_pandas(spread.select("_s", row_id, "h1", "h2"), schema, near))
        counts = found.groupBy("_s", "rep").agg(F.count(F.lit(1)).alias("found"))
        short = lacking.where("lack < 0").join(counts, ["_s", "rep"], "left").where(F.coalesce("found", F.lit(0)) < -F.col("lack"))
        if short.isEmpty():
            # a class and replicate has about sqrt(n) of these
            order = Window.partitionBy("_s", "rep").orderBy("key", row_id, "copy")
            first = found.withColumn("_r", F.row_number().over(order)).join(lacking.where("lack < 0"), ["_s", "rep"]).where(F.col("_r") <= -F.col("lack"))
            return added.unionByName(first.select(row_id, (-F.col("rep")).alias("rep")))
        widen *= 4
    return added


def _positioned(rows: DataFrame, stratum: str, row_id: str, seed: int, stratified: bool) -> DataFrame:
    h1, h2 = key_residues(seed, "poisson", row_id)
    return stored(_positions(rows, stratum, row_id, seed, stratified).withColumns({"h1": h1, "h2": h2}))


def _listed(positions: DataFrame, row_id: str, n_resamples: int, seed: int) -> DataFrame:
    """row_id, fix: the changes of each row that has any, as a comma list."""
    changes = _changes(positions, row_id, n_resamples, seed)
    return stored(changes.groupBy(row_id).agg(F.array_join(F.collect_list("rep").cast("array<string>"), ",").alias("fix")))


def bootstrap_draws(
    rows: DataFrame, stratum: str, row_id: str, n_resamples: int, seed: int = 42, stratified: bool = True, mode: str = "exact"
) -> DataFrame:
    """row_id, rep, times: how often each row is drawn in each replicate (drawn rows only), made where the row lies."""
    if mode == "poisson":
        h1, h2 = key_residues(seed, "poisson", row_id)
        drawn = rows.select(row_id, h1.alias("h1"), h2.alias("h2"), F.lit(None).cast("string").alias("fix"))
    else:
        positions = _positioned(rows, stratum, row_id, seed, stratified)
        drawn = positions.select(row_id, "h1", "h2").join(_listed(positions, row_id, n_resamples, seed), row_id, "left")
    weights = _Weights(n_resamples, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for reps, matrix in weights.chunks(part):
                at, j = np.nonzero(matrix)
                yield pd.DataFrame({row_id: part[row_id].to_numpy()[at], "rep": (reps[j] + 1).astype("int32"), "times": matrix[at, j].astype("int64")})

    return _pandas(drawn, f"`{row_id}` {dict(rows.dtypes)[row_id]}, rep int, times bigint", run)


def cluster_draws(rows: DataFrame, entity: str, n_resamples: int, seed: int = 42) -> DataFrame:
    """entity, rep, times: resampling of whole entities, for tables with repeated records."""
    entities = rows.select(entity).distinct()
    return bootstrap_draws(entities, entity, entity, n_resamples, seed, stratified=False)


def _with_draws(
    scored: DataFrame, row_id: str, n_resamples: int, seed: int, mode: str, stratified: bool, stratum: str
) -> DataFrame:
    """Scored rows with what their weights follow from: ``h1, h2`` and ``fix``, the changes that make draws exact.

    All models of a row share its draws, so differences between models are paired.
    """
    if mode in ("poisson", "whole"):
        h1, h2 = key_residues(seed, "poisson", row_id)
        return scored.withColumns({"h1": h1, "h2": h2, "fix": F.lit(None).cast("string")})
    if mode != "exact":
        raise ValueError(f"unknown bootstrap mode {mode!r}")
    drawn = [row_id, stratum] if stratified else [row_id]
    rows = stored(scored.select(*drawn).distinct().withColumn("_s", F.col(stratum) if stratified else F.lit(0)))
    positions = _positioned(rows, "_s", row_id, seed, True)
    h1, h2 = key_residues(seed, "poisson", row_id)
    return scored.withColumns({"h1": h1, "h2": h2}).join(_listed(positions, row_id, n_resamples, seed), row_id, "left")


# --- replicate sums over score blocks ------------------------------------------------


class _Weights:
    """Weight matrices (rows x some replicates) from the draw columns of rows."""

    def __init__(self, n_resamples: int, seed: int):
        self.n, self.draws = n_resamples, _Poisson(n_resamples, seed)

    def chunks(self, rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(replicate numbers, matrix) pairs that stay below the cell limit."""
        step = max(1, MATRIX_CELLS // max(1, len(rows)))
        h1, h2 = (rows[c].fillna(0).to_numpy("int64") for c in ("h1", "h2"))
        changed = np.flatnonzero(rows["fix"].notna().to_numpy())
        lists = rows["fix"].iloc[changed]
        at = np.repeat(changed, lists.str.count(",").to_numpy("int64") + 1) if len(changed) else changed
        reps = np.array(",".join(lists).split(","), dtype="int64") if len(changed) else np.zeros(0, "int64")
        place = np.abs(reps) - 1
        for low in range(0, self.n, step):
            high = min(self.n, low + step)
            matrix = self.draws.counts(h1, h2, low, high).astype("float64")
            own = np.flatnonzero((place >= low) & (place < high))
            np.add.at(matrix, (at[own], place[own] - low), np.sign(reps[own]).astype("float64"))
            yield np.arange(low, high), matrix


class _Whole:
    """One replicate: the rows themselves."""

    n = 1

    def chunks(self, rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.zeros(1, dtype="int64"), np.ones((len(rows), 1))


@dataclass(frozen=True)
class BlockMetric:
    """A metric of one's own, as sums over score cells for all replicates at once, in any mode.

    A function of ``terms`` takes (p, pos, neg): the distinct scores of a block, and the weights of positives and
    negatives at each (row) in each replicate (column). It returns one partial sum per replicate. Functions of
    ``ranked`` take (p, pos, neg, pos_above, neg_above), the last two being the weights at higher scores, in all blocks.
    ``value`` makes the metric of the summed terms, as columns by name.
    """

    value: Callable[[dict[str, Column]], Column]
    terms: dict[str, Callable[..., np.ndarray]] = field(default_factory=dict)
    ranked: dict[str, Callable[..., np.ndarray]] = field(default_factory=dict)


def _block_rows(block: pd.DataFrame, weights: _Weights) -> tuple[np.ndarray, np.ndarray, Iterator[tuple]]:
    """Scores in order, outcomes, and (replicates, weight per row and replicate) in turn.

    A score that was folded before is two rows, its positives and its negatives.
    """
    block = block.sort_values("p", kind="stable")
    folded = block["pos"].notna().to_numpy()
    plain, ready = block[~folded], block[folded]
    p = np.r_[plain["p"].to_numpy("float64"), np.repeat(ready["p"].to_numpy("float64"), 2)]
    y = np.r_[plain["y"].fillna(0).to_numpy("float64"), np.tile([1.0, 0.0], len(ready))]
    order = np.argsort(p, kind="stable")
    parts = [np.frombuffer(v) for pair in zip(ready["pos"], ready["neg"]) for v in pair]

    def drawn() -> Iterator[tuple]:
        for reps, w in weights.chunks(plain):
            if parts:
                w = np.concatenate([w, np.stack([v[reps] for v in parts])])[order]
            yield reps, w

    return p[order], y[order], drawn()


def _cells(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores, positive and negative weights per score and replicate."""
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    pos = w * y[:, None]
    neg = w - pos
    if len(starts) < len(p):
        pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
    return p[starts], pos, neg


def _block_cells(block: pd.DataFrame, weights: _Weights) -> Iterator[tuple]:
    """(replicates, distinct scores, positive and negative weights per score and replicate)."""
    p, y, drawn = _block_rows(block, weights)
    for reps, w in drawn:
        yield reps, *_cells(p, y, w)


class _Events:
    """What lies below each event (row with outcome 1) of a block: only events need running sums, and they are few."""

    def __init__(self, p: np.ndarray, y: np.ndarray):
        self.at = np.flatnonzero(y)
        n = len(p)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        cell = np.searchsorted(starts, self.at, side="right") - 1
        first, end = starts[cell], np.r_[starts[1:], n][cell]
        self.edges = np.unique(np.r_[0, first, end[(end - first > 1) & (end < n)]])
        self.first = np.searchsorted(self.edges, first)
        # a score of one row holds no other outcome; a score that ends the block has all others below its end
        self.end = np.where(end - first == 1, self.first, np.where(end == n, len(self.edges), np.searchsorted(self.edges, end)))
        self.fewer = np.searchsorted(self.at, first)
        # sums up to an edge are products within a run of rows, and what earlier runs hold
        self.runs = []
        for start in range(0, n, EVENT_ROWS):
            other = 1.0 - y[start : start + EVENT_ROWS]
            low, high = np.searchsorted(self.edges, (start, min(n, start + EVENT_ROWS)))
            before = np.arange(len(other)) < np.r_[self.edges[low:high] - start, len(other)][:, None]
            self.runs.append((start, low, high, before * other))

    def split(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Weights of events; weights of other rows below each event's score, up to it, and in all."""
        upto = np.empty((len(self.edges) + 1, w.shape[1]))
        carried = np.zeros(w.shape[1])
        for start, low, high, sides in self.runs:
            found = sides @ w[start : start + EVENT_ROWS]
            np.add(found[:-1], carried, out=upto[low:high])
            carried = carried + found[-1]
        upto[-1] = carried
        return w[self.at], upto[self.first], upto[self.end], carried

    def lower(self, events: np.ndarray) -> np.ndarray:
        """Weights of events at lower scores than each event's."""
        upto = np.zeros((len(events) + 1, events.shape[1]))
        np.cumsum(events, axis=0, out=upto[1:])
        return upto[self.fewer]


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields)


def _blocks(
    scored: DataFrame, keys: list[str], row_id: str, n_resamples: int, seed: int, mode: str, stratified: bool, stratum: str,
    block_rows: int, weights: _Weights, unit: str | None,
) -> DataFrame:
    """Scored rows with what their weights follow from, in score blocks of about ``block_rows`` rows.

    Scores that many rows share are folded in salted parts first: ``pos`` and ``neg`` are their sums per replicate.
    """
    kinds = _ddl(scored, keys)
    draw = ["h1", "h2", "fix"]
    rows = _with_draws(
        scored.withColumns({"p": F.col("p").cast("double"), "y": F.col("y").cast("int")}),
        unit or row_id, n_resamples, seed, mode, stratified and not unit, stratum,
    ).select(*keys, row_id, "p", "y", *draw)

    cells = stored(score_cells(scored, keys).select(*keys, "p", (F.col("pos") + F.col("neg")).alias("_rows")))
    crowded = cells.where(F.col("_rows") > block_rows).withColumn("_parts", F.ceil(F.col("_rows") / block_rows))
    # Blocks are balanced by rows, not by distinct scores: half-crowded scores add up.
    total = cells.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    edges = balanced_edges(scored.select(F.col("p").cast("double").alias("p")), "p", min(MAX_BLOCKS, math.ceil(total / block_rows)))
    crowded = bounded(crowded.drop("_rows"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        found = list(_block_cells(part.assign(pos=None, neg=None), weights))
        pos, neg = (np.concatenate([c[i][0] for c in found]) for i in (2, 3))
        return part[keys].iloc[:1].assign(p=part["p"].iloc[0], pos=[pos.tobytes()], neg=[neg.tobytes()])

    none = F.lit(None).cast("binary")
    if crowded.isEmpty():
        cold = rows.drop(row_id).withColumns({"pos": none, "neg": none})
    else:
        rows = stored(rows)
        parts = (
            rows.join(crowded, [*keys, "p"])
            .withColumn("_part", F.pmod(F.xxhash64(row_id), F.col("_parts")))
            .drop("_parts", row_id)
            .groupBy(*keys, "p", "_part")
            .applyInPandas(fold, f"{kinds}, p double, pos binary, neg binary")
        )
        plain = rows.join(crowded, [*keys, "p"], "left_anti").drop(row_id)
        blank = [F.lit(None).cast(t).alias(c) for c, t in plain.select("y", *draw).dtypes]
        cold = plain.withColumns({"pos": none, "neg": none}).unionByName(parts.select(*keys, "p", *blank, "pos", "neg"))
    return _apart(add_bucket(cold, "p", edges, "block"), keys)


def _apart(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks are few bytes but much work: an explicit count keeps them from being merged into a task a core.

    A table that was stored has lost it and needs it again.
    """
    return blocks.repartition(2 * shuffle_partitions(blocks), *keys, "block")


def replicate_metrics(
    scored: DataFrame,
    keys: list[str],
    row_id: str,
    metrics: list[str],
    n_resamples: int,
    seed: int = 42,
    mode: str = "exact",
    stratified: bool = True,
    stratum: str = "y",
    block_rows: int = BLOCK_ROWS,
    own: dict[str, BlockMetric] | None = None,
    unit: str | None = None,
) -> DataFrame:
    """keys, rep and one column per metric, built-in ones by name and ``own`` ones.

    With ``unit`` whole units are drawn: all rows of an entity share its weights, in whatever block they lie.

    Scores that many rows share are folded in salted parts first, so a block
    stays small whatever the distribution of scores.
    """
    own = own or {}
    weights = _Whole() if mode == "whole" else _Weights(n_resamples, seed)
    kinds = _ddl(scored, keys)
    terms = {f"_t{i}_{j}": f for i, m in enumerate(own.values()) for j, f in enumerate(m.terms.values())}
    ranked = {f"_r{i}_{j}": f for i, m in enumerate(own.values()) for j, f in enumerate(m.ranked.values())}
    gain = ["_gain"] if "auprc" in metrics else []
    won = ["_won"] if gain and "auroc" in metrics else []  # then the second look at the blocks, which needs the same sums, counts both
    blocks = _blocks(scored, keys, row_id, n_resamples, seed, mode, stratified, stratum, block_rows, weights, unit)
    if ranked or gain:
        blocks = _apart(stored(blocks), keys)

    def sums(block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        p, y, drawn = _block_rows(block, weights)
        q = np.clip(p, EPS, 1 - EPS)
        loss = -np.where(y == 1, np.log(q), np.log(1 - q))
        linear = np.stack([y, 1 - y, loss, np.where(y == 1, (1 - p) ** 2, p**2), p])
        events = _Events(p, y) if "auroc" in metrics and not won else None
        for reps, w in drawn:
            pos, neg, loss, square, total = linear @ w
            found = {"rep": (reps + 1).astype("int32"), "pos": pos, "neg": neg, "loss": loss, "square": square, "total": total}
            if terms:
                cells = _cells(p, y, w)
                found |= {c: f(*cells) for c, f in terms.items()}
            found["won"] = 0.0
            if events is not None:
                own, below, upto, _ = events.split(w)
                below += upto
                found["won"] = np.einsum("ij,ij->j", own, below) / 2
            parts.append(pd.DataFrame(found))
        return block[[*keys, "block"]].iloc[:1].merge(pd.concat(parts), how="cross")

    names = ("pos", "neg", "won", "loss", "square", "total", *terms)
    schema = f"{kinds}, block double, rep int, " + ", ".join(f"{c} double" for c in names)
    per_block = blocks.groupBy(*keys, "block").applyInPandas(sums, schema)
    group = [*keys, "rep"]
    after = Window.partitionBy(*group).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_block.withColumn("_neg_below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    if ranked or gain:
        placed = stored(
            placed.withColumns(
                {
                    "_tp": F.coalesce(F.sum("pos").over(after), F.lit(0.0)),
                    "_fp": F.coalesce(F.sum("neg").over(after), F.lit(0.0)),
                }
            )
        )
    size = F.sum("pos") + F.sum("neg")
    pi = F.sum("pos") / size
    formulas = {
        "auroc": F.sum(F.col("won") + F.col("pos") * F.col("_neg_below")),
        "auprc_baseline": pi,
        "log_loss": F.sum("loss") / size,
        "brier": F.sum("square") / size,
        "brier_scaled": 1 - F.try_divide(F.sum("square") / size, pi * (1 - pi)),
        "mean_predicted_risk": F.sum("total") / size,
    }
    table = placed.groupBy(*group).agg(
        *[formulas[m].alias(m) for m in metrics if m != "auprc"],
        F.sum("pos").alias("_pos_total"),
        F.sum("neg").alias("_neg_total"),
        *[F.sum(c).alias(c) for c in terms],
    )
    if ranked or gain:
        ahead = placed.groupBy(*keys, "block").agg(
            F.array_sort(F.collect_list(F.struct("rep", "_tp", "_fp"))).alias("ahead")
        ).select(*keys, "block", F.col("ahead._tp").alias("tp"), F.col("ahead._fp").alias("fp"))

        def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({c: [] for c in [*keys, "rep", *gain, *won, *ranked]})
            above_tp, above_fp = (np.asarray(right[c].iloc[0]) for c in ("tp", "fp"))
            parts = []
            p, y, drawn = _block_rows(left, weights)
            events = _Events(p, y)
            for reps, w in drawn:
                found = {"rep": (reps + 1).astype("int32")}
                if ranked:
                    cells = _cells(p, y, w)
                    higher = [np.cumsum(x[::-1], axis=0)[::-1] - x + above[reps] for x, above in zip(cells[1:], (above_tp, above_fp))]
                    found |= {c: f(*cells, *higher) for c, f in ranked.items()}
                if gain:
                    own, below, upto, others = events.split(w)
                    if won:
                        found["_won"] = np.einsum("ij,ij->j", own, below + upto) / 2
                    tp = above_tp[reps] + own.sum(0) - events.lower(own)
                    flagged = above_fp[reps] + others - below + tp
                    found["_gain"] = np.divide(own * tp, flagged, out=np.zeros_like(tp), where=flagged > 0).sum(0)
                parts.append(pd.DataFrame(found))
            return left[keys].iloc[:1].merge(pd.concat(parts), how="cross")

        more = (
            blocks.groupBy(*keys, "block")
            .cogroup(_apart(ahead, keys).groupBy(*keys, "block"))
            .applyInPandas(second, f"{kinds}, rep int, " + ", ".join(f"{c} double" for c in [*gain, *won, *ranked]))
        )
        table = table.join(more.groupBy(*group).agg(*[F.sum(c).alias(c) for c in [*gain, *won, *ranked]]), group)
    if "auroc" in metrics:
        pairs = F.col("auroc") + F.col("_won") if won else F.col("auroc")
        table = table.withColumn("auroc", F.try_divide(pairs, F.col("_pos_total") * F.col("_neg_total")))
    if "auprc" in metrics:
        table = table.withColumn("auprc", F.try_divide(F.col("_gain"), F.col("_pos_total")))
    for i, (name, m) in enumerate(own.items()):
        named = {t: F.col(f"_t{i}_{j}") for j, t in enumerate(m.terms)} | {t: F.col(f"_r{i}_{j}") for j, t in enumerate(m.ranked)}
        table = table.withColumn(name, m.value(named))
    return table.select(*group, *metrics, *own)


def replicate_ladder(
    scored: DataFrame, keys: list[str], row_id: str, n_resamples: int, seed: int = 42, stratified: bool = True, unit: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """keys, rep and the ladder columns: the score ladder of every replicate, made block by block where the rows lie.

    Drawn rows are never shuffled: a block is told what lies below it in each replicate and streams its ladder rows,
    so an aggregation by (keys, rep) folds them before anything moves.
    """
    weights = _Weights(n_resamples, seed)
    kinds = _ddl(scored, keys)
    known = scored.where(F.col("y").isNotNull())
    blocks = _apart(stored(_blocks(known, keys, row_id, n_resamples, seed, "exact", stratified, "y", block_rows, weights, unit)), keys)

    def totals(block: pd.DataFrame) -> pd.DataFrame:
        _, y, drawn = _block_rows(block, weights)
        sides = np.stack([y, 1 - y])
        parts = [pd.DataFrame(dict(zip(("rep", "pos", "neg"), ((reps + 1).astype("int32"), *np.rint(sides @ w).astype("int64"))))) for reps, w in drawn]
        return block[[*keys, "block"]].iloc[:1].merge(pd.concat(parts), how="cross")

    sizes = blocks.groupBy(*keys, "block").applyInPandas(totals, f"{kinds}, block double, rep int, pos long, neg long")
    before = Window.partitionBy(*keys, "rep").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "rep")
    carried = {f"{c}_below": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("pos", "neg")}
    carried |= {f"{c}_total": F.sum(c).over(whole) for c in ("pos", "neg")}
    around = list(carried)
    heads = (
        sizes.withColumns(carried)
        .groupBy(*keys, "block")
        .agg(F.array_sort(F.collect_list(F.struct("rep", *around))).alias("_head"))
        .select(*keys, "block", *[F.col(f"_head.{c}").alias(c) for c in around])
    )
    columns = ("p", "pos", "neg", *around)

    def rungs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = pd.concat(list(batches))
        head = block[block["pos_total"].notna()].iloc[0]
        offset = {c: np.asarray(head[c]) for c in around}
        for reps, p, pos, neg in _block_cells(block[block["pos_total"].isna()], weights):
            pos, neg = (np.rint(x).astype("int64") for x in (pos, neg))
            j, at = np.nonzero((pos + neg).T)  # cells no row of which was drawn are no rungs
            found = {"p": p[at], "pos": pos[at, j], "neg": neg[at, j]}
            for c, x in (("pos_below", pos), ("neg_below", neg)):
                found[c] = (np.cumsum(x, axis=0) - x)[at, j] + offset[c][reps[j]]
            found |= {c: offset[c][reps[j]] for c in ("pos_total", "neg_total")}
            yield pd.DataFrame({**{k: [head[k]] * len(at) for k in keys}, "rep": (reps[j] + 1).astype("int32"), **found})

    return (
        _apart(blocks.unionByName(heads, allowMissingColumns=True), keys)
        .groupBy(*keys, "block")
        .applyInPandas(rungs, f"{kinds}, rep int, p double, " + ", ".join(f"{c} long" for c in columns[1:]))
    )


def own_points(scored: DataFrame, keys: list[str], row_id: str, metrics: dict[str, BlockMetric]) -> DataFrame:
    """keys, metric, value of one's own metrics on the table itself: one replicate in which every row counts once."""
    table = replicate_metrics(scored, keys, row_id, [], 1, mode="whole", own=metrics)
    return long_metrics(table, keys, list(metrics))


# --- intervals -------------------------------------------------------------------------


def long_metrics(table: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return table.select(*keys, F.inline(F.array(*pairs)))


def interval(replicates: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval, SE and count of the replicate values (``value``) per key group.

    A group holds one value per replicate, so its quantiles are taken directly.
    """
    bounds = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return replicates.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(
        bounds[0].alias("ci_low"),
        bounds[1].alias("ci_high"),
        F.stddev_samp("value").alias("se"),
        F.count(F.lit(1)).alias("n_resamples"),
    )


def _custom_metrics(ladder: DataFrame, keys: list[str], metrics: dict[str, Callable[[], Column]]) -> DataFrame:
    table = ladder.groupBy(*keys).agg(*[make().alias(name) for name, make in metrics.items()])
    return long_metrics(table, keys, list(metrics))


def bootstrap_ci(
    scored: DataFrame,
    keys: list[str],
    row_id: str = "row_id",
    metrics: list[str] | dict[str, Callable[[], Column] | BlockMetric] | None = None,
    n_resamples: int = 2000,
    alpha: float = 0.05,
    seed: int = 42,
    mode: str = "exact",
    stratified: bool = True,
    unit: str | None = None,
) -> DataFrame:
    """keys, metric, estimate, ci_low, ci_high, se, n_resamples.

    ``unit`` names the column of the entity to draw where rows of an entity belong together; classes aren't kept then.

    ``metrics`` names built-in metrics, or maps names to ``BlockMetric`` or to functions that return an aggregate over
    ladder rows (see ``discrimination``). Functions are drawn in exact mode only and see the ladder of every replicate,
    row by row, so large tables want a ``BlockMetric``, which works in both modes.
    """
    metrics = metrics or ["auroc", "auprc", "brier"]
    if isinstance(metrics, dict):
        own = {k: m for k, m in metrics.items() if isinstance(m, BlockMetric)}
        free = {k: m for k, m in metrics.items() if k not in own}
        found = []
        if own:
            reps = replicate_metrics(scored, keys, row_id, [], n_resamples, seed, mode, stratified, own=own, unit=unit)
            found.append((own_points(scored, keys, row_id, own), long_metrics(reps, keys, list(own))))
        if free:
            if mode != "exact":
                raise ValueError("functions as metrics are drawn in exact mode only; a BlockMetric works in both")
            ladder = replicate_ladder(scored, keys, row_id, n_resamples, seed, stratified and not unit, unit)
            found.append((_custom_metrics(score_ladder(scored, keys), keys, free), _custom_metrics(ladder, [*keys, "rep"], free)))
        point, reps = (functools.reduce(DataFrame.unionByName, x) for x in zip(*[(p, r.select(*keys, "metric", "value")) for p, r in found]))
        bounds = interval(reps, [*keys, "metric"], alpha)
        return point.withColumnRenamed("value", "estimate").join(bounded(bounds), [*keys, "metric"], "left")
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    point = long_metrics(ladder_metrics(score_ladder(scored, keys), keys, metrics), keys, metrics)
    reps = replicate_metrics(scored, keys, row_id, metrics, n_resamples, seed, mode, stratified, unit=unit)
    bounds = interval(long_metrics(reps, keys, metrics), [*keys, "metric"], alpha)
    return point.withColumnRenamed("value", "estimate").join(bounded(bounds), [*keys, "metric"], "left")


def bootstrap_difference(
    scored: DataFrame,
    model_a: str,
    model_b: str,
    metric: str,
    row_id: str = "row_id",
    n_resamples: int = 2000,
    alpha: float = 0.05,
    seed: int = 42,
    mode: str = "exact",
) -> DataFrame:
    """One row: metric, difference, ci_low, ci_high, excludes_zero (paired on the row draws)."""
    pair = scored.where(F.col("model").isin(model_a, model_b))

    def gap(table: DataFrame, keys: list[str]) -> DataFrame:
        a = F.max(F.when(F.col("model") == model_a, F.col(metric)))
        b = F.max(F.when(F.col("model") == model_b, F.col(metric)))
        return table.groupBy(*keys).agg((a - b).alias("value"))

    point = gap(ladder_metrics(score_ladder(pair, ["model"]), ["model"], [metric]), [])
    reps = gap(replicate_metrics(pair, ["model"], row_id, [metric], n_resamples, seed, mode), ["rep"])
    bounds = interval(reps.withColumn("metric", F.lit(metric)), ["metric"], alpha)
    both = point.select(F.lit(metric).alias("metric"), F.col("value").alias("difference")).join(bounded(bounds), "metric")
    zero_out = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return both.select("metric", "difference", "ci_low", "ci_high", zero_out.alias("excludes_zero"))

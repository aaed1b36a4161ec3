"""Smoothers over the score ladder: the local line and the isotonic fit, for all key groups at once.

Both work on blocks: runs of ladder rows that hold about ``block_rows`` rows of
the table by rank, so no key group is handled in one task. What a block needs of
its group (at most a few hundred fit points, or the pools that reach into the
block) is joined to it by group and block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritally.operators.bounded import stored

BLOCK_ROWS = 65_536  # a task holds a block as a frame
MOMENTS = 12
MERGED = 64  # hulls of blocks that are merged at a time


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _blocked(ladder: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """keys, p, pos, w, below (rows below), pos_below, n (rows of the group), block."""
    below = F.col("pos_below") + F.col("neg_below")
    return stored(
        ladder.select(
            *keys, "p", "pos", (F.col("pos") + F.col("neg")).alias("w"), below.alias("below"), "pos_below",
            (F.col("pos_total") + F.col("neg_total")).alias("n"),
        ).withColumn("block", F.expr(f"below div {block_rows}"))
    )


def _at_blocks(of_group: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a small table per group, once for each block of the group."""
    blocks = cells.select(*[F.col(c).alias(c) for c in [*keys, "block"]]).distinct()
    return blocks.join(of_group, keys)


# --- local line ------------------------------------------------------------------------


def fit_points(cells: DataFrame, keys: list[str], points: int) -> DataFrame:
    """keys, at: scores at evenly spaced mid-ranks, or every score of a group that has no more than ``points``.

    A row's doubled mid-rank is a whole number, so its place on the grid of ranks is exact.
    """
    rank = 2 * F.col("below") + F.col("w")
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells"), F.min(rank).alias("_low"), F.max(rank).alias("_high"))
    grid = F.expr(f"((2 * below + w - _low) * {points - 1}) div greatest(_high - _low, 1)").cast("double")
    place = F.when(F.col("_cells") <= points, F.col("p")).otherwise(grid)
    return cells.join(sizes, keys).groupBy(*keys, place.alias("_place")).agg(F.min("p").alias("at")).drop("_place")


def window_widths(cells: DataFrame, keys: list[str], at: DataFrame, frac: float, block_rows: int) -> DataFrame:
    """keys, at, width: the distance from each fit point to its k-th nearest row, k being the share ``frac`` of all.

    The k nearest rows are k neighbours in rank: those of ranks [r, r + k) for the first r where the scores at both
    ends add up to twice the fit point or more, or for the r before it. The ladder is laid over itself, moved by
    k - 1 ranks, once for all fit points; where either end changes is a row with both scores.
    """
    k = F.greatest(F.floor(F.col("n") * F.lit(frac) + F.lit(1e-10)), F.lit(1))
    left = cells.where(F.col("below") <= F.col("n") - k).select(*keys, F.col("below").alias("r"), F.col("p").alias("left"), F.lit(None).cast("double").alias("right"))
    right = cells.where(F.col("below") + F.col("w") >= k).select(
        *keys, F.greatest(F.col("below") - (k - 1), F.lit(0)).alias("r"), F.lit(None).cast("double").alias("left"), F.col("p").alias("right")
    )
    ends = left.unionByName(right).withColumn("block", F.expr(f"r div {block_rows}"))
    carried = ends.groupBy(*keys, "block").agg(F.max("left").alias("_l"), F.max("right").alias("_r"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(*keys, "block", F.max("_l").over(before).alias("_l"), F.max("_r").over(before).alias("_r"))
    upto = Window.partitionBy(*keys, "block").orderBy("r")  # rows of the same rank see each other
    inside = ends.select(*keys, "block", "r", F.max("left").over(upto).alias("left"), F.max("right").over(upto).alias("right"))
    both = inside.join(carried, [*keys, "block"]).select(
        *keys, "block", "r", F.coalesce(F.greatest("left", "_l"), "left", "_l").alias("left"), F.coalesce(F.greatest("right", "_r"), "right", "_r").alias("right")
    )
    both = stored(both)

    def ends_of(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        rows, a = rows.sort_values("r", kind="stable"), points["at"].to_numpy()
        low, high = rows["left"].to_numpy(), rows["right"].to_numpy()
        first = np.searchsorted(low + high, 2 * a)
        out = points[[*keys, "at"]].copy()
        out["high"] = np.where(first < len(high), high[np.minimum(first, len(high) - 1)], np.nan) if len(high) else np.nan
        out["low"] = np.where(first > 0, low[np.maximum(first, 1) - 1], np.nan) if len(low) else np.nan
        return out

    found = (
        both.groupBy(*keys, "block")
        .cogroup(_at_blocks(at, both, keys).groupBy(*keys, "block"))
        .applyInPandas(ends_of, f"{_kinds(cells, keys)}, at double, high double, low double")
    )
    high = F.min(F.when(~F.isnan("high"), F.col("high"))) - F.col("at")
    low = F.col("at") - F.max(F.when(~F.isnan("low"), F.col("low")))
    width = F.greatest(F.coalesce(F.least(high, low), high, low), F.lit(0.0))
    return found.groupBy(*keys, "at").agg(width.alias("width"))


def _breaks(at: np.ndarray, width: np.ndarray) -> np.ndarray:
    # A window of zero width still needs a segment that holds its score alone.
    return np.unique(np.concatenate([at, at - width, np.where(width > 0, at + width, np.nextafter(at, np.inf))]))


def lowess_index(ladder: DataFrame, keys: list[str], frac: float, points: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, ici: mean distance between the score and a tricube-weighted local line, linear between fit points.

    Inside one side of a window the weight is a polynomial of the distance, so the sums of a local line follow from
    power moments of short score segments: one pass over the ladder, whatever the number of fit points.
    """
    cells = _blocked(ladder, keys, block_rows)
    kinds = _kinds(cells, keys)
    at = stored(fit_points(cells, keys, points))
    anchors = stored(window_widths(cells, keys, at, frac, block_rows))

    def moments_of(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        cuts = _breaks(fits["at"].to_numpy(), fits["width"].to_numpy())
        rows = rows.sort_values("p")
        p, w, pos = rows["p"].to_numpy(), rows["w"].to_numpy("float64"), rows["pos"].to_numpy("float64")
        seg = np.searchsorted(cuts, p, side="right")
        low, high = np.r_[cuts[0] - 1.0, cuts], np.r_[cuts, cuts[-1] + 1.0]
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        t = (p - (low[seg] + high[seg]) / 2) / (high[seg] - low[seg])
        out = {"seg": seg[first], "low": low[seg[first]], "high": high[seg[first]]}
        power = np.ones(len(p))
        for k in range(MOMENTS):
            out[f"m{k}"], out[f"y{k}"] = np.add.reduceat(w * power, first), np.add.reduceat(pos * power, first)
            power = power * t
        return rows[keys].iloc[:1].merge(pd.DataFrame(out), how="cross")

    names = [f"{c}{k}" for c in "my" for k in range(MOMENTS)]
    moments = (
        cells.groupBy(*keys, "block")
        .cogroup(_at_blocks(anchors, cells, keys).groupBy(*keys, "block"))
        .applyInPandas(moments_of, f"{kinds}, seg long, low double, high double, " + ", ".join(f"{c} double" for c in names))
    )
    moments = moments.groupBy(*keys, "seg", "low", "high").agg(*[F.sum(c).alias(c) for c in names])

    def lines(fits: pd.DataFrame, segments: pd.DataFrame) -> pd.DataFrame:
        fits, segments = fits.sort_values("at"), segments.sort_values("seg")
        out = fits[[*keys, "at"]].copy()
        out["fit"] = local_lines(fits["at"].to_numpy(), fits["width"].to_numpy(), segments)
        return out

    curve = anchors.groupBy(*keys).cogroup(moments.groupBy(*keys)).applyInPandas(lines, f"{kinds}, at double, fit double")
    curve = stored(curve)

    def gaps(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        fits = fits.sort_values("at")
        p, w = rows["p"].to_numpy(), rows["w"].to_numpy("float64")
        gap = np.abs(np.interp(p, fits["at"].to_numpy(), fits["fit"].to_numpy()) - p)
        return rows[keys].iloc[:1].assign(gap=(w * gap).sum(), w=w.sum())

    sums = (
        cells.groupBy(*keys, "block")
        .cogroup(_at_blocks(curve, cells, keys).groupBy(*keys, "block"))
        .applyInPandas(gaps, f"{kinds}, gap double, w double")
    )
    return sums.groupBy(*keys).agg((F.sum("gap") / F.sum("w")).alias("ici"))


def local_lines(at: np.ndarray, width: np.ndarray, seg: pd.DataFrame) -> np.ndarray:
    """Fitted value of the tricube-weighted local line at every fit point."""
    low, high = seg["low"].to_numpy(), seg["high"].to_numpy()
    mid, span = (low + high) / 2, high - low
    m = seg[[f"m{k}" for k in range(MOMENTS)]].to_numpy("float64")
    my = seg[[f"y{k}" for k in range(MOMENTS)]].to_numpy("float64")
    binom = [[math.comb(k, i) for i in range(k + 1)] for k in range(MOMENTS)]
    fit = np.empty(len(at))
    for j, (a, h) in enumerate(zip(at, width)):
        if h <= 0:
            here = low == a
            fit[j] = my[here, 0].sum() / max(m[here, 0].sum(), 1e-300)
            continue
        inside = (low >= a - h) & (high <= a + h)
        alpha, delta = (span / h)[inside], ((mid - a) / h)[inside]
        side = np.where(mid[inside] < a, -1.0, 1.0)
        ones = np.ones_like(alpha)
        scale = np.cumprod([ones, *[alpha] * (MOMENTS - 1)], axis=0)
        shift = np.cumprod([ones, *[delta] * (MOMENTS - 1)], axis=0)

        def powers(mom):
            part = scale * mom[inside].T
            return [sum(binom[k][i] * part[i] * shift[k - i] for i in range(k + 1)) for k in range(MOMENTS)]

        u, uy = powers(m), powers(my)

        def weighted(mom, k):
            return float((mom[k] - 3 * side * mom[k + 3] + 3 * mom[k + 6] - side * mom[k + 9]).sum())

        s0, s1, s2 = (weighted(u, k) for k in (0, 1, 2))
        y0, y1 = (weighted(uy, k) for k in (0, 1))
        spread = s2 - s1 * s1 / s0 if s0 > 0 else 0.0
        if s0 <= 0:
            fit[j] = np.nan
        elif spread <= 1e-12 * s0:
            fit[j] = y0 / s0
        else:
            slope = (y1 - s1 * y0 / s0) / spread
            fit[j] = (y0 - slope * s1) / s0
    return fit


# --- isotonic fit ------------------------------------------------------------------------


def lower_hull(points: pd.DataFrame) -> pd.DataFrame:
    """The points (w, s) on the lower convex hull, in order of w; whole numbers, compared exactly."""
    w, s = points["w"].tolist(), points["s"].tolist()
    kept: list[int] = []
    for i in range(len(w)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            # b goes if it lies on or above the line from a to i
            if (s[b] - s[a]) * (w[i] - w[a]) < (s[i] - s[a]) * (w[b] - w[a]):
                break
            kept.pop()
        kept.append(i)
    return points.iloc[kept]


def isotonic_pools(ladder: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, p_low, p_high, value, w_low, w_high: the pools of the non-decreasing fit of y on the score.

    A fit's pools are the edges of the lower convex hull of the running sums (rows, positives). The hull of a union
    is the hull of the parts' hulls, so blocks give their hulls and those are merged, ``MERGED`` at a time. With whole
    numbers of rows and positives a hull of n rows has at most about n ** (2 / 3) corners, however the scores lie.
    """
    if not keys:
        return isotonic_pools(ladder.withColumn("_all", F.lit(0)), ["_all"], block_rows).drop("_all")
    cells = _blocked(ladder, keys, block_rows)
    shape = f"{_kinds(cells, keys)}, block long, w long, s long, p_here double, p_next double"

    def hull_of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p")
        p = rows["p"].to_numpy()
        w, s = rows["below"].to_numpy() + rows["w"].to_numpy(), rows["pos_below"].to_numpy() + rows["pos"].to_numpy()
        points = pd.DataFrame({
            "w": np.r_[rows["below"].iloc[0], w], "s": np.r_[rows["pos_below"].iloc[0], s],
            "p_here": np.r_[np.nan, p], "p_next": np.r_[p, np.nan],
        })
        return rows[[*keys, "block"]].iloc[:1].merge(lower_hull(points), how="cross")

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        # the end of a block is the start of the next
        points = rows.groupby(["w", "s"], as_index=False)[["p_here", "p_next"]].max()
        block = rows[[*keys, "block"]].iloc[:1].assign(block=rows["block"].min() // MERGED)
        return block.merge(lower_hull(points), how="cross")

    hulls = cells.groupBy(*keys, "block").applyInPandas(hull_of, shape)
    blocks = (cells.agg(F.max("block")).first()[0] or 0) + 1
    while blocks > 1:
        hulls = stored(hulls)
        hulls = hulls.groupBy(*keys, F.expr(f"block div {MERGED}").alias("_to")).applyInPandas(merged, shape)
        blocks = -(-blocks // MERGED)
    hulls = stored(hulls)
    # corners of a group are few next to its rows, see above
    order = Window.partitionBy(*keys).orderBy("w")
    ahead = lambda c: F.lag(c).over(order)
    edges = hulls.select(*keys, ahead("p_next").alias("p_low"), F.col("p_here").alias("p_high"), ahead("w").alias("w_low"), F.col("w").alias("w_high"), ahead("s").alias("_s"), "s")
    value = (F.col("s") - F.col("_s")) / (F.col("w_high") - F.col("w_low"))
    return edges.where(F.col("w_low").isNotNull()).select(*keys, "p_low", "p_high", value.alias("value"), "w_low", "w_high")


def isotonic_index(ladder: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, ici: mean distance between the score and the isotonic fit."""
    cells = _blocked(ladder, keys, block_rows)
    pools = isotonic_pools(ladder, keys, block_rows)
    reach = F.sequence(F.expr(f"w_low div {block_rows}"), F.expr(f"(w_high - 1) div {block_rows}"))
    pools = pools.select(*keys, "value", "w_high", F.explode(reach).alias("block"))

    def gaps(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:  # a pool may reach over a block that holds the end of one long tie only
            return fits[keys].iloc[:1].assign(gap=0.0, w=0.0)  # adds nothing; Arrow takes no empty frame without types
        fits = fits.sort_values("w_high")
        value = fits["value"].to_numpy()[np.searchsorted(fits["w_high"].to_numpy(), rows["below"].to_numpy(), side="right")]
        w = rows["w"].to_numpy("float64")
        return rows[keys].iloc[:1].assign(gap=(w * np.abs(value - rows["p"].to_numpy())).sum(), w=w.sum())

    sums = (
        cells.groupBy(*keys, "block")
        .cogroup(pools.groupBy(*keys, "block"))
        .applyInPandas(gaps, f"{_kinds(cells, keys)}, gap double, w double")
    )
    return sums.groupBy(*keys).agg((F.sum("gap") / F.sum("w")).alias("ici"))


def isotonic_values(scored: DataFrame, pools: DataFrame, keys: list[str], chunk_rows: int = BLOCK_ROWS) -> DataFrame:
    """``scored`` with p replaced by the fit: constant in a pool, linear between pools, flat outside."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.schema.fields)
    columns = scored.columns
    sizes = scored.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_chunks"))
    sizes = stored(sizes)
    chunk = F.pmod(F.xxhash64(*columns), F.col("_chunks")).alias("_chunk")
    rows = scored.join(sizes, keys).select(*columns, chunk)
    knots = pools.join(sizes, keys).select(*keys, "p_low", "p_high", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_chunk"))

    def predicted(rows: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        fits = fits.sort_values("p_low")
        x = fits[["p_low", "p_high"]].to_numpy().ravel()
        y = np.repeat(fits["value"].to_numpy(), 2)
        x, first = np.unique(x, return_index=True)
        value = np.interp(rows["p"].to_numpy(), x, y[first]) if len(x) else np.full(len(rows), np.nan)
        return rows[columns].assign(p=value)

    return rows.groupBy(*keys, "_chunk").cogroup(knots.groupBy(*keys, "_chunk")).applyInPandas(predicted, shape)

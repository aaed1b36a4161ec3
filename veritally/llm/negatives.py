"""Hard negatives by inner-product search with coordinate pruning in length buckets.

Vectors become integers, so that every score is exact. Rows are cut into buckets
of vectors whose lengths differ by a tenth at most, and of at most about
``bucket_rows`` rows. For an anchor q and a lower bound t of the score:

* a bucket is passed over if |q| times its greatest length is below t;
* in a bucket, the cosine must be at least t / (|q| * greatest length), so the
  angle between the vectors is bounded, and with it each coordinate of the
  scaled row: it lies between cos(a + b) and cos(a - b), where a is the angle of
  q to that axis and b the bounded angle;
* the bucket keeps its rows sorted by each coordinate. The ranges of the
  anchor's ``focus`` largest coordinates are looked up there and intersected;
  what is left is verified exactly.

An anchor meets one bucket first; the scores found there are its bound for all
others. Positives are searched in buckets of the anchor's label, negatives in
buckets of all rows, for all positives of an anchor at once.

Defined results: rows with a null id, label or vector, an empty vector, or a
null or non-finite component take no part; vectors of different dimension aren't
compared; rows that repeat id, label and vector count once; rows that repeat the
id of an anchor are never its positives or negatives. An anchor without another
row of its label gives nothing. Scores must be below 2 ** 62. Only the named columns
are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritally.llm.common import written


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high`` bound a negative's score in hundredths of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    bucket_rows: int = 16_384
    anchor_rows: int = 8_192
    focus: int = 4


SHRINK = 0.9  # shortest by longest vector of a bucket
SLACK = 1e-9  # against rounding of cosines and angles; only ever widens a range
EXACT = float(1 << 53)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as integers."""
    flat = column.combine_chunks().flatten()
    return np.asarray(flat, np.int64).reshape(len(column), -1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score descending, then id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Bucket:
    """Rows of a bucket with their coordinates sorted."""

    def __init__(self, rows: np.ndarray, focus: int):
        self.rows, self.focus = rows, min(focus, rows.shape[1])
        self.largest = int(np.abs(rows).max(initial=0))
        self.real = rows.astype(np.float64)
        lengths = np.sqrt((self.real**2).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0)) * (1 + SLACK)
        self.scaled = self.real / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of coordinate f, and that coordinate sorted."""
        if f not in self.order:
            order = np.argsort(self.scaled[:, f], kind="stable")
            self.order[f] = order, self.scaled[order, f]
        return self.order[f]

    def feasible(self, anchor: np.ndarray, bound: float) -> np.ndarray | None:
        """Places that may score ``bound`` or more; None: all."""
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        if bound <= 0 or length == 0:
            return None
        least = bound / (length * self.longest) - SLACK if self.longest else 2.0
        if least > 1:
            return np.zeros(0, np.int64)
        q, wide = anchor / length, np.arccos(least)
        axes = np.argsort(-np.abs(q), kind="stable")[: self.focus]
        turn = np.arccos(np.clip(q[axes], -1, 1))
        low, high = np.cos(np.minimum(np.pi, turn + wide)) - SLACK, np.cos(np.maximum(0, turn - wide)) + SLACK
        spans = []
        for f, x, y in zip(axes.tolist(), low.tolist(), high.tolist()):
            order, values = self.by(f)
            spans.append((order, np.searchsorted(values, x), np.searchsorted(values, y, side="right")))
        first = int(np.argmin([b - a for _, a, b in spans]))
        order, a, b = spans[first]
        found = order[a:b]
        for k, (f, x, y) in enumerate(zip(axes.tolist(), low.tolist(), high.tolist())):
            if k != first:
                value = self.scaled[found, f]
                found = found[(value >= x) & (value <= y)]
        return found

    def scores(self, anchor: np.ndarray, places: np.ndarray) -> np.ndarray:
        most = self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor)
        if most < EXACT:  # sums of doubles are exact
            q = anchor.astype(np.float64)
            out = (self.real @ q)[places] if 4 * len(places) > len(self.rows) else self.real[places] @ q
            return out.astype(np.int64)
        if most < 1 << 63:
            return self.rows[places] @ anchor
        return np.array([sum(x * y for x, y in zip(r, anchor.tolist())) for r in self.rows[places].tolist()], object).astype(np.int64)


def searched(pairs: DataFrame, members: DataFrame, out: str, other_label: bool, k: int, s: Settings) -> DataFrame:
    """(anchor_id, goal, id, score): the first k of each anchor's goals in each bucket of its pairs.

    ``pairs`` are (bucket, anchor_id, label, vector, goals array of (goal, low, high)); a score counts for a goal
    if it lies in [low, high]. ``members`` are (bucket, id, label, vector).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            bucket = Bucket(matrix(right["vector"]), s.focus)
            ids, labels = np.asarray(right["id"]), np.asarray(right["label"])
            anchors = matrix(left["vector"])
            for q, own, label, goals in zip(anchors, left["anchor_id"].to_pylist(), left["label"].to_pylist(), left["goals"].to_pylist()):
                places = bucket.feasible(q, min(g["low"] for g in goals))
                places = np.arange(len(ids)) if places is None else places
                places = places[(ids[places] != own) & ((labels[places] != label) == other_label)]
                score = bucket.scores(q, places)
                for g in goals:
                    inside = np.flatnonzero((score >= g["low"]) & (score <= g["high"]))
                    first = inside[best(score[inside], ids[places[inside]], k)]
                    found[0] += [own] * len(first)
                    found[1] += [g["goal"]] * len(first)
                    found[2] += ids[places[first]].tolist()
                    found[3] += score[first].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("anchor_id", "goal", "id", "score"), found)})

    sizes = pairs.groupBy("bucket").agg(F.ceil(F.count("*") / s.anchor_rows).cast("int").alias("chunks"))
    sizes = written(sizes, "chunks")
    left = pairs.join(sizes, "bucket").withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.col("chunks")).cast("int")).drop("chunks")
    right = members.join(sizes, "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    found = left.groupBy("bucket", "chunk").cogroup(right.groupBy("bucket", "chunk")).applyInArrow(run, "anchor_id long, goal long, id long, score long")
    return written(found.distinct(), out)


def bucketed(points: DataFrame, by: list[str], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Points with their ``bucket``, and the buckets (``by``, bucket, rows, longest)."""
    kind = F.when(F.col("length") > 0, F.floor(F.log("length") / -float(np.log(SHRINK)))).otherwise(-(1 << 40))
    points = points.withColumn("kind", kind)
    chunks = points.groupBy(*by, "kind").agg(F.ceil(F.count("*") / s.bucket_rows).alias("chunks"))
    chunks = written(chunks, "lengths")  # a table, so that Spark may split the join where one length is very common
    points = points.join(chunks, [*by, "kind"])
    own = F.xxhash64(*by, "kind", F.pmod(F.xxhash64("id"), F.col("chunks"))).alias("bucket")
    points = written(points.select("id", "label", "width", "vector", "length", own), "bucketed")
    return points, written(points.groupBy(*by, "bucket").agg(F.count("*").alias("rows"), F.max("length").alias("longest")), "buckets")


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k (id, score) of each (anchor_id, goal), with their rank."""
    order = Window.partitionBy("anchor_id", "goal").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bounds(found: DataFrame, k: int) -> DataFrame:
    """The k-th best score so far of each (anchor_id, goal) that has k."""
    return first_of(found, k).filter(F.col("rank") == k).select("anchor_id", "goal", F.col("score").alias("bound"))


def narrowed(wanted: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``wanted`` (anchor_id, goal, low, ...) with the lower bound raised to the k-th best score found."""
    raised = F.greatest("low", F.coalesce("bound", "low"))
    return wanted.join(bounds(found, k), ["anchor_id", "goal"], "left").withColumn("low", raised).drop("bound")


def goals_of(wanted: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors with all their goals in one row, and the smallest lower bound."""
    goals = wanted.groupBy("anchor_id").agg(F.collect_list(F.struct("goal", "low", "high")).alias("goals"), F.min("low").alias("least"))
    return anchors.join(goals, "anchor_id")


def search(wanted: DataFrame, anchors: DataFrame, points: DataFrame, by: list[str], other_label: bool, k: int, s: Settings) -> DataFrame:
    """The first k for each goal (anchor_id, goal, low, high) of the anchors (anchor_id, label, width, vector, length)."""
    members, buckets = bucketed(points, by, s)
    members = members.select("bucket", "id", "label", "vector")
    home = buckets.groupBy(*by).agg(F.max_by("bucket", F.struct("longest", "rows", "bucket")).alias("home"))
    columns = ["bucket", "anchor_id", "label", "vector", "goals"]
    first = goals_of(wanted, anchors).join(home, by).withColumnRenamed("home", "bucket").select(*columns)
    near = searched(first, members, "near", other_label, k, s)
    wanted = narrowed(wanted, near, k)
    # the stated set of anchors meets all buckets of its dimension (and label) but those too short for its bound
    reach = F.col("least") <= F.ceil(F.col("length") * F.col("longest") * (1 + SLACK))
    rest = buckets.join(home, by).filter("bucket <> home").drop("rows", "home")
    pairs = goals_of(wanted, anchors).join(rest, by).filter(reach | (F.col("least") <= 0)).select(*columns)
    return first_of(near.union(searched(pairs, members, "far", other_label, k, s)).distinct(), k)


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the column ``id`` (the row's id as long).
    """
    s = settings
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    points = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & finite)
    points = points.select("id", "label", F.transform("e", lambda x: F.floor(F.lit(float(s.scale)) * x)).alias("vector")).distinct()
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    points = written(points.withColumns({"width": F.size("vector"), "length": F.sqrt(square)}), "points")
    anchors = written(points.filter(anchor).withColumnRenamed("id", "anchor_id"), "anchors")
    whole = {"goal": F.lit(0).cast("long"), "low": F.lit(-(1 << 62)), "high": F.lit(1 << 62)}

    wanted = anchors.select("anchor_id").distinct().withColumns(whole)
    positives = written(search(wanted, anchors, points, ["width", "label"], False, s.positives, s), "positives")
    positives = positives.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # 100 * score >= low * positive  <=>  score >= ceil(low * positive / 100), in whole numbers
    at = F.col("positive_score").cast("decimal(30,0)")
    part = lambda share: at * F.lit(share) - F.pmod(at * F.lit(share), F.lit(100).cast("decimal(30,0)"))
    down = lambda share: (part(share) / 100).cast("long")
    up = F.when(part(s.low) == at * F.lit(s.low), down(s.low)).otherwise(down(s.low) + 1)
    ranges = positives.select("anchor_id", F.col("positive_id").alias("goal"), up.alias("low"), down(s.high).alias("high")).filter("low <= high")
    found = search(written(ranges, "ranges"), anchors, points, ["width"], True, s.negatives, s)
    found = found.select("anchor_id", F.col("goal").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(positives, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Connected components by contraction, on DataFrames.

Each round every node points to its smallest neighbour and the graph is
rewritten over the nodes pointed to, so at least half of the linked nodes go.
The smallest node of a component always points to itself and is what remains.
Rounds are written to the shared folder; nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Loops, repeated edges and either direction are allowed; a null end drops the edge.
    """
    edges = edges.select("a", "b").filter("a <> b").distinct()
    levels: list[DataFrame] = []
    while True:
        edges = written(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = written(parent.select("node", F.least("node", "low").alias("parent")), "parents")
        levels.append(parent)
        of = lambda c: parent.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
        edges = edges.join(of("a"), "a").join(of("b"), "b")
        edges = edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct()
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[0].withColumnRenamed("parent", "component")
    for level in levels[1:]:
        step = level.select(F.col("node").alias("component"), "parent")
        found = found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return written(found, "components")

"""Stage gates: conditions over aggregates, recorded and enforced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A fatal gate did not hold."""


@dataclass
class Gate:
    name: str
    condition: Column
    detail: Column
    fatal: bool = True


def evaluate_gates(stats: DataFrame, gates: list[Gate]) -> DataFrame:
    """One row per (stats row, gate): name, passed, fatal, detail. A null condition fails."""
    rows = [
        F.struct(
            F.lit(g.name).alias("name"),
            F.coalesce(g.condition, F.lit(False)).alias("passed"),
            F.lit(g.fatal).alias("fatal"),
            g.detail.cast("string").alias("detail"),
        )
        for g in gates
    ]
    return stats.select(F.inline(F.array(*rows)))


def enforce(gates: DataFrame) -> DataFrame:
    """Raise on the first failed fatal gates, return the table otherwise."""
    wrong = gates.where(~F.col("passed") & F.col("fatal"))
    failed = wrong.limit(20).collect()
    if failed:
        more = wrong.count() - len(failed)
        raise GateError("; ".join(f"[{r['name']}] {r['detail']}" for r in failed) + (f"; and {more} more" if more > 0 else ""))
    return gates

"""One keyed-hash stream behind every random choice.

A row's draw depends on (seed, purpose, key columns) only, never on the
partition it sits in, so a retried task or a different cluster size gives the
same rows, and plain SQL can reproduce them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 48


def key_hash(seed: int, purpose: str, *keys: Column | str) -> Column:
    """48-bit non-negative hash of the key columns."""
    parts = [F.lit(str(seed)), F.lit(purpose)]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("-", *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def key_uniform(seed: int, purpose: str, *keys: Column | str) -> Column:
    """Uniform draw in [0, 1)."""
    return key_hash(seed, purpose, *keys) / F.lit(float(2**HASH_BITS))


def weighted_choice(uniform: Column, values: list, weights: list[float]) -> Column:
    """The value whose cumulative weight interval holds the uniform draw."""
    edge, choice = 0.0, None
    for value, weight in list(zip(values, weights))[:-1]:
        edge = round(edge + weight, 12)
        choice = F.when(uniform < edge, value) if choice is None else choice.when(uniform < edge, value)
    return F.lit(values[-1]) if choice is None else choice.otherwise(values[-1])


# --- many draws per row ----------------------------------------------------------
# A bootstrap needs one draw per row and replicate. Hashing text for each would
# dominate the job, so a row is hashed once to two residues (h1, h2) and every
# replicate applies its own polynomial over a prime field:
#   x = (a2 h1^2 + a1 h1 + a0 + a3 h2) mod PRIME
# Products stay below 2^62, so 64-bit integers of any engine give the same x.

PRIME = 2**31 - 1
COEFFICIENTS = ("a0", "a1", "a2", "a3")


def key_residues(seed: int, purpose: str, *keys: Column | str) -> tuple[Column, Column]:
    """Two residues from the first and second 48 bits of one digest."""
    parts = [F.lit(str(seed)), F.lit(purpose)]
    parts += [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("-", *parts))
    h1, h2 = (F.conv(F.substring(digest, at, 12), 16, 10).cast("bigint") % PRIME for at in (1, 13))
    return h1, h2


def replicate_coefficients(seed: int, purpose: str, n: int) -> list[dict[str, int]]:
    """rep and its coefficients for rep = 1..n, from the same digest rule."""

    def draw(name: str, rep: int) -> int:
        digest = hashlib.md5(f"{seed}-{purpose}-{name}-{rep}".encode(), usedforsecurity=False).hexdigest()
        return int(digest[:12], 16) % PRIME

    return [{"rep": r, **{a: draw(a, r) for a in COEFFICIENTS}} for r in range(1, n + 1)]


def polynomial(h1, h2, c: dict):
    """Works for columns and for 64-bit numpy arrays alike."""
    return (((c["a2"] * h1 + c["a1"]) % PRIME * h1 + c["a0"]) % PRIME + (c["a3"] * h2) % PRIME) % PRIME


def explode_replicates(coefficients: list[dict[str, int]], name: str) -> Column:
    """One row per replicate with a struct of its coefficients; the list is one folded literal."""
    fields = ", ".join(f"{k}: bigint" for k in coefficients[0])
    return F.explode(F.from_json(F.lit(json.dumps(coefficients)), f"array<struct<{fields}>>")).alias(name)

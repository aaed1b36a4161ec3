"""Compare a Spark result with the result of its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    if "int" in d or d in ("long", "bigint"):
        return "int"
    if d in ("double", "float") or d.startswith("decimal"):
        return d.split("(")[0]
    if d in ("string", "varchar"):
        return "string"
    return d


def canonical(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if hasattr(v, "tolist"):
        return canonical(v.tolist())
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def compare(spark_df, con, sql: str) -> list[str]:
    """Problems found; empty when rows, columns, types and values agree exactly."""
    problems = []
    rows = [r.asDict() for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    have_cols = sorted(spark_df.columns)
    if have_cols != sorted(names):
        return [f"columns {have_cols} != {sorted(names)}"]
    for c, t in spark_df.dtypes:
        a, b = kind(t), kind(types[c])
        if a != b and not (a.startswith("array") or b.endswith("[]")):
            problems.append(f"type of {c}: {t} vs {types[c]}")
    if len(rows) != len(want):
        problems.append(f"rows {len(rows)} != {len(want)}")
    left = sorted([tuple(canonical(r[c]) for c in have_cols) for r in rows], key=repr)
    order = [names.index(c) for c in have_cols]
    right = sorted([tuple(canonical(r[i]) for i in order) for r in want], key=repr)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, first {bad[0]}")
    return problems


def frame(con, sql: str) -> pd.DataFrame:
    cur = con.execute(sql)
    return pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description])

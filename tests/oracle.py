"""Side-by-side comparison of a Spark result and its SQL twin."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

from docloom.plans.tables import Tables


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in Tables.NAMES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, float) or "float" in type(v).__name__:
        return f"{float(v):.6f}"
    return str(v)


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def kinds(pdf: pd.DataFrame) -> dict:
    """Type family per column, as a strict schema check would see it."""
    out = {}
    for c in sorted(pdf.columns):
        k = pdf[c].dtype.kind
        if k == "O":
            vals = [v for v in pdf[c] if v is not None]
            k = type(vals[0]).__name__ if vals else "null"
        out[c] = "M" if k == "date" else k
    return out


def compare(spark_df, con, sql: str) -> list[str]:
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    problems = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if len(got) and len(want) and kinds(got) != kinds(want):
        diff = {c: (a, kinds(want)[c]) for c, a in kinds(got).items() if kinds(want)[c] != a}
        problems.append(f"types {diff}")
    g, w = canonical(got), canonical(want)
    if g != w:
        only_g = [r for r in g if r not in set(w)][:2]
        only_w = [r for r in w if r not in set(g)][:2]
        n = sum(1 for a, b in zip(g, w) if a != b)
        problems.append(f"{n} rows differ; spark-only {str(only_g)[:900]}; sql-only {str(only_w)[:900]}")
    return problems

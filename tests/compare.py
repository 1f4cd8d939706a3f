"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, int | float):
        return (1, float(f"{float(v):.6g}"))
    return (2, str(v))


def _row_key(row):
    """Exact values first, so that noise in the last digits of a float doesn't reorder rows."""
    return sorted(((isinstance(v, float), i, *_key(v)) for i, v in enumerate(row)), key=lambda k: k[:2])


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))
    return str(a) == str(b)


def differences(spark_rows, spark_cols, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != sorted(spark_cols):
        return [f"columns {sorted(spark_cols)} and {sorted(cols)}"]
    order = sorted(cols)
    a = sorted(([r[spark_cols.index(c)] for c in order] for r in spark_rows), key=_row_key)
    b = sorted(([r[cols.index(c)] for c in order] for r in cur.fetchall()), key=_row_key)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows"]
    return [f"{order}: {x} and {y}" for x, y in zip(a, b, strict=True) if not all(map(same, x, y))][:5]

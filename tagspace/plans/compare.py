"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Row count, column names and an order-insensitive hash of the rounded values,
the same three facts the correctness gate records.
"""

from __future__ import annotations

import hashlib
import math


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_hash(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck_connect(sf_dir: str):
    import duckdb
    from tagspace.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, fn, sql: str | None, con=None) -> dict:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"rows_spark": len(s_rows), "cols_spark": sorted(s_cols)}
    if sql is None:
        return out
    con = con or duck_connect(sf_dir)
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    out.update(rows_oracle=len(d_rows), cols_oracle=sorted(d_cols),
               hash_match=rows_hash(s_cols, s_rows) == rows_hash(d_cols, d_rows))
    out["ok"] = (out["hash_match"] and out["rows_spark"] == out["rows_oracle"]
                 and out["cols_spark"] == out["cols_oracle"])
    return out

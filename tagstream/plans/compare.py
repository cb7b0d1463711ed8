"""Order-insensitive comparison of a Spark result with a DuckDB oracle (used by tests and the
``check`` command line)."""

from __future__ import annotations

import datetime as _dt
import math

import duckdb

from tagstream.sources.tables import TABLE_NAMES


def duck(sf_dir: str) -> "duckdb.DuckDBPyConnection":
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int = 6):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, _dt.datetime) else v.isoformat()
    if isinstance(v, dict):  # DuckDB struct (field order kept) — registered queries return no maps
        return tuple(_norm(x, digits) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return v


def compare(spark_df, con, sql: str, digits: int = 6) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = spark_df.collect()
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    key = lambda r: repr(r)
    a = sorted((tuple(_norm(r[i], digits) for i in si) for r in s_rows), key=key)
    b = sorted((tuple(_norm(r[i], digits) for i in di) for r in d_rows), key=key)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} duck={len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"first diff: spark={x} duck={y}"
    return True, f"{len(a)} rows"

"""Strict Spark-vs-DuckDB result comparison used by the oracle tests.

Checks column names, logical types and the multiset of rows (order-insensitive), mirroring the driver's
row-count + schema + value-hash gate, but stricter on types so that any hashing scheme agrees.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
                  "DATE": "date", "TIMESTAMP": "timestamp", "BOOLEAN": "boolean"}


def _duck_type(t: str) -> str:
    t = str(t).upper()
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return _DUCK_TO_SPARK.get(t, t.lower())


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    # zone-less and session-zone timestamps both hold wall-clock values here (UTC session)
    types = {f.name: f.dataType.simpleString().replace("timestamp_ntz", "timestamp") for f in df.schema.fields}
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, [types[c] for c in cols], rows


def duck_rows(con, sql: str):
    rel = con.sql(sql)
    names = list(rel.columns)
    dtypes = {n: _duck_type(t) for n, t in zip(names, rel.types)}
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    rows = [tuple(_norm(r[i]) for i in idx) for r in data]
    return cols, [dtypes[c] for c in cols], rows


def compare(df, con, sql: str) -> list[str]:
    """Return a list of differences (empty when the results match)."""
    s_cols, s_types, s_rows = spark_rows(df)
    d_cols, d_types, d_rows = duck_rows(con, sql)
    problems = []
    if s_cols != d_cols:
        return [f"columns differ: spark={s_cols} duck={d_cols}"]
    if s_types != d_types:
        problems.append("types differ: " + ", ".join(
            f"{c}: {a} vs {b}" for c, a, b in zip(s_cols, s_types, d_types) if a != b))
    if len(s_rows) != len(d_rows):
        problems.append(f"row count: spark={len(s_rows)} duck={len(d_rows)}")
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        problems.append(f"values differ ({sum((cs - cd).values())} rows); cols={s_cols}; "
                        f"spark-only={only_s} duck-only={only_d}")
    return problems

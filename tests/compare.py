"""Compare a Spark result with its DuckDB oracle: names, types, rows."""

from __future__ import annotations

import datetime as dt
import glob
import os

import duckdb

_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR",
    "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if isinstance(value, float):
        if value != value:
            return "nan"
        return round(value + 0.0, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(rows, order):
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))


def check(df, sql: str | None, con) -> str:
    names = df.columns
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"no oracle n={len(got)}"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(cols) != sorted(names):
        return f"COLUMNS spark={sorted(names)} duck={sorted(cols)}"
    spark_types = {n: t for n, t in df.dtypes}
    diff = {n: (spark_types[n], types[n]) for n in names
            if _TYPES.get(spark_types[n], spark_types[n]).split()[0] != types[n].split()[0]}
    keys = sorted(names)
    a = _rows(got, [names.index(k) for k in keys])
    b = _rows(want, [cols.index(k) for k in keys])
    if a != b:
        sa, sb = set(a), set(b)
        return (f"ROWS spark={len(a)} duck={len(b)}\n  cols {keys}\n  spark-only {list(sa - sb)[:4]}"
                f"\n  duck-only {list(sb - sa)[:4]}")
    if diff:
        return f"TYPES {diff} n={len(a)}"
    return f"ok n={len(a)}"

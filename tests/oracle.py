"""Runs a registered query on both engines and compares rows regardless of order."""

from __future__ import annotations

import math
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number if number else 0.0)
    if isinstance(value, int):
        return str(value)
    return str(value)


def _kind(value):
    return "float" if isinstance(value, (float, Decimal)) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def kinds_of(columns, rows):
    out = {}
    for i, c in enumerate(columns):
        out[c] = {_kind(r[i]) for r in rows if r[i] is not None}
    return out


def compare(spark_df, con, sql):
    """None when equal, else a short description of the difference."""
    got_rows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    got, got_cols = rows_of(spark_df.columns, got_rows)
    want, cols = rows_of(want_cols, want_rows)
    if got_cols != cols:
        return f"columns {got_cols} != {cols}"
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)} {cols}; only spark {extra}; only sql {missing}"
    gk, wk = kinds_of(spark_df.columns, got_rows), kinds_of(want_cols, want_rows)
    if gk != wk:
        return f"types {[(c, gk[c], wk[c]) for c in gk if gk[c] != wk[c]]}"
    return None

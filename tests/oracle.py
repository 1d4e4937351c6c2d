"""Compare a registered query with its oracle SQL, order-insensitively."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, plan, oracle: str) -> tuple[bool, str]:
    df = plan(spark, folder)
    got = df.collect()
    cur = con.execute(oracle)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    left, right = _rows(df.columns, got), _rows(cols, want)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [n for n, t in kinds.items() if t.startswith(("array", "map", "struct"))]
    note = f" nested:{odd}" if odd else ""
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}{note}; only spark {sorted(set(left) - set(right))[:2]} only sql {sorted(set(right) - set(left))[:2]}"
    if left != right:
        a = [x for x in left if x not in set(right)][:2]
        b = [x for x in right if x not in set(left)][:2]
        return False, f"values differ ({len(left)} rows): spark {a} sql {b}{note}"
    return True, f"{len(left)} rows{note}"

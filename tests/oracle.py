"""Compare queries with their SQL in DuckDB: rows, columns, values."""

from __future__ import annotations

import math
import os
from collections import Counter


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = os.path.join(sf_dir, name)
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    try:
        return round(float(x), 6) + 0.0
    except (TypeError, ValueError):
        return str(x)


def differ(df, con, sql: str) -> str:
    """What differs, or nothing."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    b = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:2]}, only there {list((b - a).items())[:2]}"
    return ""

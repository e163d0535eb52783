"""Runs a query and its oracle and compares rows by value."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return (0 if value is None else 1, str(value))
    if isinstance(value, (int, float)) or hasattr(value, "as_integer_ratio"):
        f = float(value)
        return (2, "nan" if math.isnan(f) else f"{f + 0.0:.6g}")
    return (3, str(value))


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    names, want = oracle(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    a = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    b = sorted(tuple(plain(r[k]) for k in order) for r in want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} rows against {len(b)}; {extra}"
    return ""

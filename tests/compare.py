"""A query's rows against those of its SQL on the same tables."""

import math
import os
from functools import cache

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@cache
def connection(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def same(df, sql, folder):
    got = connection(folder).execute(sql)
    names = [c[0] for c in got.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    have = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert have == want
    return len(have)

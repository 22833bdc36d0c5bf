"""DuckDB over the same tables, and a comparison that ignores row order and float noise."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


def assert_same(df, sql, con):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b and not _close(a, b)]
    assert not different, different[:3]


def _close(a, b):
    for x, y in zip(a, b, strict=True):
        if x != y:
            try:
                if abs(float(x) - float(y)) > 1e-6 * max(1, abs(float(y))):
                    return False
            except ValueError:
                return False
    return True

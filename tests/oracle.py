"""Runs a query and its SQL side by side."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(plain([r[c] for c in names])) for r in df.collect())
    r = connect(sf_dir).sql(sql)
    order = [r.columns.index(c) for c in sorted(r.columns)]
    assert names == sorted(r.columns)
    assert got == sorted(repr(plain([row[k] for k in order])) for row in r.fetchall())

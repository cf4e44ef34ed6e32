"""Rows of a Spark query against rows of DuckDB SQL on the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _norm(rows, names, floats):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    fix = lambda v: (round(v, 9) if not math.isnan(v) else "nan") if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=key), sorted(names)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, want_names = _norm(cur.fetchall(), names, None)
    got, got_names = _norm([tuple(r) for r in df.collect()], df.columns, None)
    assert got_names == want_names
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)

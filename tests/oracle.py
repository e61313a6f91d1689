"""A query's rows against DuckDB's rows of its SQL, whatever the order."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connection(sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf, f"{t}.parquet")).exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return [names[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def same(df, sql, con):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = con.sql(sql)
    assert got == rows(out.columns, out.fetchall())

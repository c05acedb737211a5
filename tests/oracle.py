"""Compares a Spark result with DuckDB's over the same files."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def rows(frame, columns):
    """Rows as sorted text; whole floats read like integers, as nulls turn integers into floats."""
    plain = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) and abs(v) < 2**53 else v
    return sorted(str(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def same(df, c, sql):
    a, b = df.toPandas(), c.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))

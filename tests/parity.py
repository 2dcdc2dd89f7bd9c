"""Compares a query with its SQL in DuckDB, whatever the order of rows."""

import glob
import os

import duckdb

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


def rows_of(values):
    plain = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in values)


def same(spark, fn, sql, sf_dir=SF):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    frame = fn(spark, sf_dir)
    columns = sorted(frame.columns)
    expected = db.sql(sql)
    assert sorted(expected.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = db.sql(f"SELECT {quoted} FROM ({sql})").fetchall()
    got = [tuple(r) for r in frame.select(*(f"`{c}`" for c in columns)).collect()]
    assert rows_of(got) == rows_of(want)

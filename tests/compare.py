"""A query's rows beside its SQL's rows in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{at}'")
    return c


def _key(row):
    return tuple((x is None, f"{x:.9g}" if isinstance(x, float) and not math.isnan(x) else str(x)) for x in row)


def differences(df, sql, con):
    """Empty when columns, number of rows and values agree, doubles to 9 digits."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    cols = sorted(df.columns)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [(c, t, str(rel.types[rel.columns.index(c)])) for c, t in df.dtypes if kinds.get(t) != str(rel.types[rel.columns.index(c)])]
    got = sorted(_key([r[c] for c in cols]) for r in df.collect())
    want = sorted(_key([r[rel.columns.index(c)] for c in cols]) for r in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    return f"types {wrong}" if wrong else ""

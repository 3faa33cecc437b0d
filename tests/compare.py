"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(text(r[n]) for n in names) for r in df.collect())


def duck_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in found.fetchall())

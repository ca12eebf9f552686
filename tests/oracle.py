"""Runs a registered query and its SQL on the same tables and compares their rows."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(con, df, sql):
    """What differs between a DataFrame and SQL; empty if nothing does."""
    made = con.sql(sql)
    want = rows(list(made.columns), made.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(made.columns):
        return f"columns {sorted(df.columns)} against {sorted(made.columns)}"
    if got == want:
        return ""
    odd = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; {odd}"

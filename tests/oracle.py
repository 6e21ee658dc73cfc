"""Comparison of a query with its DuckDB statement over one of the sample folders."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def check(spark, sf, query, sql):
    found = query(spark, sf)
    truth = connect(sf).sql(sql)
    assert sorted(found.columns) == sorted(truth.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(truth.columns, truth.fetchall())

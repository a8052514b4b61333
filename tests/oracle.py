"""Spark's rows against DuckDB's for one query, columns by name, rows in any order."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(repr([r[i] for i in order]) for r in cursor.fetchall())


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(repr([r[n] for n in names]) for r in df.collect())


def assert_same(spark, sf_dir, queries, sql, name):
    expected, got = rows_of_sql(connect(sf_dir), sql[name]), rows_of_spark(queries[name](spark, sf_dir))
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]

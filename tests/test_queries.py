"""Registered queries against their SQL, over the smallest tables.

All of them; FRESHET_SOME_QUERIES=4 runs every fourth by name.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
EVERY = int(os.environ.get("FRESHET_SOME_QUERIES", "1"))
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{value + 0.0:.9g}"
    return str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES)[::EVERY])
def test_query_equals_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    kinds = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert kinds == {n: TYPES[k] for n, k in df.dtypes}
    quoted = ", ".join(f'"{n}"' for n in names)
    expected = sorted(tuple(map(cell, r)) for r in duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())
    got = sorted(tuple(map(cell, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES))[::EVERY])
def test_query_without_sql_gives_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows
    for column in ("pred", "flood_risk_score"):
        if column in df.columns:
            assert all(r[column] is not None and -0.5 < r[column] < 1.5 for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 26

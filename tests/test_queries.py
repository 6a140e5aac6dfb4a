"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lumbrera.plans import audit, catalog, documents, events, library, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def cell(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and value == int(value):
        return int(value)
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([cell(r[k]) for k in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        cursor = oracle.execute(registry.SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, cursor.fetchall())
    else:
        assert got


def test_source_units_of_many_lines(spark, tmp_path):
    licence = "Licensed under the Apache License, Version 2.0."
    texts = [None, "", " \n ", "t\n t ", "a\r\n\ta\na", *("\n".join([*(f"Line {i}" for i in range(n)), licence, f" {licence} "]) for n in (1, 4, 9, 10, 19, 200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["source_units"](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(connection.execute(registry.SQL["source_units"]).fetchall())

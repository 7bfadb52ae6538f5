"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from commitlens.queries.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


#: The training-data operators that SQL cannot express are tested in tests/llm.
OWN = {k for k in entry.queries() if k in QUERIES}


def test_every_query_has_sql():
    assert OWN == {k for k in entry.oracle_sql() if k in QUERIES}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(columns, cursor.fetchall())


def test_flagship(spark):
    summary = entry.entry(spark).collect()
    assert len(summary) == 25
    assert sum(r.matched_pairs for r in summary) > 0

"""Every registered query with SQL equals it in DuckDB at the smallest scale; the rest runs."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronolake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else str(v) if v is not None and not isinstance(v, (str, bool)) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in catalog.ORACLES:
        result = duck.execute(catalog.ORACLES[name])
        at = {c[0]: k for k, c in enumerate(result.description)}
        assert sorted(at) == columns
        assert got == sorted((tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall()), key=str)
    else:
        assert got


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

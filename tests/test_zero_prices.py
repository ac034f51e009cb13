"""Closes of zero, which larger tables of events hold, count in the queries as in their SQL; the operators refuse them by default."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from chronolake.plans import catalog


def alike(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Users with a bar on each day of January; of each kind of close some are zero on the days that count."""
    made, n, zero = [], 0, {1: [4], 2: [18], 3: [4, 18], 6: [27], 7: [28], 9: [25, 26], 10: [21]}
    for day in range(29):
        for user in (*range(1, 4), 5, 6, 7, 9, 10, 16, 31):
            while n % 197 == 0 or n % 17 == 0:
                n += 1
            made.append((n, datetime(2024, 1, 1) + timedelta(day), user, "view", 0.0 if day in zero.get(user, []) else 10.0 + (7 * day + user) % 13, "{}"))
            n += 1
    path = str(tmp_path_factory.mktemp("zero"))
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["holding_period", "market_evidence"])
def test_zero_close(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    result = duck.execute(catalog.ORACLES[name])
    at = {c[0]: k for k, c in enumerate(result.description)}
    wanted = sorted((tuple(alike(r[at[c]]) for c in df.columns) for r in result.fetchall()), key=str)
    assert any(x in ("nan", math.inf) for r in wanted for x in r)
    assert sorted((tuple(alike(x) for x in r) for r in df.collect()), key=str) == wanted

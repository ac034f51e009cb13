"""Operators that deal one key out over many tasks, against plain loops."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import asof, intervals, ranking

DAY = date(2020, 1, 1)


def on(k):
    return None if k is None else DAY + timedelta(days=k)


def spans(rng, n, longest, open_=True):
    out = []
    for k in range(n):
        start = rng.randrange(400)
        end = start + rng.randrange(1, longest)
        out.append((rng.choice("aaab"), k, on(start), None if open_ and rng.random() < 0.05 else on(end)))
    return out


def days(rows, key):
    return {on(x) for x in range(500) for k, _, s, e in rows if k == key and s <= on(x) and (e is None or on(x) < e)}


def runs(found):
    out = set()
    for x in sorted(found):
        if x - timedelta(days=1) not in found:
            start = x
        if x + timedelta(days=1) not in found:
            out.add((start, x + timedelta(days=1)))
    return out


SCHEMA = "k string, id int, start date, end date"


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_intervals_equal_sets_of_days(spark, seed):
    rng = random.Random(seed)
    left, right = spans(rng, 60, 12, open_=False), spans(rng, 30, 20, open_=False)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    merged, rest = intervals.spread_merge(a, ["k"], 7).collect(), intervals.spread_subtract(a, b, ["k"], 7).collect()
    for key in "ab":
        assert {(r["start"], r["end"]) for r in merged if r["k"] == key} == runs(days(left, key))
        assert {(r["start"], r["end"]) for r in rest if r["k"] == key} == runs(days(left, key) - days(right, key))
    assert intervals.spread_merge(a.limit(0), ["k"]).count() == 0


def test_one_key_is_spread(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.date_add(F.lit(DAY), (F.col("id") * 2).cast("int")).alias("start")).withColumn("end", F.date_add("start", 1))
    swept = ranking.running(df.select("k", F.col("start").alias("at"), F.lit(1).alias("n")), ["k"], ["at"], {"total": "n"}, 8)
    assert swept.where(F.datediff("at", F.lit(DAY)) / 2 + 1 != F.col("total")).count() == 0
    tasks = [r["n"] for r in swept.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert intervals.spread_merge(df, ["k"], 8).count() == 20_000 and max(tasks) <= 20_000


@pytest.mark.parametrize("width", [1, 9, 1000])
def test_meeting_spans_are_all_pairs_once(spark, width):
    rng = random.Random(width)
    left, right = spans(rng, 40, 60), spans(rng, 40, 60)
    got = [(r["a"]["id"], r["b"]["id"]) for r in intervals.meeting(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], width).collect()]
    far = date(9999, 12, 31)
    assert sorted(got) == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < (b[3] or far) and b[2] < (a[3] or far))


@pytest.mark.parametrize("ahead", [0, 3])
def test_members_by_date_equal_a_loop(spark, ahead):
    rng, rows = random.Random(ahead), []
    for k in range(80):
        start = rng.randrange(60)
        end = None if rng.random() < 0.3 else start + rng.randrange(-2, 40)
        rows.append((f"m{k % 20}", on(start - rng.randrange(20)) if rng.random() < 0.95 else None, on(start), on(end), None if end is None or rng.random() < 0.2 else on(end + rng.randrange(-9, 9))))
    asked = [on(x) for x in range(-25, 90, 3)]
    want = {}
    for d in asked:
        e = d + timedelta(days=ahead)
        n = len({m for m, known, start, end, told in rows if known and known <= d and start <= e and (end is None or end > e or (told is not None and told > d))})
        if n:
            want[d] = n
    m = spark.createDataFrame(rows, "ticker string, known date, start date, end date, end_known date")
    assert {r["date"]: r["n_members"] for r in asof.members_by_date(spark.createDataFrame([(d,) for d in asked] * 2, "date date"), m, ahead=ahead).collect()} == want


def test_labels_of_the_day(spark):
    prices = spark.createDataFrame([("p", "x", on(k), k) for k in range(0, 60, 4)] * 2, "provider string, provider_symbol string, date date, n int")
    mappings = spark.createDataFrame([("p", "x", 1, "verified", on(0), None)], "provider string, provider_symbol string, security_id int, mapping_status string, start date, end date")
    labels = [(1, "old", on(0), on(20)), (1, "OLD", on(10), on(24)), (1, "new", on(24), on(44)), (1, "dup", on(40), on(48)), (2, "other", on(0), None)]
    found = asof.relabelled(prices, mappings, spark.createDataFrame(labels, "security_id int, ticker string, start date, end date")).collect()
    assert len(found) == 30
    for r in found:
        active = {t.upper() for s, t, a, b in labels if s == 1 and a <= on(r["n"]) and (b is None or on(r["n"]) < b)}
        assert (r["ticker"], r["problem"]) == ((active.pop(), None) if len(active) == 1 else (None, "not exactly one ticker on the date"))

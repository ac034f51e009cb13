"""The registered queries over analogue tables, each with the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, facts, intervals, ranking

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Decision date of the point-in-time queries.
DAY = "1996-06-30"
D = date.fromisoformat(DAY)

PRICES = "prices AS (SELECT l_partkey AS security_id, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS close, l_quantity AS volume FROM lineitem)"
FACTS = "facts AS (SELECT o_custkey AS issuer_id, l_returnflag AS metric, CAST(o_orderdate AS DATE) AS period_end, CAST(l_shipdate AS DATE) AS as_of_date, l_extendedprice AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
SPANS = """spans AS (SELECT * FROM (SELECT o_custkey AS security_id, o_orderkey, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS start,
  CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS "end" FROM orders) WHERE "end" IS NULL OR start < "end")"""
MEMBERS = SPANS + """, members AS (SELECT security_id, start, "end", start - 10 AS known, CASE WHEN o_orderkey % 3 <> 0 THEN "end" - 5 ELSE "end" + 30 END AS end_known FROM spans)"""
MACRO = "macro AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS date, ts AS released, value, event_id FROM events)"
CURVE = "curve AS (SELECT event_type AS book, CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY ALL)"
POSITIONS = "positions AS (SELECT c_custkey AS security_id, c_mktsegment AS sector, c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS weight, c_nationkey AS book FROM customer WHERE c_acctbal > 0)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def day(c):
    return F.col(c).cast("date")


def prices(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("security_id"), day("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.col("l_quantity").alias("volume"))


def fact_rows(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("issuer_id"), F.col("l_returnflag").alias("metric"), day("o_orderdate").alias("period_end"), day("l_shipdate").alias("as_of_date"), F.col("l_extendedprice").alias("value"))


def spans(spark, d):
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), "o_orderkey", F.col("o_orderstatus").alias("status"), day("o_orderdate").alias("start"), following.cast("date").alias("end"))
    return rows.where(F.col("end").isNull() | (F.col("start") < F.col("end")))


def members(spark, d):
    """Every third end is announced a month late."""
    late = F.when(F.col("o_orderkey") % 3 != 0, F.date_sub("end", 5)).otherwise(F.date_add("end", 30))
    return spans(spark, d).select("security_id", "start", "end", F.date_sub("start", 10).alias("known"), late.alias("end_known"))


def macro(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("series_id"), day("ts").alias("date"), F.col("ts").alias("released"), "value", "event_id")


def curve(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("book"), day("ts").alias("date")).agg(F.sum("value").alias("value"))


def positions(spark, d):
    total = F.sum("c_acctbal").over(Window.partitionBy("c_nationkey"))
    return read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("security_id"), F.col("c_mktsegment").alias("sector"), (F.col("c_acctbal") / total).alias("weight"), F.col("c_nationkey").alias("book"))


# Point-in-time reads.


@query(f"WITH {FACTS} SELECT issuer_id, metric, period_end, as_of_date, value FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, metric ORDER BY as_of_date DESC, period_end DESC, value DESC) AS r FROM facts WHERE as_of_date <= DATE '{DAY}' AND period_end <= as_of_date) WHERE r = 1")
def pit_latest(spark, d):
    return asof.latest_known(fact_rows(spark, d), ["issuer_id", "metric"], D, ties=["value"])


@query(f"WITH {FACTS} SELECT issuer_id, metric, period_end, as_of_date, value FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, metric, period_end ORDER BY as_of_date DESC, value DESC) AS r FROM facts WHERE as_of_date <= DATE '{DAY}' AND period_end <= as_of_date AND value IS NOT NULL) WHERE r = 1")
def pit_history(spark, d):
    return asof.latest_known(fact_rows(spark, d).where("value IS NOT NULL"), ["issuer_id", "metric", "period_end"], D, ties=["value"])


@query(f"""WITH {FACTS}, f2 AS (SELECT *, 'T' || issuer_id AS ticker FROM facts),
r AS (SELECT c_name AS requested, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END AS issuer, CASE WHEN c_custkey % 2 = 1 THEN 'T' || c_custkey END AS ticker FROM customer),
j AS (SELECT requested, f2.* FROM r JOIN f2 ON r.issuer = CAST(f2.issuer_id AS VARCHAR) UNION ALL SELECT requested, f2.* FROM r JOIN f2 ON r.ticker = f2.ticker)
SELECT requested, metric, period_end, as_of_date, value FROM (SELECT *, row_number() OVER (PARTITION BY requested, metric, period_end ORDER BY as_of_date DESC, value DESC) AS r FROM j WHERE as_of_date <= DATE '{DAY}' AND period_end <= as_of_date) WHERE r = 1""")
def pit_batch_routes(spark, d):
    rows = fact_rows(spark, d).withColumn("issuer", F.col("issuer_id").cast("string")).withColumn("ticker", F.concat(F.lit("T"), "issuer"))
    even = F.col("c_custkey") % 2 == 0
    routes = read(spark, d, "customer").select(F.col("c_name").alias("requested"), F.when(even, "issuer").otherwise("ticker").alias("kind"), F.when(even, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("T"), "c_custkey")).alias("target"))
    found = asof.routed(rows, routes, {"issuer": "issuer", "ticker": "ticker"})
    return asof.latest_known(found, ["requested", "metric", "period_end"], D, ties=["value"]).select("requested", "metric", "period_end", "as_of_date", "value")


_CUT = f"(SELECT CAST(min(ts) AS DATE) + 15 FROM events)"


def macro_cut(spark, d):
    """The decision date: half a month after the first event."""
    return read(spark, d, "events").agg(F.date_add(F.min("ts").cast("date"), 15).alias("cut"))


@query(f"WITH {MACRO} SELECT series_id, date, released, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY released DESC, event_id DESC) AS r FROM macro WHERE CAST(released AS DATE) <= {_CUT}) WHERE r = 1")
def macro_vintage(spark, d):
    rows = macro(spark, d).join(F.broadcast(macro_cut(spark, d)), day("released") <= F.col("cut"))
    return asof.first_per(rows, ["series_id", "date"], asof.newest("released", "event_id")).select("series_id", "date", "released", "value")


@query(f"WITH {MACRO}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY released DESC, event_id DESC) AS r FROM macro WHERE CAST(released AS DATE) <= {_CUT}) WHERE r = 1) SELECT series_id, date, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS q FROM v) WHERE q = 1")
def macro_latest(spark, d):
    return asof.first_per(macro_vintage(spark, d), ["series_id"], asof.newest("date")).select("series_id", "date", "value")


@query(f"WITH {PRICES} SELECT security_id, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC, close DESC, volume DESC) AS r FROM prices WHERE date <= DATE '{DAY}') WHERE r = 1")
def latest_price(spark, d):
    return asof.first_per(prices(spark, d).where(F.col("date") <= D), ["security_id"], asof.newest("date", "close", "volume"))


_DEDUPED = f"{PRICES}, dd AS (SELECT security_id, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY security_id, date ORDER BY close DESC, volume DESC) AS r FROM prices WHERE date <= DATE '{DAY}') WHERE r = 1)"


def deduped(spark, d):
    return asof.first_per(prices(spark, d).where(F.col("date") <= D), ["security_id", "date"], asof.newest("close", "volume"))


@query(f"WITH {_DEDUPED} SELECT security_id, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS q FROM dd) WHERE q <= 10")
def price_window_n(spark, d):
    return asof.first_per(deduped(spark, d), ["security_id"], asof.newest("date"), 10)


@query(f"""WITH {PRICES}, u AS (SELECT security_id, date, close, 2 AS priority FROM prices UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_totalprice / 1000, 1 FROM orders),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, date ORDER BY priority DESC, close DESC) AS r FROM u WHERE date <= DATE '{DAY}') WHERE r = 1)
SELECT security_id, date, close, priority FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS q FROM dd) WHERE q <= 20""")
def price_two_source(spark, d):
    warm = read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), day("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000).alias("close"), F.lit(1).alias("priority"))
    both = prices(spark, d).select("security_id", "date", "close", F.lit(2).alias("priority")).unionByName(warm).where(F.col("date") <= D)
    return asof.first_per(asof.first_per(both, ["security_id", "date"], asof.newest("priority", "close")), ["security_id"], asof.newest("date"), 20)


@query("SELECT user_id, event_type, sequence, value FROM (SELECT user_id, event_type, event_id AS sequence, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events WHERE event_id <= (SELECT max(event_id) FROM events WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events))) WHERE r = 1 AND NOT (sequence % 7 = 0)")
def generation_snapshot(spark, d):
    versions = read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("sequence"), "value", (F.col("event_id") % 7 == 0).alias("is_deleted"))
    return asof.snapshot(versions, ["user_id", "event_type"], generation(spark, d)).drop("is_deleted")


def generation(spark, d) -> DataFrame:
    """The generation captured halfway through the events."""
    e = read(spark, d, "events").select("event_id", "ts")
    half = e.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b")).select((F.col("_a") + (F.col("_b") - F.col("_a")) / 2).alias("_half"))
    return asof.capture(e.join(F.broadcast(half), F.col("ts") <= F.col("_half")), "event_id")


_ROUTES = """a AS (SELECT o_orderpriority || o_custkey % 50 AS ticker, o_custkey AS security_id, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 20 AS "end" FROM orders)"""


def assignments(spark, d):
    return read(spark, d, "orders").select(F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("ticker"), F.col("o_custkey").alias("security_id"), day("o_orderdate").alias("start"), F.date_add(day("o_orderdate"), 20).alias("end"))


@query(f"""WITH {_ROUTES}, k AS (SELECT DISTINCT ticker FROM a), n AS (SELECT ticker, count(DISTINCT security_id) AS n, min(security_id) AS one FROM a WHERE start <= DATE '{DAY}' AND ("end" IS NULL OR "end" > DATE '{DAY}') GROUP BY ticker)
SELECT k.ticker, coalesce(n, 0) AS n_targets, CASE WHEN n = 1 THEN one END AS security_id FROM k LEFT JOIN n ON n.ticker = k.ticker""")
def identity_routes(spark, d):
    a = assignments(spark, d)
    return asof.routes_of(a.select("ticker").distinct(), a, D)


@query(f"""WITH {_ROUTES} SELECT ticker, count(DISTINCT security_id) AS n_targets FROM a WHERE start <= DATE '{DAY}' AND "end" > DATE '{DAY}' GROUP BY ticker HAVING count(DISTINCT security_id) > 1""")
def identity_ambiguous(spark, d):
    return identity_routes(spark, d).where("n_targets > 1").select("ticker", "n_targets")


_MEMBER = "known <= {k} AND start <= {e} AND (\"end\" IS NULL OR \"end\" > {e} OR end_known > {k})"


@query(f"""WITH {MEMBERS} SELECT security_id, start, "end" FROM members WHERE {_MEMBER.format(k=f"DATE '{DAY}'", e=f"DATE '{DAY}' + 3")}""")
def membership_known_on(spark, d):
    c = F.col
    return members(spark, d).where(asof.member_on(c("known"), c("start"), c("end"), c("end_known"), D, D + timedelta(days=3))).select("security_id", "start", "end")


_QUARTERS = "q AS (SELECT max(CAST(o_orderdate AS DATE)) AS decision FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate))"


def decisions(spark, d):
    """The last session of each quarter."""
    return read(spark, d, "orders").groupBy(F.year("o_orderdate"), F.quarter("o_orderdate")).agg(F.max(day("o_orderdate")).alias("decision")).select("decision")


@query(f"""WITH {MEMBERS}, {_QUARTERS} SELECT decision, count(DISTINCT security_id) AS n_members FROM q JOIN members ON {_MEMBER.format(k="decision", e="decision + 1")} GROUP BY decision""")
def universe_by_decision(spark, d):
    """Members are counted by a sweep over days, the dates looked up in it."""
    dates = decisions(spark, d).withColumnRenamed("decision", "date")
    return asof.members_by_date(dates, members(spark, d), "security_id", ahead=1).withColumnRenamed("date", "decision")


@query(f"WITH {_QUARTERS}, s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT decision, min(date) AS entry FROM q LEFT JOIN s ON date > decision GROUP BY decision")
def execution_dates(spark, d):
    """The first session after each decision: sessions are few, one row for each date."""
    sessions = read(spark, d, "orders").select(day("o_orderdate").alias("date")).distinct()
    return decisions(spark, d).join(asof.few(sessions), F.col("date") > F.col("decision"), "left").groupBy("decision").agg(F.min("date").alias("entry"))


@query(f"WITH {PRICES}, f AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F') SELECT c_nationkey, count(*) AS n, count(*) FILTER (WHERE p.id IS NOT NULL) AS with_prices, count(*) FILTER (WHERE f.id IS NOT NULL) AS with_facts FROM customer LEFT JOIN (SELECT DISTINCT security_id AS id FROM prices WHERE date <= DATE '{DAY}') p ON p.id = c_custkey LEFT JOIN f ON f.id = c_custkey GROUP BY c_nationkey")
def coverage_report(spark, d):
    priced = prices(spark, d).where(F.col("date") <= D).select(F.col("security_id").alias("p")).distinct()
    filed = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("f")).distinct()
    c = read(spark, d, "customer")
    joined = c.join(priced, c["c_custkey"] == F.col("p"), "left").join(filed, c["c_custkey"] == F.col("f"), "left")
    return joined.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("with_prices"), F.count("f").alias("with_facts"))


@query(f"SELECT c_custkey, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '{DAY}' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS label FROM customer")
def identity_labels(spark, d):
    o = read(spark, d, "orders").where(F.col("o_orderdate") <= D).groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("label"))
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "label")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_returnflag = 'R')")
def refresh_candidates(spark, d):
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem").where("l_returnflag = 'R'")
    return o.join(li, (o["o_orderkey"] == li["l_orderkey"]) & (li["l_shipdate"] > o["o_orderdate"]), "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def shrink_check(spark, d):
    return read(spark, d, "part").join(read(spark, d, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


# Differences, merges, intervals.


def _changed(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 2, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return o.where("o_totalprice >= 50000"), new


_CHANGED = "a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 50000), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 2 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P')"
_DELTA = f"WITH {_CHANGED} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice IS NOT DISTINCT FROM b.o_totalprice THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey"


@query(_DELTA)
def relation_delta(spark, d):
    return facts.delta(*_changed(spark, d), ["o_orderkey"])


@query(f"SELECT change, count(*) AS n FROM ({_DELTA}) GROUP BY change")
def projection_diff(spark, d):
    return relation_delta(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CHANGED} SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_totalprice ELSE a.o_totalprice END AS o_totalprice FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey")
def keyed_upsert(spark, d):
    return facts.upsert(*_changed(spark, d), ["o_orderkey"], keep_if_null=["o_orderstatus"])


_SHIFTED = """z AS (SELECT o_custkey AS security_id, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 90 AS INTEGER) AS "end" FROM orders)"""


def windows(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), day("o_orderdate").alias("start"), F.date_add(day("o_orderdate"), (30 + F.col("o_orderkey") % 90).cast("int")).alias("end"))


_MERGED = f"""{_SHIFTED}, i AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY security_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM z),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY security_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM i), m AS (SELECT security_id, min(start) AS start, max("end") AS "end" FROM j GROUP BY security_id, island)"""


@query(f"WITH {_MERGED} SELECT * FROM m")
def interval_merge(spark, d):
    return intervals.merge(windows(spark, d), ["security_id"])


@query(f"""WITH {_MERGED} SELECT security_id, "end" AS start, nxt AS "end" FROM (SELECT *, lead(start) OVER (PARTITION BY security_id ORDER BY start) AS nxt FROM m) WHERE nxt IS NOT NULL""")
def interval_gaps(spark, d):
    return intervals.gaps(windows(spark, d), ["security_id"])


@query(f"""WITH {_SHIFTED}, {SPANS} SELECT z.security_id, greatest(z.start, s.start) AS start, least(z."end", coalesce(s."end", DATE '9999-12-31')) AS "end" FROM z JOIN spans s ON s.security_id = z.security_id AND z.start < coalesce(s."end", DATE '9999-12-31') AND s.start < z."end" """)
def interval_intersect(spark, d):
    return intervals.intersect(windows(spark, d), spans(spark, d), ["security_id"])


@query(f"""WITH {_SHIFTED} SELECT security_id, start, "end" FROM (SELECT *, lag("end") OVER (PARTITION BY security_id ORDER BY start, "end") AS before FROM z) WHERE before > start""")
def overlap_lag(spark, d):
    return intervals.overlaps(windows(spark, d), ["security_id"])


@query("""WITH z AS (SELECT o_custkey AS security_id, o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 15 AS "end" FROM orders)
SELECT a.security_id, a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM z a JOIN z b ON a.security_id = b.security_id AND b.o_orderkey > a.o_orderkey AND a.start < b."end" AND b.start < a."end" """)
def overlap_self_join(spark, d):
    z = read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), "o_orderkey", day("o_orderdate").alias("start"), F.date_add(day("o_orderdate"), 15).alias("end"))
    return intervals.meeting(z, z, ["security_id"], days=60).where("b.o_orderkey > a.o_orderkey").select("a.security_id", F.col("a.o_orderkey").alias("first_key"), F.col("b.o_orderkey").alias("second_key"))


@query("""WITH z AS (SELECT o_orderstatus AS k, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) * 400 AS start FROM orders WHERE o_orderkey % 3 > 0), s AS (SELECT k, start, start + 1 AS "end" FROM z),
i AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM s), j AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT k, min(start) AS start, max("end") AS "end" FROM j GROUP BY k, island""")
def interval_merge_spread(spark, d):
    """Three keys hold all spans."""
    k = F.col("o_orderkey")
    start = F.date_add(day("o_orderdate"), (k % 7).cast("int") * 400)
    z = read(spark, d, "orders").where(k % 3 > 0).select(F.col("o_orderstatus").alias("k"), start.alias("start"), F.date_add(start, 1).alias("end"))
    return intervals.spread_merge(z, ["k"])


@query("WITH x AS (SELECT DISTINCT user_id, datediff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS p FROM events), y AS (SELECT user_id, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS island FROM x), z AS (SELECT user_id, island, count(*) AS n FROM y GROUP BY ALL) SELECT user_id, max(n) AS longest FROM z GROUP BY user_id")
def longest_run(spark, d):
    return intervals.longest_run(read(spark, d, "events").select("user_id", F.datediff(day("ts"), F.to_date(F.lit("2020-01-01"))).alias("p")), ["user_id"], "p")


@query(f"WITH {_DEDUPED} SELECT security_id, round(avg(close * volume), 4) AS adv, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS q FROM dd) WHERE q <= 10 GROUP BY security_id HAVING count(*) >= 10")
def adv_having(spark, d):
    last = price_window_n(spark, d)
    return last.groupBy("security_id").agg(F.round(F.avg(F.col("close") * F.col("volume")), 4).alias("adv"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("SELECT CAST(ts AS DATE) AS date FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_dates(spark, d):
    e = read(spark, d, "events")
    needed = e.agg(F.countDistinct("event_type").alias("_all"))
    return e.groupBy(day("ts").alias("date")).agg(F.countDistinct("event_type").alias("_n")).join(F.broadcast(needed), F.col("_n") == F.col("_all")).select("date")


@query("SELECT l_orderkey, l_linenumber, count(DISTINCT l_extendedprice) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_extendedprice) > 1")
def conflicting_keys(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_extendedprice").alias("n_values")).where("n_values > 1")


@query(f"WITH {_DEDUPED}, r AS (SELECT security_id, date, close, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS before FROM dd) SELECT security_id, date, round(close / before - 1, 6) AS move, CASE WHEN abs(close / before - 1) >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE before > 0 AND abs(close / before - 1) >= 0.25")
def price_move(spark, d):
    r = facts.with_returns(deduped(spark, d), ["security_id"], "date", "close").where(F.abs("ret") >= 0.25)
    return r.select("security_id", "date", F.round("ret", 6).alias("move"), F.when(F.abs("ret") >= 0.5, "high").otherwise("medium").alias("severity"))


@query("WITH v AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice / before - 1, 6) AS jump FROM v WHERE r <= 8 AND before > 0 AND abs(o_totalprice / before - 1) >= 0.3")
def share_jump(spark, d):
    w = Window.partitionBy("o_custkey")
    v = read(spark, d, "orders").withColumn("r", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).withColumn("before", F.lag("o_totalprice").over(w.orderBy("o_orderdate", "o_orderkey")))
    jump = F.col("o_totalprice") / F.col("before") - 1
    return v.where((F.col("r") <= 8) & (F.col("before") > 0) & (F.abs(jump) >= 0.3)).select("o_custkey", "o_orderkey", F.round(jump, 6).alias("jump"))


# Ranks.

_PCT = "(rank() OVER (PARTITION BY {s} ORDER BY {v}) - 1)::DOUBLE / count(*) OVER (PARTITION BY {s})"


@query(f"SELECT c_custkey, c_nationkey, {_PCT.format(s='c_nationkey', v='c_acctbal')} AS pct FROM customer")
def percentile_strict(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_nationkey", ranking.percentile(F.col("c_acctbal"), "c_nationkey").alias("pct"))


@query("SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice) - 1)::DOUBLE / count(*) OVER () AS o_totalprice_pct, (rank() OVER (ORDER BY o_custkey) - 1)::DOUBLE / count(*) OVER () AS o_custkey_pct FROM orders")
def percentile_spread(spark, d):
    """One section that holds every row, dealt into ranges; the second value has many ties."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return ranking.spread_percentiles(orders, "o_orderkey", [], ["o_totalprice", "o_custkey"]).select("o_orderkey", "o_totalprice_pct", "o_custkey_pct")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS position, count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders")
def ordinal_spread(spark, d):
    """Three sections, two of them with nearly half of all rows each, numbered in ranges."""
    return ranking.numbered(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


_BLEND = f"""p AS (SELECT p_partkey, p_brand, 100 * {_PCT.format(s='p_brand', v='p_retailprice')} AS q, 100 * {_PCT.format(s='p_brand', v='-p_size')} AS v FROM part),
b AS (SELECT p_partkey, p_brand, q, v, (q + v) / 2 AS score FROM p)"""


def _blend(spark, d):
    p = read(spark, d, "part").withColumn("q", 100 * ranking.percentile(F.col("p_retailprice"), "p_brand")).withColumn("v", 100 * ranking.percentile(-F.col("p_size"), "p_brand"))
    return p.withColumn("score", ranking.mean_of(["q", "v"])).select("p_partkey", "p_brand", "q", "v", "score")


@query(f"WITH {_BLEND} SELECT p_partkey, p_brand, score, CASE WHEN score >= 85 THEN 'A+' WHEN score >= 70 THEN 'A' WHEN score >= 55 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM (SELECT p_partkey, p_brand, round(score, 6) AS score FROM b)")
def composite_blend(spark, d):
    return _blend(spark, d).select("p_partkey", "p_brand", F.round("score", 6).alias("score"), ranking.grade(F.round("score", 6)).alias("grade"))


@query(f"WITH {_BLEND} SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY round(0.6 * q + 0.4 * v, 6) DESC, p_partkey) AS rank FROM b")
def policy_rank(spark, d):
    w = _blend(spark, d).withColumn("w", F.round(0.6 * F.col("q") + 0.4 * F.col("v"), 6))
    return w.select("p_partkey", "p_brand", ranking.ordinal(["p_brand"], "w", "p_partkey").alias("rank"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def sector_capped_topn(spark, d):
    return ranking.capped_top(read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", 3, 10, "c_acctbal", "c_custkey")


# Series and factors.

#: Quarters without any full year; a quarter in ten carries its neighbour's label.
_Q = "qs AS (SELECT id, e, 'Q' || (CASE WHEN id % 10 = 3 AND q = 2 THEN 1 ELSE q END) || '_' || y AS fp, CASE WHEN id % 10 = 3 AND q = 2 THEN 1 ELSE q END + 4 * y AS n, v FROM (SELECT o_custkey AS id, year(o_orderdate) AS y, quarter(o_orderdate) AS q, max(CAST(o_orderdate AS DATE)) AS e, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey, y, q))"


@query(f"WITH {_Q}, l AS (SELECT id, list(n ORDER BY e DESC)[1:4] AS ns, list(v ORDER BY e DESC)[1:4] AS vs FROM qs GROUP BY id) SELECT id AS issuer_id, round(CASE WHEN len(ns) = 4 AND list_reverse(ns) = range(ns[4], ns[4] + 4) THEN list_sum(vs) END, 2) AS ttm FROM l")
def ttm_sum(spark, d):
    q = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("issuer_id"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.max(day("o_orderdate")).alias("period_end"), F.sum("o_totalprice").alias("value"))
    named = q.withColumn("fiscal_period", F.concat(F.lit("Q"), F.when((F.col("issuer_id") % 10 == 3) & (F.col("q") == 2), 1).otherwise(F.col("q")), F.lit("_"), "y"))
    return facts.trailing_year(named, ["issuer_id"]).select("issuer_id", F.round("ttm", 2).alias("ttm"))


_RET = f"{_DEDUPED}, r AS (SELECT security_id, date, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY date), 0) - 1 AS ret, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS q FROM dd)"


@query(f"WITH {_RET} SELECT security_id, round(exp(sum(ln(1 + ret)) FILTER (WHERE q > 3)) - 1, 6) AS momentum, round(stddev_samp(ret) * sqrt(252), 6) AS volatility FROM r WHERE q <= 12 AND ret IS NOT NULL GROUP BY security_id HAVING count(*) = 12")
def momentum_vol(spark, d):
    """Momentum leaves the latest three observations out; volatility is annualised by 252."""
    r = facts.with_returns(deduped(spark, d), ["security_id"], "date", "close").withColumn("q", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date"))))
    r = r.where("q <= 12 AND ret IS NOT NULL").groupBy("security_id").agg(F.sum(F.when(F.col("q") > 3, F.log1p("ret"))).alias("m"), F.stddev_samp("ret").alias("s"), F.count(F.lit(1)).alias("n")).where("n = 12")
    return r.select("security_id", F.round(F.exp("m") - 1, 6).alias("momentum"), F.round(F.col("s") * F.sqrt(F.lit(252.0)), 6).alias("volatility"))


@query(f"WITH {CURVE}, c AS (SELECT *, max(value) OVER (PARTITION BY book ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curve) SELECT book, date, round(peak, 4) AS peak, round(CASE WHEN peak <> 0 THEN value / peak - 1 END, 6) AS drawdown FROM c")
def drawdown_curve(spark, d):
    return facts.with_drawdown(curve(spark, d), ["book"], "date", "value").select("book", "date", F.round("peak", 4).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


_CRET = f"{CURVE}, cr AS (SELECT book, date, CASE WHEN lag(value) OVER w > 0 THEN value / lag(value) OVER w - 1 END AS ret FROM curve WINDOW w AS (PARTITION BY book ORDER BY date))"


@query(f"WITH {_CRET} SELECT book, round(CASE WHEN count(ret) >= 2 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END, 6) AS sharpe, round(CASE WHEN count(ret) >= 2 AND stddev_samp(ret) > 0 THEN avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) END, 6) AS t_stat FROM cr GROUP BY book")
def sharpe_tstat(spark, d):
    sharpe, t = facts.sharpe_and_t(F.col("ret"), 252)
    return facts.with_returns(curve(spark, d), ["book"], "date", "value").groupBy("book").agg(F.round(sharpe, 6).alias("sharpe"), F.round(t, 6).alias("t_stat"))


@query(f"WITH {_CRET}, x AS (SELECT a.book, a.ret - b.ret AS ret FROM cr a JOIN cr b ON a.date = b.date AND b.book = (SELECT min(event_type) FROM events) AND a.book <> b.book WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL) SELECT book, count(*) AS n, round(avg(ret), 6) AS excess, round(CASE WHEN count(*) >= 2 AND stddev_samp(ret) > 0 THEN avg(ret) / (stddev_samp(ret) / sqrt(count(*))) END, 6) AS t_stat FROM x GROUP BY book")
def paired_excess(spark, d):
    """Every book against the benchmark (the first by name), on common dates."""
    r = facts.with_returns(curve(spark, d), ["book"], "date", "value").where("ret IS NOT NULL").select("book", "date", "ret")
    first = read(spark, d, "events").agg(F.min("event_type").alias("_first"))
    bench = r.join(F.broadcast(first), F.col("book") == F.col("_first")).select("date", F.col("ret").alias("bench"), "_first")
    x = r.join(bench, "date").where(F.col("book") != F.col("_first")).withColumn("excess", F.col("ret") - F.col("bench"))
    return x.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("excess"), 6).alias("excess_mean"), F.round(facts.sharpe_and_t(F.col("excess"), 1)[1], 6).alias("t_stat")).withColumnRenamed("excess_mean", "excess")


@query(f"WITH {_DEDUPED}, s AS (SELECT security_id, date, CASE WHEN volume > 45 THEN 2.0 WHEN volume < 3 THEN 0.5 ELSE 1.0 END AS split FROM dd) SELECT security_id, date, coalesce(exp2, 1.0) AS factor FROM (SELECT security_id, date, round(exp(sum(ln(split)) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 9) AS exp2 FROM s)")
def cumulative_split_factor(spark, d):
    split = F.when(F.col("volume") > 45, 2.0).when(F.col("volume") < 3, 0.5).otherwise(1.0)
    return deduped(spark, d).withColumn("split", split).select("security_id", "date", F.round(facts.later_product(["security_id"], "date", "split"), 9).alias("factor"))


_MONTHS = "m AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def monthly(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc("o_orderdate", "month").alias("date")).agg(F.sum("o_totalprice").alias("value"))


@query(f"WITH {_MONTHS}, l AS (SELECT series_id, max(date) AS date FROM m GROUP BY series_id) SELECT l.series_id, l.date, max(p.date) AS prior_date, round(max(n.value) / arg_max(p.value, p.date) - 1, 6) AS yoy FROM l JOIN m n ON n.series_id = l.series_id AND n.date = l.date JOIN m p ON p.series_id = l.series_id AND p.date <= l.date - 330 GROUP BY l.series_id, l.date")
def yoy_pair(spark, d):
    """The latest observation against the last one at least 330 days older."""
    m = monthly(spark, d)
    last = m.groupBy("series_id").agg(F.max("date").alias("last"), F.max_by("value", "date").alias("now"))
    prior = m.join(last, "series_id").where(F.col("date") <= F.date_sub("last", 330))
    return prior.groupBy("series_id", F.col("last").alias("date")).agg(F.max("date").alias("prior_date"), F.round(F.max("now") / F.max_by("value", "date") - 1, 6).alias("yoy"))


@query(f"WITH {_MONTHS}, t AS (SELECT date, sum(value) AS gdp, sum(value) FILTER (WHERE series_id LIKE '1%') / sum(value) AS stress FROM m GROUP BY date), g AS (SELECT date, gdp - lag(gdp) OVER (ORDER BY date) AS growth, gdp / nullif(lag(gdp, 12) OVER (ORDER BY date), 0) - 1 AS infl, stress FROM t) SELECT date, CASE WHEN growth IS NULL OR infl IS NULL THEN 'unknown' WHEN stress >= 0.21 THEN 'crisis' WHEN growth > 0 AND infl > 0 THEN 'overheating' WHEN growth > 0 THEN 'expansion' WHEN infl > 0 THEN 'stagflation' ELSE 'contraction' END AS regime FROM g")
def regime_labels(spark, d):
    """Labels of months: one row for each month of the macro series, so its windows are small by nature."""
    t = monthly(spark, d).groupBy("date").agg(F.sum("value").alias("gdp"), (F.sum(F.when(F.col("series_id").like("1%"), F.col("value"))) / F.sum("value")).alias("stress"))
    w = Window.orderBy("date")
    g = t.select("date", "stress", (F.col("gdp") - F.lag("gdp").over(w)).alias("growth"), (F.try_divide("gdp", F.lag("gdp", 12).over(w)) - 1).alias("infl"))
    label = F.when(F.col("growth").isNull() | F.col("infl").isNull(), "unknown").when(F.col("stress") >= 0.21, "crisis").when((F.col("growth") > 0) & (F.col("infl") > 0), "overheating").when(F.col("growth") > 0, "expansion").when(F.col("infl") > 0, "stagflation").otherwise("contraction")
    return g.select("date", label.alias("regime"))


# Risk.


@query(f"WITH {POSITIONS}, s AS (SELECT book, sector, sum(weight) AS w FROM positions GROUP BY ALL) SELECT p.book, p.n, p.max_position <= 0.10 AS position_ok, s.max_sector <= 0.30 AS sector_ok, p.n >= 10 AS count_ok FROM (SELECT book, count(*) AS n, max(weight) AS max_position FROM positions GROUP BY book) p JOIN (SELECT book, max(w) AS max_sector FROM s GROUP BY book) s ON s.book = p.book")
def risk_checks(spark, d):
    sectors = positions(spark, d).groupBy("book", "sector").agg(F.sum("weight").alias("w"), F.max("weight").alias("m"), F.count(F.lit(1)).alias("k"))
    b = sectors.groupBy("book").agg(F.sum("k").alias("n"), F.max("m").alias("max_position"), F.max("w").alias("max_sector"))
    return b.select("book", "n", (F.col("max_position") <= 0.10).alias("position_ok"), (F.col("max_sector") <= 0.30).alias("sector_ok"), (F.col("n") >= 10).alias("count_ok"))


@query(f"WITH {POSITIONS}, a AS (SELECT * FROM positions WHERE sector <> 'BUILDING'), b AS (SELECT * FROM positions WHERE sector <> 'MACHINERY'), j AS (SELECT coalesce(a.book, b.book) AS book, coalesce(a.weight, 0) AS x, coalesce(b.weight, 0) AS y FROM a FULL OUTER JOIN b ON a.book = b.book AND a.security_id = b.security_id) SELECT book, round(0.5 * (sum(abs(x - y)) + abs(sum(x) - sum(y))), 6) AS turnover FROM j GROUP BY book")
def turnover(spark, d):
    """Half of the moved weights, cash included."""
    p = positions(spark, d)
    a, b = p.where("sector <> 'BUILDING'").select("book", "security_id", F.col("weight").alias("x")), p.where("sector <> 'MACHINERY'").select("book", "security_id", F.col("weight").alias("y"))
    j = a.join(b, ["book", "security_id"], "full_outer").fillna(0.0, ["x", "y"])
    return j.groupBy("book").agg(F.round(0.5 * (F.sum(F.abs(F.col("x") - F.col("y"))) + F.abs(F.sum("x") - F.sum("y"))), 6).alias("turnover"))


#: (scenario, sector it hits or none for all, return there, return elsewhere). Fixed values.
SCENARIOS = (("2008", None, -0.37, -0.37), ("1929", None, -0.58, -0.58), ("2020", None, -0.34, -0.34), ("2022", None, -0.18, -0.18), ("sector", "BUILDING", -0.40, -0.10))


@query(f"WITH {POSITIONS}, sc(scenario, sector, inside, outside) AS (VALUES " + ", ".join(f"('{n}', {'NULL' if s is None else repr(s)}, {i}::DOUBLE, {o}::DOUBLE)" for n, s, i, o in SCENARIOS) + ") SELECT book, scenario, round(sum(weight * CASE WHEN sc.sector IS NULL OR sc.sector = p.sector THEN inside ELSE outside END), 6) AS loss FROM positions p CROSS JOIN sc GROUP BY book, scenario")
def stress_fixed(spark, d):
    """Each scenario is one aggregate over one scan: scenarios are a short list, positions aren't repeated."""
    losses = [F.sum(F.col("weight") * (F.lit(i) if s is None else F.when(F.col("sector") == s, i).otherwise(o))).alias(n) for n, s, i, o in SCENARIOS]
    wide = positions(spark, d).groupBy("book").agg(*losses)
    return wide.unpivot("book", [n for n, *_ in SCENARIOS], "scenario", "loss").withColumn("loss", F.round("loss", 6))


@query(f"WITH {POSITIONS}, v AS (SELECT *, 0.2 + (security_id % 10) / 100.0 AS vol FROM positions), t AS (SELECT book, sqrt(0.85 * power(sum(weight * vol), 2) + 0.15 * sum(power(weight * vol, 2))) AS total, sum(weight * vol) AS flat FROM v GROUP BY book) SELECT v.book, v.security_id, round(weight * vol * (0.85 * flat + 0.15 * weight * vol) / total, 8) AS contribution FROM v JOIN t ON t.book = v.book")
def stress_euler(spark, d):
    """Contributions to volatility under one correlation: sums, where the pairwise form would need every pair."""
    v = positions(spark, d).withColumn("x", F.col("weight") * (0.2 + (F.col("security_id") % 10) / 100))
    t = v.groupBy("book").agg(F.sum("x").alias("flat"), F.sum(F.col("x") * F.col("x")).alias("own"))
    total = F.sqrt(0.85 * F.col("flat") * F.col("flat") + 0.15 * F.col("own"))
    return v.join(t, "book").select("book", "security_id", F.round(F.col("x") * (0.85 * F.col("flat") + 0.15 * F.col("x")) / total, 8).alias("contribution"))


# Quality, documents, graphs, books.

#: (check, table, severity, SQL predicate of a bad row).
CHECKS = (
    ("orders_bad_price", "orders", "error", "o_totalprice IS NULL OR o_totalprice <= 0"),
    ("orders_bad_status", "orders", "warning", "o_orderstatus NOT IN ('O', 'F', 'P')"),
    ("orders_future_date", "orders", "error", "o_orderdate > TIMESTAMP '2030-01-01 00:00:00'"),
    ("lineitem_bad_quantity", "lineitem", "error", "l_quantity IS NULL OR l_quantity <= 0"),
    ("lineitem_bad_discount", "lineitem", "warning", "l_discount < 0 OR l_discount > 0.09"),
    ("customer_negative_balance", "customer", "warning", "c_acctbal < 0"),
    ("part_missing_brand", "part", "error", "p_brand IS NULL OR trim(p_brand) = ''"),
    ("supplier_negative_balance", "supplier", "warning", "s_acctbal < 0"),
    ("events_null_value", "events", "error", "value IS NULL"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (WHERE {p}) AS n_bad, CASE WHEN count(*) FILTER (WHERE {p}) = 0 THEN 'ok' ELSE '{s}' END AS status FROM {t}" for n, t, s, p in CHECKS))
def quality_report(spark, d):
    """All checks of a table run in one scan of it."""
    parts = []
    for name in dict.fromkeys(t for _, t, _, _ in CHECKS):
        own = [c for c in CHECKS if c[1] == name]
        counted = read(spark, d, name).agg(*[F.count_if(F.expr(p)).alias(n) for n, _, _, p in own])
        severity = F.create_map(*[F.lit(x) for n, _, s, _ in own for x in (n, s)])
        parts.append(counted.unpivot([], [n for n, *_ in own], "name", "n_bad").select("name", "n_bad", F.when(F.col("n_bad") == 0, "ok").otherwise(F.element_at(severity, F.col("name"))).alias("status")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("SELECT event_id, k.key AS field, json_extract_string(props, '$.' || k.key) AS value FROM events, LATERAL (SELECT unnest(json_keys(props)) AS key) k WHERE props IS NOT NULL")
def json_each_unnest(spark, d):
    return read(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


@query("SELECT l_orderkey, l_linenumber, tenor, sum(v) AS value FROM (SELECT l_orderkey, l_linenumber, unnest(['discount', 'tax']) AS tenor, unnest([l_discount, l_tax]) AS v FROM lineitem) WHERE v BETWEEN 0 AND 100 GROUP BY ALL")
def unpivot_wide_to_long(spark, d):
    long = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "tenor", "v")
    return long.where(F.col("v").between(0, 100)).groupBy("l_orderkey", "l_linenumber", "tenor").agg(F.sum("v").alias("value"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS source, CASE WHEN n_nationkey = 22 THEN 2 ELSE n_nationkey + 5 END AS target, 1.0 + n_regionkey / 10.0 AS ratio FROM nation WHERE n_nationkey < 20 OR n_nationkey = 22), t AS (SELECT source AS origin, target, ratio::DOUBLE AS ratio, 1 AS depth, [source, target] AS seen FROM e UNION ALL SELECT t.origin, e.target, t.ratio * e.ratio, depth + 1, list_append(seen, e.target) FROM t JOIN e ON e.source = t.target WHERE NOT list_contains(seen, e.target)) SELECT origin, target, round(ratio, 6) AS ratio, depth FROM t")
def conversion_frontier(spark, d):
    """Conversions of conversions, ratios multiplied along the way, until the frontier is empty; one chain is a circle."""
    target = F.when(F.col("n_nationkey") == 22, 2).otherwise(F.col("n_nationkey") + 5)
    e = read(spark, d, "nation").where("n_nationkey < 20 OR n_nationkey = 22").select(F.col("n_nationkey").cast("long").alias("source"), target.cast("long").alias("target"), (1 + F.col("n_regionkey") / 10).cast("double").alias("ratio"))
    return asof.frontier(e).withColumn("ratio", F.round("ratio", 6))


@query("""WITH steps AS (SELECT o_orderkey AS source, o_custkey, lead(o_orderkey) OVER w AS target, 1 + o_orderkey % 3 / 10.0E0 AS ratio, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT a.source AS origin, b.target, round(product(m.ratio), 6) AS ratio, b.place - a.place + 1 AS depth FROM steps a JOIN steps b ON a.o_custkey = b.o_custkey AND a.place <= b.place AND b.target IS NOT NULL JOIN steps m ON m.o_custkey = a.o_custkey AND m.place BETWEEN a.place AND b.place GROUP BY a.source, b.target, a.place, b.place""")
def conversion_chains(spark, d):
    """Every order converts into its customer's next one: chains as long as a customer has orders, all of their ways."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = read(spark, d, "orders").select(F.col("o_orderkey").alias("source"), following.alias("target"), (1 + F.col("o_orderkey") % 3 / F.lit(10.0)).alias("ratio")).where("target IS NOT NULL")
    return asof.frontier(edges).withColumn("ratio", F.round("ratio", 6))

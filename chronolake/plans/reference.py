"""Queries of identities, calendars, lineage, writes and attestations on analogue tables, registered beside the catalogue's."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import asof, calendars, evidence, factors, facts, ingest, ranking
from .catalog import _DEDUPED, _MEMBER, _ROUTES, DAY, FACTS, MACRO, MEMBERS, PRICES, SPANS, D, assignments, day, deduped, fact_rows, macro, members, prices, query, read, spans
from .strategies import _BARS, bars

# As-of reads.

_GAPS = FACTS + ", gaps AS (SELECT * REPLACE (CASE WHEN CAST(floor(value) AS BIGINT) % 5 <> 0 THEN value END AS value) FROM facts)"


@query(f"WITH {_GAPS} SELECT issuer_id, metric, period_end, as_of_date, value FROM (SELECT *, row_number() OVER (PARTITION BY issuer_id, metric, period_end ORDER BY as_of_date DESC, value DESC NULLS LAST) AS r FROM gaps WHERE as_of_date <= DATE '{DAY}' AND period_end <= as_of_date AND metric IN ('A', 'R')) WHERE r = 1 AND value IS NOT NULL")
def pit_metrics(spark, d):
    """A restatement without a value withdraws its period."""
    gaps = fact_rows(spark, d).withColumn("value", F.when(F.floor("value") % 5 != 0, F.col("value")))
    return asof.known_history(gaps, ["issuer_id"], D, ["A", "R"], ties=["value"])


_SOURCED = MACRO + ", src AS (SELECT series_id, date, CASE WHEN event_id % 11 > 0 THEN date + CAST(event_id % 2 AS INT) END AS release_date, value, CASE event_id % 3 WHEN 0 THEN 'fred' WHEN 1 THEN 'treasury' ELSE 'export' END AS source, event_id AS fetched_at FROM macro)"


@query(f"WITH {_SOURCED} SELECT series_id, date, release_date, value, source FROM (SELECT *, row_number() OVER (PARTITION BY series_id, date ORDER BY release_date DESC, CASE source WHEN 'fred' THEN 0 WHEN 'treasury' THEN 1 ELSE 2 END, fetched_at DESC) AS r FROM src WHERE release_date <= DATE '2024-01-20' AND date <= DATE '2024-01-20') WHERE r = 1")
def macro_sources(spark, d):
    k = F.col("event_id")
    rows = macro(spark, d).select("series_id", "date", F.when(k % 11 > 0, F.date_add("date", (k % 2).cast("int"))).alias("release_date"), "value", F.when(k % 3 == 0, "fred").when(k % 3 == 1, "treasury").otherwise("export").alias("source"), k.alias("fetched_at"))
    return asof.macro_known(rows, date(2024, 1, 20)).drop("fetched_at")


#: Claims on securities: a window from each order, of a supplier's symbol.
_CLAIMS = """cl AS (SELECT o_custkey AS security_id, 'P' || o_custkey % 100 AS claimed, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 200 AS "end" FROM orders WHERE o_orderstatus = 'F')"""
_PATHS = f"""{_ROUTES}, {_CLAIMS}, rq AS (SELECT DISTINCT ticker FROM a), ow AS (SELECT ticker, count(DISTINCT security_id) AS n, min(security_id) AS security_id FROM a WHERE start <= DATE '{DAY}' AND "end" > DATE '{DAY}' GROUP BY ticker),
ac AS (SELECT security_id, count(DISTINCT claimed) AS n, min(claimed) AS one FROM cl WHERE start <= DATE '{DAY}' AND "end" > DATE '{DAY}' GROUP BY security_id),
j AS (SELECT rq.ticker, greatest(coalesce(ow.n, 0), coalesce(ac.n, 0)) AS n, ac.one, ow.n = 1 AND EXISTS (SELECT 1 FROM cl WHERE cl.security_id = ow.security_id) AS ever FROM rq LEFT JOIN ow ON ow.ticker = rq.ticker LEFT JOIN ac ON ac.security_id = ow.security_id AND ow.n = 1),
paths AS (SELECT ticker AS requested, CASE WHEN n > 1 THEN NULL WHEN one IS NOT NULL THEN 'claimed' WHEN NOT coalesce(ever, FALSE) THEN 'ticker' END AS kind, CASE WHEN n > 1 THEN NULL WHEN one IS NOT NULL THEN one WHEN NOT coalesce(ever, FALSE) THEN ticker END AS target, n AS n_targets FROM j)"""


def paths(spark, d):
    a = assignments(spark, d)
    claims = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("security_id"), F.concat(F.lit("P"), (F.col("o_custkey") % 100).cast("string")).alias("claimed"), day("o_orderdate").alias("start"), F.date_add(day("o_orderdate"), 200).alias("end"))
    return asof.identity_paths(a, a, claims, D, "claimed")


@query(f"WITH {_PATHS} SELECT * FROM paths")
def identity_paths(spark, d):
    return paths(spark, d)


_LABELLED = f"{_DEDUPED}, lab AS (SELECT *, 'P' || security_id % 100 AS symbol, (SELECT min(o_orderpriority) FROM orders) || security_id % 50 AS ticker FROM dd)"


def labelled(spark, d):
    first = read(spark, d, "orders").agg(F.min("o_orderpriority").alias("_p"))
    return deduped(spark, d).join(F.broadcast(first)).withColumns({"symbol": F.concat(F.lit("P"), (F.col("security_id") % 100).cast("string")), "ticker": F.concat("_p", (F.col("security_id") % 50).cast("string"))}).drop("_p")


_FOUND = "fo AS (SELECT requested, lab.* FROM paths JOIN lab ON kind = 'claimed' AND lab.symbol = target UNION ALL SELECT requested, lab.* FROM paths JOIN lab ON kind = 'ticker' AND lab.ticker = target)"


@query(f"WITH {_LABELLED}, {_PATHS}, {_FOUND} SELECT requested, date, close FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY date DESC, close DESC) AS r FROM fo) WHERE r = 1")
def latest_price_routed(spark, d):
    """Two equi-joins, by symbol and by ticker, never one join with OR."""
    found = asof.routed(labelled(spark, d), paths(spark, d).drop("n_targets"), {"claimed": "symbol", "ticker": "ticker"})
    return asof.first_per(found, ["requested"], asof.newest("date", "close")).select("requested", "date", "close")


@query(f"WITH {_LABELLED}, {_PATHS}, {_FOUND}, un AS (SELECT *, CASE WHEN close > 1000 THEN 2 ELSE 1 END AS priority FROM fo), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requested, date ORDER BY priority DESC, security_id DESC) AS k FROM un) WHERE k = 1) SELECT requested, date, close, priority FROM (SELECT *, row_number() OVER (PARTITION BY requested ORDER BY date DESC) AS r FROM one) WHERE r <= 15")
def price_windows_routed(spark, d):
    found = asof.routed(labelled(spark, d), paths(spark, d).drop("n_targets"), {"claimed": "symbol", "ticker": "ticker"})
    both = found.withColumn("priority", F.when(F.col("close") > 1000, 2).otherwise(1))
    return asof.last_bars(both, ["requested"], D, 15, fetched="security_id").select("requested", "date", "close", "priority")


@query(f"WITH {_BARS} SELECT max(date) AS date FROM bars WHERE actions_complete AND close_split_adjusted IS NOT NULL AND close > 50 AND date <= DATE '2024-01-25'")
def newest_reviewed_close(spark, d):
    return asof.newest_reviewed(bars(spark, d).withColumn("close", F.col("close") - 50), date(2024, 1, 25))


@query(f"WITH {MEMBERS}, s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), n AS (SELECT date, count(DISTINCT security_id) AS n FROM s JOIN members ON {_MEMBER.format(k='date', e='date')} GROUP BY date) SELECT max(date) AS date FROM n WHERE n BETWEEN (SELECT max(n) * 0.5 FROM n) AND (SELECT max(n) * 0.8 FROM n)")
def newest_decision_date(spark, d):
    sessions = read(spark, d, "orders").select(day("o_orderdate").alias("date")).distinct()
    m = members(spark, d)
    top = asof.members_by_date(sessions, m, "security_id").agg(F.max("n_members")).first()[0] or 0
    return asof.newest_decision(sessions, m, int(-(-top * 5 // 10)), int(top * 8 // 10), "security_id")


@query("SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderpriority) > 1 THEN 'more than one snapshot' END AS problem FROM orders WHERE o_orderstatus = 'F'")
def role_snapshots(spark, d):
    """A run's snapshots by role: one each, or the row says so."""
    linked = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", "o_orderkey")
    return asof.exactly_one(linked, ["o_custkey", "o_orderpriority"], "snapshot")


@query(f"""WITH {SPANS} SELECT security_id, start, "end" FROM spans WHERE status = 'F' AND start < DATE '{DAY}' + 90 AND ("end" IS NULL OR "end" > DATE '{DAY}')""")
def windows_meeting(spark, d):
    return asof.within(spans(spark, d), "start", "end", D, F.date_add(F.lit(D), 90), status="F", security_id=None).select("security_id", "start", "end")


@query(f"WITH {_BARS} SELECT security_id, count(*) FILTER (actions_complete IS NOT TRUE) AS n FROM (SELECT * REPLACE (CASE WHEN day(date) % 5 > 0 THEN actions_complete END AS actions_complete) FROM bars) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY security_id")
def unverified_by_security(spark, d):
    unsure = bars(spark, d).withColumn("actions_complete", F.when(F.dayofmonth("date") % 5 > 0, F.col("actions_complete")))
    return asof.unverified_actions(unsure, ["security_id"], date(2024, 1, 5), date(2024, 1, 20))


@query(f"WITH {_BARS} SELECT book, count(*) FILTER (actions_complete IS NOT TRUE) AS n FROM bars WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY book")
def unverified_by_label(spark, d):
    return asof.unverified_actions(bars(spark, d), ["book"], date(2024, 1, 5), date(2024, 1, 20))


_CONVERSIONS = "cv AS (SELECT o_orderkey, o_custkey AS source, CAST(o_orderdate AS DATE) AS effective_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) - 5 AS known_date, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'verified' END AS review_status FROM orders)"


@query(f"WITH {_CONVERSIONS} SELECT o_orderkey FROM cv WHERE review_status = 'verified' AND effective_date > DATE '{DAY}' AND effective_date <= DATE '{DAY}' + 200 AND known_date <= effective_date")
def conversions_in(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", day("o_orderdate").alias("effective_date"), F.date_add(day("o_orderdate"), (F.col("o_orderkey") % 7 - 5).cast("int")).alias("known_date"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("verified").alias("review_status"))
    return asof.conversions_between(o, D, F.date_add(F.lit(D), 200)).select("o_orderkey")


_LISTINGS = """ls AS (SELECT o_custkey AS security_id, o_orderpriority AS venue_id, o_orderkey, CAST(o_orderdate AS DATE) AS listed_start, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) + 500 END AS listed_end, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS known_at FROM orders)"""


@query(f"WITH {_LISTINGS} SELECT security_id, venue_id, listed_start FROM (SELECT *, row_number() OVER (PARTITION BY security_id, venue_id ORDER BY listed_start DESC) AS r FROM ls WHERE listed_start <= DATE '{DAY}' AND (listed_end IS NULL OR listed_end > DATE '{DAY}') AND known_at <= DATE '{DAY}' - 10) WHERE r = 1")
def active_listing(spark, d):
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.col("o_orderpriority").alias("venue_id"), day("o_orderdate").alias("listed_start"), F.when(k % 4 > 0, F.date_add(day("o_orderdate"), 500)).alias("listed_end"), F.date_add(day("o_orderdate"), (k % 60).cast("int")).alias("known_at"))
    return asof.active_listings(o, ["security_id", "venue_id"], D, F.date_sub(F.lit(D), 10)).select("security_id", "venue_id", "listed_start")


_RELABEL = f"""pr AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS provider, l_partkey % 300 AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem),
mp AS (SELECT s_suppkey % 20 AS provider, p_partkey % 300 AS symbol, p_partkey AS security_id, CASE WHEN p_size < 40 THEN 'verified' ELSE 'open' END AS mapping_status, DATE '1994-01-01' + CAST(p_partkey % 700 AS INT) AS start, CASE WHEN p_partkey % 3 > 0 THEN DATE '1997-01-01' + CAST(p_partkey % 900 AS INT) END AS "end" FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1 WHERE p_partkey <= 300),
asg AS (SELECT o_custkey AS security_id, lower(o_orderpriority) AS ticker, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 300 AS "end" FROM orders)"""


@query(f"""WITH {_RELABEL}, mx AS (SELECT pr.*, mp.security_id FROM pr JOIN mp ON mp.provider = pr.provider AND mp.symbol = pr.symbol WHERE mapping_status = 'verified' AND mp.start <= date AND (mp."end" IS NULL OR mp."end" > date)),
lb AS (SELECT s.security_id, s.date, count(DISTINCT upper(asg.ticker)) AS n, min(upper(asg.ticker)) AS one FROM (SELECT DISTINCT security_id, date FROM mx) s LEFT JOIN asg ON asg.security_id = s.security_id AND asg.start <= s.date AND asg."end" > s.date GROUP BY ALL)
SELECT l_orderkey, l_linenumber, mx.security_id, mx.date, CASE WHEN n = 1 THEN one END AS ticker, CASE WHEN n <> 1 THEN 'not exactly one ticker on the date' END AS problem FROM mx JOIN lb USING (security_id, date)""")
def relabelled_prices(spark, d):
    line, part = read(spark, d, "lineitem"), read(spark, d, "part").where("p_partkey <= 300")
    rows = line.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("provider"), (F.col("l_partkey") % 300).alias("provider_symbol"), day("l_shipdate").alias("date"))
    k = F.col("p_partkey")
    supplied = part.join(read(spark, d, "supplier"), F.col("s_suppkey") == k % 10 + 1)
    mapping = supplied.select((F.col("s_suppkey") % 20).alias("provider"), (k % 300).alias("provider_symbol"), k.alias("security_id"), F.when(F.col("p_size") < 40, "verified").otherwise("open").alias("mapping_status"), F.date_add(F.lit("1994-01-01").cast("date"), (k % 700).cast("int")).alias("start"), F.when(k % 3 > 0, F.date_add(F.lit("1997-01-01").cast("date"), (k % 900).cast("int"))).alias("end"))
    labels = read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.lower("o_orderpriority").alias("ticker"), day("o_orderdate").alias("start"), F.date_add(day("o_orderdate"), 300).alias("end"))
    return asof.relabelled(rows, mapping, labels).select("l_orderkey", "l_linenumber", "security_id", "date", "ticker", "problem")


_BASIS = "b AS (SELECT event_id, value AS close, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS adjusted, CASE event_id % 5 WHEN 0 THEN 2.0 WHEN 1 THEN 0.0 WHEN 2 THEN NULL ELSE 0.5 END AS factor FROM events)"


@query(f"WITH {_BASIS} SELECT event_id, round(CASE WHEN adjusted THEN CASE WHEN factor > 0 THEN close * factor END WHEN NOT adjusted THEN close END, 6) AS price, CASE WHEN event_id % 2 = 0 THEN close ELSE factor END AS metric FROM {{b}}".replace("{b}", "b"))
def price_on_basis(spark, d):
    k = F.col("event_id")
    e = read(spark, d, "events").select("event_id", F.col("value").alias("close"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("close_split_adjusted"), F.when(k % 5 == 0, 2.0).when(k % 5 == 1, 0.0).when(k % 5 == 2, None).otherwise(0.5).cast("double").alias("split_normalization_factor"))
    both = e.withColumns({"price": F.round(factors.contemporaneous_price(), 6), "quarter_value": F.col("close"), "value": F.col("split_normalization_factor")})
    return both.select("event_id", "price", factors.metric_value(k % 2 == 0).alias("metric"))


# Calendar.


@query("""WITH RECURSIVE y AS (SELECT unnest(range(1990, 2030)) AS y), g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM g),
l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l), e AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM m),
f AS (SELECT y, d, sat FROM y, (VALUES (1, 1, FALSE), (7, 4, TRUE), (12, 25, TRUE), (6, 19, TRUE)) v(mo, dy, sat), LATERAL (SELECT make_date(y, mo, dy) AS d) WHERE mo <> 6 OR y >= 2022),
o AS (SELECT CASE dayofweek(d) WHEN 0 THEN d + 1 WHEN 6 THEN CASE WHEN sat THEN d - 1 ELSE d END ELSE d END AS d FROM f),
n AS (SELECT d FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2029-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE (month(d) = 1 AND year(d) >= 1998 AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 2 AND dayofweek(d) = 1 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND dayofweek(d) = 1 AND day(d) >= 25) OR (month(d) = 9 AND dayofweek(d) = 1 AND day(d) <= 7) OR (month(d) = 11 AND dayofweek(d) = 4 AND day(d) BETWEEN 22 AND 28)),
ss AS MATERIALIZED (SELECT d FROM (SELECT CAST(unnest(generate_series(DATE '1990-06-01', DATE '2029-05-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND d NOT IN (SELECT easter - 2 FROM e) AND d NOT IN (SELECT d FROM o) AND d NOT IN (SELECT d FROM n) AND d NOT IN (""" + ", ".join(f"DATE '{x}'" for x in calendars.CLOSED) + """)),
td AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)
SELECT date, date IN (SELECT d FROM ss) AS is_session, (SELECT min(d) FROM ss WHERE d > date) AS next_session FROM td""")
def us_sessions(spark, d):
    """The days of orders and shipments: which are sessions, and the next one of each. The oracle finds Easter by another
    rule, and holidays by the days on which they can fall."""
    days = read(spark, d, "orders").select(day("o_orderdate").alias("date")).union(read(spark, d, "lineitem").select(day("l_shipdate").alias("date")))
    return calendars.placed(days.distinct())


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'soon' WHEN 1 THEN NULL WHEN 2 THEN 'x-' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) WHEN 3 THEN 'y-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(day, '^\\s*[+-]?[0-9]+\\s*-[^-]*-[^-]*$') THEN CAST(CAST(trim(split_part(day, '-', 1)) AS BIGINT) - 1 AS VARCHAR) || '-' || split_part(day, '-', 2) || '-' || split_part(day, '-', 3) ELSE day END AS before FROM t""")
def shifted_years(spark, d):
    text = day("o_orderdate").cast("string")
    told = F.when(F.col("o_orderkey") % 9 == 0, "soon").when(F.col("o_orderkey") % 9 == 1, None).when(F.col("o_orderkey") % 9 == 2, F.concat(F.lit("x-"), text)).when(F.col("o_orderkey") % 9 == 3, "y-01-01").otherwise(text)
    return read(spark, d, "orders").select("o_orderkey", facts.shift_year(told).alias("before"))


@query("""WITH f AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS sector, CASE WHEN c_custkey % 7 > 0 THEN c_custkey END AS id, CASE WHEN c_custkey % 5 > 0 THEN 1e6 END AS adv, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_acctbal IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY place) AS k FROM f WHERE id IS NOT NULL AND sector IS NOT NULL AND adv IS NOT NULL), s AS (SELECT c_custkey, place, row_number() OVER (ORDER BY place) AS rank FROM v WHERE k <= 4 QUALIFY rank <= 15)
SELECT f.c_custkey, s.rank, CASE WHEN s.rank IS NULL THEN CASE WHEN id IS NULL THEN 'no stable identity' WHEN sector IS NULL THEN 'no sector' WHEN adv IS NULL THEN 'too few liquid days' ELSE sector || ' limit reached' END END AS reason
FROM f LEFT JOIN s USING (c_custkey) WHERE s.rank IS NOT NULL OR f.place < (SELECT max(place) FROM s) OR (SELECT count(*) FROM s) < 15""")
def selection_reasons(spark, d):
    """What a capped selection of fifteen took, and why it passed over what came before its last pick."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(k % 11 > 0, F.col("c_mktsegment")).alias("sector"), F.when(k % 7 > 0, k).alias("id"), F.when(k % 5 > 0, 1e6).alias("adv"))
    lacking = {"no stable identity": F.col("id").isNull(), "no sector": F.col("sector").isNull(), "too few liquid days": F.col("adv").isNull()}
    return ranking.selection(rows, lacking, "sector", 4, 15, "c_acctbal", "c_custkey").select("c_custkey", "rank", "reason")


# Lineage, edges, batches, gaps.

_LINE = """fx AS (SELECT l_orderkey, l_linenumber, l_orderkey AS run_id, l_suppkey AS snapshot_id, l_partkey % 5 AS rowset, o_custkey AS subject_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
lg AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority < '4' THEN 'edgar:' ELSE 'other:' END || o_orderkey AS source, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'warning' ELSE 'failed' END AS status, o_orderkey % 9 AS n_rows, o_custkey AS subject_id FROM orders),
lk AS (SELECT DISTINCT l_orderkey AS run_id, l_suppkey AS snapshot_id, CASE WHEN l_linenumber < 5 THEN 'companyfacts' ELSE 'submissions' END AS role FROM lineitem),
sn AS (SELECT s_suppkey AS snapshot_id, CASE WHEN s_suppkey % 7 > 0 THEN 200 ELSE 404 END AS http_status, s_suppkey % 4 AS n_parsed, s_suppkey % 5 AS rowset FROM supplier)"""


@query(f"WITH {_LINE} SELECT l_orderkey, l_linenumber, status AS ingest_status FROM fx JOIN lg ON lg.run_id = fx.run_id AND lg.subject_id = fx.subject_id AND source LIKE 'edgar:%' AND status IN ('success', 'warning') AND n_rows > 0 JOIN lk ON lk.run_id = fx.run_id AND lk.snapshot_id = fx.snapshot_id AND role = 'companyfacts' JOIN sn ON sn.snapshot_id = lk.snapshot_id AND http_status BETWEEN 200 AND 299 AND n_parsed > 0 AND sn.rowset = fx.rowset")
def lineage_rows(spark, d):
    o, li, s = read(spark, d, "orders"), read(spark, d, "lineitem"), read(spark, d, "supplier")
    f = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("snapshot_id"), (F.col("l_partkey") % 5).alias("rowset"), F.col("o_custkey").alias("subject_id"))
    log = o.select(F.col("o_orderkey").alias("run_id"), F.concat(F.when(F.col("o_orderpriority") < "4", "edgar:").otherwise("other:"), "o_orderkey").alias("source"), F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "warning").otherwise("failed").alias("status"), (F.col("o_orderkey") % 9).alias("n_rows"), F.col("o_custkey").alias("subject_id"))
    links = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("snapshot_id"), F.when(F.col("l_linenumber") < 5, "companyfacts").otherwise("submissions").alias("role"))
    k = F.col("s_suppkey")
    snapshots = s.select(k.alias("snapshot_id"), F.when(k % 7 > 0, 200).otherwise(404).alias("http_status"), (k % 4).alias("n_parsed"), (k % 5).alias("rowset"))
    return evidence.lineage(f, log, links, snapshots, "companyfacts", "edgar:").select("l_orderkey", "l_linenumber", "ingest_status")


#: Edges of a list and of announcements a few days off; at most one of a kind within four days on either side, so greedy matching is nearest matching.
_EDGES = "ea AS (SELECT o_custkey AS key, min(CAST(o_orderdate AS DATE)) AS date FROM orders GROUP BY o_custkey, year(o_orderdate), quarter(o_orderdate)), eb AS (SELECT key, date + CAST(key % 9 AS INT) - 4 AS date FROM ea)"


@query(f"""WITH {_EDGES}, x AS (SELECT ea.key, ea.date AS e, eb.date AS a FROM ea FULL JOIN eb ON eb.key = ea.key AND eb.date = ea.date AND FALSE), ra AS (SELECT key, date, lag(date) OVER w AS p, lead(date) OVER w AS n FROM ea WINDOW w AS (PARTITION BY key ORDER BY date)), lone AS (SELECT key FROM ra GROUP BY key HAVING coalesce(min(n - date), 99) > 14),
g AS (SELECT ea.key, ea.date AS expected, CASE WHEN abs(ea.key % 9 - 4) <= 3 THEN ea.date + CAST(ea.key % 9 AS INT) - 4 END AS actual FROM ea WHERE key IN (SELECT key FROM lone) UNION ALL SELECT key, NULL, date FROM eb WHERE abs(key % 9 - 4) > 3 AND key IN (SELECT key FROM lone))
SELECT key, expected, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN expected = actual THEN 'equal' ELSE 'moved' END AS outcome FROM g""")
def matched_edges(spark, d):
    """Keys whose edges lie two weeks apart, where the nearest is the only one near."""
    a = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate"), F.quarter("o_orderdate")).agg(F.min(day("o_orderdate")).alias("date")).select("key", "date")
    gap = F.datediff(F.lead("date").over(asof.Window.partitionBy("key").orderBy("date")), F.col("date"))
    lone = a.withColumn("_gap", gap).groupBy("key").agg(F.coalesce(F.min("_gap"), F.lit(99)).alias("_least")).where("_least > 14").select("key")
    own = a.join(lone, "key")
    return ingest.matched_edges(own, own.withColumn("date", F.date_add("date", (F.col("key") % 9 - 4).cast("int"))), ["key"])


_BATCHED = "bt AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS action, 1 AS batch FROM orders WHERE o_orderpriority < '3' UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), o_orderstatus, 2 FROM orders WHERE o_orderpriority >= '3' OR o_totalprice > 300000)"


@query(f"WITH {_BATCHED} SELECT o_custkey, date, action, CASE WHEN count(*) OVER (PARTITION BY o_custkey, date, action) > 1 THEN 'event stands in the batches more than once' END AS problem FROM bt")
def merged_batches(spark, d):
    o = read(spark, d, "orders")
    of = lambda kept, n: o.where(kept).select("o_custkey", day("o_orderdate").alias("date"), F.col("o_orderstatus").alias("action"), F.lit(n).alias("batch"))
    return ingest.merged_batches(of("o_orderpriority < '3'", 1).unionByName(of("o_orderpriority >= '3' OR o_totalprice > 300000", 2)), ["o_custkey", "date", "action"])


_FIRST, _LAST = "1996-01-01", "1997-01-01"
_REFERENCE = f"""ra AS (SELECT 'T' || o_custkey AS ticker, o_custkey AS security_id, min(CAST(o_orderdate AS DATE)) AS start, CASE WHEN o_custkey % 4 > 0 THEN max(CAST(o_orderdate AS DATE)) + 1 END AS "end" FROM orders GROUP BY o_custkey),
ro AS (SELECT o_custkey AS security_id, o_custkey % 40 AS issuer_id, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 250 AS "end" FROM orders),
rc AS (SELECT n AS issuer_id, DATE '1995-01-01' + CAST(n * 9 AS INT) AS start, CASE WHEN n % 5 > 0 THEN DATE '1996-10-01' + CAST(n AS INT) END AS "end" FROM (SELECT unnest(range(40)) AS n)),
rp AS (SELECT o_custkey AS security_id, CASE WHEN o_orderstatus <> 'P' THEN 'verified' ELSE 'open' END AS mapping_status, CAST(o_orderdate AS DATE) - 30 AS start, CAST(o_orderdate AS DATE) + 120 AS "end" FROM orders)"""


@query(f"""WITH {_REFERENCE}, dd AS (SELECT CAST(unnest(generate_series(DATE '{_FIRST}', DATE '{_LAST}' - 1, INTERVAL 1 DAY)) AS DATE) AS day), asked AS (SELECT ticker, security_id, day FROM ra JOIN dd ON start <= day AND ("end" IS NULL OR "end" > day)),
co AS (SELECT DISTINCT ro.security_id, day FROM ro JOIN rc ON rc.issuer_id = ro.issuer_id JOIN dd ON ro.start <= day AND ro."end" > day AND rc.start <= day AND (rc."end" IS NULL OR rc."end" > day)), cp AS (SELECT DISTINCT security_id, day FROM rp JOIN dd ON start <= day AND "end" > day WHERE mapping_status = 'verified'),
miss AS (SELECT * FROM asked WHERE NOT EXISTS (SELECT 1 FROM co JOIN cp USING (security_id, day) WHERE co.security_id = asked.security_id AND co.day = asked.day)),
isl AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY security_id ORDER BY day) AS INT) AS k FROM miss), g AS (SELECT ticker, security_id, min(day) AS start, max(day) + 1 AS "end" FROM isl GROUP BY ticker, security_id, k)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY security_id) > 1 THEN 'several gaps in one assignment' END AS problem FROM g""")
def reference_gaps(spark, d):
    """The oracle counts days; the operator sweeps boundaries."""
    o, when = read(spark, d, "orders"), day("o_orderdate")
    key = F.col("o_custkey")
    assigned = o.groupBy("o_custkey").agg(F.min(when).alias("start"), F.max(when).alias("_last")).select(F.concat(F.lit("T"), key.cast("string")).alias("ticker"), key.alias("security_id"), "start", F.when(key % 4 > 0, F.date_add("_last", 1)).alias("end"))
    owners = o.select(key.alias("security_id"), (key % 40).alias("issuer_id"), when.alias("start"), F.date_add(when, 250).alias("end"))
    n = F.col("id")
    ciks = spark.range(40).select(n.alias("issuer_id"), F.date_add(F.lit("1995-01-01").cast("date"), (n * 9).cast("int")).alias("start"), F.when(n % 5 > 0, F.date_add(F.lit("1996-10-01").cast("date"), n.cast("int"))).alias("end"))
    providers = o.select(key.alias("security_id"), F.when(F.col("o_orderstatus") != "P", "verified").otherwise("open").alias("mapping_status"), F.date_sub(when, 30).alias("start"), F.date_add(when, 120).alias("end"))
    return ingest.reference_gaps(assigned, owners, ciks, providers, _FIRST, _LAST)


@query("SELECT 'left' AS side, o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'both', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def member_sets(spark, d):
    a, b = (read(spark, d, "orders").where(F.col("o_orderstatus") == s).select("o_custkey") for s in "FP")
    return a.subtract(b).select(F.lit("left").alias("side"), "o_custkey").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "o_custkey"))


# Ingestion rules.

_ACTIONS = """fa AS (SELECT l_orderkey, l_linenumber, l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_quantity > 40 THEN 0.5E0 WHEN l_quantity > 35 THEN 2.0E0 ELSE 1.0E0 END AS factor FROM lineitem),
rv AS (SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS date, 0.5E0 AS factor, min(l_tax) + 0.5E0 AS legal, min(l_linenumber) < 4 AS complete FROM lineitem WHERE l_quantity > 38 GROUP BY ALL)"""


@query(f"WITH {_ACTIONS} SELECT l_orderkey, l_linenumber, fa.factor, CASE WHEN fa.factor = 1 THEN 'none reported' WHEN rv.factor IS NULL THEN 'not reviewed' WHEN rv.factor <> fa.factor THEN 'another factor' WHEN complete THEN 'reviewed' ELSE 'reviewed, incomplete' END AS review, CASE WHEN fa.factor <> 1 AND rv.factor = fa.factor THEN legal ELSE 1.0E0 END AS split_ratio, fa.factor = 1 OR coalesce(rv.factor = fa.factor AND complete, FALSE) AS actions_complete FROM fa LEFT JOIN rv ON rv.security_id = fa.security_id AND rv.date = fa.date")
def reviewed_actions(spark, d):
    li = read(spark, d, "lineitem").withColumns({"provider": F.lit("p"), "provider_symbol": F.lit("s"), "security_id": F.col("l_suppkey"), "date": day("l_shipdate")})
    keys = ["provider", "provider_symbol", "security_id", "date"]
    factor = F.when(F.col("l_quantity") > 40, 0.5).when(F.col("l_quantity") > 35, 2.0).otherwise(1.0)
    reviews = li.where("l_quantity > 38").groupBy(*keys).agg(F.lit(0.5).alias("factor"), (F.min("l_tax") + 0.5).alias("legal_ratio"), (F.min("l_linenumber") < 4).alias("complete"))
    return ingest.reviewed_actions(li.select("l_orderkey", "l_linenumber", *keys, factor.alias("factor")), reviews).select("l_orderkey", "l_linenumber", "factor", "review", "split_ratio", "actions_complete")


_TRANSITIONS = "tr AS (SELECT 'T' || n_nationkey AS a, 'T' || (n_nationkey + 8) AS b, 'S' || n_nationkey % 8 AS security_id, CASE WHEN n_nationkey < 20 THEN 'rename' ELSE 'merger' END AS kind FROM nation WHERE n_regionkey < 3), mb AS (SELECT 'T' || o_custkey % 60 AS ticker, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) * 2 + 1 AS \"end\", CAST(o_orderdate AS DATE) - 1 AS known, o_orderkey FROM orders)"


@query(f"""WITH {_TRANSITIONS}, nm AS (SELECT ticker, count(DISTINCT security_id) AS n, count(DISTINCT kind) AS k, min(security_id) AS s, min(kind) AS kind FROM (SELECT a AS ticker, security_id, kind FROM tr UNION ALL SELECT b, security_id, kind FROM tr) GROUP BY ticker),
jn AS (SELECT mb.*, coalesce(s, 'own:' || lower(mb.ticker)) AS security_id, coalesce(nm.kind, 'bounded ticker') AS status, n, k FROM mb LEFT JOIN nm ON nm.ticker = mb.ticker), ov AS (SELECT *, max("end") OVER (PARTITION BY security_id ORDER BY start, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start AS over FROM jn)
SELECT security_id, status, count(*) AS n_rows, count(*) FILTER (n > 1 OR k > 1) AS n_contradicting FROM ov GROUP BY ALL""")
def identity_assignment(spark, d):
    """Counted by security, since several memberships of one ticker may begin on one day."""
    t = read(spark, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("T"), "n_nationkey").alias("from_ticker"), F.concat(F.lit("T"), F.col("n_nationkey") + 8).alias("to_ticker"), F.concat(F.lit("S"), F.col("n_nationkey") % 8).alias("security_id"), F.when(F.col("n_nationkey") < 20, "rename").otherwise("merger").alias("kind"))
    when, k = day("o_orderdate"), F.col("o_orderkey")
    m = read(spark, d, "orders").select(F.concat(F.lit("T"), F.col("o_custkey") % 60).alias("ticker"), when.alias("start"), F.date_add(when, (k % 3 * 2 + 1).cast("int")).alias("end"), F.date_sub(when, 1).alias("known"))
    done = ingest.identity_assignments(m, t, "own:")
    return done.groupBy("security_id", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("problem").startswith("several")).alias("n_contradicting"))


@query("SELECT DISTINCT event_type AS series_id, CAST(ts AS DATE) AS vintage FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def bounded_vintages(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("series_id"), day("ts").alias("vintage"))
    lit = lambda x: F.lit(x).cast("date")
    return ingest.bounded_vintages(rows, lit("2024-01-05"), lit("2024-02-20"), lit("2024-01-20"))


@query(f"""WITH {MEMBERS}, mp AS (SELECT o_custkey AS security_id, o_orderpriority AS provider, CAST(o_orderdate AS DATE) - 100 AS start, CAST(o_orderdate AS DATE) + 100 AS "end", o_orderstatus FROM orders),
j AS (SELECT m.security_id, provider FROM members m JOIN mp ON mp.security_id = m.security_id AND o_orderstatus <> 'P' AND mp.start <= DATE '{DAY}' AND mp."end" > DATE '{DAY}' WHERE m.known <= DATE '{DAY}' AND m.start <= DATE '{DAY}' AND (m."end" IS NULL OR m."end" > DATE '{DAY}' OR m.end_known > DATE '{DAY}'))
SELECT security_id, provider, CASE WHEN count(*) OVER (PARTITION BY security_id) > 1 THEN 'more than one verified mapping' END AS problem FROM j""")
def warmup_candidates(spark, d):
    when = day("o_orderdate")
    mappings = read(spark, d, "orders").select(F.col("o_custkey").alias("security_id"), F.col("o_orderpriority").alias("provider"), F.lit("s").alias("provider_symbol"), F.when(F.col("o_orderstatus") != "P", "verified").otherwise("open").alias("mapping_status"), F.date_sub(when, 100).alias("start"), F.date_add(when, 100).alias("end"))
    return ingest.warmup_candidates(members(spark, d).withColumn("ticker", F.lit("t")), mappings, F.lit(D)).select("security_id", "provider", "problem")


@query("SELECT DISTINCT a.o_orderkey, 'key belongs to another owner' AS problem FROM orders a JOIN (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_custkey + 1 ELSE o_custkey END AS c FROM orders) b ON a.o_orderkey = b.o_orderkey WHERE a.o_custkey <> b.c")
def owner_conflicts(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    arrived = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return ingest.owner_conflicts(o, arrived, ["o_orderkey"], "o_custkey")


# Writes that validate.

_MERGED = f"""st AS (SELECT 'u' AS universe_id, 'T' || o_custkey AS ticker, CAST(NULL AS VARCHAR) AS security_id, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS "end", CAST(min(o_orderdate) AS DATE) - 1 AS known, CAST(min(o_orderdate) AS DATE) AS end_known FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
ar AS (SELECT 'u' AS universe_id, 'T' || o_custkey AS ticker, 'S' || o_custkey AS security_id, max(CAST(o_orderdate AS DATE)) AS start, CASE WHEN o_custkey % 3 > 0 THEN max(CAST(o_orderdate AS DATE)) + CAST(o_custkey % 5 AS INT) END AS "end", max(CAST(o_orderdate AS DATE)) - CAST(o_custkey % 4 AS INT) + 1 AS known, CASE WHEN o_custkey % 7 = 0 THEN max(CAST(o_orderdate AS DATE)) END AS end_known FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)"""


@query(f"""WITH {_MERGED}, ax AS (SELECT * REPLACE (coalesce(end_known, CASE WHEN "end" IS NOT NULL THEN known END) AS end_known) FROM ar), mg AS (SELECT universe_id, ticker, CASE WHEN ax.ticker IS NOT NULL THEN coalesce(ax.security_id, st.security_id) ELSE st.security_id END AS security_id, start, CASE WHEN ax.known IS NOT NULL THEN ax."end" ELSE st."end" END AS "end", coalesce(ax.known, st.known) AS known, CASE WHEN ax.known IS NOT NULL THEN ax.end_known ELSE st.end_known END AS end_known FROM st FULL JOIN ax USING (universe_id, ticker, start))
SELECT ticker, security_id, start, "end", end_known, CASE WHEN known > start THEN 'known after its start' WHEN "end" <= start THEN 'end does not follow the start' WHEN "end" IS NULL AND end_known IS NOT NULL THEN 'open, but its end is known' WHEN end_known < known OR end_known > "end" THEN 'end known out of turn'
  WHEN row_number() OVER w > 1 AND (lag("end") OVER w IS NULL OR lag("end") OVER w > start) THEN 'overlaps the interval before' END AS problem FROM mg WINDOW w AS (PARTITION BY universe_id, ticker ORDER BY start)""")
def membership_rows(spark, d):
    o, key, when = read(spark, d, "orders"), F.col("o_custkey"), day("o_orderdate")
    named = lambda kept: o.where(kept).groupBy("o_custkey").agg(F.min(when).alias("a"), F.max(when).alias("b"))
    label = (F.lit("u").alias("universe_id"), F.concat(F.lit("T"), key.cast("string")).alias("ticker"))
    stored = named("o_orderstatus = 'F'").select(*label, F.lit(None).cast("string").alias("security_id"), F.col("a").alias("start"), F.col("b").alias("end"), F.date_sub("a", 1).alias("known"), F.col("a").alias("end_known"))
    arrived = named("o_orderstatus <> 'P'").select(*label, F.concat(F.lit("S"), key.cast("string")).alias("security_id"), F.col("b").alias("start"), F.when(key % 3 > 0, F.date_add("b", (key % 5).cast("int"))).alias("end"), F.date_sub("b", (key % 4 - 1).cast("int")).alias("known"), F.when(key % 7 == 0, F.col("b")).alias("end_known"))
    return ingest.membership_rows(arrived, stored).select("ticker", "security_id", "start", "end", "end_known", "problem")


_CONVERTED = """nw AS (SELECT p_partkey AS source_security_id, CASE WHEN p_size = 50 THEN p_partkey ELSE p_partkey + 150 END AS target_security_id, DATE '1996-01-01' + p_size AS effective_date, DATE '1996-01-20' AS known_date, CASE WHEN p_size % 10 = 9 THEN 0.0E0 ELSE p_size / 10.0E0 END AS share_ratio, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 'step-up' ELSE 'carryover' END AS basis_policy, 'verified' AS review_status, DATE '2020-01-01' AS verified_date FROM part),
od AS (SELECT p_partkey AS source_security_id, p_partkey + 150 AS target_security_id, DATE '1996-01-01' + p_size AS effective_date, DATE '1996-01-20' AS known_date, p_size / 10.0E0 + CASE WHEN p_size % 8 = 0 THEN 1 ELSE 0 END AS share_ratio, 'carryover' AS basis_policy, 'verified' AS review_status FROM part WHERE p_size < 35)"""


@query(f"""WITH {_CONVERTED} SELECT nw.source_security_id, CASE WHEN nw.source_security_id = nw.target_security_id THEN 'converts into itself' WHEN nw.known_date > nw.effective_date THEN 'known after it is effective' WHEN nw.share_ratio <= 0 THEN 'ratio is not positive' WHEN nw.basis_policy <> 'carryover' THEN 'unknown basis policy'
  WHEN nw.target_security_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown security' WHEN od.source_security_id IS NOT NULL AND (od.target_security_id <> nw.target_security_id OR od.share_ratio <> nw.share_ratio OR od.basis_policy <> nw.basis_policy) THEN 'stored conversion says otherwise' END AS problem FROM nw LEFT JOIN od USING (source_security_id)""")
def conversion_rows(spark, d):
    p, k, size = read(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    first = p.agg(F.min("p_brand").alias("_b"))
    effective = F.date_add(F.lit("1996-01-01").cast("date"), size.cast("int")).alias("effective_date")
    rest = (F.lit("1996-01-20").cast("date").alias("known_date"),)
    arrived = p.join(F.broadcast(first)).select(k.alias("source_security_id"), F.when(size == 50, k).otherwise(k + 150).alias("target_security_id"), effective, *rest, F.when(size % 10 == 9, 0.0).otherwise(size / 10).alias("share_ratio"), F.when(F.col("p_brand") == F.col("_b"), "step-up").otherwise("carryover").alias("basis_policy"), F.lit("verified").alias("review_status"), F.lit("2020-01-01").cast("date").alias("verified_date"))
    stored = p.where("p_size < 35").select(k.alias("source_security_id"), (k + 150).alias("target_security_id"), effective, *rest, (size / 10 + F.when(size % 8 == 0, 1).otherwise(0)).alias("share_ratio"), F.lit("carryover").alias("basis_policy"), F.lit("verified").alias("review_status"))
    return ingest.conversion_rows(arrived, stored, p.select(k.alias("security_id")), F.lit("2021-01-01").cast("date")).select("source_security_id", "problem")


@query(f"WITH {FACTS} SELECT CASE WHEN period_end > as_of_date THEN 'period ends after it was known' ELSE 'stays' END AS fate, count(*) AS n FROM facts GROUP BY 1")
def quarantine(spark, d):
    stays, goes = ingest.quarantined(fact_rows(spark, d), F.col("period_end") > F.col("as_of_date"), "period ends after it was known")
    return stays.withColumn("fate", F.lit("stays")).select("fate").unionByName(goes.select(F.col("quarantine_reason").alias("fate"))).groupBy("fate").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SOURCED} SELECT series_id, date, count(*) AS n FROM src a WHERE release_date IS NULL AND NOT EXISTS (SELECT 1 FROM src b WHERE b.series_id = a.series_id AND b.date = a.date AND b.release_date IS NOT NULL AND b.fetched_at % 70 = 0) GROUP BY ALL")
def uncovered_legacy(spark, d):
    rows = macro(spark, d).withColumn("release_date", F.when(F.col("event_id") % 11 > 0, F.col("date")))
    left = ingest.uncovered_legacy(rows, F.col("release_date").isNull(), ["series_id", "date"], F.col("release_date").isNotNull() & (F.col("event_id") % 70 == 0))
    return left.groupBy("series_id", "date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, TRUE AS is_deleted FROM events WHERE event_type = 'error'")
def tombstones(spark, d):
    return ingest.tombstones(read(spark, d, "events"), F.col("event_type") == "error").select("event_id", "is_deleted")


# Attestations and summaries.

_JSON = """js AS (SELECT o_custkey, to_json(struct_pack(review := struct_pack(status := CASE WHEN o_custkey % 3 = 0 THEN 'open' ELSE 'verified' END), through := CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR), members := list(o_orderpriority ORDER BY o_orderkey))) AS doc, max(CAST(o_orderdate AS DATE)) + CAST(o_custkey % 12 AS INT) - 2 AS checked FROM orders GROUP BY o_custkey)"""


def attestations(spark, d):
    """A JSON document for each customer, and the day on which it was checked."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(day("o_orderdate")).alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("members"))
    status = F.when(F.col("o_custkey") % 3 == 0, "open").otherwise("verified")
    doc = F.to_json(F.struct(F.struct(status.alias("status")).alias("review"), F.col("last").cast("string").alias("through"), "members"))
    return o.select("o_custkey", doc.alias("doc"), F.date_add("last", (F.col("o_custkey") % 12 - 2).cast("int")).alias("checked"))


@query(f"WITH {_JSON} SELECT o_custkey, json_extract_string(doc, '$.review.status') AS status, CAST(json_extract_string(doc, '$.through') AS DATE) AS through, checked - CAST(json_extract_string(doc, '$.through') AS DATE) BETWEEN 0 AND 7 AS fresh, sha256(to_json(list_sort(CAST(json_extract(doc, '$.members') AS VARCHAR[])))) AS digest FROM js")
def attested(spark, d):
    doc = F.col("doc")
    through = evidence.text_at(doc, "through").cast("date")
    return attestations(spark, d).select("o_custkey", evidence.text_at(doc, "review", "status").alias("status"), through.alias("through"), F.datediff("checked", through).between(0, 7).alias("fresh"), evidence.list_digest(evidence.listed_at(doc, "members")).alias("digest"))


@query(f"WITH {_JSON} SELECT DISTINCT o_custkey, o_orderpriority AS missing FROM (SELECT DISTINCT o_custkey FROM orders) c, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM (SELECT js.o_custkey, unnest(CAST(json_extract(doc, '$.members') AS VARCHAR[])) AS m FROM js) x WHERE x.o_custkey = c.o_custkey AND x.m = o_orderpriority)")
def unlisted(spark, d):
    """What no document lists: an anti join with the unnested lists. The priorities are a handful, broadcast."""
    listed = attestations(spark, d).select("o_custkey", F.explode(evidence.listed_at(F.col("doc"), "members")).alias("missing"))
    kinds = read(spark, d, "orders").select(F.col("o_orderpriority").alias("missing")).distinct()
    everyone = read(spark, d, "orders").select("o_custkey").distinct().join(asof.few(kinds), F.lit(True))
    return everyone.join(listed, ["o_custkey", "missing"], "left_anti")


@query("SELECT c_custkey, sha256('{\"a\":' || to_json(c_mktsegment) || ',\"b\":{\"x\":' || c_nationkey || ',\"y\":' || coalesce(to_json(CASE WHEN c_custkey % 2 = 0 THEN c_name END), 'null') || '}}') AS digest FROM customer")
def canonical_digest(spark, d):
    """Fields in any order give one digest; a null is written as one."""
    inner = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("y"), F.col("c_nationkey").alias("x"))
    rows = read(spark, d, "customer").select("c_custkey", F.struct(inner.alias("b"), F.col("c_mktsegment").alias("a")).alias("v"))
    return rows.select("c_custkey", evidence.canonical_digest(F.col("v"), rows.schema["v"].dataType).alias("digest"))


@query("SELECT p_partkey, CASE WHEN n BETWEEN 100 AND 999 THEN 'Agriculture, forestry and fishing' WHEN n BETWEEN 1000 AND 1499 THEN 'Mining' WHEN n BETWEEN 1500 AND 1799 THEN 'Construction' WHEN n BETWEEN 2000 AND 3999 THEN 'Manufacturing' WHEN n BETWEEN 4000 AND 4999 THEN 'Transport, communications and utilities' WHEN n BETWEEN 5000 AND 5199 THEN 'Wholesale trade' WHEN n BETWEEN 5200 AND 5999 THEN 'Retail trade' WHEN n BETWEEN 6000 AND 6799 THEN 'Finance, insurance and real estate' WHEN n BETWEEN 7000 AND 8999 THEN 'Services' WHEN n BETWEEN 9100 AND 9729 THEN 'Public administration' WHEN n BETWEEN 9900 AND 9999 THEN 'Nonclassifiable establishments' END AS division, n // 100 IN (60, 61, 64) AND n >= 1000 OR n // 10 IN (60, 61, 64) AND n < 1000 AND n >= 100 OR n IN (60, 61, 64) AS financial FROM (SELECT p_partkey, p_partkey * 37 % 10000 AS n FROM part)")
def industry(spark, d):
    code = F.concat(F.lit("Industry / "), (F.col("p_partkey") * 37 % 10000).cast("string"))
    return read(spark, d, "part").select("p_partkey", evidence.division(code).alias("division"), evidence.is_financial(code).alias("financial"))


@query("SELECT event_type AS dataset, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")
def retained_evidence(spark, d):
    return evidence.retained(read(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("ts").alias("received_at")))


_CASES = "cs AS (SELECT user_id AS case_id, event_id AS sequence, CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'deferred' ELSE 'resolved' END AS state, event_id % 3 AS severity_rank, 'user' AS subject_type, user_id % 40 AS subject_id, event_type FROM events), la AS (SELECT *, max(severity_rank) OVER (PARTITION BY case_id) AS top FROM cs QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY sequence DESC) = 1)"


@query(f"WITH {_CASES} SELECT event_type, count(*) FILTER (state = 'open') AS n_open, count(*) FILTER (state = 'acknowledged') AS n_acknowledged, count(*) FILTER (state = 'deferred') AS n_deferred, count(*) FILTER (state = 'resolved') AS n_resolved, count(*) FILTER (state <> 'resolved') AS n_unresolved, count(*) FILTER (state <> 'resolved' AND top = 2) AS n_critical_unresolved, count(*) FILTER (state <> 'resolved' AND top = 1) AS n_high_unresolved, count(DISTINCT subject_id) FILTER (state <> 'resolved') AS n_subjects, count(*) AS n FROM la GROUP BY event_type")
def case_summary(spark, d):
    k = F.col("event_id")
    state = F.when(k % 4 == 0, "open").when(k % 4 == 1, "acknowledged").when(k % 4 == 2, "deferred").otherwise("resolved")
    events = read(spark, d, "events").select(F.col("user_id").alias("case_id"), k.alias("sequence"), state.alias("state"), (k % 3).alias("severity_rank"), F.lit("user").alias("subject_type"), (F.col("user_id") % 40).alias("subject_id"), "event_type")
    last = evidence.latest_state(events).withColumn("severity", F.when(F.col("severity_rank") == 2, "critical").when(F.col("severity_rank") == 1, "high").otherwise("medium"))
    return evidence.case_counts(last, ["event_type"])

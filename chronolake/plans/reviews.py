"""Queries of detectors as specified, of the stress bundle, and of backtest periods, registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, backtest, detectors, risk
from .catalog import _QUARTERS, DAY, FACTS, POSITIONS, D, day, decisions, fact_rows, positions, query, read
from .strategies import _BARS, _finding_sql, bars

# Detectors.


@query(
    f"WITH {_BARS}, w AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS r FROM bars WHERE date <= DATE '2024-01-28'), l AS (SELECT *, count(*) OVER (PARTITION BY security_id) AS n, lag(close) OVER (PARTITION BY security_id ORDER BY date) AS before FROM w WHERE r <= 10), "
    "x AS (SELECT *, CASE WHEN day(date) % 3 = 0 THEN 0 ELSE dividends END AS dv FROM l WHERE n > 1), b AS (SELECT *, count(*) FILTER (actions_complete IS NOT TRUE OR close <= 0) OVER (PARTITION BY security_id) AS bad FROM x) "
    + _finding_sql("price_action_mismatch", "security_session", "security_id || '@' || date", "CASE WHEN abs(close / before - 1) >= 0.5 THEN 'high' ELSE 'medium' END", "before", "close", "b WHERE bad = 0 AND abs(close / before - 1) >= 0.25 AND split_ratio = 1 AND dv = 0")
    + " UNION ALL "
    + _finding_sql("price_action_mismatch", "security", "CAST(security_id AS VARCHAR)", "'withheld'", "0", "max(bad)", "b WHERE bad > 0 GROUP BY security_id")
)
def price_action_mismatch(spark, d):
    judged = bars(spark, d).withColumn("dividends", F.when(F.dayofmonth("date") % 3 == 0, 0.0).otherwise(F.col("dividends")))
    return detectors.unexplained_moves(judged, F.lit("2024-01-28").cast("date"), n=10)


_SHARES = FACTS + ", sh AS (SELECT DISTINCT issuer_id, period_end, as_of_date, CASE WHEN CAST(floor(value) AS BIGINT) % 97 = 0 THEN 0 ELSE value END AS value FROM facts WHERE period_end <= as_of_date AND as_of_date <= DATE '1997-06-30')"
_AT = "issuer_id || '@' || period_end || '#' || as_of_date"


@query(
    f"WITH {_SHARES}, rc AS (SELECT *, dense_rank() OVER (PARTITION BY issuer_id ORDER BY as_of_date DESC) AS v FROM sh), re AS (SELECT *, count(*) OVER (PARTITION BY issuer_id) AS n FROM rc WHERE v <= 8), "
    "ok AS (SELECT * FROM re WHERE n > 1 AND value > 0), one AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY issuer_id, as_of_date ORDER BY period_end DESC, value) = 1), "
    "a AS (SELECT *, lag(value) OVER (PARTITION BY issuer_id ORDER BY as_of_date) AS before FROM one), b AS (SELECT *, lag(value) OVER (PARTITION BY issuer_id, as_of_date ORDER BY period_end, value) AS before FROM ok) "
    + " UNION ALL ".join(
        [
            _finding_sql("share_count_jump", "share_count", _AT, "'high'", "NULL", "value", "re WHERE n > 1 AND value <= 0"),
            _finding_sql("share_count_jump", "inter_vintage", _AT, "'high'", "before", "value", "a WHERE abs(value / before - 1) >= 0.3"),
            _finding_sql("share_count_jump", "intra_vintage", _AT, "'high'", "before", "value", "b WHERE abs(value / before - 1) >= 0.3"),
        ]
    )
)
def share_count_jump(spark, d):
    shares = fact_rows(spark, d).withColumn("value", F.when(F.floor("value") % 97 == 0, 0.0).otherwise(F.col("value")))
    return detectors.share_jumps(shares, F.lit("1997-06-30").cast("date"))


@query(f"WITH {FACTS}, ff AS (SELECT issuer_id, metric, date_trunc('quarter', period_end)::DATE AS period_end, date_trunc('month', as_of_date)::DATE + 27 AS as_of_date, value FROM facts) " + _finding_sql("conflicting_filings", "issuer_metric_period", "issuer_id || ':' || metric || '@' || period_end || '#' || as_of_date", "'high'", "1", "count(DISTINCT value)", f"ff WHERE period_end <= as_of_date AND as_of_date <= DATE '{DAY}' AND issuer_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY issuer_id, metric, period_end, as_of_date HAVING count(DISTINCT value) > 1"))
def conflicting_filings(spark, d):
    filed = fact_rows(spark, d).withColumns({"period_end": F.trunc("period_end", "quarter"), "as_of_date": F.date_add(F.trunc("as_of_date", "month"), 27)})
    members = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("issuer_id"))
    return detectors.conflicting_filings(filed, members, F.lit(D))


@query(
    f"WITH {FACTS}, ru AS (SELECT issuer_id, as_of_date, period_end, CAST(floor(value) AS BIGINT) % 3 AS run_id FROM facts WHERE as_of_date <= DATE '1995-03-31' AND period_end <= as_of_date), k AS (SELECT count(*) AS n, count(*) FILTER (c_custkey IN (SELECT issuer_id FROM ru WHERE run_id = 1)) AS known FROM customer) "
    + _finding_sql("fundamentals_coverage", "issuer", "CAST(c_custkey AS VARCHAR)", "CASE WHEN c_custkey IN (SELECT issuer_id FROM ru) THEN 'unverified' ELSE 'missing' END", "1", "0", "customer, k WHERE known > 0 AND c_custkey NOT IN (SELECT issuer_id FROM ru WHERE run_id = 1)")
    + " UNION ALL "
    + _finding_sql("fundamentals_coverage", "source", "'all'", "'high'", "n", "0", "k WHERE known = 0")
)
def fundamentals_coverage(spark, d):
    filed = fact_rows(spark, d).withColumn("run_id", F.floor("value") % 3)
    accepted = spark.range(1, 2).select(F.col("id").alias("run_id"))
    members = read(spark, d, "customer").select(F.col("c_custkey").alias("issuer_id"), F.col("c_name").alias("ticker"))
    return detectors.fundamentals_coverage(members, filed, accepted, F.lit("1995-03-31").cast("date"))


# Stress.

_STRESSED = f"{POSITIONS}, ps AS (SELECT book, security_id, 'T' || security_id AS ticker, CASE WHEN book % 5 > 0 OR security_id % 31 > 0 THEN sector END AS sector, weight, security_id % 3 AS rank, CASE WHEN book % 7 > 0 OR security_id % 37 > 0 THEN 1e6 * (1 + security_id % 9) END AS adv FROM positions), bl AS (SELECT book, string_agg(x, ',' ORDER BY x) AS blockers FROM (SELECT book, ticker || ':sector' AS x FROM ps WHERE sector IS NULL UNION ALL SELECT book, ticker || ':liquidity' FROM ps WHERE adv IS NULL) GROUP BY book)"
_EQUITY = 5e7


def stressed(spark, d):
    k, book = F.col("security_id"), F.col("book")
    return positions(spark, d).withColumns({"ticker": F.concat(F.lit("T"), k.cast("string")), "sector": F.when((book % 5 > 0) | (k % 31 > 0), F.col("sector")), "rank": k % 3, "adv": F.when((book % 7 > 0) | (k % 37 > 0), 1e6 * (1 + k % 9))})


def _scenario_sql(s: risk.Scenario) -> str:
    late = f"count(*) FILTER (weight * (1 + {s.others}) * {_EQUITY}::DOUBLE / (adv * {s.adv_share} * {risk.EXIT_SHARE}) > {s.sessions})"
    if s.kind == "sector":
        return f"SELECT book, '{s.name}:' || coalesce(x.sector, '') AS scenario, sum(weight * CASE WHEN p.sector IS NOT DISTINCT FROM x.sector THEN {s.chosen} ELSE {s.others} END) AS loss, {late} AS n FROM ps p JOIN (SELECT DISTINCT book, sector FROM ps) x USING (book) GROUP BY book, x.sector"
    ret = f"CASE WHEN heavy <= {s.count} THEN {s.chosen} ELSE {s.others} END" if s.kind == "heaviest" else s.chosen
    return f"SELECT book, '{s.name}', sum(weight * {ret}), {late} FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY weight DESC, rank, security_id, ticker) AS heavy FROM ps) GROUP BY book"


@query(f"WITH {_STRESSED}, sc AS (" + " UNION ALL ".join(_scenario_sql(s) for s in sorted(risk.SCENARIOS, key=lambda s: s.kind != "sector")) + ") SELECT sc.book, scenario, round(CASE WHEN blockers IS NULL THEN loss END, 8) AS loss, CASE WHEN blockers IS NULL THEN n END AS n_exits_late, coalesce(blockers, '') AS blockers FROM sc LEFT JOIN bl ON bl.book = sc.book")
def stress_bundle(spark, d):
    return risk.evaluate(stressed(spark, d), _EQUITY).withColumns({"loss": F.round("loss", 8), "blockers": F.array_join("blockers", ",")})


@query(f"WITH {POSITIONS}, v AS (SELECT book, security_id, weight * (0.2 + (security_id % 10) / 100.0) * 2 * sqrt(20 / 252.0) AS x FROM positions), pairs AS (SELECT a.book, a.security_id, sum(a.x * b.x * CASE WHEN a.security_id = b.security_id THEN 1 ELSE 0.85 END) AS row_sum FROM v a JOIN v b ON a.book = b.book GROUP BY ALL) SELECT book, security_id, round(-2 * row_sum / sqrt(sum(row_sum) OVER (PARTITION BY book)), 8) AS contribution FROM pairs")
def stress_volatility(spark, d):
    """The oracle sums over every pair of positions."""
    p = positions(spark, d).withColumn("volatility", 0.2 + (F.col("security_id") % 10) / 100)
    return risk.volatility_loss(p).withColumn("contribution", F.round("contribution", 8))


@query("WITH bk AS (SELECT c_nationkey AS book, CASE c_custkey % 40 WHEN 0 THEN 'price:' || c_name WHEN 1 THEN 'revenue_fact:' || c_name ELSE 'sector:' || c_name END AS blocker FROM customer), k(kind) AS (VALUES ('price'), ('revenue_fact')), l AS (SELECT b.book, kind, (SELECT string_agg(DISTINCT blocker, ',' ORDER BY blocker) FROM bk WHERE bk.book = b.book AND blocker LIKE kind || ':%') AS live FROM (SELECT DISTINCT book FROM bk) b, k) SELECT book, kind, CASE WHEN live IS NULL THEN 'policy demonstration' ELSE 'withholding required' END AS status, coalesce(live, '') AS live FROM l")
def stress_withheld(spark, d):
    kind = F.when(F.col("c_custkey") % 40 == 0, "price:").when(F.col("c_custkey") % 40 == 1, "revenue_fact:").otherwise("sector:")
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("book"), F.concat(kind, "c_name").alias("blocker"))
    return risk.withheld(rows).withColumn("live", F.array_join("live", ","))


@query("""WITH br AS (SELECT event_type || user_id % 6 AS security_id, CAST(ts AS DATE) AS date, avg(value) AS close, count(*) + CASE WHEN day(ts) = 20 AND user_id % 6 = 3 THEN -99 ELSE 0 END AS volume FROM events GROUP BY event_type || user_id % 6, CAST(ts AS DATE), day(ts) = 20 AND user_id % 6 = 3),
ss AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-26' ORDER BY 1 DESC LIMIT 7), w AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date DESC) AS r FROM br WHERE date <= DATE '2024-01-26'),
g AS (SELECT security_id, count(*) AS n, count(*) FILTER (date IN (SELECT date FROM ss)) AS met, max(date) AS last, count(*) FILTER (close <= 0 OR volume <= 0) AS bad, avg(close * volume) AS adv FROM w WHERE r <= 7 GROUP BY security_id),
p AS (SELECT *, CASE WHEN n < 7 THEN 'too few bars' WHEN last <> (SELECT max(date) FROM ss) THEN 'latest session is missing' WHEN met < n THEN 'sessions are missing' WHEN bad > 0 THEN 'close or volume is not positive' END AS problem FROM g) SELECT security_id, round(CASE WHEN problem IS NULL THEN adv END, 6) AS adv, problem FROM p""")
def liquidity_evidence(spark, d):
    e = read(spark, d, "events").select(F.concat("event_type", (F.col("user_id") % 6).cast("string")).alias("security_id"), day("ts").alias("date"), "value", ((F.dayofmonth("ts") == 20) & (F.col("user_id") % 6 == 3)).alias("odd"))
    rows = e.groupBy("security_id", "date", "odd").agg(F.avg("value").alias("close"), (F.count(F.lit(1)) - F.when(F.col("odd"), 99).otherwise(0)).cast("double").alias("volume"))
    return risk.liquidity_evidence(rows, e.select("date"), F.lit("2024-01-26").cast("date"), 7).withColumn("adv", F.round("adv", 6))


# Periods.

_DATES = f"{_QUARTERS}, nx AS (SELECT decision, lead(decision) OVER (ORDER BY decision) AS next_decision FROM (SELECT DISTINCT decision FROM q)), ses AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_quantity > 3 AND day(l_shipdate) % 9 > 0), ex AS (SELECT decision, next_decision, (SELECT min(date) FROM ses WHERE date > decision AND date <= next_decision) AS entry, CASE WHEN next_decision IN (SELECT date FROM ses) THEN next_decision END AS exit FROM nx WHERE next_decision IS NOT NULL)"


def schedule(spark, d):
    sessions = read(spark, d, "lineitem").where((F.col("l_quantity") > 3) & (F.dayofmonth("l_shipdate") % 9 > 0)).select(day("l_shipdate").alias("date"))
    return backtest.execution_dates(decisions(spark, d), sessions)


@query(f"WITH {_DATES} SELECT * FROM ex")
def execution_windows(spark, d):
    return schedule(spark, d)


_AUDIT = "au AS (SELECT q.decision, c_custkey AS id, c_name AS ticker, o_orderkey IS NOT NULL AND c_acctbal > 0 AS eligible, c_acctbal AS score FROM customer JOIN (SELECT DISTINCT decision FROM q) q ON TRUE LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON o_custkey = c_custkey AND day = decision)"


@query(f"""WITH {_DATES}, {_AUDIT}, rg AS (SELECT decision, CASE WHEN month(decision) > 3 THEN 'goldilocks' END AS regime FROM ex), el AS (SELECT decision, count(*) FILTER (eligible) AS n, sha256(string_agg(DISTINCT upper(ticker), chr(10) ORDER BY upper(ticker))) AS digest, list(ticker ORDER BY score DESC, ticker) FILTER (eligible) AS best FROM au GROUP BY decision),
s AS (SELECT ex.decision, entry, exit, coalesce(regime, 'unknown') AS regime, coalesce(n, 0) AS n_eligible, digest, best, CASE WHEN entry IS NULL OR exit IS NULL THEN 'no execution date' WHEN regime IS NULL THEN 'regime not known' WHEN n < 2 THEN 'too few eligible' ELSE 'ready' END AS status FROM ex JOIN rg ON rg.decision = ex.decision LEFT JOIN el ON el.decision = ex.decision)
SELECT decision, entry, exit, regime, n_eligible, digest AS members_digest, CASE WHEN status = 'ready' THEN array_to_string(best[1:2], ',') END AS selected, status, CASE WHEN status = 'too few eligible' THEN 'eligible:' || n_eligible || '<2' END AS missing FROM s""")
def backtest_periods(spark, d):
    dates = schedule(spark, d)
    regimes = dates.select("decision", F.when(F.month("decision") > 3, "goldilocks").alias("regime"))
    return backtest.periods(_audit(spark, d), dates.select("decision", "entry", "exit"), regimes, 2).withColumn("selected", F.array_join("selected", ","))


def _audit(spark, d):
    """Every customer on every decision date (a row a quarter, broadcast): eligible with a balance and an order that day."""
    bought = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), day("o_orderdate").alias("decision")).distinct().withColumn("_there", F.lit(True))
    everyone = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").join(asof.few(decisions(spark, d).distinct()), F.lit(True))
    joined = everyone.join(bought, ["c_custkey", "decision"], "left")
    return joined.select("decision", F.col("c_name").alias("ticker"), (F.col("_there").isNotNull() & (F.col("c_acctbal") > 0)).alias("eligible"), F.col("c_acctbal").alias("score"))


_MARK = f"{_DATES}, bm AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) - 15000 AS close, CASE WHEN day(l_shipdate) % 2 = 0 THEN avg(l_extendedprice) END AS adj_close FROM lineitem WHERE day(l_shipdate) % 9 > 0 GROUP BY CAST(l_shipdate AS DATE), day(l_shipdate))"


@query(f"""WITH {_MARK}, pp AS (SELECT date, coalesce(adj_close, close) AS p FROM bm), w AS (SELECT decision, coalesce(ex.entry, (SELECT min(date) FROM pp WHERE date > decision AND date <= next_decision)) AS entry, coalesce(ex.exit, (SELECT max(date) FROM pp WHERE date > decision AND date <= next_decision)) AS exit FROM ex),
j AS (SELECT w.*, a.p AS pa, b.p AS pb FROM w LEFT JOIN pp a ON a.date = w.entry LEFT JOIN pp b ON b.date = w.exit), k AS (SELECT *, CASE WHEN entry IS NULL OR exit IS NULL THEN 'no benchmark price' WHEN pa IS NULL OR pb IS NULL OR pa <= 0 THEN 'benchmark price is not valid' END AS problem FROM j) SELECT decision, entry, exit, round(CASE WHEN problem IS NULL THEN pb / pa - 1 END, 6) AS ret, problem FROM k""")
def benchmark_returns(spark, d):
    li = read(spark, d, "lineitem").where(F.dayofmonth("l_shipdate") % 9 > 0).groupBy(day("l_shipdate").alias("date")).agg((F.avg("l_extendedprice") - 15000).alias("close"), F.avg("l_extendedprice").alias("_a"))
    mark = li.withColumn("adj_close", F.when(F.dayofmonth("date") % 2 == 0, F.col("_a")))
    return backtest.benchmark_returns(mark, schedule(spark, d)).withColumn("ret", F.round("ret", 6))

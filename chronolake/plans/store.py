"""The report of a whole store over analogue relations, in which every family of faults is planted."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import quality, reviewed
from .catalog import query, read

_P, _S = "'s' || p_partkey", "'i' || s_suppkey"
_END = "CASE WHEN p_size < 45 THEN DATE '1998-06-01' END"
_SHA = "repeat('aB', 32)"
#: Relations as both engines read them from the tables.
RELATIONS = {
    "security_master": f"SELECT {_P} AS security_id FROM part WHERE p_partkey % 50 > 0",
    "issuer_master": f"SELECT {_S} AS issuer_id FROM supplier WHERE s_suppkey % 20 > 0",
    "issuer_cik_history": f"""SELECT {_S} AS issuer_id, DATE '2010-01-01' AS effective_start, CASE WHEN s_suppkey % 9 > 0 THEN DATE '2012-01-01' ELSE DATE '2009-01-01' END AS effective_end, CASE WHEN s_suppkey % 11 > 0 THEN DATE '2022-01-01' ELSE DATE '2999-01-01' END AS verified_date FROM supplier
        UNION ALL SELECT {_S}, CASE WHEN s_suppkey % 5 > 0 THEN DATE '2012-01-01' ELSE DATE '2011-06-01' END, CAST(NULL AS DATE), DATE '2022-01-01' FROM supplier""",
    "security_issuer_assignments": f"SELECT {_P} AS security_id, 'i' || (p_partkey % 21 + 1) AS issuer_id, DATE '1990-01-01' AS effective_start, CAST(NULL AS DATE) AS effective_end, CASE WHEN p_partkey % 60 > 0 THEN DATE '2022-01-01' ELSE DATE '2999-01-01' END AS verified_date FROM part",
    "provider_symbol_history": f"SELECT 'yfinance' AS provider, 'P' || (p_partkey - CASE WHEN p_partkey % 40 = 0 THEN 1 ELSE 0 END) AS provider_symbol, {_P} AS security_id, DATE '1996-06-01' AS data_start, {_END} AS data_end, CASE WHEN p_partkey % 25 > 0 THEN 'verified' ELSE 'open' END AS mapping_status, DATE '2022-01-01' AS verified_date FROM part",
    "security_identity_assignments": f"""SELECT 'u' AS universe_id, 'T' || p_partkey AS ticker, DATE '1990-01-01' AS effective_start, {_END} AS effective_end, {_P} AS security_id, CASE WHEN p_partkey % 70 > 0 THEN DATE '1990-01-01' ELSE DATE '2999-01-01' END AS known_date FROM part
        UNION ALL SELECT 'u', 'U' || p_partkey, DATE '1998-05-01', CAST(NULL AS DATE), {_P}, DATE '1998-01-01' FROM part WHERE p_partkey % 35 = 1""",
    "universe_membership": f"""SELECT 'u' AS universe_id, 'T' || p_partkey AS ticker, CASE WHEN p_partkey % 12 > 0 THEN {_P} WHEN p_partkey % 24 > 0 THEN 's0' END AS security_id, DATE '1990-01-01' AS effective_start, CASE WHEN p_partkey % 31 = 0 THEN DATE '1989-01-01' ELSE {_END} END AS effective_end,
        CASE WHEN p_partkey % 90 > 0 THEN DATE '1989-12-01' ELSE DATE '2999-01-01' END AS known_date, CASE WHEN p_partkey % 8 > 0 THEN {_END} END AS end_known_date FROM part
        UNION ALL SELECT 'u', 'T' || p_partkey, {_P}, DATE '1998-05-01', CAST(NULL AS DATE), DATE '1998-04-01', CAST(NULL AS DATE) FROM part WHERE p_partkey % 45 = 1""",
    "prices": "SELECT 'T' || (l_partkey + CASE WHEN l_orderkey % 37 = 0 THEN 1 ELSE 0 END) AS ticker, CASE WHEN l_orderkey % 5 > 0 THEN 's' || l_partkey END AS security_id, 'P' || l_partkey AS provider_symbol, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_orderkey % 301 > 0 THEN l_extendedprice ELSE -1.0E0 END AS close, l_orderkey % 41 > 0 AS actions_complete, CASE WHEN l_orderkey % 43 > 0 THEN l_orderkey % 2 = 0 END AS close_split_adjusted, CASE WHEN l_orderkey % 7 > 0 THEN 1.0E0 WHEN l_orderkey % 49 = 0 THEN -1.0E0 END AS split_normalization_factor, CASE l_orderkey % 6 WHEN 0 THEN 'yfinance:ohlc-envelope-v1' WHEN 1 THEN 'tiingo' ELSE 'yfinance' END AS source FROM lineitem",
    "factor_price_provenance": f"SELECT 'p' || p_partkey AS provenance_id, {_P} AS security_id, 'yfinance' AS provider, 'P' || p_partkey AS provider_symbol, DATE '1990-01-01' AS data_start, CASE WHEN p_partkey % 14 > 0 THEN DATE '1996-06-01' ELSE DATE '1996-06-02' END AS data_end, DATE '1996-06-01' AS overlap_start, DATE '1996-07-01' AS overlap_end, CASE WHEN p_partkey % 80 > 0 THEN DATE '2022-01-01' ELSE DATE '2999-01-01' END AS verified_date, CASE WHEN p_partkey % 22 > 0 THEN repeat('ab', 32) ELSE {_SHA} END AS payload_sha256, repeat('0f', 32) AS overlap_sha256 FROM part WHERE p_partkey % 3 > 0",
    "factor_prices": "SELECT 's' || l_partkey AS security_id, CAST(l_shipdate AS DATE) AS date, 'yfinance' AS provider, 'P' || l_partkey AS provider_symbol, l_extendedprice AS close, CASE WHEN l_orderkey % 211 > 0 THEN 0.0E0 ELSE -1.0E0 END AS dividends, 1.0E0 AS split_ratio, l_orderkey % 51 > 0 AS actions_complete, l_orderkey % 2 = 0 AS close_split_adjusted, 1.0E0 AS split_normalization_factor, 'p' || l_partkey AS provenance_id FROM lineitem WHERE l_linenumber = 1",
    "macro": "SELECT event_type AS series_id, CAST(ts AS DATE) AS date, CASE WHEN event_id % 53 = 0 THEN CAST(NULL AS DATE) WHEN event_id % 59 = 0 THEN DATE '2999-01-01' ELSE CAST(ts AS DATE) + CAST(event_id % 30 AS INT) END AS release_date, CASE WHEN event_id % 61 > 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN 'fred' ELSE 'treasury' END AS source, event_id AS fetched_at FROM events",
    "fundamentals": "SELECT 'T' || o_orderkey AS ticker, CASE WHEN o_orderkey % 4 > 0 THEN 'i' || (o_custkey % 22 + 1) END AS issuer_id, CASE WHEN o_orderkey % 3 > 0 THEN 's' || (o_custkey % 900 + 1) END AS security_id, CAST(o_orderdate AS DATE) AS period_end, CASE WHEN o_orderkey % 67 = 0 THEN CAST(NULL AS DATE) WHEN o_orderkey % 71 = 0 THEN DATE '2999-01-01' ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 1 AS INT) END AS as_of_date, CASE o_orderkey % 5 WHEN 0 THEN 'ebitda' WHEN 1 THEN 'total_assets' ELSE 'revenue' END AS metric, o_totalprice AS value, CASE WHEN o_orderkey % 73 > 0 THEN o_totalprice END AS quarter_value, 'USD' AS unit FROM orders",
    "fundamental_versions": "SELECT o_orderkey AS version_sequence, 'T' || o_orderkey AS ticker, CAST(o_orderdate AS DATE) AS period_end, CASE WHEN o_orderkey % 67 = 0 THEN CAST(NULL AS DATE) WHEN o_orderkey % 71 = 0 THEN DATE '2999-01-01' ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 1 AS INT) END AS as_of_date, CASE o_orderkey % 5 WHEN 0 THEN 'ebitda' WHEN 1 THEN 'total_assets' ELSE 'revenue' END AS metric, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice ELSE 0.0E0 END AS value, CASE WHEN o_orderkey % 73 > 0 THEN o_totalprice END AS quarter_value, 'USD' AS unit, o_orderkey % 19 = 0 AS is_deleted FROM orders WHERE o_orderkey % 13 > 0",
    "fundamental_evidence_generations": "SELECT 'g' || s_suppkey AS generation_id, s_suppkey * s_suppkey * 10 AS version_sequence FROM supplier",
    "ingest_log": "SELECT event_type AS source, CASE event_id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'warning' ELSE 'success' END AS status, event_id % 8 AS rows_inserted FROM events",
    "security_conversions": f"SELECT {_P} AS source_security_id, 's' || (p_partkey + CASE WHEN p_partkey % 65 = 0 THEN 0 ELSE 1 END) AS target_security_id, CASE WHEN p_partkey % 4 > 0 THEN DATE '1995-01-01' ELSE DATE '1999-01-01' END AS effective_date, CASE WHEN p_partkey % 55 > 0 THEN DATE '1994-12-01' ELSE DATE '2000-01-01' END AS known_date, CASE WHEN p_partkey % 75 > 0 THEN 1.5E0 ELSE 0.0E0 END AS share_ratio, 'carryover' AS basis_policy, CASE WHEN p_partkey % 85 > 0 THEN 'verified' ELSE 'open' END AS review_status, DATE '2022-01-01' AS verified_date, CASE WHEN p_partkey % 95 > 0 THEN 'https://a' ELSE 'http://a' END AS source, 'https://b' AS basis_source FROM part WHERE p_partkey % 5 = 0",
    "security_ticker_extensions": f"SELECT 'u' AS universe_id, {_P} AS security_id, 'T' || p_partkey AS ticker, 'yfinance' AS provider, 'P' || p_partkey AS provider_symbol, DATE '1998-06-01' AS data_start, CASE WHEN p_partkey % 36 > 0 THEN DATE '1998-07-01' ELSE DATE '1998-09-01' END AS data_end, DATE '1999-01-01' AS verified_date, 'portfolio_liquidation' AS purpose, 'adjacent_identity_provider_v1' AS review_policy, CASE WHEN p_partkey % 42 > 0 THEN repeat('ab', 32) END AS payload_sha256, 'https://a' AS identity_source, CASE WHEN p_partkey % 48 > 0 THEN 'https://b' ELSE 'paper' END AS provider_source FROM part WHERE p_partkey % 6 = 0",
}


def _duck(text: str) -> str:
    """A rule's text in the other engine's words."""
    text = re.sub(r"(\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", text)
    for a, b in (("double('infinity')", "'infinity'::DOUBLE"), ("startswith(", "starts_with("), ("<=>", "IS NOT DISTINCT FROM"), ("datediff(data_end, data_start)", "(data_end - data_start)"), ("current_date()", "current_date")):
        text = text.replace(a, b)
    return text


def _oracle() -> str:
    counts, severity = [], {}
    for check in quality.CHECKS:
        severity[check.name] = check.severity
        if isinstance(check, quality.Apart):
            for relation, keys, start, end in check.relations:
                w = f"PARTITION BY {', '.join(keys)} ORDER BY {start}, {end} NULLS LAST"
                counts.append(f"SELECT '{check.name}' AS name, count(*) AS n FROM (SELECT {start} AS a, row_number() OVER ({w}) AS r, lag({end}) OVER ({w}) AS before FROM {relation}) WHERE r > 1 AND (before IS NULL OR a < before)")
        else:
            gone = [f"NOT EXISTS (SELECT 1 FROM {other} r WHERE {_duck(condition)})" for other, condition in check.lacks]
            bad = f"({_duck(check.rows)})" + (f" AND ({(' AND ' if check.every else ' OR ').join(gone)})" if gone else "")
            counts.append(f"SELECT '{check.name}' AS name, count(*) AS n FROM {check.relation} l WHERE {bad}")
    newest = "SELECT series_id, date, value, row_number() OVER (PARTITION BY series_id, date ORDER BY release_date DESC NULLS LAST, fetched_at DESC) AS r FROM macro WHERE source = "
    far = "coalesce({}.data_end, DATE '9999-12-31')"
    more = {
        "macro_primary_fallback_divergence": ("warn", f"SELECT count(*) FROM ({newest}'fred') a JOIN ({newest}'treasury') b ON a.series_id = b.series_id AND a.date = b.date AND a.r = 1 AND b.r = 1 WHERE abs(a.value - b.value) > 0.05"),
        "provider_symbol_overlapping_reuse": ("fail", f"SELECT count(*) FROM provider_symbol_history a JOIN provider_symbol_history b ON a.provider = b.provider AND a.provider_symbol = b.provider_symbol AND b.security_id > a.security_id AND a.mapping_status = 'verified' AND b.mapping_status = 'verified' AND {far.format('a')} > b.data_start AND {far.format('b')} > a.data_start"),
        "fundamental_evidence_latest_projection_mismatch": ("fail", "SELECT count(*) FROM fundamentals a FULL OUTER JOIN (SELECT * FROM fundamental_versions WHERE NOT is_deleted) b ON a.ticker = b.ticker AND a.period_end = b.period_end AND a.as_of_date = b.as_of_date AND a.metric = b.metric WHERE a.ticker IS NULL OR b.ticker IS NULL OR a.value IS DISTINCT FROM b.value OR a.quarter_value IS DISTINCT FROM b.quarter_value OR a.unit IS DISTINCT FROM b.unit"),
    }
    for name, (level, sql) in more.items():
        severity[name] = level
        counts.append(f"SELECT '{name}' AS name, ({sql}) AS n")
    levels = " ".join(f"WHEN '{n}' THEN '{s}'" for n, s in severity.items())
    relations = ", ".join(f"{n} AS MATERIALIZED ({x.replace('STRING', 'VARCHAR')})" for n, x in RELATIONS.items())
    return f"WITH {relations}, counted AS (SELECT name, sum(n)::BIGINT AS n_bad FROM ({' UNION ALL '.join(counts)}) GROUP BY name) SELECT name, CASE name {levels} END AS severity, n_bad, CASE WHEN n_bad = 0 THEN 'ok' ELSE CASE name {levels} END END AS status FROM counted"


@query(_oracle())
def store_report(spark, d):
    """Every check of a store, each family with planted faults; both engines read the rules' own texts."""
    tables = {t: read(spark, d, t) for t in ("part", "supplier", "lineitem", "orders", "events")}
    named = lambda sql: re.sub(r"FROM (part|supplier|lineitem|orders|events)\b", r"FROM {\1}", sql)
    used = lambda sql: {t: df for t, df in tables.items() if f"{{{t}}}" in sql}
    relations = {n: spark.sql(named(x), **used(named(x))) for n, x in RELATIONS.items()}
    return quality.report(relations)


def _relations(spark, d, *names):
    tables = {t: read(spark, d, t) for t in ("part", "supplier", "lineitem", "orders", "events")}
    named = lambda sql: re.sub(r"FROM (part|supplier|lineitem|orders|events)\b", r"FROM {\1}", sql)
    return [spark.sql(sql, **{t: df for t, df in tables.items() if f"{{{t}}}" in sql}) for sql in map(named, names)]


#: Arriving identities: faults of a row, of its membership, and of what is stored (every fourth part).
IDENTITIES = """SELECT universe_id, CASE WHEN k % 77 > 0 THEN ticker ELSE ' ' END AS ticker, effective_start, CASE WHEN k % 19 > 0 THEN effective_end ELSE DATE '1997-01-01' END AS effective_end, CASE WHEN k % 23 = 0 THEN 's1' ELSE 's' || k END AS security_id,
  CASE WHEN k % 17 > 0 THEN DATE '1989-01-01' ELSE DATE '1991-01-01' END AS known_date, CASE WHEN k % 29 = 0 THEN 'guess' WHEN k % 2 = 0 THEN 'bounded_ticker' ELSE 'verified_ticker_change' END AS identity_status, 'review' AS source FROM (SELECT *, CAST(substr(ticker, 2) AS BIGINT) AS k FROM ({m}) q WHERE effective_start = DATE '1990-01-01') r"""
_M, _ASSIGNED = RELATIONS["universe_membership"], "SELECT 'u' AS universe_id, 'W' || p_partkey AS ticker, DATE '1996-01-01' AS effective_start, DATE '1996-06-01' AS effective_end, 's' || p_partkey AS security_id, DATE '1989-01-01' AS known_date, 'bounded_ticker' AS identity_status, 'review' AS source FROM part WHERE p_partkey % 4 = 0"


@query(f"""WITH m AS ({_M}), ar AS ({IDENTITIES.replace("{m}", "SELECT * FROM m")}), st AS ({_ASSIGNED}),
j AS (SELECT ar.*, count(*) OVER (PARTITION BY ar.universe_id, ar.ticker, ar.effective_start) AS n, min(identity_status) OVER (PARTITION BY ar.security_id) <> max(identity_status) OVER (PARTITION BY ar.security_id) AS mixed, m.universe_id IS NOT NULL AS there, m.effective_end AS mend, m.security_id AS owner
  FROM ar LEFT JOIN m ON m.universe_id = ar.universe_id AND m.ticker = ar.ticker AND m.effective_start = ar.effective_start),
p AS (SELECT universe_id, ticker, effective_start, effective_end, security_id, CASE WHEN trim(ticker) = '' THEN 'lacks universe, ticker, security or source' WHEN identity_status = 'guess' THEN 'unknown status' WHEN known_date > effective_start THEN 'known after its start' WHEN effective_end <= effective_start THEN 'end does not follow the start'
  WHEN n > 1 THEN 'arrives more than once' WHEN mixed THEN 'security has several statuses' WHEN NOT there OR mend IS DISTINCT FROM effective_end THEN 'is no membership' WHEN owner <> security_id THEN 'membership has another security' END AS problem FROM j),
a AS (SELECT universe_id, ticker, effective_start, effective_end, security_id FROM p WHERE problem IS NULL UNION ALL SELECT universe_id, ticker, effective_start, effective_end, security_id FROM st),
o AS (SELECT *, row_number() OVER w AS r, lag(effective_end) OVER w AS before FROM a WINDOW w AS (PARTITION BY universe_id, security_id ORDER BY effective_start, ticker))
SELECT ticker, security_id, effective_start, CASE WHEN r > 1 AND (before IS NULL OR effective_start < before) THEN 'security has two tickers at a time' END AS problem FROM o UNION ALL SELECT ticker, security_id, effective_start, problem FROM p WHERE problem IS NOT NULL""")
def identity_writes(spark, d):
    members, arrived, stored = _relations(spark, d, _M, IDENTITIES.replace("{m}", _M).replace("VARCHAR", "STRING"), _ASSIGNED)
    return reviewed.identity_rows(arrived, members, stored).select("ticker", "security_id", "effective_start", "problem")


#: Arriving extensions over mappings and identities that end at one day, and stored ones of every ninth.
EXTENDED = RELATIONS["security_ticker_extensions"].replace("SELECT 'u' AS universe_id", "SELECT 'x' || (p_partkey - CASE WHEN p_partkey % 66 = 0 THEN 6 ELSE 0 END) AS provenance_id, 'u' AS universe_id").replace("'portfolio_liquidation' AS purpose", "CASE WHEN p_partkey % 54 > 0 THEN 'portfolio_liquidation' ELSE 'other' END AS purpose")
_STORED_X = "SELECT 'x' || p_partkey AS provenance_id, 's' || p_partkey AS security_id, 'T' || p_partkey AS ticker, 'yfinance' AS provider, 'P' || p_partkey AS provider_symbol, DATE '1998-06-01' AS data_start, CASE WHEN p_partkey % 4 > 0 THEN DATE '1998-07-01' ELSE DATE '1998-06-15' END AS data_end, repeat('ab', 32) AS payload_sha256 FROM part WHERE p_partkey % 9 = 0"
_CROSSING = RELATIONS["provider_symbol_history"] + " UNION ALL SELECT 'yfinance', 'Q' || p_partkey, 's' || p_partkey, DATE '1998-06-20', CAST(NULL AS DATE), 'open', DATE '2022-01-01' FROM part WHERE p_partkey % 27 = 3"


@query(f"""WITH sm AS ({RELATIONS["security_master"]}), ia AS ({RELATIONS["security_identity_assignments"]}), mp AS ({_CROSSING}), st AS ({_STORED_X}), ar AS ({EXTENDED}), g AS (SELECT *, count(*) OVER (PARTITION BY provenance_id) AS n FROM ar)
SELECT provenance_id, security_id, CASE WHEN n > 1 THEN 'arrives more than once' WHEN data_end - data_start > 45 THEN 'extension is too long' WHEN purpose <> 'portfolio_liquidation' THEN 'unknown purpose or review' WHEN payload_sha256 IS NULL THEN 'digest is not one'
  WHEN NOT EXISTS (SELECT 1 FROM sm WHERE sm.security_id = g.security_id) OR NOT EXISTS (SELECT 1 FROM ia WHERE ia.universe_id = g.universe_id AND ia.security_id = g.security_id AND ia.ticker = g.ticker AND ia.effective_end = g.data_start)
    OR NOT EXISTS (SELECT 1 FROM mp WHERE mp.security_id = g.security_id AND mp.provider = g.provider AND mp.provider_symbol = g.provider_symbol AND mapping_status = 'verified' AND mp.data_end = g.data_start) THEN 'lacks an end to follow'
  WHEN EXISTS (SELECT 1 FROM mp WHERE mp.security_id = g.security_id AND mp.provider = g.provider AND mp.data_start < g.data_end AND coalesce(mp.data_end, DATE '9999-12-31') > g.data_start) THEN 'meets another mapping'
  WHEN EXISTS (SELECT 1 FROM st WHERE st.provenance_id = g.provenance_id AND (st.security_id, st.ticker, st.data_end) IS DISTINCT FROM (g.security_id, g.ticker, g.data_end)) THEN 'stored provenance says otherwise' END AS problem FROM g""")
def extension_writes(spark, d):
    """No mapping of these has an extension's own days, so any that meets them is another."""
    securities, identities, mappings, stored, arrived = _relations(spark, d, RELATIONS["security_master"], RELATIONS["security_identity_assignments"], _CROSSING, _STORED_X, EXTENDED)
    return reviewed.extension_rows(arrived, securities, identities, mappings, stored, F.current_date()).select("provenance_id", "security_id", "problem")


_PROVEN = "SELECT *, 'u' AS universe_id, 'review' AS source, 'v1' AS review_policy FROM ({x}) z"
_PROVENANCE, _FPRICES = RELATIONS["factor_price_provenance"], RELATIONS["factor_prices"]
_STORED_P = _PROVEN.replace("{x}", _PROVENANCE.replace("repeat('0f', 32) AS overlap_sha256", "CASE WHEN p_partkey % 8 > 0 THEN repeat('0f', 32) ELSE repeat('00', 32) END AS overlap_sha256").replace("WHERE p_partkey % 3 > 0", "WHERE p_partkey % 5 = 1"))


@query(f"""WITH sm AS ({RELATIONS["security_master"]}), mp AS ({RELATIONS["provider_symbol_history"]}), ar AS ({_PROVENANCE}), st AS ({_STORED_P}), fp AS ({_FPRICES}),
pv AS (SELECT provenance_id AS id, 'provenance' AS kind, CASE WHEN data_end <> overlap_start OR verified_date > current_date THEN 'intervals are not in order' WHEN NOT EXISTS (SELECT 1 FROM sm WHERE sm.security_id = ar.security_id) THEN 'unknown security'
  WHEN NOT EXISTS (SELECT 1 FROM mp WHERE mp.security_id = ar.security_id AND mp.provider = ar.provider AND mp.provider_symbol = ar.provider_symbol AND mapping_status = 'verified' AND mp.data_start = ar.data_end) THEN 'no verified mapping starts where it ends'
  WHEN EXISTS (SELECT 1 FROM st WHERE st.provenance_id = ar.provenance_id AND st.overlap_sha256 <> ar.overlap_sha256) THEN 'stored provenance says otherwise' END AS problem FROM ar),
pr AS (SELECT fp.provenance_id AS id, 'price' AS kind, CASE WHEN count(*) OVER (PARTITION BY fp.security_id, date) > 1 THEN 'arrives more than once' WHEN NOT (close > 0 AND dividends >= 0) THEN 'number is out of range' WHEN NOT actions_complete THEN 'actions or split basis are not reviewed'
  WHEN ar.provenance_id IS NULL OR date < data_start OR date >= data_end THEN 'is outside its provenance' END AS problem FROM fp LEFT JOIN ar ON ar.provenance_id = fp.provenance_id),
no AS (SELECT provenance_id AS id, 'empty' AS kind, 'has no prices' AS problem FROM ar WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.provenance_id = ar.provenance_id))
SELECT id, kind, problem, count(*) AS n FROM (SELECT * FROM pv UNION ALL SELECT * FROM pr UNION ALL SELECT * FROM no) GROUP BY ALL""")
def warmup_writes(spark, d):
    """Provenance and prices before a listing's start, each with what is wrong with it."""
    securities, mappings, arrived, stored, prices = _relations(spark, d, RELATIONS["security_master"], RELATIONS["provider_symbol_history"], _PROVEN.replace("{x}", _PROVENANCE), _STORED_P, _FPRICES)
    told = lambda df, kind: df.select(F.col("provenance_id").alias("id"), F.lit(kind).alias("kind"), "problem")
    whole = told(reviewed.provenance_rows(arrived, securities, mappings, stored, F.current_date()), "provenance").unionByName(told(reviewed.covered_prices(prices, arrived), "price")).unionByName(told(reviewed.without_prices(arrived, prices), "empty"))
    return whole.groupBy("id", "kind", "problem").agg(F.count(F.lit(1)).alias("n"))

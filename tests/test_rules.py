"""Rules of ingestion, risk, backtests, factors and stored tables on fixtures whose results are known."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import backtest, factors, ingest, intervals, reviewed, risk
from chronolake.sources import documents, manifests, tables

D = date(2024, 1, 1)


def test_ten_equal_positions_are_approved(spark):
    books = spark.createDataFrame([("a", 1e6, 1e6), ("b", 1e6, 1e6), ("empty", 1e6, 2e6)], "book string, equity double, peak double")
    rows = [("a", f"T{k}", 0.1, f"S{k % 5}", 1e8) for k in range(10)] + [("b", f"T{k}", 0.1, None if k == 3 else f"S{k % 2}", 1e8 if k else None) for k in range(10)]
    targets = spark.createDataFrame(rows, "book string, ticker string, weight double, sector string, adv double")
    current = spark.createDataFrame([], "book string, ticker string, weight double")
    got = {r["book"]: r for r in risk.assess(books, targets, current).collect()}
    assert got["a"]["approved"] and got["a"]["gross"] == pytest.approx(1) and got["a"]["turnover"] == pytest.approx(1)
    assert [n for n in risk.CHECKS if not got["b"][n]] == ["sector_concentration", "liquidity"]
    assert [n for n in risk.CHECKS if not got["empty"][n]] == ["position_count", "drawdown_halt"]


def test_repeated_or_infinite_targets_fail_integrity(spark):
    books = spark.createDataFrame([("a", 1e6, 1e6), ("b", 1e6, 1e6)], "book string, equity double, peak double")
    targets = spark.createDataFrame([("a", "X", 0.1, "s", 1e8), ("a", " x", 0.1, "s", 1e8), ("b", "X", float("inf"), "s", 1e8)], "book string, ticker string, weight double, sector string, adv double")
    got = risk.assess(books, targets, spark.createDataFrame([], "book string, ticker string, weight double")).collect()
    assert len(got) == 2 and not any(r["input_integrity"] or r["approved"] for r in got)


def test_single_period_and_contexts(spark):
    q3, fy = date(2023, 9, 30), date(2023, 12, 31)
    rows = [("q", date(2023, 1, 1), q3, "Q3", 2023, "10-Q", 90.0, 0), ("q", date(2023, 7, 1), q3, "Q3", 2023, "10-Q", 30.0, 1), ("y", date(2023, 1, 1), fy, "FY", 2023, "10-K", 120.0, 0), ("y", date(2023, 10, 1), fy, "FY", 2023, "10-K", 31.0, 1), ("i", None, fy, "FY", 2023, "10-K", 7.0, 0), ("n", None, fy, "FY", 2023, "10-K", 1.0, 0), ("n", None, fy, "FY", 2023, "10-K", 2.0, 1)]
    df = spark.createDataFrame(rows, "accn string, start date, end date, fp string, fy int, form string, val double, position int").withColumns({"unit": F.lit("USD"), "filed": F.lit(D)})
    got = {(r["accn"], r["val"]): r["period_value"] for r in ingest.single_period(df, ["accn"]).collect()}
    assert got == {("q", 90.0): 30.0, ("q", 30.0): 30.0, ("y", 120.0): 120.0, ("y", 31.0): 120.0, ("i", 7.0): 7.0, ("n", 1.0): None, ("n", 2.0): None}
    assert sorted(r["val"] for r in ingest.period_contexts(df, ["accn"], F.lit("USD")).collect()) == [30.0, 120.0]


def test_envelope_is_widened_below_one_percent_only(spark):
    df = spark.createDataFrame([(10.05, 10.0, 9.0, 9.5), (10.2, 10.0, 9.0, 9.5), (None, 10.0, 9.0, 9.5)], "open double, high double, low double, close double")
    assert [(r["repaired"], r["high"]) for r in ingest.repair_envelope(df).collect()] == [(True, 10.05), (False, 10.0), (False, 10.0)]


def test_membership_from_events(spark):
    events = spark.createDataFrame([("A", date(2024, 3, 1), "deletion", date(2024, 2, 20), 0), ("B", date(2024, 4, 1), "addition", date(2024, 3, 20), 1), ("C", date(2024, 5, 1), "deletion", D, 2), ("A", date(2023, 12, 1), "addition", D, 3)], "t string, date date, action string, known date, position int")
    rows = ingest.membership(spark.createDataFrame([("A",)], "t string"), events, "t", F.lit(D), F.lit(date(2024, 6, 30)))
    good = {r["t"]: (r["start"], r["end"], r["end_known"]) for r in rows.where("problem IS NULL").collect()}
    assert good == {"A": (D, date(2024, 3, 1), date(2024, 2, 20)), "B": (date(2024, 4, 1), date(2024, 7, 1), date(2024, 6, 30))}
    with pytest.raises(Exception, match="inactive member C"):
        ingest.refuse(rows, "t").collect()


def test_interval_subtract(spark):
    a = spark.createDataFrame([("k", D, None), ("m", D, D)], "k string, start date, end date")
    b = spark.createDataFrame([("k", D, D + timedelta(5)), ("k", D + timedelta(5), D + timedelta(9)), ("k", D + timedelta(20), D + timedelta(30))], "k string, start date, end date")
    got = sorted((r["start"], r["end"]) for r in intervals.subtract(a, b, ["k"]).collect())
    assert got == [(D + timedelta(9), D + timedelta(20)), (D + timedelta(30), date(9999, 12, 31))]


def test_holding_with_split_dividend_and_costs(spark):
    rows = [("b", "X", D, 10.0, 10.0, 1.0, 0.0), ("b", "X", D + timedelta(1), 6.0, 12.5, 2.0, 0.5)]
    paths = spark.createDataFrame(rows, "book string, security_id string, date date, close double, adj_close double, split_ratio double, dividends double")
    paths = paths.withColumns({"actions_complete": F.lit(True), "close_split_adjusted": F.lit(False), "entry": F.lit(D), "exit": F.lit(D + timedelta(1))})
    r = backtest.hold(paths, 1000, backtest.Frictions(commission_bps=10, slippage_bps=0, short_rate=0.1, dividend_rate=0.2)).first()
    assert r["gross_return"] == pytest.approx(0.25) and r["costs"] == pytest.approx(2.2) and r["taxes"] == pytest.approx(0.1 * 200 + 0.2 * 100)
    assert r["net_return"] == pytest.approx((1250 - 2.2 - 40) / 1000 - 1) and r["missing"] == []
    late = backtest.hold(paths.withColumn("exit", F.lit(D + timedelta(2))), 1000, backtest.Frictions()).first()
    assert late["net_return"] is None and late["missing"] == ["X: no exit price"]


def test_market_window_needs_every_session(spark):
    days = [D + timedelta(k) for k in range(6)]
    rows = [("full", d, 100.0 * 1.1**k, True) for k, d in enumerate(days)] + [("hole", d, 100.0, True) for d in days[:2] + days[3:]] + [("open", d, 100.0, d != days[3]) for d in days]
    df = spark.createDataFrame(rows, "k string, date date, close double, actions_complete boolean").withColumns({"split_ratio": F.lit(1.0), "dividends": F.lit(0.0), "close_split_adjusted": F.lit(True)})
    sessions = spark.createDataFrame([(d,) for d in days], "date date")
    got = {r["k"]: r for r in factors.market_window(df, sessions, "k", F.lit(days[-1]), n=5, skip=2).collect()}
    assert got["full"]["momentum"] == pytest.approx(1.1**2 - 1) and got["full"]["volatility"] == pytest.approx(0, abs=1e-9)
    assert (got["hole"]["problem"], got["open"]["problem"]) == ("missing sessions", "unverified corporate actions")


def test_filings_and_csv(spark):
    recent = {"accessionNumber": ["1", "2", "3"], "form": ["10-Q", "10-Q/A", "8-K"], "filingDate": ["2024-05-01", "2024-06-01", "2024-07-01"], "periodOfReport": ["2024-03-31"] * 3}
    docs = spark.createDataFrame([("c", json.dumps({"filings": {"recent": recent}}))], "key string, payload string")
    assert [(r["filed"]) for r in documents.filing_dates(documents.filings(docs)).collect()] == [date(2024, 6, 1)]
    texts = [("a", "\ufeffDate,Open,High,Low,Close,Volume\r\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1,2,1.2,1.5,\n"), ("b", "No data"), ("c", "Day,Open\n1,2"), ("d", "Date,Open,High,Low,Close\n2024-01-02,1,2,0.5,1.5")]
    bars = documents.csv_bars(spark.createDataFrame(texts, "key string, payload string"))
    assert sorted((r["key"], r["problem"]) for r in bars.collect() if r["problem"]) == [("a", "prices are not within high and low"), ("c", "header is not that of daily bars")]
    assert {r["key"] for r in bars.where("problem IS NULL").collect()} == {"a", "d"}
    other = bars.where("key = 'd'").withColumn("key", F.lit("a"))
    assert {(r["key"], r["provider"]) for r in documents.first_provider({"x": other, "y": bars}).collect()} == {("a", "x"), ("c", "y"), ("d", "y")}


def test_manifest_round_trip_and_problems(spark, tmp_path):
    good = spark.createDataFrame([("A", D, None), ("B", D, D + timedelta(3))], "ticker string, start date, end date")
    manifests.write_manifest(good, str(tmp_path / "m"), "spans")
    assert sorted((r["ticker"], r["end"], r["problem"]) for r in manifests.read_manifest(spark, str(tmp_path / "m"), "spans").collect()) == [("A", None, None), ("B", D + timedelta(3), None)]
    (tmp_path / "bad.csv").write_text("ticker,start,end\nA,2024-01-01,2024-01-01\nB,2024-13-01,\nC,2024-01-01,\nC,2024-01-01,2024-02-01\n,2024-01-01,\n")
    got = sorted(r["problem"] for r in manifests.read_manifest(spark, str(tmp_path / "bad.csv"), "spans").collect())
    assert got == ["cell is not of its type", "interval does not run forward", "key comes again with other values", "key comes again with other values", "key is empty"]
    (tmp_path / "other.csv").write_text("start,ticker,end\n2024-01-01,A,\n")
    with pytest.raises(Exception):
        manifests.read_manifest(spark, str(tmp_path / "other.csv"), "spans").collect()


def test_stored_tables(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda name: sorted(map(tuple, store.read(name).collect()))
    store.merge("merged", one, ["k"])
    store.merge("merged", two, ["k"])
    assert rows("merged") == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(Exception, match="drops a stored key"):
        store.refresh("merged", two, ["k"])
    with pytest.raises(Exception, match="another owner"):
        store.refresh("merged", spark.createDataFrame([(1, "a"), (2, "x"), (3, "d")], "k int, v string"), ["k"], owner="v")
    with pytest.raises(Exception, match="more than once"):
        store.merge("merged", two.union(two), ["k"])
    assert rows("merged") == [(1, "a"), (2, "c"), (3, "d")]
    for arrived in (one, two, two):
        store.append_versions("versions", arrived, ["k"])
    assert sorted((r["k"], r["v"], r["version"]) for r in store.read("versions").collect()) == [(1, "a", 1), (2, "b", 1), (2, "c", 2), (3, "d", 1)]


def test_writes_are_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = tables.Store(spark, str(tmp_path))
    a, b = (spark.createDataFrame([(k, None if k < 3 else "broken") for k in range(n)], "k int, problem string") for n in (2, 5))
    store.validated({"a": "k"}, a=a)
    with pytest.raises(Exception, match="broken 3"):
        store.validated({"a": "k", "b": "k"}, a=a.limit(1), b=b)
    assert store.read("a").count() == 2 and not store.exists("b")
    # A crash between the new states and the pointer: readers see the old state, and the next write goes through.
    monkeypatch.setattr(store, "_states", lambda: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.replace(a=a.limit(1).drop("problem"), c=a)
    monkeypatch.undo()
    assert store.read("a").count() == 2 and not store.exists("c")
    store.quarantine("a", "aside", F.col("k") == 1, "odd")
    assert [r["k"] for r in store.read("a").collect()] == [0] and [tuple(r) for r in store.read("aside").collect()] == [(1, "odd")]
    store.delete("a", F.col("k") == 0, history="history")
    assert store.read("a").count() == 0 and [tuple(r) for r in store.read("history").collect()] == [(0, True)]
    store.logged("edgar:x", "a", lambda: 3)
    with pytest.raises(ZeroDivisionError):
        store.logged("edgar:y", "a", lambda: 1 // 0)
    assert sorted((r["source"], r["n_rows"], r["status"]) for r in store.read("ingest_log").collect()) == [("edgar:x", 3, "success"), ("edgar:y", 0, "failed")]


def bytes_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_appends_write_what_arrived(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    store.append(log=spark.range(100_000).selectExpr("id AS k", "uuid() AS v"))
    before = bytes_of(tmp_path / "log")
    store.append(log=spark.createDataFrame([(1, "x")], "k long, v string"))
    assert bytes_of(tmp_path / "log") - before < before / 100 and store.read("log").count() == 100_001
    store.append(log=spark.createDataFrame([(2,)], "k long"))
    assert store.read("log").where("v IS NULL").count() == 1
    with pytest.raises(ValueError, match="no column other"):
        store.append(log=spark.createDataFrame([(2, 3)], "k long, other long"))
    store.compact("log")
    assert store.read("log").count() == 100_002


SHA = "0aF9" * 16
FACT = "ticker string, period_end date, as_of_date date, metric string, issuer_id string, security_id string, run_id string, snapshot_id string, rowset_sha256 string, row_sha256 string, value double"


def fact(spark, *rows):
    out = []
    for ticker, known, lineage, value, issuer in rows:
        out.append((ticker, date(2023, 12, 31), date.fromisoformat(known), "revenue", issuer, None, *lineage, value))
    return spark.createDataFrame(out, FACT)


def test_facts_are_written_with_their_evidence_or_not_at_all(spark, tmp_path):
    store, none, whole = tables.Store(spark, str(tmp_path)), (None,) * 4, ("r1", "s1", SHA, SHA)
    kept = spark.createDataFrame([("r1", "s1")], "run_id string, snapshot_id string")
    store.append_facts("facts", fact(spark, ("A", "2024-02-01", whole, 1.0, "i"), ("B", "2024-02-01", none, 2.0, None)), kept)
    for rows, problem in (
        ([("C", "2024-02-01", ("r1", "s2", SHA, SHA), 1.0, "i")], "raw evidence is not retained"),
        ([("C", "2024-02-01", ("r1", "s1", SHA, None), 1.0, "i")], "lineage is not whole"),
        ([("C", "2024-02-01", ("r1", "s1", SHA, "f" * 63), 1.0, "i")], "digest is not one"),
        ([("C", "2024-02-01", whole, 1.0, " ")], "lineage without an issuer"),
        ([("C", "2023-02-01", none, 1.0, None)], "period ends after it was known"),
        ([("C", "2024-02-01", none, 1.0, None)] * 2, "key arrives more than once"),
        ([("C", "2024-02-01", none, 1.0, None), ("A", "2024-02-01", none, 9.0, None)], "would replace a fact with lineage"),
    ):
        with pytest.raises(Exception, match=problem):
            store.append_facts("facts", fact(spark, *rows), kept)
    store.append_facts("facts", fact(spark, ("A", "2024-02-01", whole, 3.0, "i"), ("B", "2024-02-01", whole, 4.0, "j")), kept)
    assert sorted((r["ticker"], r["version"], r["value"], r["issuer_id"]) for r in store.read("facts").collect()) == [("A", 1, 1.0, "i"), ("A", 2, 3.0, "i"), ("B", 1, 2.0, None), ("B", 2, 4.0, "j")]


def manifest(spark, path, kind, *lines, **options):
    path.write_text(",".join(manifests.MANIFESTS[kind].names) + "\n" + "\n".join(lines) + "\n")
    return sorted(r["problem"] or "" for r in manifests.read_manifest(spark, str(path), kind, **options).collect())


def test_manifest_rules(spark, tmp_path):
    file = tmp_path / "m.csv"
    cik = lambda issuer, number, start, end, name="N": f"{issuer},{name},T,{number},{start},{end},2024-01-01,https://sec.gov/x"
    assert manifest(spark, file, "issuer_ciks", cik("i", "0000000001", "2020-01-01", "2021-01-01"), cik("i", "0000000002", "2020-06-01", ""), cik("j", "12x", "2020-01-01", ""), cik("k", "0000000003", "2020-01-01", ""), cik("k", "0000000003", "2022-01-01", "", "M")) == ["", "CIK is not a number of up to ten digits", "overlaps the interval before", "rows of one issuer_id disagree", "rows of one issuer_id disagree"]
    event = lambda ticker, action, known, source="https://a.b/c": f"u,sp500,{ticker},2024-03-01,{action},{known},{source},index_announcement"
    events = (event("A", "addition", "2024-02-01"), event("B", "swap", "2024-02-01"), event("C", "deletion", "2024-04-01"), event("D", "deletion", "2024-02-01", "a paper"))
    assert manifest(spark, file, "universe_events", *events) == ["", "", "known after it is effective", "unknown action"]
    assert manifest(spark, file, "universe_events", *events, official=True) == ["", "known after it is effective", "source is not an https address", "unknown action"]
    conversion = lambda source, target, ratio, policy="carryover", status="verified": f"{source},{target},2024-03-01,2024-02-01,{ratio},{policy},{status},2024-03-02,s,b"
    assert manifest(spark, file, "conversions", conversion("a", "b", 1.5), conversion("b", "b", 1), conversion("c", "d", 0), conversion("e", "f", 1, "step-up"), conversion("g", "h", 1, status="open")) == ["", "converts into itself", "not verified", "ratio is not positive", "unknown basis policy"]
    extension = lambda security, provider, end: f"u,{security},T,{provider},T,2024-01-01,{end},2024-03-01,i,p,liquidation"
    assert manifest(spark, file, "price_extensions", extension("a", "yfinance", "2024-02-01"), extension("b", "other", "2024-02-01"), extension("c", "tiingo", "2024-02-25")) == ["", "extension is too long", "unknown provider"]


def test_reviewed_writes(spark):
    rows = [("u", "A", date(2020, 1, 1), date(2021, 1, 1), "s1", "bounded_ticker", "x"), ("u", "B", date(2021, 1, 1), None, "s1", "bounded_ticker", "y"), ("u", "C", date(2020, 1, 1), None, "s2", "bounded_ticker", "z")]
    df = spark.createDataFrame(rows, "universe_id string, ticker string, effective_start date, effective_end date, security_id string, identity_status string, source string")
    assert sorted((r["security_id"], r["canonical_ticker"], r["source"]) for r in reviewed.masters_of(df).collect()) == [("s1", "B", "y"), ("s2", "C", "z")]
    stored = spark.createDataFrame([("p1", "2020-01-01", 1.0), ("p1", "2020-01-02", 2.0), ("p2", "2020-01-01", 3.0)], "provenance_id string, date string, close double")
    arrived = spark.createDataFrame([(9.0, "p1", "2020-01-02")], "close double, provenance_id string, date string")
    assert sorted(map(tuple, reviewed.replaced_prices(stored, arrived).collect())) == [("p1", "2020-01-02", 9.0), ("p2", "2020-01-01", 3.0)]
    member = spark.createDataFrame([("u", "A", date(2020, 1, 1), None, None)], "universe_id string, ticker string, effective_start date, effective_end date, security_id string")
    arrives = spark.createDataFrame([("u", "A", date(2020, 1, 1), None, "s1", date(2019, 1, 1), "bounded_ticker", "r"), ("u", "D", date(2020, 1, 1), None, "s3", date(2019, 1, 1), "bounded_ticker", "r")], "universe_id string, ticker string, effective_start date, effective_end date, security_id string, known_date date, identity_status string, source string")
    kept = spark.createDataFrame([("u", "Z", date(2020, 6, 1), None, "s1", date(2019, 1, 1), "bounded_ticker", "r")], arrives.schema)
    assert {(r["ticker"], r["problem"]) for r in reviewed.identity_rows(arrives, member, kept).collect()} == {("A", None), ("Z", "security has two tickers at a time"), ("D", "is no membership")}

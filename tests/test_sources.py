"""Readers of provider documents on small documents."""

import gzip
import hashlib
import json
import zipfile

import pytest

from chronolake.operators import companyfacts
from chronolake.sources import archives, zipped
from chronolake.sources import documents as sources


def frame(spark, *payloads):
    return spark.createDataFrame([(f"k{n}", json.dumps(p)) for n, p in enumerate(payloads)], "key string, payload string")


def bar(day, **other):
    return {"date": f"{day}T00:00:00Z", "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "adjClose": 1.4, "volume": 10, "divCash": 0.0, "splitFactor": 1.0} | other


def test_daily_bars(spark):
    rows = sources.daily_bars(frame(spark, [bar("2024-01-02"), bar("2024-01-03", high=1.2)], [bar("2024-01-02"), bar("2024-01-02")], [bar("2024-01-02", divCash=-1)]))
    got = sorted((r["key"], str(r["date"]), r["problem"]) for r in rows.collect() if r["problem"])
    assert got == [("k0", "2024-01-03", "prices are not within high and low"), ("k1", "2024-01-02", "duplicate date"), ("k1", "2024-01-02", "duplicate date"), ("k2", "2024-01-02", "dividend is negative or missing")]
    assert sources.strict(rows.where("key = 'k0' AND problem IS NULL")).count() == 1
    with pytest.raises(Exception, match="duplicate date"):
        sources.strict(rows.where("key = 'k1'")).collect()


def test_exported_bars_normalise_later_splits(spark):
    days = [{"date": f"2024-01-0{k}", "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "adj_close": 1.4, "volume": 1, "dividends": 0.0, "stock_splits": s} for k, s in ((2, 0.0), (3, 2.0), (4, 0.0), (5, 3.0))]
    rows = sources.exported_bars(frame(spark, {"export_schema_version": 1, "provider": "yfinance", "provider_rows": days})).orderBy("date").collect()
    assert [r["split_normalization_factor"] for r in rows] == [6.0, 3.0, 3.0, 1.0] and not any(r["problem"] for r in rows)
    for other in ({"export_schema_version": 2}, {"provider": "x"}, {"provider_rows": None}):
        export = {"export_schema_version": 1, "provider": "yfinance", "provider_rows": days} | other
        assert [(r["close"], r["problem"]) for r in sources.exported_bars(frame(spark, export)).collect()] == [(None, "export is not supported")]


def test_yield_curve(spark):
    wide = spark.createDataFrame([("f", "01/02/2024", "5.4", "N/A"), ("f", "01/03/2024", "x", "101"), ("f", "13/45/2024", "1", None)], "key string, Date string, `3 Mo` string, `10 Yr` string")
    got = sorted((r["series_id"], r["value"], r["problem"]) for r in sources.yield_curve(wide, ["3 Mo", "10 Yr"]).collect() if r["value"] is not None)
    assert got == [("10 Yr", 101.0, "value is out of range"), ("3 Mo", 1.0, "date is not valid"), ("3 Mo", 5.4, None)]


def test_macro_vintages(spark):
    rows = [{"date": "2020-01-01", "realtime_start": "2020-02-01", "value": "100"}, {"date": "2020-01-01", "realtime_start": "2020-04-01", "value": "."}, {"date": "2020-01-01", "realtime_start": "2020-05-01", "value": "x"}, {"date": "soon", "realtime_start": "2020-05-01", "value": "1"}]
    own = {"export_schema_version": 1, "provider": "fred"}
    got = sources.macro_vintages(frame(spark, own | {"series_id": "GDP", "unit": "b", "provider_rows": rows}, own | {"series_id": "GDP"}, {"series_id": "GDP", "provider_rows": rows})).collect()
    assert sorted((r["key"], r["value"] or 0, r["problem"] or "") for r in got) == [("k0", 0, "value is not a number"), ("k0", 1.0, "date is not valid"), ("k0", 100.0, ""), ("k1", 0, "document holds no observations"), ("k2", 0, "export is not supported")]


def test_company_facts(spark):
    good = {"end": "2023-12-31", "val": 5.0, "accn": "a", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}
    late = good | {"end": "2024-03-01"}
    quarter = good | {"fp": "Q2", "end": "2023-06-30"}
    payload = {"cik": 1, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [good, late, quarter]}}}}}
    got = [(r["concept"], r["unit"], r["position"], r["label"], r["problem"]) for r in sources.company_facts(frame(spark, payload)).orderBy("position").collect()]
    assert got == [("Revenues", "USD", 0, "FY2023", None), ("Revenues", "USD", 1, "FY2023", "period ends after it was filed"), ("Revenues", "USD", 2, "Q2_2023", None)]
    assert [r["problem"] for r in sources.company_facts(frame(spark, [1])).collect()] == ["document holds no facts"]


def stored(spark, policy, **concepts):
    """Rows (metric, period, value, quarter value, unit, conflict) that a document of us-gaap facts gives."""
    payload = {"cik": concepts.pop("cik", 1), "facts": {"us-gaap": {c: {"units": u if isinstance(u, dict) else {"USD": u}} for c, u in concepts.items() if c != "dei"}, "dei": concepts.get("dei", {})}}
    rows = companyfacts.stored_facts(sources.company_facts(frame(spark, payload)), companyfacts.POLICIES[policy]).collect()
    return sorted((r["metric"], r["fiscal_period"], r["value"], r["quarter_value"], r["unit"], r["conflict"]) for r in rows)


def fact(val, end="2026-03-31", start="2026-01-01", **other):
    return {"start": start, "end": end, "val": val, "accn": "a1", "fy": 2026, "fp": "Q1", "form": "10-Q", "filed": "2026-05-01"} | other


V2, V3, V4 = "sec-companyfacts-v2-storage-safe-v2", "sec-companyfacts-v3", "sec-companyfacts-v4"


def test_quarters_come_from_spans(spark):
    half, quarter = (fact(v, "2026-06-30", start, fp="Q2", filed="2026-08-01") for v, start in ((30.0, "2026-01-01"), (20.0, "2026-04-01")))
    assert stored(spark, V2, Revenues=[half, quarter]) == [("revenue", "Q2_2026", 30.0, 20.0, "USD", True)]
    assert stored(spark, "sec-companyfacts-v2-storage-safe-v1", Revenues=[half, quarter]) == []
    assert len(stored(spark, "sec-companyfacts-v2", Revenues=[half, quarter])) == 2
    assert stored(spark, V3, Revenues=[half, quarter]) == [("revenue", "Q2_2026", 20.0, 20.0, "USD", False)]
    year = [fact(100.0, "2026-12-31", "2026-01-01", fp="FY", form="10-K", filed="2027-02-01"), fact(25.0, "2026-12-31", "2026-10-01", fp="FY", form="10-K", filed="2027-02-01")]
    assert stored(spark, V3, Revenues=year) == [("revenue", "FY2026", 100.0, 100.0, "USD", False)]


def test_the_preferred_concept_wins_within_a_filing(spark):
    assert stored(spark, V2, Revenues=[fact(5.0)], SalesRevenueNet=[fact(6.0), fact(7.0, accn="a2", filed="2026-05-02")]) == [("revenue", "Q1_2026", 5.0, 5.0, "USD", False), ("revenue", "Q1_2026", 7.0, 7.0, "USD", False)]
    assert stored(spark, V3, Revenues=[fact(5.0)], SalesRevenueNet=[fact(6.0)]) == []  # they disagree: withheld
    assert stored(spark, V4, Revenues=[fact(5.0)], SalesRevenueNet=[fact(6.0)]) == [("revenue", "Q1_2026", 5.0, 5.0, "USD", False)]


def test_units_forms_and_late_facts(spark):
    assert stored(spark, V3, Revenues={"EUR": [fact(5.0)]}) == [] and stored(spark, V2, Revenues={"EUR": [fact(5.0)]}) == [("revenue", "Q1_2026", 5.0, 5.0, "USD", False)]
    assert stored(spark, V3, Revenues=[fact(5.0, form="S-1")]) == [] and len(stored(spark, V3, Revenues=[fact(5.0, form="8-K")])) == 1
    assert stored(spark, V2, Revenues=[fact(5.0, end="2026-06-01")]) == []
    assert stored(spark, V3, Revenues=[fact(5.0), fact(6.0, fp="Q2")]) == []  # one filing, two fiscal periods


def test_shares_are_instants_of_their_own_taxonomy(spark):
    share = fact(123.0, "2026-04-17", None, fp="Q2")
    own = {companyfacts.ENTITY_SHARES: {"units": {"shares": [share, share]}}}
    assert stored(spark, V3, dei=own) == [("shares_out", "Q2_2026", 123.0, 123.0, "shares", False)] and stored(spark, V2, dei=own) == []
    assert stored(spark, V3, EntityCommonStockSharesOutstanding={"shares": [share]}) == []
    assert stored(spark, V3, CommonStockSharesOutstanding={"shares": [share | {"start": "2026-01-01"}]}) == []


def test_revenue_of_reviewed_issuers(spark):
    gross, excise = [fact(50.0)], [fact(8.0)]
    named = {companyfacts.GROSS_REVENUE: gross, companyfacts.EXCISE_TAXES: excise}
    assert stored(spark, V4, **named) == [] and stored(spark, V4, cik=109198, **named) == [("revenue", "Q1_2026", 50.0, 50.0, "USD", False)]
    assert stored(spark, V4, cik=1035002, **named, Revenues=[fact(49.0)]) == [("revenue", "Q1_2026", 42.0, 42.0, "USD", False)]
    assert stored(spark, V4, cik=72971, Revenues=[fact(5.0)]) == [] and stored(spark, V3, cik=72971, Revenues=[fact(5.0)]) != []


def test_members_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for name, text in (("x/CIK0000000001.json", "{}"), ("readme.txt", "no"), ("CIK0000000002.json", "{1}"), ("y/CIK0000000002.json", "{2}")):
            archive.writestr(name, text)
        archive.writestr("CIK0000000003.json", b"\xff\xfe")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = sorted((r["archive"].rsplit("/", 1)[-1], r["key"] or "", r["payload"] or "", r["problem"] or "") for r in archives.members(spark, str(tmp_path)).collect())
    assert got == [("a.zip", "CIK0000000001.json", "{}", ""), ("a.zip", "CIK0000000002.json", "{1}", "member stands twice"), ("a.zip", "CIK0000000002.json", "{2}", "member stands twice"), ("a.zip", "CIK0000000003.json", "", "member can't be read"), ("b.zip", "", "", "not an archive")]


def test_an_archive_is_read_in_ranges(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_STORED) as archive:
        for k in range(400):
            archive.writestr(f"CIK{k:010}.json", f"{k} " * 200)
    whole = bytearray((tmp_path / "many.zip").read_bytes())
    at = whole.index(b"7 7 7 7 ")
    whole[at : at + 4] = b"x x "  # the checksum of one member no longer fits
    (tmp_path / "many.zip").write_bytes(whole)
    rows = archives.members(spark, f"{tmp_path}/*.zip", range_bytes=20_000)
    assert rows.rdd.getNumPartitions() == -(-len(whole) // 20_000) > 10
    got = {r["key"]: (r["payload"], r["problem"]) for r in rows.collect()}
    assert got == {f"CIK{k:010}.json": (f"{k} " * 200, None) if k != 7 else (None, "member can't be read") for k in range(400)}
    assert {r["problem"] for r in zipped.read(spark, str(tmp_path), most_bytes=10).collect()} == {"member is too large"}
    with pytest.raises(Exception, match="nowhere.zip"):
        archives.members(spark, f"{tmp_path}/nowhere.zip").collect()


def test_named_tickers_get_their_issuer(spark):
    payload = {"0": {"cik_str": 7, "ticker": "xom", "title": "Holdings"}, "1": {"cik_str": 8, "ticker": "A", "title": "A"}}
    assert {(r["ticker"], r["cik"], r["problem"]) for r in archives.ticker_map(frame(spark, payload)).collect()} == {("XOM", 34088, None), ("A", 8, None)}
    assert {r["cik"] for r in archives.ticker_map(frame(spark, payload), {"A": 9}).collect()} == {7, 9}


def test_component_columns_beyond_any_number_and_quoted_cells(spark):
    head = ",".join(["Security"] + [f"x{k}" for k in range(40)] + ["CIK", "Symbol"])
    line = ",".join(['"Alpha, ""the"" Inc"'] + ["1"] * 40 + ['"0000000012"', "aa"])
    docs = spark.createDataFrame([("k", f"{head}\n{line}\n")], "key string, payload string")
    assert [(r["ticker"], r["cik"], r["problem"]) for r in archives.components(docs).collect()] == [("AA", "0000000012", None)]


def test_ticker_map(spark):
    payload = {"0": {"cik_str": 1, "ticker": "a", "title": "A Inc"}, "1": {"cik_str": 0, "ticker": "B", "title": "B"}, "2": {"cik_str": 3, "ticker": "C", "title": ""}, "3": {"cik_str": 4, "ticker": "D", "title": "x"}, "4": {"cik_str": 5, "ticker": "d", "title": "y"}}
    got = sorted((r["ticker"], r["problem"] or "") for r in archives.ticker_map(frame(spark, payload)).collect())
    assert got == [("A", ""), ("B", "CIK is not positive"), ("C", "lacks a title"), ("D", "ticker stands twice"), ("D", "ticker stands twice")]


def release(*rows):
    return "<html><table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table></html>"


def test_constituent_changes(spark):
    head = ("Effective Date", "Index Name", "Action", "Company Name", "Ticker")
    fine = release(head, ("Sept 1, 2024", "S&amp;P MidCap 400", "Addition", "M", "MM"), ("September 23, 2024", "S&amp;P 500", "Addition", "Dell <b>Inc</b>", "dell"), ("Sep 23, 2024", "S&P&nbsp;500", "Deletion", "Etsy", "ETSY"))
    pages = [fine, release(("September 23, 2024", "S&P 500", "Addition", "A", "A")), release(("soon", "S&P 500", "Addition", "A", "A"), ("May 1, 2024", "S&P 500", "Deletion", "B", "B b")), release(head), release(("May 1, 2024", "S&P 500", "x", "Addition", "A", "A"))]
    docs = spark.createDataFrame([(f"k{n}", p) for n, p in enumerate(pages)], "key string, payload string")
    got = sorted((r["key"], str(r["effective_date"]), r["action"] or "", r["company"] or "", r["ticker"] or "", r["problem"] or "") for r in archives.constituent_changes(docs).collect())
    assert got == [
        ("k0", "2024-09-23", "addition", "Dell Inc", "DELL", ""),
        ("k0", "2024-09-23", "deletion", "Etsy", "ETSY", ""),
        ("k1", "2024-09-23", "addition", "A", "A", "additions and deletions do not balance"),
        ("k2", "2024-05-01", "deletion", "B", "B B", "ticker is not valid"),
        ("k2", "None", "addition", "A", "A", "no single date"),
        ("k3", "None", "", "", "", "no change of the index"),
        ("k4", "2024-05-01", "addition", "A", "A", "index and action are not clear"),
    ]


def test_components(spark):
    docs = spark.createDataFrame([("a", '\ufeffSymbol,Security,CIK\r\nMMM,"3M, Inc",66740\naos,Smith,91142\nX,,none\nBRK B,x,5\nMMM,again,1\n'), ("b", "Ticker,CIK\nA,1")], "key string, payload string")
    got = sorted((r["key"], r["ticker"] or "", r["cik"] or "", r["problem"] or "") for r in archives.components(docs).collect())
    assert got == [("a", "AOS", "0000091142", ""), ("a", "BRK B", "0000000005", "ticker is not valid"), ("a", "MMM", "0000000001", "ticker stands twice"), ("a", "MMM", "0000066740", "ticker stands twice"), ("a", "X", "", "CIK is not valid"), ("b", "", "", "lacks Symbol or CIK")]
    assert {r["problem"] for r in archives.components(docs.where("key = 'a'"), least=10).collect()} >= {"list is too short or too long"}


def test_kept_payloads(spark, tmp_path):
    rows = []
    for name, data in (("a", b"one"), ("b", b"two"), ("c", b"three"), ("d", b"four")):
        packed = gzip.compress(data if name != "b" else b"TWO")
        (tmp_path / name).write_bytes(packed if name != "c" else b"junk")
        rows.append((f"s{name}", name, hashlib.sha256(data).hexdigest(), len(data), len(packed) if name != "d" else 1))
    rows.append(("se", "e", "", 0, 0))
    expected = spark.createDataFrame(rows, "snapshot_id string, file string, payload_sha256 string, original_bytes long, stored_bytes long")
    got = sorted((r["snapshot_id"], r["payload"] or "", r["problem"] or "") for r in archives.kept_payloads(spark, str(tmp_path), expected).collect())
    assert got == [("sa", "one", ""), ("sb", "", "payload has another digest"), ("sc", "", "file can't be unpacked"), ("sd", "", "file has another size"), ("se", "", "file is not there")]

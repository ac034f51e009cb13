"""The store's checks: a sound store passes all of them, and a planted fault is counted by the check that looks for it."""

import pytest
from pyspark.sql import functions as F

from chronolake.operators import quality

H = "a" * 64
SOUND = {
    "security_master": ("security_id string", [("s1",), ("s2",)]),
    "issuer_master": ("issuer_id string", [("i1",)]),
    "issuer_cik_history": ("issuer_id string, cik string, effective_start string, effective_end string, verified_date string", [("i1", "1", "2020-01-01", "2021-01-01", "2022-01-01"), ("i1", "2", "2021-01-01", None, "2022-01-01")]),
    "security_issuer_assignments": ("security_id string, issuer_id string, effective_start string, effective_end string, verified_date string", [("s1", "i1", "2020-01-01", None, "2022-01-01")]),
    "provider_symbol_history": ("provider string, provider_symbol string, security_id string, data_start string, data_end string, mapping_status string, verified_date string", [("yfinance", "A", "s1", "2020-01-01", "2023-01-01", "verified", "2022-01-01")]),
    "security_identity_assignments": ("universe_id string, ticker string, effective_start string, effective_end string, security_id string, known_date string", [("u", "A", "2020-01-01", "2023-01-01", "s1", "2020-01-01"), ("u", "B", "2020-01-01", None, "s2", "2020-01-01")]),
    "universe_membership": ("universe_id string, ticker string, security_id string, effective_start string, effective_end string, known_date string, end_known_date string", [("u", "A", "s1", "2020-01-01", "2023-01-01", "2019-12-01", "2022-12-01")]),
    "security_conversions": ("source_security_id string, target_security_id string, effective_date string, known_date string, share_ratio double, basis_policy string, review_status string, verified_date string, source string, basis_source string", [("s1", "s2", "2022-01-01", "2021-12-01", 1.5, "carryover", "verified", "2022-02-01", "https://a", "https://b")]),
    "security_ticker_extensions": ("universe_id string, security_id string, ticker string, provider string, provider_symbol string, data_start string, data_end string, verified_date string, purpose string, review_policy string, payload_sha256 string, identity_source string, provider_source string", [("u", "s1", "A", "yfinance", "A", "2023-01-01", "2023-02-01", "2023-03-01", "portfolio_liquidation", "adjacent_identity_provider_v1", H, "https://a", "https://b")]),
    "prices": ("ticker string, security_id string, provider_symbol string, date string, close double, actions_complete boolean, close_split_adjusted boolean, split_normalization_factor double, source string", [("A", "s1", "A", "2021-01-01", 5.0, True, True, 1.0, "yfinance"), ("A", "s1", "A", "2021-01-02", 5.0, True, False, None, "yfinance")]),
    "factor_price_provenance": ("provenance_id string, security_id string, provider string, provider_symbol string, data_start string, data_end string, overlap_start string, overlap_end string, verified_date string, payload_sha256 string, overlap_sha256 string", [("p1", "s1", "yfinance", "A", "2019-01-01", "2020-01-01", "2020-01-01", "2020-02-01", "2021-01-01", H, H)]),
    "factor_prices": ("security_id string, date string, provider string, provider_symbol string, close double, dividends double, split_ratio double, actions_complete boolean, close_split_adjusted boolean, split_normalization_factor double, provenance_id string", [("s1", "2019-05-01", "yfinance", "A", 5.0, 0.0, 1.0, True, True, 1.0, "p1")]),
    "macro": ("series_id string, date string, release_date string, value double, source string, fetched_at string", [("T", "2020-01-01", "2020-01-02", 1.0, "fred", "a"), ("T", "2020-01-01", "2020-01-02", 1.04, "treasury", "a")]),
    "fundamentals": ("ticker string, issuer_id string, security_id string, period_end string, as_of_date string, metric string, value double, quarter_value double, unit string", [("A", "i1", "s1", "2020-12-31", "2021-02-01", "revenue", 5.0, 5.0, "USD")]),
    "fundamental_versions": ("version_sequence long, ticker string, period_end string, as_of_date string, metric string, value double, quarter_value double, unit string, is_deleted boolean", [(1, "A", "2020-12-31", "2021-02-01", "revenue", 5.0, 5.0, "USD", False)]),
    "fundamental_evidence_generations": ("generation_id string, version_sequence long", [("g", 1)]),
    "ingest_log": ("source string, status string, rows_inserted long", [("a", "success", 3)]),
}


@pytest.fixture(autouse=True)
def tiny(spark):
    """Relations of a few rows: some fifty joins are planned and run faster without compiled code and re-planning."""
    confs = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def store(spark, **changed):
    """The sound store with rows added; a row gives only what differs from the relation's first row."""
    out = {}
    for name, (schema, rows) in SOUND.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        more = [tuple(({c: v for c, v in zip(columns, rows[0])} | other)[c] for c in columns) for other in changed.get(name, [])]
        df = spark.createDataFrame(rows + more, schema)
        out[name] = df.withColumns({c: F.col(c).cast("date") for c in columns if c.endswith(("_date", "_start", "_end")) or c == "date"})
    return out


def bad(spark, **changed):
    return {r["name"]: r["n_bad"] for r in quality.report(store(spark, **changed)).where("n_bad > 0").collect()}


def test_a_sound_store_passes(spark):
    rows = quality.report(store(spark)).collect()
    assert [r["name"] for r in rows if r["n_bad"]] == [] and len(rows) == len({c.name for c in quality.CHECKS}) + 3 and all(r["status"] == "ok" for r in rows)


@pytest.mark.parametrize(
    "changed, found",
    [
        ({"fundamentals": [{"as_of_date": None}, {"period_end": "2022-01-01"}, {"metric": "ebitda"}, {"quarter_value": None}]}, {"fundamentals_missing_as_of_date": 1, "fundamentals_period_end_after_as_of_date": 1, "legacy_mislabeled_ebitda": 1, "fundamentals_missing_quarter_value": 1, "fundamental_evidence_unversioned_projection": 4, "fundamental_evidence_latest_projection_mismatch": 4}),
        ({"fundamentals": [{"issuer_id": "x"}, {"security_id": "s2"}, {"issuer_id": None, "security_id": "s2"}, {"security_id": None}]}, {"tagged_fundamentals_orphan_identities": 3}),
        ({"fundamental_versions": [{"version_sequence": 2, "value": 6.0}], "fundamental_evidence_generations": [{"version_sequence": 3}]}, {"fundamental_evidence_latest_projection_mismatch": 1, "fundamental_evidence_generation_ahead_of_history": 1}),
        ({"prices": [{"close": None}, {"close": float("nan")}, {"actions_complete": None}, {"close_split_adjusted": None}, {"split_normalization_factor": None}, {"split_normalization_factor": 0.0}, {"source": quality.REPAIRED}]}, {"prices_missing_close": 2, "prices_unverified_corporate_actions": 1, "prices_unknown_split_adjustment_basis": 1, "tagged_prices_unknown_split_normalization_factor": 1, "prices_invalid_split_normalization_factor": 1, "prices_repaired_ohlc_envelope": 1}),
        ({"prices": [{"date": "2023-01-15"}, {"ticker": "Z"}, {"source": "tiingo"}]}, {"tagged_prices_outside_provider_provenance": 2, "tagged_prices_wrong_dated_ticker": 1}),
        ({"universe_membership": [{"ticker": "C", "effective_end": "2019-01-01"}, {"ticker": "D", "end_known_date": None}, {"ticker": "E", "security_id": None}, {"ticker": "F", "security_id": "s9"}, {"effective_start": "2022-06-01", "known_date": "2999-01-01"}]}, {"universe_invalid_intervals": 1, "universe_missing_end_known_dates": 1, "universe_invalid_end_known_dates": 2, "universe_missing_security_ids": 1, "universe_orphan_security_ids": 1, "universe_future_known_dates": 1, "universe_overlapping_intervals": 1, "security_identity_membership_mismatches": 4}),
        ({"security_conversions": [{"share_ratio": 0.0}, {"target_security_id": "s9"}, {"effective_date": "2024-01-01"}, {"source": "http://a"}]}, {"security_conversion_invalid_rows": 2, "security_conversion_orphans": 1, "security_conversion_missing_dated_tickers": 2}),
        ({"security_ticker_extensions": [{"data_end": "2023-03-01"}, {"payload_sha256": "x"}, {"data_start": "2023-01-02"}]}, {"security_ticker_extension_invalid_rows": 2, "security_ticker_extension_broken_anchors": 1}),
        ({"factor_price_provenance": [{"provenance_id": "p2", "overlap_start": "2020-01-02"}, {"provenance_id": "p3", "security_id": "s9"}], "factor_prices": [{"close": 0.0}, {"date": "2020-05-01"}, {"provenance_id": "p9"}]}, {"factor_price_provenance_invalid_intervals": 1, "factor_price_provenance_orphans": 1, "factor_price_provenance_unanchored": 1, "factor_prices_invalid_rows": 1, "factor_prices_outside_provenance": 2}),
        ({"macro": [{"value": None}, {"release_date": None}, {"source": "treasury", "release_date": "2020-01-03", "value": 1.2}]}, {"macro_missing_value": 1, "macro_unversioned_rows": 1}),
        ({"issuer_cik_history": [{"issuer_id": "i9"}, {"effective_start": "2020-06-01", "verified_date": "2999-01-01"}], "provider_symbol_history": [{"security_id": "s2"}]}, {"reference_identity_orphans": 1, "reference_identity_overlapping_intervals": 1, "reference_identity_future_verification_dates": 1, "provider_symbol_overlapping_reuse": 1}),
        ({"ingest_log": [{"status": "failed", "rows_inserted": 0}, {"rows_inserted": 0}]}, {"failed_ingests": 1, "zero_row_ingests": 1}),
    ],
)
def test_planted_faults_are_counted(spark, changed, found):
    got = bad(spark, **changed)
    if "macro" in changed:  # the null comes last by vintage, or first: the two sources differ by 0.2 either way or say nothing
        got.pop("macro_primary_fallback_divergence", None)
    assert got == found


def test_sources_that_differ(spark):
    assert bad(spark, macro=[{"source": "treasury", "release_date": "2020-01-03", "value": 1.2}]) == {"macro_primary_fallback_divergence": 1}

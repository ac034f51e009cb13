"""Checks of whole stores: each counts the rows of a relation that break one rule, and the report has a row for each check.

Checks are declared by what they need: a predicate of a row; a match that lacks in another relation; an interval that begins
before the one before it has ended; or a difference of two relations. Checks of one kind on one relation share its scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import first_per


@dataclass(frozen=True)
class Check:
    """name, severity where any row is bad; relation and the predicate (SQL) of rows that are concerned.

    ``lacks``: (relation, condition over l and r) pairs; a concerned row is bad if any pair has no match (all of them, where
    ``every`` is set). Without it the concerned rows are bad themselves.
    """

    name: str
    severity: str
    relation: str
    rows: str = "true"
    lacks: tuple[tuple[str, str], ...] = ()
    every: bool = False


@dataclass(frozen=True)
class Apart:
    """Rows that begin before the row before them, of the same keys, has ended; an open one never ends."""

    name: str
    severity: str
    relations: tuple[tuple[str, tuple[str, ...], str, str], ...]


FUTURE = "{} > current_date()"
HASH = "NOT coalesce({} RLIKE '^[0-9a-f]{{64}}$', false)"
HTTPS = "NOT coalesce(startswith({}, 'https://'), false)"
FACT_KEY = "l.ticker = r.ticker AND l.period_end = r.period_end AND l.as_of_date = r.as_of_date AND l.metric = r.metric"
FACT_SAME = FACT_KEY + " AND l.value <=> r.value AND l.quarter_value <=> r.quarter_value AND l.unit <=> r.unit AND NOT r.is_deleted"
COVERS = "r.effective_start <= {0} AND (r.effective_end IS NULL OR r.effective_end > {0})"
WINDOW = "r.data_start <= {0} AND (r.data_end IS NULL OR r.data_end > {0})"
#: The source of a price whose envelope was widened, and its provider. Fixed values.
REPAIRED = "yfinance:ohlc-envelope-v1"
PROVIDER = f"CASE WHEN l.source = '{REPAIRED}' THEN 'yfinance' ELSE l.source END"
FLOWS = "'revenue', 'net_income', 'operating_income', 'gross_profit', 'rd_expense', 'interest_expense', 'depreciation', 'cfo', 'capex', 'dividends_paid'"

#: The checks and their severities. Fixed values.
CHECKS: tuple[Check | Apart, ...] = (
    Check("fundamentals_missing_as_of_date", "fail", "fundamentals", "as_of_date IS NULL"),
    Check("fundamentals_future_as_of_date", "fail", "fundamentals", FUTURE.format("as_of_date")),
    Check("fundamentals_period_end_after_as_of_date", "fail", "fundamentals", "period_end > as_of_date"),
    Check("fundamental_evidence_unversioned_projection", "fail", "fundamentals", lacks=(("fundamental_versions", FACT_SAME),)),
    Check("fundamental_evidence_generation_ahead_of_history", "fail", "fundamental_evidence_generations", lacks=(("fundamental_versions", "l.version_sequence <= r.version_sequence"),)),
    Check("fundamentals_missing_quarter_value", "warn", "fundamentals", f"quarter_value IS NULL AND metric IN ({FLOWS})"),
    Check("legacy_mislabeled_ebitda", "warn", "fundamentals", "metric = 'ebitda'"),
    Check("prices_missing_close", "fail", "prices", "NOT coalesce(close > 0 AND close < double('infinity'), false)"),
    Check("prices_unverified_corporate_actions", "warn", "prices", "NOT coalesce(actions_complete, false)"),
    Check("prices_repaired_ohlc_envelope", "warn", "prices", f"source = '{REPAIRED}'"),
    Check("prices_unknown_split_adjustment_basis", "fail", "prices", "close_split_adjusted IS NULL"),
    Check("tagged_prices_unknown_split_normalization_factor", "fail", "prices", "security_id IS NOT NULL AND close_split_adjusted AND split_normalization_factor IS NULL"),
    Check("prices_invalid_split_normalization_factor", "fail", "prices", "split_normalization_factor <= 0"),
    Check("factor_price_provenance_invalid_intervals", "fail", "factor_price_provenance", f"data_end <= data_start OR overlap_start <> data_end OR overlap_end <= overlap_start OR {HASH.format('payload_sha256')} OR {HASH.format('overlap_sha256')}"),
    Check("factor_price_provenance_future_verification_dates", "fail", "factor_price_provenance", FUTURE.format("verified_date")),
    Check("factor_price_provenance_orphans", "fail", "factor_price_provenance", lacks=(("security_master", "l.security_id = r.security_id"),)),
    Check("factor_price_provenance_unanchored", "fail", "factor_price_provenance", lacks=(("provider_symbol_history", "l.security_id = r.security_id AND l.provider = r.provider AND l.provider_symbol = r.provider_symbol AND r.mapping_status = 'verified' AND r.data_start = l.data_end"),)),
    Check("factor_prices_outside_provenance", "fail", "factor_prices", lacks=(("factor_price_provenance", "l.provenance_id = r.provenance_id AND l.security_id = r.security_id AND l.provider = r.provider AND l.provider_symbol = r.provider_symbol AND l.date >= r.data_start AND l.date < r.data_end"),)),
    Check("factor_prices_invalid_rows", "fail", "factor_prices", "close <= 0 OR dividends < 0 OR split_ratio <= 0 OR NOT coalesce(actions_complete, false) OR close_split_adjusted IS NULL OR split_normalization_factor <= 0"),
    Check("macro_missing_value", "warn", "macro", "value IS NULL"),
    Check("macro_unversioned_rows", "fail", "macro", "release_date IS NULL"),
    Check("macro_future_release_date", "fail", "macro", FUTURE.format("release_date")),
    Check("universe_invalid_intervals", "fail", "universe_membership", "effective_end <= effective_start"),
    Check("universe_missing_end_known_dates", "fail", "universe_membership", "effective_end IS NOT NULL AND end_known_date IS NULL"),
    Check("universe_invalid_end_known_dates", "fail", "universe_membership", "end_known_date IS NOT NULL AND (effective_end IS NULL OR end_known_date < known_date OR end_known_date > effective_end)"),
    Check("universe_future_known_dates", "fail", "universe_membership", f"{FUTURE.format('known_date')} OR {FUTURE.format('end_known_date')}"),
    Apart("universe_overlapping_intervals", "fail", (("universe_membership", ("universe_id", "ticker"), "effective_start", "effective_end"),)),
    Check("universe_missing_security_ids", "fail", "universe_membership", "security_id IS NULL"),
    Check("universe_orphan_security_ids", "fail", "universe_membership", "security_id IS NOT NULL", (("security_master", "l.security_id = r.security_id"),)),
    Check("security_identity_membership_mismatches", "fail", "universe_membership", "security_id IS NOT NULL", (("security_identity_assignments", "l.universe_id = r.universe_id AND l.ticker = r.ticker AND l.effective_start = r.effective_start AND l.security_id = r.security_id AND l.effective_end <=> r.effective_end"),)),
    Check("security_identity_future_known_dates", "fail", "security_identity_assignments", FUTURE.format("known_date")),
    Apart("security_identity_overlapping_tickers", "fail", (("security_identity_assignments", ("universe_id", "security_id"), "effective_start", "effective_end"),)),
    Check("issuer_cik_invalid_intervals", "fail", "issuer_cik_history", "effective_end <= effective_start"),
    Check("reference_identity_future_verification_dates", "fail", "issuer_cik_history", FUTURE.format("verified_date")),
    Check("reference_identity_future_verification_dates", "fail", "security_issuer_assignments", FUTURE.format("verified_date")),
    Check("reference_identity_future_verification_dates", "fail", "provider_symbol_history", FUTURE.format("verified_date")),
    Check("security_conversion_invalid_rows", "fail", "security_conversions", f"source_security_id = target_security_id OR known_date > effective_date OR NOT coalesce(share_ratio > 0 AND share_ratio < double('infinity'), false) OR basis_policy <> 'carryover' OR review_status <> 'verified' OR {FUTURE.format('verified_date')} OR {HTTPS.format('source')} OR {HTTPS.format('basis_source')}"),
    Check("security_conversion_orphans", "fail", "security_conversions", lacks=(("security_master", "l.source_security_id = r.security_id"), ("security_master", "l.target_security_id = r.security_id"))),
    Check("security_conversion_missing_dated_tickers", "fail", "security_conversions", lacks=(("security_identity_assignments", "l.source_security_id = r.security_id AND " + COVERS.format("l.effective_date")), ("security_identity_assignments", "l.target_security_id = r.security_id AND r.known_date <= l.effective_date AND " + COVERS.format("l.effective_date")))),
    Check("security_ticker_extension_invalid_rows", "fail", "security_ticker_extensions", f"data_end <= data_start OR datediff(data_end, data_start) > 45 OR {FUTURE.format('verified_date')} OR purpose <> 'portfolio_liquidation' OR review_policy <> 'adjacent_identity_provider_v1' OR {HASH.format('payload_sha256')} OR {HTTPS.format('identity_source')} OR {HTTPS.format('provider_source')}"),
    Check("security_ticker_extension_broken_anchors", "fail", "security_ticker_extensions", lacks=(("security_master", "l.security_id = r.security_id"), ("security_identity_assignments", "l.universe_id = r.universe_id AND l.security_id = r.security_id AND l.ticker = r.ticker AND r.effective_end = l.data_start"), ("provider_symbol_history", "l.security_id = r.security_id AND l.provider = r.provider AND l.provider_symbol = r.provider_symbol AND r.mapping_status = 'verified' AND r.data_end = l.data_start"))),
    Check("reference_identity_orphans", "fail", "issuer_cik_history", lacks=(("issuer_master", "l.issuer_id = r.issuer_id"),)),
    Check("reference_identity_orphans", "fail", "security_issuer_assignments", lacks=(("security_master", "l.security_id = r.security_id"), ("issuer_master", "l.issuer_id = r.issuer_id"))),
    Check("reference_identity_orphans", "fail", "provider_symbol_history", lacks=(("security_master", "l.security_id = r.security_id"),)),
    Apart("reference_identity_overlapping_intervals", "fail", (("issuer_cik_history", ("issuer_id",), "effective_start", "effective_end"), ("security_issuer_assignments", ("security_id",), "effective_start", "effective_end"), ("provider_symbol_history", ("provider", "security_id"), "data_start", "data_end"))),
    Check("tagged_prices_outside_provider_provenance", "fail", "prices", "security_id IS NOT NULL", (("provider_symbol_history", f"l.security_id = r.security_id AND l.provider_symbol = r.provider_symbol AND r.mapping_status = 'verified' AND r.provider = {PROVIDER} AND " + WINDOW.format("l.date")),)),
    Check("tagged_prices_wrong_dated_ticker", "fail", "prices", "security_id IS NOT NULL", (("security_identity_assignments", "l.security_id = r.security_id AND l.ticker = r.ticker AND " + COVERS.format("l.date")), ("security_ticker_extensions", f"l.security_id = r.security_id AND l.ticker = r.ticker AND l.provider_symbol = r.provider_symbol AND r.provider = {PROVIDER} AND " + WINDOW.format("l.date"))), every=True),
    Check("tagged_fundamentals_orphan_identities", "fail", "fundamentals", "issuer_id IS NOT NULL AND security_id IS NULL", (("issuer_master", "l.issuer_id = r.issuer_id"),)),
    Check("tagged_fundamentals_orphan_identities", "fail", "fundamentals", "issuer_id IS NULL AND security_id IS NOT NULL", (("security_issuer_assignments", "l.security_id = r.security_id"),)),
    Check("tagged_fundamentals_orphan_identities", "fail", "fundamentals", "issuer_id IS NOT NULL AND security_id IS NOT NULL", (("issuer_master", "l.issuer_id = r.issuer_id"), ("security_issuer_assignments", "l.security_id = r.security_id AND l.issuer_id = r.issuer_id"))),
    Check("failed_ingests", "warn", "ingest_log", "status = 'failed'"),
    Check("zero_row_ingests", "warn", "ingest_log", "status = 'success' AND rows_inserted = 0"),
)


def bad_rows(relations: Mapping[str, DataFrame], check: Check) -> DataFrame:
    """The rows that break a check that needs other relations: anti joins on its equal columns, ranges beside them."""
    left = relations[check.relation].where(check.rows).withColumn("_id", F.monotonically_increasing_id())
    parts = []
    for other, condition in check.lacks:
        # The highest sequence stands for a whole history that is only compared by order.
        right = relations[other].agg(F.max("version_sequence").alias("version_sequence")) if condition == "l.version_sequence <= r.version_sequence" else relations[other]
        parts.append(left.alias("l").join(right.alias("r"), F.expr(condition), "left_anti"))
    if len(parts) == 1:
        return parts[0].drop("_id")
    if check.every:  # what one anti join leaves goes through the next
        rest = left
        for other, condition in check.lacks:
            rest = rest.alias("l").join(relations[other].alias("r"), F.expr(condition), "left_anti")
        return rest.drop("_id")
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["_id"]).drop("_id")


def out_of_turn(rows: DataFrame, keys: tuple[str, ...], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last())
    marked = rows.withColumns({"_r": F.row_number().over(w), "_before": F.lag(end).over(w)})
    return marked.where((F.col("_r") > 1) & (F.col("_before").isNull() | (F.col(start) < F.col("_before")))).drop("_r", "_before")


def source_divergence(macro: DataFrame, first: str = "fred", second: str = "treasury", most: float = 0.05) -> DataFrame:
    """Observations on which the newest vintages of two sources differ by more than ``most``."""
    newest = lambda source, name: first_per(macro.where(F.col("source") == source), ["series_id", "date"], [F.col("release_date").desc_nulls_last(), F.col("fetched_at").desc_nulls_last()]).select("series_id", "date", F.col("value").alias(name))
    return newest(first, "_a").join(newest(second, "_b"), ["series_id", "date"]).where(F.abs(F.col("_a") - F.col("_b")) > most)


def symbol_reuse(mappings: DataFrame) -> DataFrame:
    """Pairs of securities that claim one provider symbol at one time, by verified mappings."""
    fine = mappings.where("mapping_status = 'verified'").withColumn("data_end", F.coalesce("data_end", F.lit("9999-12-31").cast("date")))
    a, b = fine.alias("a"), fine.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("provider", "provider_symbol")] + [F.col("b.security_id") > F.col("a.security_id"), F.col("a.data_end") > F.col("b.data_start"), F.col("b.data_end") > F.col("a.data_start")]
    return a.join(b, on).select("a.provider", "a.provider_symbol", F.col("a.security_id").alias("first_id"), F.col("b.security_id").alias("second_id"))


def stale_projection(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """Keys on which the facts and the last version that isn't deleted differ, or that only one of the two has."""
    keys = ["ticker", "period_end", "as_of_date", "metric"]
    last = first_per(versions, keys, [F.col("version_sequence").desc()]).where("NOT is_deleted")
    said = lambda df, name: df.select(*keys, F.struct("value", "quarter_value", "unit").alias(name), F.lit(True).alias(f"{name}_there"))
    return said(facts, "_a").join(said(last, "_b"), keys, "full_outer").where(F.col("_a_there").isNull() | F.col("_b_there").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("name"), "n_bad")


def report(relations: Mapping[str, DataFrame], checks: tuple[Check | Apart, ...] = CHECKS) -> DataFrame:
    """name, severity, n_bad, status (ok, or the severity) for every check whose relations are all there.

    Rules of a row share one scan of their relation; each other check is one anti join, window or full join.
    """
    there = lambda *names: all(n in relations for n in names)
    parts, plain = [], {}
    for check in checks:
        if isinstance(check, Apart):
            parts += [_counted(out_of_turn(relations[r], keys, start, end), check.name) for r, keys, start, end in check.relations if there(r)]
        elif check.lacks:
            if there(check.relation, *[r for r, _ in check.lacks]):
                parts.append(_counted(bad_rows(relations, check), check.name))
        elif there(check.relation):
            plain.setdefault(check.relation, []).append(check)
    for relation, own in plain.items():
        counted = relations[relation].agg(*[F.count_if(F.expr(c.rows)).alias(c.name) for c in own])
        parts.append(counted.unpivot([], [c.name for c in own], "name", "n_bad"))
    severity = {c.name: c.severity for c in checks}
    if there("macro"):
        parts.append(_counted(source_divergence(relations["macro"]), "macro_primary_fallback_divergence"))
        severity["macro_primary_fallback_divergence"] = "warn"
    if there("provider_symbol_history"):
        parts.append(_counted(symbol_reuse(relations["provider_symbol_history"]), "provider_symbol_overlapping_reuse"))
        severity["provider_symbol_overlapping_reuse"] = "fail"
    if there("fundamentals", "fundamental_versions"):
        parts.append(_counted(stale_projection(relations["fundamentals"], relations["fundamental_versions"]), "fundamental_evidence_latest_projection_mismatch"))
        severity["fundamental_evidence_latest_projection_mismatch"] = "fail"
    level: Column = F.element_at(F.create_map(*[F.lit(x) for pair in severity.items() for x in pair]), F.col("name"))
    whole = reduce(DataFrame.unionByName, parts).groupBy("name").agg(F.sum("n_bad").alias("n_bad"))
    return whole.select("name", level.alias("severity"), "n_bad", F.when(F.col("n_bad") == 0, "ok").otherwise(level).alias("status"))

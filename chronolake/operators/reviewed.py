"""Writes that a review authorises: identities of memberships, prices after a listing's end, factor prices before its start.

Each function gives what arrives with ``problem``; ``sources.tables.Store.validated`` writes all of it or nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import upsert

#: What an identity may rest on; the purpose and the review of a price extension, and its most days. Fixed values.
IDENTITY_STATUSES = ("bounded_ticker", "verified_ticker_change", "verified_surviving_security_ticker_change")
PURPOSE, REVIEW, MOST_DAYS = "portfolio_liquidation", "adjacent_identity_provider_v1", 45


def _missing(*names: str) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | (F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == "")
    return found


def identity_rows(arrived: DataFrame, memberships: DataFrame, stored: DataFrame) -> DataFrame:
    """The assignments as they would be stored, with problem: arriving ones by universe, ticker and start replace stored ones.

    ``arrived``, ``stored``: universe_id, ticker, effective_start, effective_end, security_id, known_date, identity_status,
    source. ``memberships``: universe_id, ticker, effective_start, effective_end, security_id. An identity stands for exactly
    one membership, which names no other security; one security has one status and one ticker at a time in a universe.
    """
    c, key = F.col, ["universe_id", "ticker", "effective_start"]
    one = arrived.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(*key)), "_s": F.min("identity_status").over(Window.partitionBy("security_id")) != F.max("identity_status").over(Window.partitionBy("security_id"))})
    member = memberships.select(*key, c("effective_end").alias("_end"), c("security_id").alias("_owner"), F.lit(True).alias("_there"))
    met = one.join(member, key, "left")
    problem = (
        F.when(_missing("universe_id", "ticker", "security_id", "source"), "lacks universe, ticker, security or source")
        .when(~F.coalesce(c("identity_status").isin(*IDENTITY_STATUSES), F.lit(False)), "unknown status")
        .when(c("effective_start").isNull() | c("known_date").isNull(), "lacks its start or when it was known")
        .when(c("known_date") > c("effective_start"), "known after its start")
        .when(c("effective_end") <= c("effective_start"), "end does not follow the start")
        .when(c("_n") > 1, "arrives more than once")
        .when(c("_s"), "security has several statuses")
        .when(c("_there").isNull() | ~c("_end").eqNullSafe(c("effective_end")), "is no membership")
        .when(c("_owner") != c("security_id"), "membership has another security")
    )
    said = met.withColumn("problem", problem).select(*arrived.columns, "problem")
    # Rows that aren't sound don't enter the comparison of intervals.
    merged = upsert(stored.withColumn("problem", F.lit(None).cast("string")), said.where("problem IS NULL"), key)
    w = Window.partitionBy("universe_id", "security_id").orderBy("effective_start", "ticker")
    before = F.lag("effective_end").over(w)
    late = (F.row_number().over(w) > 1) & (before.isNull() | (c("effective_start") < before))
    return merged.withColumn("problem", F.when(late, "security has two tickers at a time")).unionByName(said.where("problem IS NOT NULL"))


def masters_of(identities: DataFrame) -> DataFrame:
    """security_id, canonical_ticker, identity_status, source: each security by its last assignment."""
    last = F.max_by(F.struct(F.col("ticker").alias("canonical_ticker"), "identity_status", "source"), F.struct("effective_start", "ticker"))
    return identities.groupBy("security_id").agg(last.alias("_m")).select("security_id", "_m.*")


def extension_rows(arrived: DataFrame, securities: DataFrame, identities: DataFrame, mappings: DataFrame, stored: DataFrame, today: Column) -> DataFrame:
    """Price extensions with problem. An extension follows, without a gap, the end of its security's ticker in the universe
    and of its verified provider mapping, and meets no other mapping; a stored one of its provenance_id says the same."""
    c = F.col
    own = ["security_id", "ticker", "provider", "provider_symbol", "data_start", "data_end", "payload_sha256"]
    known = securities.select("security_id").distinct().withColumn("_known", F.lit(True))
    ended = identities.select("universe_id", "security_id", "ticker", c("effective_end").alias("data_start")).distinct().withColumn("_ticker", F.lit(True))
    verified = mappings.where("mapping_status = 'verified'").select("security_id", "provider", "provider_symbol", c("data_end").alias("data_start")).distinct().withColumn("_symbol", F.lit(True))
    open_end = F.coalesce("_to", F.lit("9999-12-31").cast("date"))
    # A mapping that meets the extension's days, unless it is the extension itself.
    others = mappings.select(c("security_id").alias("_s"), c("provider").alias("_p"), c("provider_symbol").alias("_symbol_there"), c("data_start").alias("_from"), c("data_end").alias("_to"), "mapping_status")
    itself = (c("_from") == c("data_start")) & c("_to").eqNullSafe(c("data_end")) & (c("_symbol_there") == c("provider_symbol")) & (c("mapping_status") == "verified")
    meets = (c("security_id") == c("_s")) & (c("provider") == c("_p")) & (c("_from") < c("data_end")) & (open_end > c("data_start")) & ~itself
    crossed = arrived.join(others, meets, "left_semi").select("provenance_id").distinct().withColumn("_crossed", F.lit(True))
    old = stored.select("provenance_id", F.struct(*own).alias("_old"))
    once = arrived.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("provenance_id")))
    met = once.join(known, "security_id", "left").join(ended, ["universe_id", "security_id", "ticker", "data_start"], "left").join(verified, ["security_id", "provider", "provider_symbol", "data_start"], "left")
    met = met.join(crossed, "provenance_id", "left").join(old, "provenance_id", "left")
    problem = (
        F.when(_missing("provenance_id", "universe_id", "security_id", "ticker", "provider", "provider_symbol", "identity_source", "provider_source"), "lacks a field")
        .when(c("_n") > 1, "arrives more than once")
        .when(~F.coalesce(c("data_start") < c("data_end"), F.lit(False)), "interval does not run forward")
        .when(F.datediff("data_end", "data_start") > MOST_DAYS, "extension is too long")
        .when(c("verified_date").isNull() | (c("verified_date") > today), "not verified by today")
        .when(~c("purpose").eqNullSafe(F.lit(PURPOSE)) | ~c("review_policy").eqNullSafe(F.lit(REVIEW)), "unknown purpose or review")
        .when(~F.coalesce(c("payload_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest is not one")
        .when(c("_known").isNull() | c("_ticker").isNull() | c("_symbol").isNull(), "lacks an end to follow")
        .when(c("_crossed"), "meets another mapping")
        .when(c("_old").isNotNull() & ~c("_old").eqNullSafe(F.struct(*own)), "stored provenance says otherwise")
    )
    return met.withColumn("problem", problem).select(*arrived.columns, "problem")


def provenance_rows(arrived: DataFrame, securities: DataFrame, mappings: DataFrame, stored: DataFrame, today: Column) -> DataFrame:
    """Provenance of factor prices before a listing's start, with problem: it ends where a verified mapping of its security and
    symbol starts, the overlap that was compared follows, and a stored one of its id says the same."""
    c = F.col
    own = ["universe_id", "security_id", "provider", "provider_symbol", "data_start", "data_end", "payload_sha256", "overlap_sha256", "review_policy"]
    known = securities.select("security_id").distinct().withColumn("_known", F.lit(True))
    starts = mappings.where("mapping_status = 'verified'").select("security_id", "provider", "provider_symbol", c("data_start").alias("data_end")).distinct().withColumn("_anchor", F.lit(True))
    old = stored.select("provenance_id", F.struct(*own).alias("_old"))
    once = arrived.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("provenance_id")))
    met = once.join(known, "security_id", "left").join(starts, ["security_id", "provider", "provider_symbol", "data_end"], "left").join(old, "provenance_id", "left")
    problem = (
        F.when(_missing("provenance_id", *own[:4], "source", *own[6:]), "lacks a field")
        .when(c("_n") > 1, "arrives more than once")
        .when(~F.coalesce((c("data_start") < c("data_end")) & (c("overlap_start") == c("data_end")) & (c("overlap_start") < c("overlap_end")) & (c("verified_date") <= today), F.lit(False)), "intervals are not in order")
        .when(c("_known").isNull(), "unknown security")
        .when(c("_anchor").isNull(), "no verified mapping starts where it ends")
        .when(c("_old").isNotNull() & ~c("_old").eqNullSafe(F.struct(*own)), "stored provenance says otherwise")
    )
    return met.withColumn("problem", problem).select(*arrived.columns, "problem")


def covered_prices(prices: DataFrame, provenance: DataFrame, source: str = "provider") -> DataFrame:
    """Reviewed prices with problem: numbers in range, actions complete, a stated basis, one row a security and date, and a
    provenance of the same security, provider (column ``source``) and symbol whose days hold the date."""
    c = F.col
    kept = provenance.select("provenance_id", c("security_id").alias("_s"), c("provider").alias("_p"), c("provider_symbol").alias("_y"), c("data_start").alias("_from"), c("data_end").alias("_to"))
    met = prices.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("security_id", "date"))).join(kept, "provenance_id", "left")
    number = lambda x, least: F.coalesce(least & ~F.isnan(x) & (c(x) < float("inf")), F.lit(False))
    fine = number("close", c("close") > 0) & number("dividends", c("dividends") >= 0) & number("split_ratio", c("split_ratio") > 0) & number("split_normalization_factor", c("split_normalization_factor") > 0)
    problem = (
        F.when(_missing("security_id", "date"), "lacks a field")
        .when(c("_n") > 1, "arrives more than once")
        .when(~fine, "number is out of range")
        .when(~F.coalesce("actions_complete", F.lit(False)) | c("close_split_adjusted").isNull(), "actions or split basis are not reviewed")
        .when(c("_s").isNull() | (c("security_id") != c("_s")) | (c(source) != c("_p")) | (c("provider_symbol") != c("_y")) | (c("date") < c("_from")) | (c("date") >= c("_to")), "is outside its provenance")
    )
    return met.withColumn("problem", problem).select(*prices.columns, "problem")


def without_prices(provenance: DataFrame, prices: DataFrame) -> DataFrame:
    """Provenance that no price refers to, with problem."""
    return provenance.join(prices.select("provenance_id").distinct(), "provenance_id", "left_anti").withColumn("problem", F.lit("has no prices"))


def replaced_prices(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Stored prices with those of every arriving provenance replaced whole, so a smaller correction leaves no stale dates."""
    return stored.join(arrived.select("provenance_id").distinct(), "provenance_id", "left_anti").unionByName(arrived.select(*stored.columns))

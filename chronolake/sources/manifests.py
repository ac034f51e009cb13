"""Reviewed reference relations, kept as CSV files whose header must be exactly the one declared here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Manifest:
    """Columns with types, the columns that name a row, the bounds of its interval, if it has one, the columns whose intervals
    may not overlap, and rules: what is wrong with a row that a predicate holds for."""

    columns: str
    keys: tuple[str, ...]
    start: str | None = None
    end: str | None = None
    apart: tuple[str, ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    #: Columns that determine others: rows of the first must agree on the rest.
    agree: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]


SOURCED = ("source NOT RLIKE '^https://[^/]+'", "source is not an https address")
VERIFIED = ("verified_date > current_date()", "verified in the future")
KNOWN = ("known_date > effective_date", "known after it is effective")

#: The relations' headers and rules. Fixed values.
MANIFESTS = {
    "security_issuers": Manifest("security_id string, issuer_id string, effective_start date, effective_end date, verified_date date, source string", ("security_id", "effective_start"), "effective_start", "effective_end", ("security_id",), (SOURCED, VERIFIED)),
    "provider_symbols": Manifest("provider string, provider_symbol string, security_id string, data_start date, data_end date, mapping_status string, verified_date date, source string", ("provider", "provider_symbol", "security_id", "data_start"), "data_start", "data_end", ("provider", "security_id"), (SOURCED, VERIFIED, ("mapping_status NOT IN ('verified', 'unresolved')", "unknown mapping status"))),
    "issuer_ciks": Manifest("issuer_id string, canonical_name string, canonical_ticker string, cik string, effective_start date, effective_end date, verified_date date, source string", ("issuer_id", "effective_start"), "effective_start", "effective_end", ("issuer_id",), (SOURCED, VERIFIED, ("cik NOT RLIKE '^[0-9]{1,10}$'", "CIK is not a number of up to ten digits")), ("issuer_id", "canonical_name", "canonical_ticker")),
    "universe_events": Manifest("universe_id string, index_name string, ticker string, effective_date date, action string, known_date date, source string, source_kind string", ("universe_id", "ticker", "effective_date", "action"), rules=(KNOWN, ("action NOT IN ('addition', 'deletion')", "unknown action"), ("source_kind NOT IN ('index_announcement', 'issuer_announcement')", "unknown kind of source"), ("coalesce(source, '') = ''", "source is empty"))),
    "identities": Manifest("universe_id string, ticker string, effective_start date, effective_end date, security_id string, known_date date, identity_status string, source string", ("universe_id", "ticker", "effective_start"), "effective_start", "effective_end", ("universe_id", "ticker"), (("known_date > effective_start", "known after its start"), ("coalesce(security_id, '') = ''", "security is empty"))),
    "transitions": Manifest("universe_id string, security_id string, from_ticker string, to_ticker string, effective_date date, known_date date, transition_type string, source string", ("universe_id", "security_id", "effective_date"), rules=(KNOWN, ("from_ticker = to_ticker", "ticker stays the same"), ("coalesce(transition_type, '') = ''", "kind of transition is empty"))),
    "conversions": Manifest("source_security_id string, target_security_id string, effective_date date, known_date date, share_ratio double, basis_policy string, review_status string, verified_date date, source string, basis_source string", ("source_security_id",), rules=(("source_security_id = target_security_id", "converts into itself"), KNOWN, VERIFIED, ("NOT coalesce(share_ratio > 0 AND share_ratio < double('infinity'), false)", "ratio is not positive"), ("basis_policy IS DISTINCT FROM 'carryover'", "unknown basis policy"), ("review_status IS DISTINCT FROM 'verified'", "not verified"))),
    "price_extensions": Manifest("universe_id string, security_id string, ticker string, provider string, provider_symbol string, data_start date, data_end date, verified_date date, identity_source string, provider_source string, purpose string", ("security_id",), "data_start", "data_end", rules=(("ticker NOT RLIKE '^[A-Z0-9.-]+$'", "ticker is not valid"), ("provider NOT IN ('yfinance', 'tiingo')", "unknown provider"), ("datediff(data_end, data_start) > 45", "extension is too long"), VERIFIED, ("data_end > date_add(verified_date, 1)", "ends after it was verified"), ("coalesce(purpose, '') = ''", "purpose is empty"))),
    "spans": Manifest("ticker string, start date, end date", ("ticker", "start"), "start", "end"),
}


def read_manifest(spark: SparkSession, path: str, kind: str, official: bool = False) -> DataFrame:
    """The rows of CSV files of one kind, typed, with ``problem``: a cell that isn't of its type, an empty key, an interval
    that doesn't run forward, a key that comes again with other values, what the kind's rules say, rows that must agree and
    don't, and intervals that overlap. Equal rows that repeat are one row. ``official``: sources must be https addresses.

    A file with another header fails the read.
    """
    shape = MANIFESTS[kind]
    text = ", ".join(f"`{n}` string" for n in shape.names)
    raw = spark.read.csv(path, schema=text, header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8").distinct()
    typed, wrong = [], F.lit(False)
    for column in shape.columns.split(", "):
        name, kind_of = column.split()
        cell = F.nullif(F.trim(F.col(name)), F.lit(""))
        value = cell.try_cast(kind_of)
        typed.append(value.alias(name))
        wrong = wrong | (cell.isNotNull() & value.isNull())
    rows = raw.select(*typed, wrong.alias("_wrong"))
    lacking = F.lit(False)
    for k in shape.keys:
        lacking = lacking | F.col(k).isNull()
    again = F.count(F.lit(1)).over(Window.partitionBy(*shape.keys)) > 1
    backward = F.col(shape.start) >= F.col(shape.end) if shape.start else F.lit(False)
    problem = F.when(F.col("_wrong"), "cell is not of its type").when(lacking, "key is empty").when(backward, "interval does not run forward").when(again, "key comes again with other values")
    for predicate, said in (*shape.rules, *([SOURCED] if official else [])):
        problem = problem.when(F.expr(predicate), said)
    if shape.agree:
        told, one = F.struct(*shape.agree[1:]), Window.partitionBy(shape.agree[0])
        problem = problem.when(F.min(told).over(one) != F.max(told).over(one), f"rows of one {shape.agree[0]} disagree")
    if shape.apart:
        w = Window.partitionBy(*shape.apart).orderBy(shape.start)
        before = F.max(F.coalesce(shape.end, F.lit("9999-12-31").cast("date"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        problem = problem.when(before > F.col(shape.start), "overlaps the interval before")
    return rows.withColumn("problem", problem).drop("_wrong")


def write_manifest(rows: DataFrame, path: str, kind: str) -> None:
    """Writes the declared columns under their header, a file for each partition of the keys' order."""
    shape = MANIFESTS[kind]
    rows.select(*shape.names).sort(*shape.keys).write.mode("errorifexists").csv(path, header=True, dateFormat="yyyy-MM-dd", emptyValue="")

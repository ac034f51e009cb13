"""Provider documents -> rows. Each reader takes a DataFrame with ``key`` and ``payload`` (one document a row).

A row that breaks a rule carries the rule's name in ``problem``; ``strict`` turns any such row into a failure, which is
what a verified load wants. Documents are spread over the cluster, and a document's rows come from built-in JSON and
array functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.companyfacts import fiscal_period
from ..operators.facts import finite, later_product

#: Markers of a missing value in yield files. Fixed values.
MISSING = ("", "n/a", "na", "null")


def strict(rows: DataFrame) -> DataFrame:
    """``rows`` without ``problem``, failing at run time at the first row that has one."""
    failed = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "problem", F.col("key"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(failed).drop("problem")


def _positive(c: str) -> Column:
    return finite(F.col(c)) & (F.col(c) > 0)


def _price_problem() -> Column:
    envelope = (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("key", "date")) > 1
    return (
        F.when(F.col("date").isNull(), "lacks a date")
        .when(repeated, "duplicate date")
        .when(~(_positive("open") & _positive("high") & _positive("low") & _positive("close") & _positive("adj_close")), "price is not positive")
        .when(~envelope, "prices are not within high and low")
        .when(~F.coalesce(_positive("split_ratio"), F.lit(False)), "split ratio is not positive")
        .when(~F.coalesce(finite(F.col("dividends")) & (F.col("dividends") >= 0), F.lit(False)), "dividend is negative or missing")
    )


def daily_bars(documents: DataFrame) -> DataFrame:
    """key, date, open, high, low, close, adj_close, volume, dividends, split_ratio, problem: JSON arrays of daily bars."""
    bar = "date string, open double, high double, low double, close double, adjClose double, volume bigint, divCash double, splitFactor double"
    rows = documents.select("key", F.explode(F.from_json("payload", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in bar.split(', '))}>>")).alias("r")).select("key", "r.*")
    named = rows.withColumn("date", F.expr("try_cast(left(date, 10) AS date)")).withColumnsRenamed({"adjClose": "adj_close", "divCash": "dividends", "splitFactor": "split_ratio"})
    return named.withColumn("problem", _price_problem())


#: What an export says of itself, and the version that is read. Fixed values.
EXPORT, EXPORT_VERSION = "export_schema_version: int, provider: string", 1


def _supported(provider: str) -> Column:
    return F.coalesce((F.col("d.export_schema_version") == EXPORT_VERSION) & (F.col("d.provider") == provider), F.lit(False))


def exported_bars(documents: DataFrame) -> DataFrame:
    """The same, with split_normalization_factor, from export documents: closes adjusted for all later splits.

    The factor of a day is the product of the ratios of later splits; 0 in ``stock_splits`` means none. An export of another
    version or provider is one row with a problem.
    """
    bar = "date: string, open: double, high: double, low: double, close: double, adj_close: double, volume: bigint, dividends: double, stock_splits: double"
    read = documents.select("key", F.from_json("payload", f"struct<{EXPORT}, provider_rows: array<struct<{bar}>>>").alias("d"))
    broken = read.where(~_supported("yfinance") | F.col("d.provider_rows").isNull()).select("key", F.lit("export is not supported").alias("problem"))
    rows = read.where(_supported("yfinance")).select("key", F.explode("d.provider_rows").alias("r")).select("key", "r.*")
    ratio = F.when(F.coalesce(F.col("stock_splits"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("stock_splits"))
    named = rows.withColumn("date", F.expr("try_cast(left(date, 10) AS date)")).withColumn("split_ratio", ratio).drop("stock_splits")
    return named.withColumn("split_normalization_factor", later_product(["key"], "date", "split_ratio")).withColumn("problem", _price_problem()).unionByName(broken, allowMissingColumns=True)


def yield_curve(wide: DataFrame, tenors: Sequence[str], date_format: str = "MM/dd/yyyy") -> DataFrame:
    """key, series_id, date, release_date, value, problem from rows of strings (key, Date and one column for each tenor).

    Missing values are left out; values must be numbers from 0 to 100, once for each series and date. The observation's
    date is its public date.
    """
    long = wide.unpivot(["key", "Date"], list(tenors), "series_id", "_text").withColumn("_text", F.trim("_text"))
    long = long.where(F.col("_text").isNotNull() & ~F.lower("_text").isin(*MISSING))
    parsed = long.select("key", "series_id", F.try_to_date("Date", date_format).alias("date"), F.expr("try_cast(_text AS double)").alias("value"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("series_id", "date")) > 1
    problem = F.when(F.col("date").isNull(), "date is not valid").when(F.col("value").isNull() | ~F.coalesce(finite(F.col("value")), F.lit(False)), "value is not a number").when(~F.col("value").between(0, 100), "value is out of range").when(repeated, "duplicate observation")
    return parsed.select("key", "series_id", "date", F.col("date").alias("release_date"), "value", problem.alias("problem"))


def macro_vintages(documents: DataFrame) -> DataFrame:
    """key, series_id, date, release_date, value, unit, problem of export documents; "." and null values are left out.

    Anything else that isn't a number or a date, a release before its observation, a vintage that comes twice, and a
    document without rows are problems.
    """
    shape = f"struct<{EXPORT}, series_id: string, unit: string, provider_rows: array<struct<date: string, realtime_start: string, value: string>>>"
    read = documents.select("key", F.from_json("payload", shape).alias("d"))
    said = F.when(~_supported("fred"), "export is not supported").when(F.col("d.provider_rows").isNull() | F.col("d.series_id").isNull(), "document holds no observations")
    broken = read.withColumn("problem", said).where(F.col("problem").isNotNull()).select("key", "problem")
    rows = read.where(_supported("fred") & F.col("d.series_id").isNotNull()).select("key", "d.series_id", "d.unit", F.explode("d.provider_rows").alias("r")).where(F.col("r.value").isNotNull() & (F.trim("r.value") != "."))
    typed = rows.select("key", "series_id", F.expr("try_cast(r.date AS date)").alias("date"), F.expr("try_cast(r.realtime_start AS date)").alias("release_date"), F.expr("try_cast(r.value AS double)").alias("value"), "unit")
    repeated = F.count(F.lit(1)).over(Window.partitionBy("key", "series_id", "date", "release_date")) > 1
    problem = F.when(F.col("date").isNull() | F.col("release_date").isNull(), "date is not valid").when(~F.coalesce(finite(F.col("value")), F.lit(False)), "value is not a number").when(F.col("release_date") < F.col("date"), "released before its date").when(repeated, "duplicate observation")
    return typed.withColumn("problem", problem).unionByName(broken, allowMissingColumns=True)


def company_facts(documents: DataFrame) -> DataFrame:
    """key, cik, taxonomy, concept, unit, position, the fields of each fact of company-facts documents, label and problem.

    ``position`` is the fact's place in its concept, unit after unit: where the first row wins, it decides. ``label`` is
    FYyyyy, Qn_yyyy, another code with or without its year, or INST. A fact without a value, end or filing date, or whose
    period ends after it was filed, says so in ``problem``; a document that can't be read is one row with a problem.
    """
    fact = "struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string, frame: string>"
    shape = f"struct<cik: bigint, facts: map<string, map<string, struct<units: map<string, array<{fact}>>>>>>"
    read = documents.select("key", F.from_json("payload", shape).alias("_d"))
    broken = read.where(F.col("_d.facts").isNull()).select("key", F.lit("document holds no facts").alias("problem"))
    a = read.select("key", "_d.cik", F.explode("_d.facts").alias("taxonomy", "_concepts"))
    b = a.select("key", "cik", "taxonomy", F.explode("_concepts").alias("concept", "_units"))
    c = b.select("key", "cik", "taxonomy", "concept", F.posexplode(F.map_entries("_units.units")).alias("_unit_at", "_unit")).select("key", "cik", "taxonomy", "concept", "_unit_at", F.col("_unit.key").alias("unit"), F.col("_unit.value").alias("_facts"))
    rows = c.select("key", "cik", "taxonomy", "concept", "unit", "_unit_at", F.posexplode("_facts").alias("_at", "_f")).select("key", "cik", "taxonomy", "concept", "unit", (F.col("_unit_at") * F.lit(1 << 32) + F.col("_at")).alias("position"), "_f.*")
    day = lambda name: F.expr(f"try_cast(`{name}` AS date)")
    typed = rows.withColumns({"start": day("start"), "end": day("end"), "filed": day("filed")}).withColumn("label", fiscal_period(F.col("fp"), F.col("fy")))
    lacking = F.col("val").isNull() | F.col("end").isNull() | F.col("filed").isNull()
    problem = F.when(lacking, "lacks a value or a date").when(F.col("end") > F.col("filed"), "period ends after it was filed")
    return typed.withColumn("problem", problem).unionByName(broken, allowMissingColumns=True)


#: Reports that carry financial statements. Fixed values.
PERIODIC_FORMS = ("10-K", "10-Q", "10-K/A", "10-Q/A", "20-F", "40-F")


def filings(documents: DataFrame) -> DataFrame:
    """key, position, accn, form, filed, period of submission documents, whose recent filings are parallel arrays."""
    shape = "struct<filings: struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, periodOfReport: array<string>>>>"
    recent = F.from_json("payload", shape)["filings"]["recent"]
    zipped = F.arrays_zip(recent["accessionNumber"].alias("accn"), recent["form"].alias("form"), recent["filingDate"].alias("filed"), recent["periodOfReport"].alias("period"))
    rows = documents.select("key", F.posexplode(zipped).alias("position", "_f")).select("key", "position", "_f.*")
    return rows.withColumns({"filed": F.expr("try_cast(filed AS date)"), "period": F.expr("try_cast(period AS date)")})


def filing_dates(rows: DataFrame) -> DataFrame:
    """key, period, filed: the date of the last listed periodic filing of each period (of ``filings``)."""
    periodic = rows.where(F.col("form").isin(*PERIODIC_FORMS) & F.col("period").isNotNull() & F.col("filed").isNotNull())
    return periodic.groupBy("key", "period").agg(F.max_by("filed", "position").alias("filed"))


def csv_bars(documents: DataFrame) -> DataFrame:
    """key, date, open, high, low, close, volume, problem of CSV documents with the header Date,Open,High,Low,Close[,Volume].

    A byte-order mark is skipped; a document of "No data" has no rows; another header is one row with a problem. Bars of
    this form know nothing of splits or dividends.
    """
    lines = F.split(F.regexp_replace(F.trim(F.col("payload")), "^\ufeff", ""), "\r?\n")
    rows = documents.where(F.lower(F.regexp_replace(F.trim("payload"), "^\ufeff", "")) != "no data").withColumn("_lines", lines)
    header = F.lower(F.trim(F.element_at("_lines", 1)))
    fine = header.isin("date,open,high,low,close", "date,open,high,low,close,volume")
    wrong = rows.where(~F.coalesce(fine, F.lit(False))).select("key", F.lit("header is not that of daily bars").alias("problem"))
    cells = rows.where(fine).select("key", F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("_line")).where(F.trim("_line") != "").withColumn("_c", F.split("_line", ","))
    number = lambda i: F.expr(f"try_cast(get(_c, {i}) AS double)")
    typed = cells.select("key", F.expr("try_cast(get(_c, 0) AS date)").alias("date"), *[number(i).alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)], F.expr("try_cast(try_cast(get(_c, 5) AS double) AS bigint)").alias("volume"))
    envelope = (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close"))
    repeated = F.count(F.lit(1)).over(Window.partitionBy("key", "date")) > 1
    positive = F.coalesce(_positive("open") & _positive("high") & _positive("low") & _positive("close"), F.lit(False))
    problem = F.when(F.col("date").isNull(), "lacks a date").when(repeated, "duplicate date").when(~positive, "price is not positive").when(~envelope, "prices are not within high and low")
    return typed.withColumn("problem", problem).unionByName(wrong, allowMissingColumns=True)


def first_provider(bars: dict[str, DataFrame]) -> DataFrame:
    """The bars of the first provider, in the order given, that has any for a key, with its name in ``provider``."""
    whole = None
    for rank, (name, rows) in enumerate(bars.items()):
        named = rows.withColumns({"provider": F.lit(name), "_rank": F.lit(rank)})
        whole = named if whole is None else whole.unionByName(named, allowMissingColumns=True)
    best = whole.groupBy("key").agg(F.min("_rank").alias("_rank"))
    return whole.join(best, ["key", "_rank"]).drop("_rank")

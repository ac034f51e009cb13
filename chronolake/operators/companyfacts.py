"""Company facts -> stored metric rows, by named policies.

Facts of several concepts make one metric. A policy says whether the earlier concept wins within a filing (``exact`` off) or
every concept of the exact unit and context counts, whether a storage key has one row, what happens where rows of a key
disagree, and whether revenue follows rules of its own for reviewed issuers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ingest
from .stages import cut, dealt

#: Metric, its statement, and its concepts, the preferred first. Fixed values.
METRICS = (
    ("revenue", "income", ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet")),
    ("net_income", "income", ("NetIncomeLoss",)),
    ("operating_income", "income", ("OperatingIncomeLoss",)),
    ("gross_profit", "income", ("GrossProfit",)),
    ("depreciation", "income", ("DepreciationDepletionAndAmortization", "DepreciationDepletionAndAmortizationPropertyPlantAndEquipment", "Depreciation")),
    ("eps_basic", "income", ("EarningsPerShareBasic",)),
    ("eps_diluted", "income", ("EarningsPerShareDiluted",)),
    ("rd_expense", "income", ("ResearchAndDevelopmentExpense",)),
    ("interest_expense", "income", ("InterestExpense",)),
    ("shares_out", "balance", ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding")),
    ("total_assets", "balance", ("Assets",)),
    ("total_liabilities", "balance", ("Liabilities",)),
    ("stockholders_equity", "balance", ("StockholdersEquity",)),
    ("current_assets", "balance", ("AssetsCurrent",)),
    ("current_liabilities", "balance", ("LiabilitiesCurrent",)),
    ("cash", "balance", ("CashAndCashEquivalentsAtCarryingValue",)),
    ("debt_total", "balance", ("LongTermDebt", "LongTermDebtNoncurrent")),
    ("cfo", "cashflow", ("NetCashProvidedByUsedInOperatingActivities", "CashFlowFromContinuingOperatingActivities")),
    ("capex", "cashflow", ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForCapitalImprovements")),
    ("dividends_paid", "cashflow", ("PaymentsForDividends", "PaymentsOfDividends")),
)
#: Metrics over a period, whose quarters come from spans; metrics a share. Fixed values.
FLOWS = ("revenue", "net_income", "operating_income", "gross_profit", "rd_expense", "interest_expense", "depreciation", "cfo", "capex", "dividends_paid")
PER_SHARE = ("eps_basic", "eps_diluted")
#: The one concept that stands in another taxonomy, where taxonomies are told apart. Fixed value.
ENTITY_SHARES = "EntityCommonStockSharesOutstanding"

#: Issuers (by CIK) whose revenue has rules of its own, and what these rules add. Fixed values.
ASSESSED_TAX = (900075, 9389, 1035443, 1086222, 1174922, 1374310, 1513761, 1535527, 1637459, 45012, 48465, 52988, 728535, 878927, 91419, 109198)
UTILITIES = (72903, 753308, 936340, 1326160)
LANDLORDS = (906107,)
REFINERS = (1035002,)
WITHOUT_REVENUE = (35527, 72971, 886982, 895421, 92230, 1281761, 1601712, 1841666)
GROSS_REVENUE, EXCISE_TAXES = "RevenueFromContractWithCustomerIncludingAssessedTax", "ExciseAndSalesTaxes"
NET_REVENUE = "RevenueFromContractWithCustomerIncludingAssessedTaxLessExciseAndSalesTaxes"
REVENUE = METRICS[0][2]
REVENUE_BY_CLASS = {
    "plain": REVENUE,
    "assessed": (*REVENUE, GROSS_REVENUE),
    "utility": ("RegulatedAndUnregulatedOperatingRevenue", *REVENUE),
    "landlord": (*REVENUE, "OperatingLeaseLeaseIncome"),
    "refiner": REVENUE,
    "none": (),
}


@dataclass(frozen=True)
class Policy:
    """exact: taxonomies, units and contexts must fit; one_row: a storage key has one row; first_wins: of rows that
    disagree the first stays, else the key is withheld; issuers: revenue by reviewed issuer, the preferred concept first."""

    exact: bool = False
    one_row: bool = True
    first_wins: bool = False
    issuers: bool = False


#: The policies by the names they are stored under. Fixed values.
POLICIES = {
    "sec-companyfacts-v2": Policy(one_row=False),
    "sec-companyfacts-v2-storage-safe-v1": Policy(),
    "sec-companyfacts-v2-storage-safe-v2": Policy(first_wins=True),
    "sec-companyfacts-v3": Policy(exact=True),
    "sec-companyfacts-v4": Policy(exact=True, issuers=True),
}
DEFAULT = "sec-companyfacts-v2-storage-safe-v2"


def revenue_class(cik: Column) -> Column:
    return (
        F.when(cik.isin(*ASSESSED_TAX), "assessed").when(cik.isin(*UTILITIES), "utility").when(cik.isin(*LANDLORDS), "landlord").when(cik.isin(*REFINERS), "refiner").when(cik.isin(*WITHOUT_REVENUE), "none").otherwise("plain")
    )


def unit_of(metric: Column) -> Column:
    return F.when(metric == "shares_out", "shares").when(metric.isin(*PER_SHARE), "USD/shares").otherwise("USD")


def fiscal_period(fp: Column, fy: Column) -> Column:
    """FYyyyy, Qn_yyyy (or another code with its year), the code alone, or INST."""
    code, year = F.nullif(fp, F.lit("")), F.when(fy != 0, fy.cast("string"))
    return F.when((code == "FY") & year.isNotNull(), F.concat(F.lit("FY"), year)).when(code.isNotNull() & year.isNotNull(), F.concat(code, F.lit("_"), year)).otherwise(F.coalesce(code, F.lit("INST")))


def candidates(facts: DataFrame, policy: Policy, issuer_class: Column) -> DataFrame:
    """``facts`` that stand for a metric, with metric, statement and priority (the concept's place).

    Where a refiner's revenue is derived, what it is derived from comes along without a metric.
    """
    rows = []
    for metric, statement, concepts in METRICS:
        classes = REVENUE_BY_CLASS if policy.issuers and metric == "revenue" else {None: concepts}
        for name, own in classes.items():
            rows += [(name, metric, statement, c, "dei" if policy.exact and c == ENTITY_SHARES else "us-gaap", k) for k, c in enumerate(own)]
    if policy.issuers:
        rows += [("refiner", None, None, c, "us-gaap", None) for c in (GROSS_REVENUE, EXCISE_TAXES)]
    table = facts.sparkSession.createDataFrame(rows, "_class string, metric string, statement string, _concept string, _taxonomy string, priority int")
    on = (F.col("concept") == F.col("_concept")) & (F.col("taxonomy") == F.col("_taxonomy")) & (F.col("_class").isNull() | (F.col("_class") == F.col("_issuer")))
    return facts.withColumn("_issuer", issuer_class).join(F.broadcast(table), on).drop("_class", "_concept", "_taxonomy", "_issuer")


def first_of_concepts(rows: DataFrame) -> DataFrame:
    """Of rows with one filing, end and start the one of the preferred concept, the first listed."""
    order = Window.partitionBy("key", "metric", "accn", "end", "start").orderBy("priority", "position")
    return rows.withColumn("_first", F.row_number().over(order)).where("_first = 1").drop("_first")


def exact_shares(rows: DataFrame) -> DataFrame:
    """Instant share counts bound to a filing, once for each concept, filing and end; problem where a filing contradicts itself."""
    said = rows.where((F.col("unit") == "shares") & (F.trim("accn") != "") & F.col("end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull() & F.col("start").isNull())
    one = Window.partitionBy("key", "taxonomy", "concept", "accn", "end")
    same = F.to_json(F.struct("filed", "val", "fp", "fy", "form", "frame"))
    marked = said.withColumn("_first", F.row_number().over(one.orderBy("position"))).withColumn("problem", F.when(F.min(same).over(one) != F.max(same).over(one), "conflict within one filing"))
    return marked.where("_first = 1").drop("_first")


def derived_revenue(rows: DataFrame) -> DataFrame:
    """Gross revenue less excise taxes of the same context, where either has one value and the difference isn't negative."""
    c = F.col
    context = ["key", "cik", "accn", "start", "end", "filed", "form", "fp", "fy", "unit"]
    gross, tax = c("concept") == GROSS_REVENUE, c("concept") == EXCISE_TAXES
    both = rows.where((gross | tax) & (c("taxonomy") == "us-gaap") & (c("unit") == "USD")).groupBy(*context).agg(
        F.min(F.when(gross, c("val"))).alias("_gross"),
        F.max(F.when(gross, c("val"))).alias("_most_gross"),
        F.min(F.when(tax, c("val"))).alias("_tax"),
        F.max(F.when(tax, c("val"))).alias("_most_tax"),
        F.min(F.when(gross, c("position"))).alias("position"),
        F.min(F.when(gross, c("frame"))).alias("frame"),
    )
    net = both.where("_gross = _most_gross AND _tax = _most_tax").select(*context, (c("_gross") - c("_tax")).alias("val"), "position", "frame")
    return net.where("val >= 0").withColumns({"taxonomy": F.lit("derived:us-gaap"), "concept": F.lit(NET_REVENUE), "metric": F.lit("revenue"), "statement": F.lit("income"), "priority": F.lit(-1)})


def over_time(rows: DataFrame, policy: Policy) -> DataFrame:
    """Exact policies: rows of metrics over a period, of the metric's unit, that stand for their filing's period, with
    period_value. All windows have one order."""
    keys = ["key", "metric", "accn"]
    periods = ingest.period_contexts(rows, keys, unit_of(F.col("metric")))
    if policy.issuers:
        least = F.min("priority").over(Window.partitionBy(*keys, "end"))
        periods = periods.withColumn("_least", least).where((F.col("metric") != "revenue") | (F.col("priority") == F.col("_least"))).drop("_least")
    return ingest.single_period(periods.withColumn("_order", F.struct("priority", "position")), keys, order="_order", complete=True)


ECONOMICS = ("fiscal_period", "statement", "value", "quarter_value", "unit")


def stored_facts(facts: DataFrame, policy: Policy, issuer_class: Column | None = None, parts: int | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """key, cik, period_end, as_of_date, metric, the economics, conflict (did rows of the key disagree?), locators (exact
    policies: where the facts stand), problem.

    ``facts`` is what ``sources.documents.company_facts`` gives. Facts that end after they were filed count where the value
    of a single period is chosen, but aren't stored themselves. A filing that contradicts itself carries a problem.
    Documents are dealt into ``parts`` parts; all windows and groups of a document then lie in one of them, and only unions
    bring its rows together again. Where ``metrics`` are named, only theirs are made.
    """
    c = F.col
    said = candidates(facts.drop("problem", "label"), policy, revenue_class(c("cik")) if issuer_class is None else issuer_class)
    if metrics is not None:
        said = said.where(c("metric").isNull() | c("metric").isin(*metrics))
    ordered = F.struct("priority", "position")
    if not policy.exact:
        rows = first_of_concepts(dealt(said, parts, "key")).withColumns({"problem": F.lit(None).cast("string"), "_order": ordered})
        return _stored(ingest.single_period(rows, ["key", "metric", "accn"], order="_order"), policy)
    said = cut(said)  # several parts read it: documents are parsed once
    bound = said.where((c("unit") == unit_of(c("metric"))) & c("val").isNotNull() & (F.trim("accn") != "") & c("end").isNotNull() & c("filed").isNotNull() & (F.trim("form") != ""))
    lasting = c("metric").isin(*FLOWS, *PER_SHARE)
    periods = bound.where(lasting)
    if policy.issuers:
        periods = periods.unionByName(derived_revenue(dealt(said.where("metric IS NULL"), parts, "key")))
    periods = over_time(dealt(periods, parts, "key"), policy).withColumn("problem", F.lit(None).cast("string"))
    shares = exact_shares(dealt(said.where("metric = 'shares_out'"), parts, "key")).where(F.trim("form").isin(*ingest.ANNUAL_FORMS, *ingest.INTERIM_FORMS))
    others = bound.where(~lasting & (c("metric") != "shares_out") & c("start").isNull() & F.trim("form").isin(*ingest.ANNUAL_FORMS, *ingest.INTERIM_FORMS))
    moments = dealt(others.withColumn("problem", F.lit(None).cast("string")).unionByName(shares), parts, "key").withColumns({"_order": ordered, "period_value": c("val")})
    return _stored(periods, policy).unionByName(_stored(moments, policy))  # no metric is in both


def _stored(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row for each storage key (or all, by the policy) of rows with period_value, _order and problem."""
    c = F.col
    flow = c("metric").isin(*FLOWS)
    named = rows.where(c("val").isNotNull() & c("end").isNotNull() & c("filed").isNotNull() & (c("end") <= c("filed"))).select(
        "key",
        "cik",
        c("end").alias("period_end"),
        c("filed").alias("as_of_date"),
        "metric",
        fiscal_period(c("fp"), c("fy")).alias("fiscal_period"),
        "statement",
        c("val").alias("value"),
        F.when(flow, c("period_value")).otherwise(c("val")).alias("quarter_value"),
        (c("unit") if policy.exact else F.lit("USD")).alias("unit"),
        "priority",
        "_order",
        F.struct("taxonomy", "concept", "accn", "form", "start", "end", "filed", "fp", "fy", "frame").alias("_locator"),
        "problem",
    )
    keys = ["key", "cik", "period_end", "as_of_date", "metric"]
    if not policy.one_row:
        return named.select(*keys, *ECONOMICS, F.lit(False).alias("conflict"), F.array().cast("array<string>").alias("locators"), "problem")
    # of the revenue of reviewed issuers only rows of a key's least priority count: they come first in both orders
    rank = F.when(c("metric") == "revenue", c("priority")).otherwise(F.lit(0)) if policy.issuers else F.lit(0)
    economics = F.struct(*ECONOMICS)
    first, least, most = F.min_by(economics, F.struct(rank, "_order")), F.min(F.struct(rank.alias("_rank"), economics.alias("_e"))), F.max(F.struct((-rank).alias("_rank"), economics.alias("_e")))
    places = F.collect_set(F.struct(rank.alias("_rank"), F.to_json("_locator").alias("_at")))
    found = named.groupBy(*keys).agg(first.alias("_e"), (~least["_e"].eqNullSafe(most["_e"])).alias("conflict"), least["_rank"].alias("_least"), places.alias("_places"), F.max("problem").alias("problem"))
    kept = found if policy.first_wins else found.where("NOT conflict")
    locators = F.expr("array_sort(transform(filter(_places, x -> x._rank = _least), x -> x._at))") if policy.exact else F.array().cast("array<string>")
    return kept.select(*keys, "_e.*", "conflict", locators.alias("locators"), "problem")

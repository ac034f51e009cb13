"""Company facts: documents built from orders and line items, read back as JSON and stored by each policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import companyfacts
from ..operators.stages import dealt, parts_of
from ..sources import documents
from .catalog import day, query, read

#: A fact from a line item and its order; both engines run these texts.
FACT = {
    "concept": "CASE l_linenumber % 6 WHEN 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'RegulatedAndUnregulatedOperatingRevenue' WHEN 1 THEN 'OperatingLeaseLeaseIncome' ELSE 'Revenues' END WHEN 1 THEN 'RevenueFromContractWithCustomerExcludingAssessedTax' WHEN 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'ExciseAndSalesTaxes' ELSE 'NetIncomeLoss' END WHEN 3 THEN 'Assets' WHEN 4 THEN 'CommonStockSharesOutstanding' ELSE 'RevenueFromContractWithCustomerIncludingAssessedTax' END",
    "unit": "CASE WHEN l_linenumber % 6 = 4 THEN 'shares' WHEN l_discount > 0.09 THEN 'EUR' ELSE 'USD' END",
    "end": "make_date(CAST(year(l_shipdate) AS INT), CAST(3 * quarter(l_shipdate) AS INT), 28)",
    "start": "CASE WHEN l_linenumber % 6 IN (3, 4) THEN CASE WHEN l_tax > 0.06 THEN make_date(CAST(year(l_shipdate) AS INT), 1, 1) END ELSE make_date(CAST(year(l_shipdate) - CASE WHEN l_tax < 0.01 THEN 1 ELSE 0 END AS INT), CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 3 * quarter(l_shipdate) - 2 END AS INT), 1) END",
    "val": "CAST(round(l_extendedprice / 20000) AS DOUBLE)",
    "accn": "o_custkey || '-' || year(l_shipdate) || '-' || quarter(l_shipdate)",
    "fy": "CAST(year(l_shipdate) AS INT)",
    "fp": "CASE WHEN l_returnflag = 'A' AND l_quantity < 3 THEN 'Q3' WHEN quarter(l_shipdate) = 4 THEN 'FY' ELSE 'Q' || quarter(l_shipdate) END",
    "form": "CASE WHEN l_quantity = 7 THEN 'S-1' WHEN quarter(l_shipdate) = 4 THEN '10-K' ELSE '10-Q' END",
    "filed": "make_date(CAST(year(l_shipdate) AS INT), CAST(3 * quarter(l_shipdate) AS INT), CASE WHEN l_linestatus = 'F' AND l_quantity < 5 THEN 20 ELSE 28 END)",
}


def _parts(spark, d) -> int | None:
    return parts_of(spark, read(spark, d, "lineitem").count())


def _lines(spark, d, parts: int | None) -> DataFrame:
    """Line items with their orders.

    Dealt into ``parts`` parts, both sides lie by order and a part's few orders are looked up, so no task sorts or holds a
    share that grows with the tables. All that facts take from the day of shipment is its date.
    """
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem").withColumn("l_shipdate", day("l_shipdate"))
    if parts:
        orders, lines = dealt(orders, parts, "o_orderkey").hint("shuffle_hash"), dealt(lines, parts, "l_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


def payloads(spark, d) -> DataFrame:
    """A document for each customer: its facts by concept and unit, in the order of their text.

    A customer's rows are brought together once, before they are texts, and are one group: its concepts and units are told
    apart within the sorted list.
    """
    parts = _parts(spark, d)
    rows = dealt(_lines(spark, d, parts), parts, "o_custkey").select(F.col("o_custkey").alias("cik"), *[F.expr(x).alias(n) for n, x in FACT.items()])
    dated = rows.withColumns({n: F.col(n).cast("string") for n in ("start", "end", "filed")})
    fact = F.struct("accn", "end", "start", "val", "fy", "fp", "form", "filed").alias("fact")
    whole = dated.groupBy("cik").agg(F.sort_array(F.collect_list(F.struct("concept", "unit", fact))).alias("rows"))
    concepts = whole.select("cik", F.expr("transform(array_distinct(rows.concept), c -> struct(c AS concept, filter(rows, x -> x.concept = c) AS rows))").alias("concepts"))
    units = "map_from_entries(transform(array_distinct(c.rows.unit), u -> struct(u, transform(filter(c.rows, x -> x.unit = u), x -> x.fact))))"
    gaap = F.expr(f"map_from_entries(transform(concepts, c -> struct(c.concept, named_struct('units', {units}))))")
    return concepts.select(F.col("cik").cast("string").alias("key"), F.to_json(F.struct("cik", F.create_map(F.lit("us-gaap"), gaap).alias("facts"))).alias("payload"))


_ROWS = f"""r AS (SELECT o_custkey AS cik, {', '.join(f'{x} AS "{n}"' for n, x in FACT.items())} FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
f AS (SELECT *, row_number() OVER (PARTITION BY cik, concept ORDER BY unit, accn, CAST("end" AS VARCHAR), CAST(start AS VARCHAR) NULLS FIRST, val, fy, fp, form, CAST(filed AS VARCHAR)) AS pos, "end" - start AS span FROM r)"""
_PERIOD = "CASE WHEN fp = 'FY' THEN 'FY' || fy ELSE fp || '_' || fy END"


def _metric(classes: str) -> str:
    """(concept, metric, statement, priority, class) as SQL values."""
    rows = [("NetIncomeLoss", "net_income", "income", 0, None), ("Assets", "total_assets", "balance", 0, None), ("CommonStockSharesOutstanding", "shares_out", "balance", 0, None)]
    for name in classes.split():
        own = companyfacts.REVENUE_BY_CLASS["plain" if name == "all" else name]
        rows += [(c, "revenue", "income", k, None if name == "all" else name) for k, c in enumerate(own)]
    return "m(concept, metric, statement, priority, class) AS (VALUES " + ", ".join(f"('{c}', '{m}', '{s}', {k}, {'NULL' if n is None else repr(n)})" for c, m, s, k, n in rows) + ")"


_V2 = f"""WITH {_ROWS}, {_metric('all')}, c AS (SELECT f.*, metric, statement, priority FROM f JOIN m USING (concept)),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, metric, accn, "end", start ORDER BY priority, pos) AS k FROM c) WHERE k = 1),
g AS (SELECT *, count(*) OVER w AS n, bool_or(fp = 'FY') OVER w AS annual FROM d WINDOW w AS (PARTITION BY cik, metric, accn, "end")),
q AS (SELECT *, CASE WHEN metric NOT IN ('revenue', 'net_income') OR n = 1 THEN val WHEN annual THEN arg_max(val, (span, priority, pos, val)) FILTER (span IS NOT NULL) OVER w ELSE arg_min(val, (span, priority, pos, val)) FILTER (span IS NOT NULL) OVER w END AS qv FROM g WINDOW w AS (PARTITION BY cik, metric, accn, "end")),
s AS (SELECT *, {_PERIOD} AS period FROM q WHERE "end" <= filed),
o AS (SELECT cik, "end", filed, metric, arg_min((period, statement, val, qv), (priority, pos)) AS e, count(DISTINCT (period, statement, val, qv)) > 1 AS conflict FROM s GROUP BY ALL)
SELECT cik, "end" AS period_end, filed AS as_of_date, metric, e[1] AS fiscal_period, e[3] AS value, e[4] AS quarter_value, 'USD' AS unit, conflict FROM o"""


def _stored(spark, d, policy: str, issuer=None, metrics=None) -> DataFrame:
    return companyfacts.stored_facts(documents.company_facts(payloads(spark, d)), companyfacts.POLICIES[policy], issuer, _parts(spark, d), metrics)


def _selected(df: DataFrame) -> DataFrame:
    return df.select("cik", "period_end", "as_of_date", "metric", "fiscal_period", "value", "quarter_value", "unit", "conflict")


@query(_V2)
def facts_storage_v2(spark, d):
    """The default: the preferred concept of a filing, one row for each key, the first where rows disagree."""
    return _selected(_stored(spark, d, companyfacts.DEFAULT))


@query(_V2.replace("conflict FROM o", "conflict FROM o WHERE NOT conflict"))
def facts_storage_withheld(spark, d):
    return _selected(_stored(spark, d, "sec-companyfacts-v2-storage-safe-v1"))


def _one_value(concept: str, issuer: str) -> str:
    return f"""SELECT cik, accn, start, "end", filed, form, fp, fy, unit, span, min(val) AS v, min(pos) AS pos FROM f WHERE concept = '{concept}' AND unit = 'USD' AND {issuer} = 'refiner' GROUP BY ALL HAVING min(val) = max(val)"""


def _exact(classes: str, issuer: str, preferred: bool) -> str:
    least = "QUALIFY (metric <> 'revenue' OR priority = min(priority) OVER (PARTITION BY cik, metric, accn, \"end\"))" if preferred else ""
    least_key = "QUALIFY (metric <> 'revenue' OR priority = min(priority) OVER (PARTITION BY cik, metric, \"end\", filed))" if preferred else ""
    return f"""WITH {_ROWS}, {_metric(classes)}, c AS (SELECT f.*, metric, statement, priority FROM f JOIN m ON m.concept = f.concept AND (m.class IS NULL OR m.class = {issuer})),
ga AS ({_one_value(companyfacts.GROSS_REVENUE, issuer)}), tx AS ({_one_value(companyfacts.EXCISE_TAXES, issuer)}),
dv AS (SELECT ga.* EXCLUDE (v), ga.v - tx.v AS val, '{companyfacts.NET_REVENUE}' AS concept, 'revenue' AS metric, 'income' AS statement, -1 AS priority FROM ga JOIN tx ON ga.cik = tx.cik AND ga.accn = tx.accn AND ga.start IS NOT DISTINCT FROM tx.start AND ga."end" = tx."end" AND ga.filed = tx.filed AND ga.form = tx.form AND ga.fp = tx.fp AND ga.fy = tx.fy WHERE ga.v >= tx.v),
u AS (SELECT * FROM (SELECT * FROM c UNION ALL BY NAME SELECT * FROM dv) WHERE unit = CASE metric WHEN 'shares_out' THEN 'shares' ELSE 'USD' END),
sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik, concept, accn, "end" ORDER BY pos) AS k FROM u WHERE metric = 'shares_out' AND start IS NULL) WHERE k = 1),
inst AS (SELECT cik, accn, "end", filed, metric, statement, priority, fp, fy, val, val AS qv, form, unit FROM (SELECT * EXCLUDE (k) FROM sh UNION ALL SELECT * FROM u WHERE metric = 'total_assets' AND start IS NULL) WHERE form IN ('10-K', '10-Q')),
p AS (SELECT * FROM u WHERE metric IN ('revenue', 'net_income') AND span BETWEEN 1 AND 400),
ok AS (SELECT *, count(DISTINCT (fp, fy)) OVER (PARTITION BY cik, metric, accn, "end") AS n FROM p),
fo AS (SELECT * FROM ok WHERE n = 1 AND form = CASE fp WHEN 'FY' THEN '10-K' ELSE '10-Q' END),
sp AS (SELECT * FROM fo WINDOW w AS (PARTITION BY cik, metric, accn, "end") QUALIFY span = CASE WHEN fp = 'FY' THEN max(span) OVER w ELSE min(span) OVER w END),
pr AS (SELECT * FROM sp {least}),
fl AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN val WHEN fp = 'FY' THEN arg_max(val, (span, priority, pos, val)) OVER w ELSE arg_min(val, (span, priority, pos, val)) OVER w END AS qv FROM pr WINDOW w AS (PARTITION BY cik, metric, accn, "end")),
al AS (SELECT cik, accn, "end", filed, metric, statement, priority, fp, fy, val, qv, form, unit FROM fl UNION ALL SELECT * FROM inst),
s AS (SELECT *, {_PERIOD} AS period FROM al WHERE "end" <= filed {least_key}),
o AS (SELECT cik, "end", filed, metric, min((period, statement, val, qv, unit)) AS e, count(DISTINCT (period, statement, val, qv, unit)) AS n FROM s GROUP BY ALL)
SELECT cik, "end" AS period_end, filed AS as_of_date, metric, e[1] AS fiscal_period, e[3] AS value, e[4] AS quarter_value, e[5] AS unit, FALSE AS conflict FROM o WHERE n = 1"""


@query(_exact("all", "NULL", False))
def facts_v3(spark, d):
    """Exact units and contexts; a key whose rows disagree is withheld."""
    return _selected(_stored(spark, d, "sec-companyfacts-v3"))


_CLASSES = tuple(companyfacts.REVENUE_BY_CLASS)


@query(_exact(" ".join(_CLASSES), f"{list(_CLASSES)}[cik % 6 + 1]", True))
def facts_v4(spark, d):
    """Revenue by reviewed issuer: here a sixth each has one of the rules, a refiner's net of excise taxes among them."""
    issuer = F.get(F.array(*[F.lit(x) for x in _CLASSES]), (F.col("cik") % 6).cast("int"))
    return _selected(_stored(spark, d, "sec-companyfacts-v4", issuer))


@query(_exact(" ".join(_CLASSES), f"{list(_CLASSES)}[cik % 6 + 1]", True).replace("AS e, count(DISTINCT", "AS e, min(priority) AS top, count(DISTINCT").rpartition("SELECT cik,")[0] + "SELECT cik % 6 AS class, count(*) AS n, count(*) FILTER (WHERE top = -1) AS n_derived FROM o WHERE n = 1 AND metric = 'revenue' GROUP BY 1")
def facts_by_class(spark, d):
    """Revenue rows by class of issuer, and how many of them are derived."""
    issuer = F.get(F.array(*[F.lit(x) for x in _CLASSES]), (F.col("cik") % 6).cast("int"))
    rows = _stored(spark, d, "sec-companyfacts-v4", issuer, ["revenue"])
    derived = F.exists("locators", lambda x: F.contains(x, F.lit(companyfacts.NET_REVENUE)))
    return rows.groupBy((F.col("cik") % 6).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.count_if(derived).alias("n_derived"))

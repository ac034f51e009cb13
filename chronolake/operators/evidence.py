"""Evidence about evidence: attestations kept as JSON, lineage from facts to raw snapshots, and summaries of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Divisions of the standard industrial classification: first and last code, name. Fixed values.
DIVISIONS = (
    (100, 999, "Agriculture, forestry and fishing"),
    (1000, 1499, "Mining"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4999, "Transport, communications and utilities"),
    (5000, 5199, "Wholesale trade"),
    (5200, 5999, "Retail trade"),
    (6000, 6799, "Finance, insurance and real estate"),
    (7000, 8999, "Services"),
    (9100, 9729, "Public administration"),
    (9900, 9999, "Nonclassifiable establishments"),
)
#: Beginnings of the codes of financial companies. Fixed values.
FINANCIAL = ("60", "61", "64")


def division(code: Column) -> Column:
    """The division of the first three or four digits in ``code``; null without any."""
    number = F.try_to_number(F.nullif(F.regexp_extract(code, r"\d{3,4}", 0), F.lit("")), F.lit("9999")).cast("int")
    return F.coalesce(*[F.when(number.between(a, b), name) for a, b, name in DIVISIONS])


def is_financial(code: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    return F.substring(digits, 1, 2).isin(*FINANCIAL)


def text_at(document: Column, *path: str) -> Column:
    """The text at a path of a JSON document, or null."""
    return F.get_json_object(document, "$." + ".".join(path))


def listed_at(document: Column, *path: str) -> Column:
    """The array of texts at a path of a JSON document."""
    return F.from_json(text_at(document, *path), "array<string>")


def list_digest(texts: Column) -> Column:
    """SHA-256 of an array of texts, sorted, as compact JSON."""
    return F.sha2(F.to_json(F.array_sort(texts)), 256)


def lines_digest(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, n, digest: SHA-256 of the group's texts in order, a line each. For groups that are lists of members, not data."""
    return rows.groupBy(*keys).agg(F.count(text).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))


def canonical(column: Column, kind: T.DataType) -> Column:
    """``column`` with the fields of structs, and the keys of maps, in order, at any depth, ready for ``to_json``."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*[canonical(column.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(column)))
    return column


def canonical_digest(column: Column, kind: T.DataType) -> Column:
    """SHA-256 of a value as JSON with sorted keys, so that equal values have equal digests."""
    return F.sha2(F.to_json(canonical(column, kind), {"ignoreNullFields": "false"}), 256)


def lineage(facts: DataFrame, log: DataFrame, links: DataFrame, snapshots: DataFrame, role: str, prefix: str) -> DataFrame:
    """Facts with the ingest and the raw snapshot that they came from; what can't show both isn't there.

    ``facts``: run_id, snapshot_id, rowset, subject_id, ...; ``log``: run_id, source, status, n_rows, subject_id;
    ``links``: run_id, snapshot_id, role; ``snapshots``: snapshot_id, http_status, n_parsed, rowset. The small relations
    are joined first, so facts are shuffled once.
    """
    c = F.col
    good = log.where(c("source").startswith(prefix) & c("status").isin("success", "warning") & (c("n_rows") > 0)).select("run_id", "subject_id", c("status").alias("ingest_status"))
    read = snapshots.where(c("http_status").between(200, 299) & (c("n_parsed") > 0)).select("snapshot_id", "rowset")
    path = links.where(c("role") == role).select("run_id", "snapshot_id").distinct().join(good, "run_id").join(read, "snapshot_id")
    return facts.join(path, ["run_id", "snapshot_id", "subject_id", "rowset"])


def retained(snapshots: DataFrame) -> DataFrame:
    """dataset, n, latest: what of each dataset is kept."""
    return snapshots.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max("received_at").alias("latest"))


def case_counts(cases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ``cases`` (state, severity, subject_type, subject_id): by state, unresolved ones by severity, subjects affected."""
    c = F.col
    open_ = c("state") != "resolved"
    states = [F.count_if(c("state") == s).alias(f"n_{s}") for s in ("open", "acknowledged", "deferred", "resolved")]
    severe = [F.count_if(open_ & (c("severity") == s)).alias(f"n_{s}_unresolved") for s in ("critical", "high")]
    return cases.groupBy(*by).agg(*states, F.count_if(open_).alias("n_unresolved"), *severe, F.countDistinct(F.when(open_, F.struct("subject_type", "subject_id"))).alias("n_subjects"), F.count(F.lit(1)).alias("n"))


def latest_state(events: DataFrame, case: str = "case_id", order: str = "sequence") -> DataFrame:
    """The state of each case after its last event; severity is the highest it ever had (``severity_rank``)."""
    w = Window.partitionBy(case)
    top = events.withColumn("severity_rank", F.max("severity_rank").over(w)).withColumn("occurrences", F.count(F.lit(1)).over(w))
    return top.withColumn("_r", F.row_number().over(w.orderBy(F.col(order).desc()))).where("_r = 1").drop("_r")

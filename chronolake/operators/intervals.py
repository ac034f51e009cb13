"""Half-open intervals [start, end) of a key: merging, intersecting, gaps, overlaps, runs. A null end is open.

``merge`` and ``subtract`` are one window's work for each key. Their ``spread_`` forms deal the boundaries of all keys into
ranges, so one key may hold most of the spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running

OPEN = "9999-12-31"


def _closed(df: DataFrame) -> DataFrame:
    return df.withColumn("end", F.coalesce("end", F.to_date(F.lit(OPEN))))


def merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: intervals that touch or overlap become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = _closed(df).withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def intersect(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: where an interval of each side overlap."""
    a, b = _closed(left).alias("a"), _closed(right).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.start") < F.col("b.end"), F.col("b.start") < F.col("a.end")]
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))


def gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: what lies between the merged intervals of a key."""
    w = Window.partitionBy(*keys).orderBy("start")
    following = merge(df, keys).withColumn("_next", F.lead("start").over(w))
    return following.where(F.col("_next").isNotNull()).select(*keys, F.col("end").alias("start"), F.col("_next").alias("end"))


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: what the intervals of the left cover and those of the right don't.

    A sweep: every boundary of a key is one row, and depth counts how many of each side are open after it.
    """

    def edges(df: DataFrame, a: int, b: int) -> DataFrame:
        closed = _closed(df).where(F.col("start") < F.col("end"))
        return closed.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(a).alias("l"), F.lit(b).alias("r")), F.struct(F.col("end").alias("at"), F.lit(-a).alias("l"), F.lit(-b).alias("r")))).alias("_e")).select(*keys, "_e.*")

    steps = edges(left, 1, 0).unionByName(edges(right, 0, 1)).groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("l").over(upto).alias("_l"), F.sum("r").over(upto).alias("_r"))
    return merge(swept.where("_l > 0 AND _r = 0").select(*keys, "start", "end"), keys)


def _boundaries(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, at, ``column``: how many more spans are open from each boundary on; spans that touch leave nothing there."""
    closed = _closed(df).where(F.col("start") < F.col("end"))
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias(column)), F.struct(F.col("end").alias("at"), F.lit(-1).alias(column)))
    return closed.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*")


def _islands(swept: DataFrame, keys: Sequence[str], inside: Column, before: Column, parts: int | None) -> DataFrame:
    """keys, start, end: the runs of boundaries after which ``inside`` holds; ``before`` says whether it held just before."""
    marks = swept.withColumns({"_in": inside, "_was": before}).where(F.col("_in") != F.col("_was")).select(*keys, "at", F.col("_in").cast("int").alias("_starts"))
    numbered = running(marks, keys, ["at"], {"_island": "_starts"}, parts)
    return numbered.groupBy(*keys, "_island").agg(F.min("at").alias("start"), F.max("at").alias("end")).drop("_island")


def spread_merge(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """``merge`` for keys of any size: boundaries are summed up in every task before they are dealt out in order, the depth
    is a running sum over ranges, and an island runs from where it leaves zero to where it comes back. Empty spans are none."""
    c = F.col
    steps = _boundaries(df, keys, "n").groupBy(*keys, "at").agg(F.sum("n").alias("n")).where("n <> 0")
    swept = running(steps, keys, ["at"], {"_depth": "n"}, parts)
    return _islands(swept, keys, c("_depth") > 0, c("_depth") - c("n") > 0, parts)


def spread_subtract(left: DataFrame, right: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """``subtract`` for keys of any size."""
    c = F.col
    both = _boundaries(left, keys, "l").withColumn("r", F.lit(0)).unionByName(_boundaries(right, keys, "r").withColumn("l", F.lit(0)))
    steps = both.groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where("l <> 0 OR r <> 0")
    swept = running(steps, keys, ["at"], {"_l": "l", "_r": "r"}, parts)
    return _islands(swept, keys, (c("_l") > 0) & (c("_r") == 0), (c("_l") - c("l") > 0) & (c("_r") - c("r") == 0), parts)


def meeting(left: DataFrame, right: DataFrame, keys: Sequence[str], days: int = 90) -> DataFrame:
    """Pairs of rows of one key whose spans meet, as columns ``a`` and ``b`` (structs of the rows): a bucketed join.

    Each span is repeated for the periods of ``days`` that it touches, and the period is part of the equi-join's key, so
    the spans of one key meet in many tasks. A pair that shares several periods counts in the first one. Open spans reach to
    the last boundary of either side.
    """
    c = F.col
    last = lambda df: df.agg(F.max(F.greatest("start", F.coalesce("end", "start")))).first()[0]
    horizon = F.lit(max(filter(None, (last(left), last(right))), default=None)).cast("date")
    period = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / days)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        closed = df.withColumn("_to", F.coalesce("end", F.to_date(F.lit(OPEN)))).where(c("start") < c("_to"))
        touched = F.sequence(period(c("start")), period(F.greatest(c("start"), F.least(F.date_sub("_to", 1), horizon))))
        row = F.struct(*df.columns).alias(name)
        return closed.select(*[c(k).alias(f"_{name}_{k}") for k in keys], F.explode(touched).alias(f"_{name}"), c("start").alias(f"_{name}_start"), c("_to").alias(f"_{name}_end"), row)

    a, b = dealt(left, "a"), dealt(right, "b")
    on = [c(f"_a_{k}") == c(f"_b_{k}") for k in keys] + [c("_a") == c("_b"), c("_a_start") < c("_b_end"), c("_b_start") < c("_a_end")]
    return a.join(b, on).where(c("_a") == period(F.greatest("_a_start", "_b_start"))).select("a", "b")


def overlaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that start before the row before them (of the same key) has ended."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return _closed(df).withColumn("_before", F.lag("end").over(w)).where(F.col("_before") > F.col("start")).drop("_before")


def longest_run(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """keys, longest: the longest run of consecutive integers in ``position``."""
    distinct = df.select(*keys, position).distinct()
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return distinct.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest"))

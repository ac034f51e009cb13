"""Cross-sectional ranks and selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut

#: Grades by score, best first. Fixed values.
GRADES = ((85.0, "A+"), (70.0, "A"), (55.0, "B"), (40.0, "C"))


def percentile(value: Column, *section: str) -> Column:
    """Share of the section's values, one's own included in the count, that lie strictly below; null for null.

    Nulls are sorted last, so all percentiles of a section are made from one shuffle by the section alone. A section is one
    task's work; ``spread_percentiles`` deals it out.
    """
    held = Window.partitionBy(*section)
    return F.when(value.isNotNull(), (F.rank().over(held.orderBy(value.asc_nulls_last())) - 1) / F.count(value).over(held))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> list[Column]:
    """``left``'s columns equal ``right``'s of the same names after an underscore, nulls too."""
    return [left[c].eqNullSafe(right[f"_{c}"]) for c in columns]


def _dealt(df: DataFrame, section: Sequence[str], order: Sequence[Column | str], parts: int | None) -> DataFrame:
    """``df`` with _range: ranges of about equal size of the rows in the order of section and ``order``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *section, *order).withColumn("_range", F.spark_partition_id())


def numbered(df: DataFrame, section: Sequence[str], order: Sequence[Column | str], position: str = "position", size: str = "size", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 0, long) in its section under ``order``, and the section's number of rows.

    Two levels, so a section of any size is spread: rows are dealt into ranges of the order and numbered within these; what
    comes before a range is a running sum over the sections' counts by range. ``order`` must be a total order, or the places
    of equals are arbitrary (but kept: the ranges are written once).
    """
    c = F.col
    own = Window.partitionBy(*section, "_range").orderBy(*order)
    local = cut(_dealt(df, section, order, parts).withColumn("_local", F.row_number().over(own)))
    counts = local.groupBy(*section, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*section)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[c(s).alias(f"_{s}") for s in section], c("_range").alias("__range"), before.alias("_before"), F.sum("_n").over(whole).alias("_size"))
    met = local.join(starts, _same(local, starts, [*section, "_range"]))
    return met.select(*[local[x] for x in df.columns], (c("_before") + c("_local") - 1).alias(position), c("_size").alias(size))


def running(df: DataFrame, section: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column | str], parts: int | None = None) -> DataFrame:
    """``df`` with the running sums of each section in the order of ``order`` (distinct within a section), the row itself included.

    Two levels, as in ``numbered``: sums within ranges of the order, and a running sum over the ranges' sums.
    """
    c = F.col
    own = Window.partitionBy(*section, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    given = df.withColumns({f"_in_{n}": c(x) if isinstance(x, str) else x for n, x in sums.items()})
    local = cut(_dealt(given, section, order, parts).withColumns({f"_own_{n}": F.sum(f"_in_{n}").over(own) for n in sums}))
    totals = local.groupBy(*section, "_range").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    upto = Window.partitionBy(*section).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[c(s).alias(f"_{s}") for s in section], c("_range").alias("__range"), *[F.coalesce(F.sum(f"_sum_{n}").over(upto), F.lit(0)).alias(f"_before_{n}") for n in sums])
    met = local.join(before, _same(local, before, [*section, "_range"]))
    return met.select(*[local[x] for x in df.columns], *[(c(f"_before_{n}") + c(f"_own_{n}")).alias(n) for n in sums])


def spread_percentiles(df: DataFrame, key: str, section: Sequence[str], values: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``<value>_pct`` of each of ``values``: ``percentile`` for sections of any size, exact with ties.

    ``key`` is unique. The values of all metrics are dealt together into ranges of (section, metric, value); within a range
    they are ranked, and what lies below the range is a running sum over the ranges. A value that fills several ranges has
    in all of them the rank of its first row: a range's lowest value takes it from the range where that value begins.
    """
    c = F.col
    long = df.select(key, *section, F.explode(F.array(*[F.struct(F.lit(v).alias("_metric"), c(v).cast("double").alias("_value")) for v in values])).alias("_m"))
    long = long.select(key, *section, "_m.*").where("_value IS NOT NULL")
    by = [*section, "_metric"]
    local = cut(_dealt(long, by, ["_value", key], parts).withColumn("_rank", F.rank().over(Window.partitionBy(*by, "_range").orderBy("_value"))))
    ranges = local.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.max("_rank").alias("_top"))
    w = Window.partitionBy(*by).orderBy("_range")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.lag("_hi").over(w) < c("_lo"), F.lit(True))
    ranges = ranges.withColumns({"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_begins": begins, "_total": F.sum("_n").over(Window.partitionBy(*by))})
    # Where a range's highest value starts, unless the whole range is one value that started earlier.
    ranges = ranges.withColumn("_start", F.when(c("_begins") | (c("_lo") < c("_hi")), c("_before") + c("_top") - 1))
    below = F.when(c("_begins"), c("_before")).otherwise(F.last("_start", ignorenulls=True).over(upto))
    starts = ranges.select(*[c(s).alias(f"_{s}") for s in (*by, "_range")], c("_lo"), c("_before"), below.alias("_below"), c("_total"))
    met = local.join(starts, _same(local, starts, [*by, "_range"]))
    pct = F.when(c("_value") == c("_lo"), c("_below")).otherwise(c("_before") + c("_rank") - 1) / c("_total")
    wide = met.select(local[key], local["_metric"], pct.alias("_pct")).groupBy(key).agg(*[F.max(F.when(c("_metric") == v, c("_pct"))).alias(f"{v}_pct") for v in values])
    return df.join(wide, key, "left")


def mean_of(columns: Sequence[str], least: int = 2) -> Column:
    """The mean of the values that are there, if ``least`` are."""
    there = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(there >= least, total / there)


def grade(score: Column) -> Column:
    chain = F.when(score.isNull(), None)
    for least, name in GRADES:
        chain = chain.when(score >= least, name)
    return chain.otherwise("D")


def ordinal(section: Sequence[str], score: str, tie: str) -> Column:
    return F.row_number().over(Window.partitionBy(*section).orderBy(F.col(score).desc_nulls_last(), F.col(tie)))


def capped_top(df: DataFrame, group: str, cap: int, n: int, score: str, tie: str) -> DataFrame:
    """The n best rows with at most ``cap`` of a group: equal to a greedy walk, as a group's cap depends on its own picks only.

    The first ranking keeps ``cap`` rows of a group; the second is a top-n, not a sort of all.
    """
    best = df.withColumn("_in_group", ordinal([group], score, tie)).where(F.col("_in_group") <= cap).drop("_in_group")
    return best.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).limit(n)


def selection(df: DataFrame, lacking: Mapping[str, Column], group: str, cap: int, n: int, score: str, tie: str) -> DataFrame:
    """``capped_top`` with its reasons: ``df`` with rank (of the n that are taken) and reason (of those that are passed over).

    A row is passed over for the first of ``lacking`` that holds, else because its group has its ``cap``. Rows after the last
    pick aren't looked at, and are left out, unless fewer than n could be taken; rows without a score are left out.
    """
    c = F.col
    reason = F.coalesce(*[F.when(x, name) for name, x in lacking.items()])
    told = df.where(c(score).isNotNull()).withColumn("reason", reason)
    best = told.where("reason IS NULL").withColumn("_in_group", ordinal([group], score, tie)).where(c("_in_group") <= cap)
    picked = best.orderBy(c(score).desc(), tie).limit(n).select(c(tie).alias("_tie"), c(score).alias("_score"))
    # n rows at most, broadcast and numbered in one task.
    taken = picked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(c("_score").desc(), "_tie")))
    last = taken.agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_score", (-c("rank")).alias("_r"), c("_tie").alias("_at"))).alias("_last"))
    joined = told.join(F.broadcast(taken.drop("_score")), c(tie) == c("_tie"), "left").join(F.broadcast(last), F.lit(True))
    before = (c(score) > c("_last._score")) | ((c(score) == c("_last._score")) & (c(tie) < c("_last._at")))
    kept = joined.where(c("rank").isNotNull() | (c("_n") < n) | before)
    over = F.when(c("rank").isNull(), F.coalesce("reason", F.concat(c(group), F.lit(" limit reached"))))
    return kept.select(*df.columns, "rank", over.alias("reason"))

"""Series and statements: fiscal labels, trailing twelve months, returns, curves, vintages, merges and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Labels of full years and of single quarters. Fixed values.
YEAR_LABEL, QUARTER_LABEL = r"^FY(\d{4})$", r"^Q([1-4])_(\d{4})$"


def fiscal_label(label: Column) -> Column:
    """struct(full, year, quarter): is it a full year's label (whatever follows FY), and the year and quarter that it names
    exactly; null where it doesn't. Case and outer spaces make no difference."""
    text = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    part = lambda pattern, k: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k).cast("int"))
    return F.struct(text.startswith("FY").alias("full"), F.coalesce(part(YEAR_LABEL, 1), part(QUARTER_LABEL, 2)).alias("year"), part(QUARTER_LABEL, 1).alias("quarter"))


def trailing_year(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ttm: a flow's value over the year that ends with its newest period, or null where the labels leave a doubt.

    ``history``: keys, period_end, fiscal_period, value; one row for each period end. With a full year: that year's value
    plus the quarters after it less the same quarters of that year. The quarters after must be labelled Q1..Qk of the next
    year, in the order of their ends, and each must have exactly one counterpart up to the year's end. Without any full
    year: the sum of the last four rows, if their labels are consecutive quarters.

    All windows share the keys' partitioning, so the history is shuffled once.
    """
    c, by = F.col, Window.partitionBy(*keys)
    rows = history.select(*keys, "period_end", "value", fiscal_label(c("fiscal_period")).alias("_l")).select(*keys, "period_end", "value", c("_l.full").alias("_full"), c("_l.year").alias("_year"), c("_l.quarter").alias("_quarter"))
    annual = F.max(F.when(c("_full"), F.struct("period_end", "_year", "value"))).over(by)
    rows = rows.withColumn("_annual", annual).withColumn("_post", F.coalesce(~c("_full") & (c("period_end") > c("_annual.period_end")), F.lit(False)))
    rows = rows.withColumn("_k", F.count_if("_post").over(by)).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_full", "_post").orderBy("period_end")))
    single = Window.partitionBy(*keys, "_full")
    serial = F.when(c("_quarter").isNotNull(), c("_year") * 4 + c("_quarter"))
    rows = rows.withColumn("_serial", serial).withColumn("_back", F.row_number().over(single.orderBy(F.desc("period_end")))).withColumn("_step", c("_serial") - F.lag("_serial").over(single.orderBy("period_end")))
    fits = F.coalesce((c("_year") == c("_annual._year") + 1) & (c("_quarter") == c("_nth")), F.lit(False))
    prior = F.coalesce((c("period_end") <= c("_annual.period_end")) & (c("_year") == c("_annual._year")) & c("_quarter").between(1, c("_k")), F.lit(False))
    last = ~c("_full") & (c("_back") <= 4)
    sums = rows.groupBy(*keys).agg(
        F.max("_annual").alias("_annual"),
        F.max("_k").alias("_k"),
        F.count_if(c("_post") & ~fits).alias("_odd"),
        F.coalesce(F.sum(F.when(c("_post"), c("value"))), F.lit(0.0)).alias("_added"),
        F.count_if(prior).alias("_n_prior"),
        F.bit_or(F.when(prior, F.pow(F.lit(2), c("_quarter")).cast("int"))).alias("_kinds"),
        F.coalesce(F.sum(F.when(prior, c("value"))), F.lit(0.0)).alias("_taken"),
        F.count_if(last & c("_serial").isNotNull()).alias("_n_last"),
        F.count_if(last & (c("_back") <= 3) & (c("_step") == 1)).alias("_n_steps"),
        F.sum(F.when(last, c("value"))).alias("_last"),
    )
    matched = (c("_odd") == 0) & (c("_k") <= 4) & (c("_n_prior") == c("_k")) & (F.coalesce("_kinds", F.lit(0)) == F.pow(F.lit(2), c("_k") + 1).cast("int") - 2)
    rolled = F.when(c("_k") == 0, c("_annual.value")).when(matched, c("_annual.value") + c("_added") - c("_taken"))
    plain = F.when((c("_n_last") == 4) & (c("_n_steps") == 3), c("_last"))
    return sums.select(*keys, F.when(c("_annual").isNull(), plain).otherwise(rolled).alias("ttm"))


def in_order(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def with_returns(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds ret: change against the row before; null at the first row and where the row before is not positive."""
    before = F.lag(value).over(in_order(keys, order))
    return df.withColumn("ret", F.when(before > 0, F.col(value) / before - 1))


def with_drawdown(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds peak and drawdown (0 or below)."""
    peak = F.max(value).over(in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") != 0, F.col(value) / F.col("peak") - 1))


def later_product(keys: Sequence[str], order: str, factor: str) -> Column:
    """The product of the factors of all later rows (1 at the last): one running product from the end of each key."""
    later = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.product(F.col(factor)).over(later), F.lit(1.0))


def sharpe_and_t(ret: Column, periods: float) -> tuple[Column, Column]:
    """Annualised mean over sample deviation, and the t statistic of the mean; null below two values or without spread."""
    n, mean, spread = F.count(ret), F.avg(ret), F.stddev_samp(ret)
    fine = (n >= 2) & (spread > 0)
    return F.when(fine, mean / spread * F.sqrt(F.lit(float(periods)))), F.when(fine, mean / (spread / F.sqrt(n)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()) -> DataFrame:
    """``old`` overwritten by ``new`` on the keys; the columns ``keep_if_null`` keep their old value where the new is null."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    arrived = F.col(f"b.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        fresh = F.coalesce(f"b.{c}", f"a.{c}") if c in keep_if_null or c in keys else F.col(f"b.{c}")
        return F.when(arrived, fresh).otherwise(F.col(f"a.{c}")).alias(c)

    return joined.select(*[value(c) for c in old.columns])


def delta(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change: added, removed, changed or unchanged, comparing all other columns null-safely."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.withColumn("_a", F.lit(1)).alias("a"), new.withColumn("_b", F.lit(1)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], change.alias("change"))


def quotient(above: Column, below: Column) -> Column:
    """above / below by the rules of floating point: over zero infinite, or not a number where ``above`` is zero too or is none."""
    over_zero = F.when((above == 0) | F.isnan(above), float("nan")).otherwise(F.signum(above) * float("inf"))
    return F.when(below != 0, above / below).when(below == 0, over_zero)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def shift_year(day: Column) -> Column:
    """A text of the form year-month-day with the year before; any other text as it is. Days aren't checked: the 29th of
    February stays."""
    parts, shape = F.split(day, "-"), day.rlike(r"^\s*[0-9]+\s*-[^-]*-[^-]*$")
    year = (F.trim(F.get(parts, F.lit(0))).try_cast("bigint") - 1).cast("string")
    return F.when(shape, F.concat_ws("-", year, F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).otherwise(day)

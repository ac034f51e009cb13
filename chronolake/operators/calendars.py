"""The sessions of the US equity exchanges, by rule: weekdays less holidays and the days that were closed besides."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .asof import few

#: Days on which the whole market was closed out of turn. Fixed values.
CLOSED = ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")
#: First years of holidays that came later: Martin Luther King's and Juneteenth. Fixed values.
KING, JUNETEENTH = 1998, 2022


def easter(year: Column) -> Column:
    """Western Easter Sunday: the Sunday after the ecclesiastical full moon."""
    whole = lambda x: F.floor(x).cast("int")
    golden, century = year % 19, whole(year / 100)
    epact = F.pmod(century - whole(century / 4) - whole((8 * century + 13) / 25) + 19 * golden + 15, F.lit(30))
    moon = epact - whole(epact / 28) * (1 - whole(epact / 28) * whole(F.lit(29) / (epact + 1)) * whole((21 - golden) / 11))
    weekday = F.pmod(year + whole(year / 4) + moon + 2 - century + whole(century / 4), F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), moon - weekday)


def _observed(day: Column) -> Column:
    """The Friday before a Saturday, the Monday after a Sunday."""
    return F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)


def holidays(year: Column) -> Column:
    """The scheduled holidays of a year, as an array of dates."""
    date = lambda month, day: F.make_date(year, F.lit(month), F.lit(day))
    nth = lambda month, name, n: F.date_add(F.next_day(F.date_sub(date(month, 1), 1), name), 7 * (n - 1))
    new_year = date(1, 1)
    days = [
        F.when(F.dayofweek(new_year) == 1, F.date_add(new_year, 1)).otherwise(new_year),  # a Saturday isn't made up for
        F.when(year >= KING, nth(1, "Mon", 3)),
        nth(2, "Mon", 3),
        F.date_sub(easter(year), 2),
        F.date_sub(F.next_day(date(5, 31), "Mon"), 7),
        F.when(year >= JUNETEENTH, _observed(date(6, 19))),
        _observed(date(7, 4)),
        nth(9, "Mon", 1),
        nth(11, "Thu", 4),
        _observed(date(12, 25)),
    ]
    return F.array_compact(F.array(*days))


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """date: the sessions in [start, end); some 250 rows a year."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("date")) if start < end else spark.createDataFrame([], "date date")
    shut = F.array(*[F.lit(x).cast("date") for x in CLOSED])
    open_ = F.dayofweek("date").between(2, 6) & ~F.array_contains(holidays(F.year("date")), F.col("date")) & ~F.array_contains(shut, F.col("date"))
    return days.where(open_)


#: Days within which there is a session after any day: the longest closure had six days in a row, weekend included.
LONGEST_CLOSURE = 12


def placed(days: DataFrame) -> DataFrame:
    """date, is_session, next_session of ``days`` (date, each once); a null date is no session and has no next one.

    The days after each are looked up among the sessions by equality, so there is no range join.
    """
    first, last = days.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return days.select("date", F.lit(False).alias("is_session"), F.lit(None).cast("date").alias("next_session"))
    open_ = sessions(days.sparkSession, str(first), str(last + timedelta(days=LONGEST_CLOSURE + 1))).withColumnRenamed("date", "_day")
    own = days.select("date", F.explode(F.sequence("date", F.date_add("date", LONGEST_CLOSURE))).alias("_day")).join(few(open_), "_day")
    found = own.groupBy("date").agg(F.min("_day").alias("_first"), F.min(F.when(F.col("_day") > F.col("date"), F.col("_day"))).alias("next_session"))
    return days.join(found, "date", "left").select("date", F.coalesce(F.col("_first") == F.col("date"), F.lit(False)).alias("is_session"), "next_session")

"""Holidays, price bands and billing periods, generated as tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.config import MID, OFF, ON, SUMMER, SUMMER_MONTHS, WINTER
from ampledger.functions.timeexpr import col, instant, period_end, period_start

_BANDS = {ON, MID, OFF}
YEARS = (1900, 2200)  # of the table of all holidays: some 4,000 rows


def _monday_from(day: Column) -> Column:
    return F.next_day(F.date_sub(day, 1), "MON")


def _good_friday(year: Column) -> Column:
    """Two days before Easter Sunday, by the Gregorian computus in whole numbers."""

    def div(a: Column, n: int) -> Column:
        return F.floor(a / n).cast("int")

    golden, century, rest = year % 19, div(year, 100), year % 100
    leap, cycle = div(century, 4), century % 4
    moon = (19 * golden + century - leap - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    sunday = (32 + 2 * cycle + 2 * div(rest, 4) - moon - rest % 4) % 7
    shift = moon + sunday - 7 * div(golden + 11 * moon + 22 * sunday, 451) + 114
    return F.date_sub(F.make_date(year, div(shift, 31), shift % 31 + 1), 2)


def holidays(years: DataFrame) -> DataFrame:
    """``date, substitute_for, name`` of every holiday of ``years(year)`` and its weekday substitute.

    A substitute is the next free weekday: Christmas and Boxing Day move by two days from
    either weekend day, all others to Monday.
    """
    y = F.col("year")
    rules = {
        "New Year's Day": F.make_date(y, F.lit(1), F.lit(1)),
        "Family Day": F.date_add(_monday_from(F.make_date(y, F.lit(2), F.lit(1))), 14),
        "Good Friday": _good_friday(y),
        "Victoria Day": _monday_from(F.make_date(y, F.lit(5), F.lit(18))),
        "Canada Day": F.make_date(y, F.lit(7), F.lit(1)),
        "Civic Holiday": _monday_from(F.make_date(y, F.lit(8), F.lit(1))),
        "Labour Day": _monday_from(F.make_date(y, F.lit(9), F.lit(1))),
        "Thanksgiving Day": F.date_add(_monday_from(F.make_date(y, F.lit(10), F.lit(1))), 7),
        "Christmas Day": F.make_date(y, F.lit(12), F.lit(25)),
        "Boxing Day": F.make_date(y, F.lit(12), F.lit(26)),
    }
    each = F.explode(F.array(*(F.struct(d.alias("date"), F.lit(n).alias("name")) for n, d in rules.items())))
    base = years.select("year").distinct().select(each.alias("h")).select("h.date", "h.name")
    weekday = F.weekday("date")
    moved = F.when(F.col("name").isin("Christmas Day", "Boxing Day") | (weekday == 5), 2).otherwise(1)
    substitutes = base.where(weekday >= 5).select(
        F.date_add("date", moved).alias("date"), F.col("date").alias("substitute_for"), "name"
    )
    return base.select("date", F.lit(None).cast("date").alias("substitute_for"), "name").unionByName(substitutes)


def all_holidays(spark: SparkSession) -> DataFrame:
    """``holidays`` of every year of YEARS, so that no pass over the data is needed to learn its years."""
    return holidays(spark.range(YEARS[0], YEARS[1] + 1).select(F.col("id").cast("int").alias("year")))


def holidays_between(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """The holidays, substitutes included, that fall on the dates from ``first`` to ``last``."""
    return all_holidays(spark).where(F.col("date").between(first, last))


def day_off(days: DataFrame, holiday: DataFrame) -> DataFrame:
    """``days(date)`` with ``off``: weekend or holiday. The holiday table is a dozen rows a year."""
    marks = F.broadcast(holiday.select("date").distinct().withColumn("is_holiday", F.lit(True)))
    return days.join(marks, "date", "left").withColumn(
        "off", (F.weekday("date") >= 5) | F.coalesce("is_holiday", F.lit(False))
    )


def band(day: Column | str, hour: Column | str, off: Column | str) -> Column:
    """Price band of a local hour."""

    def schedule(rows) -> Column:
        out = F.lit(rows[0][1])
        for start, name in rows[1:]:
            out = F.when(col(hour) >= start, name).otherwise(out)
        return out

    summer = F.month(col(day)).between(*SUMMER_MONTHS)
    return F.when(col(off), OFF).when(summer, schedule(SUMMER)).otherwise(schedule(WINTER))


def tou_calendar(days: DataFrame, holiday: DataFrame) -> DataFrame:
    """``date, hour, tou`` for each of ``days(date)``."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    return day_off(days.select("date").distinct(), holiday).select("date", hours.alias("hour"), "off").select(
        "date", "hour", band("date", "hour", "off").alias("tou")
    )


def tou_blocks(days: DataFrame, holiday: DataFrame) -> DataFrame:
    """``start_utc, end_utc, tou``: the maximal stretches of one band over consecutive local days.

    Hours that begin a block are found per day first, so the one ordered pass over all days
    has a handful of rows a day.
    """
    cal = tou_calendar(days, holiday)
    in_day = Window.partitionBy("date").orderBy("hour")
    starts = cal.withColumn("before", F.lag("tou").over(in_day)).where("before is null or before <> tou")
    whole = Window.orderBy("date", "hour")  # a calendar: bounded by the days covered, not by the data
    islands = starts.withColumn("prev", F.lag("tou").over(whole)).withColumn("prev_date", F.lag("date").over(whole))
    new = F.col("prev").isNull() | (F.col("prev") != F.col("tou")) | (F.datediff("date", "prev_date") > 1)
    islands = islands.withColumn("island", F.sum(new.cast("int")).over(whole))
    spans = islands.groupBy("island").agg(
        F.first("tou").alias("tou"),
        F.min(F.struct("date", "hour")).alias("a"),
        F.max("date").alias("last"),
    )
    nxt = F.lead(F.struct("a.date", "a.hour")).over(Window.orderBy("island"))
    spans = spans.withColumn("z", nxt)
    wall = lambda d, h: F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), h, F.lit(0), F.lit(0))
    end_day = F.date_add("last", 1)
    joined = F.col("z").isNotNull() & (F.col("z.date") <= end_day)
    return spans.select(
        instant(wall(F.col("a.date"), F.col("a.hour"))).alias("start_utc"),
        instant(F.when(joined, wall(F.col("z.date"), F.col("z.hour"))).otherwise(wall(end_day, F.lit(0)))).alias("end_utc"),
        "tou",
    )


def billing_periods(first: Column, last: Column, spark: SparkSession, day: int = 23) -> DataFrame:
    """``ending, start_utc, end_utc, days, hours`` of the periods with closing dates from ``first`` to ``last``."""
    months = F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("ending")
    return spark.range(1).select(months).select("ending", *_span("ending"))


def _span(ending: str) -> list[Column]:
    start, end = period_start(ending), period_end(ending)
    return [
        start.alias("start_utc"),
        end.alias("end_utc"),
        F.datediff(F.col(ending), F.add_months(ending, -1)).cast("long").alias("days"),
        ((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).cast("long").alias("hours"),
    ]

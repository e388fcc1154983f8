"""Which dates a site's session reports cover, by their file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.timeexpr import period_ending

_MONTHS = "january february march april may june july august september october november december".split()
_NAME = r"^Session_Report_([A-Za-z]+)_(\d{1,2})_(\d{4})-([A-Za-z]+)_(\d{1,2})_(\d{4})(?:-.*)?$"


def report_dates(named: DataFrame) -> DataFrame:
    """``named(name, ...)`` with ``first_date`` and ``last_date`` that the file name states.

    Both are null where it is not of that form, each where no such date exists. The name is
    taken apart once a row: generators keep its parts from being worked out for every use.
    """
    stem = F.regexp_replace(F.element_at(F.split("name", "/"), -1), r"\.[^.]*$", "")
    parts = F.when(stem.rlike(_NAME), F.slice(F.split(stem, "[_-]", 9), 3, 6))
    p = lambda k: F.element_at("_part", k)

    def date(at: int) -> Column:
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(p(at)))
        return F.concat_ws("-", p(at + 2), month.cast("string"), p(at + 1)).try_cast("date")

    dates = F.struct(date(1).alias("first_date"), date(4).alias("last_date"))
    return named.withColumn("_part", F.explode(F.array(parts))).select("*", F.inline(F.array(dates))).drop("_part")


def islands(ranges: DataFrame) -> DataFrame:
    """``site_id, first_date, last_date``: the covered stretches of ``ranges(site_id, first_date, last_date)``; adjacent days connect."""
    by_site = Window.partitionBy("site_id").orderBy("first_date", "last_date")
    reach = F.max("last_date").over(by_site.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.where("first_date is not null and last_date is not null").withColumn("reach", reach)
    new = F.col("reach").isNull() | (F.col("first_date") > F.date_add("reach", 1))
    runs = runs.withColumn("island", F.sum(new.cast("int")).over(by_site.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("site_id", "island").agg(F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")).drop("island")


def covered_periods(stretches: DataFrame, periods: DataFrame) -> DataFrame:
    """``site_id, period_ending, covered``: whether one stretch holds all dates of the period.

    Stretches are filed under each period they touch, so that they meet ``periods(site_id,
    period_ending)`` by equality.
    """
    noon = lambda d: F.timestamp_seconds(F.unix_seconds(F.col(d).cast("timestamp")) + 12 * 3600)
    touched = F.sequence(period_ending(noon("first_date")), period_ending(noon("last_date")), F.expr("interval 1 month"))
    filed = stretches.where("last_date >= first_date").withColumn("period_ending", F.explode(touched))
    starts = F.date_add(F.add_months("period_ending", -1), 1)
    whole = (F.col("first_date") <= starts) & (F.col("last_date") >= F.col("period_ending"))
    seen = filed.groupBy("site_id", "period_ending").agg(F.max(whole).alias("w"))
    return periods.join(seen, ["site_id", "period_ending"], "left").select("site_id", "period_ending", F.coalesce("w", F.lit(False)).alias("covered"))


def undated_reports(named: DataFrame) -> DataFrame:
    """The rows of ``named(name, ...)`` whose name says no dates, or a date that is none."""
    dated = report_dates(named)
    return dated.where("first_date is null or last_date is null").select(*named.columns)


def coverage_errors(named: DataFrame, periods: DataFrame) -> DataFrame:
    """``site_id, period_ending, coverage_error`` of each of ``periods``, from the names ``named(site_id, name)`` of the sites' reports.

    UndatedReport where a name says no dates; ReportsDoNotCover where the reports leave a day of the period out.
    Where ``named`` has a ``period_ending`` too, each report is filed for that period and speaks for it alone: an
    undated one refuses its period and no other. Without it all of a site's reports speak for all its periods.
    """
    if "period_ending" not in named.columns:
        return _coverage_errors(named.select("site_id", "name"), periods)
    filed = F.struct("site_id", "period_ending").alias("site_id")
    found = _coverage_errors(named.select(filed, "name"), periods.select(filed, "period_ending"))
    return found.select("site_id.site_id", "period_ending", "coverage_error")


def _coverage_errors(named: DataFrame, periods: DataFrame) -> DataFrame:
    dated = report_dates(named)
    undated = dated.groupBy("site_id").agg(F.max(F.col("first_date").isNull() | F.col("last_date").isNull()).alias("undated"))
    rows = covered_periods(islands(dated), periods).join(undated, "site_id", "left")
    error = F.when(F.col("undated"), "UndatedReport").when(~F.col("covered"), "ReportsDoNotCover")
    return rows.select("site_id", "period_ending", error.alias("coverage_error"))


def gated(rows: DataFrame, errors: DataFrame | None, figures: list[str]) -> DataFrame:
    """``rows`` with ``error`` from ``coverage_errors`` put first, and null ``figures`` where it is set.

    A period that is not among ``errors`` is not covered; without ``errors`` rows stay as they are.
    """
    if errors is None:
        return rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    known = errors.select("site_id", "period_ending", F.coalesce("coverage_error", F.lit("")).alias("_gate"))
    met = rows.join(known, ["site_id", "period_ending"], "left")
    gate = F.nullif(F.coalesce("_gate", F.lit("ReportsDoNotCover")), F.lit(""))
    error = F.coalesce(gate, F.col("error")) if "error" in rows.columns else gate
    met = met.withColumn("error", error).drop("_gate")
    return met.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in figures})

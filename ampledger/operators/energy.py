"""Session energy by price band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.config import MID, OFF, ON
from ampledger.functions.calendar import all_holidays, band, day_off
from ampledger.functions.timeexpr import local, period_ending


def energy_parts(sessions: DataFrame, day: int = 23) -> DataFrame:
    """``site_id, period_ending, date, tou, kwh``: sessions with ``adj_start, adj_end, energy`` cut into local hours.

    Energy is spread evenly over the adjusted span. Bands change on the hour, and so do
    periods, so each session is cut into its hours and each hour has one band and one
    period: a join with the few days' holidays, and no range join. A session of n hours
    gives n + 1 rows at most; rows combine before the shuffle.
    """
    live = sessions.where((F.col("adj_end") > F.col("adj_start")) & F.col("energy").isNotNull())
    hour0 = F.col("adj_start") - F.pmod("adj_start", F.lit(3600))
    hours = live.withColumn("h", F.explode(F.sequence(hour0, F.col("adj_end") - 1, F.lit(3600).cast("long"))))
    overlap = F.least("adj_end", F.col("h") + 3600) - F.greatest("adj_start", "h")
    at = local(F.timestamp_seconds("h"))
    parts = hours.select(
        "site_id",
        period_ending(F.timestamp_seconds("h"), day).alias("period_ending"),
        F.to_date(at).alias("date"),
        F.hour(at).alias("hour"),
        (F.col("energy") * overlap / (F.col("adj_end") - F.col("adj_start"))).alias("kwh"),
    )
    return day_off(parts, all_holidays(sessions.sparkSession)).select("site_id", "period_ending", "date", band("date", "hour", "off").alias("tou"), "kwh")


def _by_band(parts: DataFrame, *keys: str) -> DataFrame:
    each = (F.sum(F.when(F.col("tou") == b, F.col("kwh")).otherwise(0.0)).alias(f"{n}_kwh") for n, b in (("on", ON), ("mid", MID), ("off", OFF)))
    return parts.groupBy("site_id", "period_ending", *keys).agg(*each, F.sum("kwh").alias("kwh"))


def energy_by_day(sessions: DataFrame, day: int = 23) -> DataFrame:
    """``site_id, period_ending, date, on_kwh, mid_kwh, off_kwh, kwh`` by local date."""
    return _by_band(energy_parts(sessions, day), "date")


def energy_by_band(sessions: DataFrame, day: int = 23) -> DataFrame:
    """``site_id, period_ending, on_kwh, mid_kwh, off_kwh, kwh`` to six decimals."""
    sums = _by_band(energy_parts(sessions, day))
    return sums.select("site_id", "period_ending", *(F.round(c, 6).alias(c) for c in ("on_kwh", "mid_kwh", "off_kwh", "kwh")))

"""Requested intervals of interest: wall times, with or without a designator, to instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.functions.timeexpr import local

#: Designator and hours behind UTC; fixed values.
OFFSETS = {"EST": 5, "EDT": 4}


def candidates(wall: Column) -> Column:
    """``array<struct<name,at>>``: the instants that show this wall time; none in a gap, two in a fold."""
    tried = F.array(
        *(
            F.struct(F.lit(n).alias("name"), F.timestamp_seconds(F.unix_seconds(wall.cast("timestamp")) + h * 3600).alias("at"))
            for n, h in OFFSETS.items()
        )
    )
    return F.filter(tried, lambda c: local(c["at"]) == wall)


def checked_intervals(requests: DataFrame) -> DataFrame:
    """``request_id, start_utc, length_s, error`` of ``requests(request_id, start_local, length, designator)``.

    ``length`` is '1h', '15m' or null (an hour from :00, else a quarter); a start carries no
    seconds and lies on a quarter hour, an hour starts at :00. ``error`` names the first rule
    broken and leaves the other columns null.
    """
    at, found = F.col("start_local"), F.col("found")
    named = F.filter(found, lambda c: c["name"] == F.upper("designator"))
    length = F.coalesce("length", F.when(F.minute(at) == 0, "1h").otherwise("15m"))
    picked = F.when(F.col("designator").isNull(), found).otherwise(named)
    error = (
        F.when(at.isNull(), "NoStart")
        .when(F.date_trunc("minute", at) != at.cast("timestamp"), "CarriesSeconds")
        .when(F.minute(at) % 15 != 0, "OffQuarterHour")
        .when(~length.isin("1h", "15m"), "UnknownLength")
        .when((length == "1h") & (F.minute(at) != 0), "HourNotOnTheHour")
        .when(F.size(found) == 0, "NeverOccurred")
        .when(F.size(picked) > 1, "OccursTwice")
        .when(F.size(picked) == 0, "WrongDesignator")
    )
    rows = requests.withColumn("found", candidates(at)).withColumns({"error": error, "picked": picked})
    ok = F.col("error").isNull()
    return rows.select(
        "request_id",
        F.when(ok, F.element_at("picked", 1)["at"]).alias("start_utc"),
        F.when(ok, F.when(length == "1h", 3600).otherwise(900).cast("long")).alias("length_s"),
        "error",
    )

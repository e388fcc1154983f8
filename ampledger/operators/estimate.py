"""How much of a peak hour was charging: sessions joined to 15-minute segments, as brackets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, GRID_S, SEGMENT_S, SiteConfig
from ampledger.functions.load import site_load


def segments_of(intervals: DataFrame) -> DataFrame:
    """``site_id, interval_start, seg_start`` from ``intervals(site_id, interval_start, interval_s)``, in seconds."""
    last = F.col("interval_start") + F.col("interval_s") - SEGMENT_S
    step = F.lit(SEGMENT_S).cast("long")
    return intervals.select("site_id", "interval_start", F.explode(F.sequence(F.col("interval_start"), last, step)).alias("seg_start"))


def overlap_ratio() -> tuple[Column, Column]:
    """Least and greatest share of the segment that the session can cover: an edge that is the session's own is uncertain by a minute."""
    seg_end = F.col("seg_start") + SEGMENT_S
    a, b = F.greatest("adj_start", "seg_start"), F.least("adj_end", seg_end)
    a_max = a + F.when(F.col("adj_start") == a, GRID_S).otherwise(0)
    b_min = b - F.when(F.col("adj_end") == b, GRID_S).otherwise(0)
    return F.greatest(F.lit(0), b_min - a_max) / SEGMENT_S, (b - a) / SEGMENT_S


def segment_aggregates(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Brackets of vehicles and kW of each segment; segments without a session give zeros.

    Sessions are filed under each hour they touch and met there by site and hour: a segment
    lies in one hour, so each pair meets once, and the equi-join replaces a range join.
    ``sessions`` needs ``site_id, adj_start, adj_end, avg_kw``.
    """
    segments = segments_of(intervals).withColumn("h", F.floor(F.col("seg_start") / 3600))
    live = sessions.where(F.col("adj_end") > F.col("adj_start")).select("site_id", "adj_start", "adj_end", "avg_kw")
    hours = F.sequence(F.floor(F.col("adj_start") / 3600), F.floor((F.col("adj_end") - 1) / 3600))
    filed = live.withColumn("h", F.explode(hours))
    low, high = overlap_ratio()
    meets = (F.col("adj_start") < F.col("seg_start") + SEGMENT_S) & (F.col("adj_end") > F.col("seg_start"))
    found = filed.join(segments, ["site_id", "h"]).where(meets)
    sums = found.groupBy("site_id", "interval_start", "seg_start").agg(
        F.sum(low).alias("count_min"),
        F.sum(high).alias("count_max"),
        F.sum(low * F.col("avg_kw")).alias("kw_min"),
        F.sum(high * F.col("avg_kw")).alias("kw_max"),
        F.count("*").alias("members"),
    )
    keys = ["site_id", "interval_start", "seg_start"]
    return segments.drop("h").join(sums, keys, "left").fillna(0.0).fillna(0, "members")


def estimates(segments: DataFrame, cfg: SiteConfig = DEFAULT) -> DataFrame:
    """Energy-based and count-based kW and kVA at both ends of the brackets."""
    cols = {}
    for way, unit in (("energy", cfg.rating_kw), ("count", None)):
        for end in ("min", "max"):
            n = F.col(f"count_{end}") if unit is None else F.col(f"kw_{end}") / unit
            load = site_load(n, cfg)
            cols |= {f"{way}_kw_{end}": load["kw"], f"{way}_kva_{end}": load["kva"]}
    return segments.withColumns(cols)


def best_segments(estimated: DataFrame, digits: int | None = 6) -> DataFrame:
    """Of each interval the segment with the greatest middle of the bracket, by energy and by count; the earliest on a tie.

    ``digits``: decimals of the estimates, None for all.
    """
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))

    def best(way: str, by: str) -> Column:
        mid = F.round(F.col(f"{by}_min") + F.col(f"{by}_max"), 9)  # sums differ in the last digits by order
        names = [f"{way}_{u}_{e}" for u in ("kw", "kva") for e in ("min", "max")]
        return F.max(F.struct(mid.alias("mid"), (-F.col("seg_start")).alias("at"), *names)).alias(way)

    tops = estimated.groupBy("site_id", "interval_start").agg(best("energy", "kw"), best("count", "count"))
    out = [
        c
        for way in ("energy", "count")
        for c in (
            F.timestamp_seconds(-F.col(f"{way}.at")).cast("timestamp_ntz").alias(f"{way}_segment"),
            *(shown(F.col(f"{way}.{way}_{u}_{e}")).alias(f"{way}_{u}_{e}") for u in ("kw", "kva") for e in ("min", "max")),
        )
    ]
    return tops.select("site_id", F.timestamp_seconds("interval_start").cast("timestamp_ntz").alias("interval_start"), *out)

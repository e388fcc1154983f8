"""Report-shaped results, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.config import MID, OFF, ON, SEGMENT_S
from ampledger.operators.estimate import segments_of


def estimate_summary(best: DataFrame) -> DataFrame:
    """Four rows an interval: kW and kVA, by energy and by count, with the segment they come from."""
    rows = F.array(
        *(
            F.struct(
                F.lit(way).alias("way"), F.lit(unit).alias("unit"), F.col(f"{way}_{unit}_min").alias("low"),
                F.col(f"{way}_{unit}_max").alias("high"), F.col(f"{way}_segment").alias("segment"),
            )
            for way in ("energy", "count")
            for unit in ("kw", "kva")
        )
    )
    return best.select("site_id", "interval_start", F.explode(rows).alias("r")).select("site_id", "interval_start", "r.*")


def _touching(sessions: DataFrame, intervals: DataFrame, span: Column, start: str) -> DataFrame:
    """Sessions met with intervals inside one hour, by site and hour; strict overlap, spans that are inverted meet nothing."""
    live = sessions.where(F.col("adj_end") > F.col("adj_start"))
    filed = live.withColumn("h", F.explode(F.sequence(F.floor(F.col("adj_start") / 3600), F.floor((F.col("adj_end") - 1) / 3600))))
    asked = intervals.withColumn("h", F.floor(F.col(start) / 3600))
    return filed.join(asked, ["site_id", "h"]).where((F.col("adj_start") < F.col(start) + span) & (F.col("adj_end") > F.col(start)))


def segment_members(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """``site_id, interval_start, seg_start, nth, id``: the sessions of each segment, by file, bucket and row.

    Long form: a segment's list is never gathered in one row.
    """
    return _touching(sessions, segments_of(intervals), F.lit(SEGMENT_S), "seg_start").select(
        "site_id", "interval_start", "seg_start", "path", "bucket", "row", "id"
    )


def excluded_sessions(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every excluded session, with the number of intervals that its span, either way round, meets."""
    out = sessions.where("bucket = 'excluded'").select("site_id", "path", "row", "id", "adj_start", "adj_end")
    turned = out.withColumns({"adj_start": F.least("adj_start", "adj_end"), "adj_end": F.greatest("adj_start", "adj_end")})
    met = _touching(turned, intervals, F.col("interval_s"), "interval_start")
    n = met.groupBy("site_id", "path", "row", "id").agg(F.count("*").alias("n_intervals"))
    return out.join(n, ["site_id", "path", "row", "id"], "left").fillna(0, "n_intervals")


def interval_anomalies(intervals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Anomalies of all sessions, shared ids among them, that meet an interval within an hour; ``pos`` is their fixed order."""
    met = _touching(sessions, intervals, F.col("interval_s"), "interval_start")
    shared = F.when(F.col("duplicate_id"), F.array(F.lit("DuplicateId"))).otherwise(F.array().cast("array<string>"))
    named = F.posexplode(F.concat("anomalies", shared)).alias("pos", "anomaly")
    return met.select("site_id", "interval_start", "path", "row", "id", "avg_kw", named).withColumn("cell", anomaly_cell())


def printed_thousandths(x: Column) -> Column:
    """A figure of 1 or more as printed to three decimals: its exact binary value rounded, a half to even.

    Its fraction is a whole number of 2^-52, and a thousand times that still fits a long.
    """
    units = ((x - F.floor(x)) * float(2**52)).cast("long") * 1000
    low = F.shiftright(units, 52)
    rest, half = units - F.shiftleft(low, 52), 2**51
    up = (rest > half) | ((rest == half) & (low % 2 == 1))
    total = F.floor(x).cast("long") * 1000 + low + up.cast("long")
    return F.concat(F.floor(total / 1000).cast("string"), F.lit("."), F.lpad((total % 1000).cast("string"), 3, "0"))


def anomaly_cell() -> Column:
    """The anomaly as printed, with its mean power where that is the fault."""
    shown = F.concat("anomaly", F.lit("("), printed_thousandths(F.col("avg_kw")), F.lit(")"))
    return F.when(F.col("anomaly") == "ExcessiveAvgKw", shown).otherwise(F.col("anomaly"))


def anomaly_kinds(found: DataFrame) -> DataFrame:
    """``site_id, interval_start, nth, anomaly``: the kinds of ``interval_anomalies``, in the order in which they first come up."""
    keys = ["site_id", "interval_start"]
    each = found.groupBy(*keys, "anomaly").agg(F.min(F.struct("path", "row", "id", "pos")).alias("at"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
    return each.select(*keys, nth.cast("long").alias("nth"), "anomaly")


def deserted(segments: DataFrame) -> DataFrame:
    """``site_id, interval_start, deserted``: whether no session reached any segment of the interval."""
    return segments.groupBy("site_id", "interval_start").agg((F.max("members") == 0).alias("deserted"))


def lines(rows: DataFrame, keys: list[str], names: list[str], less: tuple[str, ...] = ()) -> DataFrame:
    """Columns turned into ``line, amount`` rows, in the order given by ``pos``; those in ``less`` are shown negative."""
    shown = {n: -F.col(n) if n in less else F.col(n) for n in names}
    each = F.posexplode(F.array(*(F.struct(F.lit(n).alias("line"), x.alias("amount")) for n, x in shown.items()))).alias("pos", "l")
    return rows.select(*keys, each).select(*keys, F.col("pos").cast("long").alias("pos"), "l.*")


def demand_lines(delivery: DataFrame) -> DataFrame:
    """The three demand charges with the demand they are levied on, its prorated figure, the rate and the charge."""
    of = {"distribution": ("kVA", "ev_kva"), "connection": ("kW", "ev_kw"), "network": ("kW 7-7", "ev_kw77")}
    each = F.array(
        *(
            F.struct(
                F.lit(n).alias("line"), F.lit(basis).alias("basis"), F.col(ev).alias("demand"),
                (F.col(ev) * F.col("days_factor")).alias("adjusted"), F.col(f"{n}_rate").alias("rate"), F.col(n).alias("charge"),
            )
            for n, (basis, ev) in of.items()
        )
    )
    return delivery.select("site_id", "period_ending", F.explode(each).alias("l")).select("site_id", "period_ending", "l.*")


def recovery_table(recovered: DataFrame) -> DataFrame:
    """Each stretch by band, and its total; a total has no rate. A period without rates has no table."""
    keys = ["site_id", "period_ending", "from_date", "to_date"]
    band = lambda tou, b: F.struct(F.lit(tou).alias("tou"), F.col(f"{b}_kwh").alias("kwh"), F.col(f"{b}_rate").alias("rate"), (F.col(f"{b}_kwh") * F.col(f"{b}_rate")).alias("recovery"))
    whole = F.struct(F.lit("Total").alias("tou"), (F.col("on_kwh") + F.col("mid_kwh") + F.col("off_kwh")).alias("kwh"), F.lit(None).cast("double").alias("rate"), F.col("recovery"))
    each = F.array(band(ON, "on"), band(MID, "mid"), band(OFF, "off"), whole)
    return recovered.where("error is null").select(*keys, F.explode(each).alias("l")).select(*keys, "l.*")


def recovery_totals(recovered: DataFrame) -> DataFrame:
    """What each stretch of a period brought in, and the period: the row without ``from_date``."""
    keys = ["site_id", "period_ending"]
    sets = [[*keys, "from_date"], keys]
    good = recovered.where("error is null")
    return good.groupingSets([[F.col(c) for c in one] for one in sets], *sets[0]).agg(F.sum("recovery").alias("recovery"))

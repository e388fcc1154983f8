"""Interval-meter feed: series to readings, gaps, billing periods, demand peaks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ampledger.config import MAX_GAP_HOURS, METER_S, OFF
from ampledger.functions.calendar import all_holidays, band, day_off
from ampledger.functions.timeexpr import local, on_grid, period_end, period_ending, period_start

UOM = {"kwh": 72, "kw": 38, "kva": 61}
SCALE = 10**6  # readings are whole millionths of a kWh, kW or kVA: the unit of a power of ten of -3
FLAGS = ("MissingKwh", "MissingKw", "MissingKva", "MissingInterval", "DuplicateInterval", "MisalignedInterval", "ImplausibleGap")


def scaled(series: DataFrame) -> DataFrame:
    """``series`` with every value in the unit of readings, by its ``power_of_ten``: 10^(3 - p) of the feed's units make a kWh.

    Values stay whole; powers below -3 are rounded to a millionth of a kWh. A null power counts as -3.
    """
    shift = F.coalesce(F.col("power_of_ten"), F.lit(-3)) + 3
    wide = F.col("value").cast("decimal(38,0)")
    up = wide * F.pow(F.lit(10.0), F.greatest(shift, F.lit(0))).cast("decimal(19,0)")
    down = F.round(F.col("value") / F.pow(F.lit(10.0), -F.least(shift, F.lit(0))))
    return series.withColumn("value", F.when(shift >= 0, up.cast("long")).otherwise(down.cast("long"))).drop("power_of_ten")


def _packed() -> Column:
    return F.col("doc_order").cast("decimal(19,0)") * F.lit(10**15).cast("decimal(16,0)") + F.col("value").cast("decimal(19,0)")


def readings(series: DataFrame) -> DataFrame:
    """``meter_id, ts, kwh, kw, kva, repeated``: the series side by side; of a repeated hour the last in document order.

    Values are taken by their ``power_of_ten`` where there is one, else as millionths. Readings
    at one place in the order go by value. Where ``doc_order`` is a number both are packed into one, so that the
    aggregate stays a hash aggregate; it may be a struct, as feeds have it.
    """
    series = scaled(series) if "power_of_ten" in series.columns else series
    if isinstance(series.schema["doc_order"].dataType, StructType):
        place = F.struct("doc_order", "value")
    else:
        place = _packed()
    picked = []
    for name, uom in UOM.items():
        here = F.col("uom") == uom
        picked += [
            F.max_by(F.when(here, F.col("value")), F.when(here, place)).alias(name),
            F.count_if(here).alias(f"n_{name}"),
        ]
    wide = series.groupBy("meter_id", "ts").agg(*picked)
    return wide.select("meter_id", "ts", *UOM, (F.greatest(*(f"n_{c}" for c in UOM)) > 1).alias("repeated"))


def _before(wide: DataFrame, slice_hours: int | None) -> DataFrame:
    """``wide`` with ``before``, the meter's reading before each.

    With ``slice_hours`` a meter's hours are dealt to tasks in slices of that length, and the last reading of
    each slice is carried over to the meter's next one, by a pass over one row a slice.
    """
    if slice_hours is None:
        return wide.withColumn("before", F.lag("ts").over(Window.partitionBy("meter_id").orderBy("ts")))
    keys = ["meter_id", "slice"]
    sliced = wide.withColumn("slice", F.floor(F.unix_seconds("ts") / (slice_hours * METER_S)))
    lasts = sliced.groupBy(*keys).agg(F.max("ts").alias("last"))
    upto = F.lag("last").over(Window.partitionBy("meter_id").orderBy("slice"))
    carried = lasts.select(F.col("meter_id").alias("_meter"), F.col("slice").alias("_slice"), upto.alias("_carried"))
    met = sliced.join(carried, F.col("meter_id").eqNullSafe(F.col("_meter")) & (F.col("slice") == F.col("_slice")))
    own = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    return met.withColumn("before", F.coalesce(own, "_carried")).select(*wide.columns, "before")


def fill_gaps(wide: DataFrame, slice_hours: int | None = None) -> DataFrame:
    """Readings with placeholders for missing hours, and ``anomalies`` of each hour in their fixed order.

    Hours are counted from the observed reading before a gap. A gap of more than
    MAX_GAP_HOURS is flagged on the reading after it and not filled. A reading and the
    placeholders before it come out of one row, so the pivot and its window run once. A meter is one task's,
    or with ``slice_hours`` that of one task for each stretch of so many hours; the result is the same.
    """
    gap_s = F.unix_seconds("ts") - F.unix_seconds("before")
    gap = F.floor(gap_s / METER_S)
    flags = F.array(
        F.when(F.col("kwh").isNull(), "MissingKwh"),
        F.when(F.col("kw").isNull(), "MissingKw"),
        F.when(F.col("kva").isNull(), "MissingKva"),
        F.when(F.col("repeated"), "DuplicateInterval"),
        F.when(~on_grid("ts", METER_S), "MisalignedInterval"),
        F.when(gap > MAX_GAP_HOURS, "ImplausibleGap"),
    )
    hour = F.expr("interval 1 hour")
    steps = F.sequence(F.col("before") + hour, F.col("ts") - F.expr("interval 1 second"), hour)
    missing = F.when((gap <= MAX_GAP_HOURS) & (gap_s > METER_S), steps).otherwise(F.array().cast("array<timestamp>"))
    none = [F.lit(None).cast("long").alias(c) for c in UOM]
    seen = F.struct("ts", *UOM, F.filter(flags, lambda f: f.isNotNull()).alias("anomalies"))
    holes = F.transform(missing, lambda t: F.struct(t.alias("ts"), *none, F.array(F.lit("MissingInterval")).alias("anomalies")))
    return _before(wide, slice_hours).select("meter_id", F.inline(F.concat(F.array(seen), holes)))


def with_band(rows: DataFrame) -> DataFrame:
    """``tou`` of the hour, null off the hour."""
    at = local("ts")
    rows = rows.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))
    off = day_off(rows, all_holidays(rows.sparkSession))
    return off.withColumn("tou", F.when(on_grid("ts", METER_S), band("date", "hour", "off")))


def _peak(name: str, value: str, companion: str, ok: Column) -> list[Column]:
    """First greatest value with hour, companion and band, as hash aggregates: the order key is one number, not a struct."""
    use = ok & F.col(value).isNotNull()
    order = F.when(use, F.col(value).cast("decimal(20,0)") * F.lit(10**11).cast("decimal(12,0)") - F.unix_seconds("ts").cast("decimal(12,0)"))
    return [
        F.max(F.when(use, F.col(value))).alias(name),
        F.max_by("ts", order).cast("timestamp_ntz").alias(f"{name}_at"),
        F.max_by(companion, order).alias(f"{name}_{companion}"),
        F.max_by("tou", order).alias(f"{name}_tou"),
    ]


def _peak_figures() -> list[Column]:
    whole, day_time = F.col("tou").isNotNull(), F.col("tou") != OFF
    return [
        *_peak("max_kw", "kw", "kva", whole),
        *_peak("max_kw_nop", "kw", "kva", day_time),
        *_peak("max_kva", "kva", "kw", whole),
        *_peak("max_kva_nop", "kva", "kw", day_time),
    ]


def _sums() -> list[Column]:
    some = F.col("kwh").isNotNull() | F.col("kw").isNotNull() | F.col("kva").isNotNull()
    return [
        F.count_if(some).alias("n_hours"),
        F.count_if(some & on_grid("ts", METER_S)).alias("n_aligned"),
        F.sum("kwh").alias("kwh_raw"),
        *(F.count_if(F.array_contains("anomalies", f)).alias(f"n_{f}") for f in FLAGS),
    ]


def _rolled(sums: DataFrame, *more: str) -> DataFrame:
    expected = (24 * F.datediff("period_ending", F.add_months("period_ending", -1))).cast("long")
    return sums.select(
        "meter_id", "period_ending", "n_hours", expected.alias("expected_hours"),
        (F.col("n_hours") == expected).alias("complete"),
        ((F.col("n_aligned") == expected) & (F.col("n_MissingInterval") == 0)).alias("complete_strict"),
        F.round(F.col("kwh_raw") / SCALE, 6).alias("kwh"), *(f"n_{f}" for f in FLAGS), *more,
    )


_PEAKS = [
    f"{p}{s}"
    for p, c in (("max_kw", "kva"), ("max_kw_nop", "kva"), ("max_kva", "kw"), ("max_kva_nop", "kw"))
    for s in ("", "_at", f"_{c}", "_tou")
]


def period_peaks(filled: DataFrame, day: int = 23) -> DataFrame:
    """Four demand maxima of each meter and billing period: kW and kVA, over all hours and outside off-peak.

    Only hours on the grid count; of equal values the earliest; the companion may be null.
    """
    rows = with_band(filled.where(F.col("kw").isNotNull() | F.col("kva").isNotNull()))
    return rows.groupBy("meter_id", period_ending("ts", day).alias("period_ending")).agg(*_peak_figures())


def period_rollup(filled: DataFrame, day: int = 23) -> DataFrame:
    """Hours with a value, kWh and flagged hours of each meter and period, and whether all its hours are there.

    ``complete`` counts hours as the bills do; ``complete_strict`` wants every hour on the grid
    and none missing.
    """
    return _rolled(filled.groupBy("meter_id", period_ending("ts", day).alias("period_ending")).agg(*_sums()))


def period_figures(filled: DataFrame, day: int = 23) -> DataFrame:
    """``period_rollup`` and ``period_peaks`` side by side, in one aggregate."""
    sums = with_band(filled).groupBy("meter_id", period_ending("ts", day).alias("period_ending")).agg(*_sums(), *_peak_figures())
    return _rolled(sums, *_PEAKS)


def anomaly_counts() -> Column:
    """``MissingKw(2),MissingInterval(3)``: the kinds that occur, in their fixed order; empty if none does."""
    return F.concat_ws(",", *(F.when(F.col(f"n_{f}") > 0, F.concat(F.lit(f"{f}("), F.col(f"n_{f}").cast("string"), F.lit(")"))) for f in FLAGS))


def peak_table(figures: DataFrame) -> DataFrame:
    """From ``period_figures`` one row a period, newest first: hours, kWh and the four maxima with their hour on both clocks."""
    groups = []
    for name, other in (("max_kw", "kva"), ("max_kw_nop", "kva"), ("max_kva", "kw"), ("max_kva_nop", "kw")):
        groups += [
            (F.col(name) / SCALE).alias(name), local(f"{name}_at").alias(f"{name}_interval"), F.col(f"{name}_at").alias(f"{name}_interval_utc"),
            (F.col(f"{name}_{other}") / SCALE).alias(f"{name}_{other}"), F.col(f"{name}_tou"),
        ]
    shown = figures.select(
        "meter_id", F.col("period_ending").alias("billing_period_ending"), F.col("n_hours").alias("nbr_of_intervals"), "kwh", *groups,
        anomaly_counts().alias("anomalies"),
    )
    return shown.orderBy(F.desc("billing_period_ending"), "meter_id")


def period_values(wide: DataFrame, ending: dt.date, day: int = 23) -> DataFrame:
    """Roll-up and demand maxima of every meter for the one period that closes on ``ending``.

    Raises where the closing date is not on the closing day, or where no meter has an hour in
    the period, naming the dates that the feed covers. A meter without one has no row. Of the
    readings outside of the period only the last before and the first after it are looked at.
    """
    if not 1 <= day <= 27 or ending.day != day:
        raise ValueError(f"{ending} cannot close a period that closes on day {day} of the month")
    start, end = period_start(F.lit(ending), day), period_end(F.lit(ending))
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    beside = wide.groupBy("meter_id").agg(
        F.max(F.when(F.col("ts") < start, F.col("ts"))).alias("a"), F.min(F.when(F.col("ts") >= end, F.col("ts"))).alias("z")
    )
    none = [F.lit(None).cast("long").alias(c) for c in UOM]
    ends = beside.select("meter_id", F.explode(F.array("a", "z")).alias("ts"), *none, F.lit(False).alias("repeated")).where("ts is not null")
    filled = fill_gaps(wide.where(inside).select("meter_id", "ts", *UOM, "repeated").unionByName(ends)).where(inside)
    if wide.where(inside).isEmpty() and filled.isEmpty():
        first, last = wide.agg(F.to_date(local(F.min("ts"))), F.to_date(local(F.max("ts")))).first()
        held = f"the feed covers {first} to {last}" if first else "the feed has no readings"
        raise ValueError(f"no readings in the period ending {ending}; {held}")
    return period_figures(filled, day)


def boundary_fit(swept: DataFrame, printed: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Of each boundary rule of ``boundary_sweep``: how many of the bills' energies it reproduces, and how far it is off.

    ``rule, n_periods, n_matches, mean_abs_error, worst`` in kWh, from ``printed(meter_id,
    period_ending, kwh)``; periods on one side only are left out.
    """
    both = swept.select("rule", "meter_id", "period_ending", (F.col("kwh_raw") / SCALE).alias("measured")).join(printed, ["meter_id", "period_ending"])
    off = F.abs(F.col("measured") - F.col("kwh"))
    return both.groupBy("rule").agg(
        F.count("*").alias("n_periods"), F.count_if(off <= tolerance).alias("n_matches"), F.avg(off).alias("mean_abs_error"), F.max(off).alias("worst")
    )


def boundary_sweep(wide: DataFrame) -> DataFrame:
    """kWh of each meter and period when periods are cut at UTC-5, at prevailing local midnight and at UTC-4."""
    shifted = lambda h: F.to_date(F.timestamp_seconds(F.unix_seconds("ts") - h * 3600))
    rules = {"est": shifted(5), "prevailing": F.to_date(local("ts")), "edt": shifted(4)}
    keyed = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), d.alias("day")) for r, d in rules.items())))
    rows = wide.select("meter_id", "kwh", keyed.alias("k")).select("meter_id", "kwh", "k.*")
    month = F.when(F.dayofmonth("day") > 23, F.add_months("day", 1)).otherwise(F.col("day"))
    ending = F.make_date(F.year(month), F.month(month), F.lit(23))
    out = rows.groupBy("rule", "meter_id", ending.alias("period_ending")).agg(F.sum("kwh").alias("kwh_raw"))
    fixed = F.max(F.when(F.col("rule") == "est", F.col("kwh_raw"))).over(Window.partitionBy("meter_id", "period_ending"))
    return out.select("rule", "meter_id", "period_ending", "kwh_raw", (F.col("kwh_raw") - fixed).alias("off_by"))

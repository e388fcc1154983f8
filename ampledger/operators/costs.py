"""What charging cost, what it was billed at, and the difference, for all sites and periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, MID, OFF, ON
from ampledger.operators.coverage import gated
from ampledger.operators.estimate import best_segments, estimates, segment_aggregates

KEYS = ["site_id", "period_ending"]
BILLED_DAYS = 30.0
BANDS = {"on": ON, "mid": MID, "off": OFF}


def _share(charges: Column, line: str) -> Column:
    return F.try_divide(charges * F.col(line), F.col("total_electricity_charges"))


def _zero(*names: str) -> Column:
    """``ZeroDenominator(name)`` of the first figure that is zero or missing."""
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.coalesce(F.col(n), F.lit(0.0)) == 0, f"ZeroDenominator({n})").otherwise(out)
    return out


def _off_cycle(day: int) -> Column:
    """The date closes no billing period."""
    return F.dayofmonth("period_ending") != day


def energy_cost(energy: DataFrame, bills: DataFrame, day: int = DEFAULT.bill_end_day) -> DataFrame:
    """Band energy at the bill's own rates, after the loss factor, with tax and rebate in proportion.

    ``error`` names a zero figure of the bill, or NotABillingPeriodEnding, NoBill or NoEnergy, or
    what ``energy`` carries; costs are then null.
    """
    energy = gated(energy, None, []).withColumnRenamed("error", "refused")
    rows = bills.withColumn("billed", F.lit(True)).join(energy.withColumn("used", F.lit(True)), KEYS, "full")
    part = {b: F.col(f"{b}_kwh") * F.col("loss_factor_adjustment") * F.try_divide(f"{b}_peak_cost", f"{b}_peak_kwh") for b in BANDS}
    error = F.when(_off_cycle(day), "NotABillingPeriodEnding").otherwise(F.col("refused"))
    error = F.coalesce(error, F.when(F.col("billed").isNull(), "NoBill").when(F.col("used").isNull(), "NoEnergy"))
    rows = rows.withColumn("error", F.coalesce(error, _zero(*(f"{b}_peak_kwh" for b in BANDS), "total_electricity_charges")))
    ok = F.col("error").isNull()
    rows = rows.withColumns({f"{b}_cost": F.when(ok, p) for b, p in part.items()})
    charges = F.col("on_cost") + F.col("mid_cost") + F.col("off_cost")
    rows = rows.withColumns({"charges": charges, "tax": _share(charges, "hst"), "rebate": _share(charges, "ontario_electricity_rebate")})
    return rows.select(*KEYS, *(f"{b}_cost" for b in BANDS), "charges", "tax", "rebate", (F.col("charges") + F.col("tax") - F.col("rebate")).alias("net"), "error")


def peak_hours(figures: DataFrame) -> DataFrame:
    """``site_id, period_ending, basis, interval_start, error`` of the three billed maxima of ``period_figures``, in seconds.

    A period that lacks hours has no maximum to go by: PeriodNotFullyCovered. NoPeak names a series without a reading.
    """
    at = {"kva": "max_kva_at", "kw": "max_kw_at", "kw77": "max_kw_nop_at"}
    each = F.array(*(F.struct(F.lit(b).alias("basis"), F.unix_seconds(F.col(c).cast("timestamp")).alias("interval_start")) for b, c in at.items()))
    rows = figures.select(F.col("meter_id").alias("site_id"), "period_ending", "complete", F.explode(each).alias("p")).select(*KEYS, "complete", "p.*")
    error = F.when(~F.col("complete"), "PeriodNotFullyCovered").when(F.col("interval_start").isNull(), F.concat(F.lit("NoPeak("), "basis", F.lit(")")))
    return rows.select(*KEYS, "basis", F.when(F.col("complete"), F.col("interval_start")).alias("interval_start"), error.alias("error"))


def peak_power(figures: DataFrame, sessions: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """For each billed maximum of ``period_figures`` the load estimates of the hour it was measured in.

    An hour that several maxima share is estimated once; null estimates come with ``error``. Periods that the
    session reports do not cover, by ``coverage_errors``, are refused: what charged in such an hour is not known.
    """
    hours = gated(peak_hours(figures), coverage, ["interval_start"])
    asked = hours.where("interval_start is not null").select("site_id", "interval_start", F.lit(3600).alias("interval_s")).distinct()
    best = best_segments(estimates(segment_aggregates(asked, sessions)), digits=None)
    best = best.withColumn("interval_start", F.unix_seconds(F.col("interval_start").cast("timestamp")))
    return hours.join(best, ["site_id", "interval_start"], "left")


def delivery_cost(power: DataFrame, bills: DataFrame, day: int = DEFAULT.bill_end_day, coverage: DataFrame | None = None) -> DataFrame:
    """The three demand lines, each at the middle of its own hour's energy-based bracket, prorated to thirty days.

    ``error``: NotABillingPeriodEnding for a bill off the cycle, UndatedReport or ReportsDoNotCover by
    ``coverage`` (of ``coverage_errors``, for the periods of both sides), NoBill, NotMetered,
    PeriodNotFullyCovered, NoPeak of a basis, or ZeroDenominator of a figure; charges are then null.
    """

    def mid(basis: str, unit: str) -> Column:
        return F.max(F.when(F.col("basis") == basis, (F.col(f"energy_{unit}_min") + F.col(f"energy_{unit}_max")) / 2))

    demand = power.groupBy(*KEYS).agg(
        mid("kva", "kva").alias("ev_kva"), mid("kw", "kw").alias("ev_kw"), mid("kw77", "kw").alias("ev_kw77"),
        F.max(F.when(~F.col("error").startswith("NoPeak"), F.col("error"))).alias("refused"),
    )
    rows = bills.withColumn("billed", F.lit(True)).join(demand.withColumn("metered", F.lit(True)), KEYS, "full")
    none = F.coalesce(*(F.when(F.col(f"ev_{b}").isNull(), f"NoPeak({b})") for b in ("kva", "kw", "kw77")))
    rows = gated(rows, coverage, [])
    error = F.when(_off_cycle(day), "NotABillingPeriodEnding").otherwise(F.col("error"))
    error = F.coalesce(error, F.when(F.col("billed").isNull(), "NoBill").when(F.col("metered").isNull(), "NotMetered"))
    error = F.coalesce(error, F.col("refused"), none, _zero("adj_kva", "adj_kw", "adj_peak_7_7_kw", "total_electricity_charges"))
    rows = rows.withColumn("error", error)
    lines = {
        "distribution": ("distribution_charges", "adj_kva", "ev_kva"),
        "connection": ("transmission_connection_charge", "adj_kw", "ev_kw"),
        "network": ("transmission_network_charge", "adj_peak_7_7_kw", "ev_kw77"),
    }
    ok = F.col("error").isNull()
    rows = rows.withColumn("days_factor", F.col("number_of_days") / BILLED_DAYS)
    rows = rows.withColumns({f"{n}_rate": F.when(ok, F.try_divide(line, adj)) for n, (line, adj, _) in lines.items()})
    rows = rows.withColumns({n: F.col(f"{n}_rate") * F.col(ev) * F.col("days_factor") for n, (_, _, ev) in lines.items()})
    charges = F.col("distribution") + F.col("connection") + F.col("network")
    rows = rows.withColumns({"charges": charges, "tax": _share(charges, "hst"), "rebate": _share(charges, "ontario_electricity_rebate")})
    return rows.select(
        *KEYS, "ev_kva", "ev_kw", "ev_kw77", "days_factor", *(f"{n}_rate" for n in lines), *lines, "charges", "tax", "rebate",
        (F.col("charges") + F.col("tax") - F.col("rebate")).alias("net"), "error",
    )


def rate_stretches(periods: DataFrame, rates: DataFrame) -> DataFrame:
    """Each period cut where its site's rates change: ``from_date, to_date, on_rate, mid_rate, off_rate, error``.

    A rate holds from its effective date to the next one's eve. A period that begins before
    any rate is one row with error RatesNotYetInEffect. Of rates effective on one day the
    greatest on-peak, then mid-peak, then off-peak rate holds.
    """
    names = [f"{b}_rate" for b in BANDS]
    one = rates.groupBy("site_id", "effective_date").agg(F.max(F.struct(*names)).alias("r")).select("site_id", "effective_date", "r.*")
    until = F.lead("effective_date").over(Window.partitionBy("site_id").orderBy("effective_date"))
    held = one.withColumn("until", until)
    begins = F.date_add(F.add_months("period_ending", -1), 1)
    spans = periods.select(*KEYS).distinct().withColumn("begins", begins)
    meets = (F.col("effective_date") <= F.col("period_ending")) & (F.col("until").isNull() | (F.col("until") > F.col("begins")))
    rows = spans.join(held, "site_id", "left").where(F.col("effective_date").isNull() | meets)
    cut = rows.select(
        *KEYS, "begins", F.greatest("begins", "effective_date").alias("from_date"),
        F.least("period_ending", F.date_sub("until", 1)).alias("to_date"), *names, "effective_date",
    )
    opening = cut.groupBy(*KEYS).agg(F.min("from_date").alias("first"), F.min("effective_date").alias("e"))
    late = spans.join(opening, KEYS, "left").where("e is null or e > begins").select(*KEYS)
    good = cut.join(late, KEYS, "left_anti").select(*KEYS, "from_date", "to_date", *names, F.lit(None).cast("string").alias("error"))
    bad = late.select(*KEYS, *(F.lit(None).cast("date").alias(c) for c in ("from_date", "to_date")), *(F.lit(None).cast("double").alias(n) for n in names), F.lit("RatesNotYetInEffect").alias("error"))
    return good.unionByName(bad)


def cost_recovery(daily: DataFrame, stretches: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Energy of each stretch at its rates, from ``daily(site_id, period_ending, date, on_kwh, mid_kwh, off_kwh)``.

    Periods that the session reports do not cover, by ``coverage_errors``, are refused. A row with
    ``error`` has no figures. A period may end an hour into the local day after its closing date; that hour belongs to
    the last stretch.
    """
    use = F.least("date", "period_ending")
    by_day = daily.withColumn("use", use).groupBy(*KEYS, "use").agg(*(F.sum(f"{b}_kwh").alias(f"{b}_kwh") for b in BANDS))
    inside = F.col("use").between(F.col("from_date"), F.col("to_date"))
    met = stretches.alias("s").join(by_day.alias("d"), KEYS, "left")
    zero = lambda b: F.sum(F.when(inside, F.col(f"{b}_kwh")).otherwise(0.0)).alias(f"{b}_kwh")
    sums = met.groupBy(*KEYS, "from_date", "to_date", *(f"{b}_rate" for b in BANDS), "error").agg(*(zero(b) for b in BANDS))
    total = sum((F.col(f"{b}_kwh") * F.col(f"{b}_rate") for b in BANDS), F.lit(0.0))
    rows = gated(sums.withColumn("recovery", total), coverage, ["recovery"])
    ok = F.col("error").isNull()
    return rows.withColumns({c: F.when(ok, F.col(c)) for c in (*(f"{b}_kwh" for b in BANDS), "recovery")})


def to_the_cent(x: Column) -> Column:
    """The amount as printed to the cent: its exact binary value rounded, a half to even.

    ``x * 100`` may round onto a half that the exact product only comes near, so the product's
    rounding error, found by splitting x into halves that multiply exactly, breaks such a tie.
    """
    t = x * 134217729.0  # 2**27 + 1
    high = t - (t - x)
    product = x * 100.0
    error = (high * 100.0 - product) + (x - high) * 100.0
    near = F.rint(product)
    off = product - near
    return F.when((F.abs(off) == 0.5) & (error * off > 0), near + off * 2).otherwise(near) / 100.0


def surplus(recovered: DataFrame, delivery: DataFrame, energy: DataFrame) -> DataFrame:
    """Recovery less delivery and energy cost, each as printed, with a verdict and the error of each part.

    A period that a part lacks is named there: NoRecovery, NoDelivery or NoEnergyCost.
    """
    r = recovered.groupBy(*KEYS).agg(F.sum("recovery").alias("r"), F.coalesce(F.max("error"), F.lit("")).alias("r_error"))
    d = delivery.select(*KEYS, F.col("net").alias("d"), F.coalesce("error", F.lit("")).alias("d_error"))
    e = energy.select(*KEYS, F.col("net").alias("e"), F.coalesce("error", F.lit("")).alias("e_error"))
    rows = r.join(d, KEYS, "full").join(e, KEYS, "full")
    lacks = {"recovery": ("r", "NoRecovery"), "delivery": ("d", "NoDelivery"), "energy": ("e", "NoEnergyCost")}
    errors = [F.nullif(F.coalesce(f"{c}_error", F.lit(none)), F.lit("")).alias(f"{n}_error") for n, (c, none) in lacks.items()]
    cents = rows.select(*KEYS, *(to_the_cent(F.col(c)).alias(n) for n, (c, _) in lacks.items()), *errors)
    left = to_the_cent(F.col("recovery") - F.col("delivery") - F.col("energy"))
    x = F.col("surplus")
    verdict = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "unknown").when(x < 0, "short").otherwise("covered")
    return cents.withColumn("surplus", left).withColumn("verdict", verdict)

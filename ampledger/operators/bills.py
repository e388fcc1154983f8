"""Utility bills: reading charge lines, adding them up, checking a bill against itself and the meter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.functions.timeexpr import col

#: Wording of the bill. A charge with ``later`` has its amount on the rate line after it.
BANDS = {"On-peak": "on_peak", "Mid-peak": "mid_peak", "Off-peak": "off_peak"}
DIRECT = {"Customer Charges": "delivery_customer_charges", "Distribution Charges": "distribution_charges"}
LATER = {
    "Transmission Connection Charge": "transmission_connection_charge",
    "Transmission Network Charge": "transmission_network_charge",
    "Standard Supply Service Administrative Charge": "standard_supply_admin_charge",
    "Wholesale Market Service Charge": "wholesale_market_svc_charge",
}
HEADINGS = ("Electricity", "Delivery", "Regulatory Charges")
COSTS = [f"{b}_cost" for b in BANDS.values()]
CHARGES = [*DIRECT.values(), *LATER.values()]


def money(text: Column | str) -> Column:
    """``$1,761.07`` as a number; null if it is none."""
    return F.regexp_replace(F.trim(col(text)), "[$,]", "").try_cast("double")


def bill_date(text: Column | str) -> Column:
    """``JUN 23 2026`` as a date; null if it is none."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.lower(F.trim(col(text)))), F.lit("MMM d yyyy")))


def reading_period(text: Column | str) -> tuple[Column, Column]:
    """Both dates of ``MAY 23 2026 TO JUN 23 2026``."""
    parts = F.split(F.upper(col(text)), r"\s+TO\s+")
    return bill_date(F.get(parts, F.lit(0))), bill_date(F.get(parts, F.lit(1)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def classify(lines: DataFrame) -> DataFrame:
    """Adds ``category, kwh, value, error`` to ``lines(bill_id, line_no, label, amount)``.

    A rate line belongs to the charge named before it in its bill, once. Lines without an
    amount that name nothing are decoration: no category. ``error``: UnknownCharge,
    MissingAmount, NoChargeAbove.
    """
    text = F.trim("label")
    used = F.regexp_extract(text, r"^(.*?) kWh (On-peak|Mid-peak|Off-peak)(?: @ .*)?$", 1)
    season = F.regexp_extract(text, r"^(.*?) kWh (On-peak|Mid-peak|Off-peak)(?: @ .*)?$", 2)
    heading = _lookup(LATER, text)
    is_rate = (season == "") & text.rlike(r"(^| )at \$")
    mark = F.when(heading.isNotNull(), heading).when(is_rate, F.lit(""))
    before = Window.partitionBy("bill_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("above", F.last(mark, ignorenulls=True).over(before))
    category = (
        F.when(season != "", _lookup(BANDS, season)).when(is_rate, F.nullif("above", F.lit(""))).otherwise(_lookup(DIRECT, text))
    )
    silent = heading.isNotNull() | text.isin(*HEADINGS) | text.startswith("Time of use") | text.startswith("Electricity distributed by")
    wants = (season != "") | is_rate | _lookup(DIRECT, text).isNotNull()
    error = (
        F.when(is_rate & (F.coalesce("above", F.lit("")) == ""), "NoChargeAbove")
        .when(wants & (money("amount").isNull() | ((season != "") & money(used).isNull())), "MissingAmount")
        .when(~wants & ~silent & F.col("amount").isNotNull(), "UnknownCharge")
    )
    return rows.withColumns(
        {"category": category, "kwh": F.when(season != "", money(used)), "value": F.when(wants, money("amount")), "error": error}
    ).drop("above")


def roll_up(classified: DataFrame) -> DataFrame:
    """One row a bill: every charge and band with its repeats added together, and the number of faulty lines."""
    of = lambda c, v: F.round(F.sum(F.when(F.col("category") == c, F.col(v)).otherwise(0.0)), 6)
    return classified.groupBy("bill_id").agg(
        *(of(b, "kwh").alias(f"{b}_kwh") for b in BANDS.values()),
        *(of(b, "value").alias(f"{b}_cost") for b in BANDS.values()),
        *(of(c, "value").alias(c) for c in CHARGES),
        F.count("error").alias("n_errors"),
    )


def bill_total() -> Column:
    return F.col("total_electricity_charges") + F.col("hst") - F.col("ontario_electricity_rebate")


def checks(bills: DataFrame) -> DataFrame:
    """Adds ``failed``: the names of the rules that a bill's own figures break; a null figure breaks its rules."""
    c = F.col
    near = lambda a, b, eps: F.abs(a - b) <= eps
    whole = sum((c(n) for n in (*COSTS, *CHARGES)), F.lit(0.0))
    days = c("number_of_days")
    rules = {
        "lines": near(whole, c("total_electricity_charges"), 0.01),
        "bands": near(c("on_peak_kwh") + c("mid_peak_kwh") + c("off_peak_kwh"), c("adjusted_kwh_used"), 0.002),
        "loss": near(c("kwh_used") * c("loss_factor_adjustment"), c("adjusted_kwh_used"), 0.002),
        "dates": F.datediff("meter_reading_period_to", "meter_reading_period_from") == days,
        "statement": c("statement_date") >= c("meter_reading_period_to"),
        "month": days.between(28, 31),
        "kva": c("demand_kva") >= c("demand_kw"),
        "window": c("peak_7_7_kw") <= c("demand_kw"),
    }
    for raw, adj in (("peak_7_7_kw", "adj_peak_7_7_kw"), ("demand_kw", "adj_kw"), ("demand_kva", "adj_kva")):
        rules[adj] = near(c(raw) * days / 30.0, c(adj), 0.0025)
    positive = ("peak_7_7_kw", "adj_peak_7_7_kw", "demand_kw", "demand_kva", "metering_adj", "adj_kw", "adj_kva", "hst", "ontario_electricity_rebate")
    rules["positive"] = F.least(*(F.coalesce(c(n), F.lit(0.0)) for n in positive)) > 0
    named = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in rules.items()))
    return bills.withColumn("failed", F.filter(named, lambda x: x.isNotNull()))


def agrees_truncated(measured: Column, printed: Column) -> Column:
    """The printed figure is the measured one cut to three decimals."""
    return (measured - printed >= -1e-9) & (measured - printed < 0.001)

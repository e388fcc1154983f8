"""Whole bills and invoices from their text: landmarks, tables and key-value lines to one typed row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.operators.bills import CHARGES, bill_date, classify, money, reading_period, roll_up

#: Wording of the bill, and the order of its two usage tables.
CHARGES_BEGIN, CHARGES_END = "Your Electricity Charges", "Your Total Electricity Charges"
STATEMENT, REBATE, TAX_PREFIX, DEMAND_HEADING = "Statement Date", "Ontario Electricity Rebate", "H.S.T.", "Peak kW"
METER_ROW = (None, "period", "number_of_days", None, "kwh_used", "loss_factor_adjustment", "adjusted_kwh_used")
DEMAND_ROW = ("peak_7_7_kw", "adj_peak_7_7_kw", "demand_kw", "demand_kva", "metering_adj", "adj_kw", "adj_kva")
#: Keys of an invoice's figures, and their types.
INVOICE = {
    "period_ending": "date", "days": "int", "loss_factor": "double", "kwh_used": "double", "demand_kw": "double", "peak_kw_7_7": "double",
    "demand_kva": "double", "adjusted_kwh_used": "double", "tou_on_peak_kwh": "double", "tou_mid_peak_kwh": "double", "tou_off_peak_kwh": "double",
}


def _beside(matches) -> Column:
    """The fragment right of the first one that ``matches``; null without one."""
    at = F.array_position(F.transform("f", matches), True)
    return F.when(at > 0, F.get("f", at.cast("int")))


def _first(value: Column) -> Column:
    """The first line's value that is not null."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _named(named: Column, error: str) -> Column:
    return F.when(named, F.lit(error))


def read_bills(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bills, refused)`` from ``lines(bill_id, line_no, fragments)``, the texts of each printed line from left to right.

    ``bills`` has a row for every bill that reads whole: ``bill_id``, the period, and all figures that
    ``costs`` and ``checks`` ask for. ``refused(bill_id, error)`` has all others, with the first of: Missing of
    a landmark, table or amount; Shape of a table or an order that is another; Malformed of a figure that is no number
    or date; UnknownCharge, MissingAmount or NoChargeAbove of a charge line. The rebate counts as a positive
    amount, though a bill prints it as a credit. Of a landmark that comes up twice the first counts.
    """
    rows = lines.select("bill_id", "line_no", F.transform("fragments", lambda x: F.trim(F.coalesce(x, F.lit("")))).alias("f"))
    begin, _ = reading_period(F.get(F.filter("f", _is_period), F.lit(0)))
    is_demand = (F.size("f") == len(DEMAND_ROW)) & F.forall("f", lambda x: money(x).isNotNull())
    here = lambda text: F.min(F.when(F.array_contains("f", text), F.col("line_no")))
    label = F.get("f", F.lit(0))
    marks = rows.groupBy("bill_id").agg(
        _first(_beside(lambda x: x == STATEMENT)).alias("statement"),
        _first(_beside(lambda x: x == REBATE)).alias("rebate"),
        _first(_beside(lambda x: x.startswith(TAX_PREFIX))).alias("tax"),
        _first(F.when(begin.isNotNull(), F.col("f"))).alias("meter"),
        F.min(F.when(label == CHARGES_BEGIN, F.col("line_no"))).alias("from_line"),
        F.min(F.when(label == CHARGES_END, F.col("line_no"))).alias("to_line"),
        _first(F.when((label == CHARGES_END) & (F.size("f") > 1), F.element_at("f", -1))).alias("whole"),
        here(DEMAND_HEADING).alias("heading"),
        F.array_sort(F.collect_list(F.when(is_demand, F.struct("line_no", "f")))).alias("sevens"),  # of one bill
    )
    demand = F.get(F.filter("sevens", lambda s: s["line_no"] >= F.col("heading")), F.lit(0))["f"]
    marks = marks.withColumn("demand", demand).drop("sevens")
    inside = rows.join(marks.select("bill_id", "from_line", "to_line"), "bill_id").where("line_no > from_line and line_no < to_line and size(f) > 0")
    charges = classify(inside.select("bill_id", "line_no", label.alias("label"), F.when(F.size("f") > 1, F.element_at("f", -1)).alias("amount")))
    faults = charges.groupBy("bill_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("fault"))
    summed = roll_up(charges).drop("n_errors").join(faults, "bill_id")
    from_date, to_date = reading_period(F.get(F.filter("meter", _is_period), F.lit(0)))
    of_meter = lambda name: F.get("meter", F.lit(METER_ROW.index(name)))
    figures = {
        "statement_date": bill_date("statement"), "ontario_electricity_rebate": F.abs(money("rebate")), "hst": money("tax"),
        "total_electricity_charges": money("whole"), "number_of_days": of_meter("number_of_days").try_cast("long"),
        **{n: money(of_meter(n)) for n in METER_ROW[4:]}, **{n: money(F.get("demand", F.lit(k))) for k, n in enumerate(DEMAND_ROW)},
        "meter_reading_period_from": from_date, "meter_reading_period_to": to_date,
    }
    read = marks.withColumns(figures).join(summed, "bill_id", "left")
    missing = {
        "from_line": CHARGES_BEGIN, "to_line": CHARGES_END, "whole": f"amount of {CHARGES_END}", "statement": STATEMENT, "tax": TAX_PREFIX, "rebate": REBATE,
        "meter": "meter reading period", "heading": DEMAND_HEADING, "demand": "row of demand figures",
    }
    error = F.coalesce(
        *(_named(F.col(c).isNull(), f"Missing({what})") for c, what in missing.items()),
        _named(F.col("to_line") <= F.col("from_line"), "Shape(the total comes before the charges)"),
        _named(F.size("meter") != len(METER_ROW), "Shape(meter reading row)"),
        *(_named(F.col(n).isNull(), f"Malformed({n})") for n in figures),
        F.col("fault"),
    )
    none = {c: F.coalesce(c, F.lit(0.0)) for c in (*CHARGES, *(f"{b}_peak_{x}" for b in ("on", "mid", "off") for x in ("kwh", "cost")))}
    done = read.withColumns(none).withColumn("error", error).drop("statement", "rebate", "tax", "meter", "from_line", "to_line", "whole", "heading", "demand", "fault")
    bills = done.where("error is null").drop("error").withColumn("period_ending", F.col("meter_reading_period_to"))
    return bills, done.where("error is not null").select("bill_id", "error")


def _is_period(text: Column) -> Column:
    begin, end = reading_period(text)
    return text.contains(" TO ") & begin.isNotNull() & end.isNotNull()


def key_values(lines: DataFrame) -> DataFrame:
    """``doc_id, key, value`` of ``lines(doc_id, line_no, text)``: ``key value`` lines; blank lines and ``#`` comments say nothing.

    Of a key that comes up twice the last line counts.
    """
    text = F.trim("text")
    said = lines.where((text != "") & ~text.startswith("#")).withColumn("t", F.regexp_replace(text, r"\s+", " "))
    key = F.substring_index("t", " ", 1)
    rows = said.select("doc_id", "line_no", key.alias("key"), F.expr("substring(t, length(substring_index(t, ' ', 1)) + 2)").alias("value")).where("value <> ''")
    return rows.groupBy("doc_id", "key").agg(F.max_by("value", "line_no").alias("value"))


def invoices(lines: DataFrame) -> DataFrame:
    """One typed row for each invoice of ``lines(doc_id, line_no, text)``, as ``reconcile`` holds it against the meter.

    ``missing`` lists keys that are not there, or whose value is none of their type.
    """
    wide = key_values(lines).groupBy("doc_id").pivot("key", list(INVOICE)).agg(F.first("value"))
    typed = wide.select("doc_id", *(F.col(k).try_cast(kind).alias(k) for k, kind in INVOICE.items()))
    lacking = F.filter(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in INVOICE)), lambda x: x.isNotNull())
    return typed.withColumn("missing", lacking)


def printed_figures(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(demand, bands)`` of ``invoices`` with a ``meter_id``, named as ``reconcile.demand`` and ``reconcile.band_energy`` take them."""
    keys = ["meter_id", "period_ending"]
    demand = read.select(*keys, F.col("kwh_used").alias("kwh"), F.col("demand_kw").alias("kw"), F.col("peak_kw_7_7").alias("kw_nop"), F.col("demand_kva").alias("kva"))
    bands = [F.col(f"tou_{b}_peak_kwh").alias(f"{b}_peak_kwh") for b in ("on", "mid", "off")]
    return demand, read.select(*keys, *bands, F.col("loss_factor").alias("loss_factor_adjustment"))

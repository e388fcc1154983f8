"""Session, series and bill tables derived from the benchmark tables, and the same in SQL.

events become charging sessions, lineitem the meter's three series, orders the bill lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.functions.timeexpr import period_end, period_ending, period_start

SITES = 10


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """``site_id, path, row, id, start_local, end_local, dur_s, charge_s, energy``; one report row each.

    Every fiftieth start carries seconds. ``repeats``: every twentieth event is reported again by a third file.
    """
    e = read(spark, sf_dir, "events")
    k, n, err = F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), F.col("event_type") == "error"
    dur = k * 120 + n % 60
    ts = F.col("ts").cast("timestamp")
    start = F.when(n % 50 == 7, F.date_trunc("second", ts)).otherwise(F.date_trunc("minute", ts))
    stretched = F.when(err & (n % 3 == 0), 120).otherwise(0)
    end = F.timestamp_seconds(F.unix_seconds(F.date_trunc("minute", F.timestamp_seconds(F.unix_seconds(start) + dur))) + stretched)
    own = F.concat(F.lit("e"), (n % 2).cast("string"))
    paths = F.when(n % 20 == 0, F.array(own, F.lit("e9"))).otherwise(F.array(own)) if repeats else F.array(own)
    return e.select(
        (F.col("user_id") % SITES).alias("site_id"),
        F.explode(paths).alias("path"),
        (n + 2).alias("row"),
        F.concat(F.lit("S"), (n - F.when(err, n % 2).otherwise(0)).cast("string")).alias("id"),
        start.cast("timestamp_ntz").alias("start_local"),
        end.cast("timestamp_ntz").alias("end_local"),
        dur.alias("dur_s"),
        F.when(k % 10 == 0, F.lit(0).cast("long")).otherwise(dur).alias("charge_s"),
        (F.col("value") / 10).alias("energy"),
    )


def sessions_sql(repeats: bool = False) -> str:
    """CTE ``s``."""
    again = " UNION ALL SELECT site_id, 'e9' AS path, \"row\", id, start_local, end_local, dur_s, charge_s, energy FROM s0 WHERE (\"row\" - 2) % 20 = 0"
    return f"""
src AS (SELECT event_id AS n, event_type = 'error' AS err, user_id, value, CASE WHEN event_id % 50 = 7 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS start_local,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
s0 AS (SELECT user_id % {SITES} AS site_id, 'e' || CAST(n % 2 AS VARCHAR) AS path, n + 2 AS "row",
    'S' || CAST(n - CASE WHEN err THEN n % 2 ELSE 0 END AS VARCHAR) AS id, start_local,
    date_trunc('minute', start_local + to_seconds(k * 120 + n % 60)) + to_seconds(CASE WHEN err AND n % 3 = 0 THEN 120 ELSE 0 END) AS end_local,
    k * 120 + n % 60 AS dur_s, CASE WHEN k % 10 = 0 THEN 0 ELSE k * 120 + n % 60 END AS charge_s, value / 10 AS energy FROM src),
s AS (SELECT * FROM s0{again if repeats else ""})"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``meter_id, uom, ts, value, doc_order``: 72 energy, 38 real power, 61 apparent power, in thousandths."""
    li = read(spark, sf_dir, "lineitem")
    hour = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24
    late = F.when(F.col("l_linenumber") == 7, 1800).otherwise(0)
    ts = F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + hour * 3600 + late)
    values = F.array(
        F.struct(F.lit(72).alias("uom"), (F.col("l_quantity") * 1000).cast("long").alias("value")),
        F.struct(F.lit(38).alias("uom"), F.when(F.col("l_returnflag") != "A", (F.col("l_extendedprice") * 10).cast("long")).alias("value")),
        F.struct(F.lit(61).alias("uom"), (F.col("l_extendedprice") * (1 + F.col("l_tax")) * 10).cast("long").alias("value")),
    )
    return (
        li.select(
            (F.col("l_suppkey") % SITES).alias("meter_id"),
            ts.alias("ts"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_order"),
            F.explode(values).alias("v"),
        )
        .select("meter_id", "v.uom", "ts", "v.value", "doc_order")
        .where("value is not null")
    )


SERIES_SQL = f"""
li AS (SELECT l_suppkey % {SITES} AS meter_id, l_orderkey * 10 + l_linenumber AS doc_order,
    CAST(l_shipdate AS TIMESTAMP) + to_seconds(((l_orderkey * 7 + l_linenumber * 5) % 24) * 3600 + CASE WHEN l_linenumber = 7 THEN 1800 ELSE 0 END) AS ts,
    CAST(trunc(l_quantity * 1000) AS BIGINT) AS v72,
    CASE WHEN l_returnflag <> 'A' THEN CAST(trunc(l_extendedprice * 10) AS BIGINT) END AS v38,
    CAST(trunc(l_extendedprice * (1 + l_tax) * 10) AS BIGINT) AS v61 FROM lineitem),
series AS (SELECT meter_id, 72 AS uom, ts, v72 AS value, doc_order FROM li
  UNION ALL SELECT meter_id, 38, ts, v38, doc_order FROM li WHERE v38 IS NOT NULL
  UNION ALL SELECT meter_id, 61, ts, v61, doc_order FROM li)"""


#: Label of a charge line by order priority, in the wording of the utility's bills.
LABELS = {
    "1-URGENT": "Customer Charge",
    "2-HIGH": "Distribution Charges",
    "3-MEDIUM": "Transmission Connection Charge",
    "4-NOT SPECIFIED": "Transmission Network Charge",
    "5-LOW": "Wholesale Market Service Charge",
}


def bill_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_id, ts, label, amount``, dated by the order."""
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("o_orderpriority")]
    return read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % SITES).alias("site_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        label.alias("label"),
        F.col("o_totalprice").alias("amount"),
    )


def powered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series as three kinds of meter state them: thousandths, hundredths, or whole units, by ``power_of_ten``."""
    kind = F.col("meter_id") % 3
    power = F.when(kind == 0, -3).when(kind == 1, -2).otherwise(0)
    value = F.when(kind == 0, F.col("value")).when(kind == 1, F.expr("value div 10")).otherwise(F.expr("value div 1000"))
    return series(spark, sf_dir).select("meter_id", "uom", power.alias("power_of_ten"), "ts", value.alias("value"), "doc_order")


POWERED_SQL = f"""{SERIES_SQL},
powered AS (SELECT meter_id, uom, ts, doc_order, CASE meter_id % 3 WHEN 0 THEN -3 WHEN 1 THEN -2 ELSE 0 END AS power_of_ten,
    CASE meter_id % 3 WHEN 0 THEN value WHEN 1 THEN value // 10 ELSE value // 1000 END AS value FROM series)"""


def site_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings of each site's meter: ``meter_id, ts, kwh, kw, kva, repeated``.

    A small base load in every hour of the periods that the site's events touch, and the hour's
    events. Sites 4 and 9 lack the base load, and so most of their hours; site 7 has no meter.
    """
    e = read(spark, sf_dir, "events").where(F.col("user_id") % SITES != 7)
    site, hour = (F.col("user_id") % SITES).alias("meter_id"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    milli, k = (F.col("value") * 1000).cast("long"), F.get_json_object("props", "$.k").cast("long")
    busy = e.select(site, hour, milli.alias("kw"), (milli + k * 1000).alias("kva"))
    spans = e.groupBy(site).agg(F.min(period_ending("ts")).alias("a"), F.max(period_ending("ts")).alias("z")).where("meter_id % 5 <> 4")
    step = F.expr("interval 1 hour")
    hours = F.explode(F.sequence(period_start("a"), period_end("z") - step, step)).alias("ts")
    base = spans.select("meter_id", hours).withColumn("kw", F.lit(1000).cast("long")).withColumn("kva", F.lit(1100).cast("long"))
    sums = busy.unionByName(base).groupBy("meter_id", "ts").agg(F.sum("kw").alias("kw"), F.sum("kva").alias("kva"))
    return sums.select("meter_id", "ts", F.col("kw").alias("kwh"), "kw", "kva", F.lit(False).alias("repeated"))


def hours_sql(ending: Callable[[str], str]) -> str:
    """CTE ``site_hours``; ``ending`` gives the period of a timestamp."""
    return f"""
sh0 AS (SELECT user_id % {SITES} AS meter_id, ts, CAST(trunc(value * 1000) AS BIGINT) AS milli, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE user_id % {SITES} <> 7),
sh1 AS (SELECT meter_id, min({ending("ts")}) AS a, max({ending("ts")}) AS z FROM sh0 WHERE meter_id % 5 <> 4 GROUP BY meter_id),
sh2 AS (SELECT meter_id, date_trunc('hour', ts) AS ts, milli AS kw, milli + 1000 * k AS kva FROM sh0
  UNION ALL SELECT meter_id, unnest(generate_series(CAST(a - INTERVAL 1 MONTH AS TIMESTAMP) + INTERVAL 29 HOUR, CAST(z AS TIMESTAMP) + INTERVAL 28 HOUR, INTERVAL 1 HOUR)), 1000, 1100 FROM sh1),
site_hours AS (SELECT meter_id, ts, CAST(sum(kw) AS BIGINT) AS kw, CAST(sum(kva) AS BIGINT) AS kva FROM sh2 GROUP BY ALL)"""


def site_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_id, name`` of each site's session reports: two periods; site 1 lacks three days between them, and a name of site 3 says no dates."""
    sites = read(spark, sf_dir, "events").select((F.col("user_id") % SITES).alias("site_id")).distinct()
    early, late, short = (f"/in/Session_Report_{d}.csv" for d in ("December_24_2023-January_23_2024", "January_24_2024-February_23_2024-v2", "January_27_2024-February_23_2024"))
    names = F.when(F.col("site_id") == 1, F.array(F.lit(early), F.lit(short))).when(F.col("site_id") == 3, F.array(F.lit(early), F.lit(late), F.lit("/in/export.csv")))
    return sites.select("site_id", F.explode(names.otherwise(F.array(F.lit(early), F.lit(late)))).alias("name"))


#: CTE ``gate``: coverage of both periods by the dates of the names above.
GATE_SQL = f"""
gs AS (SELECT DISTINCT user_id % {SITES} AS site_id FROM events),
gr AS (SELECT site_id, DATE '2023-12-24' AS a, DATE '2024-01-23' AS z FROM gs
  UNION ALL SELECT site_id, CASE WHEN site_id = 1 THEN DATE '2024-01-27' ELSE DATE '2024-01-24' END, DATE '2024-02-23' FROM gs
  UNION ALL SELECT site_id, NULL, NULL FROM gs WHERE site_id = 3),
gd AS (SELECT DISTINCT site_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM gr WHERE a IS NOT NULL),
gp AS (SELECT site_id, p AS period_ending FROM gs, (VALUES (DATE '2024-01-23'), (DATE '2024-02-23')) t(p)),
gc AS (SELECT site_id, period_ending, count(d) AS n FROM gp LEFT JOIN gd USING (site_id) WHERE d IS NULL OR (d > period_ending - INTERVAL 1 MONTH AND d <= period_ending) GROUP BY ALL),
gate AS (SELECT gp.site_id, gp.period_ending, CASE WHEN EXISTS (SELECT 1 FROM gr WHERE gr.site_id = gp.site_id AND a IS NULL) THEN 'UndatedReport'
    WHEN coalesce(n, 0) <> date_diff('day', CAST(gp.period_ending - INTERVAL 1 MONTH AS DATE), gp.period_ending) THEN 'ReportsDoNotCover' END AS refused
  FROM gp LEFT JOIN gc ON gc.site_id = gp.site_id AND gc.period_ending = gp.period_ending)"""

#: Column of the site's bill, as arithmetic that both engines read alike on whole numbers: thousandths of
#: energy by kind of event (n_on, n_mid, n_off), their sum n, and the period's days.
BILL_FIGURES = {
    "on_peak_kwh": "n_on / 1000.0", "mid_peak_kwh": "n_mid / 1000.0", "off_peak_kwh": "n_off / 1000.0",
    "on_peak_cost": "n_on * 158 / 1000000.0", "mid_peak_cost": "n_mid * 122 / 1000000.0", "off_peak_cost": "n_off * 76 / 1000000.0",
    "delivery_customer_charges": "50.0", "distribution_charges": "n * 9 / 1000000.0",
    "transmission_connection_charge": "n * 3 / 1000000.0", "transmission_network_charge": "n * 5 / 1000000.0",
    "standard_supply_admin_charge": "0.25", "wholesale_market_svc_charge": "n / 1000000.0",
    "adjusted_kwh_used": "(n_on + n_mid + n_off) / 1000.0", "loss_factor_adjustment": "1.0295",
    "demand_kw": "(n / 700000.0 + 1)", "demand_kva": "(n / 650000.0 + 1)", "peak_7_7_kw": "(n / 800000.0 + 1)",
    "adj_kw": "(n / 700000.0 + 1) * days / 30.0", "adj_kva": "(n / 650000.0 + 1) * days / 30.0",
    "adj_peak_7_7_kw": "(n / 800000.0 + 1) * days / 30.0", "metering_adj": "1.0",
}

_DECIMAL = re.compile(r"([0-9]+[.][0-9]+)")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bill of each site and period, from the sums of its events.

    Sites divisible by 4 are billed a cent and a half too little; odd sites' energy is not loss-adjusted.
    Of those for February, site 5's has no mid-peak energy, site 6's is missing, and site 2's ends a day early.
    """
    e = read(spark, sf_dir, "events").withColumn("m", (F.col("value") * 1000).cast("long"))
    kind = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("m")).otherwise(0))
    sums = e.groupBy((F.col("user_id") % SITES).alias("site_id"), period_ending("ts").alias("period_ending")).agg(
        kind("purchase").alias("n_on"), kind("view").alias("n_mid"), kind("click").alias("n_off"), F.sum("m").alias("n")
    )
    site = lambda n: (F.col("site_id") == n) & (F.month("period_ending") == 2)
    sums = sums.where(~site(6)).withColumn("n_mid", F.when(site(5), 0).otherwise(F.col("n_mid")))
    sums = sums.withColumn("period_ending", F.when(site(2), F.date_sub("period_ending", 1)).otherwise(F.col("period_ending")))
    begins = F.add_months("period_ending", -1)
    rows = sums.withColumn("days", F.datediff("period_ending", begins).cast("long"))
    rows = rows.select("*", *(F.expr(_DECIMAL.sub(r"\1D", x)).cast("double").alias(c) for c, x in BILL_FIGURES.items()))
    parts = [c for c in BILL_FIGURES if c.endswith(("_cost", "_charge", "_charges"))]
    whole = sum((F.col(c) for c in parts[1:]), F.col(parts[0])) - F.when(F.col("site_id") % 4 == 0, 0.015).otherwise(0.0)
    used = F.when(F.col("site_id") % 2 == 1, F.col("adjusted_kwh_used")).otherwise(F.col("adjusted_kwh_used") / F.col("loss_factor_adjustment"))
    return rows.withColumns(
        {
            "total_electricity_charges": whole,
            "kwh_used": used,
            "number_of_days": F.col("days"),
            "meter_reading_period_from": begins,
            "meter_reading_period_to": F.col("period_ending"),
            "statement_date": F.date_add("period_ending", 5),
        }
    ).withColumns({"hst": F.col("total_electricity_charges") * 0.13, "ontario_electricity_rebate": F.col("total_electricity_charges") * 0.1})


def bills_sql(ending: str) -> str:
    """CTE ``bills``; ``ending`` is the period of ts."""
    parts = " + ".join(c for c in BILL_FIGURES if c.endswith(("_cost", "_charge", "_charges")))
    kind = lambda t: f"CAST(sum(CASE WHEN event_type = '{t}' THEN m ELSE 0 END) AS BIGINT)"
    figures = ", ".join(f"CAST({_DECIMAL.sub(r'\1::DOUBLE', x)} AS DOUBLE) AS {c}" for c, x in BILL_FIGURES.items())
    return f"""
b0 AS (SELECT user_id % {SITES} AS site_id, {ending} AS period_ending, event_type, CAST(trunc(value * 1000) AS BIGINT) AS m FROM events),
b1 AS (SELECT site_id, period_ending, {kind("purchase")} AS n_on, {kind("view")} AS n_mid, {kind("click")} AS n_off, CAST(sum(m) AS BIGINT) AS n FROM b0 GROUP BY ALL),
bz AS (SELECT site_id, CAST(CASE WHEN site_id = 2 AND month(period_ending) = 2 THEN period_ending - 1 ELSE period_ending END AS DATE) AS period_ending, n_on,
    CASE WHEN site_id = 5 AND month(period_ending) = 2 THEN 0 ELSE n_mid END AS n_mid, n_off, n FROM b1 WHERE NOT (site_id = 6 AND month(period_ending) = 2)),
b2 AS (SELECT *, date_diff('day', CAST(period_ending - INTERVAL 1 MONTH AS DATE), period_ending) AS days FROM bz),
b3 AS (SELECT *, {figures} FROM b2),
b4 AS (SELECT *, {parts} - CASE WHEN site_id % 4 = 0 THEN 0.015::DOUBLE ELSE 0 END AS total_electricity_charges,
    CASE WHEN site_id % 2 = 1 THEN adjusted_kwh_used ELSE adjusted_kwh_used / loss_factor_adjustment END AS kwh_used FROM b3),
bills AS (SELECT *, total_electricity_charges * 0.13::DOUBLE AS hst, total_electricity_charges * 0.1::DOUBLE AS ontario_electricity_rebate FROM b4)"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery rates of each site: one of 2023 (not at site 9), and a change on 2024-01-10 at sites divisible by 3."""
    sites = read(spark, sf_dir, "events").select((F.col("user_id") % SITES).alias("site_id")).distinct()
    cents = lambda base: (F.col("site_id") + base) / 100
    made = lambda day, up: sites.select("site_id", F.lit(day).cast("date").alias("effective_date"), *(cents(b + up).alias(f"{n}_rate") for n, b in (("on", 20), ("mid", 15), ("off", 10))))
    return made("2023-06-01", 0).where("site_id <> 9").unionByName(made("2024-01-10", 3).where("site_id % 3 = 0"))


RATES_SQL = f"""
sites AS (SELECT DISTINCT user_id % {SITES} AS site_id FROM events),
rates AS (SELECT site_id, DATE '2023-06-01' AS effective_date, (site_id + 20) / 100 AS on_rate, (site_id + 15) / 100 AS mid_rate, (site_id + 10) / 100 AS off_rate FROM sites WHERE site_id <> 9
  UNION ALL SELECT site_id, DATE '2024-01-10', (site_id + 23) / 100, (site_id + 18) / 100, (site_id + 13) / 100 FROM sites WHERE site_id % 3 = 0)"""


def bill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines as printed, one bill an account and period: ``bill_id, line_no, label, amount``.

    A charge whose amount is on its rate line gives two lines; low-priority orders are energy lines.
    """
    o = read(spark, sf_dir, "orders")
    amount = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    later = {"1-URGENT": "Transmission Connection Charge", "3-MEDIUM": "Transmission Network Charge"}
    line = lambda nth, label, value: F.struct((F.col("o_orderkey") * 2 + nth).alias("line_no"), label.alias("label"), value.alias("amount"))
    none = F.lit(None).cast("string")
    used = F.concat(F.format_number(F.col("o_orderkey") % 5000 + 1000, 3), F.lit(" kWh Off-peak @ $0.076 / kWh"))
    two = lambda label: F.array(line(0, F.lit(label), none), line(1, F.lit("140.640 kW at $3.1008 per kW per 30 Days"), amount))
    p = F.col("o_orderpriority")
    lines = (
        F.when(p == "1-URGENT", two(later["1-URGENT"])).when(p == "3-MEDIUM", two(later["3-MEDIUM"]))
        .when(p == "2-HIGH", F.array(line(0, F.lit("Distribution Charges"), amount)))
        .when(p == "5-LOW", F.array(line(0, used, amount)))
        .otherwise(F.array(line(0, F.lit("Late Payment"), amount), line(1, F.lit("Delivery"), none)))
    )
    bill = F.concat_ws("/", F.col("o_custkey").cast("string"), period_ending("o_orderdate").cast("string"))
    return o.select(bill.alias("bill_id"), F.explode(lines).alias("l")).select("bill_id", "l.*")


def bill_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bill of ``bills`` as its printed lines: ``bill_id, line_no, fragments``.

    On-peak energy is in two lines where a price changed. Site 3's bills lack their rebate, and site 8's have a charge
    that no rule knows.
    """
    b = bills(spark, sf_dir)
    full = lambda c: F.col(c).cast("string")
    kwh = lambda c: F.format_number(F.col(c), 3)
    day = lambda c: F.upper(F.date_format(c, "MMM dd yyyy"))
    row = lambda *f: F.array(*(F.lit(x) if isinstance(x, str) else x for x in f))
    used = lambda band, name, of: row(F.concat(kwh(of), F.lit(f" kWh {name} @ $0.158 / kWh")), full(band))
    site = F.col("site_id")
    lines = [
        row("Statement Date", F.date_format("statement_date", "MMM d yyyy"), "Page 1"), row("Your Electricity Charges"), row("Electricity"),
        row("Time of use pricing from today"), used("on_peak_cost", "On-peak", "on_peak_kwh"), row("0.000 kWh On-peak @ $0.182 / kWh", "$0.00"),
        used("mid_peak_cost", "Mid-peak", "mid_peak_kwh"), used("off_peak_cost", "Off-peak", "off_peak_kwh"), row("Delivery"),
        row("Customer Charges", F.concat(F.lit("$"), full("delivery_customer_charges"))), row("Distribution Charges", full("distribution_charges")),
        row("Transmission Connection Charge"), row("140.640 kW at $3.1008 per kW per 30 Days", full("transmission_connection_charge")),
        row("Transmission Network Charge"), row("140.640 kW at $4.2 per kW per 30 Days", full("transmission_network_charge")), row("Regulatory Charges"),
        row("Standard Supply Service Administrative Charge"), row("at $0.25 per 30 Days", full("standard_supply_admin_charge")),
        row("Wholesale Market Service Charge"), row("17.2 kWh at $0.007 per kWh", full("wholesale_market_svc_charge")),
        F.when(site == 8, row("Late Payment", "$1.00")), row("Your Total Electricity Charges", F.concat(F.lit("$"), full("total_electricity_charges"))),
        row("H.S.T. (R123)", full("hst")), F.when(site != 3, row("Ontario Electricity Rebate", F.concat(F.lit("-"), full("ontario_electricity_rebate")), "CR")),
        row("1", F.concat(day("meter_reading_period_from"), F.lit(" TO "), day("meter_reading_period_to")), full("number_of_days"), "1", full("kwh_used"), full("loss_factor_adjustment"), kwh("adjusted_kwh_used")),
        row("Peak kW", "Adj."), row("7-7"), row(*(full(c) for c in ("peak_7_7_kw", "adj_peak_7_7_kw", "demand_kw", "demand_kva", "metering_adj", "adj_kw", "adj_kva"))),
    ]
    bill = F.concat_ws("/", site.cast("string"), F.col("meter_reading_period_to").cast("string"))
    return b.select(bill.alias("bill_id"), F.posexplode(F.array(*lines)).alias("line_no", "fragments")).where("fragments is not null")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval requests of every line: wall times over seven years, some off the grid or misnamed."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    at = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + (k * 7 + n * 5) % 24 * 3600
    at = at + F.get(F.array(*(F.lit(m) for m in (0, 0, 15, 30, 45, 7))), (k % 6).cast("int")) * 60 + F.when(k % 11 == 0, 30).otherwise(0)
    return read(spark, sf_dir, "lineitem").select(
        (k * 10 + n).alias("request_id"),
        F.timestamp_seconds(at).cast("timestamp_ntz").alias("start_local"),
        F.when(n % 3 == 1, "1h").when(n % 3 == 2, "15m").alias("length"),
        F.when(k % 4 == 1, "EST").when(k % 4 == 2, "edt").alias("designator"),
    )


def report_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session report's file name for every order: ``site_id, name, first``; some state a date that is none."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    said = lambda x: F.date_format(x, "MMMM_d_yyyy")
    last = F.date_add(d, (k % 150).cast("int"))
    name = F.concat(F.lit("/in/Session_Report_"), said(d), F.lit("-"), F.when(k % 13 == 0, F.lit("June_31_1998")).otherwise(said(last)), F.when(k % 5 == 0, "-mock").otherwise(""), F.lit(".csv"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site_id"), name.alias("name"), d.alias("first"))


def raw_sessions(spark: SparkSession, sf_dir: str, bad: bool = True) -> DataFrame:
    """The session rows as a report's text cells; ``bad``: some durations and energies are no numbers."""
    s = sessions(spark, sf_dir)
    n = F.col("row")
    clock = lambda c: F.format_string("%d:%02d:%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.col(c) % 60)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd H:mm")
    exact = F.when(F.second("start_local") > 0, F.date_format("start_local", "yyyy-MM-dd H:mm:ss")).otherwise(shown("start_local"))
    return s.select(
        "site_id", "path", "row", "id", exact.alias("conn_start"),
        F.concat(shown("end_local"), F.when(n % 2 == 0, ":00").otherwise("")).alias("conn_end"),
        F.when(F.lit(bad) & (n % 97 == 0), "1:75:00").otherwise(clock("dur_s")).alias("conn_duration"), clock("charge_s").alias("active_time"),
        F.when(F.lit(bad) & (n % 101 == 0), "n/a").otherwise(F.col("energy").cast("string")).alias("energy_use"),
    )

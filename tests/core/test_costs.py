import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ampledger.operators import bills as B
from ampledger.operators import costs as C
from ampledger.operators import coverage as V
from ampledger.operators import meter
from ampledger.operators import sessions as S
from ampledger.operators.requests import checked_intervals
from ampledger.sources import files
from ampledger.sources.session_reports import session_reports

D = dt.date.fromisoformat


def test_cents_are_those_of_the_printed_figure(spark):
    rng = random.Random(5)
    xs = [0.125, 0.375, 2.675, 1.005, -0.125, -2.675, 0.0, 1e9 + 0.005] + [rng.randrange(10**9) / 1000 for _ in range(4000)]
    xs += [rng.uniform(-1e6, 1e6) for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.to_the_cent(F.col("x")).alias("c")).collect()
    assert all(r.c == float(f"{r.x:.2f}") for r in rows)


def test_requests_in_the_gap_and_the_fold(spark):
    asked = [
        ("2026-03-08 02:30:00", None, None), ("2026-11-01 01:30:00", None, None), ("2026-11-01 01:30:00", None, "est"),
        ("2026-11-01 01:30:00", None, "EDT"), ("2026-07-01 16:00:00", None, "EST"), ("2026-07-01 16:00:00", None, None),
        ("2026-07-01 16:15:00", "1h", None), ("2026-07-01 16:20:00", None, None), ("2026-07-01 16:00:09", None, None),
    ]
    rows = [(i, dt.datetime.fromisoformat(a), n, d) for i, (a, n, d) in enumerate(asked)] + [(9, None, None, None)]
    got = checked_intervals(spark.createDataFrame(rows, "request_id int, start_local timestamp_ntz, length string, designator string"))
    out = {r.request_id: r for r in got.withColumn("start_utc", F.date_format("start_utc", "MM-dd HH:mm")).collect()}
    assert [out[i].error for i in range(10)] == [
        "NeverOccurred", "OccursTwice", None, None, "WrongDesignator", None, "HourNotOnTheHour", "OffQuarterHour", "CarriesSeconds", "NoStart",
    ]
    assert (out[2].start_utc, out[3].start_utc, out[5].start_utc) == ("11-01 06:30", "11-01 05:30", "07-01 20:00")
    assert (out[2].length_s, out[5].length_s) == (900, 3600)


def test_bill_lines(spark):
    lines = [
        (1, "Electricity", None), (2, "13,240.523 kWh On-peak @ $0.158 / kWh", "$2,092.00"), (3, "100 kWh On-peak @ $0.2 / kWh", "$20.00"),
        (4, "Transmission Network Charge", None), (5, "Customer Charges", "$50.00"), (6, "140.640 kW at $3.1008 per kW per 30 Days", "$1,761.07"),
        (7, "at $0.25 per 30 Days", "$0.25"), (8, "Mystery", "$1.00"), (9, "-----", None), (10, "Distribution Charges", None),
    ]
    c = B.classify(spark.createDataFrame([("b", *x) for x in lines], "bill_id string, line_no int, label string, amount string"))
    assert {r.line_no: r.error for r in c.where("error is not null").collect()} == {7: "NoChargeAbove", 8: "UnknownCharge", 10: "MissingAmount"}
    r = B.roll_up(c).first()
    assert (r.on_peak_kwh, r.on_peak_cost, r.transmission_network_charge, r.delivery_customer_charges) == (13340.523, 2112.0, 1761.07, 50.0)
    assert (r.n_errors, r.mid_peak_kwh, r.wholesale_market_svc_charge) == (3, 0.0, 0.0)
    a, z = B.reading_period(F.lit("MAY 23 2026 TO JUN 23 2026"))
    assert tuple(spark.range(1).select(a, z, B.bill_date(F.lit("JUN 31 2026"))).first()) == (D("2026-05-23"), D("2026-06-23"), None)


def test_report_names_and_coverage(spark):
    names = ["Session_Report_june_1_2026-June_30_2026-mock.csv", "Session_Report_May_1_2026-May_31_2026.csv", "Session_Report_June_31_2026-July_1_2026.csv", "x.csv"]
    named = spark.createDataFrame([("a", n) for n in names], "site_id string, name string")
    got = V.report_dates(named)
    assert got.where("first_date is null").count() == 2
    periods = spark.createDataFrame([("a", D("2026-06-23")), ("a", D("2026-07-23")), ("b", D("2026-06-23"))], "site_id string, period_ending date")
    out = V.covered_periods(V.islands(got), periods).collect()
    assert {(r.site_id, str(r.period_ending)): r.covered for r in out} == {("a", "2026-06-23"): True, ("a", "2026-07-23"): False, ("b", "2026-06-23"): False}
    errors = V.coverage_errors(named.where("name not in ('x.csv', 'Session_Report_June_31_2026-July_1_2026.csv')"), periods).collect()
    assert {(r.site_id, str(r.period_ending)): r.coverage_error for r in errors} == {
        ("a", "2026-06-23"): None, ("a", "2026-07-23"): "ReportsDoNotCover", ("b", "2026-06-23"): "ReportsDoNotCover",
    }
    assert {r.coverage_error for r in V.coverage_errors(named, periods.where("site_id = 'a'")).collect()} == {"UndatedReport"}
    rows = periods.withColumn("kwh", F.lit(1.0))
    gated = V.gated(rows, V.coverage_errors(named.where("name like '%May%' or name like '%june%'"), periods.limit(1)), ["kwh"]).collect()
    assert {(r.site_id, str(r.period_ending)): (r.error, r.kwh) for r in gated} == {
        ("a", "2026-06-23"): (None, 1.0), ("a", "2026-07-23"): ("ReportsDoNotCover", None), ("b", "2026-06-23"): ("ReportsDoNotCover", None),
    }


def bill(site, ending, **figures):
    base = {f"{b}_peak_{k}": 10.0 for b in ("on", "mid", "off") for k in ("kwh", "cost")} | {
        "loss_factor_adjustment": 1.0, "total_electricity_charges": 100.0, "hst": 13.0, "ontario_electricity_rebate": 10.0, "number_of_days": 31,
        "distribution_charges": 30.0, "transmission_connection_charge": 20.0, "transmission_network_charge": 10.0,
        "adj_kva": 10.0, "adj_kw": 10.0, "adj_peak_7_7_kw": 10.0,
    }
    return {"site_id": site, "period_ending": D(ending)} | base | figures


def test_costs_name_what_refuses_a_period(spark):
    bills = [bill(1, "2026-06-23"), bill(2, "2026-06-22"), bill(3, "2026-06-23", mid_peak_kwh=0.0), bill(4, "2026-06-23"), bill(6, "2026-06-23", adj_kw=0.0), bill(7, "2026-06-23")]
    bills = spark.createDataFrame([tuple(b.values()) for b in bills], list(bills[0]))
    used = spark.createDataFrame(
        [(s, D("2026-06-23"), 1.0, 2.0, 3.0, e) for s, e in ((1, None), (3, None), (5, None), (7, "ReportsDoNotCover"))],
        "site_id long, period_ending date, on_kwh double, mid_kwh double, off_kwh double, error string",
    )
    got = {r.site_id: (r.error, r.net) for r in C.energy_cost(used, bills).collect()}
    assert got[1][0] is None and abs(got[1][1] - 6.0 * 1.03) < 1e-9
    assert {s: e for s, (e, _) in got.items() if s != 1} == {
        2: "NotABillingPeriodEnding", 3: "ZeroDenominator(mid_peak_kwh)", 4: "NoEnergy", 5: "NoBill", 6: "NoEnergy", 7: "ReportsDoNotCover",
    }
    at = dt.datetime(2026, 6, 15, 20)
    figures = [(s, D("2026-06-23"), whole, at, at, nop) for s, whole, nop in ((1, True, at), (3, False, at), (4, True, None), (5, True, at), (6, True, at))]
    figures = spark.createDataFrame(figures, "meter_id long, period_ending date, complete boolean, max_kva_at timestamp, max_kw_at timestamp, max_kw_nop_at timestamp")
    none = spark.createDataFrame([], "site_id long, adj_start long, adj_end long, avg_kw double")
    out = {r.site_id: (r.error, r.charges) for r in C.delivery_cost(C.peak_power(figures, none), bills).collect()}
    assert out[1][0] is None and out[1][1] > 0 and all(c is None for s, (_, c) in out.items() if s != 1)
    assert {s: e for s, (e, _) in out.items() if s != 1} == {
        2: "NotABillingPeriodEnding", 3: "PeriodNotFullyCovered", 4: "NoPeak(kw77)", 5: "NoBill", 6: "ZeroDenominator(adj_kw)", 7: "NotMetered",
    }


def test_surplus_keeps_periods_that_one_part_lacks(spark):
    made = lambda rows, c: spark.createDataFrame([(s, D("2026-06-23"), x, e) for s, x, e in rows], f"site_id long, period_ending date, {c} double, error string")
    got = C.surplus(made([(1, 10.0, None), (2, None, "RatesNotYetInEffect")], "recovery"), made([(1, 3.0, None), (3, 1.0, None)], "net"), made([(1, 9.0, None)], "net"))
    out = {r.site_id: (r.surplus, r.verdict, r.recovery_error, r.delivery_error, r.energy_error) for r in got.collect()}
    assert out == {
        1: (-2.0, "short", None, None, None), 2: (None, "unknown", "RatesNotYetInEffect", "NoDelivery", "NoEnergyCost"),
        3: (None, "unknown", "NoRecovery", None, "NoEnergyCost"),
    }


def test_rates_split_the_period_and_keep_its_energy(spark):
    rates = [(1, D("2026-01-01"), 0.1, 0.1, 0.1), (1, D("2026-06-01"), 0.2, 0.2, 0.2), (1, D("2026-06-24"), 9.0, 9.0, 9.0), (2, D("2026-06-01"), 1.0, 1.0, 1.0)]
    rates = spark.createDataFrame(rates, "site_id long, effective_date date, on_rate double, mid_rate double, off_rate double")
    days = [(s, D("2026-06-23"), D(d), 1.0, 0.0, 2.0) for s in (1, 2) for d in ("2026-05-31", "2026-06-01", "2026-06-23", "2026-06-24")]
    daily = spark.createDataFrame(days, "site_id long, period_ending date, date date, on_kwh double, mid_kwh double, off_kwh double")
    out = C.cost_recovery(daily, C.rate_stretches(daily, rates)).orderBy("site_id", "from_date").collect()
    assert [(r.site_id, str(r.from_date), str(r.to_date), r.on_kwh, r.error) for r in out] == [
        (1, "2026-05-24", "2026-05-31", 1.0, None), (1, "2026-06-01", "2026-06-23", 3.0, None), (2, "None", "None", None, "RatesNotYetInEffect"),
    ]
    assert [r.recovery and round(r.recovery, 9) for r in out] == [0.3, 1.8, None]


REPORT = """ Charge_Session_ID ,Conn_DateTime_Start,Conn_DateTime_End,Conn_Duration,Active_Charge_Time,Energy_Use,Station_ID
A,2026-06-15 9:05,2026-06-15 10:05:30,1:00:30,0:59:00,5.5,"P,1"
B,2026-06-15 9:05,soon,1:00:30,0:59:00,5.5,P2
C,2026-06-15 9:05,2026-06-15 10:05,1:60:30,0:59:00,5.5,P2
"""


def test_session_report_is_read_and_written_back(spark, tmp_path):
    (tmp_path / "Session_Report_June_1_2026-June_30_2026.csv").write_text(REPORT)
    rows = session_reports(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.id, r.row, r.parse_error) for r in rows] == [("A", 2, None), ("B", 3, "conn_end"), ("C", 4, "conn_duration")]
    assert (rows[0].start_local, rows[0].dur_s, rows[0].Station_ID) == (dt.datetime(2026, 6, 15, 9, 5), 3630, "P,1")
    with pytest.raises(ValueError, match="quarantine"):
        S.flag_sessions(session_reports(spark, str(tmp_path)))
    good = session_reports(spark, str(tmp_path)).where("parse_error is null").drop("parse_error")
    flagged = S.flag_sessions(good.withColumn("site_id", F.lit(1)))
    files.write_sessions(flagged, str(tmp_path / "out"))
    table = spark.read.parquet(str(tmp_path / "out"))
    assert len(set(files.REPORTED) | set(files.DERIVED)) == 30 and set(files.REPORTED) | set(files.DERIVED) <= set(table.columns)
    again = files.read_sessions(spark, str(tmp_path / "out")).collect()
    first = flagged.first()
    assert [(r.id, r.anomalies, r.bucket, r.workbook_discrepancy, r.Station_ID) for r in again] == [("A", first.anomalies, first.bucket, False, "P,1")]
    assert (again[0].adj_start, again[0].adj_end, again[0].avg_kw) == (first.adj_start, first.adj_end, first.avg_kw)


def test_stored_figures_never_count(spark):
    flagged = S.flag_sessions(spark.createDataFrame(
        [(1, "a", 2, "A", dt.datetime(2026, 6, 15, 9, 5), dt.datetime(2026, 6, 15, 10, 5), 3600, 3600, 5.0)],
        "site_id long, path string, row long, id string, start_local timestamp_ntz, end_local timestamp_ntz, dur_s long, charge_s long, energy double",
    ))
    table = files.session_table(flagged)
    wrong = table.withColumn("avg_kw", F.lit(99.0)).withColumn("adj_conn_duration", F.lit(None).cast("long")).withColumn("adj_conn_end_utc", F.lit(None).cast("timestamp"))
    r = files.reread(wrong).first()
    assert (r.avg_kw, r.discrepancies) == (5.0, ["adj_conn_end_utc", "avg_kw"]) and r.adj_end == flagged.first().adj_end
    assert files.reread(table.withColumn("Charge_Session_ID", F.lit(" "))).count() == 0 and files.reread(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="lacks Conn_Duration"):
        files.reread(table.drop("Conn_Duration"))
    with pytest.raises(Exception, match="unknown anomaly Odd"):
        files.reread(table.withColumn("anomalies", F.lit("Odd"))).collect()


def _entry(own, related, content):
    links = "".join(f'<link rel="related" href="{r}"/>' for r in related)
    return f'<entry><link rel="self" href="{own}"/>{links}<content>{content}</content></entry>'


def test_feed_links(spark, tmp_path):
    kind = lambda uom, s=3600: f'<espi:ReadingType xmlns:espi="e"><espi:intervalLength>{s}</espi:intervalLength><espi:powerOfTenMultiplier>-3</espi:powerOfTenMultiplier><espi:uom>{uom}</espi:uom></espi:ReadingType>'
    block = lambda v: f'<espi:IntervalBlock xmlns:espi="e"><espi:IntervalReading><espi:timePeriod><espi:duration>3600</espi:duration><espi:start>1732338000</espi:start></espi:timePeriod><espi:value>{v}</espi:value></espi:IntervalReading></espi:IntervalBlock>'
    empty = '<espi:MeterReading xmlns:espi="e"/>'
    entries = [
        _entry("t72", [], kind(72)), _entry("t38", [], kind(38)), _entry("t61", [], kind(61, 900)),
        _entry("m1", ["nowhere", "t72", "t38"], empty), _entry("m2", ["t38"], empty), _entry("m3", ["t61"], empty),
        _entry("b1", ["m1"], block(83759998)), _entry("b2", ["m2"], block(7)), _entry("b3", ["gone"], block(8)), _entry("b4", ["m3"], block(9)),
    ]
    (tmp_path / "f.xml").write_text(f'<feed xmlns="a">{"".join(entries)}</feed>')
    series, errors = files.feed_series(files.feed_entries(spark, str(tmp_path)))
    assert {(r.uom, r.value, r.power_of_ten) for r in series.collect()} == {(72, 83759998, -3), (38, 7, -3)}
    assert {(r.href, r.error) for r in errors.collect()} == {("b3", "DanglingLink"), ("b4", "NotHourly"), ("t61", "EmptySeries")}
    (tmp_path / "less").mkdir()
    (tmp_path / "less" / "g.xml").write_text(f'<feed xmlns="a">{entries[0]}{_entry("m1", ["t72"], empty)}{_entry("b1", ["m1"], block(5))}</feed>')
    _, errors = files.feed_series(files.feed_entries(spark, str(tmp_path / "less")))
    assert {(r.href, r.error) for r in errors.collect()} == {(None, "AbsentSeries(38)"), (None, "AbsentSeries(61)")}
    wide = meter.readings(files.meter_series(series)).collect()
    assert [(r.kwh, r.kw, r.kva, r.meter_id.endswith("f.xml")) for r in wide] == [(83759998, 7, None, True)]
    named = series.select("path").distinct().withColumn("meter_id", F.lit(5))
    assert [r.meter_id for r in meter.readings(files.meter_series(series, named)).collect()] == [5]


def test_powers_of_ten(spark):
    rows = [(1, 72, p, 0, 5, n) for n, p in enumerate((None, -3, -1, 2, -5))]
    got = meter.scaled(spark.createDataFrame(rows, "meter_id int, uom int, power_of_ten int, ts int, value long, doc_order int")).collect()
    assert [r.value for r in got] == [5, 5, 500, 500_000, 0]

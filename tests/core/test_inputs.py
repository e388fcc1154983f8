import csv
import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from ampledger.config import SiteConfig
from ampledger.functions.load import site_load
from ampledger.functions.sites import BY_SITE, checked_sites, with_sites
from ampledger.functions.timeexpr import period_ending
from ampledger.operators import bill_text, estimate, meter, reconcile
from ampledger.operators import coverage as V
from ampledger.operators import sessions as S
from ampledger.plans import inputs
from ampledger.sources import files

D = dt.date.fromisoformat

#: Figures of one published invoice.
INVOICE = """
# an invoice, as key value lines
period_ending       2026-06-23
days                31
loss_factor         1.0295
kwh_used            77292.718
demand_kw           153.119
peak_kw_7_7         152.639
demand_kva          183.359
adjusted_kwh_used   79572.853
tou_on_peak_kwh     15165.894
tou_mid_peak_kwh    14291.230
tou_off_peak_kwh    50115.729
"""


def _lines(spark, *texts):
    rows = [(f"d{n}", k, line) for n, text in enumerate(texts) for k, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "doc_id string, line_no int, text string")


def test_the_published_invoice_reconciles(spark):
    read = bill_text.invoices(_lines(spark, INVOICE, "days many\n\nperiod_ending 2026-07-23\nperiod_ending  2026-08-23")).orderBy("doc_id").collect()
    assert (read[0].period_ending, read[0].days, read[0].demand_kva, read[0].missing) == (D("2026-06-23"), 31, 183.359, [])
    assert read[1].period_ending == D("2026-08-23") and "days" in read[1].missing and len(read[1].missing) == 10
    invoice = bill_text.invoices(_lines(spark, INVOICE)).withColumn("meter_id", F.lit(1))
    demand, bands = bill_text.printed_figures(invoice)
    measured = spark.createDataFrame([(1, D("2026-06-23"), 77292.71776, 153.119996, 152.639996, 183.3592)], "meter_id int, period_ending date, kwh double, kw double, kw_nop double, kva double")
    got = reconcile.demand(measured, demand, ("kw", "kw_nop", "kva"), energy=("kwh",)).first()
    assert (got.kw_agrees, got.kw_nop_agrees, got.kva_agrees, got.kwh_agrees, got.unmatched) == (True, True, True, True, None)
    metered = [(1, D("2026-06-23"), t, x / 1.0295) for t, x in (("OnPeak", 15165.894), ("MidPeak", 14291.230), ("OffPeak", 50115.729))]
    held = reconcile.band_energy(spark.createDataFrame(metered, "meter_id int, period_ending date, tou string, kwh double"), bands)
    assert [r.agrees for r in held.collect()] == [True] * 3
    assert bill_text.invoices(_lines(spark)).count() == 0


PAGE = [
    ["Statement Date", "Jun 29 2026"], ["Your Electricity Charges"], ["Electricity"], ["Time of use"], ["1,000.500 kWh On-peak @ $0.158 / kWh", "$158.08"],
    ["500.000 kWh Mid-peak @ $0.122 / kWh", "61.00"], ["10.000 kWh On-peak @ $0.2 / kWh", "2.00"], ["----"], ["Customer Charges", "$50.00"], ["Distribution Charges", "1,200.00"],
    ["Transmission Connection Charge"], ["140.640 kW at $3.1008 per kW per 30 Days", "450.00"], ["Wholesale Market Service Charge"], ["17 kWh at $0.007 per kWh", "1.5"],
    ["Your Total Electricity Charges", "$1,922.58"], ["H.S.T. (R101)", "249.94"], ["Ontario Electricity Rebate", "-$192.26", "CR"],
    ["40004253", "MAY 23 2026 TO JUN 23 2026", "31", "1", "1,467.217", "1.0295", "1,510.500"], ["Peak kW", "Adj."], ["7-7"], ["1", "x", "3", "4", "5", "6", "7"],
    ["10.5", "10.85", "11", "12", "1", "11.367", "12.4"],
]


def test_a_bill_is_read_whole_or_refused(spark):
    def edited(**changes):
        return [changes.get(row[0].split(" ")[0].lower(), row) for row in PAGE]

    pages = {
        "good": PAGE, "nodate": edited(statement=["Statement"]), "odd": edited(customer=["Late Payment", "$1.00"]), "row": edited(**{"40004253": ["MAY 23 2026 TO JUN 23 2026", "31"]}),
        "number": edited(**{"40004253": ["1", "MAY 23 2026 TO JUN 23 2026", "31", "1", "many", "1.0295", "2"]}), "flipped": [PAGE[0], PAGE[14], PAGE[1], *PAGE[2:14], *PAGE[15:]],
        "rate": edited(transmission=["x"]), "nopeak": [r for r in PAGE if r[0] != "Peak kW"], "blank": [], "amount": edited(distribution=["Distribution Charges"]),
    }
    rows = [(b, k, f) for b, page in pages.items() for k, f in enumerate(page)] + [("nulls", 0, None), ("nulls", 1, [None])]
    bills, refused = bill_text.read_bills(spark.createDataFrame(rows, "bill_id string, line_no int, fragments array<string>"))
    got = bills.collect()
    assert [r.bill_id for r in got] == ["good"]
    r = got[0]
    assert (r.on_peak_kwh, r.on_peak_cost, r.off_peak_kwh, r.distribution_charges, r.transmission_connection_charge, r.wholesale_market_svc_charge) == (1010.5, 160.08, 0.0, 1200.0, 450.0, 1.5)
    assert (r.statement_date, r.meter_reading_period_from, r.period_ending, r.number_of_days) == (D("2026-06-29"), D("2026-05-23"), D("2026-06-23"), 31)
    assert (r.hst, r.ontario_electricity_rebate, r.kwh_used, r.peak_7_7_kw, r.adj_kva) == (249.94, 192.26, 1467.217, 10.5, 12.4)
    assert {x.bill_id: x.error for x in refused.collect()} == {
        "nodate": "Missing(Statement Date)", "odd": "UnknownCharge", "row": "Shape(meter reading row)", "number": "Malformed(kwh_used)",
        "flipped": "Shape(the total comes before the charges)", "rate": "NoChargeAbove", "nopeak": "Missing(Peak kW)", "nulls": "Missing(Your Electricity Charges)", "amount": "MissingAmount",
    }


def _feed(path, twice):
    entry = lambda own, related, content: f'<entry><link rel="self" href="{own}"/>{"".join(f"<link rel=" + chr(34) + "related" + chr(34) + f" href=" + chr(34) + r + chr(34) + "/>" for r in related)}<content>{content}</content></entry>'
    kind = lambda uom: f'<espi:ReadingType xmlns:espi="e"><espi:intervalLength>3600</espi:intervalLength><espi:powerOfTenMultiplier>-3</espi:powerOfTenMultiplier><espi:uom>{uom}</espi:uom></espi:ReadingType>'
    block = lambda v: f'<espi:IntervalBlock xmlns:espi="e"><espi:IntervalReading><espi:timePeriod><espi:duration>3600</espi:duration><espi:start>1732338000</espi:start></espi:timePeriod><espi:value>{v}</espi:value></espi:IntervalReading></espi:IntervalBlock>'
    parts = [entry(f"t{u}", [], kind(u)) for u in (72, 38, 61)] + [entry(f"m{u}", [f"t{u}"], '<espi:MeterReading xmlns:espi="e"/>') for u in (72, 38, 61)]
    parts += [entry(f"b{u}{k}", [f"m{u}"], block(u + k)) for k in (0, 1) for u in (72, 38, 61)] + ([entry("t72b", [], kind(72))] if twice else [])
    path.write_text(f'<feed xmlns="a">{"".join(parts)}</feed>')


def test_a_feed_with_an_error_yields_no_reading(spark, tmp_path):
    _feed(tmp_path / "good.xml", False)
    _feed(tmp_path / "twice.xml", True)
    series, errors = files.read_feeds(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in errors.collect()} == {("twice.xml", "RepeatedUnit")}
    got = meter.readings(files.meter_series(series)).collect()
    assert [(r.meter_id.rsplit("/", 1)[1], r.kwh, r.kw, r.kva, r.repeated) for r in got] == [("good.xml", 73, 39, 62, True)]
    every, errors = files.feed_series(files.feed_entries(spark, str(tmp_path)))
    assert every.select("path").distinct().count() == 2 and files.meter_series(every, errors=errors).select("meter_id").distinct().count() == 1


def test_document_order_does_not_overflow(spark, tmp_path):
    _feed(tmp_path / "good.xml", False)
    late = F.col("place") + (F.lit(9_000_000) * (1 << 33))  # the place of an entry that task 9,000,000 reads
    series, _ = files.feed_series(files.feed_entries(spark, str(tmp_path)).withColumn("place", late))
    assert [(r.kwh, r.kw, r.kva) for r in meter.readings(files.meter_series(series)).collect()] == [(73, 39, 62)]


def test_sites_in_one_plan_equal_separate_runs(spark):
    rng = random.Random(3)
    rows = []
    for n in range(300):
        start = dt.datetime(2026, 3, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 60))
        took = rng.randrange(0, 9000)
        rows.append((n % 2, "a", n, f"S{n}", start, (start + dt.timedelta(seconds=took)).replace(second=0), took, rng.choice([0, took]), rng.uniform(0, 20)))
    cols = "site_id long, path string, row long, id string, start_local timestamp_ntz, end_local timestamp_ntz, dur_s long, charge_s long, energy double"
    df = spark.createDataFrame(rows, cols)
    own = [SiteConfig(), SiteConfig(breaker_a=24.0, ev_thd=0.1, xfmr_kva=112.5, bill_end_day=11, zone="America/Vancouver")]
    table = spark.createDataFrame([(k, c.breaker_a, c.ev_thd, c.xfmr_kva, c.bill_end_day, c.zone) for k, c in enumerate(own)], "site_id long, breaker_a double, ev_thd double, xfmr_kva double, bill_end_day int, zone string")
    shown = ["site_id", "row", "id", "start_utc", "end_utc", "avg_kw", "anomalies", "bucket", "ending", "kw", "kva"]

    def run(rows, cfg):
        load = site_load(F.lit(2.5), cfg)
        flagged = S.flag_sessions(rows, cfg).withColumn("ending", period_ending("start_utc", cfg.bill_end_day)).withColumn("kw", load["kw"]).withColumn("kva", load["kva"])
        return sorted((*r[:5], round(r[5], 9), *r[6:9], round(r[9], 9), round(r[10], 9)) for r in flagged.select(*shown).collect())

    one = run(with_sites(df, table), BY_SITE)
    assert one == sorted(x for k, c in enumerate(own) for x in run(df.where(F.col("site_id") == k), c)) and len(one) >= 300
    segments = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0), (1, 1.0, 2.0, 3.0, 4.0)], "site_id long, count_min double, count_max double, kw_min double, kw_max double")
    both = {r.site_id: r.energy_kva_max for r in estimate.estimates(with_sites(segments, table), BY_SITE).collect()}
    for k, c in enumerate(own):
        assert both[k] == pytest.approx(estimate.estimates(segments.where(F.col("site_id") == k), c).first().energy_kva_max)
    bad = spark.createDataFrame([(0, 31, 0.99), (1, 5, 0.9999), (2, None, None)], "site_id long, bill_end_day int, ev_pf double")
    assert [r.error for r in checked_sites(bad).orderBy("site_id").collect()] == ["NotAClosingDay", "PowerFactor", None]
    assert {r.site_id for r in with_sites(df, bad).collect()} == set() and with_sites(df, bad.where("site_id = 2")).count() == 300


def test_gaps_filled_in_slices_are_those_of_one_window(spark):
    rng = random.Random(6)
    hour, at = [], 0
    for _ in range(3000):
        at += rng.choice([3600] * 6 + [1800, 7200, 3600 * 50, 3600 * 3000])
        hour.append(at)
    rows = [(m, dt.datetime(2001, 1, 1) + dt.timedelta(seconds=s), s % 7, None, 3, False) for m, part in (("a", hour), ("b", hour[:3]), (None, hour[5:40])) for s in part]
    wide = spark.createDataFrame(rows + [("c", dt.datetime(1960, 1, 1), 1, 1, 1, False), ("c", dt.datetime(2020, 1, 1), 1, 1, 1, True)], "meter_id string, ts timestamp, kwh long, kw long, kva long, repeated boolean")
    whole = meter.fill_gaps(wide)
    digest = lambda df: df.groupBy("meter_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ts", "kwh", "kw", "kva", F.concat_ws(",", "anomalies"))).alias("x")).orderBy("meter_id").collect()
    want = digest(whole)
    for hours in (1, 24, 24 * 90):
        assert digest(meter.fill_gaps(wide, hours)) == want
    plan = meter.fill_gaps(wide, 24 * 90)._jdf.queryExecution().toString()
    assert "slice" in plan and meter.fill_gaps(wide.limit(0), 24).count() == 0


def test_one_long_meter_is_many_tasks(spark):
    n = 2_000_000
    hours = spark.range(n).where("id % 1000 <> 500").select(
        F.lit(1).alias("meter_id"), F.timestamp_seconds(F.col("id") * 3600 - 10**9).alias("ts"), F.lit(1).cast("long").alias("kwh"),
        F.lit(None).cast("long").alias("kw"), F.lit(2).cast("long").alias("kva"), F.lit(False).alias("repeated"),
    )
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        filled = meter.fill_gaps(hours, 24 * 365).withColumn("task", F.spark_partition_id())
        each = filled.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.array_contains("anomalies", "MissingInterval")).alias("gaps")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert sum(r.n for r in each) == n and sum(r.gaps for r in each) == n // 1000 and len(each) == 4 and max(r.n for r in each) < n // 2


def test_a_store_is_pruned_and_written_again(spark, tmp_path):
    rows = [(s, "a", n, f"S{n}", dt.datetime(2026, 1 + n % 4, 15, 9, 5), dt.datetime(2026, 1 + n % 4, 15, 10, 5), 3600, 3600, 5.0) for n in range(8) for s in (1, 2)]
    df = spark.createDataFrame(rows, "site_id long, path string, row long, id string, start_local timestamp_ntz, end_local timestamp_ntz, dur_s long, charge_s long, energy double")
    flagged, at = S.flag_sessions(df), str(tmp_path / "store")
    for _ in range(2):
        files.write_sessions(flagged, at)
        assert spark.read.parquet(at).count() == 16
    files.write_sessions(flagged.where("site_id = 1 and month(start_local) = 2").limit(1), at)
    assert spark.read.parquet(at).count() == 15
    some = files.read_sessions(spark, at, "2026-02-10", "2026-04-01")
    assert {r.start_utc.month for r in some.collect()} == {2, 3} and some.count() == 7
    plan = some._jdf.queryExecution().toString()
    found = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in found and "2026-02" in found and "2026-04" in found


def test_an_undated_report_refuses_the_period_it_is_filed_for(spark):
    may, june, july = (D(f"2026-0{m}-23") for m in (5, 6, 7))
    names = [(1, "/in/Session_Report_April_24_2026-May_23_2026.csv", may), (1, "/in/export.csv", june), (1, "/in/Session_Report_May_24_2026-June_23_2026.csv", june),
             (1, "Session_Report_May_24_2026-July_23_2026.csv", july), (2, "Session_Report_April_24_2026-July_23_2026.csv", may)]
    named = spark.createDataFrame(names, "site_id int, name string, period_ending date")
    periods = spark.createDataFrame([(s, p) for s in (1, 2) for p in (may, june, july)], "site_id int, period_ending date")
    filed = {(r.site_id, r.period_ending): r.coverage_error for r in V.coverage_errors(named, periods).collect()}
    assert filed == {(1, may): None, (1, june): "UndatedReport", (1, july): None, (2, may): None, (2, june): "ReportsDoNotCover", (2, july): "ReportsDoNotCover"}
    every = {(r.site_id, r.period_ending): r.coverage_error for r in V.coverage_errors(named.drop("period_ending"), periods).collect()}
    assert {e for (s, _), e in every.items() if s == 1} == {"UndatedReport"} and {e for (s, _), e in every.items() if s == 2} == {None}
    assert [r.name for r in V.undated_reports(named).collect()] == ["/in/export.csv"]


def test_report_files_keep_their_order_where_sorts_spill(spark):
    conf, key = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "100")
    try:
        at = inputs.report_folder(spark, "/root/testdata/sf0.01", bad=False)
    finally:
        conf.remove(key)
    for kind in ("e0", "e1"):
        for file in pathlib.Path(at.removeprefix("file://"), kind).glob("site_id=*/*.csv"):
            with file.open(newline="") as f:
                events = [int(r["Event"]) for r in csv.DictReader(f)]
            assert events == sorted(events) and len(events) > 300

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ampledger.operators import meter, reconcile, reports, sessions
from ampledger.sources import scratch, session_reports

D = dt.date.fromisoformat


def test_one_period_is_that_of_the_roll_up(spark):
    hours = spark.range(24 * 60).select(
        F.lit(1).alias("meter_id"), F.timestamp_seconds(F.lit(1779235200) + F.col("id") * 3600).alias("ts"),
        F.col("id").alias("kwh"), F.col("id").alias("kw"), F.col("id").alias("kva"), F.lit(False).alias("repeated"),
    )
    got = meter.period_values(hours, D("2026-06-23")).collect()
    want = meter.period_rollup(meter.fill_gaps(hours)).where("period_ending = '2026-06-23'").first()
    assert len(got) == 1 and (got[0].n_hours, got[0].kwh, got[0].complete) == (744, want.kwh, True)
    assert got[0].max_kw == got[0].max_kva


def test_a_period_without_readings_names_what_the_feed_covers(spark):
    one = spark.createDataFrame([(1, dt.datetime(2026, 6, 1, 12), 1, 1, 1, False)], "meter_id int, ts timestamp, kwh long, kw long, kva long, repeated boolean")
    with pytest.raises(ValueError, match="2026-06-01 to 2026-06-01"):
        meter.period_values(one, D("2026-09-23"))
    with pytest.raises(ValueError, match="no readings"):
        meter.period_values(one.limit(0), D("2026-06-23"))
    with pytest.raises(ValueError, match="cannot close"):
        meter.period_values(one, D("2026-06-22"))
    with pytest.raises(ValueError, match="cannot close"):
        meter.period_values(one, D("2026-06-28"), 28)


def test_one_period_takes_gaps_across_its_ends(spark):
    at = ["2026-05-23 12:00", "2026-05-26 00:00", "2026-06-20 03:30", "2026-07-01 05:00"]
    hours = spark.createDataFrame([(1, dt.datetime.fromisoformat(t), 1, 1, 1, False) for t in at], "meter_id int, ts timestamp, kwh long, kw long, kva long, repeated boolean")
    got = meter.period_values(hours, D("2026-06-23"))
    want = meter.period_figures(meter.fill_gaps(hours)).where("period_ending = '2026-06-23'")
    assert got.collect() == want.collect() and got.first().n_MissingInterval > 600
    gap = meter.period_values(hours.where("ts < '2026-05-24' or ts > '2026-06-30'"), D("2026-06-23")).first()
    assert (gap.n_hours, gap.n_MissingInterval, gap.max_kw) == (0, 744, None)


def test_bands_are_held_against_the_bill_before_its_loss_factor(spark):
    metered = [(1, D("2026-06-23"), t, x) for t, x in (("OnPeak", 100.0), ("MidPeak", 50.0), ("OffHour", 1.0))]
    metered = spark.createDataFrame(metered + [(2, D("2026-06-23"), "OnPeak", 1.0)], "meter_id int, period_ending date, tou string, kwh double")
    bills = spark.createDataFrame(
        [(1, D("2026-06-23"), 102.95, 52.0, 7.0, 1.0295), (2, D("2026-06-23"), 1.0, 1.0, 1.0, 0.0)],
        "meter_id int, period_ending date, on_peak_kwh double, mid_peak_kwh double, off_peak_kwh double, loss_factor_adjustment double",
    )
    got = {(r.meter_id, r.tou): (r.agrees, r.unmatched) for r in reconcile.band_energy(metered, bills).collect()}
    assert got[1, "OnPeak"] == (True, None) and got[1, "MidPeak"] == (False, None)
    assert got[1, "OffHour"] == (None, "meter") and got[1, "OffPeak"] == (None, "bill") and got[2, "OnPeak"] == (None, None)
    assert reconcile.band_energy(metered.limit(0), bills.limit(0)).count() == 0


def test_report_lines_add_down(spark):
    row = spark.createDataFrame([(1, D("2026-06-23"), 10.0, 3.0, 4.0, 3.0)], "site_id int, period_ending date, recovery double, energy double, delivery double, surplus double")
    got = reports.lines(row, ["site_id"], ["recovery", "energy", "delivery", "surplus"], less=("energy", "delivery")).orderBy("pos").collect()
    assert [r.amount for r in got] == [10.0, -3.0, -4.0, 3.0] and sum(r.amount for r in got[:3]) == got[3].amount


def test_recovery_table_has_a_total_without_a_rate(spark):
    cols = "site_id int, period_ending date, from_date date, to_date date, on_rate double, mid_rate double, off_rate double, error string, on_kwh double, mid_kwh double, off_kwh double, recovery double"
    rows = [
        (1, D("2026-06-23"), D("2026-05-24"), D("2026-05-31"), 0.5, 0.25, 0.125, None, 2.0, 4.0, 8.0, 3.0),
        (1, D("2026-06-23"), D("2026-06-01"), D("2026-06-23"), 1.0, 1.0, 1.0, None, 1.0, 1.0, 1.0, 3.0),
        (2, D("2026-06-23"), None, None, None, None, None, "RatesNotYetInEffect", 0.0, 0.0, 0.0, None),
    ]
    df = spark.createDataFrame(rows, cols)
    got = reports.recovery_table(df).where("from_date = '2026-05-24'").collect()
    assert [(r.tou, r.kwh, r.rate, r.recovery) for r in got] == [
        ("OnPeak", 2.0, 0.5, 1.0), ("MidPeak", 4.0, 0.25, 1.0), ("OffPeak", 8.0, 0.125, 1.0), ("Total", 14.0, None, 3.0),
    ]
    totals = {(r.site_id, r.from_date and str(r.from_date)): r.recovery for r in reports.recovery_totals(df).collect()}
    assert totals == {(1, "2026-05-24"): 3.0, (1, "2026-06-01"): 3.0, (1, None): 6.0}


def test_printed_thousandths(spark):
    rng = random.Random(6)
    xs = [6.0625, 6.9, 7.0005, 7.0015, 6.9995, 1.9999999, 100.0, 6.58944, 1e6 + 0.0625] + [rng.uniform(1, 2000) for _ in range(2000)] + [rng.randrange(16_000, 9**6) / 16_000 for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", reports.printed_thousandths(F.col("x")).alias("t")).collect()
    assert all(r.t == f"{r.x:.3f}" for r in rows)


def test_orders_of_first_appearance(spark):
    met = [(1, 0, "b", 3, "x", 0, "P"), (1, 0, "a", 9, "y", 0, "Q"), (1, 0, "a", 9, "y", 1, "P"), (1, 0, "c", 1, "z", 0, "R"), (1, 1, "c", 1, "z", 0, "R")]
    met = spark.createDataFrame(met, "site_id int, interval_start int, path string, row int, id string, pos int, anomaly string")
    assert sorted((r.interval_start, r.nth, r.anomaly) for r in reports.anomaly_kinds(met).collect()) == [(0, 1, "Q"), (0, 2, "P"), (0, 3, "R"), (1, 1, "R")]
    segments = spark.createDataFrame([(1, 0, 0), (1, 0, 2), (1, 1, 0), (1, 1, 0)], "site_id int, interval_start int, members int")
    assert {r.interval_start: r.deserted for r in reports.deserted(segments).collect()} == {0: False, 1: True}
    merged = spark.createDataFrame([(1, "b", "session", 5), (1, "a", "excluded", 2), (1, "b", "spike", 3)], "site_id int, path string, bucket string, row int")
    assert [(r.nth, r.path, r.n_sessions) for r in sessions.sources(merged).orderBy("nth").collect()] == [(1, "a", 1), (2, "b", 2)]
    off = spark.createDataFrame([("a", n, ["OffGridTimes"] if n % 2 else []) for n in range(20)] + [("b", 1, [])], "path string, row long, anomalies array<string>")
    assert {r.path: (r.n_off, r.n, r.first_rows) for r in sessions.off_grid_summary(off).collect()} == {"a": (10, 20, [1, 3, 5]), "b": (0, 1, [])}


def test_peak_table_is_newest_first_and_counts_anomalies(spark):
    at = ["2026-05-26 00:00", "2026-05-26 03:00", "2026-06-24 12:30"]
    hours = spark.createDataFrame([(1, dt.datetime.fromisoformat(t), 2_000_000, 3_000_000, None, False) for t in at], "meter_id int, ts timestamp, kwh long, kw long, kva long, repeated boolean")
    rows = meter.peak_table(meter.period_figures(meter.fill_gaps(hours))).collect()
    assert len(rows[0].asDict()) == 25 and [str(r.billing_period_ending) for r in rows] == ["2026-07-23", "2026-06-23"]
    assert rows[1].anomalies.startswith("MissingKva(2),MissingInterval(") and (rows[1].nbr_of_intervals, rows[1].kwh, rows[1].max_kw) == (2, 4.0, 3.0)
    assert rows[1].max_kw_interval == dt.datetime(2026, 5, 25, 20) and rows[1].max_kw_interval_utc == dt.datetime(2026, 5, 26) and rows[0].max_kw is None


def test_intermediate_tables_need_a_shared_folder_and_can_be_cleared(spark, tmp_path):
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Cluster:
        conf = Conf
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
    kept = scratch.written(spark.range(5), "t")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert kept.count() == 5 and os.path.isdir(folder)
    before = set(os.listdir(folder))
    scratch.release(scratch.written(spark.range(3), "t"), spark.range(1))
    assert kept.count() == 5 and set(os.listdir(folder)) == before
    scratch.clear(spark)
    assert not os.path.exists(folder)


def _report(path, header, *rows):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n")


HEAD = "Charge_Session_ID,Conn_DateTime_Start,Conn_DateTime_End,Conn_Duration,Active_Charge_Time,Energy_Use"


def test_each_report_is_read_by_its_own_header(spark, tmp_path):
    _report(tmp_path / "r" / "a.csv", HEAD + ",Station_ID", 'A,2026-06-15 9:05,2026-06-15 10:05,1:00:00,0:50:00,5.5,"P, ""1"""', "", "B,2026-06-15 9:05,2026-06-15 10:05,1:00:00,0:50:00,5.5")
    _report(tmp_path / "r" / "b.csv", "Note, Energy_Use ,Active_Charge_Time,Conn_Duration,Conn_DateTime_End,Conn_DateTime_Start,Charge_Session_ID,row,PATH", '"two\nlines",5.5,0:50:00,1:00:00,2026-06-15 10:05,2026-06-15 9:05,C,77,here', ",5.5,0:50:00,1:00:00,2026-06-15 10:05,2026-06-15 9:05,D")
    _report(tmp_path / "r" / "c.csv", HEAD)
    order = spark.createDataFrame([(f"file://{tmp_path}/r/b.csv", 1), (str(tmp_path / "r" / "a.csv"), 2)], "path string, position int")
    rows = session_reports.session_reports(spark, str(tmp_path / "r"), order).orderBy("id").collect()
    assert [(r.id, r.row, r.position, r.parse_error) for r in rows] == [("A", 2, 2, None), ("B", 3, 2, None), ("C", 2, 1, None), ("D", 3, 1, None)]
    assert {(r.start_local, r.end_local, r.dur_s, r.charge_s, r.energy) for r in rows} == {(dt.datetime(2026, 6, 15, 9, 5), dt.datetime(2026, 6, 15, 10, 5), 3600, 3000, 5.5)}
    assert [r.Station_ID for r in rows] == ['P, "1"', None, None, None] and [(r.Note, r.report_row, r.report_PATH) for r in rows[2:]] == [("two\nlines", "77", "here"), (None, None, None)]
    few = session_reports.session_reports(spark, str(tmp_path / "r"), through=["Note"])
    assert "Note" in few.columns and "Station_ID" not in few.columns and few.count() == 4
    merged = session_reports.quarantine(session_reports.session_reports(spark, str(tmp_path / "r"), order))[0]
    again = merged.withColumn("id", F.lit("same")).withColumn("site_id", F.lit(1))
    first = sessions.deduplicate(sessions.flag_sessions(again)).collect()
    assert [(r.path[-5:], r.row) for r in first] == [("b.csv", 2)]
    back = order.withColumn("position", 3 - F.col("position"))
    again = session_reports.session_reports(spark, str(tmp_path / "r"), back).drop("parse_error").withColumn("id", F.lit("same")).withColumn("site_id", F.lit(1))
    merged = sessions.deduplicate(sessions.flag_sessions(again))
    assert [(r.path[-5:], r.row) for r in merged.collect()] == [("a.csv", 2)]
    assert [r.nth for r in sessions.sources(merged).collect()] == [1]


def test_a_bad_cell_refuses_its_file(spark, tmp_path):
    good = "A,2026-06-15 9:05,2026-06-15 10:05,1:00:00,0:50:00,5.5"
    _report(tmp_path / "r" / "good.csv", HEAD, good)
    _report(tmp_path / "r" / "bad.csv", HEAD, good, "B,2026-06-15 9:05,soon,1:75:00,0:50:00,5.5", "C,x,y,z,0,n/a")
    _report(tmp_path / "r" / "lacks.csv", HEAD.replace("Energy_Use", "Energy"), good)
    _report(tmp_path / "r" / "long.csv", HEAD, good + ",more")
    typed = session_reports.session_reports(spark, str(tmp_path / "r"))
    accepted, refused = session_reports.quarantine(typed)
    assert [r.path.rsplit("/", 1)[1] for r in accepted.collect()] == ["good.csv"] and "parse_error" not in accepted.columns
    assert {r.path.rsplit("/", 1)[1]: (r.first_row, r.cell) for r in refused.collect()} == {
        "bad.csv": (3, "conn_end"), "lacks.csv": (2, "missing column Energy_Use"), "long.csv": (2, "more cells than columns"),
    }
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    assert session_reports.session_reports(spark, str(tmp_path / "none")).count() == 0
    wide = session_reports.session_reports(spark, str(tmp_path / "r" / "good.csv"), max_columns=5)
    assert [r.parse_error for r in wide.collect()] == ["too many columns"]


def test_null_figures_have_no_bucket(spark):
    at = dt.datetime(2026, 6, 15, 9, 5), dt.datetime(2026, 6, 15, 10, 5)
    rows = [(1, "a", 2, "A", *at, 3600, 3600, 5.0), (1, "a", 3, "B", *at, None, 3600, 5.0), (1, "a", 4, "C", None, at[1], 3600, 3600, 5.0), (1, "a", 5, "D", *at, 3600, 0, None)]
    df = spark.createDataFrame(rows, "site_id long, path string, row long, id string, start_local timestamp_ntz, end_local timestamp_ntz, dur_s long, charge_s long, energy double")
    got = {r.id: (r.bucket, "DstUnresolvable" in r.anomalies) for r in sessions.flag_sessions(df).collect()}
    assert got == {"A": ("session", False), "B": (None, False), "C": (None, False), "D": (None, False)}


def test_no_more_columns_are_read_than_records_have(spark, tmp_path):
    good = "A,2026-06-15 9:05,2026-06-15 10:05:30,1:00:00,0:50:00,5.5"
    _report(tmp_path / "r" / "a.csv", HEAD, good)
    _report(tmp_path / "r" / "b.csv", "Note," + HEAD, '"two,\nlines, ""x""",' + good)
    typed = session_reports.session_reports(spark, str(tmp_path / "r"))
    assert {(r.Note, r.end_local.second, r.parse_error) for r in typed.collect()} == {(None, 30, None), ('two,\nlines, "x"', 30, None)}
    assert "_c6" in (plan := typed._jdf.queryExecution().toString()) and "_c20" not in plan
    _report(tmp_path / "r" / "c.csv", HEAD, good, good + ",,,,,,,,,,,,,,,,,,,x")
    assert [r.row for r in session_reports.session_reports(spark, str(tmp_path / "r")).where("parse_error = 'more cells than columns'").collect()] == [3]

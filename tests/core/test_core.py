import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, SiteConfig
from ampledger.functions import calendar as cal
from ampledger.functions import timeexpr as T
from ampledger.functions.load import site_load
from ampledger.operators import energy, estimate, meter
from ampledger.operators import sessions as S
from ampledger.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def ts(text):
    return dt.datetime.fromisoformat(text)


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    res = duck.execute(SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(got.columns)
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()]
    have = [tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()]
    assert len(have) > 0 and sorted(have, key=repr) == sorted(want, key=repr)


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_the_two_clocks(spark):
    """Just after local midnight in summer the standard date is still the day before."""
    df = one(spark, t=ts("2026-06-24 04:30:00")).select(
        F.to_date(T.local("t")).alias("loc"), T.standard_date("t").alias("std"), T.period_ending("t").alias("p"),
        T.period_start("std").cast("string").alias("x"), T.floor_to(F.timestamp_seconds(F.lit(-1)), 900).cast("string").alias("neg"),
    )
    r = df.first()
    assert (r.loc, r.std, r.p) == (dt.date(2026, 6, 24), dt.date(2026, 6, 23), dt.date(2026, 6, 23))
    assert r.neg == "1969-12-31 23:45:00"


def test_every_closing_day_tiles_the_year(spark):
    for day in (1, 15, 23, 27):
        rows = spark.range(0, 366 * 24).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("t"))
        bad = rows.withColumn("p", T.period_ending("t", day)).where((F.col("t") < T.period_start("p")) | (F.col("t") >= T.period_end("p")))
        assert bad.count() == 0


def test_holidays_of_2026_and_moved_christmas(spark):
    def of(year):
        return {(r.name, r.date, r.substitute_for) for r in cal.holidays(one(spark, year=year)).collect()}

    days = {(n, d) for n, d, s in of(2026) if s is None}
    assert days >= {
        ("Family Day", dt.date(2026, 2, 16)), ("Good Friday", dt.date(2026, 4, 3)), ("Victoria Day", dt.date(2026, 5, 18)),
        ("Civic Holiday", dt.date(2026, 8, 3)), ("Labour Day", dt.date(2026, 9, 7)), ("Thanksgiving Day", dt.date(2026, 10, 12)),
    }
    assert {("Boxing Day", dt.date(2026, 12, 28), dt.date(2026, 12, 26))} == {h for h in of(2026) if h[2]}
    assert {h[1] for h in of(2021) if h[2] and h[0] in ("Christmas Day", "Boxing Day")} == {dt.date(2021, 12, 27), dt.date(2021, 12, 28)}


def test_blocks_cover_days_once_across_the_clock_change(spark):
    days = spark.createDataFrame([(dt.date(2026, 3, d),) for d in range(6, 10)], "date date")
    blocks = sorted(tuple(r) for r in cal.tou_blocks(days, cal.holidays(one(spark, year=2026))).collect())
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(blocks, blocks[1:]))
    assert (blocks[-1][1] - blocks[0][0]).total_seconds() == (4 * 24 - 1) * 3600


def sessions(spark, rows):
    """(id, start, end, minutes connected, minutes active, energy)"""
    full = [(1, "a", k + 2, i, ts(s), ts(e), int(c * 60), int(a * 60), float(x)) for k, (i, s, e, c, a, x) in enumerate(rows)]
    return spark.createDataFrame(
        full, "site_id long, path string, row long, id string, start_local timestamp_ntz, end_local timestamp_ntz, dur_s long, charge_s long, energy double"
    )


DAY = "2026-06-15 "
DIAGRAM = [
    ("A", DAY + "15:54", DAY + "17:03", 69, 69, 6.9), ("B", DAY + "15:59", DAY + "16:15", 16, 15, 1.6),
    ("C", DAY + "16:08", DAY + "16:42", 34, 30, 3.1), ("D", DAY + "16:24", DAY + "16:34", 10, 10, 1.1),
    ("E", DAY + "16:20", DAY + "16:34", 14, 12, 1.18), ("F", DAY + "16:34", DAY + "16:42", 8, 6, 0.67),
    ("G", DAY + "16:48", DAY + "16:55", 7, 6, 0.61),
]


def test_segment_brackets_and_best_segment(spark):
    flagged = S.flag_sessions(sessions(spark, DIAGRAM))
    hour = spark.createDataFrame([(1, 1781553600, 3600)], "site_id long, interval_start long, interval_s int")
    seg = estimate.segment_aggregates(hour, flagged)
    rows = [tuple(round(r[c], 3) for c in ("count_min", "count_max", "kw_min", "kw_max")) + (r.members,) for r in seg.orderBy("seg_start").collect()]
    assert rows == [
        (2.4, 2.467, 14.88, 15.293, 3), (2.933, 3.133, 17.94, 19.2, 5), (2.8, 3.133, 17.42, 19.56, 5), (1.4, 1.533, 8.44, 9.253, 2)
    ]
    best = estimate.best_segments(estimate.estimates(seg)).first()
    got = [round(best[f"{w}_{u}_{e}"], 3) for w in ("energy", "count") for u in ("kw", "kva") for e in ("min", "max")]
    assert got == [18.383, 19.657, 18.852, 20.139, 19.787, 21.121, 20.271, 21.619]
    assert best.energy_segment == best.count_segment == ts("2026-06-15 20:15")


def test_site_load_table(spark):
    load = site_load(F.col("n"))
    got = {r.n: (round(r.kw, 2), round(r.kva, 2)) for r in spark.range(11).select(F.col("id").cast("double").alias("n"), load["kw"].alias("kw"), load["kva"].alias("kva")).collect()}
    assert got[0] == (0.35, 1.54) and got[1] == (6.95, 7.37) and got[5] == (33.61, 34.28) and got[10] == (67.5, 68.77)
    assert round(DEFAULT.rating_kw, 5) == 6.58944
    with pytest.raises(ValueError):
        SiteConfig(ev_pf=1.0)
    with pytest.raises(ValueError):
        SiteConfig(bill_end_day=28)


def test_duration_band_is_strict(spark):
    """Within (-60 s, +61 s) of the reported span; an end before the start is never sound."""
    rows = [("early out", 29.0), ("early in", 29 + 1 / 60), ("late in", 31.0), ("late out", 31 + 1 / 60)]
    made = [(i, DAY + "10:00", DAY + "10:30", m, m, 1.0) for i, m in rows] + [("inverted", DAY + "10:01", DAY + "10:00", 0, 0, 1.0)]
    got = {r.id: r.bucket for r in S.flag_sessions(sessions(spark, made)).collect()}
    assert {i for i, b in got.items() if b == "session"} == {"early in", "late in"}
    assert {i for i, b in got.items() if b == "excluded"} == {"early out", "late out", "inverted"}


def test_fold_and_gap(spark):
    made = [
        ("edt", "2026-11-01 01:10", "2026-11-01 02:10", 120, 10, 1.0),  # only the earlier instant gives the reported end
        ("est", "2026-11-01 01:10", "2026-11-01 02:10", 60, 10, 1.0),
        ("odd", "2026-11-01 01:10", "2026-11-01 05:00", 5, 5, 1.0),
        ("two", "2026-11-01 01:10", "2026-11-01 01:30", 20, 10, 1.0),
        ("gap", "2026-03-08 02:30", "2026-03-08 04:00", 30, 10, 1.0),
    ]
    got = {r.id: (r.start_utc, [a for a in r.anomalies if a.startswith("Dst")]) for r in S.flag_sessions(sessions(spark, made)).collect()}
    assert got["edt"] == (ts("2026-11-01 05:10"), []) and got["est"] == (ts("2026-11-01 06:10"), [])
    assert got["odd"] == (ts("2026-11-01 05:10"), ["DstUnresolvable"])
    assert got["two-EDT"] == (ts("2026-11-01 05:10"), ["DstAmbiguousDuplicated"])
    assert got["two-EST"] == (ts("2026-11-01 06:10"), ["DstAmbiguousDuplicated"])
    assert got["gap"] == (ts("2026-03-08 07:30"), ["DstGapShifted"])


def test_merge_keeps_the_first_and_flags_shared_ids(spark):
    a = [("X", DAY + "10:00", DAY + "10:30", 30, 30, 1.0), ("X", DAY + "10:00", DAY + "10:30", 30, 30, 1.0), ("X", DAY + "12:00", DAY + "12:30", 30, 30, 1.0)]
    nan = [("N", DAY + "10:00", DAY + "10:30", 30, 30, float("nan"))] * 2
    kept = S.deduplicate(S.flag_sessions(sessions(spark, a + nan))).collect()
    assert sorted((r.id, r.row, r.duplicate_id) for r in kept) == [("N", 5, True), ("N", 6, True), ("X", 2, True), ("X", 4, True)]


def test_band_energies_add_up(spark):
    made = [("long", "2026-06-20 09:00", "2026-06-24 09:00", 96 * 60, 600, 96.0), ("none", DAY + "10:00", DAY + "10:10", 10, 10, 0.0)]
    got = energy.energy_by_band(S.flag_sessions(sessions(spark, made))).collect()
    assert {r.period_ending for r in got} == {dt.date(2026, 6, 23)} | {dt.date(2026, 7, 23)}
    assert abs(sum(r.kwh for r in got) - 96.0) < 1e-5 and all(abs(r.kwh - r.on_kwh - r.mid_kwh - r.off_kwh) < 1e-5 for r in got)


def feed(spark, rows):
    return spark.createDataFrame([(1, u, ts(t), v, n) for n, (u, t, v) in enumerate(rows)], "meter_id long, uom int, ts timestamp, value long, doc_order long")


def test_gaps_repeats_and_flags(spark):
    rows = [(72, "2026-01-01 05:00", 1), (72, "2026-01-01 05:00", 2), (38, "2026-01-01 05:00", 7), (61, "2026-01-01 05:00", 8)]
    rows += [(72, "2026-01-01 08:30", 3), (72, "2029-01-01 00:00", 4)]
    got = {str(r.ts): (r.kwh, r.anomalies) for r in meter.fill_gaps(meter.readings(feed(spark, rows))).collect()}
    assert got == {
        "2026-01-01 05:00:00": (2, ["DuplicateInterval"]),
        "2026-01-01 06:00:00": (None, ["MissingInterval"]),
        "2026-01-01 07:00:00": (None, ["MissingInterval"]),
        "2026-01-01 08:00:00": (None, ["MissingInterval"]),
        "2026-01-01 08:30:00": (3, ["MissingKw", "MissingKva", "MisalignedInterval"]),
        "2029-01-01 00:00:00": (4, ["MissingKw", "MissingKva", "ImplausibleGap"]),
    }


def test_peaks_take_the_earliest_aligned_hour(spark):
    at = ["2026-06-15 12:00", "2026-06-15 15:00", "2026-06-15 16:30", "2026-06-15 05:00"]
    rows = [(38, t, v) for t, v in zip(at, (50, 50, 90, 60))] + [(61, at[1], 55)]
    r = meter.period_peaks(meter.readings(feed(spark, rows))).first()
    assert (r.max_kw, r.max_kw_at, r.max_kw_kva, r.max_kw_tou) == (60, ts(at[3]), None, "OffPeak")
    assert (r.max_kw_nop, r.max_kw_nop_at, r.max_kw_nop_kva, r.max_kw_nop_tou) == (50, ts(at[0]), None, "MidPeak")
    assert (r.max_kva, r.max_kva_kw) == (55, 50)


def test_no_nested_loop_or_python_in_plans(spark):
    for name, f in QUERIES.items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("NestedLoop", "Cartesian", "Python", "Pandas", "Arrow")), name


def test_empty_tables(spark):
    s = S.flag_sessions(sessions(spark, DIAGRAM).limit(0))
    assert s.count() == 0 and S.deduplicate(s).count() == 0 and energy.energy_by_band(s).count() == 0
    f = meter.fill_gaps(meter.readings(feed(spark, [(72, "2026-01-01 05:00", 1)]).limit(0)))
    assert f.count() == 0 and meter.period_peaks(f).count() == 0

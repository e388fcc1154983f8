"""The library's queries over the given tables, each beside its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, MID, OFF, ON
from ampledger.functions import calendar as cal
from ampledger.functions import timeexpr as T
from ampledger.functions.load import site_load
from ampledger.operators import energy, estimate, meter
from ampledger.operators import sessions as S
from ampledger.operators.coverage import coverage_errors, gated
from ampledger.sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def ntz(*names: str):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


TZ = "'America/Toronto'"


def sql_local(ts: str) -> str:
    return f"({ts} AT TIME ZONE 'UTC' AT TIME ZONE {TZ})"


def sql_instant(wall: str) -> str:
    return f"(({wall}) AT TIME ZONE {TZ} AT TIME ZONE 'UTC')"


def sql_ending(ts: str) -> str:
    sd = f"CAST({ts} - INTERVAL 5 HOUR AS DATE)"
    m = f"(CASE WHEN day({sd}) > 23 THEN {sd} + INTERVAL 1 MONTH ELSE {sd} END)"
    return f"make_date(CAST(year({m}) AS BIGINT), CAST(month({m}) AS BIGINT), 23)"


def sql_monday(day: str) -> str:
    return f"({day} + CAST((8 - isodow({day})) % 7 AS INTEGER))"


def sql_holidays(years: str) -> str:
    """CTEs up to ``holiday``; ``years`` selects a column y."""
    md = lambda m, d: f"make_date(y, {m}, {d})"
    rules = [
        (md(1, 1), "New Year''s Day"), (f"{sql_monday(md(2, 1))} + 14", "Family Day"),
        ("make_date(y, s // 31, s % 31 + 1) - 2", "Good Friday"), (sql_monday(md(5, 18)), "Victoria Day"),
        (md(7, 1), "Canada Day"), (sql_monday(md(8, 1)), "Civic Holiday"), (sql_monday(md(9, 1)), "Labour Day"),
        (f"{sql_monday(md(10, 1))} + 7", "Thanksgiving Day"), (md(12, 25), "Christmas Day"), (md(12, 26), "Boxing Day"),
    ]
    base = " UNION ALL ".join(f"SELECT {d} AS date, '{n}' AS name FROM easter" for d, n in rules)
    return f"""
years AS ({years}),
e1 AS (SELECT DISTINCT CAST(y AS BIGINT) AS y FROM years),
e2 AS (SELECT *, (19 * (y % 19) + y // 100 - (y // 100) // 4 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM e2),
easter AS (SELECT y, h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) + 114 AS s FROM e3),
base AS ({base}),
holiday AS (SELECT CAST(date AS DATE) AS date, CAST(NULL AS DATE) AS substitute_for, name FROM base
  UNION ALL SELECT CAST(date + CASE WHEN name IN ('Christmas Day', 'Boxing Day') OR isodow(date) = 6 THEN 2 ELSE 1 END AS DATE), CAST(date AS DATE), name
  FROM base WHERE isodow(date) >= 6)"""


def sql_band(day: str, hour: str) -> str:
    off = f"(isodow({day}) >= 6 OR {day} IN (SELECT date FROM holiday))"
    return f"""CASE WHEN {off} OR {hour} < 7 OR {hour} >= 19 THEN '{OFF}'
      WHEN (month({day}) BETWEEN 5 AND 10) = ({hour} >= 11 AND {hour} < 17) THEN '{ON}' ELSE '{MID}' END"""


METER_YEARS = "SELECT DISTINCT year(l_shipdate) + i AS y FROM lineitem, (VALUES (-1), (0), (1)) t(i)"
SHIP_YEARS = "SELECT DISTINCT year(l_shipdate) AS y FROM lineitem"


def _ship_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()


@query(f"WITH {sql_holidays(SHIP_YEARS)} SELECT * FROM holiday")
def holiday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays and substitutes of the years of the meter data."""
    return cal.holidays(_ship_years(spark, sf_dir))


_DAYS_SQL = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"


def _ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()


@query(f"""WITH {sql_holidays(SHIP_YEARS)}, {_DAYS_SQL}, hours AS (SELECT date, CAST(unnest(range(24)) AS INTEGER) AS hour FROM days)
SELECT date, hour, {sql_band("date", "hour")} AS tou FROM hours""")
def tou_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price band of every local hour of the days of the meter data."""
    return cal.tou_calendar(_ship_days(spark, sf_dir), cal.holidays(_ship_years(spark, sf_dir)))


@query(f"""WITH {sql_holidays(SHIP_YEARS)}, {_DAYS_SQL}, hours AS (SELECT date, CAST(unnest(range(24)) AS INTEGER) AS hour FROM days),
b AS (SELECT date, hour, {sql_band("date", "hour")} AS tou FROM hours),
c AS (SELECT *, CASE WHEN lag(tou) OVER w = tou AND date_diff('day', lag(date) OVER w, date) <= 1 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (ORDER BY date, hour)),
d AS (SELECT *, sum(new) OVER (ORDER BY date, hour) AS island FROM c),
e AS (SELECT island, min(tou) AS tou, min(CAST(date AS TIMESTAMP) + to_hours(hour)) AS a, max(CAST(date AS TIMESTAMP) + to_hours(hour)) + INTERVAL 1 HOUR AS z FROM d GROUP BY island)
SELECT {sql_instant("a")} AS start_utc, {sql_instant("z")} AS end_utc, tou FROM e""")
def tou_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal stretches of one band, as instants."""
    blocks = cal.tou_blocks(_ship_days(spark, sf_dir), cal.holidays(_ship_years(spark, sf_dir)))
    return blocks.select(*ntz("start_utc", "end_utc"), "tou")


@query(f"""WITH m AS (SELECT min({sql_ending("CAST(l_shipdate AS TIMESTAMP)")}) AS a, max({sql_ending("CAST(l_shipdate AS TIMESTAMP)")}) AS z FROM lineitem),
e AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS ending FROM m),
f AS (SELECT ending, CAST(ending - INTERVAL 1 MONTH AS DATE) AS prev FROM e)
SELECT ending, CAST(prev AS TIMESTAMP) + INTERVAL 29 HOUR AS start_utc, CAST(ending AS TIMESTAMP) + INTERVAL 29 HOUR AS end_utc,
  CAST(date_diff('day', prev, ending) AS BIGINT) AS days, CAST(24 * date_diff('day', prev, ending) AS BIGINT) AS hours FROM f""")
def billing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The billing periods that the meter data spans."""
    ends = A.read(spark, sf_dir, "lineitem").agg(
        F.min(T.period_ending("l_shipdate")).alias("a"), F.max(T.period_ending("l_shipdate")).alias("z")
    )
    listed = ends.select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("ending"))
    return listed.select("ending", *cal._span("ending")).select("ending", *ntz("start_utc", "end_utc"), "days", "hours")


@query(f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, ts, ts - to_seconds(epoch(ts)::BIGINT % 900) AS segment, epoch(ts)::BIGINT % 3600 = 0 AS on_hour,
  {sql_local("ts")} AS local_time, CAST(ts - INTERVAL 5 HOUR AS DATE) AS standard_date, {sql_ending("ts")} AS period_ending
FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) + to_seconds((l_orderkey * 997 + l_linenumber * 61) % 86400) AS ts FROM lineitem)""")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, local time, standard date and billing period of an instant of every line."""
    shift = (F.col("l_orderkey") * 997 + F.col("l_linenumber") * 61) % 86400
    rows = A.read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("line"),
        F.timestamp_seconds(T.seconds("l_shipdate") + shift).alias("ts"),
    )
    return rows.select(
        "l_orderkey", "line", *ntz("ts"), T.floor_to("ts", 900).cast("timestamp_ntz").alias("segment"),
        T.on_grid("ts", 3600).alias("on_hour"), T.local("ts").alias("local_time"),
        T.standard_date("ts").alias("standard_date"), T.period_ending("ts").alias("period_ending"),
    )


WIDE_SQL = f"""{A.SERIES_SQL},
wide AS (SELECT meter_id, ts,
    first(value ORDER BY doc_order DESC, value DESC) FILTER (uom = 72) AS kwh, first(value ORDER BY doc_order DESC, value DESC) FILTER (uom = 38) AS kw,
    first(value ORDER BY doc_order DESC, value DESC) FILTER (uom = 61) AS kva,
    greatest(count(*) FILTER (uom = 72), count(*) FILTER (uom = 38), count(*) FILTER (uom = 61)) > 1 AS repeated
  FROM series GROUP BY meter_id, ts)"""

FILLED_SQL = f"""{WIDE_SQL},
seen AS (SELECT *, lag(ts) OVER (PARTITION BY meter_id ORDER BY ts) AS before FROM wide),
gaps AS (SELECT *, CAST(epoch(ts) AS BIGINT) - CAST(epoch(before) AS BIGINT) AS gap_s FROM seen),
filled AS (SELECT meter_id, ts, kwh, kw, kva, list_filter([
      CASE WHEN kwh IS NULL THEN 'MissingKwh' END, CASE WHEN kw IS NULL THEN 'MissingKw' END, CASE WHEN kva IS NULL THEN 'MissingKva' END,
      CASE WHEN repeated THEN 'DuplicateInterval' END, CASE WHEN epoch(ts)::BIGINT % 3600 <> 0 THEN 'MisalignedInterval' END,
      CASE WHEN gap_s // 3600 > 17520 THEN 'ImplausibleGap' END], lambda x: x IS NOT NULL) AS anomalies FROM gaps
  UNION ALL
  SELECT meter_id, unnest(generate_series(before + INTERVAL 1 HOUR, ts - INTERVAL 1 SECOND, INTERVAL 1 HOUR)), NULL, NULL, NULL, ['MissingInterval']
  FROM gaps WHERE gap_s > 3600 AND gap_s // 3600 <= 17520)"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter.fill_gaps(meter.readings(A.series(spark, sf_dir)))


@query(f"""WITH {FILLED_SQL} SELECT meter_id, ts, kwh / 1000000.0::DOUBLE AS kwh, kw / 1000000.0::DOUBLE AS kw, kva / 1000000.0::DOUBLE AS kva,
  array_to_string(anomalies, ',') AS anomalies FROM filled""")
def interval_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of every meter, gaps filled, in kWh, kW and kVA, with its anomalies; newest first."""
    scaled = [(F.col(c) / meter.SCALE).alias(c) for c in meter.UOM]
    rows = _filled(spark, sf_dir).select("meter_id", *ntz("ts"), *scaled, F.array_join("anomalies", ",").alias("anomalies"))
    return rows.orderBy(F.desc("ts"), "meter_id")


@query(f"""WITH {A.POWERED_SQL}, w AS (SELECT meter_id, uom, ts, first(value ORDER BY doc_order DESC, value DESC) / pow(10, 3 - first(power_of_ten)) AS v FROM powered GROUP BY meter_id, uom, ts)
SELECT meter_id, round(sum(v) FILTER (uom = 72), 6) AS kwh, round(max(v) FILTER (uom = 38), 6) AS max_kw, round(max(v) FILTER (uom = 61), 6) AS max_kva FROM w GROUP BY meter_id""")
def scaled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy and maxima of meters whose feeds state values in different powers of ten."""
    wide = meter.readings(A.powered_series(spark, sf_dir))
    shown = lambda c, name: F.round(c / meter.SCALE, 6).alias(name)
    return wide.groupBy("meter_id").agg(shown(F.sum("kwh"), "kwh"), shown(F.max("kw"), "max_kw"), shown(F.max("kva"), "max_kva"))


def _sql_peak(name: str, value: str, companion: str, ok: str) -> str:
    ranked = f"FILTER ({ok} AND {value} IS NOT NULL)"
    order = f"({value}::HUGEINT * 100000000000 - epoch(ts)::BIGINT)"
    return f"""max({value}) {ranked} AS {name}, max_by(ts, {order}) {ranked} AS {name}_at,
    first({companion} ORDER BY {order} DESC) {ranked} AS {name}_{companion}, max_by(tou, {order}) {ranked} AS {name}_tou"""


BANDED_SQL = f"""{WIDE_SQL}, {sql_holidays(METER_YEARS)},
lt AS (SELECT *, {sql_local("ts")} AS wall FROM wide WHERE kw IS NOT NULL OR kva IS NOT NULL),
ld AS (SELECT *, CAST(wall AS DATE) AS d, hour(wall) AS h FROM lt),
banded AS (SELECT *, CASE WHEN epoch(ts)::BIGINT % 3600 = 0 THEN {sql_band("d", "h")} END AS tou, {sql_ending("ts")} AS period_ending FROM ld)"""


@query(f"""WITH {BANDED_SQL} SELECT meter_id, period_ending, {_sql_peak("max_kw", "kw", "kva", "tou IS NOT NULL")},
  {_sql_peak("max_kw_nop", "kw", "kva", "tou <> 'OffPeak'")}, {_sql_peak("max_kva", "kva", "kw", "tou IS NOT NULL")},
  {_sql_peak("max_kva_nop", "kva", "kw", "tou <> 'OffPeak'")} FROM banded GROUP BY meter_id, period_ending""")
def period_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four demand maxima of each meter and billing period; placeholders hold no value, so gaps need no filling here."""
    return meter.period_peaks(meter.readings(A.series(spark, sf_dir)))


_FLAGS = meter.FLAGS


@query(f"""WITH {FILLED_SQL}, p AS (SELECT *, {sql_ending("ts")} AS period_ending FROM filled),
g AS (SELECT meter_id, period_ending, count(*) FILTER (kwh IS NOT NULL OR kw IS NOT NULL OR kva IS NOT NULL) AS n_hours,
  count(*) FILTER ((kwh IS NOT NULL OR kw IS NOT NULL OR kva IS NOT NULL) AND epoch(ts)::BIGINT % 3600 = 0) AS n_aligned, sum(kwh) AS kwh_raw,
  {", ".join(f"count(*) FILTER (list_contains(anomalies, '{f}')) AS n_{f}" for f in _FLAGS)} FROM p GROUP BY meter_id, period_ending),
x AS (SELECT *, CAST(24 * date_diff('day', CAST(period_ending - INTERVAL 1 MONTH AS DATE), period_ending) AS BIGINT) AS expected_hours FROM g)
SELECT meter_id, period_ending, n_hours, expected_hours, n_hours = expected_hours AS complete,
  n_aligned = expected_hours AND n_MissingInterval = 0 AS complete_strict, round(CAST(kwh_raw AS DOUBLE) / 1000000, 6) AS kwh,
  {", ".join(f"n_{f}" for f in _FLAGS)} FROM x""")
def period_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, energy, completeness and anomaly counts of each meter and billing period."""
    return meter.period_rollup(_filled(spark, sf_dir))


ONE_PERIOD = dt.date(1998, 6, 23)


@query(f"""WITH r AS ({SQL["period_rollup"]}), p AS ({SQL["period_peaks"]}) SELECT * FROM r LEFT JOIN p USING (meter_id, period_ending) WHERE period_ending = DATE '{ONE_PERIOD}'""")
def period_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the period that closes on one date, as a bill's reader asks for them."""
    return meter.period_values(meter.readings(A.series(spark, sf_dir)), ONE_PERIOD)


@query(f"""WITH {WIDE_SQL}, k AS (SELECT meter_id, kwh, unnest([
    {{'rule': 'est', 'd': CAST(ts - INTERVAL 5 HOUR AS DATE)}}, {{'rule': 'prevailing', 'd': CAST({sql_local("ts")} AS DATE)}},
    {{'rule': 'edt', 'd': CAST(ts - INTERVAL 4 HOUR AS DATE)}}]) AS r FROM wide),
m AS (SELECT meter_id, kwh, r.rule AS rule, CASE WHEN day(r.d) > 23 THEN r.d + INTERVAL 1 MONTH ELSE r.d END AS m FROM k),
g AS (SELECT rule, meter_id, make_date(CAST(year(m) AS BIGINT), CAST(month(m) AS BIGINT), 23) AS period_ending, CAST(sum(kwh) AS BIGINT) AS kwh_raw FROM m GROUP BY ALL)
SELECT g.*, CAST(g.kwh_raw - f.kwh_raw AS BIGINT) AS off_by FROM g LEFT JOIN (SELECT * FROM g WHERE rule = 'est') f USING (meter_id, period_ending)""")
def boundary_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period energy under three boundary rules."""
    return meter.boundary_sweep(meter.readings(A.series(spark, sf_dir)))


def _sql_group(name: str, other: str) -> str:
    scale = "/ 1000000.0::DOUBLE"
    return f"""{name} {scale} AS {name}, {sql_local(f"{name}_at")} AS {name}_interval, {name}_at AS {name}_interval_utc, {name}_{other} {scale} AS {name}_{other}, {name}_tou"""


@query(f"""WITH r AS ({SQL["period_rollup"]}), p AS ({SQL["period_peaks"]}) SELECT meter_id, period_ending AS billing_period_ending, n_hours AS nbr_of_intervals, kwh,
  {_sql_group("max_kw", "kva")}, {_sql_group("max_kw_nop", "kva")}, {_sql_group("max_kva", "kw")}, {_sql_group("max_kva_nop", "kw")},
  concat_ws(',', {", ".join(f"CASE WHEN n_{f} > 0 THEN '{f}(' || n_{f} || ')' END" for f in _FLAGS)}) AS anomalies FROM r LEFT JOIN p USING (meter_id, period_ending)""")
def peak_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a meter and period, newest first: hours, energy, the four maxima on both clocks, anomalies."""
    return meter.peak_table(meter.period_figures(_filled(spark, sf_dir)))


_READ_SPAN = f"""SELECT CAST(min({sql_local("ts")}) AS DATE) AS a, CAST(max({sql_local("ts")}) AS DATE) AS z FROM series WHERE uom = 72"""


@query(f"""WITH {A.SERIES_SQL}, span AS ({_READ_SPAN}), {sql_holidays("SELECT unnest(range(year(a), year(z) + 1)) AS y FROM span")}
SELECT date, substitute_for, name FROM holiday WHERE date BETWEEN (SELECT a FROM span) AND (SELECT z FROM span)""")
def holidays_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holidays between the first and the last energy reading, with what they are observed for."""
    first, last = A.series(spark, sf_dir).where("uom = 72").agg(F.to_date(T.local(F.min("ts"))), F.to_date(T.local(F.max("ts")))).first()
    return cal.holidays_between(spark, first, last)


@query(f"""WITH s AS ({SQL["boundary_sweep"]}), b AS (SELECT meter_id, period_ending, round(kwh_raw / 1000000.0::DOUBLE, 3) + CASE WHEN meter_id % 4 = 1 THEN 0.05 ELSE 0 END AS kwh FROM s WHERE rule = 'est'),
d AS (SELECT rule, abs(kwh_raw / 1000000.0::DOUBLE - kwh) AS off FROM s JOIN b USING (meter_id, period_ending))
SELECT rule, count(*) AS n_periods, count(*) FILTER (off <= 0.001) AS n_matches, round(avg(off), 6) AS mean_abs_error, round(max(off), 6) AS worst FROM d GROUP BY rule""")
def boundary_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each boundary rule reproduces bills, which are cut at UTC-5, printed to three decimals and wrong for some meters."""
    swept = meter.boundary_sweep(meter.readings(A.series(spark, sf_dir)))
    wrong = F.when(F.col("meter_id") % 4 == 1, 0.05).otherwise(0.0)
    printed = swept.where("rule = 'est'").select("meter_id", "period_ending", (F.round(F.col("kwh_raw") / meter.SCALE, 3) + wrong).alias("kwh"))
    fit = meter.boundary_fit(swept, printed)
    return fit.select("rule", "n_periods", "n_matches", *(F.round(c, 6).alias(c) for c in ("mean_abs_error", "worst")))


@query(f"""WITH {FILLED_SQL}, n AS (SELECT meter_id, {sql_ending("ts")} AS p, count(*) FILTER (kwh IS NOT NULL OR kw IS NOT NULL OR kva IS NOT NULL) AS n FROM filled GROUP BY ALL)
SELECT count(*) AS "rows", count(DISTINCT (meter_id, {sql_ending("ts")})) AS periods,
  (SELECT count(*) FROM n WHERE n <> 24 * date_diff('day', CAST(p - INTERVAL 1 MONTH AS DATE), p)) AS incomplete_periods,
  {", ".join(f"count(*) FILTER (list_contains(anomalies, '{f}')) AS n_{f}" for f in _FLAGS)},
  CAST(min({sql_local("ts")}) AS DATE) AS first_date, CAST(max({sql_local("ts")}) AS DATE) AS last_date FROM filled""")
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, periods, incomplete ones, anomaly counts and covered local dates of the whole feed."""
    rows = _filled(spark, sf_dir).withColumn("p", T.period_ending("ts"))
    per = rows.groupBy("meter_id", "p").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("kwh").isNotNull() | F.col("kw").isNotNull() | F.col("kva").isNotNull()).alias("n_hours"),
        *(F.count_if(F.array_contains("anomalies", f)).alias(f"n_{f}") for f in _FLAGS),
        F.min("ts").alias("a"),
        F.max("ts").alias("z"),
    )
    return per.agg(
        F.sum("rows").alias("rows"), F.count("*").alias("periods"),
        F.count_if(F.col("n_hours") != 24 * F.datediff("p", F.add_months("p", -1))).alias("incomplete_periods"), *(F.sum(f"n_{f}").alias(f"n_{f}") for f in _FLAGS),
        F.to_date(T.local(F.min("a"))).alias("first_date"), F.to_date(T.local(F.max("z"))).alias("last_date"),
    )


RATE = repr(DEFAULT.rating_kw)


def flagged_sql(repeats: bool = False) -> str:
    """CTE ``f``; folds and gaps do not occur in the table's month, and are tested on small tables."""
    return f"""{A.sessions_sql(repeats)},
u AS (SELECT *, {sql_instant("start_local")} AS start_utc, {sql_instant("end_local")} AS end_utc FROM s),
v AS (SELECT *, CAST(epoch(start_utc) AS BIGINT) AS a, CAST(epoch(end_utc) AS BIGINT) AS b FROM u),
w AS (SELECT *, a - a % 60 AS adj_start, (b + 1) - (b + 1) % 60 + 60 AS adj_end,
    a <= b AND a + dur_s < b + 61 AND b - 60 < a + dur_s AS fits,
    CASE WHEN charge_s = 0 THEN CASE WHEN energy = 0 THEN 0.0 ELSE {RATE} END ELSE energy / charge_s * 3600 END AS avg_kw FROM v),
f AS (SELECT *, list_filter([CASE WHEN charge_s = 0 THEN 'ZeroActiveChargeTime' END,
      CASE WHEN charge_s <> 0 AND energy / (charge_s / 3600) > {RATE} THEN 'ExcessiveAvgKw' END,
      CASE WHEN NOT fits THEN 'InconsistentDuration' END,
      CASE WHEN a % 60 <> 0 OR b % 60 <> 0 THEN 'OffGridTimes' END], lambda x: x IS NOT NULL) AS anomalies,
    CASE WHEN NOT fits THEN 'excluded' WHEN charge_s = 0 THEN 'spike' ELSE 'session' END AS bucket FROM w)"""


DEDUP_SQL = f"""{flagged_sql(True)},
nth AS (SELECT *, row_number() OVER (PARTITION BY site_id, id, adj_start, adj_end, charge_s, energy
    ORDER BY path, CASE bucket WHEN 'session' THEN 0 WHEN 'spike' THEN 1 ELSE 2 END, "row") AS nth FROM f),
d AS (SELECT *, count(*) OVER (PARTITION BY site_id, id) > 1 AS duplicate_id FROM nth WHERE nth = 1)"""


def _flagged(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    return S.flag_sessions(A.sessions(spark, sf_dir, repeats))


@query(f"""WITH {flagged_sql()} SELECT site_id, path, "row", id, start_utc, end_utc, make_timestamp(adj_start * 1000000) AS adj_start,
  make_timestamp(adj_end * 1000000) AS adj_end, avg_kw, array_to_string(anomalies, ',') AS anomalies, bucket FROM f""")
def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session with its instants, adjusted span, mean power, anomalies and bucket."""
    f = _flagged(spark, sf_dir)
    spans = [F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("adj_start", "adj_end")]
    return f.select(
        "site_id", "path", "row", "id", *ntz("start_utc", "end_utc"), *spans, "avg_kw",
        F.array_join("anomalies", ",").alias("anomalies"), "bucket",
    )


@query(f"""WITH {DEDUP_SQL} SELECT site_id, id, path, "row", bucket, duplicate_id FROM d""")
def session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of three report files merged, repeats dropped, shared ids flagged."""
    return S.deduplicate(_flagged(spark, sf_dir, True)).select("site_id", "id", "path", "row", "bucket", "duplicate_id")


@query(f"""WITH {flagged_sql()} SELECT site_id, CAST(min({sql_local("start_utc")}) AS DATE) AS first_date, CAST(max({sql_local("end_utc")}) AS DATE) AS last_date,
  count(*) FILTER (bucket = 'session') AS n_session, count(*) FILTER (bucket = 'spike') AS n_spike, count(*) FILTER (bucket = 'excluded') AS n_excluded
  FROM f GROUP BY site_id""")
def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered dates and bucket sizes of each site."""
    return S.coverage(_flagged(spark, sf_dir))


#: CTEs up to ``parts``: kWh by site, period, local date and band.
PARTS_SQL = f"""{DEDUP_SQL},
spread AS (SELECT site_id, adj_start, adj_end, energy FROM d WHERE bucket <> 'excluded' AND adj_end > adj_start),
hrs AS (SELECT *, unnest(range(adj_start - adj_start % 3600, adj_end, 3600)) AS h FROM spread),
{sql_holidays("SELECT DISTINCT year(ts) + i AS y FROM events, (VALUES (-1), (0), (1)) t(i)")},
pieces AS (SELECT *, make_timestamp(h * 1000000) AS ts, energy * (least(adj_end, h + 3600) - greatest(adj_start, h)) / (adj_end - adj_start) AS kwh FROM hrs),
lh AS (SELECT *, {sql_local("ts")} AS l FROM pieces),
ldh AS (SELECT *, CAST(l AS DATE) AS ld, hour(l) AS hr FROM lh),
parts AS (SELECT site_id, {sql_ending("ts")} AS period_ending, ld, kwh, {sql_band("ld", "hr")} AS tou FROM ldh)"""

BAND_SUMS = """coalesce(sum(kwh) FILTER (tou = 'OnPeak'), 0) AS on_kwh, coalesce(sum(kwh) FILTER (tou = 'MidPeak'), 0) AS mid_kwh,
  coalesce(sum(kwh) FILTER (tou = 'OffPeak'), 0) AS off_kwh"""


@query(f"""WITH {PARTS_SQL}, {A.GATE_SQL}, sums AS (SELECT site_id, period_ending, {BAND_SUMS}, sum(kwh) AS kwh FROM parts GROUP BY site_id, period_ending)
SELECT site_id, period_ending, {", ".join(f"CASE WHEN refused IS NULL THEN round({c}, 6) END AS {c}" for c in ("on_kwh", "mid_kwh", "off_kwh", "kwh"))}, refused AS error
FROM sums LEFT JOIN gate USING (site_id, period_ending)""")
def ev_energy_by_tou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charging energy of each site and billing period by price band, from merged sessions that are not excluded; none where reports leave days out."""
    merged = S.deduplicate(_flagged(spark, sf_dir, True)).where("bucket <> 'excluded'")
    found = energy.energy_by_band(merged)
    return gated(found, coverage_errors(A.site_reports(spark, sf_dir), found), ["on_kwh", "mid_kwh", "off_kwh", "kwh"])


def segments_sql(intervals: str) -> str:
    """CTEs up to ``sa`` for the query ``intervals(site_id, interval_start)``."""
    return f"""
live AS (SELECT site_id, adj_start, adj_end, avg_kw FROM d WHERE bucket <> 'excluded' AND adj_end > adj_start),
iv AS ({intervals}),
sg AS (SELECT *, unnest(range(interval_start, interval_start + 3600, 900)) AS seg_start FROM iv),
ov AS (SELECT sg.*, avg_kw, greatest(adj_start, seg_start) AS x, least(adj_end, seg_start + 900) AS y, adj_start, adj_end
  FROM sg JOIN live ON live.site_id = sg.site_id AND adj_start < seg_start + 900 AND adj_end > seg_start),
br AS (SELECT *, CAST(greatest(0, y - CASE WHEN adj_end = y THEN 60 ELSE 0 END - x - CASE WHEN adj_start = x THEN 60 ELSE 0 END) AS DOUBLE) / 900 AS lo, CAST(y - x AS DOUBLE) / 900 AS hi FROM ov),
ag AS (SELECT site_id, interval_start, seg_start, sum(lo) AS count_min, sum(hi) AS count_max, sum(lo * avg_kw) AS kw_min, sum(hi * avg_kw) AS kw_max, count(*) AS members FROM br GROUP BY ALL),
sa AS (SELECT site_id, interval_start, seg_start, coalesce(count_min, 0) AS count_min, coalesce(count_max, 0) AS count_max, coalesce(kw_min, 0) AS kw_min, coalesce(kw_max, 0) AS kw_max,
  coalesce(members, 0) AS members FROM sg LEFT JOIN ag USING (site_id, interval_start, seg_start))"""


ASKED_SQL = f"""SELECT DISTINCT user_id % {A.SITES} AS site_id, CAST(epoch({sql_instant("CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR")}) AS BIGINT) AS interval_start FROM events"""
SEGMENTS_SQL = f"{DEDUP_SQL}, {segments_sql(ASKED_SQL)}"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = S.deduplicate(_flagged(spark, sf_dir, True)).where("bucket <> 'excluded'")
    hour = T.instant(F.to_date("ts").cast("timestamp") + F.expr("interval 16 hours"))
    asked = A.read(spark, sf_dir, "events").select(
        (F.col("user_id") % A.SITES).alias("site_id"), F.unix_seconds(hour).alias("interval_start"), F.lit(3600).alias("interval_s")
    )
    return estimate.segment_aggregates(asked.distinct(), merged)


@query(f"""WITH {SEGMENTS_SQL} SELECT site_id, make_timestamp(interval_start * 1000000) AS interval_start, make_timestamp(seg_start * 1000000) AS seg_start,
  round(count_min, 6) AS count_min, round(count_max, 6) AS count_max, round(kw_min, 6) AS kw_min, round(kw_max, 6) AS kw_max, members FROM sa""")
def segment_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed vehicle count and kW of the four segments of 16:00-17:00 local, each site and day."""
    stamps = [F.timestamp_seconds(c).cast("timestamp_ntz").alias(c) for c in ("interval_start", "seg_start")]
    figures = [F.round(c, 6).alias(c) for c in ("count_min", "count_max", "kw_min", "kw_max")]
    return _segments(spark, sf_dir).select("site_id", *stamps, *figures, "members")


def _sql_load(n: str) -> tuple[str, str]:
    """kW and kVA of n vehicles."""
    c = DEFAULT
    kw, q, d = f"({n}) * {c.rating_kw!r}", f"({n}) * {c.ev_kvar!r}", f"({n}) * {c.ev_distortion!r}"
    x2 = f"pow(sqrt(pow({kw}, 2) + pow({q}, 2) + pow({d}, 2)) / {c.xfmr_kva!r}, 2)"
    all_kw = f"({kw} + {c.no_load_kw!r} + {c.full_load_kw!r} * {x2})"
    all_q = f"({q} + {c.magnetizing_pu * c.xfmr_kva!r} + {c.reactance_pu * c.xfmr_kva!r} * {x2})"
    return f"{all_kw}::DOUBLE", f"sqrt(pow({all_kw}, 2) + pow({all_q}, 2) + pow({d}, 2))::DOUBLE"


def _sql_estimates() -> str:
    out = []
    for way in ("energy", "count"):
        for end in ("min", "max"):
            kw, kva = _sql_load(f"kw_{end}::DOUBLE / {RATE}" if way == "energy" else f"count_{end}::DOUBLE")
            out += [f"{kw} AS {way}_kw_{end}", f"{kva} AS {way}_kva_{end}"]
    return ", ".join(out)


def _sql_best(shown: str = "round({}, 6)") -> str:
    out = []
    for way, by in (("energy", "kw"), ("count", "count")):
        order = f"ORDER BY round({by}_min + {by}_max, 9) DESC, seg_start"
        out.append(f"make_timestamp(first(seg_start {order}) * 1000000) AS {way}_segment")
        out += [f"{shown.format(f'first({way}_{u}_{e} {order})')} AS {way}_{u}_{e}" for u in ("kw", "kva") for e in ("min", "max")]
    return ", ".join(out)


@query(f"""WITH {SEGMENTS_SQL}, es AS (SELECT *, {_sql_estimates()} FROM sa)
SELECT site_id, make_timestamp(interval_start * 1000000) AS interval_start, {_sql_best()} FROM es GROUP BY site_id, interval_start""")
def best_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of each hour that charging loaded most, by energy and by count, with its load estimates."""
    return estimate.best_segments(estimate.estimates(_segments(spark, sf_dir)))


@query(f"""WITH {A.sessions_sql()}, n AS (SELECT site_id, CAST(start_local AS DATE) AS date, CAST(count(*) % 11 AS DOUBLE) AS vehicles FROM s GROUP BY ALL)
SELECT site_id, date, vehicles, round({_sql_load("vehicles")[0]}, 6) AS kw, round({_sql_load("vehicles")[1]}, 6) AS kva,
  round({_sql_load("vehicles")[0]} / {_sql_load("vehicles")[1]}, 6) AS pf FROM n""")
def site_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load at the transformer for a number of vehicles drawn from each site and day."""
    n = A.sessions(spark, sf_dir).groupBy("site_id", F.to_date("start_local").alias("date")).agg((F.count("*") % 11).cast("double").alias("vehicles"))
    load = site_load(F.col("vehicles"))
    return n.select("site_id", "date", "vehicles", *(F.round(load[c], 6).alias(c) for c in ("kw", "kva", "pf")))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.LABELS.items())


@query(f"""SELECT o_custkey % {A.SITES} AS site_id, {sql_ending("CAST(o_orderdate AS TIMESTAMP)")} AS period_ending,
  {", ".join(f"round(sum(CASE WHEN label = '{v}' THEN o_totalprice ELSE 0 END), 2) AS {v.lower().replace(' ', '_')}" for v in A.LABELS.values())},
  round(sum(o_totalprice), 2) AS total FROM (SELECT *, CASE o_orderpriority {_CASES} END AS label FROM orders) GROUP BY 1, 2""")
def bill_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge lines of each site and billing period, repeated labels added together."""
    lines = A.bill_lines(spark, sf_dir).withColumn("period_ending", T.period_ending("ts"))
    each = [
        F.round(F.sum(F.when(F.col("label") == v, F.col("amount")).otherwise(0.0)), 2).alias(v.lower().replace(" ", "_"))
        for v in A.LABELS.values()
    ]
    return lines.groupBy("site_id", "period_ending").agg(*each, F.round(F.sum("amount"), 2).alias("total"))

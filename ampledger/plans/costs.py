"""Queries over bills, costs, recovery, requests, reports and reconciliation, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.operators import bills as B
from ampledger.operators import costs as C
from ampledger.operators import coverage as V
from ampledger.operators import energy, meter, reconcile, reports
from ampledger.operators import sessions as S
from ampledger.operators.requests import checked_intervals
from ampledger.plans import core as K
from ampledger.sources import adapters as A
from ampledger.sources.files import DERIVED, reread
from ampledger.sources.files import session_table as session_columns
from ampledger.sources.scratch import written
from ampledger.sources.session_reports import type_sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}

_BAND_ROWS = (("OnPeak", "on"), ("MidPeak", "mid"), ("OffPeak", "off"))


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def sql_six(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deduplicate(K._flagged(spark, sf_dir, True))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).where("bucket <> 'excluded'")


BILLS_SQL = A.bills_sql(K.sql_ending("ts"))


@query(f"""WITH {A.sessions_sql()} SELECT "row", path, start_local, end_local, CASE WHEN "row" % 97 <> 0 THEN dur_s END AS dur_s, charge_s,
  CASE WHEN "row" % 101 <> 0 THEN round(energy, 6) END AS energy,
  CASE WHEN "row" % 97 = 0 THEN 'conn_duration' WHEN "row" % 101 = 0 THEN 'energy_use' END AS parse_error FROM s""")
def session_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of every session row, typed, with the first bad cell named."""
    rows = type_sessions(A.raw_sessions(spark, sf_dir))
    return rows.select("row", "path", "start_local", "end_local", "dur_s", "charge_s", *six("energy"), "parse_error")


@query(f"""WITH {K.flagged_sql()}, o AS (SELECT path, "row" AS r, list_contains(anomalies, 'OffGridTimes') AS off FROM f)
SELECT path, count(*) FILTER (off) AS n_off, count(*) AS n, coalesce(array_to_string(list_sort(list(r) FILTER (off))[1:3], ','), '') AS first_rows FROM o GROUP BY path""")
def off_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows off the minute grid of each report file."""
    out = S.off_grid_summary(K._flagged(spark, sf_dir))
    return out.withColumn("first_rows", F.array_join(F.transform("first_rows", lambda x: x.cast("string")), ","))


@query(f"""WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS k, l_linenumber AS n,
    CAST(l_shipdate AS TIMESTAMP) + to_seconds((l_orderkey * 7 + l_linenumber * 5) % 24 * 3600 + [0, 0, 15, 30, 45, 7][l_orderkey % 6 + 1] * 60 + CASE WHEN l_orderkey % 11 = 0 THEN 30 ELSE 0 END) AS wall FROM lineitem),
c AS (SELECT *, CASE n % 3 WHEN 1 THEN 3600 WHEN 2 THEN 900 ELSE CASE WHEN minute(wall) = 0 THEN 3600 ELSE 900 END END AS len,
    CASE k % 4 WHEN 1 THEN 'EST' WHEN 2 THEN 'EDT' END AS want,
    {K.sql_local("(wall + INTERVAL 5 HOUR)")} = wall AS est, {K.sql_local("(wall + INTERVAL 4 HOUR)")} = wall AS edt FROM q),
e AS (SELECT *, CASE WHEN second(wall) <> 0 THEN 'CarriesSeconds' WHEN minute(wall) % 15 <> 0 THEN 'OffQuarterHour' WHEN len = 3600 AND minute(wall) <> 0 THEN 'HourNotOnTheHour'
    WHEN NOT est AND NOT edt THEN 'NeverOccurred' WHEN est AND edt AND want IS NULL THEN 'OccursTwice'
    WHEN (want = 'EST' AND NOT est) OR (want = 'EDT' AND NOT edt) THEN 'WrongDesignator' END AS error FROM c)
SELECT request_id, CASE WHEN error IS NULL THEN wall + CASE WHEN want = 'EST' OR (want IS NULL AND est) THEN INTERVAL 5 HOUR ELSE INTERVAL 4 HOUR END END AS start_utc,
  CASE WHEN error IS NULL THEN CAST(len AS BIGINT) END AS length_s, error FROM e""")
def interval_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested wall times resolved to instants, or the rule they break."""
    return checked_intervals(A.requests(spark, sf_dir)).withColumn("start_utc", F.col("start_utc").cast("timestamp_ntz"))


_NOON = "CAST({} AS TIMESTAMP) + INTERVAL 12 HOUR"


@query(f"""WITH n AS (SELECT o_custkey AS site_id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 150 AS INTEGER) AS z, o_orderkey % 13 <> 0 AS good FROM orders),
per AS (SELECT DISTINCT site_id, {K.sql_ending(f"({_NOON.format('a')})")} AS period_ending FROM n),
good AS (SELECT site_id, a, z FROM n WHERE good),
days AS (SELECT DISTINCT site_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM good),
cov AS (SELECT site_id, {K.sql_ending(f"({_NOON.format('d')})")} AS period_ending, count(*) AS n FROM days GROUP BY ALL)
SELECT site_id, period_ending, coalesce(n = date_diff('day', CAST(period_ending - INTERVAL 1 MONTH AS DATE), period_ending), false) AS covered FROM per LEFT JOIN cov USING (site_id, period_ending)""")
def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the dates that report names state cover each period in which an account has a report."""
    named = V.report_dates(A.report_names(spark, sf_dir))
    noon = F.timestamp_seconds(F.unix_seconds(F.col("first").cast("timestamp")) + 12 * 3600)
    periods = named.select("site_id", K.T.period_ending(noon).alias("period_ending")).distinct()
    return V.covered_periods(V.islands(named), periods)


_O = "sum(CASE WHEN o_orderpriority = '{}' THEN {} ELSE 0 END)"


@query(f"""SELECT CAST(o_custkey AS VARCHAR) || '/' || CAST({K.sql_ending("CAST(o_orderdate AS TIMESTAMP)")} AS VARCHAR) AS bill_id,
  round({_O.format("5-LOW", "o_orderkey % 5000 + 1000")}::DOUBLE, 2) AS off_peak_kwh, round({_O.format("5-LOW", "o_totalprice")}, 2) AS off_peak_cost,
  round({_O.format("2-HIGH", "o_totalprice")}, 2) AS distribution_charges, round({_O.format("1-URGENT", "o_totalprice")}, 2) AS transmission_connection_charge,
  round({_O.format("3-MEDIUM", "o_totalprice")}, 2) AS transmission_network_charge, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS n_errors FROM orders GROUP BY 1""")
def bill_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed charge lines read, classified and added up by bill."""
    rows = B.roll_up(B.classify(A.bill_text(spark, sf_dir)))
    shown = ("off_peak_kwh", "off_peak_cost", "distribution_charges", "transmission_connection_charge", "transmission_network_charge")
    return rows.select("bill_id", *(F.round(c, 2).alias(c) for c in shown), "n_errors")


@query(f"""WITH {BILLS_SQL} SELECT site_id, period_ending, round(total_electricity_charges + hst - ontario_electricity_rebate, 6) AS bill_total,
  array_to_string(list_filter([CASE WHEN abs({" + ".join(c for c in A.BILL_FIGURES if c.endswith(("_cost", "_charge", "_charges")))} - total_electricity_charges) > 0.01 THEN 'lines' END,
    CASE WHEN abs(on_peak_kwh + mid_peak_kwh + off_peak_kwh - adjusted_kwh_used) > 0.002 THEN 'bands' END,
    CASE WHEN abs(kwh_used * loss_factor_adjustment - adjusted_kwh_used) > 0.002 THEN 'loss' END, CASE WHEN NOT days BETWEEN 28 AND 31 THEN 'month' END,
    CASE WHEN demand_kva < demand_kw THEN 'kva' END, CASE WHEN peak_7_7_kw > demand_kw THEN 'window' END,
    CASE WHEN abs(peak_7_7_kw * days / 30.0::DOUBLE - adj_peak_7_7_kw) > 0.0025 THEN 'adj_peak_7_7_kw' END,
    CASE WHEN abs(demand_kw * days / 30.0::DOUBLE - adj_kw) > 0.0025 THEN 'adj_kw' END, CASE WHEN abs(demand_kva * days / 30.0::DOUBLE - adj_kva) > 0.0025 THEN 'adj_kva' END,
    CASE WHEN least(peak_7_7_kw, adj_peak_7_7_kw, demand_kw, demand_kva, metering_adj, adj_kw, adj_kva, hst, ontario_electricity_rebate) <= 0 THEN 'positive' END], lambda x: x IS NOT NULL), ',') AS failed FROM bills""")
def bill_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bill's total and the rules that its own figures break."""
    rows = B.checks(A.bills(spark, sf_dir))
    return rows.select("site_id", "period_ending", F.round(B.bill_total(), 6).alias("bill_total"), F.array_join("failed", ",").alias("failed"))


#: CTE ``ec``: energy cost of sites with a bill and energy.
ENERGY_COST_SQL = f"""
used AS (SELECT *, true AS used FROM (SELECT site_id, period_ending, {K.BAND_SUMS} FROM parts GROUP BY ALL) LEFT JOIN gate USING (site_id, period_ending)),
{BILLS_SQL},
ec0 AS (SELECT *, CASE WHEN day(period_ending) <> 23 THEN 'NotABillingPeriodEnding' WHEN refused IS NOT NULL THEN refused WHEN b.n IS NULL THEN 'NoBill' WHEN u.used IS NULL THEN 'NoEnergy' WHEN on_peak_kwh = 0 THEN 'ZeroDenominator(on_peak_kwh)'
    WHEN mid_peak_kwh = 0 THEN 'ZeroDenominator(mid_peak_kwh)' WHEN off_peak_kwh = 0 THEN 'ZeroDenominator(off_peak_kwh)' END AS error FROM bills b FULL JOIN used u USING (site_id, period_ending)),
ec1 AS (SELECT *, CASE WHEN error IS NULL THEN on_kwh * loss_factor_adjustment * on_peak_cost / on_peak_kwh END AS on_cost,
    CASE WHEN error IS NULL THEN mid_kwh * loss_factor_adjustment * mid_peak_cost / mid_peak_kwh END AS mid_cost,
    CASE WHEN error IS NULL THEN off_kwh * loss_factor_adjustment * off_peak_cost / off_peak_kwh END AS off_cost FROM ec0),
ec2 AS (SELECT *, on_cost + mid_cost + off_cost AS charges FROM ec1),
ec AS (SELECT *, charges * hst / total_electricity_charges AS tax, charges * ontario_electricity_rebate / total_electricity_charges AS rebate,
    charges + charges * hst / total_electricity_charges - charges * ontario_electricity_rebate / total_electricity_charges AS net FROM ec2)"""
_EC = ("on_cost", "mid_cost", "off_cost", "charges", "tax", "rebate", "net")


def _gate(spark: SparkSession, sf_dir: str, periods: DataFrame) -> DataFrame:
    return V.coverage_errors(A.site_reports(spark, sf_dir), periods.select("site_id", "period_ending").distinct())


def _energy_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = energy._by_band(energy.energy_parts(_counted(spark, sf_dir)))
    return C.energy_cost(V.gated(used, _gate(spark, sf_dir, used), []), A.bills(spark, sf_dir))


@query(f"WITH {K.PARTS_SQL}, {A.GATE_SQL}, {ENERGY_COST_SQL} SELECT site_id, period_ending, {sql_six(*_EC)}, error FROM ec")
def energy_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What charging energy cost each site and period."""
    return _energy_cost(spark, sf_dir).select("site_id", "period_ending", *six(*_EC), "error")


#: CTEs up to ``power``: estimates of the hour of each billed maximum.
POWER_SQL = f"""{A.hours_sql(K.sql_ending)}, {A.GATE_SQL}, hl AS (SELECT *, {K.sql_local("ts")} AS w FROM site_hours), hd AS (SELECT *, CAST(w AS DATE) AS wd, hour(w) AS wh FROM hl),
hb AS (SELECT *, {K.sql_band("wd", "wh")} AS tou, {K.sql_ending("ts")} AS period_ending FROM hd),
pk AS (SELECT meter_id AS site_id, period_ending, first(ts ORDER BY kva DESC, ts) AS kva_at, first(ts ORDER BY kw DESC, ts) AS kw_at,
    first(ts ORDER BY kw DESC, ts) FILTER (tou <> 'OffPeak') AS kw77_at, count(*) = 24 * date_diff('day', CAST(period_ending - INTERVAL 1 MONTH AS DATE), period_ending) AS complete FROM hb GROUP BY meter_id, period_ending),
pi AS (SELECT site_id, period_ending, complete, unnest([{{'basis': 'kva', 'found_at': kva_at}}, {{'basis': 'kw', 'found_at': kw_at}}, {{'basis': 'kw77', 'found_at': kw77_at}}], recursive := true) FROM pk),
ph AS (SELECT site_id, period_ending, basis, CASE WHEN complete AND refused IS NULL THEN found_at END AS peak_at,
    CASE WHEN refused IS NOT NULL THEN refused WHEN NOT complete THEN 'PeriodNotFullyCovered' WHEN found_at IS NULL THEN 'NoPeak(' || basis || ')' END AS no_power FROM pi LEFT JOIN gate USING (site_id, period_ending)),
{K.segments_sql("SELECT DISTINCT site_id, CAST(epoch(peak_at) AS BIGINT) AS interval_start FROM ph WHERE peak_at IS NOT NULL")},
es AS (SELECT *, {K._sql_estimates()} FROM sa),
best AS (SELECT site_id, interval_start, {K._sql_best("{}")} FROM es GROUP BY site_id, interval_start),
power AS (SELECT ph.site_id, period_ending, basis, peak_at, no_power, best.* EXCLUDE (site_id, interval_start) FROM ph LEFT JOIN best ON best.site_id = ph.site_id AND best.interval_start = CAST(epoch(peak_at) AS BIGINT))"""
_FIGURES = [f"{w}_{u}_{e}" for w in ("energy", "count") for u in ("kw", "kva") for e in ("min", "max")]


def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima are cut once and written, as their hours are used twice: to be asked for, and to be answered."""
    figures = _figures(spark, sf_dir)
    return C.peak_power(figures, _counted(spark, sf_dir), _gate(spark, sf_dir, _periods(figures)))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(meter.period_figures(meter.fill_gaps(A.site_hours(spark, sf_dir))), "figures")


def _periods(figures: DataFrame) -> DataFrame:
    return figures.select(F.col("meter_id").alias("site_id"), "period_ending")


@query(f"""WITH {K.PARTS_SQL}, {POWER_SQL} SELECT site_id, period_ending, basis, peak_at, energy_segment, count_segment, {sql_six(*_FIGURES)}, no_power AS error FROM power""")
def peak_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charging's share of the hour of each billed maximum."""
    rows = _power(spark, sf_dir).withColumn("peak_at", F.timestamp_seconds("interval_start").cast("timestamp_ntz"))
    return rows.select("site_id", "period_ending", "basis", "peak_at", "energy_segment", "count_segment", *six(*_FIGURES), "error")


_mid = lambda basis, unit: f"max(CASE WHEN basis = '{basis}' THEN (energy_{unit}_min + energy_{unit}_max) / 2 END)"
DELIVERY_SQL = f"""
dm AS (SELECT site_id, period_ending, {_mid("kva", "kva")} AS ev_kva, {_mid("kw", "kw")} AS ev_kw, {_mid("kw77", "kw")} AS ev_kw77,
    max(no_power) FILTER (no_power NOT LIKE 'NoPeak%') AS lacking, true AS metered FROM power GROUP BY ALL),
dc0 AS (SELECT *, CASE WHEN day(period_ending) <> 23 THEN 'NotABillingPeriodEnding' WHEN refused IS NOT NULL THEN refused WHEN n IS NULL THEN 'NoBill' WHEN metered IS NULL THEN 'NotMetered' WHEN lacking IS NOT NULL THEN lacking
    WHEN ev_kva IS NULL THEN 'NoPeak(kva)' WHEN ev_kw IS NULL THEN 'NoPeak(kw)' WHEN ev_kw77 IS NULL THEN 'NoPeak(kw77)' END AS error FROM bills FULL JOIN dm USING (site_id, period_ending) LEFT JOIN gate USING (site_id, period_ending)),
dc2 AS (SELECT *, CASE WHEN error IS NULL THEN distribution_charges / adj_kva * ev_kva * (days / 30) END AS distribution,
    CASE WHEN error IS NULL THEN transmission_connection_charge / adj_kw * ev_kw * (days / 30) END AS connection,
    CASE WHEN error IS NULL THEN transmission_network_charge / adj_peak_7_7_kw * ev_kw77 * (days / 30) END AS network FROM dc0),
dc3 AS (SELECT *, distribution + connection + network AS charges FROM dc2),
dc AS (SELECT *, charges * hst / total_electricity_charges AS tax, charges * ontario_electricity_rebate / total_electricity_charges AS rebate,
    charges + charges * hst / total_electricity_charges - charges * ontario_electricity_rebate / total_electricity_charges AS net FROM dc3)"""
_DC = ("ev_kva", "ev_kw", "ev_kw77", "distribution", "connection", "network", "charges", "tax", "rebate", "net")


def _delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills, figures = written(A.bills(spark, sf_dir), "bills"), _figures(spark, sf_dir)
    gate = written(_gate(spark, sf_dir, _periods(figures).union(bills.select(*C.KEYS))), "gate")
    power = C.peak_power(figures, _counted(spark, sf_dir), gate)
    return C.delivery_cost(power, bills, coverage=gate)


@query(f"WITH {K.PARTS_SQL}, {POWER_SQL}, {BILLS_SQL}, {DELIVERY_SQL} SELECT site_id, period_ending, {sql_six(*_DC)}, error FROM dc")
def delivery_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charging's part of each site's demand charges."""
    return _delivery(spark, sf_dir).select("site_id", "period_ending", *six(*_DC), "error")


#: CTE ``rec``: each stretch's energy at its rates; a day takes the last rate effective by then, or the opening one.
RECOVERY_SQL = f"""
{A.RATES_SQL},
sp AS (SELECT site_id, period_ending, CAST(period_ending - INTERVAL 1 MONTH AS DATE) + 1 AS begins FROM (SELECT DISTINCT site_id, period_ending FROM parts)),
hold AS (SELECT *, lead(effective_date) OVER (PARTITION BY site_id ORDER BY effective_date) AS until FROM rates),
cut AS (SELECT sp.*, greatest(begins, effective_date) AS from_date, least(period_ending, coalesce(until - 1, period_ending)) AS to_date, on_rate, mid_rate, off_rate
  FROM sp JOIN hold USING (site_id) WHERE effective_date <= period_ending AND (until IS NULL OR until > begins)),
okp AS (SELECT site_id, period_ending FROM cut GROUP BY ALL HAVING min(from_date) = min(begins)),
st AS (SELECT site_id, period_ending, from_date, to_date, on_rate, mid_rate, off_rate, NULL AS error FROM cut SEMI JOIN okp USING (site_id, period_ending)
  UNION ALL SELECT site_id, period_ending, NULL, NULL, NULL, NULL, NULL, 'RatesNotYetInEffect' FROM sp ANTI JOIN okp USING (site_id, period_ending)),
rs0 AS (SELECT st.*, coalesce(sum(kwh) FILTER (tou = 'OnPeak'), 0) AS on_kwh, coalesce(sum(kwh) FILTER (tou = 'MidPeak'), 0) AS mid_kwh, coalesce(sum(kwh) FILTER (tou = 'OffPeak'), 0) AS off_kwh
  FROM st LEFT JOIN parts p ON p.site_id = st.site_id AND p.period_ending = st.period_ending AND least(ld, st.period_ending) BETWEEN from_date AND to_date GROUP BY ALL),
rs1 AS (SELECT rs0.* EXCLUDE (error), coalesce(refused, error) AS error FROM rs0 LEFT JOIN gate USING (site_id, period_ending)),
rs AS (SELECT * REPLACE ({", ".join(f"CASE WHEN error IS NULL THEN {b}_kwh END AS {b}_kwh" for b in ("on", "mid", "off"))}) FROM rs1),
rec AS (SELECT *, on_kwh * on_rate + mid_kwh * mid_rate + off_kwh * off_rate AS recovery FROM rs)"""
_RC = ("on_kwh", "mid_kwh", "off_kwh", "recovery")


def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = written(energy.energy_by_day(_counted(spark, sf_dir)), "daily")
    return C.cost_recovery(daily, C.rate_stretches(daily, A.rates(spark, sf_dir)), _gate(spark, sf_dir, daily))


@query(f"WITH {K.PARTS_SQL}, {A.GATE_SQL}, {RECOVERY_SQL} SELECT site_id, period_ending, from_date, to_date, {sql_six(*_RC)}, error FROM rec")
def cost_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each stretch of constant rates, and what it brought in."""
    return _recovery(spark, sf_dir).select("site_id", "period_ending", "from_date", "to_date", *six(*_RC), "error")


_cent = lambda x: f"CAST(printf('%.2f', {x}) AS DOUBLE)"


@query(f"""WITH {K.PARTS_SQL}, {POWER_SQL}, {RECOVERY_SQL}, {ENERGY_COST_SQL}, {DELIVERY_SQL},
r AS (SELECT site_id, period_ending, sum(recovery) AS r, max(error) AS r_error, true AS has_r FROM rec GROUP BY ALL),
x AS (SELECT site_id, period_ending, {_cent("r")} AS recovery, {_cent("dc.net")} AS delivery, {_cent("ec.net")} AS energy,
    CASE WHEN has_r IS NULL THEN 'NoRecovery' ELSE r_error END AS recovery_error, CASE WHEN has_d IS NULL THEN 'NoDelivery' ELSE dc.error END AS delivery_error,
    CASE WHEN has_e IS NULL THEN 'NoEnergyCost' ELSE ec.error END AS energy_error
  FROM r FULL JOIN (SELECT *, true AS has_d FROM dc) dc USING (site_id, period_ending) FULL JOIN (SELECT *, true AS has_e FROM ec) ec USING (site_id, period_ending)),
y AS (SELECT *, {_cent("recovery - delivery - energy")} AS surplus FROM x)
SELECT *, CASE WHEN surplus IS NULL THEN 'unknown' WHEN surplus < 0 THEN 'short' ELSE 'covered' END AS verdict FROM y""")
def cost_recovery_surplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery less delivery and energy cost of each site and period, to the cent.

    Sessions, energy by day, maxima and bills are worked out once and written; all three parts read them.
    """
    counted = written(_counted(spark, sf_dir).select("site_id", "adj_start", "adj_end", "energy", "avg_kw"), "counted")
    daily = written(energy.energy_by_day(counted), "daily")
    bills = written(A.bills(spark, sf_dir), "bills")
    figures = _figures(spark, sf_dir)
    periods = daily.select(*C.KEYS).union(_periods(figures)).union(bills.select(*C.KEYS))
    gate = written(_gate(spark, sf_dir, periods), "gate")
    stretches = written(C.rate_stretches(daily, A.rates(spark, sf_dir)), "stretches")
    power = written(C.peak_power(figures, counted, gate), "power")
    recovered = C.cost_recovery(daily, stretches, gate)
    used = daily.groupBy("site_id", "period_ending").agg(*(F.sum(f"{b}_kwh").alias(f"{b}_kwh") for b in C.BANDS))
    delivery = C.delivery_cost(power, bills, coverage=gate)
    return C.surplus(recovered, delivery, C.energy_cost(V.gated(used, gate, []), bills))


@query(f"""WITH {K.BANDED_SQL}, g AS (SELECT meter_id, period_ending, max(kw) FILTER (tou IS NOT NULL) AS m, max(kva) FILTER (tou IS NOT NULL) AS v FROM banded GROUP BY ALL),
e AS (SELECT meter_id, {K.sql_ending("ts")} AS period_ending, CAST(sum(kwh) AS BIGINT) AS k FROM wide GROUP BY ALL),
m AS (SELECT meter_id, period_ending, m / 1000000.0::DOUBLE AS kw, v / 1000000.0::DOUBLE AS kva, k / 1000000.0::DOUBLE AS kwh FROM e LEFT JOIN g USING (meter_id, period_ending)),
p AS (SELECT meter_id, period_ending, floor(kw * 1000 + 1e-7) / 1000 + CASE WHEN meter_id % 3 = 0 THEN 0.002 ELSE 0 END AS kw, floor(kva * 1000 + 1e-7) / 1000 AS kva,
    round(kwh, 3) + CASE WHEN meter_id % 4 = 1 THEN 0.01 ELSE 0 END AS kwh FROM m WHERE NOT (meter_id = 5 AND year(period_ending) = 1997))
SELECT meter_id, period_ending, m.kw - p.kw >= -1e-9 AND m.kw - p.kw < 0.001 AS kw_agrees, m.kva - p.kva >= -1e-9 AND m.kva - p.kva < 0.001 AS kva_agrees,
  abs(m.kwh - p.kwh) <= 0.001 AS kwh_agrees, CASE WHEN has_p IS NULL THEN 'meter' END AS unmatched FROM m LEFT JOIN (SELECT *, true AS has_p FROM p) p USING (meter_id, period_ending)""")
def reconcile_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metered maxima and energy against printed ones: demand cut to three decimals and wrong for every third meter, energy rounded, some bills missing."""
    figures = meter.period_figures(meter.fill_gaps(meter.readings(A.series(spark, sf_dir)))).where("kwh is not null or max_kw is not null or max_kva is not null")
    measured = figures.select("meter_id", "period_ending", *((F.col(f"max_{c}") / meter.SCALE).alias(c) for c in ("kw", "kva")), "kwh")
    off = lambda when, by: F.when(when, by).otherwise(0.0)
    printed = figures.where(~((F.col("meter_id") == 5) & (F.year("period_ending") == 1997))).select(
        "meter_id", "period_ending",
        (F.floor(F.col("max_kw") / 1000) / 1000 + off(F.col("meter_id") % 3 == 0, 0.002)).alias("kw"),
        (F.floor(F.col("max_kva") / 1000) / 1000).alias("kva"),
        (F.round("kwh", 3) + off(F.col("meter_id") % 4 == 1, 0.01)).alias("kwh"),
    )
    return reconcile.demand(measured, printed, ("kw", "kva"), energy=("kwh",))


def _band_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meter.with_band(meter.readings(A.series(spark, sf_dir))).withColumn("period_ending", K.T.period_ending("ts"))
    return rows.groupBy("meter_id", "period_ending", F.coalesce("tou", F.lit("OffHour")).alias("tou")).agg(F.sum("kwh").alias("k"))


@query(f"""WITH {K.BANDED_SQL} SELECT meter_id, period_ending, coalesce(tou, 'OffHour') AS tou, round(CAST(sum(kwh) AS DOUBLE) / 1000000, 6) AS kwh FROM banded GROUP BY ALL""")
def metered_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metered energy of each period by band, as bills state it before the loss factor."""
    sums = _band_sums(spark, sf_dir)
    return sums.select("meter_id", "period_ending", "tou", F.round(F.col("k") / 10**6, 6).alias("kwh"))


@query(f"""WITH {K.BANDED_SQL}, g AS (SELECT meter_id, period_ending, coalesce(tou, 'OffHour') AS tou, CAST(sum(kwh) AS BIGINT) AS k FROM banded GROUP BY ALL),
e AS (SELECT *, ((k * 10295 + 5000000) // 10000000 / 1000.0::DOUBLE + CASE WHEN meter_id % 3 = 0 AND tou = 'OnPeak' THEN 0.5::DOUBLE ELSE 0 END) / 1.0295::DOUBLE AS x FROM g)
SELECT meter_id, period_ending, tou, round(k / 1000000.0::DOUBLE, 6) AS kwh, CASE WHEN tou <> 'OffHour' THEN round(x, 6) END AS expected,
  CASE WHEN tou <> 'OffHour' THEN abs(k / 1000000.0::DOUBLE - x) < 0.001 END AS agrees, CASE WHEN tou = 'OffHour' THEN 'meter' END AS unmatched FROM e""")
def reconcile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metered energy by band against bills printed after the loss factor, which overstate on-peak for every third meter."""
    sums = _band_sums(spark, sf_dir)
    stated = F.expr("(k * 10295 + 5000000) div 10000000") / 1000.0
    on = F.when((F.col("tou") == "OnPeak") & (F.col("meter_id") % 3 == 0), 0.5).otherwise(0.0)
    of = lambda tou: F.max(F.when(F.col("tou") == tou, stated + on))
    printed = sums.groupBy("meter_id", "period_ending").agg(*(of(t).alias(f"{b}_peak_kwh") for t, b in _BAND_ROWS))
    printed = printed.withColumn("loss_factor_adjustment", F.lit(1.0295))
    metered = sums.withColumn("kwh", F.col("k") / 10**6)
    found = reconcile.band_energy(metered, printed).where("kwh is not null or expected is not null")
    return found.select("meter_id", "period_ending", "tou", *six("kwh", "expected"), "agrees", "unmatched")


_TABLE_SQL = f"""{K.flagged_sql()},
t AS (SELECT site_id, path, "row", id AS "Charge_Session_ID", dur_s AS "Conn_Duration", charge_s AS "Active_Charge_Time", round(energy, 6) AS "Energy_Use",
    {K.sql_local("make_timestamp(adj_start * 1000000)")} AS adj_conn_start, {K.sql_local("make_timestamp(adj_end * 1000000)")} AS adj_conn_end, start_utc AS conn_start_utc, end_utc AS conn_end_utc,
    make_timestamp(adj_start * 1000000) AS adj_conn_start_utc, make_timestamp(adj_end * 1000000) AS adj_conn_end_utc,
    CASE WHEN adj_end >= adj_start THEN adj_end - adj_start END AS adj_conn_duration, avg_kw, array_to_string(anomalies, ',') AS anomalies FROM f)"""


@query(f"WITH {_TABLE_SQL} SELECT * FROM t")
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as the stored table has them, less the columns that the tables here do not fill."""
    rows = session_columns(K._flagged(spark, sf_dir))
    stamps = K.ntz("adj_conn_start", "adj_conn_end", "conn_start_utc", "conn_end_utc", "adj_conn_start_utc", "adj_conn_end_utc")
    shown = rows.select("site_id", "path", "row", "Charge_Session_ID", "Conn_Duration", "Active_Charge_Time", F.round("Energy_Use", 6).alias("Energy_Use"), *stamps, *DERIVED[6:])
    return shown


@query(f"""WITH {_TABLE_SQL},
o AS (SELECT *, adj_conn_start_utc + to_seconds(CASE WHEN "row" % 50 = 0 THEN 60 ELSE 0 END) AS s_start, CASE WHEN "row" % 70 <> 0 THEN adj_conn_end_utc END AS s_end,
    CASE WHEN "row" % 7 <> 0 THEN adj_conn_duration + CASE WHEN "row" % 60 = 0 THEN 1 ELSE 0 END END AS s_dur, avg_kw + CASE WHEN "row" % 75 = 0 THEN 0.5 ELSE 0 END AS s_kw FROM t),
c AS (SELECT path, "row", list_filter([CASE WHEN s_start IS DISTINCT FROM adj_conn_start_utc THEN 'adj_conn_start_utc' END, CASE WHEN s_end IS DISTINCT FROM adj_conn_end_utc THEN 'adj_conn_end_utc' END,
    CASE WHEN abs(s_dur - adj_conn_duration) > 1e-6 THEN 'adj_conn_duration' END, CASE WHEN abs(s_kw - avg_kw) > 1e-6 THEN 'avg_kw' END], lambda x: x IS NOT NULL) AS found FROM o)
SELECT path, "row", array_to_string(found, ',') AS columns FROM c WHERE len(found) > 0""")
def stored_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with some derived cells altered or emptied, read again: which cells differ from the recomputed ones."""
    n = F.col("row")
    stored = session_columns(K._flagged(spark, sf_dir)).withColumns(
        {
            "adj_conn_start_utc": F.timestamp_seconds(F.unix_seconds("adj_conn_start_utc") + F.when(n % 50 == 0, 60).otherwise(0)),
            "adj_conn_end_utc": F.when(n % 70 != 0, F.col("adj_conn_end_utc")),
            "adj_conn_duration": F.when(n % 7 != 0, F.col("adj_conn_duration") + F.when(n % 60 == 0, 1).otherwise(0)),
            "avg_kw": F.col("avg_kw") + F.when(n % 75 == 0, 0.5).otherwise(0.0),
        }
    )
    found = reread(stored).where("workbook_discrepancy")
    return found.select("path", "row", F.array_join("discrepancies", ",").alias("columns"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = K.T.instant(F.to_date("ts").cast("timestamp") + F.expr("interval 16 hours"))
    rows = A.read(spark, sf_dir, "events").select((F.col("user_id") % A.SITES).alias("site_id"), F.unix_seconds(hour).alias("interval_start"))
    return rows.distinct().withColumn("interval_s", F.lit(3600))


@query(f"""WITH {K.SEGMENTS_SQL}, es AS (SELECT *, {K._sql_estimates()} FROM sa), best AS (SELECT site_id, make_timestamp(interval_start * 1000000) AS interval_start, {K._sql_best()} FROM es GROUP BY site_id, es.interval_start)
{" UNION ALL ".join(f"SELECT site_id, interval_start, '{w}' AS way, '{u}' AS unit, {w}_{u}_min AS low, {w}_{u}_max AS high, {w}_segment AS segment FROM best" for w in ("energy", "count") for u in ("kw", "kva"))}""")
def estimate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four estimates of each 16:00 hour."""
    return reports.estimate_summary(K.best_segment(spark, sf_dir))


@query(f"""WITH {K.SEGMENTS_SQL} SELECT sg.site_id, sg.interval_start, sg.seg_start, path, bucket, "row", id FROM sg JOIN d ON d.site_id = sg.site_id AND bucket <> 'excluded'
  AND adj_end > adj_start AND adj_start < seg_start + 900 AND adj_end > seg_start""")
def segment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of each segment of each 16:00 hour."""
    return reports.segment_members(_asked(spark, sf_dir), _counted(spark, sf_dir))


@query(f"""WITH {K.DEDUP_SQL}, iv AS ({K.ASKED_SQL}), x AS (SELECT *, least(adj_start, adj_end) AS lo, greatest(adj_start, adj_end) AS hi FROM d WHERE bucket = 'excluded')
SELECT x.site_id, path, "row", id, count(interval_start) AS n_intervals FROM x LEFT JOIN iv ON iv.site_id = x.site_id AND lo < interval_start + 3600 AND hi > interval_start GROUP BY ALL""")
def excluded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded sessions and how many of the 16:00 hours they touch."""
    return reports.excluded_sessions(_asked(spark, sf_dir), _merged(spark, sf_dir)).select("site_id", "path", "row", "id", "n_intervals")


_MET_SQL = f"""iv AS ({K.ASKED_SQL}),
m AS (SELECT d.site_id, interval_start, path, "row", id, avg_kw, list_concat(anomalies, CASE WHEN duplicate_id THEN ['DuplicateId'] ELSE [] END) AS a
  FROM d JOIN iv ON iv.site_id = d.site_id AND adj_end > adj_start AND adj_start < interval_start + 3600 AND adj_end > interval_start),
un AS (SELECT *, unnest(a) AS anomaly, CAST(unnest(range(len(a))) AS BIGINT) AS pos FROM m)"""


@query(f"""WITH {K.DEDUP_SQL}, {_MET_SQL}
SELECT site_id, interval_start, path, "row", id, pos, CASE WHEN anomaly = 'ExcessiveAvgKw' THEN printf('ExcessiveAvgKw(%.3f)', avg_kw) ELSE anomaly END AS cell FROM un""")
def interval_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies that touch each 16:00 hour, as printed, by file, row and id; those of a session in their fixed order."""
    found = reports.interval_anomalies(_asked(spark, sf_dir), _merged(spark, sf_dir)).orderBy("site_id", "interval_start", "path", "row", "id", "pos")
    return found.select("site_id", "interval_start", "path", "row", "id", F.col("pos").cast("long").alias("pos"), "cell")


@query(f"""WITH {K.DEDUP_SQL}, {_MET_SQL}, k AS (SELECT site_id, interval_start, anomaly, min((path, "row", id, pos)) AS spot FROM un GROUP BY ALL)
SELECT site_id, interval_start, row_number() OVER (PARTITION BY site_id, interval_start ORDER BY spot) AS nth, anomaly FROM k""")
def anomaly_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of anomaly in each 16:00 hour, in the order in which they first come up."""
    return reports.anomaly_kinds(reports.interval_anomalies(_asked(spark, sf_dir), _merged(spark, sf_dir)))


@query(f"""WITH {K.SEGMENTS_SQL} SELECT site_id, make_timestamp(interval_start * 1000000) AS interval_start, max(members) = 0 AS deserted FROM sa GROUP BY ALL""")
def deserted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which 16:00 hours no session reached."""
    stamp = F.timestamp_seconds("interval_start").cast("timestamp_ntz").alias("interval_start")
    return reports.deserted(K._segments(spark, sf_dir)).select("site_id", stamp, "deserted")


@query(f"""WITH {K.DEDUP_SQL}, p AS (SELECT site_id, path, count(*) AS n_sessions FROM d GROUP BY ALL)
SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY path) AS nth, path, n_sessions FROM p""")
def session_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that each site's merged sessions are from, in order."""
    return S.sources(_merged(spark, sf_dir))


@query(f"""WITH {K.PARTS_SQL} SELECT site_id, period_ending, coalesce(tou, 'Total') AS tou, round(sum(kwh), 6) AS kwh FROM parts GROUP BY GROUPING SETS ((site_id, period_ending, tou), (site_id, period_ending))""")
def energy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charging energy of each period by band, with its total."""
    parts = energy.energy_parts(_counted(spark, sf_dir))
    sums = parts.groupingSets([["site_id", "period_ending", "tou"], ["site_id", "period_ending"]], "site_id", "period_ending", "tou").agg(F.sum("kwh").alias("k"))
    return sums.select("site_id", "period_ending", F.coalesce("tou", F.lit("Total")).alias("tou"), F.round("k", 6).alias("kwh"))


def _sql_lines(table: str, names: tuple[str, ...], less: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT site_id, period_ending, CAST({i} AS BIGINT) AS pos, '{c}' AS line, round({'-' if c in less else ''}{c}, 6) AS amount FROM {table}"
        for i, c in enumerate(names)
    )


@query(f"WITH {K.PARTS_SQL}, {A.GATE_SQL}, {ENERGY_COST_SQL} {_sql_lines('ec', _EC, ('rebate',))}")
def energy_cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy cost as numbered lines; the rebate is a credit."""
    return reports.lines(energy_cost(spark, sf_dir), C.KEYS, list(_EC), less=("rebate",))


_DL = _DC[3:]


@query(f"WITH {K.PARTS_SQL}, {POWER_SQL}, {BILLS_SQL}, {DELIVERY_SQL} {_sql_lines('dc', _DL, ('rebate',))}")
def delivery_cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery cost as numbered lines; the rebate is a credit."""
    return reports.lines(delivery_cost(spark, sf_dir), C.KEYS, list(_DL), less=("rebate",))


_DEMAND = (
    ("distribution", "kVA", "ev_kva", "distribution_charges / adj_kva"),
    ("connection", "kW", "ev_kw", "transmission_connection_charge / adj_kw"),
    ("network", "kW 7-7", "ev_kw77", "transmission_network_charge / adj_peak_7_7_kw"),
)


@query(f"""WITH {K.PARTS_SQL}, {POWER_SQL}, {BILLS_SQL}, {DELIVERY_SQL}
{" UNION ALL ".join(f"SELECT site_id, period_ending, '{n}' AS line, '{u}' AS basis, round({ev}, 6) AS demand, round({ev} * (days / 30), 6) AS adjusted, CASE WHEN error IS NULL THEN round({r}, 6) END AS rate, round({n}, 6) AS charge FROM dc" for n, u, ev, r in _DEMAND)}""")
def delivery_demand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand, rate and charge of each delivery line."""
    return reports.demand_lines(_delivery(spark, sf_dir)).select(*C.KEYS, "line", "basis", *six("demand", "adjusted", "rate", "charge"))


@query(f"""WITH {K.PARTS_SQL}, {A.GATE_SQL}, {RECOVERY_SQL}
{" UNION ALL ".join(f"SELECT site_id, period_ending, from_date, to_date, '{t}' AS tou, round({b}_kwh, 6) AS kwh, round({b}_rate, 6) AS rate, round({b}_kwh * {b}_rate, 6) AS recovery FROM rec WHERE error IS NULL" for t, b in _BAND_ROWS)}
UNION ALL SELECT site_id, period_ending, from_date, to_date, 'Total', round(on_kwh + mid_kwh + off_kwh, 6), NULL, round(recovery, 6) FROM rec WHERE error IS NULL""")
def recovery_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of each stretch by band, with its total."""
    rows = reports.recovery_table(_recovery(spark, sf_dir))
    return rows.select(*C.KEYS, "from_date", "to_date", "tou", *six("kwh", "rate", "recovery"))


@query(f"""WITH {K.PARTS_SQL}, {A.GATE_SQL}, {RECOVERY_SQL}
SELECT site_id, period_ending, from_date, round(sum(recovery), 6) AS recovery FROM rec WHERE error IS NULL GROUP BY GROUPING SETS ((site_id, period_ending, from_date), (site_id, period_ending))""")
def recovery_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery of each stretch and of the whole period."""
    return reports.recovery_totals(_recovery(spark, sf_dir)).select(*C.KEYS, "from_date", *six("recovery"))


_SURPLUS = ("recovery", "energy", "delivery", "surplus")


@query(f"WITH sp0 AS ({SQL['cost_recovery_surplus']}) {_sql_lines('sp0', _SURPLUS, ('energy', 'delivery'))}")
def surplus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surplus as four lines that add up; costs are shown negative."""
    return reports.lines(cost_recovery_surplus(spark, sf_dir), C.KEYS, list(_SURPLUS), less=("energy", "delivery"))


@query(f"""WITH {K.DEDUP_SQL} SELECT site_id, bucket, path, "row", id, start_utc, energy, avg_kw FROM d""")
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged sessions with bucket, start, energy and mean power, by site, bucket, file and row."""
    rows = _merged(spark, sf_dir).select("site_id", "bucket", "path", "row", "id", *K.ntz("start_utc"), "energy", "avg_kw")
    return rows.orderBy("site_id", F.expr("array_position(array('session', 'spike', 'excluded'), bucket)"), "path", "row")

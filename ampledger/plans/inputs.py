"""Queries over what the library reads as files and text, each beside its SQL.

The files are written by Spark from the benchmark tables first, and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.functions.load import site_load
from ampledger.functions.sites import BY_SITE, with_sites
from ampledger.functions.timeexpr import period_ending
from ampledger.operators import bill_text, energy, meter
from ampledger.operators import bills as B
from ampledger.operators import costs as C
from ampledger.operators import sessions as S
from ampledger.operators.coverage import gated
from ampledger.plans import core as K
from ampledger.plans import costs as P
from ampledger.sources import adapters as A
from ampledger.sources.scratch import folder, written
from ampledger.sources.session_reports import quarantine, session_reports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


_HEADERS = {"id": "Charge_Session_ID", "conn_start": "Conn_DateTime_Start", "conn_end": "Conn_DateTime_End", "conn_duration": "Conn_Duration", "active_time": "Active_Charge_Time", "energy_use": "Energy_Use"}


def report_folder(spark: SparkSession, sf_dir: str, bad: bool) -> str:
    """Report files of every site: one of its even events, one of its odd ones, whose headers differ.

    Odd events' files have the columns in another order, with blanks in the header, one more column and one
    less. ``bad``: in files of sites divisible by 3 some cells are no numbers.
    """
    at = folder(spark, "reports")
    raw = A.raw_sessions(spark, sf_dir, bad=False)
    n, hit = F.col("row"), F.lit(bad) & (F.col("site_id") % 3 == 0)
    raw = raw.withColumn("conn_duration", F.when(hit & (n % 97 == 0), "1:75:00").otherwise(F.col("conn_duration")))
    raw = raw.withColumn("energy_use", F.when(hit & (n % 101 == 0), "n/a").otherwise(F.col("energy_use")))
    cells = [F.col(c).alias(h) for c, h in _HEADERS.items()]
    even = [*cells, n.cast("string").alias("Event"), F.concat(F.lit('P "'), n % 7, F.lit('", east')).alias("Station_ID")]
    odd = [n.cast("string").alias("Event"), *(F.col(c).alias(f" {h} ") for c, h in reversed(_HEADERS.items())), F.lit("as reported").alias("path")]
    for kind, columns in (("e0", even), ("e1", odd)):
        # the write wants rows by site: a sort by row alone would be followed by one that loses it where it spills
        rows = raw.where(F.col("path") == kind).repartition("site_id").sortWithinPartitions("site_id", "row")
        rows.select("site_id", *columns).write.partitionBy("site_id").option("header", True).option("escape", '"').csv(f"{at}/{kind}")
    return at


def _read_reports(spark: SparkSession, at: str) -> DataFrame:
    rows = session_reports(spark, [f"{at}/e0/*", f"{at}/e1/*"])
    site = F.regexp_extract("path", r"/site_id=(\d+)/", 1).cast("long")
    return rows.withColumn("site_id", site).withColumn("kind", F.regexp_extract("path", r"/(e[01])/", 1))


@query(f"""WITH {A.sessions_sql()} SELECT site_id, path AS kind, "row" AS event, row_number() OVER (PARTITION BY site_id, path ORDER BY "row") + 1 AS "row", id, start_local, end_local, dur_s, charge_s, round(energy, 6) AS energy,
  CASE WHEN path = 'e0' THEN 'P "' || CAST("row" % 7 AS VARCHAR) || '", east' END AS "Station_ID", CASE WHEN path = 'e1' THEN 'as reported' END AS report_path FROM s""")
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files whose headers differ, read as one table."""
    rows = _read_reports(spark, report_folder(spark, sf_dir, bad=False)).where("parse_error is null")
    return rows.select(
        "site_id", "kind", F.col("Event").cast("long").alias("event"), "row", "id", "start_local", "end_local", "dur_s", "charge_s",
        F.round("energy", 6).alias("energy"), "Station_ID", "report_path",
    )


@query(f"""WITH {A.sessions_sql()}, r AS (SELECT site_id, path AS kind, energy, row_number() OVER (PARTITION BY site_id, path ORDER BY "row") + 1 AS place,
    CASE WHEN site_id % 3 = 0 AND "row" % 97 = 0 THEN 'conn_duration' WHEN site_id % 3 = 0 AND "row" % 101 = 0 THEN 'energy_use' END AS bad FROM s)
SELECT site_id, kind, count(*) AS n_rows, CASE WHEN count(bad) = 0 THEN round(sum(energy), 6) END AS energy, min(place) FILTER (bad IS NOT NULL) AS first_row,
  first(bad ORDER BY place) FILTER (bad IS NOT NULL) AS cell FROM r GROUP BY ALL""")
def refused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report file: its energy where it is accepted, else its first bad cell. One such cell keeps out the whole file."""
    rows = written(_read_reports(spark, report_folder(spark, sf_dir, bad=True)), "reports")  # read three times
    accepted, refused = quarantine(rows)
    files = rows.groupBy("path", "site_id", "kind").agg(F.count("*").alias("n_rows"))
    sums = S.flag_sessions(accepted.withColumn("row", F.col("row").cast("long"))).groupBy("path").agg(F.sum("energy").alias("e"))
    met = files.join(sums, "path", "left").join(refused, "path", "left")
    return met.select("site_id", "kind", "n_rows", F.round("e", 6).alias("energy"), "first_row", "cell")


@query(f"""WITH {K.flagged_sql(True)}, p AS (SELECT *, CASE path WHEN 'e9' THEN 1 WHEN 'e1' THEN 2 WHEN 'e0' THEN 3 END AS given FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY site_id, id, adj_start, adj_end, charge_s, energy ORDER BY given, CASE bucket WHEN 'session' THEN 0 WHEN 'spike' THEN 1 ELSE 2 END, "row") AS k FROM p)
SELECT site_id, path, "row", id, bucket FROM q WHERE k = 1""")
def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that several files report, by the order in which these were given: e9, e1, e0."""
    given = F.create_map(*(F.lit(x) for kv in {"e9": 1, "e1": 2, "e0": 3}.items() for x in kv))[F.col("path")]
    return S.deduplicate(K._flagged(spark, sf_dir, True).withColumn("position", given.cast("long"))).select("site_id", "path", "row", "id", "bucket")


_READ = [*A.BILL_FIGURES, "total_electricity_charges", "hst", "ontario_electricity_rebate", "kwh_used"]


def _read_bills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bills read from their pages, with the site that the account is at."""
    read, refused = bill_text.read_bills(A.bill_pages(spark, sf_dir))
    site = F.substring_index("bill_id", "/", 1).cast("long").alias("site_id")
    return read.select("*", site), refused.select("*", site)


@query(f"""WITH {P.BILLS_SQL}, said AS (SELECT *, CASE site_id WHEN 3 THEN 'Missing(Ontario Electricity Rebate)' WHEN 8 THEN 'UnknownCharge' END AS error FROM bills)
SELECT site_id, CAST(site_id AS VARCHAR) || '/' || CAST(CAST(period_ending AS DATE) AS VARCHAR) AS bill_id, CASE WHEN error IS NULL THEN CAST(days AS BIGINT) END AS number_of_days,
  CASE WHEN error IS NULL THEN CAST(CAST(period_ending AS DATE) + 5 AS DATE) END AS statement_date, {", ".join(f"CASE WHEN error IS NULL THEN round({c}, 6) END AS {c}" for c in _READ)}, error FROM said""")
def bills_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole bills read from their printed lines, and the error of each that does not read."""
    read, refused = _read_bills(spark, sf_dir)
    shown = read.select("site_id", "bill_id", "number_of_days", "statement_date", *(F.round(c, 6).alias(c) for c in _READ), F.lit(None).cast("string").alias("error"))
    return shown.unionByName(refused, allowMissingColumns=True)


_BAD_BILL = "site_id IN (3, 8)"
_COST_SQL = f"""{K.PARTS_SQL}, {P.POWER_SQL}, {P.ENERGY_COST_SQL}, {P.DELIVERY_SQL}"""


@query(f"""WITH {_COST_SQL}, both_ AS (SELECT site_id, period_ending, round(ec.net, 6) AS energy_net, round(dc.net, 6) AS delivery_net,
    round(CASE WHEN b.total_electricity_charges IS NOT NULL THEN b.total_electricity_charges + b.hst - b.ontario_electricity_rebate END, 6) AS bill_total
  FROM (SELECT * FROM bills WHERE NOT {_BAD_BILL}) b JOIN ec USING (site_id, period_ending) JOIN dc USING (site_id, period_ending))
SELECT * FROM both_""")
def costs_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy and delivery cost of each bill that reads whole, from its text lines alone."""
    read, _ = _read_bills(spark, sf_dir)
    bills = written(read, "read-bills")
    counted = written(P._counted(spark, sf_dir).select("site_id", "adj_start", "adj_end", "energy", "avg_kw"), "counted")
    used = written(energy._by_band(energy.energy_parts(counted)), "used")
    figures = P._figures(spark, sf_dir)
    gate = written(P._gate(spark, sf_dir, P._periods(figures).union(bills.select(*C.KEYS)).union(used.select(*C.KEYS))), "gate")
    spent = C.energy_cost(gated(used, gate, []), bills).select(*C.KEYS, F.round("net", 6).alias("energy_net"))
    delivered = C.delivery_cost(C.peak_power(figures, counted, gate), bills, coverage=gate).select(*C.KEYS, F.round("net", 6).alias("delivery_net"))
    totals = bills.select(*C.KEYS, F.round(B.bill_total(), 6).alias("bill_total"))
    return totals.join(spent, C.KEYS).join(delivered, C.KEYS)


_RATED = "(208.0 * (breaker_a * 0.8) / 1000.0 * 0.99)::DOUBLE"
_KVA = "(208.0 * (breaker_a * 0.8) / 1000.0)::DOUBLE"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of sites that differ in breaker, transformer, closing day and zone; site 5 is not listed, site 7 contradicts itself."""
    site = F.col("site_id")
    zones = F.array(*(F.lit(f"America/{z}") for z in ("Toronto", "Vancouver", "Halifax", "Winnipeg")))
    return A.read(spark, sf_dir, "events").select((F.col("user_id") % A.SITES).alias("site_id")).distinct().where(site != 5).select(
        "site_id", (32 + site % 3 * 8).cast("double").alias("breaker_a"), (75 + site % 2 * 25).cast("double").alias("xfmr_kva"),
        F.when(site == 7, 31).otherwise(20 + site % 5).cast("int").alias("bill_end_day"), F.get(zones, (site % 4).cast("int")).alias("zone"),
    )


@query(f"""WITH {A.sessions_sql()},
c AS (SELECT site_id, CASE WHEN site_id = 5 THEN 40.0 ELSE 32 + site_id % 3 * 8 END AS breaker_a, CASE WHEN site_id = 5 THEN 75.0 ELSE 75 + site_id % 2 * 25 END AS xfmr_kva,
    CASE WHEN site_id = 5 THEN 23 ELSE 20 + site_id % 5 END AS d, CASE WHEN site_id = 5 THEN 'America/Toronto' ELSE ['America/Toronto', 'America/Vancouver', 'America/Halifax', 'America/Winnipeg'][site_id % 4 + 1] END AS zone
  FROM (SELECT DISTINCT site_id FROM s) WHERE site_id <> 7),
x AS (SELECT s.*, d, xfmr_kva, {_RATED} AS rated, {_KVA} AS one, start_local AT TIME ZONE zone AT TIME ZONE 'UTC' AS start_utc FROM s JOIN c USING (site_id)),
y AS (SELECT *, CAST(start_utc - INTERVAL 5 HOUR AS DATE) AS sd, CASE WHEN charge_s = 0 THEN CASE WHEN energy = 0 THEN 0.0 ELSE rated END ELSE energy / charge_s * 3600 END AS kw FROM x),
z AS (SELECT *, CASE WHEN day(sd) > d THEN sd + INTERVAL 1 MONTH ELSE sd END AS m FROM y),
w AS (SELECT *, sqrt(pow(3 * rated, 2) + pow(3 * sqrt(pow(one / sqrt(1 + 0.045::DOUBLE * 0.045), 2) - rated * rated), 2) + pow(3 * one / sqrt(1 + 0.045::DOUBLE * 0.045) * 0.045, 2)) / xfmr_kva AS load FROM z)
SELECT site_id, make_date(CAST(year(m) AS BIGINT), CAST(month(m) AS BIGINT), CAST(d AS BIGINT)) AS period_ending, count(*) AS n, count(*) FILTER (charge_s <> 0 AND energy / (charge_s / 3600) > rated) AS n_excessive,
  min(start_utc) AS first_start, round(sum(kw), 4) AS kw, round(max(3 * rated + 0.35 + 1.6 * load * load), 6) AS three_vehicles FROM w GROUP BY ALL""")
def site_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of sites with breakers, transformers, closing days and zones of their own, in one plan."""
    rows = S.flag_sessions(with_sites(A.sessions(spark, sf_dir), _sites(spark, sf_dir)), BY_SITE)
    rows = rows.withColumn("period_ending", period_ending("start_utc", BY_SITE.bill_end_day)).withColumn("load", site_load(F.lit(3.0), BY_SITE)["kw"])
    return rows.groupBy("site_id", "period_ending").agg(
        F.count("*").alias("n"), F.count_if(F.array_contains("anomalies", "ExcessiveAvgKw")).alias("n_excessive"),
        F.min("start_utc").cast("timestamp_ntz").alias("first_start"), F.round(F.sum("avg_kw"), 4).alias("kw"), F.round(F.max("load"), 6).alias("three_vehicles"),
    )


SLICE_HOURS = 24 * 90


@query(f"""WITH {K.FILLED_SQL} SELECT meter_id, year(ts) AS year, count(*) AS n, CAST(sum(kwh) AS BIGINT) AS kwh, count(*) FILTER (list_contains(anomalies, 'MissingInterval')) AS n_missing,
  CAST(sum(epoch(ts)::BIGINT) FILTER (list_contains(anomalies, 'MissingInterval')) AS BIGINT) AS places FROM filled GROUP BY ALL""")
def sliced_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps filled in slices of ninety days, each its own task's, by meter and year."""
    filled = meter.fill_gaps(meter.readings(A.series(spark, sf_dir)), SLICE_HOURS)
    gap = F.array_contains("anomalies", "MissingInterval")
    return filled.groupBy("meter_id", F.year("ts").cast("long").alias("year")).agg(
        F.count("*").alias("n"), F.sum("kwh").alias("kwh"), F.count_if(gap).alias("n_missing"), F.sum(F.when(gap, F.unix_seconds("ts"))).alias("places")
    )

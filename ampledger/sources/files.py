"""Meter feeds read as tables, and the session table written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, SiteConfig
from ampledger.functions.timeexpr import local
from ampledger.operators.sessions import adjusted, avg_kw

TOKENS = (
    "ZeroActiveChargeTime", "ExcessiveAvgKw", "InconsistentDuration", "OffGridTimes", "DstGapShifted",
    "DstAmbiguousDuplicated", "DstUnresolvable", "WorkbookDiscrepancy", "DuplicateId",
)


#: Columns of the session table as reported, with what they are called here; then those derived from them.
REPORTED = {
    "UR_ID": None, "Location_Address": None, "Location_City": None, "Location_Postal_Code": None, "Station_ID": None,
    "Station_Network_Provider": None, "Station_Make": None, "Station_Model": None, "Charge_Session_ID": "id", "User_ID": None,
    "Conn_DateTime_Start": "start_local", "Conn_DateTime_End": "end_local", "Conn_Duration": "dur_s", "Charge_Duration": None,
    "Active_Charge_Time": "charge_s", "Charging_Level": None, "Energy_Use": "energy", "Total_Fee": None, "Vehicle_Make": None,
    "Vehicle_Model": None, "Vehicle_Year": None,
}
DERIVED = ("adj_conn_start", "adj_conn_end", "conn_start_utc", "conn_end_utc", "adj_conn_start_utc", "adj_conn_end_utc", "adj_conn_duration", "avg_kw", "anomalies")
NEEDED = ("Charge_Session_ID", "conn_start_utc", "conn_end_utc", "adj_conn_end_utc", "Conn_Duration", "Active_Charge_Time", "Energy_Use", "anomalies")


def session_table(flagged: DataFrame) -> DataFrame:
    """``site_id, path, row``, then the 21 columns of a report and the 9 derived ones; columns that a report lacked are null.

    ``adj_conn_duration`` is in seconds, and null for a span that is inverted; anomalies are comma-joined tokens.
    """
    stamp = lambda c: F.timestamp_seconds(c)
    reported = [F.col(own or n).alias(n) if (own or n) in flagged.columns else F.lit(None).cast("string").alias(n) for n, own in REPORTED.items()]
    start, end = stamp("adj_start"), stamp("adj_end")
    derived = [
        local(start), local(end), F.col("start_utc").cast("timestamp"), F.col("end_utc").cast("timestamp"), start, end,
        F.when(F.col("adj_end") >= F.col("adj_start"), F.col("adj_end") - F.col("adj_start")), F.col("avg_kw"), F.array_join("anomalies", ","),
    ]
    return flagged.select("site_id", "path", "row", *reported, *(c.alias(n) for n, c in zip(DERIVED, derived, strict=True)))


def write_sessions(flagged: DataFrame, path: str) -> None:
    """The session table, partitioned by site and month of the start.

    Written again, it replaces the months of the sites that it holds and leaves all others, so that a run that is
    repeated leaves one copy.
    """
    table = session_table(flagged).withColumn("month", F.date_format("conn_start_utc", "yyyy-MM"))
    table.write.partitionBy("site_id", "month").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored_between(stored: DataFrame, since: str, until: str) -> DataFrame:
    """Rows of a stored table that start from ``since`` up to before ``until``, instants as text; of its months only these are read."""
    first, last = F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    months = (F.col("month") >= F.date_format(first, "yyyy-MM")) & (F.col("month") <= F.date_format(last, "yyyy-MM"))
    return stored.where(months & (F.col("conn_start_utc") >= first) & (F.col("conn_start_utc") < last))


def reread(stored: DataFrame, cfg: SiteConfig = DEFAULT, tolerance: float = 1e-6) -> DataFrame:
    """A session table as sessions again, every derived figure worked out anew; what was stored never counts.

    Adds ``discrepancies``, the stored columns that differ, and ``workbook_discrepancy``. Stored
    instants must be there; a missing duration or mean power is none, as tables written by a
    spreadsheet may not hold them. Fails where one of the NEEDED columns is missing or a token
    of ``anomalies`` is unknown; rows without an id are left out.
    """
    missing = [c for c in NEEDED if c not in stored.columns]
    if missing:
        raise ValueError(f"the session table lacks {', '.join(missing)}")
    rows = stored.where("Charge_Session_ID is not null and trim(Charge_Session_ID) <> ''")
    tokens = F.when(F.col("anomalies") == "", F.array().cast("array<string>")).otherwise(F.split("anomalies", ","))
    unknown = F.array_except(tokens, F.array(*(F.lit(t) for t in TOKENS)))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown anomaly "), F.element_at(unknown, 1)))).otherwise(tokens)
    own = {n: F.col(n).alias(c) for n, c in REPORTED.items() if c and n in stored.columns}
    kept = [c for c in stored.columns if c not in own and c not in DERIVED]
    held = [F.col(c).alias(f"_{c}") for c in DERIVED if c in stored.columns and c != "anomalies"]
    fresh = adjusted(
        rows.select(*kept, *own.values(), F.col("conn_start_utc").alias("start_utc"), F.col("conn_end_utc").alias("end_utc"), checked.alias("anomalies"), *held)
    )
    zero, fits = F.col("charge_s") == 0, ~F.array_contains("anomalies", "InconsistentDuration")
    fresh = fresh.withColumns({"avg_kw": avg_kw(cfg), "bucket": F.when(~fits, "excluded").when(zero, "spike").otherwise("session")})
    instant_of = {"adj_conn_start_utc": "adj_start", "adj_conn_end_utc": "adj_end"}
    differs = [F.when(~F.unix_seconds(F.col(f"_{n}").cast("timestamp")).eqNullSafe(F.col(c)), n) for n, c in instant_of.items() if n in stored.columns]
    span = F.when(F.col("adj_end") >= F.col("adj_start"), F.col("adj_end") - F.col("adj_start"))
    for n, c in (("adj_conn_duration", span), ("avg_kw", F.col("avg_kw"))):
        if n in stored.columns:
            differs.append(F.when(F.abs(F.col(f"_{n}").cast("double") - c) > tolerance, n))
    found = F.filter(F.array(*differs, F.lit(None).cast("string")), lambda x: x.isNotNull())
    out = fresh.withColumn("discrepancies", found).withColumn("workbook_discrepancy", F.size("discrepancies") > 0)
    return out.drop(*(f"_{c}" for c in DERIVED))


def read_sessions(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Reads a written session table back, by ``reread``; with ``since`` and ``until`` the sessions that ``stored_between`` keeps."""
    stored = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    return reread(stored if since is None and until is None else stored_between(stored, since or "0001-01-01", until or "9999-12-31"))


UNITS = (72, 38, 61)  # Wh, W and VA: what an export carries
_LINK = "array<struct<_rel:string,_href:string>>"
_ENTRY = f"""link {_LINK}, content struct<
  ReadingType:struct<uom:int,powerOfTenMultiplier:int,intervalLength:long>,
  IntervalBlock:array<struct<IntervalReading:array<struct<timePeriod:struct<duration:long,start:long>,value:long>>>>>"""


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """The flat entries of meter feeds, one row each, with their place in the document."""
    reader = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(_ENTRY)
    return reader.load(path).select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"))


def feed_series(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(series, errors)``: blocks joined to their meter reading and that to its reading type.

    A block's meter reading, and a reading's type, is the first related link that leads to
    one, within the same file. ``errors(path, href, error)``: DanglingLink, NotHourly,
    RepeatedUnit where a file has two types of one unit, and of the three units EmptySeries
    where one has a type but no reading and AbsentSeries where it has no type. The series are
    ``path, uom, power_of_ten, ts, value, doc_order``; the order is that of path, entry and reading, which no
    size of file or number of tasks can overflow.
    """
    rel = lambda name: F.filter("link", lambda x: x["_rel"] == name)
    own = F.element_at(F.transform(rel("self"), lambda x: x["_href"]), 1)
    e = entries.withColumn("self", own).withColumn("to", F.transform(rel("related"), lambda x: x["_href"]))
    types = e.where("content.ReadingType is not null").select("path", F.col("self").alias("type"), "content.ReadingType.*")
    meters = e.where(F.col("content.ReadingType").isNull() & F.col("content.IntervalBlock").isNull())
    hops = meters.select("path", F.col("self").alias("meter"), F.posexplode("to").alias("nth", "type")).join(types, ["path", "type"])
    first = F.row_number().over(Window.partitionBy("path", "meter").orderBy("nth"))
    typed = hops.withColumn("k", first).where("k = 1").select("path", "meter", "type", "uom", "powerOfTenMultiplier", "intervalLength")
    blocks = e.where("content.IntervalBlock is not null").select("path", "place", "self", "to", "content.IntervalBlock")
    tried = blocks.select("path", "place", F.posexplode("to").alias("nth", "meter")).join(typed, ["path", "meter"])
    best = F.row_number().over(Window.partitionBy("path", "place").orderBy("nth"))
    linked = tried.withColumn("k", best).where("k = 1").drop("k", "nth")
    joined = blocks.join(linked, ["path", "place"], "left")
    readings = joined.select("path", "place", "self", "uom", "powerOfTenMultiplier", "intervalLength", F.posexplode(F.flatten(F.transform("IntervalBlock", lambda b: b["IntervalReading"]))).alias("n", "r"))
    series = readings.where("uom is not null and intervalLength = 3600 and r.timePeriod.duration = 3600").select(
        "path", "uom", F.col("powerOfTenMultiplier").alias("power_of_ten"), F.timestamp_seconds("r.timePeriod.start").alias("ts"),
        F.col("r.value").alias("value"), F.struct("path", "place", F.col("n").cast("long").alias("n")).alias("doc_order"),
    )
    dangling = joined.where("uom is null").select("path", F.col("self").alias("href"), F.lit("DanglingLink").alias("error"))
    odd = readings.where("uom is not null and not (intervalLength <=> 3600 and r.timePeriod.duration <=> 3600)")
    hourly = odd.select("path", F.col("self").alias("href"), F.lit("NotHourly").alias("error")).distinct()
    twice = types.groupBy("path", "uom").agg(F.count("*").alias("n"), F.max("type").alias("href")).where("n > 1")
    found = series.select("path", "uom").distinct()
    empty = types.where(F.col("uom").isin(*UNITS)).join(found, ["path", "uom"], "left_anti").select("path", F.col("type").alias("href"), F.lit("EmptySeries").alias("error"))
    wanted = entries.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, UNITS))).alias("uom"))
    absent = wanted.join(types, ["path", "uom"], "left_anti").select("path", F.lit(None).cast("string").alias("href"), F.concat(F.lit("AbsentSeries("), F.col("uom").cast("string"), F.lit(")")).alias("error"))
    errors = dangling.unionByName(hourly).unionByName(twice.select("path", "href", F.lit("RepeatedUnit").alias("error")))
    return series, errors.unionByName(empty).unionByName(absent)


def read_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(series, errors)`` of ``feed_series``, with no reading of a file that has an error."""
    series, errors = feed_series(feed_entries(spark, path))
    return series.join(errors.select("path").distinct(), "path", "left_anti"), errors


def meter_series(series: DataFrame, meters: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """``meter_id, uom, power_of_ten, ts, value, doc_order`` of ``feed_series``, as ``meter.readings`` takes it.

    ``meters(path, meter_id)`` names each file's meter; without it a file is a meter, by its
    path. Files that ``meters`` does not list, and those with any of ``errors(path, ...)``, are left out.
    """
    if errors is not None:
        series = series.join(errors.select("path").distinct(), "path", "left_anti")
    named = series.withColumn("meter_id", F.col("path")) if meters is None else series.join(meters, "path")
    return named.select("meter_id", "uom", "power_of_ten", "ts", "value", "doc_order")

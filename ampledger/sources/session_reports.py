"""Session report files: each read by its own header, and files with a bad cell refused whole.

Files may differ in the order and number of their columns. Records are read without names, one
task a file, and every cell is looked up by the header of its own file, so all files are one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampledger.functions.timeexpr import col
from ampledger.sources.scratch import written

#: Report columns that must be there, by trimmed header name, and what they are called here.
REQUIRED = {
    "Charge_Session_ID": "id",
    "Conn_DateTime_Start": "conn_start",
    "Conn_DateTime_End": "conn_end",
    "Conn_Duration": "conn_duration",
    "Active_Charge_Time": "active_time",
    "Energy_Use": "energy_use",
}
TYPED = {"start_local": "conn_start", "end_local": "conn_end", "dur_s": "conn_duration", "charge_s": "active_time", "energy": "energy_use"}
MAX_COLUMNS = 256  # cells of a record; a file whose header is wider is refused
MAX_NAMES = 1000  # distinct names of columns, over all files, that pass through

_OWN = {"path", "row", "position", "site_id", "parse_error", *REQUIRED.values(), *TYPED}


def wall_time(text: Column | str) -> Column:
    """``2026-06-15 9:05`` or ``2026-06-15 09:05:30`` as a wall time; null if it is none."""
    t = F.trim(col(text))
    shape = t.rlike(r"^\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}(:\d{2})?$")
    full = F.when(F.regexp_count(t, F.lit(":")) == 1, F.concat(t, F.lit(":00"))).otherwise(t)
    return F.when(shape, F.try_to_timestamp(full, F.lit("yyyy-MM-dd H:mm:ss")).cast("timestamp_ntz"))


def clock_seconds(text: Column | str) -> Column:
    """``H:MM:SS`` with any number of hours, as seconds; null if it is none."""
    t = F.trim(col(text))
    h, m, s = (F.regexp_extract(t, r"^(\d{1,9}):(\d{1,2}):(\d{1,2})$", i).try_cast("long") for i in (1, 2, 3))
    return F.when((m < 60) & (s < 60), h * 3600 + m * 60 + s)


def type_sessions(raw: DataFrame) -> DataFrame:
    """Text cells to ``start_local, end_local, dur_s, charge_s, energy``; ``parse_error`` names the first bad cell.

    A ``parse_error`` that the rows have already goes first.
    """
    typed = raw.withColumns(
        {
            "start_local": wall_time("conn_start"),
            "end_local": wall_time("conn_end"),
            "dur_s": clock_seconds("conn_duration"),
            "charge_s": clock_seconds("active_time"),
            "energy": F.trim("energy_use").try_cast("double"),
        }
    )
    known = [F.col("parse_error")] if "parse_error" in raw.columns else []
    bad = F.coalesce(*known, *(F.when(F.col(c).isNull(), F.lit(source)) for c, source in TYPED.items()))
    return typed.withColumn("parse_error", bad).drop(*TYPED.values())


def _plain(path: Column) -> Column:
    """A path without its scheme and with single slashes, as paths are stated in more than one way."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), "/+", "/")


def _scan(spark: SparkSession, path: str | list[str], columns: int) -> DataFrame:
    """The first ``columns`` cells of all records, headers too, one task a file.

    The schema has one column more, which is left out: where columns are pruned, a record that is shorter or longer
    than the schema raises nothing in the parser, which otherwise raises and drops an error for every missing cell.
    """
    schema = ", ".join(f"_c{k} string" for k in range(columns + 1))
    reader = spark.read.schema(schema).option("header", False).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    return reader.option("columnPruning", True).csv(path)


def _most_cells(spark: SparkSession, path: str | list[str], columns: int) -> int:
    """The place of the last cell, up to ``columns``, that any record of the files has."""
    last = F.coalesce(*(F.when(F.col(f"_c{k}").isNotNull(), k + 1) for k in reversed(range(columns))))
    return _scan(spark, path, columns).select(last.alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1


def _records(spark: SparkSession, path: str | list[str], columns: int) -> DataFrame:
    """``path, place, cells``: all records of the files, headers too, in order of place within a file; cells beyond ``columns`` are not read."""
    cells = F.array(*(F.col(f"_c{k}") for k in range(columns)))
    raw = _scan(spark, path, columns).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("place"), cells.alias("cells"))
    wide = F.coalesce(F.array_max(F.transform("cells", lambda c, k: F.when(c.isNotNull(), k + 1))), F.lit(0))
    return raw.withColumn("cells", F.slice("cells", F.lit(1), wide))


def file_headers(records: DataFrame) -> DataFrame:
    """``path, first, names``: each file's header line, trimmed, and its place; of names that repeat, the last column counts."""
    heads = records.groupBy("path").agg(F.min("place").alias("first"), F.min_by("cells", "place").alias("names"))
    return heads.withColumn("names", F.transform("names", lambda n: F.trim(F.coalesce(n, F.lit("")))))


def _cell(name: str) -> Column:
    """The cell under ``name``; null where the file has no such column, or the record ends before it."""
    at = F.array_position(F.reverse("names"), name)
    return F.when(at > 0, F.get("cells", (F.size("names") - at).cast("int")))


def _called(names: list[str]) -> dict[str, str]:
    """What columns that pass through are called: as in the file, unless the library or, but for case, another has the name."""
    taken, out = {n.lower() for n in _OWN}, {}
    for n in names:
        called = n if n.lower() not in taken else f"report_{n}"
        while called.lower() in taken:
            called += "_"
        taken.add(called.lower())
        out[n] = called
    return out


def session_reports(
    spark: SparkSession,
    path: str | list[str],
    order: DataFrame | None = None,
    through: list[str] | None = None,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """The rows of report files, typed, with ``path`` and ``row``; the header is row 1, blank lines do not count.

    ``parse_error`` names the first bad cell of a row, or a required column that its file lacks, or
    says that a record is longer than the header, or the header longer than ``max_columns``; see ``quarantine``.
    Other columns pass through as text: those of ``through``, or without it all that any file has, null in
    files that lack them. One that is called like a column of the library has ``report_`` before its name.
    ``order(path, position)`` states the order in which the files were given: it adds ``position``, null for
    files not listed. A file with nothing after its header has no rows, an empty folder gives none.
    """
    records = _records(spark, path, _most_cells(spark, path, max_columns + 1))
    heads = written(file_headers(records), "report-headers")
    if through is None:
        found = heads.select(F.explode("names").alias("n")).where("n <> ''").distinct().limit(MAX_NAMES + 1).collect()
        if len(found) > MAX_NAMES:
            raise ValueError(f"the reports have more than {MAX_NAMES} names of columns: state the ones to keep")
        through = sorted(r.n for r in found if r.n not in REQUIRED)
    rows = records.join(heads, "path").where("place > first")
    absent = F.coalesce(*(F.when(~F.array_contains("names", n), F.concat(F.lit("missing column "), F.lit(n))) for n in REQUIRED))
    wide = F.when(F.size("names") > max_columns, "too many columns").when(F.size("cells") > F.size("names"), "more cells than columns")
    called = _called(through)
    typed = type_sessions(
        rows.select(
            "path", (F.col("place") - F.col("first") + 1).alias("row"), F.coalesce(wide, absent).alias("parse_error"),
            *(_cell(n).alias(c) for n, c in REQUIRED.items()), *(_cell(n).alias(c) for n, c in called.items()),
        )
    ).withColumn("id", F.trim(F.coalesce("id", F.lit(""))))
    if order is None:
        return typed
    listed = order.groupBy(_plain(F.col("path")).alias("_path")).agg(F.min("position").cast("long").alias("position"))
    return typed.withColumn("_path", _plain(F.col("path"))).join(listed, "_path", "left").drop("_path")


def quarantine(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``: a file with one bad cell is refused whole, as its other figures are not to be trusted.

    ``refused(path, first_row, cell)`` names the first bad cell by row; ``accepted`` has the rows of all
    other files, without ``parse_error``, as ``flag_sessions`` takes them.
    """
    first = F.min(F.struct("row", "parse_error")).alias("at")
    refused = typed.where("parse_error is not null").groupBy("path").agg(first)
    refused = refused.select("path", F.col("at.row").alias("first_row"), F.col("at.parse_error").alias("cell"))
    return typed.join(refused.select("path"), "path", "left_anti").drop("parse_error"), refused

"""Charging sessions: instants, flags, buckets, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, GRID_S, ZONE, SiteConfig
from ampledger.functions.timeexpr import instant, local, on_grid, seconds


def resolve_times(rows: DataFrame, zone: Column | str = ZONE) -> DataFrame:
    """Adds ``start_utc, end_utc, dst`` from wall times; a fold that either instant explains gives two rows.

    A start inside a gap is shifted on by the gap and flagged. A start inside a fold is tried
    as both instants against the reported end, in wall time and within (-60 s, +61 s): one
    fit decides, two give a row each (ids end in -EDT and -EST), none gives the earlier,
    flagged. An end inside a fold is the instant nearest to start plus duration, the earlier
    on a tie.
    """
    wall_end = F.unix_seconds(F.col("end_local").cast("timestamp"))
    early = instant("start_local", zone)
    late = F.timestamp_seconds(F.unix_seconds(early) + 3600)
    folded = local(late, zone) == F.col("start_local")
    gap = local(early, zone) != F.col("start_local")

    def explains(start: Column) -> Column:
        off = seconds(local(F.timestamp_seconds(F.unix_seconds(start) + F.col("dur_s")), zone)) - wall_end
        return (off > -60) & (off < 61)

    def case(start: Column, suffix: str, flag: str | None) -> Column:
        return F.struct(start.alias("start"), F.lit(suffix).alias("suffix"), F.lit(flag).cast("string").alias("dst"))

    a, b = explains(early), explains(late)
    cases = (
        F.when(early.isNull(), F.array(case(early, "", None)))
        .when(~folded & gap, F.array(case(early, "", "DstGapShifted")))
        .when(~folded, F.array(case(early, "", None)))
        .when(a & b, F.array(case(early, "-EDT", "DstAmbiguousDuplicated"), case(late, "-EST", "DstAmbiguousDuplicated")))
        .when(b, F.array(case(late, "", None)))
        .when(a, F.array(case(early, "", None)))
        .otherwise(F.array(case(early, "", "DstUnresolvable")))
    )
    rows = rows.withColumn("c", F.explode(cases))
    end_early = instant("end_local", zone)
    end_late = F.timestamp_seconds(F.unix_seconds(end_early) + 3600)
    aim = F.unix_seconds("c.start") + F.col("dur_s")
    nearer = F.abs(F.unix_seconds(end_late) - aim) < F.abs(F.unix_seconds(end_early) - aim)
    end = F.when((local(end_late, zone) == F.col("end_local")) & nearer, end_late).otherwise(end_early)
    return rows.select(
        *(c for c in rows.columns if c not in ("c", "id")),
        F.concat("id", "c.suffix").alias("id"),
        F.col("c.start").alias("start_utc"),
        end.alias("end_utc"),
        F.col("c.dst").alias("dst"),
    )


def adjusted(rows: DataFrame) -> DataFrame:
    """``adj_start, adj_end`` in seconds: the widest span that times stated to the minute allow."""
    s, e = seconds("start_utc"), seconds("end_utc") + 1
    return rows.withColumns(
        {"adj_start": s - F.pmod(s, F.lit(GRID_S)), "adj_end": e - F.pmod(e, F.lit(GRID_S)) + GRID_S}
    )


def duration_fits() -> Column:
    """Reported duration against reported start and end, within what rounding to minutes allows."""
    s, e, d = seconds("start_utc"), seconds("end_utc"), F.col("dur_s")
    return (s <= e) & (s + d < e + 61) & (e - 60 < s + d)


def avg_kw(cfg: SiteConfig = DEFAULT) -> Column:
    """Mean power over the active time; without any, 0 for no energy and the breaker rating otherwise."""
    stuck = (F.col("charge_s") == 0) | F.isnan("energy")
    return F.when(stuck, F.when(F.col("energy") == 0, 0.0).otherwise(F.lit(cfg.rating_kw))).otherwise(
        F.col("energy") / F.col("charge_s") * 3600
    )


def flag_sessions(rows: DataFrame, cfg: SiteConfig = DEFAULT) -> DataFrame:
    """Resolved sessions with adjusted span, ``avg_kw``, ``anomalies`` in their fixed order and ``bucket``.

    bucket: excluded if the duration is inconsistent, spike without active time, else session; none where
    a figure is null, so that no such row is ever counted. Rows that still carry ``parse_error`` are not taken: the
    files with a bad cell are to be refused first, by ``quarantine``.
    """
    if "parse_error" in rows.columns:
        raise ValueError("refuse the files with a bad cell first: sources.session_reports.quarantine")
    rows = adjusted(resolve_times(rows, cfg.zone))
    zero, fits = F.col("charge_s") == 0, duration_fits()
    flags = F.array(
        F.when(zero, "ZeroActiveChargeTime"),
        F.when(~zero & (F.col("energy") / (F.col("charge_s") / 3600) > cfg.rating_kw), "ExcessiveAvgKw"),
        F.col("dst"),
        F.when(~fits, "InconsistentDuration"),
        F.when(~(on_grid("start_utc", GRID_S) & on_grid("end_utc", GRID_S)), "OffGridTimes"),
    )
    return rows.withColumns(
        {
            "avg_kw": avg_kw(cfg),
            "anomalies": F.filter(flags, lambda f: f.isNotNull()),
            "bucket": F.when(_whole(), F.when(~fits, "excluded").when(zero, "spike").otherwise("session")),
        }
    ).drop("dst")


def _whole() -> Column:
    """No figure of the row is null."""
    return F.col("energy").isNotNull() & F.col("charge_s").isNotNull() & F.col("dur_s").isNotNull() & F.col("start_utc").isNotNull() & F.col("end_utc").isNotNull()


def _given(rows: DataFrame) -> list[Column]:
    """The order of files: by ``position`` where rows have one, files without it last, then by path."""
    return [F.col("position").asc_nulls_last(), F.col("path")] if "position" in rows.columns else [F.col("path")]


_BUCKETS = {"session": 0, "spike": 1, "excluded": 2}


def deduplicate(flagged: DataFrame) -> DataFrame:
    """One row of each set that agrees in site, id, adjusted span, active time and energy: the first in merge order.

    Merge order is file, then bucket, then row; files are in the order given by ``position``, or that of their paths. Energies that are not numbers never agree.
    ``duplicate_id`` marks every row whose (site, id) is left more than once.
    """
    rank = F.create_map(*(F.lit(x) for kv in _BUCKETS.items() for x in kv))[F.col("bucket")]
    odd = F.when(F.isnan("energy"), F.concat_ws(":", "path", F.col("row").cast("string")))
    same = Window.partitionBy("site_id", "id", "adj_start", "adj_end", "charge_s", "energy", odd)
    first = F.row_number().over(same.orderBy(*_given(flagged), rank, "row"))
    kept = flagged.withColumn("nth", first).where("nth = 1").drop("nth")
    return kept.withColumn("duplicate_id", F.count("*").over(Window.partitionBy("site_id", "id")) > 1)


def coverage(flagged: DataFrame) -> DataFrame:
    """First and last local date of each site's sessions, with counts by bucket."""
    return flagged.groupBy("site_id").agg(
        F.min(F.to_date(local("start_utc"))).alias("first_date"),
        F.max(F.to_date(local("end_utc"))).alias("last_date"),
        *(F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in _BUCKETS),
    )


def off_grid_summary(flagged: DataFrame) -> DataFrame:
    """Rows off the minute grid of each file: how many, of how many, and the first three.

    Only three rows of a task and file are shuffled for the examples, however many are off the grid.
    """
    off = F.array_contains("anomalies", "OffGridTimes")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("row"))
    firsts = flagged.where(off).select("path", "row").withColumn("nth", nth).where("nth <= 3")
    firsts = firsts.groupBy("path").agg(F.array_sort(F.collect_list("row")).alias("first_rows"))
    counts = flagged.groupBy("path").agg(F.count_if(off).alias("n_off"), F.count("*").alias("n"))
    none = F.array().cast("array<long>")
    return counts.join(firsts, "path", "left").select("path", "n_off", "n", F.coalesce("first_rows", none).alias("first_rows"))


def sources(merged: DataFrame) -> DataFrame:
    """``site_id, nth, path, n_sessions``: the files that each site's sessions are from, in the order in which they first come up."""
    rank = F.create_map(*(F.lit(x) for kv in _BUCKETS.items() for x in kv))[F.col("bucket")]
    given = [F.coalesce("position", F.lit(2**62)).alias("at")] if "position" in merged.columns else []
    each = merged.groupBy("site_id", "path").agg(F.min(F.struct(*given, F.col("path").alias("p"), rank.alias("b"), "row")).alias("at"), F.count("*").alias("n_sessions"))
    nth = F.row_number().over(Window.partitionBy("site_id").orderBy("at"))
    return each.select("site_id", nth.cast("long").alias("nth"), "path", "n_sessions")

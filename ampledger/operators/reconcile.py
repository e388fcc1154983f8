"""Figures held against each other: meter with bill, stored with recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampledger.config import MID, OFF, ON
from ampledger.operators.bills import agrees_truncated


def demand(measured: DataFrame, printed: DataFrame, figures: tuple[str, ...], energy: tuple[str, ...] = (), tolerance: float = 0.001) -> DataFrame:
    """Whether each printed demand is the measured one cut to three decimals, and each energy within ``tolerance``.

    A row on one side only is named in ``unmatched``.
    """
    keys, every = ["meter_id", "period_ending"], (*figures, *energy)
    m = measured.select(*keys, *(F.col(f).alias(f"m_{f}") for f in every), F.lit(True).alias("has_m"))
    p = printed.select(*keys, *(F.col(f).alias(f"p_{f}") for f in every), F.lit(True).alias("has_p"))
    both = m.join(p, keys, "full")
    unmatched = F.when(F.col("has_p").isNull(), "meter").when(F.col("has_m").isNull(), "bill")
    cut = [agrees_truncated(F.col(f"m_{f}"), F.col(f"p_{f}")).alias(f"{f}_agrees") for f in figures]
    near = [(F.abs(F.col(f"m_{f}") - F.col(f"p_{f}")) <= tolerance).alias(f"{f}_agrees") for f in energy]
    return both.select(*keys, *cut, *near, unmatched.alias("unmatched"))


def band_energy(metered: DataFrame, printed: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Metered energy of each band against the bill's, which is stated after the loss factor.

    From ``metered(meter_id, period_ending, tou, kwh)`` and bills with ``on_peak_kwh, mid_peak_kwh,
    off_peak_kwh, loss_factor_adjustment``. A band on one side only is named in ``unmatched``; a zero
    or missing loss factor leaves ``expected`` and ``agrees`` null.
    """
    keys = ["meter_id", "period_ending", "tou"]
    stated = F.explode(F.array(*(F.struct(F.lit(t).alias("tou"), F.col(c).alias("stated")) for t, c in ((ON, "on_peak_kwh"), (MID, "mid_peak_kwh"), (OFF, "off_peak_kwh")))))
    p = printed.select("meter_id", "period_ending", "loss_factor_adjustment", stated.alias("b")).select(
        *keys[:2], "b.tou", F.try_divide("b.stated", "loss_factor_adjustment").alias("expected"), F.lit(True).alias("has_p")
    )
    both = metered.select(*keys, "kwh", F.lit(True).alias("has_m")).join(p, keys, "full")
    unmatched = F.when(F.col("has_p").isNull(), "meter").when(F.col("has_m").isNull(), "bill")
    off_by = F.col("kwh") - F.col("expected")
    return both.select(*keys, "kwh", "expected", off_by.alias("off_by"), (F.abs(off_by) < tolerance).alias("agrees"), unmatched.alias("unmatched"))


def stored_discrepancies(stored: DataFrame, fresh: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows whose stored derived columns differ from the recomputed ones, with the columns' names; null differs from a value."""
    both = stored.select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns)).join(fresh.select(*keys, *columns), keys)

    def differs(c: str):
        a, b = F.col(f"old_{c}").cast("double"), F.col(c).cast("double")
        return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))

    found = F.filter(F.array(*(F.when(differs(c), c) for c in columns)), lambda x: x.isNotNull())
    return both.withColumn("columns", found).where(F.size("columns") > 0).select(*keys, "columns")

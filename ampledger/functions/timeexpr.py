"""Instants are timestamps with the session zone at UTC; wall times are timestamp_ntz.

Two clocks: prevailing local time for bands, holidays and sessions; UTC-5 all year for
billing boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampledger.config import STANDARD_OFFSET_S, ZONE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ts: Column | str) -> Column:
    return F.unix_seconds(col(ts).cast("timestamp"))


def floor_to(ts: Column | str, step: int) -> Column:
    """The last grid point at or before the instant, before 1970 too."""
    s = seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(step)))


def on_grid(ts: Column | str, step: int) -> Column:
    return F.pmod(seconds(ts), F.lit(step)) == 0


def local(ts: Column | str, zone: Column | str = ZONE) -> Column:
    """Prevailing wall time of an instant."""
    return F.from_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def instant(wall: Column | str, zone: Column | str = ZONE) -> Column:
    """Instant of a wall time: the earlier one in a fold, shifted on by its length in a gap."""
    return F.to_utc_timestamp(col(wall).cast("timestamp"), zone)


def standard_date(ts: Column | str) -> Column:
    """Date at UTC-5."""
    return F.to_date(F.timestamp_seconds(seconds(ts) - STANDARD_OFFSET_S))


def standard_midnight(day: Column | str) -> Column:
    return F.timestamp_seconds(F.unix_seconds(col(day).cast("timestamp")) + STANDARD_OFFSET_S)


def period_ending(ts: Column | str, day: Column | int = 23) -> Column:
    """Closing date of the billing period that holds the instant."""
    sd = standard_date(ts)
    month = F.when(F.dayofmonth(sd) > day, F.add_months(sd, 1)).otherwise(sd)
    return F.make_date(F.year(month), F.month(month), F.lit(day))


def period_start(ending: Column | str, day: Column | int = 23) -> Column:
    """First instant of the period with that closing date: standard midnight after the one before."""
    return standard_midnight(F.date_add(F.add_months(col(ending), -1), 1))


def period_end(ending: Column | str) -> Column:
    """First instant after the period."""
    return standard_midnight(F.date_add(col(ending), 1))

"""Sites that differ: the constants of ``config.SiteConfig`` as columns of a table, in place of one site's numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampledger.config import DEFAULT

#: Columns of a site table, with the value that stands where a site states none.
COLUMNS = (
    "panel_v", "breaker_a", "derate", "ev_pf", "ev_thd", "xfmr_kva", "no_load_kw", "full_load_kw", "magnetizing_pu", "reactance_pu", "bill_end_day", "zone",
)


class SiteColumns:
    """The same names as ``SiteConfig``, each a column: pass it as ``cfg`` to operators over rows that ``with_sites`` made."""

    def __getattr__(self, name: str) -> Column:
        if name not in COLUMNS:
            raise AttributeError(name)
        return F.col(f"cfg_{name}")

    @property
    def distortion_factor(self) -> Column:
        return 1.0 / F.sqrt(1.0 + self.ev_thd * self.ev_thd)

    @property
    def ev_kva(self) -> Column:
        return self.panel_v * (self.breaker_a * self.derate) / 1000.0

    @property
    def rating_kw(self) -> Column:
        return self.ev_kva * self.ev_pf

    @property
    def ev_kvar(self) -> Column:
        full = self.ev_kva * self.distortion_factor
        return F.sqrt(full * full - self.rating_kw * self.rating_kw)

    @property
    def ev_distortion(self) -> Column:
        return self.ev_kva * self.distortion_factor * self.ev_thd


BY_SITE = SiteColumns()


def checked_sites(sites: DataFrame) -> DataFrame:
    """``sites`` with all COLUMNS, defaults where one is null or not there, and ``error`` where a site contradicts itself.

    NotAClosingDay: a period must end on day 1 to 27; PowerFactor: it exceeds what the current distortion allows.
    """
    kinds = {"bill_end_day": "int", "zone": "string"}
    filled = [
        F.coalesce(F.col(c).cast(kinds.get(c, "double")) if c in sites.columns else F.lit(None), F.lit(getattr(DEFAULT, c))).alias(c) for c in COLUMNS
    ]
    rows = sites.select(*(c for c in sites.columns if c not in COLUMNS), *filled)
    allowed = 1.0 / F.sqrt(1.0 + F.col("ev_thd") * F.col("ev_thd"))
    error = F.when(~F.col("bill_end_day").between(1, 27), "NotAClosingDay").when(F.col("ev_pf") > allowed, "PowerFactor")
    return rows.withColumn("error", error)


def with_sites(rows: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """``rows`` with the constants of their site as ``cfg_`` columns, for ``BY_SITE``.

    Sites with an ``error`` have no rows; a site that the table does not list has the defaults.
    """
    table = checked_sites(sites).select(F.col(key).alias("_site"), F.col("error").alias("_error"), *(F.col(c).alias(f"cfg_{c}") for c in COLUMNS))
    met = rows.join(table, rows[key] == table["_site"], "left").where("_error is null").drop("_site", "_error")
    return met.withColumns({f"cfg_{c}": F.coalesce(f"cfg_{c}", F.lit(getattr(DEFAULT, c))) for c in COLUMNS})

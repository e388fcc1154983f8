"""Electrical load as columns: vehicles, transformer, quadrature sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampledger.config import DEFAULT, SiteConfig


def apparent(kw: Column, kvar: Column, distortion: Column) -> Column:
    return F.sqrt(kw * kw + kvar * kvar + distortion * distortion)


def site_load(vehicles: Column, cfg: SiteConfig = DEFAULT) -> dict[str, Column]:
    """Load at the transformer primary of a (fractional) number of vehicles: kw, kvar, distortion, kva, pf, loading."""
    kw, kvar, dist = vehicles * cfg.rating_kw, vehicles * cfg.ev_kvar, vehicles * cfg.ev_distortion
    x = apparent(kw, kvar, dist) / cfg.xfmr_kva
    all_kw = kw + cfg.no_load_kw + cfg.full_load_kw * x * x
    all_kvar = kvar + cfg.magnetizing_pu * cfg.xfmr_kva + cfg.reactance_pu * cfg.xfmr_kva * x * x
    kva = apparent(all_kw, all_kvar, dist)
    return {
        "kw": all_kw, "kvar": all_kvar, "distortion": dist, "kva": kva,
        "pf": F.when(kva == 0, 1.0).otherwise(all_kw / kva), "loading": kva / cfg.xfmr_kva,
    }

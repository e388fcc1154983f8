"""Site constants and closed lists.

Fixed values: they must equal those of the installation and the utility's rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

ZONE = "America/Toronto"
STANDARD_OFFSET_S = 5 * 3600  # billing boundaries lie at midnight of UTC-5 all year

GRID_S = 60
SEGMENT_S = 900
METER_S = 3600
MAX_GAP_HOURS = 17_520

ON, MID, OFF = "OnPeak", "MidPeak", "OffPeak"
#: (from hour, band) of a weekday; weekends and holidays are OffPeak all day.
SUMMER = ((0, OFF), (7, MID), (11, ON), (17, MID), (19, OFF))
WINTER = ((0, OFF), (7, ON), (11, MID), (17, ON), (19, OFF))
SUMMER_MONTHS = (5, 10)


@dataclass(frozen=True)
class SiteConfig:
    """One site's panel, vehicles, transformer and billing day."""

    panel_v: float = 208.0
    breaker_a: float = 40.0
    derate: float = 0.80
    ev_pf: float = 0.99
    ev_thd: float = 0.045
    xfmr_kva: float = 75.0
    no_load_kw: float = 0.35
    full_load_kw: float = 1.6
    magnetizing_pu: float = 0.02
    reactance_pu: float = 0.04
    bill_end_day: int = 23
    zone: str = ZONE

    def __post_init__(self) -> None:
        if not 1 <= self.bill_end_day <= 27:
            raise ValueError("a period must end on day 1 to 27")
        if self.ev_pf > self.distortion_factor:
            raise ValueError("the power factor exceeds what the current distortion allows")

    @property
    def distortion_factor(self) -> float:
        return 1.0 / math.sqrt(1.0 + self.ev_thd**2)

    @property
    def ev_kva(self) -> float:
        return self.panel_v * (self.breaker_a * self.derate) / 1000.0

    @property
    def rating_kw(self) -> float:
        return self.ev_kva * self.ev_pf

    @property
    def ev_kvar(self) -> float:
        return math.sqrt((self.ev_kva * self.distortion_factor) ** 2 - self.rating_kw**2)

    @property
    def ev_distortion(self) -> float:
        return self.ev_kva * self.distortion_factor * self.ev_thd


DEFAULT = SiteConfig()

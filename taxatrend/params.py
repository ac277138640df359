"""Every window and threshold of the insights, in one immutable value."""

from __future__ import annotations

import calendar
from dataclasses import asdict, dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class Window:
    """Closed interval of local calendar days."""

    start: str
    end: str

    @property
    def years(self) -> str:
        return f"{self.start[:4]}–{self.end[:4]}"

    @property
    def months(self) -> int:
        """Calendar months touched by the window."""
        (ys, ms), (ye, me) = (map(int, d.split("-")[:2]) for d in (self.start, self.end))
        return (ye - ys) * 12 + (me - ms) + 1


def month_window(month: str) -> Window:
    """First to last day of a ``YYYY-MM`` month."""
    y, m = map(int, month.split("-"))
    return Window(f"{month}-01", f"{month}-{calendar.monthrange(y, m)[1]:02d}")


def add_months(day: date, n: int) -> date:
    """Month arithmetic that clamps to the last day of the month, as Spark's ``add_months``."""
    y, m0 = divmod(day.year * 12 + day.month - 1 + n, 12)
    return date(y, m0 + 1, min(day.day, calendar.monthrange(y, m0 + 1)[1]))


@dataclass(frozen=True)
class Params:
    # The published default settings.
    version: str = "2026-10-04.3"
    report_month: str = "2026-09"
    tier_min_records: int = 100
    tier_since: str = "2015-01-01"
    baseline: Window = field(default_factory=lambda: Window("2015-01-01", "2019-12-31"))

    lookback_months: int = 36
    evidence_gap_max_records: int = 10
    regional_min_baseline_records: int = 5

    baseline_window: Window = field(default_factory=lambda: Window("2017-01-01", "2019-12-31"))
    recent_window: Window = field(default_factory=lambda: Window("2022-01-01", "2024-12-31"))
    aoo_fine_cell_m: int = 2000
    aoo_coarse_cell_m: int = 10000
    wild_only: bool = True
    flag_change: float = 0.3
    range_min_records: int = 20
    min_precise_share: float = 0.5

    decline_ratio: float = 0.7
    increase_ratio: float = 1 / 0.7
    z: float = 1.96
    min_detections: int = 20
    rate_min_records: int = 20

    min_taxa: int = 3
    alpha: float = 0.05

    outside_range_km: float = 100
    out_of_season_max_share: float = 0.01
    season_min_baseline_records: int = 100

    @property
    def report(self) -> Window:
        return month_window(self.report_month)

    @property
    def silence(self) -> Window:
        """The look-back window ending with the report month."""
        end = date.fromisoformat(self.report.end)
        return Window((add_months(end, -self.lookback_months) + timedelta(days=1)).isoformat(), self.report.end)

    @property
    def baseline_years(self) -> int:
        return int(self.baseline.end[:4]) - int(self.baseline.start[:4]) + 1

    def as_dict(self) -> dict:
        return asdict(self)

"""Column roles of a KPI table; both counter dialects are described with it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class KpiSpec:
    entity: tuple[str, ...] = ("cell_id",)
    time: str = "ts"
    ties: tuple[str, ...] = ()
    kpis: tuple[str, ...] = ()
    windows: dict[str, int] = field(default_factory=dict)
    min_periods: dict[str, int] = field(default_factory=dict)
    lags: tuple[int, ...] = (1, 4)
    clip: float = 5.0


# Fixed values of the two dialects: rows per window on the 15-minute grid.
COUNTER_WINDOWS = {"1h": 4, "4h": 16, "24h": 96}
INVENTORY_WINDOWS = {"1h": 4, "4h": 16, "24h": 96}
INVENTORY_MIN_PERIODS = {"1h": 2, "4h": 8, "24h": 48}

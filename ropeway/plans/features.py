"""The batch feature lineage: rolling, change, peer and time features in one lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ropeway.functions.timefeat import counter_time_features
from ropeway.operators.peers import leave_one_out_z
from ropeway.operators.windows import in_one_pass, lag_deltas_step, rolling_statistics_step, rolling_z_step
from ropeway.spec import KpiSpec


def feature_table(df: DataFrame, spec: KpiSpec, peer_group: list[str]) -> DataFrame:
    """Counter table plus its features; window stages share one partitioning by entity."""
    kpi = spec.kpis[0]
    out = in_one_pass(df, spec, [rolling_statistics_step(spec), lag_deltas_step(spec), rolling_z_step(spec)])
    out = leave_one_out_z(out, peer_group, kpi)
    return out.withColumns(counter_time_features(F.col(spec.time)))


def feature_names(df: DataFrame, spec: KpiSpec) -> list[str]:
    marks = ("_mean_", "_std_", "_max_", "_min_", "_lag_", "_delta_", "_z", "_sin", "_cos")
    flags = ("peer_z", "is_weekend", "is_peak_hour")
    return [c for c in df.columns if c in flags or (c.startswith(spec.kpis) and any(m in c for m in marks))
            or c.endswith(("_sin", "_cos"))]


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Features without history count as 0, as at serving time."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})

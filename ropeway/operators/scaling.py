"""Scalers fitted on one frame and applied to any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ropeway.plans.prefix import column_quantiles


def fit_robust(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre = median, scale = p95 - p05 (0 -> 1), NULL counted as 0."""
    values = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    q = column_quantiles(train, values, {"center": 0.5, "a": 0.05, "b": 0.95})
    span = F.col("b") - F.col("a")
    return q.select("feature", "center", F.when(span == 0, 1.0).otherwise(span).alias("scale"))


def fit_standard(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Centre = mean, scale = population deviation (0 -> 1)."""
    def row(f):
        v = F.col(f).cast("double")
        s = F.stddev_pop(v)
        return F.struct(F.lit(f).alias("feature"), F.avg(v).alias("center"), F.when(s == 0, 1.0).otherwise(s).alias("scale"))

    return train.agg(F.array(*map(row, features)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def apply_scaler(df: DataFrame, stats: DataFrame, features: Sequence[str], null_as_zero: bool = True) -> DataFrame:
    """Statistics (one row per feature) arrive as one scalar map."""
    entries = stats.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale"))))).scalar()
    def scaled(f):
        v = F.coalesce(F.col(f), F.lit(0.0)) if null_as_zero else F.col(f)
        s = entries[f]
        return (v - s["center"]) / s["scale"]
    return df.withColumns({f: scaled(f) for f in features})

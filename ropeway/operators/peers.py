"""Comparison of a cell with its peer group at the same time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ropeway.functions.scalar import clip
from ropeway.plans.prefix import average_rank
from ropeway.plans.skew import attach, with_group_stats

# Fixed value: epsilon under the leave-one-out standard deviation.
STD_EPS = 1e-6


def leave_one_out_z(df: DataFrame, group: Sequence[str], kpi: str, bound: float = 5.0) -> DataFrame:
    """Z against the other members; groups of two or fewer score 0.

    With deviations from the group mean the sums over the others need only the
    group's count and squared deviations, which stay accurate at any magnitude.
    """
    stats = with_group_stats(
        df, group,
        {"_n": F.count(kpi), "_mean": F.avg(kpi), "_var": F.var_pop(kpi)},
    )
    n, d = F.col("_n"), F.col(kpi) - F.col("_mean")
    others = F.greatest(n - 1, F.lit(1))
    var = (F.col("_var") * n - d * d) / others - (d / others) * (d / others)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    z = clip(d * n / others / (std + STD_EPS), -bound, bound)
    return stats.withColumn("peer_z", F.when(n <= 2, 0.0).otherwise(z)).drop("_n", "_mean", "_var")


def inclusive_z(df: DataFrame, group: Sequence[str], kpi: str, bound: float = 5.0) -> DataFrame:
    """Z against the whole group with sample deviation; undefined scores 0."""
    stats = with_group_stats(df, group, {"_mean": F.avg(kpi), "_std": F.stddev_samp(kpi)})
    z = (F.col(kpi) - F.col("_mean")) / F.when(F.col("_std") > 0, F.col("_std"))
    return stats.withColumn(
        "peer_z", F.coalesce(clip(z, -bound, bound), F.lit(0.0))
    ).drop("_mean", "_std")


def percentile_rank(df: DataFrame, group: Sequence[str], kpi: str, null_as: Column | None = None) -> DataFrame:
    """Average rank of ties over the non-NULL count of the group."""
    ranks = average_rank(df, group, kpi).select(
        *group, kpi, "n", (F.col("avg_rank") / F.col("total")).alias("peer_rank")
    )
    out = attach(df, ranks, [*group, kpi], rows="n", how="left").drop("n")
    if null_as is not None:
        out = out.withColumn("peer_rank", F.coalesce("peer_rank", null_as))
    return out

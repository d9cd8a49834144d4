"""Joins of a fact table with per-key statistics when a key may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.session import rows_per_task

BROADCAST_ROWS_KEY, BROADCAST_ROWS = "ropeway.broadcastRows", 200_000
BROADCAST_BYTES = 64 << 20


def broadcast_rows(spark: SparkSession) -> int:
    """Largest counted side that may be broadcast."""
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS)))


def group_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join on group keys where NULL is a group like any other."""
    other = right.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = left.join(F.broadcast(other) if small else other, same, how)
    return out.drop(*[f"_key_{k}" for k in keys])


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    rows: str,
    how: str = "inner",
) -> DataFrame:
    """Join ``stats`` (one row per key, ``rows`` = fact rows of the key) onto ``df``.

    Keys above the per-task limit are salted: their statistics row is copied once
    per salt and the fact rows spread over the copies.  Other keys keep one row.
    """
    if not keys:
        one = stats.select(F.struct(*[c for c in stats.columns]).alias("s")).scalar()
        return df.select("*", *[one[c].alias(c) for c in stats.columns])
    limit = rows_per_task(df.sparkSession)
    hot = stats.where(F.col(rows) > limit).select(
        *keys, F.ceil(F.col(rows) / limit).cast("int").alias("_salts")
    )
    n_hot = hot.count()
    if n_hot == 0:
        return group_join(df, stats, keys, how)
    payload = [c for c in df.columns if c not in keys]
    spread = F.xxhash64(*payload) if payload else F.monotonically_increasing_id()
    salted = group_join(df, hot, keys, "left", small=n_hot <= broadcast_rows(df.sparkSession)).withColumn(
        "_salt", F.coalesce(F.pmod(spread, F.col("_salts")), F.lit(0)).cast("int")
    )
    copies = stats.withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col(rows), F.lit(1)) / limit).cast("int") - 1)),
    )
    return group_join(salted, copies, [*keys, "_salt"], how).drop("_salt", "_salts")


def with_group_stats(df: DataFrame, keys: Sequence[str], aggs: dict) -> DataFrame:
    """``df`` plus aggregates of its key group: partial aggregation, then a salted join."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_group_rows"), *[a.alias(n) for n, a in aggs.items()]
    )
    return attach(df, stats, keys, rows="_group_rows").drop("_group_rows")


def broadcastable(dim: DataFrame) -> bool:
    """Whether ``dim`` was counted to have few enough rows and measured to have few enough bytes."""
    most = broadcast_rows(dim.sparkSession)
    wide = [c for c, t in dim.dtypes if t.startswith(("string", "varchar", "char", "binary", "array", "map", "struct"))]
    size = F.octet_length(F.to_json(F.struct(*wide))) if wide else F.lit(0)
    rows, wide_bytes = dim.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= most and wide_bytes + 8 * (len(dim.columns) - len(wide)) * rows <= BROADCAST_BYTES


def lookup_join(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join a dimension: broadcast below a measured size, salted on hot keys beyond it."""
    if broadcastable(dim):
        return df.join(F.broadcast(dim), list(keys), how)
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_key_rows")).join(dim, list(keys))
    return attach(df, sized, keys, rows="_key_rows", how=how).drop("_key_rows")

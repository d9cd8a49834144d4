"""Per-entity windows whose hot entities are split along time.

Only entities above the per-task row limit are split.  Their rows are bucketed by
time, consecutive buckets form segments of about one task each, and the rows
before a segment that a bounded frame can reach are copied into it as halo rows.
Everything else keeps its single partition and costs no extra copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.prefix import BUCKET, cut_points, hot_instants, isolating, with_bucket
from ropeway.plans.skew import group_join
from ropeway.session import rows_per_task

SEGMENT, HALO = "_segment", "_halo"


@dataclass(frozen=True)
class Split:
    df: DataFrame
    keys: list[str]
    is_split: bool


def split(df: DataFrame, entity: Sequence[str], time: str, halo_rows: int = 0,
          halo_after: int = 0, ties: Sequence[str] = ()) -> Split:
    """Partition keys for a frame reaching ``halo_rows`` back and ``halo_after`` ahead.

    ``ties`` order rows of one time; the first of them splits a crowded instant.
    """
    entity = list(entity)
    limit = max(rows_per_task(df.sparkSession), 1)
    per_entity = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("_rows"))
    hot = per_entity.where(F.col("_rows") > limit)
    if hot.count() == 0:
        return Split(df, entity, False)
    ties = [t for t in ties if t in df.columns]
    wanted = list(dict.fromkeys([*entity, time, *ties[:1]]))
    hot_rows = group_join(df.select(*wanted), hot.select(*entity), entity, "left_semi")
    instants = hot_instants(hot_rows, time, ties)
    cuts = isolating(cut_points(hot_rows, time), instants)
    buckets = (
        with_bucket(hot_rows, time, cuts, instants=instants, ties=ties).groupBy(*entity, BUCKET)
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    before = (
        Window.partitionBy(*entity).orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = buckets.select(
        *entity, BUCKET, "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    ).withColumn(SEGMENT, F.floor(F.col("_start") / limit).cast("int"))
    bounds = placed.groupBy(*entity, SEGMENT).agg(
        F.min("_start").alias("_first"),
        F.max(F.col("_start") + F.col("_rows")).alias("_end"),
    )
    per_entity_bounds = bounds.groupBy(*entity).agg(
        F.collect_list(F.struct(SEGMENT, "_first", "_end")).alias("_bounds")
    )
    placed = group_join(placed, per_entity_bounds, entity)
    start, end = F.col("_start"), F.col("_start") + F.col("_rows")
    reached = F.filter(
        "_bounds",
        lambda b: ((b["_first"] >= end) & (b["_first"] - halo_rows < end))
        | ((b["_end"] <= start) & (b["_end"] + halo_after > start)),
    )
    routes = placed.select(
        *entity, BUCKET, SEGMENT, F.transform(reached, lambda b: b[SEGMENT]).alias("_reach")
    )
    routed = group_join(with_bucket(df, time, cuts, instants=instants, ties=ties), routes, [*entity, BUCKET], "left")
    home = F.array(F.struct(F.coalesce(SEGMENT, F.lit(0)).alias("s"), F.lit(False).alias("h")))
    extra = F.transform(
        F.coalesce("_reach", F.array().cast("array<int>")),
        lambda s: F.struct(s.alias("s"), F.lit(True).alias("h")),
    )
    copies = routed.select(*df.columns, F.explode(F.concat(home, extra)).alias("_copy"))
    out = copies.select(
        *df.columns, F.col("_copy.s").alias(SEGMENT), F.col("_copy.h").alias(HALO)
    )
    return Split(out, [*entity, SEGMENT], True)


def windowed(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    halo_rows: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    halo_after: int = 0,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Run ``build(frame, partition_keys)`` with bounded row frames, then drop halos."""
    parts = split(df, entity, time, halo_rows, halo_after, ties)
    out = build(parts.df, parts.keys)
    if parts.is_split:
        out = out.where(~F.col(HALO)).drop(SEGMENT, HALO)
    return out


def last_known(
    df: DataFrame,
    entity: Sequence[str],
    time: str,
    ties: Sequence[str],
    columns: dict[str, Column],
) -> DataFrame:
    """Latest non-NULL value of each expression up to and including the row."""
    entity = list(entity)
    parts = split(df, entity, time, ties=ties)
    w = Window.partitionBy(*parts.keys).orderBy(time, *ties)
    w = w.rowsBetween(Window.unboundedPreceding, 0)
    local = parts.df.select(
        "*", *[F.last(c, ignorenulls=True).over(w).alias(o) for o, c in columns.items()]
    )
    if not parts.is_split:
        return local
    at = F.struct(time, *ties)
    ends = parts.df.groupBy(*entity, SEGMENT).agg(
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(o) for o, c in columns.items()]
    )
    before = (
        Window.partitionBy(*entity).orderBy(SEGMENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = ends.select(
        *entity, SEGMENT,
        *[F.last(o, ignorenulls=True).over(before).alias(f"_carry_{o}") for o in columns],
    )
    joined = group_join(local, carried, [*entity, SEGMENT], "left")
    return joined.select(
        *df.columns, *[F.coalesce(o, f"_carry_{o}").alias(o) for o in columns]
    )

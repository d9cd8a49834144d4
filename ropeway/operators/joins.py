"""Joins of facts, dimensions, features and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ropeway.plans.segments import last_known
from ropeway.plans.skew import broadcastable, lookup_join

#: Shares of the calls over which a busy end is spread.
NODE_SHARES = 8


def first_of_key(dim: DataFrame, key: str) -> DataFrame:
    """One row per key, the smallest column by column; map-typed columns do not take part in the order."""
    rest = [c for c, t in dim.dtypes if c != key and not t.startswith("map")]
    maps = [c for c, t in dim.dtypes if t.startswith("map")]
    if not rest:
        return dim.dropDuplicates([key])
    if maps:
        row = F.min_by(F.struct(*rest, *maps), F.struct(*rest))
    else:
        row = F.min(F.struct(*rest))
    return dim.groupBy(key).agg(row.alias("_first")).select(*[c if c == key else F.col("_first")[c].alias(c) for c in dim.columns])


def enrich(df: DataFrame, dim: DataFrame, key: str, cluster: Column | None = None) -> DataFrame:
    """Left join a de-duplicated dimension; unmatched rows stay and are marked.

    Of rows that repeat the key the one that is smallest column by column counts.
    """
    unique = first_of_key(dim, key).withColumn("_hit", F.lit(1))
    out = lookup_join(df, unique, [key]).withColumn("matched", F.coalesce("_hit", F.lit(0))).drop("_hit")
    return out if cluster is None else out.withColumn("cluster_id", cluster)


def as_of(
    spine: DataFrame,
    features: DataFrame,
    entity: Sequence[str],
    time: str,
    values: Sequence[str],
    ttl_seconds: int | None = None,
    feature_ties: Sequence[str] = (),
) -> DataFrame:
    """Latest feature row at or before each spine row, within the time to live.

    A feature row at the same instant is visible.  Rows of both sides share one
    ordered pass per entity; hot entities are split along time by ``last_known``.
    """
    entity = list(entity)
    extra = [c for c in spine.columns if c not in (*entity, time)]
    left = spine.select(
        *entity, time, F.lit(1).alias("_side"),
        F.struct(*(extra or [F.lit(1).alias("_")])).alias("_row"),
    )
    right = features.select(
        *entity, time, F.lit(0).alias("_side"),
        F.struct(*feature_ties, F.col(time).alias("_at"), *values).alias("_feature"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    ties = ["_side"]
    if feature_ties:
        both = both.withColumn("_tie", F.struct(*[F.col(f"_feature.{t}") for t in feature_ties]))
        ties.append("_tie")
    filled = last_known(both, entity, time, ties, {"_known": F.col("_feature")}).where("_side = 1")
    age = F.unix_micros(time) - F.unix_micros(F.col("_known._at"))
    live = F.col("_known").isNotNull()
    if ttl_seconds is not None:
        live = live & (age <= ttl_seconds * 1_000_000)
    return filled.select(
        *entity, time, *[F.col(f"_row.{c}").alias(c) for c in extra],
        F.when(live, F.col("_known._at")).alias("feature_ts"),
        *[F.when(live, F.col(f"_known.{v}")).alias(v) for v in values],
    )


def next_within(
    flags: DataFrame, alarms: DataFrame, entity: Sequence[str], time: str, seconds: int
) -> DataFrame:
    """First alarm of the entity at or after each flag within the window, else NULL.

    Only the nearest alarm decides, so the join is an as-of join on reversed time
    and never pairs every flag with every alarm of a busy cell.
    """
    entity = list(entity)
    extra = [c for c in flags.columns if c not in entity]
    left = flags.select(
        *entity, (-F.unix_micros(time)).alias("_back"), F.lit(1).alias("_side"),
        F.struct(*extra).alias("_row"),
    )
    right = alarms.select(
        *entity, (-F.unix_micros(time)).alias("_back"), F.lit(0).alias("_side"),
        F.col(time).alias("_alarm"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    out = last_known(both, entity, "_back", ["_side"], {"_next": F.col("_alarm")}).where("_side = 1")
    near = F.unix_micros("_next") + F.col("_back") <= seconds * 1_000_000
    return out.select(
        *entity, *[F.col(f"_row.{c}").alias(c) for c in extra],
        F.when(near, F.col("_next")).alias("alarm_ts"),
    ).withColumn("confirmed", F.col("alarm_ts").isNotNull().cast("int"))


def with_labels(df: DataFrame, labels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Left join one label row per key; an unlabelled row counts as 0."""
    unique = labels.groupBy(*keys).agg(F.max(label).alias(label))
    return lookup_join(df, unique, keys).withColumn(label, F.coalesce(label, F.lit(0)))


def with_truth(predictions: DataFrame, truth: DataFrame, key: str = "prediction_id") -> DataFrame:
    """Delayed ground truth joined back; predictions without truth stay."""
    return predictions.join(truth, key, "left")


def orphans(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    return lookup_join(df, reference.select(key).distinct(), [key], "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def members(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return lookup_join(df, wanted.select(*keys).distinct(), keys, "left_semi")


def label_rows(df: DataFrame, flagged: Column, source: str, confidence: float) -> DataFrame:
    return df.where(flagged).withColumns(
        {"label_source": F.lit(source), "label_confidence": F.lit(confidence)}
    )


def expand_intervals(intervals: DataFrame, start: str, end: str, minutes: int = 15) -> DataFrame:
    """One row per reporting period of each interval, end exclusive."""
    step = F.make_dt_interval(mins=F.lit(minutes))
    last = F.col(end) - F.expr("INTERVAL 1 MICROSECOND")
    return intervals.withColumn("rop_ts", F.explode(F.sequence(F.col(start), last, step)))


def resolve_endpoints(calls: DataFrame, nodes: DataFrame, key: str, ends: Sequence[str]) -> DataFrame:
    """Keep the calls whose ends are all known nodes."""
    known = nodes.select(F.col(key).alias("_node")).distinct()
    if broadcastable(known):
        for end in ends:
            calls = calls.join(F.broadcast(known), F.col(end) == F.col("_node"), "left_semi")
        return calls
    # a node in every share of the calls: a busy end is spread without counting the calls first
    salt = F.pmod(F.xxhash64(*calls.columns), F.lit(NODE_SHARES)).cast("int")
    copies = known.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(NODE_SHARES - 1))))
    out = calls.withColumn("_share", salt)
    for end in ends:
        out = out.join(copies, (F.col(end) == F.col("_node")) & (F.col("_share") == F.col("_copy")), "left_semi")
    return out.drop("_share")


def skew_check(offline: DataFrame, online: DataFrame, keys: Sequence[str], value: str,
               tolerance: float = 0.001) -> DataFrame:
    """Rows where the two stores disagree or only one has the feature."""
    a = offline.select(*keys, F.col(value).alias("offline"))
    b = online.select(*keys, F.col(value).alias("online"))
    out = a.join(b, list(keys), "full")
    gap = F.abs(F.col("offline") - F.col("online"))
    return out.withColumn("delta", gap).where(gap.isNull() | (gap > tolerance))

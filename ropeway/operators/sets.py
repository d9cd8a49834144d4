"""Set operations on ids, edges and write-sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def shared(df: DataFrame, column: str, other: Column) -> DataFrame:
    both = F.array_sort(F.array_intersect(F.col(column), other))
    return df.withColumns({"shared": both, "overlaps": F.arrays_overlap(F.col(column), other).cast("int")})


def symmetrise(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Both directions of every edge, once."""
    pair = edges.select(source, target)
    return pair.union(edges.select(F.col(target), F.col(source))).distinct()


def edge_delta(before: DataFrame, after: DataFrame, limit: float = 0.05) -> DataFrame:
    """Added, removed and kept edges of two snapshots; changes above the limit trigger."""
    keys = before.columns
    a = before.distinct().withColumn("_a", F.lit(1))
    b = after.distinct().withColumn("_b", F.lit(1))
    j = a.join(b, keys, "full")
    ina, inb = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    out = j.agg(F.count_if(inb & ~ina).alias("added"), F.count_if(ina & ~inb).alias("removed"),
                F.count_if(ina & inb).alias("kept"))
    changed, old = F.col("added") + F.col("removed"), F.col("kept") + F.col("removed")
    return out.withColumn("trigger", (changed > limit * old).cast("int"))

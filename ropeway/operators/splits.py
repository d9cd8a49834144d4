"""Ordering, top-k, temporal splits, sampling, thresholds and label rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.prefix import exact_quantiles, running_sums

# Split shares of the two dialects.
COUNTER_SPLIT, INVENTORY_SPLIT = (0.60, 0.20), (0.70, 0.15)


def top_n(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), tie).limit(n)


def top_k_per_group(df: DataFrame, group: Sequence[str], by: Column, ties: Sequence[str], k: int) -> DataFrame:
    """Best k rows of each group; the row limit is applied before the shuffle as well."""
    over = Window.partitionBy(*group).orderBy(by.desc(), *ties)
    return df.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def split_bounds(df: DataFrame, time: str, shares: tuple[float, float], floor_minutes: int | None = 15) -> Column:
    """The two cut instants as epoch microseconds (a scalar struct)."""
    us = F.unix_micros(time)
    lo, hi = F.min(us), F.max(us)
    def cut(share: float) -> Column:
        at = F.floor(lo + (hi - lo) * share).cast("long")
        if floor_minutes is None:
            return at
        step = floor_minutes * 60_000_000
        return F.floor(at / step).cast("long") * step
    return df.agg(F.struct(cut(shares[0]).alias("a"), cut(shares[0] + shares[1]).alias("b"))).scalar()


def temporal_split(df: DataFrame, time: str, shares: tuple[float, float] = COUNTER_SPLIT,
                   floor_minutes: int | None = 15) -> DataFrame:
    """Adds ``split``; train before validation before test, without overlap."""
    cuts, us = split_bounds(df, time, shares, floor_minutes), F.unix_micros(time)
    return df.withColumn("split", F.when(us < cuts["a"], "train").when(us < cuts["b"], "val").otherwise("test"))


def split_report(df: DataFrame, time: str, label: str) -> DataFrame:
    """Rows, range and label rate per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.unix_micros(F.min(time)).alias("first_us"),
        F.unix_micros(F.max(time)).alias("last_us"), F.avg(label).alias("label_rate"))


def assert_no_overlap(report: DataFrame) -> None:
    """Raises when a later split starts before an earlier one ends."""
    rows = {r["split"]: r for r in report.collect()}
    for before, after in (("train", "val"), ("val", "test")):
        if before in rows and after in rows and rows[before]["last_us"] >= rows[after]["first_us"]:
            raise ValueError(f"{before} and {after} overlap in time")


def gapped_folds(df: DataFrame, day: str, folds: int, train_days: int, val_days: int, gap_days: int) -> DataFrame:
    """Each row once per fold that uses it; train and validation are kept apart by the gap.

    Folds slide so that the last one ends on the last day.
    """
    last = df.agg(F.max(F.unix_date(day))).scalar()
    d = F.unix_date(day)

    def role(i: int) -> Column:
        end = last - (folds - 1 - i) * val_days
        val = (d > end - val_days) & (d <= end)
        train_end = end - val_days - gap_days
        train = (d > train_end - train_days) & (d <= train_end)
        return F.when(val, F.struct(F.lit(i).alias("fold"), F.lit("val").alias("role"))).when(
            train, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("role")))

    used = F.array_compact(F.array(*[role(i) for i in range(folds)]))
    return df.withColumn("_f", F.explode(used)).select(*df.columns, "_f.fold", "_f.role")


def last_days_holdout(df: DataFrame, day: str, days: int = 14) -> DataFrame:
    """Marks the rows of the last ``days`` days as holdout, all earlier ones as develop."""
    last = df.agg(F.max(F.unix_date(day))).scalar()
    return df.withColumn("role", F.when(F.unix_date(day) > last - days, "holdout").otherwise("develop"))


def positional_split(df: DataFrame, order: str, tie: str, shares: tuple[float, float] = INVENTORY_SPLIT) -> DataFrame:
    """Split by position in a global order, found with a distributed running count."""
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = running_sums(df.withColumn("_one", F.lit(1)), [], order, {"_pos": "_one"}, ties=[tie], exclusive=True)
    a, b = F.floor(total * shares[0]), F.floor(total * (shares[0] + shares[1]))
    pos = F.col("_pos")
    return placed.withColumn("split", F.when(pos < a, "train").when(pos < b, "val").otherwise("test")).drop("_one", "_pos")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """Exactly n rows, the same ones on every run."""
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)
    return df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")


def percentile_labels(df: DataFrame, score: str, prob: float = 0.97, strict: bool = False) -> DataFrame:
    cut = exact_quantiles(df, [], score, {"t": prob}).scalar()
    hit = F.col(score) > cut if strict else F.col(score) >= cut
    return df.withColumn("pseudo_label", hit.cast("int"))


def combine_labels(df: DataFrame, labels: Sequence[str], scores: Sequence[str], policy: str = "union") -> DataFrame:
    """Union, intersection or majority (two detectors: union) of labels and the mean scaled score."""
    votes = sum(F.col(c) for c in labels)
    need = {"union": 1, "intersection": len(labels), "majority": max(1, len(labels) // 2)}[policy]
    bounds = df.agg(F.struct(*[f(s).alias(f"{n}_{s}") for s in scores for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    mean = sum(
        (F.col(s) - bounds[f"lo_{s}"]) / (bounds[f"hi_{s}"] - bounds[f"lo_{s}"] + 1e-10) for s in scores
    ) / len(scores)
    return df.withColumns({"auto_label": (votes >= need).cast("int"), "auto_score": mean})

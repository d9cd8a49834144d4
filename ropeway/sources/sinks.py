"""Table sinks: splits, JSON reports, feature push, prediction log, retention, erasure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.operators.privacy import erase
from ropeway.sources.tables import check_columns


def write_splits(df: DataFrame, path: str) -> None:
    """Snappy Parquet with one folder per split; readers prune on ``split``."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def push_features(df: DataFrame, expected: Sequence[str], path: str, entity: str = "cell_id",
                  time: str = "event_timestamp") -> None:
    """Contract-checked write of one batch's folder: missing features fail, extra ones are dropped, floats are single.

    The folder is overwritten, so a batch that is written again does not double its rows.
    """
    check_columns(df, [entity, time, *expected])
    df.select(entity, time, *[F.col(c).cast("float").alias(c) for c in expected]).write.mode("overwrite").parquet(path)


def latest_features(spark: SparkSession, path: str, entity: str = "cell_id", time: str = "event_timestamp") -> DataFrame:
    """Newest pushed row per entity over all batch folders, the largest of equally new ones, with map-side combination."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.groupBy(entity).agg(F.max_by(F.struct("*"), F.struct(F.col(time), *[c for c in df.columns if c != time])).alias("r")).select("r.*")


def log_predictions(df: DataFrame, path: str, time: str) -> None:
    """Append-only log by date and hour; files are never rewritten."""
    placed = df.withColumns({"date": F.to_date(time), "hour": F.hour(time)})
    # rebalancing merges small hours and splits hot ones by size
    placed.hint("rebalance", "date", "hour").write.mode("append").partitionBy("date", "hour").parquet(path)


def recent_predictions(spark: SparkSession, path: str, time: str, tie: str, n: int) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def retained(df: DataFrame, date: str, now: Column, days: int) -> DataFrame:
    """Rows still inside the retention period; on a date-partitioned table whole folders are skipped."""
    return df.where(F.col(date) > F.date_sub(now, days))


def online_live(df: DataFrame, time: str, now: Column, interval_seconds: int) -> DataFrame:
    """Online rows younger than twice their interval."""
    return df.where(F.unix_timestamp(now) - F.unix_timestamp(time) <= 2 * interval_seconds)


def erase_from_store(spark: SparkSession, source: str, target: str, tokens: DataFrame, key: str) -> int:
    """Rewrites a store without the tokens to ``target`` and returns the number of removed rows.

    The old folder stays until the caller swaps the paths, so a lost job leaves it whole.
    """
    df = spark.read.parquet(source)
    erase(df, tokens, key).write.mode("overwrite").parquet(target)
    return df.join(tokens.select(key).distinct(), key, "left_semi").count()

"""Registry and adapter views of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL equivalent."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        # the tables hold naive UTC times
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def sql_f32(expr: str) -> str:
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"


def sql_r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def r6(col):
    """``sql_r6`` digit for digit: millionths are rounded as doubles, not as the digits a double prints with."""
    return F.round(col * 1e6) / 1e6 + 0.0


def kpi_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one KPI series per user."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("cell_id"),
        "ts",
        F.col("value").alias("kpi"),
        (F.col("event_type") == "error").cast("int").alias("is_anomaly"),
        F.pmod("user_id", F.lit(10)).cast("int").alias("cluster_id"),
        F.to_date("ts").alias("day"),
        "event_type",
    )


KE = """ke AS (SELECT event_id, user_id AS cell_id, ts, value AS kpi,
  CAST(event_type = 'error' AS INTEGER) AS is_anomaly, CAST(user_id % 10 AS INTEGER) AS cluster_id,
  CAST(ts AS DATE) AS day, event_type FROM events)"""


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """The KPI series with every seventh reading lost."""
    return kpi_events(spark, sf).withColumn(
        "kpi", F.when(F.col("event_id") % 7 != 0, F.col("kpi"))
    )


KG = KE + """, kg AS (SELECT event_id, cell_id, ts, CASE WHEN event_id % 7 <> 0 THEN kpi END AS kpi,
  is_anomaly, cluster_id, day, event_type FROM ke)"""


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Three derived detector scores, all in 0-1, with the anomaly label."""
    ke = kpi_events(spark, sf)
    top = ke.agg(F.max("kpi").alias("m"))
    s1 = F.col("kpi") / top.scalar()
    return ke.withColumn("s1", s1).withColumns(
        {
            "s2": 1 - F.col("s1") * F.col("s1"),
            "s3": F.abs(F.col("s1") - 0.25),
            "score": F.round(F.col("s1"), 4),
        }
    )


SC = KE + """, sc AS (SELECT *, 1 - s1 * s1 AS s2, abs(s1 - 0.25) AS s3, round(s1, 4) AS score
  FROM (SELECT *, kpi / (SELECT max(kpi) FROM ke) AS s1 FROM ke))"""


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour relations: user u points to u+10 and u+20 while they exist."""
    cells = table(spark, sf, "events").select(F.col("user_id").alias("source")).distinct()
    edges = cells.select(
        "source", F.explode(F.array(F.col("source") + 10, F.col("source") + 20)).alias("target")
    )
    known = cells.select(F.col("source").alias("target"))
    return edges.join(known, "target", "left_semi").select(
        "source", "target", ((F.col("target") - F.col("source")) / 10.0).alias("distance_km")
    )


NRT = """cells AS (SELECT DISTINCT user_id AS source FROM events),
nrt AS (SELECT c.source, t.source AS target, (t.source - c.source) / 10.0 AS distance_km
  FROM cells c JOIN cells t ON t.source = c.source + 10 OR t.source = c.source + 20)"""

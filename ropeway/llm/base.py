"""Registry, table access and column helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ASCII white space, as Java, RE2 and Python read it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL equivalent."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pack(docs: DataFrame, **own: Column) -> DataFrame:
    """Own columns beside the whole row in ``_row``, so that no name of the input clashes with them."""
    return docs.select(*[c.alias(n) for n, c in own.items()], F.struct("*").alias("_row"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.select("_row.*")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cut lineage that outlives an executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` bucketed by ``key`` below the shared folder: joins on it do not move it again."""
    spark, path, name = df.sparkSession, scratch_path(df.sparkSession, label), fresh_name(label.replace("-", "_"))
    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    df.repartition(buckets, key).write.insertInto(name)
    return spark.table(name)


_memory: dict = {}


def worker_memory(key, make):
    """What a worker keeps between tasks: one operator's memory, for which another's makes room."""
    if key not in _memory:
        _memory.clear()
        _memory[key] = make()
    return _memory[key]


def fresh_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"

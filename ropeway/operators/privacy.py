"""Pseudonyms, query limits and erasure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ropeway.plans.prefix import running_sums
from ropeway.plans.skew import lookup_join

BLOCK = 64


def padded_keys(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer key blocks, prepared once where the secret lives."""
    import hashlib

    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(message: Column, inner: Column, outer: Column) -> Column:
    """Hex HMAC-SHA256 from two digests; the key blocks are binary columns."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonymise(df: DataFrame, column: str, secrets: DataFrame, name: str = "token") -> DataFrame:
    """``secrets`` is a protected one-row table (inner, outer); read as a scalar, never a plan literal."""
    keys = secrets.select(F.struct("inner", "outer")).scalar()
    return df.withColumn(name, hmac_sha256(F.col(column).cast("string"), keys["inner"], keys["outer"]))


def salted_token(column: Column, salt: Column) -> Column:
    return F.substring(F.sha2(F.concat(salt, column.cast("string")), 256), 1, 16)


def query_rate(df: DataFrame, entity: Sequence[str], time: str, tie: str, seconds: int = 86400, limit: int = 10) -> DataFrame:
    """Requests of the entity in the last ``seconds`` up to each row.

    Every request also expires once, so the rolling count is a running sum over
    arrivals and expiries and needs no time-range frame.
    """
    step = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    rows = df.withColumns({"_d": F.lit(1), "_kind": F.lit(0)})
    gone = df.withColumn(time, F.col(time) + step).withColumns({"_d": F.lit(-1), "_kind": F.lit(1)})
    # an arrival still counts at exactly its age limit, so expiries sort last
    out = running_sums(rows.union(gone), entity, time, {"recent": "_d"}, ties=["_kind", tie])
    return out.where("_kind = 0").drop("_d", "_kind").withColumn("limited", (F.col("recent") > limit).cast("int"))


def erase(df: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    return lookup_join(df, tokens.select(key).distinct(), [key], "left_anti")


def erasure_audit(stores: dict[str, DataFrame], tokens: DataFrame, key: str) -> DataFrame:
    """Rows to remove per store."""
    out = None
    gone = tokens.select(key).distinct()
    for name, df in stores.items():
        part = lookup_join(df, gone, [key], "left_semi").agg(F.count(F.lit(1)).alias("removed")).withColumn("store", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

"""Queries with forced splits, a hot entity, a hot instant and NULL keys, against their SQL."""

import importlib.util
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ropeway.plans.skew import BROADCAST_ROWS_KEY
from ropeway.session import ROWS_PER_TASK, scratch_path

_spec = importlib.util.spec_from_file_location("check_catalog", os.path.join(os.path.dirname(__file__), "check_catalog.py"))
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

SF = "/root/testdata/sf0.001"
SPLIT = [
    "w1_rolling_statistics", "w5_rolling_z", "w6_leave_one_out_z", "w8_percentile_rank", "w9_row_index", "w10_forward_fill",
    "w11_short_fill", "w21_sustained_breach", "j1_enrich", "j6_as_of", "j8_confirmed_flags", "j13_valid_topology", "a3_feature_profile",
    "a5_caller_statistics", "e3_e4_areas", "f2_wasserstein", "f8_ks_test", "f12_alert_rules", "k3_query_rate", "t5_positional_split",
    "r3_write_conflicts", "r7_arbitration", "a13_cumulative_cost", "t4_holdout", "p11_contract_report", "a19_fingerprint",
]


@pytest.fixture(scope="module")
def hot(spark):
    """The tables with a third of the events at one user and fifty of them at one instant."""
    base = scratch_path(spark, "hot")
    for name in check.TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "events":
            df = df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast(dict(df.dtypes)["user_id"]))
            at = df.agg(F.min("ts")).first()[0]
            df = df.withColumn("ts", F.when(F.col("event_id") % 60 == 0, F.lit(at)).otherwise(F.col("ts")).cast(dict(df.dtypes)["ts"]))
        df.coalesce(1).write.parquet(f"{base}/{name}.parquet")
    return base


@pytest.mark.parametrize("name", SPLIT)
def test_split_path_equals_sql(spark, hot, name):
    spark.conf.set(ROWS_PER_TASK, "40")
    spark.conf.set(BROADCAST_ROWS_KEY, "10")
    try:
        df = entry.queries()[name](spark, hot)
        columns = sorted(df.columns)
        got = [tuple(check.canon(r[c]) for c in columns) for r in df.collect()]
    finally:
        spark.conf.unset(ROWS_PER_TASK)
        spark.conf.unset(BROADCAST_ROWS_KEY)
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{hot.removeprefix('file:')}/{t}.parquet/*.parquet')")
    con.execute("SET TimeZone='UTC'")
    out = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    want = [tuple(check.canon(r[names.index(c)]) for c in columns) for r in out.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_hot_instant_is_split(spark):
    """300 rows of one entity at one time spread over segments of about the limit, in the order of their ties."""
    from ropeway.plans.segments import SEGMENT, split
    from ropeway.plans.prefix import running_sums

    at = "timestamp'2024-01-01 00:00:00'"
    df = spark.range(300).selectExpr("1 AS e", f"{at} AS t", "id AS tie").union(
        spark.range(60).selectExpr("1 AS e", f"{at} + make_interval(0, 0, 0, 0, 0, int(id) - 30) AS t", "id + 1000 AS tie"))
    spark.conf.set(ROWS_PER_TASK, "40")
    try:
        parts = split(df, ["e"], "t", ties=["tie"])
        sizes = [r["count"] for r in parts.df.groupBy(SEGMENT).count().collect()]
        assert parts.is_split and max(sizes) <= 100 and sum(sizes) == 360
        sums = running_sums(df.withColumn("one", F.lit(1)), ["e"], "t", {"n": "one"}, ties=["tie"]).orderBy("t", "tie").collect()
        assert [r["n"] for r in sums] == list(range(1, 361))
    finally:
        spark.conf.unset(ROWS_PER_TASK)

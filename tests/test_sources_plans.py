import json
import subprocess

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ropeway.session import scratch_path
from ropeway.sources import sinks, tables
from ropeway.sources.alarms import parse_alarms

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_missing_columns_are_named(spark):
    with pytest.raises(tables.ContractError, match="nothing_here"):
        tables.check_columns(spark.range(1), ["id", "nothing_here"])


def test_push_contract(spark):
    df = spark.range(3).select(F.col("id").alias("cell_id"), F.current_timestamp().alias("event_timestamp"), F.lit(1.5).alias("a"), F.lit(2).alias("extra"))
    path = scratch_path(spark, "push-test")
    sinks.push_features(df, ["a"], path)
    out = spark.read.parquet(path)
    assert out.columns == ["cell_id", "event_timestamp", "a"] and dict(out.dtypes)["a"] == "float"
    with pytest.raises(tables.ContractError):
        sinks.push_features(df, ["a", "b"], path)


def test_alarm_forms(spark):
    def ev(i, **h):
        return {"commonEventHeader": {"eventId": i, "startEpochMicrosec": 1, **h}, "faultFields": {"eventSeverity": "MAJOR"}}

    texts = [json.dumps({"event": ev("a", timeZoneOffset="UTC")}), json.dumps({"eventList": [ev("b"), ev("c"), ev("d")]}),
             json.dumps({"event": ev("e")}), "{broken"]
    good, bad = parse_alarms(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = {r["event_id"]: (r["version"], r["priority"], r["domain"]) for r in good.collect()}
    assert set(got) == set("abcde") and bad.count() == 1
    assert got["a"][0] == "7.2" and got["b"][0] == "7.2" and got["e"] == ("7.1", "Normal", "fault")


def test_erasure_rewrites_the_store(spark):
    a, b = scratch_path(spark, "s"), scratch_path(spark, "t")
    spark.range(10).write.parquet(a)
    assert sinks.erase_from_store(spark, a, b, spark.range(3), "id") == 3
    assert spark.read.parquet(b).count() == 7


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "w1_rolling_statistics", "w6_leave_one_out_z", "j6_as_of", "j8_confirmed_flags", "e3_e4_areas", "f2_wasserstein",
    "g4_neighbour_features", "p6_cqi_consistency", "p15_min_max", "t5_positional_split", "k1_pseudonym"])
def test_no_cross_products(tiny_tasks, name):
    text = plan(entry.queries()[name](tiny_tasks, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["e3_e4_areas", "f2_wasserstein", "t5_positional_split"])
def test_ordered_sums_are_bucketed(tiny_tasks, name):
    """On large input the ordered window runs inside buckets, not in one task."""
    assert "_bucket" in plan(entry.queries()[name](tiny_tasks, SF))


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["e17_score_histogram"](spark, SF))
    assert "props" not in text


def test_no_local_checkpoints_in_the_library():
    hit = subprocess.run(["grep", "-rn", "localCheckpoint\\|crossJoin", "ropeway"], cwd=entry.os.path.dirname(entry.__file__), capture_output=True)
    assert hit.stdout == b""


def test_breaker_stream_equals_batch(spark):
    batch, stream = (entry.queries()[n](spark, SF) for n in ("r9_breaker_timeline", "x13_breaker_state"))
    cols = ["cluster_id", "event_id", "state_before", "tried", "state_after"]
    # rows that the watermark has not passed are still open on the stream
    events = spark.read.parquet(f"{SF}/events.parquet")
    closed = events.where(F.col("ts") < F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 HOUR")).select("event_id")
    want = batch.join(closed, "event_id", "left_semi")
    assert sorted(map(tuple, want.select(*cols).collect())) == sorted(map(tuple, stream.select(*cols).collect()))


def test_feature_lineage_shuffles_once_per_partitioning(spark):
    """Rolling, lag and z windows share one exchange by entity."""
    text = plan(entry.entry(spark))
    assert text.count("hashpartitioning(cell_id") == 1

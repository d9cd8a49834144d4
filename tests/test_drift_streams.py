"""Drift reports from counts, calendar comparison, newest-N state and the alarm interval join."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ropeway.operators import drift as D
from ropeway.operators import graph as G
from ropeway.operators.windows import sustained
from ropeway.streaming import jobs

START = datetime(2024, 1, 1)


def ks(a, b):
    at = sorted({*a, *b})
    return max(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) for x in at)


def test_calendar_ks_equals_two_sample_statistic(tiny_tasks):
    rng = random.Random(8)
    ref = [("f", h, float(rng.randint(0, 20))) for h in (0, 1) for _ in range(60)]
    cur = [("f", s % 2, s, float(rng.randint(0, 26) + s % 3)) for s in (10, 11, 14) for _ in range(rng.randint(1, 25))]
    out = D.calendar_ks(tiny_tasks.createDataFrame(ref, "g string, hour int, value double"),
                        tiny_tasks.createDataFrame(cur, "g string, hour int, slot int, value double"), ["g"], "hour", "slot").collect()
    assert len(out) == 3
    for r in out:
        mine, base = [c[3] for c in cur if c[2] == r["slot"]], [x[2] for x in ref if x[1] == r["hour"]]
        assert r["ks"] == pytest.approx(ks(base, mine), abs=1e-12) and (r["n_ref"], r["n_cur"]) == (60, len(mine))


def test_a_missing_hour_ends_the_run(spark):
    hours = [1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13]
    df = spark.createDataFrame([("f", h, 0.001) for h in hours], "f string, slot long, p double")
    out = {r["slot"]: r["sustained"] for r in sustained(df, ["f"], "slot", F.col("p") < 0.01, 6, F.col("slot")).collect()}
    assert [h for h in hours if out[h]] == [6, 13]


def test_report_from_counts(spark):
    rng = random.Random(3)
    rows = [("a", s, rng.gauss(m, 1e-3) + 1e6) for s, m in (("ref", 0), ("cur", 0.002)) for _ in range(80)]
    rows += [("flat", s, 4.0) for s in ("ref", "cur") for _ in range(60)] + [("few", "cur", 1.0), ("few", "ref", 2.0)]
    out = {r["feature"]: r for r in D.feature_report(spark.createDataFrame(rows, "feature string, side string, value double")).collect()}
    assert set(out) == {"a", "flat"} and out["flat"]["psi"] == 0 and out["flat"]["wasserstein"] == 0
    ref, cur = ([v for f, s, v in rows if f == "a" and s == side] for side in ("ref", "cur"))
    assert out["a"]["ref_std"] == pytest.approx(np.std(ref), rel=1e-6) and out["a"]["cur_mean"] == pytest.approx(np.mean(cur), rel=1e-12)
    gap = np.mean(np.abs(np.sort(ref) - np.sort(cur)))
    assert out["a"]["wasserstein"] == pytest.approx(gap / np.std(ref), rel=1e-6)


def test_monitor_keeps_the_newest_of_every_feature(spark, tmp_path):
    rng = random.Random(4)
    feats = [f"f{i}" for i in range(5)]
    ref = spark.createDataFrame([(f, rng.gauss(0, 1)) for f in feats[:4] for _ in range(200)], "feature string, value double")
    write = jobs.monitor_drift(ref, f"{tmp_path}/state", f"{tmp_path}/reports", "ts", "id", keep=70)
    held = {f: [] for f in feats}
    for batch_id in range(3):
        rows = [(f, rng.gauss(batch_id, 1), START + timedelta(minutes=rng.randint(0, 500)), i + 1000 * batch_id) for f in feats for i in range(40)]
        rows += [("f0", float("nan"), START + timedelta(days=9), -1), ("f1", None, START + timedelta(days=9), -2)]
        frame = spark.createDataFrame(rows, "feature string, value double, ts timestamp, id long")
        for _ in range(2):  # a batch that is tried again leaves the same state
            write(frame, batch_id)
        for f in feats:
            held[f] = sorted(held[f] + [r[1:] for r in rows if r[0] == f and r[1] is not None and r[1] == r[1]], key=lambda r: (r[1], r[2]))[-70:]
        kept = spark.read.parquet(f"{tmp_path}/state/{batch_id}").collect()
        for f in feats:
            assert sorted(r["id"] for r in kept if r["feature"] == f) == sorted(x[2] for x in held[f])
    report = {r["feature"]: r for r in spark.read.parquet(f"{tmp_path}/reports/2").collect()}
    assert set(report) == set(feats[:4]) and all(r["n_cur"] == 70 for r in report.values())
    long = ref.withColumn("side", F.lit("ref")).unionByName(spark.createDataFrame([(f, x[0], "cur") for f in feats[:4] for x in held[f]], "feature string, value double, side string"))
    for r in D.feature_report(long).collect():
        assert report[r["feature"]]["psi"] == pytest.approx(r["psi"]) and report[r["feature"]]["wasserstein"] == pytest.approx(r["wasserstein"])


def test_alarms_at_the_ends_of_the_interval(spark, tmp_path):
    at = lambda minutes, seconds=0: START + timedelta(minutes=minutes, seconds=seconds)
    flags = [("c1", at(0)), ("c2", at(0)), ("c3", at(0)), ("c4", at(0)), ("c5", at(7)), ("c5", at(7)), ("late", at(600))]
    alarms = [("c1", at(30)), ("c2", at(31)), ("c3", at(0, -1)), ("c4", at(0)), ("c5", at(20)), ("c5", at(12)), ("c5", at(3)), ("late", at(600))]
    for name, rows in (("flags", flags), ("alarms", alarms)):
        spark.createDataFrame(rows, "cell string, ts timestamp").write.parquet(f"{tmp_path}/{name}")
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    f, a = (jobs.file_stream(own, f"{tmp_path}/{n}", "cell string, ts timestamp") for n in ("flags", "alarms"))
    out = jobs.corroborated(f, a, "cell", "ts")
    jobs.append_table(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["cell"]: r["alarm_time"] for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {"c1": at(30), "c2": None, "c3": None, "c4": at(0), "c5": at(12)}


def test_components_of_every_snapshot(spark):
    edges = [(1, 1, 2), (1, 3, 4), (1, 2, 3), (1, 8, 9), (2, 1, 2), (2, 3, 4), (2, 8, 9), (3, 5, 5)]
    sig = G.topology_signature(spark.createDataFrame(edges, "day int, a int, b int"), "day", "a", "b", F.col("id"))
    assert {r["day"]: r["components"] for r in sig.collect()} == {1: 2, 2: 3, 3: 1}

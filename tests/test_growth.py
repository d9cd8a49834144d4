"""Work that grows with the input only, and results that hold on larger tables."""

import math
import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from ropeway.catalog import base, streams
from ropeway.operators import geo, joins, rules
from ropeway.operators.documents import two_decimals
from ropeway.session import durable
from ropeway.streaming import jobs, stateful

START = datetime(2024, 1, 1)


def test_corroboration_forms_no_pairs(spark, tmp_path):
    rng = random.Random(5)
    at = lambda: START + timedelta(seconds=rng.randrange(0, 6 * 3600, 7))
    flags = [(k, at()) for k in (1, 2, None) for _ in range(150)] + [(3, START)]
    alarms = [(k, at()) for k in (1, 2, None, 4) for _ in range(12)]
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    for name, rows in (("flags", flags), ("alarms", alarms)):
        for part in (0, 1):  # two deliveries, out of order
            spark.createDataFrame(rows[part::2], "cell int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/{name}/{part}")
    f, a = (jobs.file_stream(own, f"{tmp_path}/{n}/*", "cell int, ts timestamp", files_per_trigger=1) for n in ("flags", "alarms"))
    out = jobs.corroborated(f, a, "cell", "ts", delay="6 hours")
    assert "Join" not in out._jdf.queryExecution().logical().toString()
    jobs.append_table(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() == 0  # the watermark is still before them
    end = [(9, START + timedelta(hours=13))]
    for n in ("flags", "alarms"):
        spark.createDataFrame(end, "cell int, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/{n}/2")
    jobs.append_table(out, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted((str(r["cell"]), r["flag_time"], r["alarm_time"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    near = lambda k, t: min((s for c, s in alarms if c == k and k is not None and t <= s <= t + timedelta(minutes=30)), default=None)
    want = sorted({(str(k), t, near(k, t)) for k, t in flags}, key=lambda r: r[:2])
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == [w[2] for w in want]


def test_two_decimals_of_the_value_a_double_has(spark):
    values = [i / 1000 for i in range(0, 3000, 5)] + [-0.595, -1e-9, 0.125, 0.375, 1e12 + 0.125, 99.995, 0.9999]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", two_decimals(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['x']:.2f}" for r in rows]


def test_the_last_stragglers_of_a_dense_stream_are_late(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), 1, "view", 1.0) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["late"] for r in streams.late_routing(spark, str(tmp_path)).collect()}
    assert got == {i: int(i % 10 == 3 and i > 20) for i in range(200)}


def test_millionths_are_rounded_as_the_sql_does(spark):
    sql = "SELECT " + base.sql_r6("(2 * i + 1) / 2e6::DOUBLE") + " AS x FROM range(20000) t(i) ORDER BY i"
    want = [r[0] for r in duckdb.sql(sql).fetchall()]
    got = spark.range(20000).select("id", base.r6((2 * F.col("id") + 1) / F.lit(2e6)).alias("x")).orderBy("id").collect()
    assert [r["x"] for r in got] == want


def test_entities_share_state_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "SHARES", 4)
    rng = random.Random(6)
    rows = [(e, START + timedelta(seconds=rng.randrange(40_000)), i, rng.choice([None, rng.random()])) for i, e in enumerate([*range(30), None] * 6)]
    rows.append((99, START + timedelta(days=1), 10_000, 1.0))
    for part in range(3):
        spark.createDataFrame(sorted(rows, key=lambda r: r[1])[part * 63 : part * 63 + 63], "cell long, ts timestamp, id long, kpi double").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stream = stateful.rolling_stream(jobs.file_stream(own, f"{tmp_path}/in/*", "cell long, ts timestamp, id long, kpi double", files_per_trigger=1),
                                     "cell", "ts", "id", "kpi", delay="10 hours")
    q = jobs.append_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 5  # the null entity has a key of its own
    got = {r["id"]: (r["cell"], r["mean_4h"], r["delta_1"]) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
    want = {}
    for e in [*range(30), None]:
        mine = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(mine):
            seen = [m[3] for m in mine[: i + 1] if m[3] is not None]
            both = i > 0 and r[3] is not None and mine[i - 1][3] is not None
            want[r[2]] = e, sum(seen) / len(seen) if seen else 0.0, r[3] - mine[i - 1][3] if both else 0.0
    assert set(got) == set(want)
    for i, (e, mean, change) in want.items():
        assert got[i][0] == e and abs(got[i][1] - mean) < 1e-12 and abs(got[i][2] - change) < 1e-12


def test_approvals_out_of_reach_leave_the_lock_rounds(spark, monkeypatch):
    sizes = []

    def counted(df):
        out = durable(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(rules, "durable", counted)
    chain = [(i, 1, START + timedelta(seconds=200 * i)) for i in range(6)]
    apart = [(100 + i, c, START + timedelta(hours=i)) for i in range(1, 40) for c in (1, 2)]
    got = rules.lock_decisions(spark.createDataFrame(chain + apart, "id long, cell int, ts timestamp"), "id", "cell", "ts", 300).collect()
    assert {r["id"]: r["approved"] for r in got} == {**{i: int(i % 2 == 0) for i in range(6)}, **{r[0]: 1 for r in apart}}
    assert sizes[0] == 84 and max(sizes[2:]) < 10


def test_endpoints_are_resolved_without_counting_calls(spark, monkeypatch):
    monkeypatch.setattr(joins, "broadcastable", lambda _: False)
    calls = [(1, i % 5, i) for i in range(60)] + [(None, 1, 0), (2, None, 0), (9, 1, 0), (2, 3, 7), (2, 3, 7)]
    out = joins.resolve_endpoints(spark.createDataFrame(calls, "a long, b long, n int"), spark.createDataFrame([(i,) for i in (1, 2, 3, 3, None)], "k long"), "k", ["a", "b"])
    assert sorted(map(tuple, out.collect())) == sorted(c for c in calls if c[0] in (1, 2, 3) and c[1] in (1, 2, 3))
    assert "count(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_small_and_large_sites_meet_all_their_cells(spark):
    rng = random.Random(9)
    size = {1: 100, 2: 3, 3: 1}  # one site above FEW_SPOTS
    cells = [(100 * s + i, s, i % 2, rng.uniform(-80, 80), rng.uniform(-170, 170)) for s, n in size.items() for i in range(n)]
    out = geo.nearest_locations(spark.createDataFrame(cells, "id long, site int, band int, lat double, lon double"), 4, math.pi * geo.EARTH_KM, ["site", "band"], ["site"])
    got = {}
    for r in out.collect():
        got.setdefault((r["lat"], r["lon"]), []).append((r["distance_km"], r["target"]))

    def km(a, b):
        p, q = math.radians(a[3]), math.radians(b[3])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(h, 1.0)))

    for c in cells:
        want = [d[0] for d in sorted((d for d in cells if d[1] == c[1]), key=lambda d: km(c, d))][:5]
        assert [t for _, t in sorted(got[c[3], c[4]])] == want
    levels = out._jdf.queryExecution().optimizedPlan().toString()
    assert "-1" in levels and f"<= {geo.FEW_SPOTS}" in levels

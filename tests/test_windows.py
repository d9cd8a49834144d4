import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ropeway.operators import windows as W
from ropeway.operators.privacy import query_rate
from ropeway.operators.joins import as_of, next_within
from ropeway.plans.prefix import exact_quantiles, running_sums
from ropeway.plans.skew import attach
from ropeway.session import ROWS_PER_TASK
from ropeway.spec import KpiSpec

T0 = datetime(2024, 1, 1)
SPEC = KpiSpec(ties=("i",), kpis=("kpi",), windows={"1h": 4, "4h": 16})


def series(spark, cells, n, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for c in cells:
        for k in range(n if c else n * 4):
            v = None if rng.random() < 0.15 else round(rng.uniform(0, 100), 2)
            rows.append((i, c, T0 + timedelta(minutes=15 * k + rng.randint(0, 5)), v))
            i += 1
    return spark.createDataFrame(rows, "i long, cell_id long, ts timestamp, kpi double")


def both_paths(spark, build):
    """The result with whole partitions and with hot entities split must agree."""
    spark.conf.unset(ROWS_PER_TASK)
    plain = sorted(map(str, build().collect()))
    spark.conf.set(ROWS_PER_TASK, "8")
    try:
        cut = sorted(map(str, build().collect()))
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    assert plain == cut
    return plain


@pytest.mark.parametrize("op", [
    lambda d: W.rolling_statistics(d, SPEC), lambda d: W.lag_deltas(d, SPEC), lambda d: W.rolling_z(d, SPEC, 24),
    lambda d: W.row_index(d, SPEC), lambda d: W.forward_fill(d, SPEC, {"kpi": F.lit(-1.0)}),
    lambda d: W.centred_mean(d, SPEC, "kpi", "m"), lambda d: W.reset_flags(d, SPEC, 12, 4),
    lambda d: W.sequences(d.na.fill(0.0), SPEC, "i", 8, 2),
])
def test_hot_entities_give_the_same_rows(spark, op):
    df = series(spark, [0, 1, 2], 15)
    out = both_paths(spark, lambda: op(df).select(*sorted(op(df).columns)))
    assert out


def test_first_rows_and_gates(spark):
    rows = [(i, 1, T0 + timedelta(minutes=15 * i), v) for i, v in enumerate([1.0, None, 3.0, 5.0, 7.0, 9.0])]
    df = spark.createDataFrame(rows, "i long, cell_id long, ts timestamp, kpi double")
    got = {r["i"]: r for r in W.rolling_statistics(df, SPEC).collect()}
    assert got[0]["kpi_mean_1h"] is None and got[0]["kpi_std_1h"] == 0.0
    assert got[2]["kpi_mean_1h"] is None          # one reading in the frame, two needed
    assert got[3]["kpi_mean_1h"] == 2.0           # 1 and 3
    assert got[5]["kpi_max_1h"] == 7.0 and got[5]["kpi_min_1h"] == 3.0


def test_counter_reset_guard(spark):
    rows = [(i, 1, T0 + timedelta(minutes=15 * i), v) for i, v in enumerate([100.0, 105.0, 5.0, 110.0])]
    df = spark.createDataFrame(rows, "i long, cell_id long, ts timestamp, kpi double")
    got = [r["kpi_delta_1"] for r in W.lag_deltas(df, SPEC).orderBy("i").collect()]
    assert got == [None, 5.0, None, 105.0]
    free = [r["kpi_delta_1"] for r in W.lag_deltas(df, SPEC, signal=["kpi"]).orderBy("i").collect()]
    assert free[2] == -100.0


def test_cusum_matches_recursion(spark):
    rng = random.Random(3)
    for trial in range(3):
        d = [0, 1, 1, 3, 0] if trial == 0 else [round(rng.uniform(0, 2), 3) for _ in range(30)]
        df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(d)], "k int, t int, x double")
        got = [r["alarm"] for r in W.cusum_flag(df, ["k"], "t", "x").orderBy("t").collect()]
        s, hit, want = 0.0, 0, []
        for x in d:
            s = max(0.0, s + x - 0.5)
            hit = int(hit or s > 3)
            want.append(hit)
        assert got == want


def test_as_of_ttl_and_ties(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    spine = spark.createDataFrame([(1, at(-1)), (1, at(0)), (1, at(20)), (1, at(60))], "c int, ts timestamp")
    feats = spark.createDataFrame([(1, at(0), 10.0), (1, at(15), 20.0)], "c int, ts timestamp, v double")
    got = [r["v"] for r in as_of(spine, feats, ["c"], "ts", ["v"], 1800).orderBy("ts").collect()]
    assert got == [None, 10.0, 20.0, None]


def test_as_of_and_next_on_hot_entity(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(i, i % 2, T0 + timedelta(seconds=rng.randint(0, 9000))) for i in range(60)], "i long, c long, ts timestamp")
    right = spark.createDataFrame([(i, i % 2, T0 + timedelta(seconds=rng.randint(0, 9000)), float(i)) for i in range(80)], "j long, c long, ts timestamp, v double")
    both_paths(spark, lambda: as_of(left, right, ["c"], "ts", ["v"], 600, ["j"]).select("i", "v"))
    both_paths(spark, lambda: next_within(left, right, ["c"], "ts", 300).select("i", "confirmed", F.unix_micros("alarm_ts")))


def test_query_rate_equals_brute_force(spark):
    rng = random.Random(7)
    rows = sorted((T0 + timedelta(seconds=rng.randint(0, 5000)), i) for i in range(70))
    df = spark.createDataFrame([(1, t, i) for t, i in rows], "c int, ts timestamp, i long")
    got = {r["i"]: r["recent"] for r in query_rate(df, ["c"], "ts", "i", 600, 3).collect()}
    for t, i in rows:
        want = sum(1 for u, j in rows if (u, j) <= (t, i) and t - u <= timedelta(seconds=600))
        assert got[i] == want


def test_prefix_and_quantiles_across_buckets(tiny_tasks):
    rng = random.Random(11)
    rows = [(i % 3 if i % 2 else 0, float(rng.randint(0, 40))) for i in range(200)]
    df = tiny_tasks.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"q": 0.3, "m": 0.5}, count_as="n").collect()}
    import numpy as np
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        assert got[g]["n"] == len(vals)
        assert got[g]["q"] == pytest.approx(np.quantile(vals, 0.3))
        assert got[g]["m"] == pytest.approx(np.quantile(vals, 0.5))
    one = tiny_tasks.createDataFrame([(float(i), 1) for i in range(50)], "v double, n int")
    run = running_sums(one, [], "v", {"s": "n"}, next_as="nx").orderBy("v").collect()
    assert [r["s"] for r in run] == list(range(1, 51))
    assert [r["nx"] for r in run] == [float(i) for i in range(1, 50)] + [None]


def test_salted_join_keeps_every_row(tiny_tasks):
    df = tiny_tasks.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k long, i long")
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))
    out = attach(df, stats, ["k"], rows="n")
    assert out.count() == 300 and out.select("i").distinct().count() == 300


def test_null_keys_stay_a_group(spark):
    rows = [(None if i % 2 else i % 4, i, T0 + timedelta(minutes=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "cell_id long, i long, ts timestamp, kpi double")
    both_paths(spark, lambda: W.row_index(df, SPEC).select("i", "row_index"))
    both_paths(spark, lambda: W.rolling_statistics(df, SPEC).select("i", "kpi_mean_1h"))
    both_paths(spark, lambda: W.forward_fill(df, SPEC, {"kpi": F.lit(0.0)}).select("i", "kpi"))
    from ropeway.plans.skew import with_group_stats
    out = both_paths(spark, lambda: with_group_stats(df, ["cell_id"], {"s": F.sum("kpi")}).select("i", "s"))
    assert len(out) == 40


@pytest.mark.parametrize("rows", ["200000", "2"])
def test_lookups_broadcast_or_salted_agree(tiny_tasks, rows):
    """Semi, anti, inner and left lookups on a key that holds most rows."""
    from ropeway.plans.skew import BROADCAST_ROWS_KEY, lookup_join

    df = tiny_tasks.createDataFrame([(0 if i % 3 else (None if i % 6 else i), i) for i in range(120)], "k long, i long")
    dim = tiny_tasks.createDataFrame([(k, k * 10) for k in (0, 6, 12, 18)], "k long, v long")
    tiny_tasks.conf.set(BROADCAST_ROWS_KEY, rows)
    try:
        n = {how: lookup_join(df, dim, ["k"], how).count() for how in ("left_semi", "left_anti", "inner", "left")}
    finally:
        tiny_tasks.conf.unset(BROADCAST_ROWS_KEY)
    hit = df.where("k IN (0, 6, 12, 18)").count()
    assert n == {"left_semi": hit, "left_anti": 120 - hit, "inner": hit, "left": 120}

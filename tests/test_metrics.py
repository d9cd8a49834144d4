import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ropeway.operators import aggregates as A
from ropeway.operators import drift as D
from ropeway.operators import evaluate as E
from ropeway.operators import resample
from ropeway.plans import prefix
from ropeway.operators.peers import leave_one_out_z
from ropeway.sources import tables
from ropeway.operators.splits import assert_no_overlap, split_report, temporal_split
from ropeway.functions import scalar as S
from ropeway.operators.scaling import apply_scaler, fit_standard


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def test_auc_with_ties(spark):
    df = scored(spark, [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1)])
    got = E.areas(E.score_counts(df, [], "score", "y"), [], "score").first()
    assert got["roc_auc"] == 0.875


def test_auc_is_antisymmetric_and_split_free(tiny_tasks):
    rng = random.Random(2)
    rows = [(rng.random(), int(rng.random() < 0.3)) for _ in range(120)]
    a = E.areas(E.score_counts(scored(tiny_tasks, rows), [], "score", "y"), [], "score").first()["roc_auc"]
    b = E.areas(E.score_counts(scored(tiny_tasks, [(-s, y) for s, y in rows]), [], "score", "y"), [], "score").first()["roc_auc"]
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute) and a + b == pytest.approx(1.0)


def test_bootstrap_interval_contains_the_point(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(round(rng.gauss(0.6 if i % 3 == 0 else 0.4, 0.2), 2), int(i % 3 == 0)) for i in range(300)]
    counts = E.score_counts(scored(spark, rows), [], "score", "y")
    point = E.areas(counts, [], "score").first()["roc_auc"]
    first = resample.bootstrap_metrics(counts, "score", 100).first()
    assert first["roc_auc_low"] < point < first["roc_auc_high"]
    # many buckets and small chunks draw the same weights
    monkeypatch.setattr(resample, "DRAWN_VALUES", 9)
    monkeypatch.setattr(resample, "CHUNK", 4)
    again = resample.bootstrap_metrics(counts, "score", 100).first()
    assert list(again) == pytest.approx(list(first), abs=1e-12)


def test_bootstrap_replicates_equal_weighted_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "DRAWN_VALUES", 5)
    rng = random.Random(5)
    rows = [(rng.randint(0, 30) / 30, rng.random() < 0.4) for _ in range(200)] + [(0.5, False)] * 90
    counts = E.score_counts(scored(spark, [(s, int(y)) for s, y in rows]), [], "score", "y")
    key = lambda tag, c: F.pmod(F.floor(c * 30).cast("bigint") + (1000 if tag == "pos" else 5000), F.lit(resample.PRIME))
    coefs = resample.coefficients(40, 7)
    at = sorted({s for s, _ in rows}, reverse=True)
    have = {c: np.array([sum(s == t and y == (c == "pos") for s, y in rows) for t in at]) for c in ("pos", "neg")}
    draws = {c: resample.weights(np.array([int(np.floor(s * 30)) + (1000 if c == "pos" else 5000) for s in at]), have[c], coefs) for c in have}
    aucs, aps, f1s = [], [], []
    for r in range(40):
        p, n = draws["pos"][:, r], draws["neg"][:, r]
        aucs.append(sum(p[i] * n[j] * ((i < j) + 0.5 * (i == j)) for i in range(len(at)) for j in range(len(at))) / (p.sum() * n.sum()))
        aps.append(sum(p[i] / p.sum() * p[: i + 1].sum() / max(1, p[: i + 1].sum() + n[: i + 1].sum()) for i in range(len(at))))
        up = np.array(at) >= 0.5
        f1s.append(2 * p[up].sum() / (p.sum() + p[up].sum() + n[up].sum()))
    out = resample.bootstrap_metrics(counts, "score", 40, seed=7, key=key).first()
    for name, values in (("roc_auc", aucs), ("pr_auc", aps), ("f1", f1s)):
        want = [np.mean(values), np.percentile(values, 2.5), np.percentile(values, 97.5)]
        assert [out[f"{name}_{x}"] for x in ("mean", "low", "high")] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("n", [1, 3, 30, 31, 900, 250_000])
def test_poisson_weights_have_the_right_moments(n):
    keys = np.arange(1, 4001)
    drawn = resample.weights(keys, np.full(len(keys), n), resample.coefficients(25, 1)).astype(float)
    assert drawn.mean() == pytest.approx(n, abs=5 * (n / drawn.size) ** 0.5)
    assert drawn.var() == pytest.approx(n, rel=0.05)


def test_off_policy_interval(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.gauss(1.0, 2.0), rng.random() < 0.5) for _ in range(400)] + [(None, True)], "reward double, up boolean")
    target = F.when(F.col("up"), 0.8).otherwise(0.2)
    out = E.off_policy(df, "reward", target, F.lit(0.5), 300).first()
    assert out["low"] < out["value"] < out["high"] and out["excludes_zero"] == 1 and out["max_weight"] == pytest.approx(1.6)
    rows = [(1.6 if r["up"] else 0.4) * r["reward"] for r in df.collect() if r["reward"] is not None]
    assert out["high"] - out["low"] == pytest.approx(2 * 1.96 * np.std(rows) / len(rows) ** 0.5, rel=0.25)
    assert E.off_policy(df.where("reward > 1e9"), "reward", target, F.lit(0.5), 10).first()["low"] is None


def test_wasserstein_of_equal_samples_is_zero_and_shift_is_shift(tiny_tasks):
    rows = [("a", "ref", float(i)) for i in range(1, 101)] + [("a", "cur", float(i + 50)) for i in range(1, 101)]
    rows += [("b", s, float(i)) for s in ("ref", "cur") for i in range(60)]
    rows += [("c", "ref", 5.0)] * 60 + [("c", "cur", 5.0)] * 60
    long = tiny_tasks.createDataFrame(rows, "feature string, side string, value double")
    got = {r["feature"]: r for r in D.min_max_distance(long, ["feature"]).collect()}
    assert got["a"]["distance"] == pytest.approx(50.0) and got["a"]["ks"] == pytest.approx(0.5)
    assert got["b"]["score"] == pytest.approx(0.0) and got["c"]["score"] == 0.0
    psi = {r["feature"]: r["psi"] for r in D.psi(long, ["feature"]).collect()}
    assert psi["a"] > 0.25 and psi["b"] == pytest.approx(0.0) and psi["c"] == pytest.approx(0.0)


def test_leave_one_out_equals_brute_force(tiny_tasks):
    rng = random.Random(8)
    rows = [(i, g, rng.uniform(0, 10)) for i, g in enumerate([1] + [2] * 2 + [3] * 3 + [4] * 20)]
    df = tiny_tasks.createDataFrame(rows, "i long, g int, v double")
    got = {r["i"]: r["peer_z"] for r in leave_one_out_z(df, ["g"], "v").collect()}
    for i, g, v in rows:
        peers = [x for j, k, x in rows if k == g and j != i]
        if len(peers) < 2:
            assert got[i] == 0.0
            continue
        m = sum(peers) / len(peers)
        sd = (sum((x - m) ** 2 for x in peers) / len(peers)) ** 0.5
        assert got[i] == pytest.approx(max(-5, min(5, (v - m) / (sd + 1e-6))), abs=1e-6)


def test_idle_cells_under_ansi(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "succ double, att double, ul double")
    row = df.select(
        S.success_ratio(F.col("succ"), F.col("att")).alias("a"), S.success_percent(F.col("succ"), F.col("att")).alias("b"),
        S.direction_ratio(F.lit(5.0), F.col("ul")).alias("c"), S.prb_efficiency(F.lit(5.0), F.col("ul")).alias("d"),
        S.guarded_ratio(F.lit(5.0), F.col("ul")).alias("e")).first()
    assert tuple(row) == (0.0, 100.0, 1.0, 0.0, None)


def test_non_finite_values_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.finite(F.col("v"))).collect()] == [None, None, None, 2.0, None]


def test_temporal_split_covers_input_without_overlap(spark):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 700).alias("ts"), (F.col("id") % 2).alias("y"))
    out = temporal_split(df, "ts")
    assert out.count() == 200
    report = split_report(out, "ts", "y")
    assert_no_overlap(report)
    late = report.withColumn("last_us", F.col("last_us") + 10**12)
    with pytest.raises(ValueError):
        assert_no_overlap(late)


def test_scaler_is_fitted_on_train_only(spark):
    train = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 8.0)], "a double, b double")
    row = apply_scaler(test, fit_standard(train, ["a", "b"]), ["a", "b"]).first()
    assert (row["a"], row["b"]) == (3.0, 1.0)


def test_column_quantiles_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SKETCH_ACCURACY", 100)
    rng = np.random.default_rng(5)
    n = 6000
    columns = {"normal": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)), "flat": np.full(n, 3.0), "steps": rng.integers(0, 40, n).astype(float)}
    rows = [tuple(float(c[i]) for c in columns.values()) + (None if i % 3 else float(i), None) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "gaps", "none"])).repartition(7)
    probs = {"least": 0.0, "a": 0.01, "b": 0.333, "m": 0.5, "c": 0.951, "most": 1.0}
    out = {r["feature"]: r for r in prefix.column_quantiles(df, {c: F.col(c) for c in df.columns}, probs).collect()}
    columns["gaps"] = np.arange(0.0, n, 3)
    for name, values in columns.items():
        for q, p in probs.items():
            assert out[name][q] == pytest.approx(np.quantile(values, p), abs=1e-12), (name, q)
    assert all(out["none"][q] is None for q in probs)
    assert [r["m"] for r in prefix.column_quantiles(df.where("false"), {"normal": F.col("normal")}, {"m": 0.5}).collect()] == [None]
    # one action before execution, however many columns
    jobs = []
    for group, cols in (("one", ["normal"]), ("all", df.columns)):
        spark.sparkContext.setJobGroup(group, group)
        later = prefix.column_quantiles(df, {c: F.col(c) for c in cols}, probs)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    assert later.count() == 6


def test_pair_sums_and_diagnostics(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 150)) + 1e6
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = 5.0
    y = (x[:, 0] > 1e6).astype(float)
    names = [f"f{i}" for i in range(150)]
    rows = [tuple(float(v) for v in r) + (float(t),) for r, t in zip(x, y, strict=True)]
    rows[0] = (None, *rows[0][1:])
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"])).repartition(3)
    out = {r["feature"]: r for r in A.feature_diagnostics(df, names, "y").collect()}
    assert len(out) == 150 and out["f0"]["collinear"] == "f1" and out["f1"]["collinear"] == "f0" and out["f5"]["collinear"] == ""
    assert out["f2"]["low_variance"] == 1 and out["f2"]["target_corr"] is None and out["f2"]["collinear"] == ""
    assert out["f9"]["variance"] == pytest.approx(x[:, 9].var(ddof=1), rel=1e-9)
    assert out["f0"]["target_corr"] == pytest.approx(np.corrcoef(x[1:, 0], y[1:])[0, 1], rel=1e-9)


def test_run_health_uses_the_quantile_of_earlier_runs(spark):
    r = random.Random(17)
    rows = [(k, t, r.choice([None, 1.0, 2.0, r.uniform(0, 9), 40.0]), r.randint(0, 1)) for k in ("a", "b", None) for t in range(120)]
    frame = spark.createDataFrame(rows, "pipeline string, at int, took double, failed int")
    out = A.run_health(frame, ["pipeline"], "at", "failed", "took")
    assert out.columns == [*frame.columns, "alert_failed", "alert_streak", "alert_slow"]
    got = {(x.pipeline, x.at): (x.alert_failed, x.alert_streak, x.alert_slow) for x in out.collect()}
    for k, t, took, failed in rows:
        own = [x for x in rows if x[0] == k and x[1] <= t]
        earlier = [x[2] for x in own[:-1] if x[2] is not None]
        slow = bool(earlier) and took is not None and took > 2 * np.quantile(earlier, 0.95)
        assert got[k, t] == (failed, int(len(own) > 2 and all(x[3] for x in own[-3:])), int(slow)), (k, t)
    assert A.run_health(frame.where("false"), ["pipeline"], "at", "failed", "took").count() == 0


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_running_quantile(p):
    r, values, seen = random.Random(3), [], A.RunningQuantile(p)
    assert seen.value() is None
    for _ in range(400):
        values.append(r.choice([r.uniform(-5, 5), float(r.randint(0, 3))]))
        seen.add(values[-1])
        assert seen.value() == pytest.approx(np.quantile(values, p))


def test_metrics_record_blocks_and_gates(spark):
    rows = [(0.9, 0.9, 1), (0.8, 0.2, 1), (0.7, 0.95, 0), (0.2, 0.1, 0), (0.1, 0.9, 0), (0.05, 0.1, 1)]
    frame = spark.createDataFrame(rows, "s1 double, s2 double, y int")
    both = E.cascade(frame, "s1", "s2", "y", 0.5, 0.5)
    impact = E.daily_impact(both.withColumn("prevalence", (F.col("tp") + F.col("fn")) / F.col("n_items")))
    block = E.cascade_block(both)
    one, two = (E.tier_block(frame, s, "y", 0.5) for s in ("s1", "s2"))
    out = E.metrics_record(one, two, block, impact, spark.createDataFrame([(0.99,)], "val_pr_auc double")).first()
    assert (out.tier1.n_positive, out.tier1.n_negative, out.tier1.precision, out.tier1.recall) == (3, 3, 2 / 3, 2 / 3)
    assert (out.cascade.n_cascade_true_positives, out.cascade.n_cascade_false_positives, out.cascade.n_cascade_false_negatives) == (1, 1, 2)
    assert out.cascade.total_miss_rate == 2 / 3 and out.operational_impact.daily_anomalies == 960.0
    ap = (1 + 1 + 3 / 6) / 3
    assert out.tier1.pr_auc == pytest.approx(ap)
    gates = out.governance_gates
    assert gates.tier1_pr_auc_met and not gates.cascade_precision_met and not gates.cascade_recall_met and not gates.overall_pass
    assert out.train_test_comparison.overfitting_warning and out.train_test_comparison.pr_auc_delta == round(ap - 0.99, 4)
    assert "train_test_comparison" not in E.metrics_record(one, two, block, impact).columns
    # one class only: areas are undefined and their gate fails
    plain = E.tier_block(frame.where("y = 0"), "s1", "y", 0.5)
    assert not E.metrics_record(plain, two, block, impact).first().governance_gates.tier1_pr_auc_met


def test_feature_categories_in_order_of_precedence():
    kinds = {"lat": "identifier", "is_anomaly": "label", "rop_index": "temporal", "avg_cqi_roll_4h_mean": "rolling_statistic",
             "handover_success_rate_delta": "delta", "sinr_db_zscore": "rolling_zscore", "sinr_db_peer_zscore": "peer_group_spatial",
             "avg_cqi_neighbour_mean": "graph_neighbour", "handover_success_rate": "cross_kpi_ratio", "avg_cqi": "raw_kpi",
             "counter_is_reset": "data_quality_flag", "anything": "other"}
    assert {n: tables.category(n) for n in kinds} == kinds
    assert set(tables.DESCRIPTIONS) >= {*tables.RATIOS, *tables.RAW_KPIS}

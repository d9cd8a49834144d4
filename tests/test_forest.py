import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ropeway.operators import forest as T
from ropeway.operators import models as M


def frame(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x, y, z = rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
        rows.append((x, y, z, int(rng.random() < (0.8 if x > 0.6 and y > 0 else 0.1))))
    return spark.createDataFrame(rows, "x double, y double, z double, l int").repartition(3)


def test_every_split_is_the_best_of_its_features(spark):
    df = frame(spark)
    got = M.fit_forest(df, ["x", "y", "z"], "l", 6, 5, 7).stages[-1]
    assert got.cuts[1] == [0.0, 1.0] and all(len(c) <= T.BINS - 1 for c in got.cuts)
    w = np.array(got.weights)
    for t in range(6):
        inner = np.flatnonzero(got.feat[t] != T.LEAF)
        assert inner.size and inner.max() < 2 ** 5 - 1
        for k in inner:
            low, high = got.counts[t, 2 * k + 1], got.counts[t, 2 * k + 2]
            assert (low + high == got.counts[t, k]).all() and min(low.sum(), high.sum()) >= 7
            gini = lambda c: 2 * np.prod(c * w) / (c * w).sum()
            assert got.gain[t, k] == pytest.approx(gini(got.counts[t, k]) - gini(low) - gini(high), rel=1e-3, abs=1e-3)
    # three features, two a node: the informative ones lead
    order = sorted(zip(got.featureImportances, "xyz", strict=True), reverse=True)
    assert order[-1][1] == "z" and sum(v for v, _ in order) == pytest.approx(1)
    again = M.fit_forest(df.coalesce(1), ["x", "y", "z"], "l", 6, 5, 7).stages[-1]
    assert again.cuts == got.cuts


def test_best_split_matches_brute_force():
    rng = np.random.default_rng(3)
    counts, weights = rng.integers(0, 9, (5, 2, T.BINS, 2)), (0.6, 2.5)
    counts[:, 1] = rng.permuted(counts[:, 0], axis=1)
    counts[:, 1, 0] += (counts[:, 0].sum(axis=1) - counts[:, 1].sum(axis=1))
    gain, place, cut, low, high = T._best(counts, weights, 20)
    gini = lambda c: 2 * c[0] * weights[0] * c[1] * weights[1] / max(c[0] * weights[0] + c[1] * weights[1], 1e-300)
    for i, node in enumerate(counts):
        tried = {}
        for p in range(2):
            for b in range(T.BINS - 1):
                left, right = node[p, :b + 1].sum(axis=0), node[p, b + 1:].sum(axis=0)
                if left.sum() >= 20 and right.sum() >= 20:
                    tried[p, b] = gini(left + right) - gini(left) - gini(right)
        assert gain[i] == pytest.approx(max(tried.values()))
        assert tried[place[i], cut[i]] == pytest.approx(gain[i])
        assert (low[i] == node[place[i], :cut[i] + 1].sum(axis=0)).all() and (high[i] == node[place[i], cut[i] + 1:].sum(axis=0)).all()


def test_draws_are_poisson_and_repeat():
    drawn = T._counts(42, 3, 1, 200_000)
    assert (drawn == T._counts(42, 3, 1, 200_000)).all() and (drawn != T._counts(42, 4, 1, 200_000)).any()
    for k in range(4):
        assert (drawn == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)


def test_as_good_as_spark_ml(spark):
    df = frame(spark, 6000)
    train, val = df.where("pmod(xxhash64(x), 3) > 0"), df.where("pmod(xxhash64(x), 3) = 0")
    ours = M.evaluate(M.score(M.fit_forest(train, ["x", "y", "z"], "l", 40, 6, 5), val), "l").first()
    pack = VectorAssembler(inputCols=["x", "y", "z"], outputCol="_x")
    theirs = RandomForestClassifier(featuresCol="_x", labelCol="l", weightCol="_weight", numTrees=40, maxDepth=6, minInstancesPerNode=5, seed=1)
    model = theirs.fit(pack.transform(M.balanced(train, "l")))
    ref = M.evaluate(M.score(model, pack.transform(val)), "l").first()
    assert ours["roc_auc"] == pytest.approx(ref["roc_auc"], abs=0.02) and ours["pr_auc"] == pytest.approx(ref["pr_auc"], abs=0.03)


def test_leaves_missing_values_and_one_class(spark):
    df = spark.createDataFrame([(float("nan") if i % 4 == 0 else float(i % 4), int(i % 4 == 0)) for i in range(400)], "x double, l int")
    model = M.fit_forest(df, ["x"], "l", 5, 3, 2)
    far = M.score(model, df).groupBy("l").agg(F.min("score"), F.max("score")).collect()
    assert {tuple(r) for r in far} == {(0, 0.0, 0.0), (1, 1.0, 1.0)}
    alone = M.fit_forest(df.where("l = 0"), ["x"], "l", 2, 3, 2)
    assert {r["score"] for r in M.score(alone, df).collect()} == {0.0}
    with pytest.raises(ValueError):
        M.fit_forest(df.withColumn("l", F.lit(None).cast("int")), ["x"], "l", 2, 3, 2)


def test_measures_score_each_row_once(spark):
    ran = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        ran.add(1)
        return x

    scored = frame(spark, 500).select("l", counted.asNondeterministic()("x").alias("score"))
    M.evaluate(scored, "l").first()
    assert ran.value == 500


def test_grid_grows_once_what_forests_alone_grow(spark, monkeypatch):
    df = frame(spark, 900)
    grid = [{"trees": t, "depth": d, "min_leaf": m} for t in (2, 4) for d in (3, 6) for m in (3, 9)]
    alone = {(g["depth"], g["min_leaf"]): M.fit_forest(df, ["x", "y", "z"], "l", 4, g["depth"], g["min_leaf"]) for g in grid}
    made, passes, fitted, fit = [], [], [], M.fit_forest
    durable, deepen = T.durable, T.Grove._deepen
    monkeypatch.setattr(T, "durable", lambda d: made.append(1) or durable(d))
    monkeypatch.setattr(T.Grove, "_deepen", lambda g: passes.append(g.level) or deepen(g))
    monkeypatch.setattr(M, "fit_forest", lambda *a, **k: fitted.append((a[4:6], m := fit(*a, **k))) or m)
    rows = M.grid_search(df, df, ["x", "y", "z"], "l", grid).collect()
    # the rows are binned once and a level is one pass, whatever the number of settings
    assert len(made) == 1 and passes == list(range(6))
    assert [s for s, _ in fitted] == [(d, m) for d in (3, 6) for m in (3, 9)]
    for shape, model in fitted:
        one, own = alone[shape].stages[-1], model.stages[-1]
        for a in ("feat", "cut", "counts", "gain"):
            assert (getattr(one, a) == getattr(own, a)).all(), (shape, a)
    # leaf sizes part on the way
    assert (fitted[2][1].stages[-1].feat != fitted[3][1].stages[-1].feat).any()
    for g, r in zip(grid, rows, strict=True):
        want = M.evaluate(M.score(M.first_trees(alone[g["depth"], g["min_leaf"]], g["trees"]), df), "l").first()
        assert (r.roc_auc, r.pr_auc) == pytest.approx((want.roc_auc, want.pr_auc), abs=1e-12)


def test_votes_of_parts_and_strangers(spark):
    df = frame(spark, 300)
    deep, other = (M.fit_forest(df, ["x", "y", "z"], "l", n, d, m, seed=s).stages[-1] for n, d, m, s in ((5, 5, 3, 1), (3, 2, 20, 2)))
    forests = [deep.part(slice(2)), other, deep, other.part(slice(1))]
    assert forests[0].begins(deep) and not other.begins(deep) and not deep.begins(forests[0])
    packed = VectorAssembler(inputCols=["x", "y", "z"], outputCol="_x").transform(df)
    got = packed.select(T.votes(spark, forests)(T.vector_to_array("_x")).alias("p"), "x", "y", "z").collect()
    for i, f in enumerate(forests):
        share = f.counts[..., 1] * f.weights[1] / np.maximum((f.counts * np.array(f.weights)).sum(axis=-1), 1e-300)
        for r in got[:40]:
            bins = [np.searchsorted(c, r[k]) for c, k in zip(f.cuts, "xyz", strict=True)]
            total = 0.0
            for t in range(f.getNumTrees):
                k = 0
                while f.feat[t, k] != T.LEAF:
                    k = 2 * k + 1 + (bins[f.feat[t, k]] > f.cut[t, k])
                total += share[t, k]
            assert r["p"][i] == pytest.approx(total / f.getNumTrees)
    assert M.grid_search(df, df.where("x > 2"), ["x", "y", "z"], "l", [{"trees": 1, "depth": 2, "min_leaf": 5}]).first()["pr_auc"] is None


def test_grid_scores_each_row_once(spark, monkeypatch):
    ran, votes = spark.sparkContext.accumulator(0), M.votes

    @F.udf("array<double>")
    def counted(p):
        ran.add(1)
        return p

    monkeypatch.setattr(M, "votes", lambda s, f: lambda c: counted.asNondeterministic()(votes(s, f)(c)))
    df = frame(spark, 200)
    M.grid_search(df, df, ["x", "y", "z"], "l", [{"trees": 2, "depth": d, "min_leaf": m} for d in (1, 2) for m in (5, 9)]).collect()
    assert ran.value == 200

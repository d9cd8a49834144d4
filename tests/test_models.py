import inspect
import random

import pytest

from ropeway.catalog import models
from ropeway.operators import models as M


def test_registered_models_have_full_size_and_score_the_test_split(spark, monkeypatch):
    frame = spark.createDataFrame([(float(i % 7), int(i % 3 == 0)) for i in range(60)], "x double, is_anomaly int").coalesce(1)
    monkeypatch.setattr(models, "_frames", lambda s, d: (["x"], frame, frame, frame))
    fit, sizes = M.fit_forest, []

    def small(*a, **k):
        bound = inspect.signature(fit).bind(*a, **k)
        bound.apply_defaults()
        sizes.append(tuple(bound.arguments[n] for n in ("trees", "depth", "min_leaf")))
        bound.arguments.update(trees=1, depth=2)
        return fit(*bound.args, **bound.kwargs)

    monkeypatch.setattr(M, "fit_forest", small)
    val, test = models.random_forest(spark, "").collect()
    assert sizes == [(300, 12, 5)]
    assert (val.split, test.split) == ("val", "test") and val[1:] == test[1:]
    rows = models.forest_grid(spark, "").collect()
    # settings with 200 trees take the first ones of the forests of 300
    assert sizes[1:] == [(300, d, m) for d in (8, 12) for m in (3, 5)]
    assert [(r.trees, r.depth, r.min_leaf) for r in rows] == [(t, d, m) for t in (200, 300) for d in (8, 12) for m in (3, 5)]
    best = max(rows, key=lambda r: (r.pr_auc, -r.setting))
    assert [r.setting for r in rows if r.test_pr_auc is not None] == [best.setting]
    assert best.test_pr_auc == best.pr_auc


def test_first_trees_vote_alone(spark):
    rng = random.Random(1)
    rows = [(x := rng.random(), y := rng.random(), int(x + 0.3 * rng.random() > 0.6 and y > 0.2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, l int").coalesce(2)
    whole = M.fit_forest(df, ["x", "y"], "l", 9, 4, 3)
    assert M.first_trees(whole, 9) is whole
    some = M.first_trees(whole, 4)
    assert [t.toDebugString for t in some.stages[-1].trees] == [t.toDebugString for t in whole.stages[-1].trees[:4]]
    got = [r["score"] for r in M.score(some, df, digits=9).collect()]
    votes = whole.stages[0].transform(df)
    each = [[r["probability"][1] for r in t.setFeaturesCol("_x").transform(votes).select("probability").collect()] for t in whole.stages[-1].trees[:4]]
    assert got == pytest.approx([sum(p) / 4 for p in zip(*each, strict=True)], abs=1e-8)
    # a real fit tells the classes apart
    assert M.evaluate(M.score(whole, df), "l").first()["roc_auc"] > 0.9

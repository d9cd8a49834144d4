"""Model fitting: forest, grid search, logistic baseline on Spark ML, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ropeway.operators.evaluate import areas, best_thresholds, curve, score_counts
from ropeway.operators.forest import Grove, votes
from ropeway.session import durable

# Forest size and the searched grid.
TREES, DEPTH = 300, 12
FOREST_GRID = tuple({"trees": t, "depth": d, "min_leaf": m} for t in (200, 300) for d in (8, 12) for m in (3, 5))


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Weight n / (2 * n_class) per row."""
    n = train.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))).scalar()
    pos = F.greatest(n["p"], F.lit(1))
    neg = F.greatest(n["n"] - n["p"], F.lit(1))
    return train.withColumn("_weight", n["n"] / (2.0 * F.when(F.col(label) == 1, pos).otherwise(neg)))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")


def fit_forest(train: DataFrame, features: Sequence[str], label: str, trees: int = TREES, depth: int = DEPTH,
               min_leaf: int = 5, seed: int = 42, grove: Grove | None = None):
    """A forest of its own, or one of a grove that grows forests of these rows together."""
    assembler = _assembler(features)
    grove = grove or Grove(assembler.transform(train), "_x", label, (min_leaf,), seed)
    return PipelineModel([assembler, grove.forest(trees, depth, min_leaf)])


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, max_iter: int = 100):
    """Balanced logistic regression on standardised features."""
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True)
    model = LogisticRegression(featuresCol="_z", labelCol=label, weightCol="_weight", maxIter=max_iter)
    return Pipeline(stages=[_assembler(features), scaler, model]).fit(balanced(train, label))


def score(model, df: DataFrame, name: str = "score", digits: int = 6) -> DataFrame:
    """Probability of the positive class; rounded so that equal scores share one count row."""
    keep = [c for c in df.columns]
    out = model.transform(df)
    return out.select(*keep, F.round(vector_to_array("probability")[1], digits).alias(name))


def score_all(models: Sequence[PipelineModel], df: DataFrame, label: str, digits: int = 6) -> DataFrame:
    """Rounded scores of one frame by several forests of the same features: setting (place in the list), score, label."""
    rows = models[0].stages[0].transform(df)
    p = votes(df.sparkSession, [m.stages[-1] for m in models])(vector_to_array("_x"))
    each = rows.select(label, p.alias("_p")).select(label, F.posexplode("_p").alias("setting", "_p"))
    return each.select("setting", F.round("_p", digits).alias("score"), label)


def evaluate(scored: DataFrame, label: str, name: str = "score") -> DataFrame:
    """Both areas and the best F1 threshold on a validation frame."""
    # the model runs once, not once per measure
    counts = durable(score_counts(scored, [], name, label))
    best = best_thresholds(curve(counts, [], name), [], name).select(F.struct("f1_threshold", "f1")).scalar()
    return areas(counts, [], name).select("roc_auc", "pr_auc", best["f1_threshold"].alias("threshold"), best["f1"].alias("f1"))


def held_out(model, val: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """``evaluate`` on the validation frame and, at the threshold found there, on the test frame: a row each."""
    on_val = evaluate(score(model, val), label).first()
    cut = on_val["threshold"]
    scored = durable(score(model, test).select("score", label))
    hit, true = F.col("score") >= F.lit(cut), F.col(label) == 1
    f1 = scored.agg((2 * F.count_if(hit & true) / F.nullif(F.count_if(hit) + F.count_if(true), F.lit(0))).alias("f1")).first()["f1"]
    on_test = areas(score_counts(scored, [], "score", label), [], "score").first()
    rows = [("val", *(on_val[c] for c in ("roc_auc", "pr_auc", "threshold", "f1"))), ("test", on_test["roc_auc"], on_test["pr_auc"], cut, f1)]
    return val.sparkSession.createDataFrame(
        rows, "split string, roc_auc double, pr_auc double, threshold double, f1 double")


def first_trees(model: PipelineModel, trees: int) -> PipelineModel:
    """The forest of the first trees of a fitted forest: trees are drawn and grown independently of each other."""
    own = model.stages[-1]
    if trees >= own.getNumTrees:
        return model
    return PipelineModel([*model.stages[:-1], own.part(slice(trees))])


def grid_search(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, grid=FOREST_GRID,
                test: DataFrame | None = None) -> DataFrame:
    """Validation PR-AUC of every forest setting on the fixed temporal split.

    Settings that differ in the number of trees share one fit of the largest, of which
    the smaller forests are the first trees; all fits grow together and score the rows in
    one pass.  With ``test``, the setting with the largest PR-AUC (the first of equal ones) is
    scored there too.
    """
    rows, best, fitted = [], None, {}
    most = {(g["depth"], g["min_leaf"]): max(h["trees"] for h in grid if (h["depth"], h["min_leaf"]) == (g["depth"], g["min_leaf"])) for g in grid}
    grove = Grove(_assembler(features).transform(train), "_x", label, sorted({g["min_leaf"] for g in grid}))
    for shape, trees in most.items():
        fitted[shape] = fit_forest(train, features, label, trees, *shape, grove=grove)
    models = [first_trees(fitted[g["depth"], g["min_leaf"]], g["trees"]) for g in grid]
    # the models run once, not once per pass over the counts
    counts = durable(score_counts(score_all(models, val, label), ["setting"], "score", label))
    measured = {r["setting"]: r for r in areas(counts, ["setting"], "score").collect()}
    for i, g in enumerate(grid):
        # a setting without a row has nothing to score
        roc, pr = (measured[i]["roc_auc"], measured[i]["pr_auc"]) if i in measured else (None, None)
        rows.append([i, *g.values(), roc, pr])
        if best is None or (pr or 0.0) > best[0]:
            best = (pr or 0.0, i, models[i])
    schema = ", ".join(["setting int", *(f"{k} int" for k in grid[0]), "roc_auc double", "pr_auc double"])
    if test is not None:
        got = areas(durable(score_counts(score(best[2], test), [], "score", label)), [], "score").first()
        rows = [[*r, *((got["roc_auc"], got["pr_auc"]) if r[0] == best[1] else (None, None))] for r in rows]
        schema += ", test_roc_auc double, test_pr_auc double"
    return train.sparkSession.createDataFrame(rows, schema)


def importances(model, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Impurity importance per feature, ranked; one row per column of the model."""
    values = model.stages[-1].featureImportances.toArray()
    pairs = sorted(zip(features, (float(v) for v in values)), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame(
        [(f, v, i + 1) for i, (f, v) in enumerate(pairs)], "feature string, importance double, rank int")

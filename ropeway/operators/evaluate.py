"""Classification metrics on ordered score counts.

Scored rows collapse to (group, score, positives, negatives) first; every curve,
area and threshold search is an ordered running sum over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.operators.resample import bootstrap_means, hashed_key, intervals
from ropeway.plans.prefix import exact_quantiles, quantile_grid, running_sums, value_counts
from ropeway.plans.skew import attach

# Search limits, gates, and the ensemble weight grid.
PRECISION_TARGET, RECALL_TARGET, YOUDEN_MIN_PRECISION = 0.85, 0.90, 0.10
WEIGHT_GRID = ((0.20, 0.50, 0.30), (0.10, 0.70, 0.20), (0.25, 0.40, 0.35), (0.30, 0.30, 0.40))


def safe(num: Column, den: Column) -> Column:
    """Ratio that is 0 when undefined."""
    return F.coalesce(num / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation, NULL when a column is constant (``corr`` divides by zero there)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def confusion(df: DataFrame, groups: Sequence[str], predicted: Column, label: str) -> DataFrame:
    y = F.col(label) == 1
    return df.groupBy(*groups).agg(
        F.count_if(predicted & y).alias("tp"), F.count_if(predicted & ~y).alias("fp"),
        F.count_if(~predicted & ~y).alias("tn"), F.count_if(~predicted & y).alias("fn"),
    )


def rates() -> dict[str, Column]:
    """Rates of a confusion row (columns tp, fp, tn, fn)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    # products of row counts pass 2**63 on large tables
    product = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "f1": safe(2.0 * tp, 2 * tp + fp + fn),
        "specificity": safe(tn, tn + fp),
        "false_alarm_rate": safe(fp, fp + tn),
        "prevalence": safe(tp + fn, tp + fp + tn + fn),
        "mcc": safe(tp.cast("double") * tn - fp.cast("double") * fn, product),
    }


def threshold_metrics(df: DataFrame, groups: Sequence[str], score: str, label: str,
                      threshold: float | Column, strict: bool = False) -> DataFrame:
    """Confusion counts and rates at a threshold; ``strict`` flags only above it."""
    cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = (F.col(score) > cut) if strict else (F.col(score) >= cut)
    return confusion(df, groups, hit, label).select("*", *[c.alias(n) for n, c in rates().items()])


def brier(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.groupBy(*groups).agg(F.avg(gap * gap).alias("brier"))


def score_counts(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    return value_counts(df, groups, score, {"n_pos": F.col(label), "n_neg": 1 - F.col(label)})


def accumulate(counts: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """True and false positives when everything from this score up is flagged."""
    return running_sums(counts, groups, score, {"tp": "n_pos", "fp": "n_neg"}, descending=True)


def areas(counts: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """ROC-AUC with averaged ties and PR-AUC as average precision; NULL if one class lacks."""
    acc = accumulate(counts, groups, score)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pos, neg = F.sum("n_pos").cast("double"), F.sum("n_neg").cast("double")
    pairs = F.sum(F.col("n_neg") * (tp - F.col("n_pos") / 2.0))
    ap = F.sum(F.col("n_pos") * safe(tp, tp + fp))
    none = F.lit(0.0)
    return acc.groupBy(*groups).agg(
        (pairs / F.nullif(pos * neg, none)).alias("roc_auc"),
        (ap / F.nullif(pos, none)).alias("pr_auc"),
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"),
    )


def curve(counts: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """Precision, recall, F1, FPR and Youden's J at every distinct threshold."""
    totals = counts.groupBy(*groups).agg(
        F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"), F.count(F.lit(1)).alias("_rows")
    )
    acc = attach(accumulate(counts, groups, score), totals, groups, rows="_rows").drop("_rows")
    return with_curve_columns(acc)


def with_curve_columns(acc: DataFrame) -> DataFrame:
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    return acc.withColumns({
        "precision": safe(tp, tp + fp), "recall": safe(tp, p),
        "f1": safe(2.0 * tp, p + tp + fp), "fpr": safe(fp, n),
        "youden": safe(tp, p) - safe(fp, n),
    })


def best_thresholds(points: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """F1, precision and recall modes; equal values resolve to the lowest threshold."""
    s = F.col(score)
    first = lambda metric, where=None: F.max_by(
        s, F.when(where, F.struct(metric, -s)) if where is not None else F.struct(metric, -s))
    ok_p, ok_r = F.col("precision") >= PRECISION_TARGET, F.col("recall") >= RECALL_TARGET
    return points.groupBy(*groups).agg(
        first(F.col("f1")).alias("f1_threshold"), F.max("f1").alias("f1"),
        F.coalesce(F.max(F.when(ok_p, s)), first(F.col("precision"))).alias("precision_threshold"),
        F.coalesce(F.min(F.when(ok_r, s)), first(F.col("recall"))).alias("recall_threshold"),
    )


def youden_threshold(points: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """Highest J among thresholds of at least 10 % precision, else the best F1."""
    s = F.col(score)
    ok = F.col("precision") >= YOUDEN_MIN_PRECISION
    row = F.struct(s.alias("threshold"), "precision", "recall", "f1", "youden")
    best = F.coalesce(
        F.max_by(row, F.when(ok, F.struct(F.col("youden"), -s))),
        F.max_by(row, F.struct(F.col("f1"), -s)),
    )
    return points.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.*")


def grid_search(df: DataFrame, score: str, label: str) -> DataFrame:
    """Best threshold per metric over 200 score percentiles from 1 to 99."""
    probs = [(1 + 98 * i / 199) / 100 for i in range(200)]
    grid = quantile_grid(df, [], score, probs).select(F.col("q").alias(score)).distinct()
    marks = grid.select(score, F.lit(0).cast("long").alias("n_pos"), F.lit(0).cast("long").alias("n_neg"),
                        F.lit(-1).alias("_mark"))
    counts = score_counts(df, [], score, label).withColumn("_mark", F.lit(0))
    acc = running_sums(counts.unionByName(marks), [], score, {"tp": "n_pos", "fp": "n_neg"},
                       ties=["_mark"], descending=False, exclusive=True)
    # rows below the mark are left out of the flagged set
    totals = counts.agg(F.struct(F.sum("n_pos").alias("p"), F.sum("n_neg").alias("n"))).scalar()
    at = acc.where("_mark = -1").select(
        F.col(score).alias("threshold"), totals["p"].alias("p"), totals["n"].alias("n"),
        (totals["p"] - F.col("tp")).alias("tp"), (totals["n"] - F.col("fp")).alias("fp"))
    at = with_curve_columns(at).withColumn("balanced_accuracy", (F.col("recall") + 1 - F.col("fpr")) / 2)
    flagged = F.col("tp") + F.col("fp")
    usable = at.where((flagged > 0) & (flagged < F.col("p") + F.col("n")))
    t = F.col("threshold")
    metrics = ["f1", "precision", "recall", "balanced_accuracy"]
    return usable.agg(*[
        c for m in metrics for c in (
            F.max_by(t, F.struct(F.round(m, 12), -t)).alias(f"{m}_threshold"), F.max(m).alias(m))
    ])


def weight_search(df: DataFrame, scores: Sequence[str], label: str,
                  grid: Sequence[Sequence[float]] = WEIGHT_GRID) -> DataFrame:
    """ROC-AUC of every weight set; ``best`` marks the winner (first on ties)."""
    options = F.explode(F.array(*[
        F.struct(F.lit(i).alias("grid_id"), sum(F.col(s) * w for s, w in zip(scores, ws)).alias("ensemble"))
        for i, ws in enumerate(grid)
    ]))
    combos = df.select(label, options.alias("o")).select(label, "o.*").withColumn(
        "ensemble", F.round("ensemble", 9))
    out = areas(score_counts(combos, ["grid_id"], "ensemble", label), ["grid_id"], "ensemble")
    winner = out.agg(F.max_by("grid_id", F.struct(F.round("roc_auc", 12), -F.col("grid_id")))).scalar()
    return out.withColumn("best", (F.col("grid_id") == winner).cast("int"))


def cascade(df: DataFrame, s1: str, s2: str, label: str, t1: float, t2: float) -> DataFrame:
    """Stage 2 decides only what stage 1 flags."""
    first = F.col(s1) >= t1
    both = first & (F.col(s2) >= t2)
    scored = df.withColumns({
        "_first": first, "_both": both,
        "cascade_score": F.when(first, F.col(s2)).otherwise(F.col(s1) / 2),
    })
    base = confusion(scored, [], F.col("_both"), label).select(
        "*", *[rates()[n].alias(n) for n in ("precision", "recall", "f1", "false_alarm_rate")])
    stage = scored.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("_first").alias("n_first"))
    auc = areas(score_counts(scored, [], "cascade_score", label), [], "cascade_score").select("roc_auc")
    st = stage.select(F.struct("*")).scalar()
    return base.select(
        "*", st["n_items"].alias("n_items"), st["n_first"].alias("n_first"),
        (1 - st["n_first"] / st["n_items"]).alias("reduction_rate"), auc.scalar().alias("roc_auc"))


def tier_block(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One tier's record: class sizes, rates at the threshold, both areas and the Brier score."""
    area = areas(score_counts(df, [], score, label), [], score).select(F.struct("roc_auc", "pr_auc")).scalar()
    return threshold_metrics(df, [], score, label, threshold).select(
        F.lit(float(threshold)).alias("threshold"), (F.col("tp") + F.col("fn")).alias("n_positive"),
        (F.col("tn") + F.col("fp")).alias("n_negative"),
        *["prevalence", "precision", "recall", "f1", "specificity", "mcc"],
        area["roc_auc"].alias("roc_auc"), area["pr_auc"].alias("pr_auc"), brier(df, [], score, label).scalar().alias("brier_score"))


def cascade_block(metrics: DataFrame) -> DataFrame:
    """The record of both tiers together, from ``cascade``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return metrics.select(
        F.col("n_items").alias("n_total_items"), (tp + fn).alias("n_true_anomalies"),
        F.col("precision").alias("cascade_precision"), F.col("recall").alias("cascade_recall"), F.col("f1").alias("cascade_f1"),
        F.col("roc_auc").alias("cascade_roc_auc"), F.col("reduction_rate").alias("tier1_reduction_rate"),
        F.col("false_alarm_rate").alias("total_false_alarm_rate"), safe(fn, tp + fn).alias("total_miss_rate"),
        (tp + fp).alias("n_cascade_positives"), tp.alias("n_cascade_true_positives"),
        fp.alias("n_cascade_false_positives"), fn.alias("n_cascade_false_negatives"))


# Least PR-AUC of the first tier, precision and recall of the cascade; loss of PR-AUC that warns of overfitting.
LEAST_PR_AUC, LEAST_PRECISION, LEAST_RECALL, OVERFIT = 0.60, 0.70, 0.65, -0.10


def metrics_record(tier1: DataFrame, tier2: DataFrame, both: DataFrame, impact: DataFrame,
                   validation: DataFrame | None = None) -> DataFrame:
    """One nested record: tier1, tier2, cascade, operational_impact, governance_gates, train_test_comparison.

    All arguments are one-row tables; ``validation`` has the first tier's val_pr_auc,
    and without it the comparison is left out.  An undefined metric fails its gate.
    """
    one = lambda df: df.select(F.struct("*")).scalar()
    out = both.select(F.struct("*").alias("cascade")).withColumns(
        {"tier1": one(tier1), "tier2": one(tier2), "operational_impact": one(impact)})
    checks = {"tier1_pr_auc": (F.col("tier1.pr_auc"), LEAST_PR_AUC),
              "cascade_precision": (F.col("cascade.cascade_precision"), LEAST_PRECISION),
              "cascade_recall": (F.col("cascade.cascade_recall"), LEAST_RECALL)}
    met = {n: F.coalesce(c >= least, F.lit(False)) for n, (c, least) in checks.items()}
    every = F.lit(True)
    for m in met.values():
        every = every & m
    out = out.withColumn("governance_gates", F.struct(
        *[F.lit(least).alias(f"{n}_minimum") for n, (_, least) in checks.items()],
        *[m.alias(f"{n}_met") for n, m in met.items()], every.alias("overall_pass")))
    order = ["tier1", "tier2", "cascade", "operational_impact", "governance_gates"]
    if validation is None:
        return out.select(*order)
    known, test = one(validation)["val_pr_auc"], F.col("tier1.pr_auc")
    return out.select(*order, F.struct(
        known.alias("val_pr_auc"), test.alias("test_pr_auc"), F.round(test - known, 4).alias("pr_auc_delta"),
        (test - known < OVERFIT).alias("overfitting_warning")).alias("train_test_comparison"))


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Mean score against the positive share; a bin contains its upper border."""
    at = F.greatest(F.ceil(F.round(F.col(score) * bins, 9)) - 1, F.lit(0)).cast("int")
    return df.groupBy(at.alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(label).alias("positive_rate"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, score: str, label: str, bins: int = 50) -> DataFrame:
    """Counts per class in equal bins of 0-1."""
    at = F.least(F.floor(F.round(F.col(score) * bins, 9)), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))


def correlation_baseline(df: DataFrame, features: Sequence[str], label: str, prob: float = 0.95) -> DataFrame:
    """Best correlated feature above its p95, and the majority class, as F1 baselines."""
    corr = df.agg(*[F.coalesce(F.abs(correlation(f, label)), F.lit(0.0)).alias(f) for f in features]).first()
    best = max(features, key=lambda f: (round(corr[f], 12), -features.index(f)))
    cut = exact_quantiles(df, [], best, {"t": prob}).first()["t"]
    rule = threshold_metrics(df, [], best, label, cut, strict=True).select(
        F.lit(best).alias("feature"), F.lit(cut).alias("threshold"), "precision", "recall", "f1")
    share = df.agg(F.avg(label)).scalar()
    return rule.withColumn("majority_accuracy", F.greatest(share, 1 - share)).withColumn(
        "majority_f1", F.when(share > 0.5, 2 * share / (1 + share)).otherwise(0.0))


def attribution_ranking(rows: DataFrame, feature: str, value: str) -> DataFrame:
    """Mean absolute attribution per feature, ranked; the table has one row per feature."""
    out = rows.groupBy(feature).agg(F.avg(F.abs(value)).alias("importance"))
    order = Window.orderBy(F.col("importance").desc(), feature)
    return out.withColumn("rank", F.row_number().over(order))


def root_cause_ranking(candidates: DataFrame, incident: str, score: str, is_root: str, tie: str, k: int = 3) -> DataFrame:
    """Top-1 and top-k hit rates over labelled incidents, node ROC-AUC and label coverage."""
    over = Window.partitionBy(incident).orderBy(F.col(score).desc(), tie)
    top = candidates.withColumn("_rn", F.row_number().over(over)).where(F.col("_rn") <= k)
    hits = top.groupBy(incident).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(is_root))).alias("hit1"), F.max(is_root).alias("hitk"))
    known = candidates.groupBy(incident).agg(F.max(is_root).alias("labelled"))
    summary = hits.join(known, incident).agg(
        F.avg(F.when(F.col("labelled") == 1, F.col("hit1"))).alias("top1"),
        F.avg(F.when(F.col("labelled") == 1, F.col("hitk"))).alias("top_k"),
        F.avg("labelled").alias("coverage"), F.count(F.lit(1)).alias("incidents"))
    auc = areas(score_counts(candidates, [], score, is_root), [], score).select("roc_auc").scalar()
    return summary.withColumn("node_auc", auc)


def gate(metrics: DataFrame, limits: Sequence[tuple[str, str, float]]) -> DataFrame:
    """One row per rule (metric, >= or <=, limit) of a one-row metrics table, with all-pass."""
    rules = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(op).alias("op"), F.lit(float(v)).alias("limit"),
                 F.col(m).cast("double").alias("value")) for m, op, v in limits]))
    out = metrics.select(rules.alias("r")).select("r.*")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    out = out.withColumn("passed", F.coalesce(ok, F.lit(False)))
    return out.withColumn("all_passed", F.min("passed").over(Window.partitionBy(F.lit(1))))


def fixed_recall_precision(points: DataFrame, groups: Sequence[str], recall: float = 0.05) -> DataFrame:
    """Best precision among thresholds that reach the recall."""
    return points.where(F.col("recall") >= recall).groupBy(*groups).agg(F.max("precision").alias("precision_at_recall"))


def precision_at(df: DataFrame, score: str, label: str, tie: str, k: int = 50) -> DataFrame:
    return df.orderBy(F.col(score).desc(), tie).limit(k).agg(F.avg(label).alias("precision_at_k"))


# Cost model of the first impact estimate.
TICKET_COST, MISS_COST, BASE_RECALL, BASE_FALSE_ALARM = 45.0, 500.0, 0.68, 0.12
# Cost model of the second impact estimate.
BASE_FALSE_ALARMS, HOURLY_RATE, MINUTES_PER_ALARM = 10000.0, 85.0, 25.0


def daily_impact(metrics: DataFrame, periods: int = 96, cells: int = 20) -> DataFrame:
    """Daily false alarms, misses and savings against a fixed-threshold baseline.

    ``metrics`` carries tp, fp, fn, n_items and prevalence of the evaluated cascade.
    """
    decisions = float(periods * cells)
    scale = decisions / F.greatest(F.col("n_items"), F.lit(1))
    base_fp = decisions * BASE_FALSE_ALARM
    base_fn = decisions * F.col("prevalence") * (1 - BASE_RECALL)
    fp_less = F.greatest(base_fp - F.col("fp") * scale, F.lit(0.0))
    fn_less = F.greatest(base_fn - F.col("fn") * scale, F.lit(0.0))
    saving = fp_less * TICKET_COST + fn_less * MISS_COST
    return metrics.select(
        F.round(decisions * F.col("prevalence"), 1).alias("daily_anomalies"),
        F.round(F.col("fp") * scale, 1).alias("daily_false_alarms"),
        F.round(F.col("fn") * scale, 1).alias("daily_missed"),
        F.round(fp_less, 1).alias("false_alarms_avoided"), F.round(fn_less, 1).alias("misses_avoided"),
        F.round(saving, 0).alias("daily_saving"), F.round(saving * 365, 0).alias("annual_saving"))


def annual_impact(metrics: DataFrame, year_share: float = 0.25) -> DataFrame:
    """Yearly false alarms, analyst hours and cost from test-period tp and fp."""
    fp, tp = F.col("fp") / year_share, F.col("tp") / year_share
    unit = MINUTES_PER_ALARM / 60.0 * HOURLY_RATE
    return metrics.select(
        fp.alias("false_alarms"), tp.alias("detections"),
        ((BASE_FALSE_ALARMS - fp) * MINUTES_PER_ALARM / 60.0).alias("hours_saved"),
        ((BASE_FALSE_ALARMS - fp) * unit).alias("cost_saved"),
        (100.0 * (BASE_FALSE_ALARMS - fp) / (BASE_FALSE_ALARMS + 1e-9)).alias("reduction_pct"),
        (fp * unit / (tp + 1e-9)).alias("cost_per_detection"))


def off_policy(df: DataFrame, reward: str, target: Column, behaviour: Column, replicates: int = 1000,
               level: float = 0.95, seed: int = 42, key=hashed_key) -> DataFrame:
    """Importance-weighted mean reward, its bootstrap percentile interval, largest weight and logged mean.

    ``excludes_zero`` tells whether the interval lies on one side of zero, the gate a
    candidate policy must pass.  Rows of equal weighted reward are drawn together.
    """
    w = target / behaviour
    weighted = df.withColumns({"_w": w, "_r": w * F.col(reward)})
    point = weighted.agg(F.avg("_r").alias("value"), F.max("_w").alias("max_weight"), F.avg(reward).alias("logged"))
    means = bootstrap_means(value_counts(weighted, [], "_r"), "_r", replicates, seed, key)
    low, high = F.col("mean_low"), F.col("mean_high")
    x = intervals(means, ["mean"], level).select(F.struct(
        low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).cast("int").alias("excludes_zero"))).scalar()
    return point.select("value", x["low"].alias("low"), x["high"].alias("high"), "max_weight", "logged", x["excludes_zero"].alias("excludes_zero"))

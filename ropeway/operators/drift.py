"""Distribution drift between a reference and a current sample in long form.

Long form: one row per (group..., value) with ``side`` 'ref' or 'cur'.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.prefix import exact_quantiles, running_sums, value_counts
from ropeway.plans.skew import attach, lookup_join

# Limits of the two drift reports.
PSI_LIMITS, WASSERSTEIN_LIMITS = (0.10, 0.25), (0.15, 0.35)
MODEL_LIMITS = (0.15, 0.30, 0.50)
PROPORTION_FLOOR = 1e-7


def _side(name: str) -> Column:
    return (F.col("side") == name).cast("int")


def reference_stats(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    ref, cur = (F.when(F.col("side") == s, F.col(value)) for s in ("ref", "cur"))
    return long.groupBy(*groups).agg(
        F.min(ref).alias("ref_min"), F.max(ref).alias("ref_max"),
        F.avg(ref).alias("ref_mean"), F.avg(cur).alias("cur_mean"),
        F.stddev_pop(ref).alias("ref_std"), F.stddev_pop(cur).alias("cur_std"),
        F.count(ref).alias("n_ref"), F.count(cur).alias("n_cur"),
    )


def psi(long: DataFrame, groups: Sequence[str], value: str = "value", bins: int = 10) -> DataFrame:
    """Population stability index over equal bins of the reference range."""
    bounds = long.where("side = 'ref'").groupBy(*groups).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_hi") == F.col("_lo")
    bounds = bounds.withColumns({
        "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    binned = lookup_join(long.where(F.col(value).isNotNull()), bounds, groups, "inner").groupBy(
        *groups, F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.sum(_side("ref")).alias("r"), F.sum(_side("cur")).alias("c"))
    per_bin = binned.groupBy(*groups).agg(
        F.collect_list(F.struct("bin", "r", "c")).alias("b"),
        F.sum("r").alias("tr"), F.sum("c").alias("tc"))

    def share(n: Column, total: Column) -> Column:
        p = n / (total + PROPORTION_FLOOR)
        return F.when(p == 0, PROPORTION_FLOOR).otherwise(p)

    def term(b: Column) -> Column:
        r, c = share(b["r"], F.col("tr")), share(b["c"], F.col("tc"))
        return (c - r) * F.log(c / r)

    # bins empty on both sides contribute nothing
    ordered = F.array_sort("b")
    return per_bin.select(*groups, F.aggregate(ordered, F.lit(0.0), lambda a, b: a + term(b)).alias("psi"))


def side_counts(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Rows of either side per (group, value): all that the distances and the report read."""
    return value_counts(long, groups, value, {"n_ref": _side("ref"), "n_cur": _side("cur")})


def cdf_distances(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Raw Wasserstein distance and KS statistic per group from ordered value counts."""
    return count_distances(side_counts(long, groups, value), groups, value)


def count_distances(counts: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    acc = running_sums(counts, groups, value, {"c_ref": "n_ref", "c_cur": "n_cur"}, next_as="_next")
    totals = counts.groupBy(*groups).agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"), F.count(F.lit(1)).alias("_rows"))
    acc = attach(acc, totals, groups, rows="_rows")
    none = F.lit(0.0)
    gap = F.abs(F.col("c_ref") / F.nullif(F.col("t_ref"), none) - F.col("c_cur") / F.nullif(F.col("t_cur"), none))
    return acc.groupBy(*groups).agg(
        F.sum(gap * F.coalesce(F.col("_next") - F.col(value), F.lit(0.0))).alias("distance"),
        F.max(gap).alias("ks"), F.max("t_ref").alias("n_ref"), F.max("t_cur").alias("n_cur"))


def calendar_ks(reference: DataFrame, current: DataFrame, groups: Sequence[str], season: str, slot: str,
                value: str = "value") -> DataFrame:
    """KS statistic of every calendar slot against the reference of its season (hour of day).

    ``reference`` has (groups, season, value), ``current`` (groups, season, slot,
    value).  Between two values of a slot its own distribution stands still and the
    reference only rises, so the largest gap lies at one of the slot's values, before
    or after its step.  The reference is counted and summed once per season; each
    slot looks up its values there instead of being sorted with a copy of it.
    """
    keys = [*groups, season]
    ref = value_counts(reference, keys, value, {"n_ref": F.lit(1), "n_slot": F.lit(0)})
    own = value_counts(current, [*keys, slot], value)
    marks = own.select(*keys, value, F.lit(0).cast("long").alias("n_ref"), F.lit(1).cast("long").alias("n_slot"))
    both = ref.unionByName(marks).groupBy(*keys, value).agg(F.sum("n_ref").alias("n_ref"), F.max("n_slot").alias("n_slot"))
    placed = running_sums(both, keys, value, {"c_ref": "n_ref"}).where("n_slot > 0").select(
        *keys, value, "c_ref", (F.col("c_ref") - F.col("n_ref")).alias("b_ref"))
    totals = ref.groupBy(*keys).agg(F.sum("n_ref").alias("n_ref"))
    steps = running_sums(own, [*keys, slot], value, {"c_cur": "n"}).join(placed, [*keys, value])
    sizes = own.groupBy(*keys, slot).agg(F.sum("n").alias("n_cur"), F.count(F.lit(1)).alias("_rows"))
    steps = attach(steps, sizes, [*keys, slot], rows="_rows").join(totals, keys)
    gap = lambda c, r: F.abs(c / F.col("n_cur") - r / F.col("n_ref"))
    return steps.groupBy(*keys, slot).agg(
        F.max(F.greatest(gap(F.col("c_cur"), F.col("c_ref")), gap(F.col("c_cur") - F.col("n"), F.col("b_ref")))).alias("ks"),
        F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sample p-value."""
    lam2 = d * d * n * m / (n + m)
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (1 if k % 2 else -1) * F.exp(-2.0 * k * k * lam2)
    return F.least(F.greatest(2.0 * total, F.lit(0.0)), F.lit(1.0))


def min_max_distance(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Wasserstein on the reference 0-1 scale; a constant reference scores 0."""
    d = cdf_distances(long, groups, value).join(
        reference_stats(long, groups, value).drop("n_ref", "n_cur"), list(groups))
    span = F.col("ref_max") - F.col("ref_min")
    return d.withColumn("score", F.when(span < 1e-9, 0.0).otherwise(F.col("distance") / F.when(span >= 1e-9, span)))


def robust_distance(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Wasserstein on the reference p5-p95 scale with the data-quality routing flag."""
    ref_q = exact_quantiles(long.where("side = 'ref'"), groups, value, {"p05": 0.05, "p95": 0.95})
    cur_q = exact_quantiles(long.where("side = 'cur'"), groups, value, {"cur_p99": 0.99})
    base = min_max_distance(long, groups, value).join(ref_q, list(groups)).join(cur_q, list(groups))
    span = F.col("p95") - F.col("p05")
    robust = F.when(span < 1e-9, 0.0).otherwise(F.col("distance") / F.when(span >= 1e-9, span))
    bad = (F.col("cur_p99") > F.col("ref_max") * 1.5) | (F.col("score") > 2 * MODEL_LIMITS[2])
    return base.select(*groups, robust.alias("robust_score"), "score", bad.cast("int").alias("data_quality_alert"))


def status(score: Column, limits: Sequence[float]) -> Column:
    return F.when(score < limits[0], "OK").when(score < limits[1], "YELLOW").otherwise("RED")


def feature_report(long: DataFrame, feature: str = "feature", minimum: int = 50) -> DataFrame:
    """PSI and standardised Wasserstein with statuses; ``retrain`` if any feature is red."""
    return count_report(side_counts(long, [feature]), feature, minimum)


def count_report(counts: DataFrame, feature: str = "feature", minimum: int = 50, bins: int = 10) -> DataFrame:
    """The report from (feature, value, n_ref, n_cur), one row per distinct value.

    Bounds, moments, bins and distances all read the counts, whose shuffle they
    share; bounds are a row per feature and join where adaptive execution finds them
    small enough to broadcast.
    """
    groups, v = [feature], F.col("value")
    mean = lambda n: F.sum(v * F.col(n)) / F.nullif(F.sum(n), F.lit(0))
    have = lambda n: F.when(F.col(n) > 0, v)
    bounds = counts.groupBy(feature).agg(
        F.min(have("n_ref")).alias("ref_min"), F.max(have("n_ref")).alias("ref_max"), mean("n_ref").alias("ref_mean"),
        mean("n_cur").alias("cur_mean"), F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    flat = F.col("ref_max") == F.col("ref_min")
    low = F.when(flat, F.col("ref_min") - 0.5).otherwise(F.col("ref_min"))
    high = F.when(flat, F.col("ref_max") + 0.5).otherwise(F.col("ref_max"))
    at = F.least(F.greatest(F.floor((v - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    own = counts.select(feature, "value", F.col("n_ref").alias("r"), F.col("n_cur").alias("c")).join(bounds, groups)
    square = lambda n, m: F.sum(F.col(n) * (v - F.col(m)) * (v - F.col(m)))
    per_bin = own.groupBy(feature, at.alias("bin")).agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"), square("r", "ref_mean").alias("sr"), square("c", "cur_mean").alias("sc"))
    share = lambda n, total: F.greatest(n / (total + PROPORTION_FLOOR), F.lit(PROPORTION_FLOOR))
    per = per_bin.groupBy(feature).agg(
        F.array_sort(F.collect_list(F.struct("bin", "r", "c"))).alias("b"), F.sum("r").alias("tr"), F.sum("c").alias("tc"),
        F.sqrt(F.sum("sr") / F.nullif(F.sum("r"), F.lit(0))).alias("ref_std"), F.sqrt(F.sum("sc") / F.nullif(F.sum("c"), F.lit(0))).alias("cur_std"))
    term = lambda p, q: (q - p) * F.log(q / p)
    index = F.aggregate("b", F.lit(0.0), lambda x, b: x + term(share(b["r"], F.col("tr")), share(b["c"], F.col("tc"))))
    moments = per.select(feature, index.alias("psi"), "ref_std", "cur_std")
    distances = count_distances(counts, groups).select(feature, "distance")
    out = bounds.join(moments, groups).join(distances, groups).where(F.col("n_cur") >= minimum)
    out = out.withColumn("wasserstein", F.col("distance") / F.greatest("ref_std", F.lit(1e-6)))
    out = out.withColumns({
        "psi_status": status(F.col("psi"), PSI_LIMITS),
        "wass_status": status(F.col("wasserstein"), WASSERSTEIN_LIMITS)})
    red = ((F.col("psi_status") == "RED") | (F.col("wass_status") == "RED")).cast("int")
    return out.withColumn("retrain", F.max(red).over(Window.partitionBy(F.lit(1)))).drop("distance")


def model_report(long: DataFrame, feature: str = "feature", min_ref: int = 30, min_cur: int = 10) -> DataFrame:
    """One row: mean of the per-feature scores, status and the drifted features."""
    d = min_max_distance(long, [feature]).where(
        (F.col("n_ref") >= min_ref) & (F.col("n_cur") >= min_cur)
    ).withColumn("score", F.round("score", 4))
    overall = F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4)
    out = d.agg(
        overall.alias("overall"), F.count(F.lit(1)).alias("n_features"),
        F.array_sort(F.collect_list(F.when(F.col("score") >= MODEL_LIMITS[1], F.col(feature)))).alias("drifted"))
    o = F.col("overall")
    label = (
        F.when(F.col("n_features") == 0, "insufficient_data").when(o >= MODEL_LIMITS[2], "critical")
        .when(o >= MODEL_LIMITS[1], "alert").when(o >= MODEL_LIMITS[0], "warn").otherwise("ok"))
    return out.withColumn("status", label).withColumn(
        "retrain", F.col("status").isin("alert", "critical").cast("int"))


# Retraining limits and the age of a model in days.
MIN_AUC, MIN_F1, MIN_LABELS, MAX_AGE_DAYS = 0.72, 0.60, 50, 30


def retraining_decision(drift: DataFrame, performance: DataFrame, age_days: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Most urgent trigger per model; drift before performance before age on ties.

    ``drift`` has status and overall; ``performance`` has labelled, roc_auc and f1.
    """
    joined = drift.join(performance, list(keys), "full") if keys else drift.join(
        performance, F.lit(True), "full")
    weak = (F.col("labelled") >= MIN_LABELS) & ((F.col("roc_auc") < MIN_AUC) | (F.col("f1") < MIN_F1))

    def trigger(when: Column, kind: str, rank: int | Column, order: int) -> Column:
        urgency = rank if isinstance(rank, Column) else F.lit(rank)
        return F.when(when, F.struct(urgency.alias("rank"), F.lit(-order).alias("order"), F.lit(kind).alias("kind")))

    critical = F.when(F.col("status") == "critical", 3).otherwise(2)
    best = F.greatest(
        trigger(F.col("status").isin("alert", "critical"), "drift", critical, 0),
        trigger(F.col("status") == "warn", "drift_warn", 1, 1),
        trigger(weak, "performance", 3, 2),
        trigger(age_days > MAX_AGE_DAYS, "scheduled", 2, 3),
    )
    rank = F.coalesce(F.col("best.rank"), F.lit(0))
    urgency = F.when(rank == 3, "immediate").when(rank == 2, "next_cycle").otherwise("low")
    return joined.withColumn("best", best).select(
        *keys, (rank >= 2).cast("int").alias("retrain"),
        F.coalesce("best.kind", F.lit("none")).alias("trigger"), urgency.alias("urgency"),
        F.when(F.col("best.kind") == "drift", max(14, MAX_AGE_DAYS // 2)).otherwise(MAX_AGE_DAYS).alias("window_days"),
        F.when(rank >= 2, "inactive").otherwise("unchanged").alias("loop_state"))

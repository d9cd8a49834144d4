"""Grouped KPI summaries, profiles, error tables, cost and privacy aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from math import floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ropeway.operators.evaluate import areas, confusion, correlation, safe, score_counts
from ropeway.plans.prefix import column_quantiles, exact_quantiles, running_sums
from ropeway.plans.skew import group_join

PROFILE_PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
# Unit cost per inference tier in USD; the token tier is per 1,000 tokens.
TIER_COST = {"cpu_tabular": 0.000001, "gpu_gnn": 0.00005, "llm_rag": 0.0008, "agent": 0.02, "edge_onnx": 0.0000005}
TOKEN_TIER, GPU_TIERS = "llm_rag", ("gpu_gnn", "llm_rag")


def tumbling(df: DataFrame, keys: Sequence[str], time: str, kpi: str, critical: Column, success: Column,
             width: str, streaming: bool = False) -> DataFrame:
    """Mean, p95, success rate and critical count per window; a stream uses the sketch p95."""
    window = F.window(time, width)
    aggs = [F.avg(kpi).alias("mean"), F.avg(success.cast("int")).alias("success_rate"),
            F.count_if(critical).alias("critical"), F.count(F.lit(1)).alias("n")]
    if streaming or df.isStreaming:
        out = df.groupBy(window.alias("w"), *keys).agg(*aggs, F.percentile_approx(kpi, 0.95, 10000).alias("p95"))
        return out.select(F.col("w.start").alias("window_start"), *keys, "mean", "p95", "success_rate", "critical", "n")
    placed = df.withColumn("window_start", window["start"])
    base = placed.groupBy("window_start", *keys).agg(*aggs)
    p95 = exact_quantiles(placed, ["window_start", *keys], kpi, {"p95": 0.95})
    return group_join(base, p95, ["window_start", *keys], "left")


def diurnal_profile(df: DataFrame, entity: str, time: str, kpi: str) -> DataFrame:
    """Median and deviation per entity and hour; empty hours take the entity's typical hour."""
    hourly = df.withColumn("hour", F.hour(time))
    med = exact_quantiles(hourly, [entity, "hour"], kpi, {"median": 0.5})
    std = hourly.groupBy(entity, "hour").agg(F.coalesce(F.stddev_samp(kpi), F.lit(0.0)).alias("std"))
    seen = group_join(std, med, [entity, "hour"])
    # at most 24 rows per entity from here on
    spine = seen.select(entity).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    typical = seen.groupBy(entity).agg(F.median("median").alias("_m"), F.median("std").alias("_s"))
    filled = group_join(group_join(spine, seen, [entity, "hour"], "left"), typical, [entity])
    return filled.select(
        entity, "hour", F.coalesce("median", "_m").alias("median"), F.coalesce("std", "_s").alias("std"))


def feature_profile(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Moments, percentiles and missing share per feature; one aggregate row of all columns, no copies of values."""
    v = {f: F.col(f).cast("double") for f in features}
    rows = [F.struct(
        F.lit(f).alias("feature"), F.avg(v[f]).alias("mean"), F.stddev_samp(v[f]).alias("std"), F.min(v[f]).alias("min"),
        F.max(v[f]).alias("max"), (100.0 * F.avg(v[f].isNull().cast("int"))).alias("missing_pct")) for f in features]
    base = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return base.join(column_quantiles(df, v, PROFILE_PROBS), "feature")


def pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) over the rows where both columns have a value, for all pairs of column numbers.

    Columns are shifted by their means, so that squares keep their digits.  A task
    adds up its rows as matrix products; what it emits is a row per pair, and those
    are summed with partial aggregation.  The plan does not grow with the pairs.
    """
    names = list(columns)
    shift = np.array([x if x is not None else 0.0 for x in df.agg(*[F.avg(F.col(c).cast("double")) for c in names]).first()])
    frame = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, len(names), len(names)))
        for part in frames:
            x = part.to_numpy(float) - shift
            have = ~np.isnan(x)
            x = np.where(have, x, 0.0)
            has = have.astype(float)
            total += [has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x]
        a, b = (i.ravel() for i in np.indices((len(names), len(names))))
        n, s, ss, both = (t.ravel() for t in total)
        _, s_other, ss_other, _ = (t.T.ravel() for t in total)
        yield pd.DataFrame({"a": a, "b": b, "n": n, "sa": s, "sb": s_other, "saa": ss, "sbb": ss_other, "sab": both})

    sums = frame.mapInPandas(add, "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double")
    return sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def feature_diagnostics(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.95) -> DataFrame:
    """Variance, target correlation and partners with |r| above the limit, from one pass of pair sums."""
    names = [*features, target]
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    va, vb = (F.greatest(F.col(q) - s * s / n, F.lit(0.0)) for q, s in (("saa", sa), ("sbb", sb)))
    # what rounding leaves of a constant column's squares is no spread
    spread = lambda v, q: F.when(v > 1e-12 * F.col(q), v)
    r = (F.col("sab") - sa * sb / n) / F.sqrt(spread(va, "saa") * spread(vb, "sbb"))
    pairs = pair_sums(df, names).where("n > 0").select("a", "b", (va / F.nullif(n - 1, F.lit(0.0))).alias("variance"), r.alias("r"))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("b") + 1)
    is_partner = (F.col("b") != F.col("a")) & (F.col("b") < len(features)) & (F.abs("r") > limit)
    out = pairs.where(F.col("a") < len(features)).groupBy("a").agg(
        F.max(F.when(F.col("a") == F.col("b"), F.col("variance"))).alias("variance"),
        F.max(F.when(F.col("b") == len(features), F.col("r"))).alias("target_corr"),
        F.array_sort(F.collect_list(F.when(is_partner, F.struct("b", name.alias("name"))))).alias("p"))
    return out.select(
        F.element_at(F.array(*map(F.lit, features)), F.col("a") + 1).alias("feature"), "variance", "target_corr",
        (F.col("variance") < 1e-6).cast("int").alias("low_variance"), F.concat_ws(",", F.col("p")["name"]).alias("collinear"))


def caller_statistics(calls: DataFrame) -> DataFrame:
    """Contacts, calls, message share and first activity per caller."""
    voice, sms = F.col("type") == "voice", F.col("type") == "sms"
    return calls.groupBy("caller").agg(
        F.countDistinct("callee").alias("contacts"), F.count(F.lit(1)).alias("calls"),
        F.count_if(sms).alias("sms"), F.avg(F.when(voice, F.col("duration"))).alias("mean_voice"),
        F.avg(sms.cast("int")).alias("sms_ratio"), F.min("ts").alias("first_seen"))


def false_alarm_grid(df: DataFrame, row: str, hour: Column, predicted: Column, label: str) -> DataFrame:
    """False-alarm rate per row class with one column per hour of day."""
    negatives = df.where(F.col(label) == 0)
    return (
        negatives.withColumn("_h", hour).groupBy(row).pivot("_h", list(range(24)))
        .agg(F.avg(predicted.cast("int")))
    )


def entity_errors(df: DataFrame, entity: str, score: str, label: str, threshold: float) -> DataFrame:
    """Error counts, rates and ROC-AUC per entity with alert flags."""
    base = confusion(df, [entity], F.col(score) >= threshold, label)
    mean = df.groupBy(entity).agg(F.avg(score).alias("mean_score"))
    auc = areas(score_counts(df, [entity], score, label), [entity], score).select(entity, "roc_auc")
    far, miss = safe(F.col("fp"), F.col("fp") + F.col("tn")), safe(F.col("fn"), F.col("fn") + F.col("tp"))
    return group_join(group_join(base, mean, [entity]), auc, [entity], "left").withColumns({
        "false_alarm_rate": far, "miss_rate": miss,
        "high_far": (far > 0.10).cast("int"), "high_miss": (miss > 0.30).cast("int")})


def entity_ranking(df: DataFrame, entity: str, score: str, label: str, minimum: int = 2) -> DataFrame:
    """Average precision and ROC-AUC of entities with enough positives, best first."""
    out = areas(score_counts(df, [entity], score, label), [entity], score)
    return out.where(F.col("n_pos") >= minimum).orderBy(F.col("pr_auc").desc(), entity)


def detection_rate(df: DataFrame, kind: str, predicted: Column) -> DataFrame:
    return df.groupBy(kind).agg(F.avg(predicted.cast("int")).alias("rate"), F.count(F.lit(1)).alias("n"))


def by_outcome(df: DataFrame, predicted: Column, label: str, kpi: str) -> DataFrame:
    """KPI quartiles per TP / FP / TN / FN."""
    y = F.col(label) == 1
    kind = (F.when(predicted & y, "TP").when(predicted, "FP").when(y, "FN").otherwise("TN"))
    return exact_quantiles(df.withColumn("outcome", kind), ["outcome"], kpi,
                           {"q1": 0.25, "q2": 0.5, "q3": 0.75}, count_as="n")


def serving_metrics(df: DataFrame, keys: Sequence[str], latency: str, score: str, error: Column, fallback: Column) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(error).alias("errors"),
        F.count_if(fallback).alias("fallbacks"), F.avg(score).alias("mean_score"))
    return group_join(base, exact_quantiles(df, keys, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), keys)


def inference_cost(df: DataFrame, tier: str, samples: str, tokens: str, wall_ms: str) -> DataFrame:
    """Cost columns per record; only the token tier is priced per token."""
    rate = F.coalesce(F.element_at(F.create_map(*[x for k, v in TIER_COST.items() for x in (F.lit(k), F.lit(v))]),
                                   F.col(tier)), F.lit(0.0))
    cost = F.when(F.col(tier) == TOKEN_TIER, F.col(tokens) / 1000.0).otherwise(F.col(samples)) * rate
    seconds = F.col(wall_ms) / 1000.0
    return df.withColumns({
        "cost": cost, "cost_per_sample": cost / F.greatest(F.col(samples), F.lit(1)), "cpu_seconds": seconds,
        "gpu_seconds": F.when(F.col(tier).isin(*GPU_TIERS), seconds).otherwise(0.0)})


def cumulative_cost(costed: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str]) -> DataFrame:
    """Cost of each key's records up to and including the row."""
    return running_sums(costed, keys, order, {"cumulative_cost": "cost"}, ties=ties)


def cost_summary(costed: DataFrame, tier: str) -> DataFrame:
    return costed.rollup(tier).agg(
        F.sum("cost").alias("cost"), F.sum("gpu_seconds").alias("gpu_seconds"),
        F.sum("cpu_seconds").alias("cpu_seconds"), F.count(F.lit(1)).alias("records")
    ).withColumn(tier, F.coalesce(tier, F.lit("total")))


def alert_rollup(df: DataFrame, levels: Sequence[str], severity_rank: str) -> DataFrame:
    """Worst severity and count for every level of the hierarchy."""
    return df.rollup(*levels).agg(
        F.max(severity_rank).alias("worst"), F.count(F.lit(1)).alias("n"),
        F.grouping_id().cast("int").alias("level"))


def k_anonymous(df: DataFrame, keys: Sequence[str], subject: str, aggs: dict[str, Column], k: int = 10) -> DataFrame:
    """Aggregates of groups below k distinct subjects become NULL; k stays with the view."""
    out = df.groupBy(*keys).agg(F.countDistinct(subject).alias("subjects"), *[a.alias(n) for n, a in aggs.items()])
    shown = F.col("subjects") >= k
    return out.select(*keys, F.when(shown, F.col("subjects")).alias("subjects"),
                      *[F.when(shown, F.col(n)).alias(n) for n in aggs], F.lit(k).alias("k"))


def laplace_noise(df: DataFrame, key: str, value: str, epsilon: float, sensitivity: float, secrets: DataFrame) -> DataFrame:
    """Noise from a keyed hash, so a retried task publishes the same number.

    ``secrets`` is a protected one-row table (secret); read as a scalar, never a plan literal.
    """
    digest = F.sha2(F.concat_ws("|", secrets.select("secret").scalar(), F.col(key).cast("string")), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13) - 0.5
    noise = -F.signum(u) * (sensitivity / epsilon) * F.log(1 - 2 * F.abs(u))
    return df.withColumn("noisy", F.col(value) + noise).withColumn("epsilon", F.lit(float(epsilon)))


def budget_ledger(spends: DataFrame, view: str, quarter: Column, epsilon: str, limit: float) -> DataFrame:
    out = spends.groupBy(view, quarter.alias("quarter")).agg(F.sum(epsilon).alias("spent"))
    return out.withColumn("exhausted", (F.col("spent") > limit).cast("int"))


class RunningQuantile:
    """Interpolated quantile of the values so far: the lower ones in a max-heap, the upper ones in a min-heap."""

    def __init__(self, p: float):
        self.p, self.low, self.high = p, [], []

    def value(self) -> float | None:
        n = len(self.low) + len(self.high)
        if not n:
            return None
        at = (n - 1) * self.p
        low = floor(at)
        if at == low:
            return -self.low[0]
        return (low + 1 - at) * -self.low[0] + (at - low) * self.high[0]

    def add(self, x: float) -> None:
        if self.low and x < -self.low[0]:
            heappush(self.low, -x)
        else:
            heappush(self.high, x)
        size = floor((len(self.low) + len(self.high) - 1) * self.p) + 1
        while len(self.low) < size:
            heappush(self.low, -heappop(self.high))
        while len(self.low) > size:
            heappush(self.high, -heappop(self.low))


def earlier_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Quantile of a double column over the rows of the key before each row, NULL for the first.

    Rows must come with a key's rows together and in order; NULL values are left out.
    One pass with two heaps, instead of a sort for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, RunningQuantile(p)
        for batch in batches:
            out = []
            for *key, x in zip(*(batch[c].to_pylist() for c in (*keys, value)), strict=True):
                if key != current:
                    current, seen = key, RunningQuantile(p)
                out.append(seen.value())
                if x is not None:
                    seen.add(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def run_health(runs: DataFrame, keys: Sequence[str], time: str, failed: str, duration: str) -> DataFrame:
    """Failure, third failure in a row, and runs beyond twice the earlier p95 (one row per run and period).

    One shuffle and one sort serve the streak and the running quantile; the durations
    of one key are held by one task.
    """
    placed = runs.withColumn("_took", F.col(duration).cast("double")).repartition(*keys).sortWithinPartitions(*keys, time)
    streak = F.sum(failed).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(-2, 0)) == 3
    usual = earlier_quantile(placed.withColumn("_streak", streak.cast("int")), keys, "_took", 0.95, "_usual")
    return usual.withColumns({
        "alert_failed": F.col(failed), "alert_streak": F.col("_streak"),
        "alert_slow": F.coalesce((F.col("_took") > 2 * F.col("_usual")).cast("int"), F.lit(0))}).drop("_took", "_streak", "_usual")


def node_features(cells: DataFrame, parent: str, attributes: dict[str, object]) -> DataFrame:
    """Cells per parent node with defaulted attributes."""
    return cells.groupBy(parent).agg(
        F.count(F.lit(1)).alias("cells"),
        *[F.coalesce(F.max(a), F.lit(d)).alias(a) for a, d in attributes.items()])


def fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Order-independent lineage hash: an XOR, which pairs of equal rows cancel, and a sum modulo 2^32, which they do not."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    digest = F.sha2(text, 256)
    part = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long")
    total = F.sum(part(16, 8).cast("decimal(38,0)")) % F.lit(2**32)
    return df.agg(F.bit_xor(part(1, 15)).alias("hash"), total.cast("long").alias("total"), F.count(F.lit(1)).alias("rows"))


def metric_summary(metrics: DataFrame, gates: Sequence[tuple[str, float]]) -> DataFrame:
    """Metrics, gate booleans and a one-line narrative as JSON."""
    checks = [(F.col(m) >= limit).alias(f"{m}_met") for m, limit in gates]
    every = F.lit(True)
    for m, limit in gates:
        every = every & (F.col(m) >= limit)
    text = F.format_string("precision %.3f, recall %.3f, gate %s", "precision", "recall",
                           F.when(every, "passed").otherwise("failed"))
    return metrics.select(
        F.to_json(F.struct(*[F.round(c, 6).alias(c) for c in metrics.columns], *checks)).alias("summary"),
        every.cast("int").alias("overall_pass"), text.alias("narrative"))

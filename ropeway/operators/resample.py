"""Bootstrap replicates as wide running states: all weights of a value are drawn at once, in the task that holds it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.prefix import BUCKET, cut_points, with_bucket
from ropeway.session import durable

#: Uniforms are whole numbers below this prime.
PRIME = (1 << 31) - 1
#: Values whose weights one task draws, and values held by it at once.
DRAWN_VALUES, CHUNK = 2_500, 64
#: Thresholds up to which a draw is compared with each of them.
COMPARED = 64


def coefficients(replicates: int, seed: int) -> np.ndarray:
    """Four coefficients of each replicate: the digits of a SHA-256 of seed and number (from 1)."""
    digests = [hashlib.sha256(f"{seed}:{r}".encode()).hexdigest() for r in range(1, replicates + 1)]
    return np.array([[int(d[k : k + 8], 16) % PRIME for d in digests] for k in range(0, 32, 8)], np.uint64)


def uniforms(keys: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    """Keys by replicates: a cubic polynomial of the key modulo PRIME, so any four keys are independent."""
    k, mask, shift = keys.astype(np.uint64)[:, None], np.uint64(PRIME), np.uint64(31)
    x, over = np.empty((2, len(keys), coefs.shape[1]), np.uint64)
    x[:] = coefs[0]
    for c in coefs[1:]:
        x *= k
        x += c
        for _ in range(2):
            np.right_shift(x, shift, out=over)
            x &= mask
            x += over
    x[x >= mask] -= mask
    return x.view(np.int64)


@lru_cache(maxsize=4096)
def poisson_bounds(n: int) -> tuple[int, np.ndarray]:
    """Inverse of the Poisson(n) distribution: least weight, and the uniforms from which on it is one more each."""
    low = max(0, math.floor(n - 12 * math.sqrt(n))) if n > 30 else 0
    k = np.arange(low + 1, n + 12 * math.isqrt(n) + 40)
    steps = np.append(low * math.log(n) - n - math.lgamma(low + 1), math.log(n) - np.log(k))
    bounds = np.floor(np.cumsum(np.exp(np.cumsum(steps))) * PRIME)
    return low, bounds[bounds < PRIME].astype(np.int64)


def weights(keys: np.ndarray, sizes: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    """Poisson(size) weights, keys by replicates: the sum of ``size`` Poisson(1) row weights, inverted at once."""
    out = np.zeros((len(keys), coefs.shape[1]), np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        drawn, (low, bounds) = uniforms(keys[rows], coefs), poisson_bounds(size)
        if len(bounds) <= COMPARED:
            drawn, more, reached = drawn.astype(np.uint32), np.zeros(drawn.shape, np.uint8), np.empty(drawn.shape, bool)
            for b in bounds.astype(np.uint32):
                np.greater_equal(drawn, b, out=reached)
                more += reached.view(np.uint8)
        else:
            more = np.searchsorted(bounds, drawn, "right")
        out[rows] = low + more.astype(np.int64)
    return out


def hashed_key(tag: str, value: Column) -> Column:
    """A key below PRIME from a hash of the value."""
    return F.pmod(F.xxhash64(F.lit(tag), value), F.lit(PRIME))


def _chunks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for begin in range(0, len(frame), CHUNK):
        yield frame.iloc[begin : begin + CHUNK]


def bootstrap_metrics(counts: DataFrame, score: str, replicates: int = 1000, level: float = 0.95, seed: int = 42,
                      threshold: float = 0.5, key: Callable[[str, Column], Column] = hashed_key) -> DataFrame:
    """Percentile intervals of areas and threshold metrics from Poisson-weighted score counts.

    ``counts`` is one row per distinct score (score, n_pos, n_neg), in no need of
    rounding.  Scores are cut into buckets; a task draws the weights of its scores in
    all replicates and adds them up.  The totals of higher buckets are the start of
    each bucket's second pass, which draws the same weights again and runs along the
    curve with one state per replicate.  Only (bucket, replicate) rows are shuffled.
    A replicate without rows of one class is left out.  ``key`` names a number below
    PRIME for a class and score; equal keys share their draws.
    """
    keyed = counts.select(F.col(score).cast("double").alias("s"), "n_pos", "n_neg",
                          key("pos", F.col(score)).alias("k_pos"), key("neg", F.col(score)).alias("k_neg"))
    cuts = cut_points(keyed, "s", limit=DRAWN_VALUES)
    buckets = with_bucket(keyed, "s", cuts) if cuts else keyed.withColumn(BUCKET, F.lit(0))

    def drawn(part: pd.DataFrame, coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(weights(part[f"k_{c}"].to_numpy(), part[f"n_{c}"].to_numpy(), coefs) for c in ("pos", "neg"))

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        coefs = coefficients(replicates, seed)
        sums = np.zeros((4, replicates), np.int64)
        for part in _chunks(frame):
            pos, neg = drawn(part, coefs)
            above = part["s"].to_numpy() >= threshold
            sums += [pos.sum(0), neg.sum(0), pos[above].sum(0), neg[above].sum(0)]
        columns = dict(zip(("n_pos", "n_neg", "tp", "fp"), sums, strict=True))
        return pd.DataFrame({BUCKET: frame[BUCKET].iloc[0], "replicate": np.arange(replicates), **columns})

    totals = durable(buckets.groupBy(BUCKET).applyInPandas(
        total, f"{BUCKET} int, replicate int, n_pos long, n_neg long, tp long, fp long"))
    higher = Window.partitionBy("replicate").orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(higher), F.lit(0))
    starts = totals.select(BUCKET, F.struct("replicate", start("n_pos").alias("p"), start("n_neg").alias("n")).alias("x"))
    starts = starts.groupBy(BUCKET).agg(F.array_sort(F.collect_list("x")).alias("x"))
    starts = starts.select(BUCKET, F.col("x.p").alias("p"), F.col("x.n").alias("n"))

    def along(frame: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        coefs = coefficients(replicates, seed)
        tp, fp = start["p"].iloc[0].astype(np.int64), start["n"].iloc[0].astype(np.int64)
        roc, ap = np.zeros(replicates), np.zeros(replicates)
        for part in _chunks(frame.sort_values("s", ascending=False)):
            pos, neg = drawn(part, coefs)
            tps, fps = tp + pos.cumsum(0), fp + neg.cumsum(0)
            roc += (neg * (tps - pos / 2)).sum(0)
            ap += (pos * tps / np.maximum(tps + fps, 1)).sum(0)
            tp, fp = tps[-1], fps[-1]
        return pd.DataFrame({"replicate": np.arange(replicates), "roc": roc, "ap": ap})

    curve = buckets.groupBy(BUCKET).cogroup(starts.groupBy(BUCKET)).applyInPandas(along, "replicate int, roc double, ap double")
    sums = curve.groupBy("replicate").agg(F.sum("roc").alias("roc"), F.sum("ap").alias("ap"))
    whole = totals.groupBy("replicate").agg(*[F.sum(c).cast("double").alias(c) for c in ("n_pos", "n_neg", "tp", "fp")])
    per = whole.join(sums, "replicate").where("n_pos > 0 AND n_neg > 0")
    p, n, tp, fp = (F.col(c) for c in ("n_pos", "n_neg", "tp", "fp"))
    none = F.lit(0.0)
    per = per.select(
        (F.col("roc") / (p * n)).alias("roc_auc"), (F.col("ap") / p).alias("pr_auc"),
        (2 * tp / (p + tp + fp)).alias("f1"), F.coalesce(tp / F.nullif(tp + fp, none), none).alias("precision"), (tp / p).alias("recall"),
        F.coalesce((tp * (n - fp) - fp * (p - tp)) / F.nullif(F.sqrt((tp + fp) * p * n * (n - fp + p - tp)), none), none).alias("mcc"))
    return intervals(per, ["roc_auc", "pr_auc", "f1", "precision", "recall", "mcc"], level)


def intervals(per: DataFrame, metrics: list[str], level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of each metric over the replicates (one row each)."""
    tail = (1 - level) / 2
    return per.agg(*[
        c for m in metrics for c in (
            F.avg(m).alias(f"{m}_mean"), F.percentile(m, tail).alias(f"{m}_low"), F.percentile(m, 1 - tail).alias(f"{m}_high"))
    ], F.count(F.lit(1)).alias("replicates"))


def bootstrap_means(counts: DataFrame, value: str, replicates: int = 1000, seed: int = 42,
                    key: Callable[[str, Column], Column] = hashed_key) -> DataFrame:
    """(replicate, mean) of Poisson-weighted value counts (value, n): one pass, one row per task and replicate."""
    keyed = counts.select(F.col(value).cast("double").alias("v"), F.col("n").alias("n"), key("mean", F.col(value)).alias("k"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coefs = coefficients(replicates, seed)
        weight, total = np.zeros(replicates, np.int64), np.zeros(replicates)
        for frame in frames:
            for part in _chunks(frame):
                drawn = weights(part["k"].to_numpy(), part["n"].to_numpy(), coefs)
                weight += drawn.sum(0)
                total += part["v"].to_numpy() @ drawn
        yield pd.DataFrame({"replicate": np.arange(replicates), "w": weight, "t": total})

    sums = keyed.mapInPandas(add, "replicate int, w long, t double").groupBy("replicate").agg(F.sum("w").alias("w"), F.sum("t").alias("t"))
    return sums.where("w > 0").select("replicate", (F.col("t") / F.col("w")).alias("mean"))

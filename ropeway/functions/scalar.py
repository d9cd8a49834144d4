"""Scalar KPI expressions: ratios, indices, clean-up, severity, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards, caps and limits of the two counter dialects.
ATTEMPT_FLOOR = 1e-9
RATIO_EPS = 1e-6
SATURATION = 0.80
SEVERITY_RED, SEVERITY_YELLOW = 0.50, 0.30
ENSEMBLE_WEIGHTS = (0.20, 0.50, 0.30)
ROP_SECONDS = 900


def lit(value) -> Column:
    return F.lit(value)


def f32(col: Column) -> Column:
    """Single-precision rounding, the width features are stored with."""
    return col.cast("float").cast("double")


def finite(col: Column) -> Column:
    """NaN and both infinities become NULL."""
    bad = F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(~bad, col)


def clip(col: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL (least/greatest alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, lit(low)), lit(high)))


def ratio_or_null(num: Column, den: Column) -> Column:
    return num / F.nullif(den, lit(0.0))


def success_ratio(succ: Column, att: Column) -> Column:
    """0-1 ratio where an idle cell scores 0."""
    return clip(succ / F.greatest(att, lit(ATTEMPT_FLOOR)), 0.0, 1.0)


def success_percent(succ: Column, att: Column) -> Column:
    """0-100 rate where an idle cell scores 100."""
    return F.coalesce(clip(ratio_or_null(succ, att) * 100.0, 0.0, 100.0), lit(100.0))


def direction_ratio(dl: Column, ul: Column, idle_as_one: bool = True) -> Column:
    """DL/UL ratio: capped at 50 with idle = 1, or epsilon-guarded and capped at 100."""
    if idle_as_one:
        return F.coalesce(F.least(ratio_or_null(dl, ul), F.when(ul != 0, lit(50.0))), lit(1.0))
    return clip(dl / (ul + RATIO_EPS), 0.0, 100.0)


def guarded_ratio(num: Column, den: Column) -> Column:
    return F.when(den > RATIO_EPS, num / (den + RATIO_EPS))


def prb_efficiency(tput: Column, prb: Column) -> Column:
    return F.coalesce(F.least(ratio_or_null(tput, prb), F.when(prb != 0, lit(20.0))), lit(0.0))


def quality_index(cqi: Column, retx: Column) -> Column:
    return cqi * (1.0 - clip(retx, 0.0, 1.0))


def accessibility(*ratios: Column) -> Column:
    out = clip(ratios[0], 0.0, 1.0)
    for r in ratios[1:]:
        out = out * clip(r, 0.0, 1.0)
    return out


def load_index(dl: Column, ul: Column) -> Column:
    return F.sqrt(clip(dl, 0.0, 1.0) * clip(ul, 0.0, 1.0))


def saturation_flag(prb: Column) -> Column:
    return F.when(prb > SATURATION, 1).otherwise(0)


def signal_spread(rsrp: Column, rsrq: Column) -> Column:
    return rsrp - rsrq


def cqi_consistency(tput: Column, cqi: Column, p95: Column) -> Column:
    """Normalised throughput over normalised CQI; a non-positive p95 counts as 1."""
    scale = F.when(p95 <= 0, lit(1.0)).otherwise(p95)
    ratio = ratio_or_null(clip(tput / scale, 0.0, 1.0), cqi / 15.0)
    return F.coalesce(clip(ratio, 0.0, 2.0), lit(0.5))


def weighted_score(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean over the tiers that are present; NULL when none is."""
    total = lit(0.0)
    mass = lit(0.0)
    for s, w in zip(scores, weights):
        total = total + F.coalesce(s * w, lit(0.0))
        mass = mass + F.when(s.isNotNull(), lit(float(w))).otherwise(0.0)
    return total / F.nullif(mass, lit(0.0))


def severity(score: Column, red: float = SEVERITY_RED, yellow: float = SEVERITY_YELLOW) -> Column:
    return F.when(score >= red, "RED").when(score >= yellow, "YELLOW").otherwise("CLEAR")


def min_max(score: Column, low: Column, high: Column, flip_negative: bool = False) -> Column:
    """Scale to 0-1; a constant score gives 0, negative-scored detectors may be flipped."""
    flip = (low < 0) if flip_negative else lit(False)
    span = high - low
    scaled = (score - low) / F.when(span >= 1e-9, span)
    scaled = F.when(flip, (high - score) / F.when(span >= 1e-9, span)).otherwise(scaled)
    return F.when(score.isNotNull(), F.coalesce(scaled, lit(0.0)))


def fallback_rule(prb: Column, rrc: Column) -> Column:
    """Overload before setup failure before none; (label, confidence)."""
    def outcome(name: str, confidence: float) -> Column:
        return F.struct(lit(name).alias("label"), lit(confidence).alias("confidence"))

    return (
        F.when(prb > 0.95, outcome("overload", 0.85))
        .when(rrc < 0.85, outcome("failure", 0.90))
        .otherwise(outcome("none", 0.70))
    )


def violations(features: dict[str, Column]) -> Column:
    """Names of the features that are missing or not finite."""
    return F.array_compact(
        F.array(*[F.when(finite(c).isNull(), lit(name)) for name, c in features.items()])
    )


def published_score(score: Column) -> Column:
    """Score shown to consumers, one decimal, half-even."""
    return F.bround(score, 1)


def volume_to_mbps(kbits: Column) -> Column:
    return kbits / 1000.0 / float(ROP_SECONDS)


def online_features(raw: dict[str, Column]) -> dict[str, Column]:
    """The serving feature row; batch and stream use the same expressions."""
    def sr(succ: Column, att: Column) -> Column:
        return clip(succ / F.greatest(att, lit(1.0)), 0.0, 1.0)

    rates = [
        sr(raw["rrc_succ"], raw["rrc_att"]),
        sr(raw["erab_succ"], raw["erab_att"]),
        sr(raw["ho_succ"], raw["ho_att"]),
    ]
    dl_prb, ul_prb = clip(raw["dl_prb"], 0.0, 1.0), clip(raw["ul_prb"], 0.0, 1.0)
    tput = volume_to_mbps(raw["dl_kbits"])
    logs = [F.log(F.greatest(r, lit(1e-6))) for r in rates]
    return {
        "dl_prb_utilisation": dl_prb,
        "ul_prb_utilisation": ul_prb,
        "rrc_setup_success_rate": rates[0],
        "erab_setup_success_rate": rates[1],
        "ho_success_rate": rates[2],
        "dl_throughput_mbps": tput,
        "ul_throughput_mbps": volume_to_mbps(raw["ul_kbits"]),
        "active_ue_count": F.greatest(raw["active_ue"], lit(0.0)),
        "prb_imbalance": dl_prb - ul_prb,
        "dl_tput_per_ue": tput / F.greatest(raw["active_ue"], lit(1.0)),
        "quality_score": F.exp((logs[0] + logs[1] + logs[2]) / 3.0),
    }

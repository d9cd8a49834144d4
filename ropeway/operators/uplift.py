"""Effect of an intervention, profile validation and process rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ropeway.plans.prefix import exact_quantiles

# Feasibility limits of the evaluation branches.
MIN_DONORS, MAX_PRE_RMSE, PRE_WINDOW, MIN_PRE, MAX_ABSENT = 10, 0.08, 14, 7, 0.20


def counterfactual(series: DataFrame, unit: str, period: str, kpi: str, treated: str, start: int) -> DataFrame:
    """Uplift per treated unit by the strongest feasible method.

    ``series`` has one row per unit and integer period.  Donors are averaged per
    period once, so no treated-donor pair is formed.
    """
    t = F.col(period)
    donors = series.where(F.col(treated) == 0)
    donor_mean = donors.groupBy(period).agg(F.avg(kpi).alias("_d"))
    n_donors = donors.agg(F.countDistinct(unit)).scalar()
    first = series.agg(F.min(period)).scalar()
    rows = series.where(F.col(treated) == 1).join(donor_mean, period, "left")
    pre, post = t < start, t >= start
    gap = F.col(kpi) - F.col("_d")
    recent = pre & (t >= start - PRE_WINDOW)
    x = (t - start).cast("double")
    y = lambda cond: F.when(cond, F.col(kpi))
    out = rows.groupBy(unit).agg(
        F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"),
        F.sqrt(F.avg(F.when(recent, gap * gap))).alias("pre_rmse"),
        F.avg(F.when(post, gap)).alias("synthetic"),
        F.regr_slope(y(pre), F.when(pre, x)).alias("s0"), F.regr_intercept(y(pre), F.when(pre, x)).alias("i0"),
        F.regr_slope(y(post), F.when(post, x)).alias("s1"), F.regr_intercept(y(post), F.when(post, x)).alias("i1"))
    expected = (F.lit(start) - first).cast("double")
    absent = 1 - F.col("n_pre") / F.nullif(expected, F.lit(0.0))
    thin = (F.col("n_pre") < MIN_PRE) | (absent > MAX_ABSENT) | (F.col("n_post") == 0)
    method = (
        F.when(thin, "INSUFFICIENT_DATA")
        .when((n_donors >= MIN_DONORS) & (F.col("pre_rmse") <= MAX_PRE_RMSE), "SYNTHETIC_CONTROL").otherwise("ITS_ONLY"))
    its = method == "ITS_ONLY"
    return out.select(
        unit, method.alias("method"), F.col("pre_rmse"),
        F.when(method == "SYNTHETIC_CONTROL", F.col("synthetic")).alias("uplift"),
        F.when(its, F.col("i1") - F.col("i0")).alias("level_change"),
        F.when(its, F.col("s1") - F.col("s0")).alias("slope_change"))


def arm_difference(df: DataFrame, arm: str, kpi: str, treated: str, control: str) -> DataFrame:
    """Direct comparison when a randomised control exists."""
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(kpi)))
    return df.agg(mean(treated).alias("treated"), mean(control).alias("control"),
                  (mean(treated) - mean(control)).alias("uplift"))


def validate_profile(profile: DataFrame, holdout: DataFrame, entity: str, time: str, kpi: str) -> DataFrame:
    """Actual hourly median against the fitted profile and its 95 % band."""
    actual = exact_quantiles(holdout.withColumn("hour", F.hour(time)), [entity, "hour"], kpi, {"actual": 0.5})
    out = actual.join(profile, [entity, "hour"])
    band = 1.96 * F.col("std")
    inside = (F.col("std") <= 0) | (F.abs(F.col("actual") - F.col("median")) <= band)
    return out.withColumns({"error": F.col("actual") - F.col("median"), "within": inside.cast("int")})


def validation_summary(validated: DataFrame, entity: str) -> DataFrame:
    return validated.agg(
        F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("pairs"),
        F.avg("within").alias("coverage"), F.avg(F.abs("error")).alias("mae"))


def outcome_rates(df: DataFrame, rates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Share of ``hit`` among ``base`` for each named (hit, base)."""
    return df.agg(*[F.avg(F.when(base, hit.cast("int"))).alias(n) for n, (hit, base) in rates.items()])

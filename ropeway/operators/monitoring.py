"""Rates over calendar frames, freshness, burn rates and alert rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_rate(daily: DataFrame, keys: Sequence[str], day: str, part: str, whole: str, days: int) -> DataFrame:
    """Share over the last ``days`` calendar days of a daily series (one row per key and day)."""
    over = (
        Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    )
    return daily.withColumn("rate", F.sum(part).over(over) / F.sum(whole).over(over))


def quality_profile(df: DataFrame, keys: Sequence[str], time: str, kpi: str, low: float, high: float,
                    width: str = "10 minutes") -> DataFrame:
    """Nulls, out-of-range and zero readings per window; also runs on a stream."""
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(kpi).isNull()).alias("nulls"),
        F.count_if((F.col(kpi) < low) | (F.col(kpi) > high)).alias("out_of_range"),
        F.count_if(F.col(kpi) == 0).alias("zeros"))
    live = F.col("n") - F.col("nulls")
    all_zero = ((live > 0) & (F.col("zeros") == live)).cast("int")
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "nulls", "out_of_range",
                      "zeros", all_zero.alias("all_zero"))


def freshness(df: DataFrame, view: Sequence[str], time: str, now, interval_seconds: int) -> DataFrame:
    """Age of the last write per view at the given instant; stale beyond twice the interval."""
    out = df.groupBy(*view).agg(F.max(time).alias("last_write"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_write")
    return out.select(*view, age.alias("age_seconds"), (age > 2 * interval_seconds).cast("int").alias("stale"))


def burn_rate(df: DataFrame, keys: Sequence[str], time: str, bad: str, objective: float) -> DataFrame:
    """Error-budget burn over 1 h and 6 h at every minute with traffic.

    Rows collapse to one per key and minute before the range frames, so a busy
    service contributes at most its number of minutes.
    """
    minutes = df.groupBy(*keys, F.floor(F.unix_timestamp(time) / 60).cast("long").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"))
    budget = 1 - objective
    base = Window.partitionBy(*keys).orderBy("minute")

    def rate(width: int):
        over = base.rangeBetween(-(width - 1), 0)
        return F.sum("bad").over(over) / F.sum("n").over(over) / budget

    spent = F.sum("bad").over(base.rangeBetween(Window.unboundedPreceding, 0))
    seen = F.sum("n").over(base.rangeBetween(Window.unboundedPreceding, 0))
    out = minutes.withColumns({
        "burn_1h": rate(60), "burn_6h": rate(360), "budget_left": 1 - spent / seen / budget})
    level = F.when(F.col("burn_1h") > 14.4, "P1").when(F.col("burn_6h") > 6, "P2").otherwise("none")
    return out.withColumn("priority", level)


def persistent_breach(df: DataFrame, keys: Sequence[str], epoch: str, breached, width: int, periods: int) -> DataFrame:
    """1 when ``periods`` adjacent windows of ``width`` seconds all breach (one row per key and window)."""
    over = Window.partitionBy(*keys).orderBy(epoch).rangeBetween(-(periods - 1) * width, 0)
    hit = F.coalesce(breached, F.lit(False)).cast("int")
    return df.withColumn("firing", (F.sum(hit).over(over) >= periods).cast("int"))


def disagreement(df: DataFrame, keys: Sequence[str], a: str, b: str, normal, limit: float = 0.05) -> DataFrame:
    """Share of non-anomalous rows on which two models differ."""
    out = df.where(normal).groupBy(*keys).agg(F.avg((F.col(a) != F.col(b)).cast("int")).alias("rate"))
    return out.withColumn("alert", (F.col("rate") > limit).cast("int"))


def canary(df: DataFrame, arm: str, load: str, treated: str, control: str) -> DataFrame:
    """Roll back when the treated median load exceeds the control's by more than 10 %."""
    from ropeway.plans.prefix import exact_quantiles

    med = exact_quantiles(df, [arm], load, {"m": 0.5})
    out = med.agg(
        F.max(F.when(F.col(arm) == treated, F.col("m"))).alias("treated_median"),
        F.max(F.when(F.col(arm) == control, F.col("m"))).alias("control_median"))
    return out.withColumn("rollback", (F.col("treated_median") > 1.1 * F.col("control_median")).cast("int"))

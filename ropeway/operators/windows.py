"""Time-ordered features per entity: rolling statistics, lags, fills, resets, CUSUM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.functions.scalar import clip
from ropeway.plans.prefix import exact_quantiles, running_sums
from ropeway.plans.segments import last_known, windowed
from ropeway.spec import KpiSpec

# Reset guards and history conditions.
DELTA_RESET, COUNTER_RESET = 0.9, 0.5
LONG_LAG, LONG_HISTORY = 96, 200


def _order(spec: KpiSpec) -> list[str]:
    return [spec.time, *spec.ties]


def _frame(keys: Sequence[str], spec: KpiSpec, start: int, end: int):
    return Window.partitionBy(*keys).orderBy(*_order(spec)).rowsBetween(start, end)


Build = Callable[[DataFrame, list[str]], DataFrame]


def in_one_pass(df: DataFrame, spec: KpiSpec, steps: Sequence[tuple[int, Build]]) -> DataFrame:
    """Several bounded-frame steps (rows reached back, builder) over one partitioning."""

    def build(frame, keys):
        for _, step in steps:
            frame = step(frame, keys)
        return frame

    return windowed(df, spec.entity, spec.time, max(reach for reach, _ in steps), build, ties=spec.ties)


def rolling_statistics_step(spec: KpiSpec) -> tuple[int, Build]:
    """Mean, std, max and min of the previous w rows, half a window required."""

    def build(frame, keys):
        cols = []
        for label, w in spec.windows.items():
            over = _frame(keys, spec, -w, -1)
            for k in spec.kpis:
                enough = F.count(k).over(over) >= max(1, w // 2)
                cols += [
                    F.when(enough, F.avg(k).over(over)).alias(f"{k}_mean_{label}"),
                    F.coalesce(F.stddev_samp(k).over(over), F.lit(0.0)).alias(f"{k}_std_{label}"),
                    F.when(enough, F.max(k).over(over)).alias(f"{k}_max_{label}"),
                    F.when(enough, F.min(k).over(over)).alias(f"{k}_min_{label}"),
                ]
        return frame.select("*", *cols)

    return max(spec.windows.values()), build


def rolling_statistics(df: DataFrame, spec: KpiSpec) -> DataFrame:
    return in_one_pass(df, spec, [rolling_statistics_step(spec)])


def rolling_features(df: DataFrame, spec: KpiSpec) -> DataFrame:
    """Inventory dialect: explicit minimum counts, std below them 0, range added."""

    def build(frame, keys):
        cols = []
        for label, w in spec.windows.items():
            over = _frame(keys, spec, -w, -1)
            need = spec.min_periods.get(label, max(1, w // 2))
            for k in spec.kpis:
                enough = F.count(k).over(over) >= need
                low, high = F.min(k).over(over), F.max(k).over(over)
                cols += [
                    F.when(enough, F.avg(k).over(over)).alias(f"{k}_mean_{label}"),
                    F.coalesce(F.when(enough, F.stddev_samp(k).over(over)), F.lit(0.0)).alias(f"{k}_std_{label}"),
                    F.when(enough, low).alias(f"{k}_min_{label}"),
                    F.when(enough, high).alias(f"{k}_max_{label}"),
                    F.when(enough, F.greatest(high - low, F.lit(0.0))).alias(f"{k}_range_{label}"),
                ]
        return frame.select("*", *cols)

    return windowed(df, spec.entity, spec.time, max(spec.windows.values()), build, ties=spec.ties)


def lag_deltas_step(spec: KpiSpec, signal: Sequence[str] = ()) -> tuple[int, Build]:
    """Lag and delta; a counter reset voids the delta except on signal-strength KPIs."""

    def build(frame, keys):
        over = Window.partitionBy(*keys).orderBy(*_order(spec))
        cols = []
        for k in spec.kpis:
            for n in spec.lags:
                prev = F.lag(k, n).over(over)
                delta = F.col(k) - prev
                if k not in signal:
                    delta = F.when(
                        ~F.coalesce((delta < -DELTA_RESET * prev) & (prev > 0), F.lit(False)), delta
                    )
                cols += [prev.alias(f"{k}_lag_{n}"), delta.alias(f"{k}_delta_{n}")]
        return frame.select("*", *cols)

    return max(spec.lags), build


def lag_deltas(df: DataFrame, spec: KpiSpec, signal: Sequence[str] = ()) -> DataFrame:
    return in_one_pass(df, spec, [lag_deltas_step(spec, signal)])


def history_lags(df: DataFrame, spec: KpiSpec) -> list[int]:
    """The lags of ``spec``, and the day lag where most entities have history; one job, before the plan is made."""
    rows = df.groupBy(*spec.entity).agg(F.count(F.lit(1)).alias("n"))
    seen = rows.agg(
        F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= LONG_HISTORY).alias("long")
    ).first()
    return [*spec.lags, *([LONG_LAG] if seen["long"] > seen["all"] * 0.5 else [])]


def change_features(df: DataFrame, spec: KpiSpec, lags: Sequence[int] | None = None) -> DataFrame:
    """Delta, absolute change and direction at each lag: the columns follow from the arguments, not from the data."""
    lags = [*(spec.lags if lags is None else lags)]

    def build(frame, keys):
        over = Window.partitionBy(*keys).orderBy(*_order(spec))
        cols = []
        for k in spec.kpis:
            for n in lags:
                delta = F.col(k) - F.lag(k, n).over(over)
                cols += [
                    delta.alias(f"{k}_delta_{n}"),
                    F.abs(delta).alias(f"{k}_abs_{n}"),
                    F.coalesce(F.signum(delta).cast("int"), F.lit(0)).alias(f"{k}_dir_{n}"),
                ]
        return frame.select("*", *cols)

    return windowed(df, spec.entity, spec.time, max(lags), build, ties=spec.ties)


def rolling_z_step(spec: KpiSpec, window: int = 96) -> tuple[int, Build]:
    """Z-score against the previous window, a quarter of it required, clipped, NULL -> 0."""

    def build(frame, keys):
        over = _frame(keys, spec, -window, -1)
        cols = []
        for k in spec.kpis:
            enough = F.count(k).over(over) >= max(2, window // 4)
            std = F.when(enough, F.stddev_samp(k).over(over))
            z = (F.col(k) - F.avg(k).over(over)) / F.when(std > 0, std)
            cols.append(F.coalesce(clip(z, -spec.clip, spec.clip), F.lit(0.0)).alias(f"{k}_z"))
        return frame.select("*", *cols)

    return window, build


def rolling_z(df: DataFrame, spec: KpiSpec, window: int = 96) -> DataFrame:
    return in_one_pass(df, spec, [rolling_z_step(spec, window)])


def row_index(df: DataFrame, spec: KpiSpec, name: str = "row_index") -> DataFrame:
    """Position of the row inside its entity, from 0."""
    counted = df.withColumn("_one", F.lit(1))
    out = running_sums(counted, spec.entity, spec.time, {name: "_one"}, ties=spec.ties, exclusive=True)
    return out.drop("_one").withColumn(name, F.col(name).cast("long"))


def forward_fill(df: DataFrame, spec: KpiSpec, defaults: dict[str, Column]) -> DataFrame:
    """Last seen value without limit, then the given global default."""
    filled = last_known(
        df, spec.entity, spec.time, spec.ties, {f"_seen_{k}": F.col(k) for k in spec.kpis}
    )
    return filled.select(
        *[c for c in df.columns if c not in spec.kpis],
        *[F.coalesce(f"_seen_{k}", defaults[k]).alias(k) for k in spec.kpis],
    )


def short_fill(df: DataFrame, spec: KpiSpec, defaults: dict[str, Column], limit: int = 2,
               window: int = 96, need: int = 48) -> DataFrame:
    """Last value of at most ``limit`` rows back, rolling mean, default, then 0."""

    def build(frame, keys):
        recent = _frame(keys, spec, -limit, 0)
        day = _frame(keys, spec, -window, -1)
        cols = [
            F.coalesce(
                F.last(k, ignorenulls=True).over(recent),
                F.when(F.count(k).over(day) >= need, F.avg(k).over(day)),
                defaults[k],
                F.lit(0.0),
            ).alias(f"_filled_{k}")
            for k in spec.kpis
        ]
        return frame.select("*", *cols)

    out = windowed(df, spec.entity, spec.time, window, build, ties=spec.ties)
    return out.select(
        *[c for c in df.columns if c not in spec.kpis],
        *[F.col(f"_filled_{k}").alias(k) for k in spec.kpis],
    )


def reset_flags(df: DataFrame, spec: KpiSpec, window: int = 96, need: int = 48) -> DataFrame:
    """1 where a cumulative counter falls by more than half its recent maximum."""

    def build(frame, keys):
        order = Window.partitionBy(*keys).orderBy(*_order(spec))
        over = order.rowsBetween(-window, -1)
        cols = []
        for k in spec.kpis:
            top = F.when(F.count(k).over(over) >= need, F.max(k).over(over))
            drop = F.col(k) - F.lag(k).over(order)
            is_reset = drop < -COUNTER_RESET * F.when(top.isNotNull(), F.greatest(top, F.lit(1.0)))
            cols.append(F.when(is_reset, 1).otherwise(0).alias(f"{k}_is_reset"))
        return frame.select("*", *cols)

    return windowed(df, spec.entity, spec.time, window, build, ties=spec.ties)


def sequences(df: DataFrame, spec: KpiSpec, label: str, length: int = 8, stride: int = 1) -> DataFrame:
    """Full row windows of one entity as arrays; labelled if any row is anomalous."""
    indexed = row_index(df, spec, "_at")

    def build(frame, keys):
        over = _frame(keys, spec, -(length - 1), 0)
        return frame.select(
            *spec.entity, *_order(spec), "_at",
            *[c for c in frame.columns if c in ("_segment", "_halo")],
            F.collect_list(F.struct(*spec.kpis)).over(over).alias("steps"),
            F.max(label).over(over).alias("label"),
        )

    out = windowed(indexed, spec.entity, spec.time, length, build, ties=spec.ties)
    start = F.col("_at") - (length - 1)
    return out.where((start >= 0) & (start % stride == 0)).withColumn("start_index", start).drop("_at")


def sigma_drop(df: DataFrame, spec: KpiSpec, kpi: str, window: int = 4, sigmas: float = 3.0) -> DataFrame:
    """Drop below the rolling mean in standard deviations; threshold taken before scaling."""

    def build(frame, keys):
        over = _frame(keys, spec, -(window - 1), 0)
        enough = F.count(kpi).over(over) >= 2
        std = F.greatest(F.stddev_samp(kpi).over(over), F.lit(1e-6))
        score = F.when(enough, (F.avg(kpi).over(over) - F.col(kpi)) / std)
        return frame.withColumn("raw_score", F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)))

    out = windowed(df, spec.entity, spec.time, window, build, ties=spec.ties)
    top = out.agg(F.max("raw_score")).scalar()
    return out.withColumns(
        {
            "score": F.when(top > 0, F.col("raw_score") / top).otherwise(0.0),
            "flag": F.when(F.col("raw_score") >= sigmas, 1).otherwise(0),
        }
    )


def deviation_score(df: DataFrame, spec: KpiSpec, kpi: str, window: int = 16) -> DataFrame:
    """Fall below the rolling mean of the previous window, scaled by the largest fall."""

    def build(frame, keys):
        over = _frame(keys, spec, -window, -1)
        enough = F.count(kpi).over(over) >= max(1, window // 2)
        fall = F.when(enough, F.avg(kpi).over(over) - F.col(kpi))
        return frame.withColumn("_fall", F.greatest(F.coalesce(fall, F.lit(0.0)), F.lit(0.0)))

    out = windowed(df, spec.entity, spec.time, window, build, ties=spec.ties)
    top = out.agg(F.max("_fall")).scalar()
    return out.withColumn("score", F.col("_fall") / F.when(top > 0, top).otherwise(1.0)).drop("_fall")


def centred_mean(df: DataFrame, spec: KpiSpec, kpi: str, name: str, window: int = 4) -> DataFrame:
    """Centred mean; an even window leans one row to the past, edges use what exists."""
    back, ahead = window // 2, window - 1 - window // 2

    def build(frame, keys):
        return frame.withColumn(name, F.avg(kpi).over(_frame(keys, spec, -back, ahead)))

    return windowed(df, spec.entity, spec.time, back, build, halo_after=ahead, ties=spec.ties)


def buffer_features(df: DataFrame, spec: KpiSpec, kpi: str) -> DataFrame:
    """Serving view of the last 16 and 96 rows with the current one; missing -> 0."""

    def build(frame, keys):
        order = Window.partitionBy(*keys).orderBy(*_order(spec))
        cols = []
        for label, w in (("4h", 16), ("24h", 96)):
            over = order.rowsBetween(-(w - 1), 0)
            cols += [
                F.coalesce(F.avg(kpi).over(over), F.lit(0.0)).alias(f"{kpi}_mean_{label}"),
                F.coalesce(F.stddev_samp(kpi).over(over), F.lit(0.0)).alias(f"{kpi}_std_{label}"),
            ]
        delta = F.col(kpi) - F.lag(kpi).over(order)
        return frame.select("*", *cols, F.coalesce(delta, F.lit(0.0)).alias(f"{kpi}_delta_1"))

    return windowed(df, spec.entity, spec.time, 96, build, ties=spec.ties)


def external_z(value: Column, mean: Column, std: Column, floor: float = 1e-6, bound: float = 6.0) -> Column:
    return clip((value - mean) / F.greatest(std, F.lit(floor)), -bound, bound)


def cusum_flag(df: DataFrame, keys: Sequence[str], time: str, distance: str,
               allowance: float = 0.5, threshold: float = 3.0) -> DataFrame:
    """Latched one-sided CUSUM over a pre-aggregated series (one row per key and period).

    The closed form replaces the recursion: the sum since the last reset is the
    running sum minus its running minimum.
    """
    run = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col(distance) - allowance).over(run)
    with_total = df.withColumn("_c", total)
    low = F.least(F.min("_c").over(run), F.lit(0.0))
    level = with_total.withColumn("cusum", F.col("_c") - low)
    latched = F.max((F.col("cusum") > threshold).cast("int")).over(run)
    return level.withColumn("alarm", latched).drop("_c")


def last_n_mean(df: DataFrame, spec: KpiSpec, score: str, n: int = 100) -> DataFrame:
    """Mean of the last n scores up to the row, 1.0 while nothing was scored."""

    def build(frame, keys):
        mean = F.avg(score).over(_frame(keys, spec, -(n - 1), 0))
        return frame.withColumn("rolling_score", F.coalesce(mean, F.lit(1.0)))

    return windowed(df, spec.entity, spec.time, n, build, ties=spec.ties)


def sustained(df: DataFrame, keys: Sequence[str], time: str, breached: Column, periods: int = 2,
              position: Column | None = None) -> DataFrame:
    """Flag a breach that has held for ``periods`` consecutive periods of a series with one row a period.

    ``position`` is the number of the period on the calendar, so that a missing period
    breaks the run; without it, rows count as consecutive.
    """
    over = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(periods - 1), 0)
    if position is not None:
        over = Window.partitionBy(*keys).orderBy(position).rangeBetween(-(periods - 1), 0)
    hit = F.coalesce(breached, F.lit(False)).cast("int")
    return df.withColumn("sustained", (F.sum(hit).over(over) == periods).cast("int"))


def global_median(df: DataFrame, kpi: str) -> Column:
    return exact_quantiles(df, [], kpi, {"m": 0.5}).scalar()

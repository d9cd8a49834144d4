"""Ordered prefix sums and exact quantiles that never put one group in one task.

A frame too large for one task is cut along the order column at approximate
quantiles.  The cuts are literals, so every scan of the frame agrees on the
bucket of a row, even after a lost executor.  Per-bucket totals are a small
aggregate; their running sums give each bucket its starting offset and the
remaining window runs inside (group, bucket).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.skew import attach, group_join
from ropeway.session import rows_per_task

#: Cuts that one reducer finds; more are found in parts.
CUTS_AT_ONCE = 4096
BUCKET = "_bucket"


def as_number(column: Column, dtype: str) -> Column:
    """Order-preserving double for numeric, timestamp and date columns."""
    if dtype.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if dtype == "date":
        return F.unix_date(column).cast("double")
    return column.cast("double")


def cut_points(df: DataFrame, order: str, source: DataFrame | None = None, limit: int | None = None) -> list[float]:
    """Bucket borders; empty when the whole frame fits one task.

    ``source`` is a cheaper frame with at least as many rows; when it is small
    enough, ``df`` itself is not evaluated.  ``limit`` replaces the rows that a task
    holds where a row is more work than a comparison.
    """
    limit = min(limit or math.inf, rows_per_task(df.sparkSession))
    if source is not None and source.count() <= limit:
        return []
    n = df.count()
    if n <= limit:
        return []
    key = as_number(F.col(order), dict(df.dtypes)[order])
    parts = math.ceil(n / limit)
    coarse = min(parts, CUTS_AT_ONCE)
    grid = lambda k: [i / k for i in range(1, k)]
    cuts = sorted(set(df.agg(F.percentile_approx(key, grid(coarse), 20 * coarse).alias("q")).first()["q"] or []))
    fine = math.ceil(parts / coarse)
    if fine > 1:
        # every coarse bucket finds its own cuts in a reducer of its own
        inner = with_bucket(df, order, cuts).groupBy(BUCKET).agg(F.percentile_approx(key, grid(fine), 20 * fine).alias("q"))
        cuts += [c for row in inner.collect() for c in row["q"] or []]
    return sorted(set(cuts))


def hot_instants(df: DataFrame, order: str, ties: Sequence[str]) -> DataFrame | None:
    """(_at, _sub_cuts): order values that more rows share than a task holds, and where to cut their first tie.

    None where there are none or the tie is not a number or time.  There are at most
    as many as tasks are needed for the frame.
    """
    spark, types = df.sparkSession, dict(df.dtypes)
    if not ties or not re.match("tinyint|smallint|int|bigint|float|double|decimal|date|timestamp", types.get(ties[0], "")):
        return None
    limit = rows_per_task(spark)
    at = as_number(F.col(order), types[order]).alias("_at")
    crowded = df.groupBy(at).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    most = crowded.agg(F.max("_n")).first()[0]
    if most is None:
        return None
    parts = math.ceil(most / limit)
    grid = [i / parts for i in range(1, parts)]
    tie = as_number(F.col(ties[0]), types[ties[0]]).alias("_tie")
    cut = df.select(at, tie).join(crowded, "_at").groupBy("_at").agg(F.percentile_approx("_tie", grid, 20 * parts).alias("_sub_cuts"))
    return spark.createDataFrame(cut.collect(), cut.schema)


def isolating(cuts: Sequence[float], instants: DataFrame | None) -> list[float]:
    """Cuts with every hot instant in a bucket of its own."""
    if instants is None:
        return list(cuts)
    hot = [r["_at"] for r in instants.collect()]
    return sorted({*cuts, *hot, *[math.nextafter(x, math.inf) for x in hot]})


def with_bucket(df: DataFrame, order: str, cuts: Sequence[float], name: str = BUCKET,
                instants: DataFrame | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Bucket number of ``order``; a cut belongs to the bucket on its right.

    Rows of a hot instant get fractions behind the number, in the order of their first tie.
    """
    if instants is not None:
        plain = with_bucket(df, order, cuts, name)
        at = as_number(F.col(order), dict(df.dtypes)[order])
        tie = as_number(F.col(ties[0]), dict(df.dtypes)[ties[0]])
        joined = plain.join(F.broadcast(instants), at == F.col("_at"), "left")
        part = F.coalesce(F.size(F.filter("_sub_cuts", lambda c: c <= tie)), F.lit(0))
        within = F.when(F.col("_sub_cuts").isNull(), F.lit(0)).otherwise(part)
        return joined.withColumn(name, F.col(name) + within / float(1 << 20)).drop("_at", "_sub_cuts")
    key = as_number(F.col(order), dict(df.dtypes)[order])
    borders = [-math.inf, *cuts, math.inf]
    staged = df.withColumn("_order_key", key)
    out = Bucketizer(
        splits=borders, inputCol="_order_key", outputCol=name, handleInvalid="keep"
    ).transform(staged)
    return out.withColumn(name, F.col(name).cast("int")).drop("_order_key")


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: dict[str, str],
    ties: Sequence[str] = (),
    descending: bool = False,
    exclusive: bool = False,
    cuts: Sequence[float] | None = None,
    next_as: str | None = None,
) -> DataFrame:
    """Add running sums of ``sums`` (output name -> input column) along ``order``.

    ``next_as`` adds the following order value of the group.
    """
    last = -1 if exclusive else 0
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    cuts = cut_points(df, order) if cuts is None else cuts
    local_order = [direction(c) for c in (order, *ties)]
    if not cuts:
        ordered = Window.partitionBy(*groups).orderBy(*local_order)
        w = ordered.rowsBetween(Window.unboundedPreceding, last)
        following = [F.lead(order).over(ordered).alias(next_as)] if next_as else []
        return df.select(
            "*",
            *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(o) for o, c in sums.items()],
            *following,
        )
    instants = hot_instants(df, order, ties)
    bucketed = with_bucket(df, order, isolating(cuts, instants), instants=instants, ties=ties)
    first_of = F.max(order) if descending else F.min(order)
    totals = bucketed.groupBy(*groups, BUCKET).agg(
        *[F.sum(c).alias(f"_total_{o}") for o, c in sums.items()], first_of.alias("_first")
    )
    onward = Window.partitionBy(*groups).orderBy(direction(BUCKET))
    before = (
        Window.partitionBy(*groups)
        .orderBy(direction(BUCKET))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *groups,
        BUCKET,
        *[
            F.coalesce(F.sum(f"_total_{o}").over(before), F.lit(0)).alias(f"_offset_{o}")
            for o in sums
        ],
        F.lead("_first").over(onward).alias("_next_first"),
    )
    joined = group_join(bucketed, offsets, [*groups, BUCKET])
    ordered = Window.partitionBy(*groups, BUCKET).orderBy(*local_order)
    w = ordered.rowsBetween(Window.unboundedPreceding, last)
    following = (
        [F.coalesce(F.lead(order).over(ordered), "_next_first").alias(next_as)] if next_as else []
    )
    return joined.select(
        *df.columns,
        *following,
        *[
            (F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_offset_{o}")).alias(o)
            for o, c in sums.items()
        ],
    )


def value_counts(
    df: DataFrame, groups: Sequence[str], value: str, weights: dict[str, Column] | None = None
) -> DataFrame:
    """Rows per (group, value), combined on the map side; NULL values are left out."""
    weights = weights or {"n": F.lit(1)}
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(*[F.sum(w).cast("long").alias(o) for o, w in weights.items()])
    )


def _contribution(value: str, pos: Column) -> Column:
    """Share of one value-count row in the interpolated order statistic at ``pos``."""
    lo, hi, frac = F.floor(pos), F.ceil(pos), pos - F.floor(pos)
    below, end = F.col("_below"), F.col("_below") + F.col("n")
    has_lo, has_hi = (lo >= below) & (lo < end), (hi >= below) & (hi < end)
    return (
        F.when(has_lo & has_hi, F.col(value))
        .when(has_lo, F.col(value) * (1 - frac))
        .when(has_hi, F.col(value) * frac)
    )


def _placed_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Value counts with the rows below each value and the group total."""
    counts = value_counts(df, groups, value)
    cuts = cut_points(counts, value, source=df)
    placed = running_sums(counts, groups, value, {"_below": "n"}, exclusive=True, cuts=cuts)
    if not cuts:
        return placed.withColumn("_total", F.sum("n").over(Window.partitionBy(*groups)))
    totals = counts.groupBy(*groups).agg(
        F.sum("n").cast("long").alias("_total"), F.count(F.lit(1)).alias("_rows")
    )
    return attach(placed, totals, groups, rows="_rows").drop("_rows")


def quantile_grid(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Many quantiles at once as rows (group, i, q)."""
    placed = _placed_counts(df, groups, value)
    grid = F.array(*[F.lit(float(p)) for p in probs])
    spots = F.transform(
        grid, lambda p, i: F.struct(i.alias("i"), (p * (F.col("_total") - 1)).alias("pos"))
    )
    mine = F.filter(
        spots,
        lambda s: (F.ceil(s["pos"]) >= F.col("_below"))
        & (F.floor(s["pos"]) < F.col("_below") + F.col("n")),
    )
    hits = placed.select(*groups, value, "n", "_below", F.explode(mine).alias("s"))
    return hits.groupBy(*groups, F.col("s.i").alias("i")).agg(
        F.sum(_contribution(value, F.col("s.pos"))).alias("q")
    )


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    count_as: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group from ordered value counts."""
    placed = _placed_counts(df, groups, value)
    aggs = [
        F.sum(_contribution(value, F.lit(float(p)) * (F.col("_total") - 1))).alias(name)
        for name, p in probs.items()
    ]
    if count_as:
        aggs.append(F.max("_total").alias(count_as))
    return placed.groupBy(*groups).agg(*aggs)


def average_rank(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(group, value) -> mean rank of ties (from 1), rows below, rows equal, group size."""
    placed = _placed_counts(df, groups, value)
    rank = F.col("_below") + (F.col("n") + 1) / 2
    return placed.withColumn("avg_rank", rank).withColumnsRenamed({"_below": "below", "_total": "total"})


#: Accuracy of the sketches that bracket a wanted rank, and how many of their errors a bracket reaches to either side.
SKETCH_ACCURACY, BRACKET = 10_000, 4


def _brackets(sketch: Sequence[float], least: float, most: float, probs: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint intervals of values, in order, that hold the wanted ranks."""
    reach, out = BRACKET / SKETCH_ACCURACY, []
    ends = zip(sketch[: len(probs)], sketch[len(probs) :], probs, strict=True)
    for low, high in sorted((least if p <= reach else low, most if p >= 1 - reach else high) for low, high, p in ends):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def column_quantiles(df: DataFrame, columns: dict[str, Column], probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of many columns, as rows (feature, one column per name in ``probs``).

    One aggregate, the only job before execution, builds a sketch of every column,
    which brackets each wanted rank by two values.  A second pass counts rows by
    stretch between brackets and, inside brackets, by value: only a few thousandths of
    the values are shuffled, repeated ones as one row.  NULLs are left out; a column
    without values has NULL quantiles.
    """
    names, ps = list(columns), list(probs.values())
    v = {f: columns[f].cast("double") for f in names}
    reach = BRACKET / SKETCH_ACCURACY
    at = [min(max(p + s * reach, 0.0), 1.0) for s in (-1, 1) for p in ps]
    row = df.agg(*[F.struct(
        F.percentile_approx(v[f], at, SKETCH_ACCURACY).alias("q"), F.min(v[f]).alias("least"), F.max(v[f]).alias("most"),
        F.count(v[f]).alias("n")).alias(f"c{k}") for k, f in enumerate(names)]).first()
    spine = df.sparkSession.createDataFrame([(k, f) for k, f in enumerate(names)], "c int, feature string")
    have = [k for k in range(len(names)) if row[f"c{k}"]["n"]]
    if not have:
        return spine.select("feature", *[F.lit(None).cast("double").alias(n) for n in probs])

    def placed(k: int) -> Column:
        """Column number, stretch (odd inside of a bracket) and, there, the value."""
        c, x = row[f"c{k}"], v[names[k]]
        stretch = F.lit(0)
        for i, (low, high) in enumerate(_brackets(c["q"], c["least"], c["most"], ps)):
            stretch = F.when(x > F.lit(high), 2 * i + 2).when(x >= F.lit(low), 2 * i + 1).otherwise(stretch)
        return F.struct(F.lit(k).alias("c"), F.when(x.isNotNull(), stretch).alias("stretch"), x.alias("value"))

    long = df.select(F.explode(F.array(*map(placed, have))).alias("r")).select("r.*").where("stretch IS NOT NULL")
    counts = long.groupBy("c", "stretch", F.when(F.col("stretch") % 2 == 1, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("c").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("c", "stretch").agg(F.sum("n").alias("n")).select(
        "c", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # a bracket holds at most so many values; beyond a task's rows they are cut as any ordered sum
    most = max(row[f"c{k}"]["n"] for k in have) * min(1.0, 2 * (BRACKET + 1) / SKETCH_ACCURACY * len(ps))
    inside = counts.where("value IS NOT NULL")
    cuts = [] if most <= rows_per_task(df.sparkSession) else None
    sums = running_sums(inside, ["c", "stretch"], "value", {"_inside": "n"}, exclusive=True, cuts=cuts)
    sums = sums.join(base, ["c", "stretch"]).withColumn("_below", F.col("_base") + F.col("_inside"))
    places = {k: [p * (row[f"c{k}"]["n"] - 1) for p in ps] for k in have}
    pos = F.create_map(*[c for k in have for c in (F.lit(k), F.array(*map(F.lit, places[k])))])
    spots = F.transform(pos[F.col("c")], lambda p, i: F.struct(i.alias("i"), p.alias("pos")))
    mine = F.filter(spots, lambda s: (F.ceil(s["pos"]) >= F.col("_below")) & (F.floor(s["pos"]) < F.col("_below") + F.col("n")))
    hits = sums.select("c", "value", "n", "_below", F.explode(mine).alias("s"))
    got = hits.groupBy("c").pivot("s.i", list(range(len(ps)))).agg(F.sum(_contribution("value", F.col("s.pos"))))
    return spine.join(got, "c", "left").select("feature", *[F.col(str(i)).alias(n) for i, n in enumerate(probs)])

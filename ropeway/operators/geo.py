"""Nearest-neighbour relations between sites on the globe."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.plans.skew import attach

# Earth radius, reach and band weighting of a relation table.
EARTH_KM, REACH_KM, NEIGHBOURS, BAND_WEIGHT = 6371.0, 5.0, 8, 1.5
FINEST_KM = 1e-4
#: Locations of a group up to which all of them are compared.
FEW_SPOTS = 64


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2
    )
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _xyz() -> dict[str, Column]:
    lat, lon = F.radians("lat"), F.radians("lon")
    return {
        "_x": EARTH_KM * F.cos(lat) * F.cos(lon),
        "_y": EARTH_KM * F.cos(lat) * F.sin(lon),
        "_z": EARTH_KM * F.sin(lat),
    }


def _cube(level: Column, side0: float) -> list[Column]:
    side = F.lit(side0) / F.pow(F.lit(2.0), level)
    at = lambda a: F.when(level < 0, F.lit(0)).otherwise(F.floor(F.col(a) / side).cast("long"))
    return [at(a).cast("long").alias(f"_c{a[1]}") for a in ("_x", "_y", "_z")]


def nearest_locations(
    points: DataFrame, k: int, reach_km: float, payload: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """k+1 nearest points of every distinct location, itself included.

    Space is cut into cubes whose side halves per level.  A location searches the
    finest level that surely holds its k neighbours, so a crowded cube is only
    searched through its small sub-cubes and the candidate pairs grow linearly.
    Points on one spot are represented by the k+1 smallest ids.
    """
    group = list(group)
    spot = [*group, "lat", "lon"]
    at_spot = Window.partitionBy(*spot).orderBy("id")
    kept = points.select("id", *spot, *[c for c in payload if c not in spot]).withColumn(
        "_rn", F.row_number().over(at_spot)
    ).where(F.col("_rn") <= k + 1)
    counts = points.groupBy(*spot).agg(F.count(F.lit(1)).alias("_here"))
    locations = counts.withColumns(_xyz())
    cube = ["_level", "_cx", "_cy", "_cz"]
    every = F.sequence(F.lit(0), F.lit(math.ceil(math.log2(reach_km / FINEST_KM))))
    if group:
        # the locations of a small group meet directly, in one cube of a level of its own
        few = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_spots"))
        locations = attach(locations, few, group, rows="_spots")
        locations = locations.withColumn("_first", F.when(F.col("_spots") <= FEW_SPOTS, -1).otherwise(0)).drop("_spots")
        every = F.when(F.col("_first") < 0, F.array(F.lit(-1))).otherwise(every)
    else:
        locations = locations.withColumn("_first", F.lit(0))
    leveled = locations.select("*", F.explode(every).alias("_level"))
    leveled = leveled.select("*", *_cube(F.col("_level"), reach_km))
    dense = leveled.groupBy(*group, *cube).agg(
        F.sum("_here").alias("_points"), F.count(F.lit(1)).alias("_rows")
    ).where(F.col("_points") >= k + 1)
    finest = attach(leveled.select(*spot, *cube), dense, [*group, *cube], rows="_rows").groupBy(*spot).agg(
        F.max("_level").alias("_finest")
    )
    search = locations.join(finest, spot, "left").withColumn(
        "_level", F.greatest(F.coalesce("_finest", F.lit(0)) - 1, F.col("_first"))
    )
    search = search.select(*spot, "_x", "_y", "_z", "_level", *_cube(F.col("_level"), reach_km))
    for axis in ("_cx", "_cy", "_cz"):
        beside = F.array(*[F.col(axis) + d for d in (-1, 0, 1)])
        search = search.withColumn(axis, F.explode(F.when(F.col("_level") < 0, F.array(F.col(axis))).otherwise(beside)))
    candidates = leveled.select(
        *group, *cube, F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"),
        F.col("_x").alias("_tx"), F.col("_y").alias("_ty"), F.col("_z").alias("_tz"),
    )
    near = search.join(candidates, [*group, *cube])
    chord2 = sum((F.col(f"_{a}") - F.col(f"_t{a}")) * (F.col(f"_{a}") - F.col(f"_t{a}")) for a in "xyz")
    limit = 2 * EARTH_KM * math.sin(min(reach_km / (2 * EARTH_KM), math.pi / 2))
    near = near.where(chord2 <= (limit * 1.001) ** 2 + 1e-6).select(
        *spot, "t_lat", "t_lon",
        haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")).alias("distance_km"),
    ).where(F.col("distance_km") <= reach_km)
    # the k+1 nearest spots, ties included, always contain the k+1 nearest points
    by_distance = Window.partitionBy(*spot).orderBy("distance_km")
    near = near.withColumn("_rn", F.rank().over(by_distance)).where(F.col("_rn") <= k + 1).drop("_rn")
    targets = kept.select(
        *group, F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("id").alias("target"),
        *[F.col(c).alias(f"t_{c}") for c in payload],
    )
    pairs = near.join(targets, [*group, "t_lat", "t_lon"])
    order = Window.partitionBy(*spot).orderBy("distance_km", "target")
    return pairs.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k + 1).drop("_rn")


def neighbour_relations(cells: DataFrame, k: int = NEIGHBOURS, reach_km: float = REACH_KM) -> DataFrame:
    """Up to k nearest relations per cell within reach or on the same site.

    ``cells`` has ``id, site, band, lat, lon``.
    """
    half_globe = math.pi * EARTH_KM
    near = nearest_locations(cells, k, reach_km, ["site", "band"])
    same = nearest_locations(cells, k, half_globe, ["site", "band"], group=["site"])
    spots = cells.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    own = cells.select(F.col("id").alias("source"), "site", "band", "lat", "lon")
    per_spot = near.join(spots, ["lat", "lon"])
    site_spots = cells.groupBy("site", "lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    fields = ["source", "site", "band", "target", "t_site", "t_band", "distance_km"]
    a = attach(own, _as_lists(per_spot, ["lat", "lon"]), ["lat", "lon"], rows="_n")
    b = attach(own, _as_lists(same.join(site_spots, ["site", "lat", "lon"]), ["site", "lat", "lon"]),
               ["site", "lat", "lon"], rows="_n")
    both = a.select("source", "site", "band", F.explode("_list").alias("t")).unionByName(
        b.select("source", "site", "band", F.explode("_list").alias("t"))
    )
    flat = both.select("source", "site", "band", "t.*").where("source <> target").select(*fields).distinct()
    order = Window.partitionBy("source").orderBy("distance_km", "target")
    same_band = F.col("band") == F.col("t_band")
    return (
        flat.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
        .select(
            "source", "target", F.round("distance_km", 3).alias("distance_km"),
            (F.col("site") == F.col("t_site")).alias("same_site"), same_band.alias("same_band"),
            F.round(F.when(same_band, BAND_WEIGHT).otherwise(1.0) / (1 + F.col("distance_km")), 4).alias("edge_weight"),
            F.when(F.col("site") == F.col("t_site"), "co_site").otherwise("neighbour").alias("relation_type"),
        )
    )


def _as_lists(pairs: DataFrame, spot: Sequence[str]) -> DataFrame:
    """At most k+1 targets of a location as one array row."""
    return pairs.groupBy(*spot).agg(
        F.max("_n").alias("_n"),
        F.collect_list(F.struct("target", "t_site", "t_band", "distance_km")).alias("_list"),
    )

"""Graph operators on edge tables: components, degrees, neighbour features, rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ropeway.operators.sets import symmetrise
from ropeway.plans.prefix import running_sums
from ropeway.plans.skew import lookup_join, with_group_stats
from ropeway.session import durable

# What-if sensitivities (tilt on CQI and handover points, power on throughput).
TILT_CQI, TILT_HANDOVER_PP, POWER_TPUT = -0.8, -0.5, 0.8
CI_SHARE = {"cqi": 0.3, "handover": 0.2, "throughput": 0.1}


def components(edges: DataFrame, source: str, target: str, max_rounds: int = 60) -> DataFrame:
    """Component (smallest node id) of every node.

    Each round hooks a node's root to the smallest root among its neighbours and
    halves the pointer chains, so rounds grow with the logarithm of the diameter.
    All steps are joins and minimum aggregates; lineage is cut every round.
    """
    pairs = durable(symmetrise(edges, source, target).toDF("u", "v").where("u <> v"))
    alone = edges.select(F.col(source).alias("id")).union(edges.select(F.col(target)))
    parents = durable(alone.distinct().withColumn("f", F.col("id")))
    for _ in range(max_rounds):
        up = parents.select(F.col("id").alias("f"), F.col("f").alias("gf"))
        jumped = parents.join(up, "f").select("id", "f", "gf")
        near = (
            pairs.join(jumped.select(F.col("id").alias("v"), "gf"), "v")
            .groupBy(F.col("u").alias("id")).agg(F.min("gf").alias("m"))
        )
        seen = jumped.join(near, "id", "left").withColumn("m", F.least("gf", F.coalesce("m", "gf")))
        hooks = seen.groupBy(F.col("f").alias("id")).agg(F.min("m").alias("h"))
        moved = seen.join(hooks, "id", "left").select(
            "id", F.least("m", F.coalesce("h", "m")).alias("f"), F.col("f").alias("old"))
        moved = durable(moved)
        parents = moved.select("id", "f")
        if moved.where("f <> old").limit(1).count() == 0:
            return parents.withColumnRenamed("f", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Every directed edge counts at both ends."""
    ends = edges.select(F.col(source).alias("id")).unionAll(edges.select(F.col(target)))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def neighbour_statistics(kpis: DataFrame, edges: DataFrame, cell: str, time: str, kpi: str,
                         source: str = "source", target: str = "target") -> DataFrame:
    """Mean, min, max and population deviation over the out-neighbours at the same time."""
    links = edges.select(F.col(target).alias(cell), F.col(source).alias("_src")).distinct()
    spread = lookup_join(kpis.select(cell, time, kpi), links, [cell], "inner")
    return spread.groupBy(F.col("_src").alias(cell), time).agg(
        F.avg(kpi).alias("nbr_mean"), F.min(kpi).alias("nbr_min"), F.max(kpi).alias("nbr_max"),
        F.stddev_pop(kpi).alias("nbr_std"))


def nearest_undirected(edges: DataFrame, source: str, target: str, distance: str, k: int = 6) -> DataFrame:
    """Undirected neighbour list of at most k distinct partners by distance."""
    both = edges.select(source, target, distance).union(
        edges.select(F.col(target), F.col(source), F.col(distance)))
    unique = both.groupBy(source, target).agg(F.min(distance).alias(distance))
    over = Window.partitionBy(source).orderBy(distance, target)
    return unique.withColumn("_rn", F.row_number().over(over)).where(F.col("_rn") <= k).drop("_rn")


def neighbour_features(kpis: DataFrame, edges: DataFrame, cell: str, time: str, kpi: str) -> DataFrame:
    """Own value stands in for missing neighbours; the deviation is then 0."""
    stats = neighbour_statistics(kpis, edges, cell, time, kpi)
    own = F.col(kpi)
    return kpis.join(stats, [cell, time], "left").withColumns({
        "nbr_mean": F.coalesce("nbr_mean", own), "nbr_min": F.coalesce("nbr_min", own),
        "nbr_max": F.coalesce("nbr_max", own), "nbr_std": F.coalesce("nbr_std", F.lit(0.0))})


def node_index(nodes: DataFrame, id_col: str) -> DataFrame:
    """Dense 0-based index by sorted id, from a distributed running count."""
    one = nodes.select(id_col).distinct().withColumn("_one", F.lit(1))
    return running_sums(one, [], id_col, {"index": "_one"}, exclusive=True).select(
        id_col, F.col("index").cast("long").alias("index"))


def typed_edges(parts: Sequence[tuple[str, DataFrame, str, str, bool]]) -> DataFrame:
    """(type, frame, source, target, add reverse) -> one edge table with ``edge_type``."""
    out = None
    for kind, frame, s, t, reverse in parts:
        rows = frame.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(kind).alias("edge_type"))
        if reverse:
            rows = rows.union(frame.select(F.col(t), F.col(s), F.lit(f"rev_{kind}")))
        rows = rows.distinct()
        out = rows if out is None else out.union(rows)
    return out


def call_weights(calls: DataFrame) -> DataFrame:
    """Voice counts 1, a message 0.5; weights of a caller sum to 1."""
    w = F.when(F.col("type") == "voice", 1.0).otherwise(0.5)
    edges = calls.groupBy("caller", "callee").agg(F.sum(w).alias("w"))
    total = with_group_stats(edges, ["caller"], {"_t": F.sum("w")})
    return total.select("caller", "callee", (F.col("w") / F.col("_t")).alias("weight"))


def propagate(weights: DataFrame, features: DataFrame, node: str, columns: Sequence[str]) -> DataFrame:
    """Own features plus the weighted mean of the called nodes' features."""
    theirs = features.select(F.col(node).alias("callee"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    mean = weights.join(theirs, "callee").groupBy(F.col("caller").alias(node)).agg(
        *[F.sum(F.col("weight") * F.col(f"_n_{c}")).alias(f"nbr_{c}") for c in columns])
    out = features.join(mean, node, "left")
    return out.withColumns({f"nbr_{c}": F.coalesce(f"nbr_{c}", F.lit(0.0)) for c in columns})


def reciprocal_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs that call each other, found by grouping the unordered pair."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    pair = edges.where(F.col(a) != F.col(b)).select(lo.alias("a"), hi.alias("b"), (F.col(a) == lo).alias("_f"))
    seen = pair.groupBy("a", "b").agg(F.max("_f").alias("_x"), F.min("_f").alias("_y"))
    return seen.where(F.col("_x") & ~F.col("_y")).select("a", "b")


def shared_key_links(rows: DataFrame, member: str, key: str) -> DataFrame:
    """Members of one key linked to its smallest member: a star instead of all pairs."""
    pairs = rows.select(member, key).where(F.col(key).isNotNull()).distinct()
    star = with_group_stats(pairs, [key], {"_hub": F.min(member), "_n": F.count(F.lit(1))})
    return star.where((F.col("_n") > 1) & (F.col(member) != F.col("_hub"))).select(
        F.col("_hub").alias("source"), F.col(member).alias("target")).distinct()


def short_call_suspects(calls: DataFrame, short_below: float = 5.0, share: float = 0.5, contacts: int = 20) -> DataFrame:
    """Callers of many one-off numbers with mostly very short calls."""
    per = calls.where("type = 'voice'").groupBy("caller", "callee").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration") < short_below).alias("s"))
    out = per.groupBy("caller").agg(
        F.count(F.lit(1)).alias("contacts"), (F.sum("s") / F.sum("n")).alias("short_share"),
        F.avg((F.col("n") == 1).cast("int")).alias("one_off_share"))
    hit = (F.col("short_share") >= share) & (F.col("contacts") >= contacts)
    return out.withColumn("suspect", hit.cast("int"))


def ring_recall(rings: DataFrame, predictions: DataFrame, ring: str, member: str, flagged: str, gate: float = 0.70) -> DataFrame:
    """Share of flagged members per ring; half flagged means detected."""
    per = rings.join(predictions, member).groupBy(ring).agg(
        F.count(F.lit(1)).alias("members"), F.sum(flagged).alias("flagged"))
    per = per.withColumn("rate", F.col("flagged") / F.col("members")).withColumn(
        "detected", (F.col("rate") >= 0.5).cast("int"))
    overall = per.agg(F.avg("detected")).scalar()
    return per.withColumns({"overall": overall, "gate_passed": (overall >= gate).cast("int")})


def blast_sizes(edges: DataFrame, cells: DataFrame, cell: str, site: str,
                source: str = "source", target: str = "target") -> DataFrame:
    """Size of the one-hop blast radius without listing co-site pairs.

    Out-neighbours plus co-sited cells minus the neighbours counted twice.
    """
    # cells and links are few beside the rows they come from, and each is read several times
    located = durable(cells.select(cell, site).distinct())
    per_site = with_group_stats(located, [site], {"_site_cells": F.count(F.lit(1))})
    links = durable(edges.select(F.col(source).alias(cell), F.col(target).alias("_t")).where(F.col(cell) != F.col("_t")).distinct())
    away = durable(lookup_join(links, located, [cell], "inner").withColumnRenamed(site, "_s1"))
    away = lookup_join(away.withColumnRenamed(cell, "_c").withColumnRenamed("_t", cell), located, [cell], "left")
    out = away.groupBy(F.col("_c").alias(cell)).agg(
        F.count(F.lit(1)).alias("_out"), F.count_if(F.col("_s1") == F.col(site)).alias("_same"))
    size = F.coalesce("_out", F.lit(0)) - F.coalesce("_same", F.lit(0)) + F.col("_site_cells") - 1
    return per_site.join(out, cell, "left").select(cell, site, size.cast("long").alias("blast"))


def blast_members(targets: DataFrame, edges: DataFrame, cells: DataFrame, cell: str, site: str,
                  source: str = "source", target: str = "target", hops: int = 1) -> DataFrame:
    """Cells reached from the requested cells; more hops repeat the neighbour join."""
    wanted = targets.select(cell).distinct()
    links = edges.select(F.col(source).alias("_at"), F.col(target).alias("_next")).distinct()
    reach = wanted.select(cell, F.col(cell).alias("_at"))
    found = None
    for _ in range(hops):
        reach = reach.join(links, "_at").select(cell, F.col("_next").alias("_at")).distinct()
        found = reach if found is None else found.union(reach)
    here = wanted.join(cells.select(cell, site), cell)
    peers = here.join(cells.select(F.col(cell).alias("_at"), site), site).select(cell, "_at")
    return found.union(peers).where(F.col("_at") != F.col(cell)).distinct().withColumnRenamed("_at", "affected")


def what_if(proposals: DataFrame) -> DataFrame:
    """Projected changes, intervals and advice.

    ``proposals`` has kind ('tilt' or 'power'), delta, the hour's deviations
    std_cqi, std_handover, std_throughput (NULL for an unknown cell) and blast.
    """
    tilt, d = F.col("kind") == "tilt", F.col("delta")
    change = {
        "cqi": F.when(tilt, F.round(d * TILT_CQI, 3)),
        "handover": F.when(tilt, F.round(d * TILT_HANDOVER_PP, 3)),
        "throughput": F.when(~tilt, F.round(d * POWER_TPUT, 3)),
    }
    half = {k: 1.96 * F.col(f"std_{k}") * F.abs(d) * CI_SHARE[k] for k in change}
    worst = F.least(*change.values())
    known = F.col("std_cqi").isNotNull()
    advice = (
        F.when(~known | (worst < -2.0), "BLOCK")
        .when((F.col("blast") > 10) | (worst < -0.5), "CAUTION").otherwise("SAFE"))
    return proposals.select(
        "*", *[F.when(known, c).alias(f"d_{k}") for k, c in change.items()],
        *[F.when(known & change[k].isNotNull(), h).alias(f"half_{k}") for k, h in half.items()],
        advice.alias("advice"))


def topology_signature(edges: DataFrame, snapshot: str, source: str, target: str, site: Column, labelled: bool = True) -> DataFrame:
    """Cells, sites, edges, components and degree distribution per snapshot (``site`` is an expression on ``id``).

    Components are labelled over (snapshot, cell) nodes, so all snapshots share the
    rounds; without ``labelled`` they are left out.  A source ties its targets to their
    smallest, so only links between targets enter the rounds; a source that is
    no target hangs on them and changes no count.
    """
    from ropeway.plans.prefix import exact_quantiles

    edges = durable(edges.select(snapshot, source, target))
    pair = edges.select(snapshot, F.col(source).alias("a"), F.col(target).alias("b"))
    both = pair.union(pair.select(snapshot, "b", "a")).distinct()
    deg = durable(both.groupBy(snapshot, F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree")))
    base = deg.withColumn("_site", site).groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("_site").alias("sites"),
        F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_std"))
    q = exact_quantiles(deg, [snapshot], "degree", {f"p{p}": p / 100 for p in (10, 25, 50, 75, 90)})
    n = edges.groupBy(snapshot).agg(F.count(F.lit(1)).alias("edges"))
    if not labelled:
        return base.join(q, snapshot).join(n, snapshot)
    node = lambda c: F.struct(F.col(snapshot).alias("at"), F.col(c).alias("cell"))
    tied = with_group_stats(pair, [snapshot, "a"], {"_hub": F.min("b")})
    ends = pair.select(snapshot, F.col("b").alias("a")).distinct()
    links = tied.select(snapshot, F.col("_hub").alias("a"), "b").union(
        tied.select(snapshot, "a", F.col("_hub").alias("b")).distinct().join(ends, [snapshot, "a"], "left_semi")).distinct()
    labels = components(durable(links.select(node("a").alias("a"), node("b").alias("b"))), "a", "b")
    roots = labels.where("id = component").groupBy(F.col("id.at").alias(snapshot)).agg(F.count(F.lit(1)).alias("components"))
    return base.join(q, snapshot).join(n, snapshot).join(roots, snapshot)


def signature_distance(signatures: DataFrame, snapshot: str) -> DataFrame:
    """Euclidean distance of each snapshot's degree percentiles to the first one's."""
    cols = ["p10", "p25", "p50", "p75", "p90"]
    vec = F.array(*cols)
    first = signatures.agg(F.min_by(vec, F.col(snapshot))).scalar()
    gap = sum((F.col(c) - first[i]) * (F.col(c) - first[i]) for i, c in enumerate(cols))
    return signatures.withColumn("distance", F.sqrt(gap))

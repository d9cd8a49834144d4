"""Peer comparisons and joins."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, gappy_events, kpi_events, query, r6, sql_f32, sql_r6, table
from ropeway.functions.scalar import f32
from ropeway.operators import geo, joins as J, peers as P
from ropeway.plans.skew import with_group_stats

PEER = ["day", "cluster_id"]


@query("w6_leave_one_out_z", f"""WITH {KE}, g AS (SELECT day, cluster_id, count(*) AS n, avg(kpi) AS mu FROM ke GROUP BY 1, 2),
d AS (SELECT event_id, n, kpi - mu AS d, sum((kpi - mu) * (kpi - mu)) OVER (PARTITION BY day, cluster_id) AS ss FROM ke JOIN g USING (day, cluster_id))
SELECT event_id, {sql_r6('''CASE WHEN n <= 2 THEN 0 ELSE least(greatest(d * n / (n - 1) /
 (sqrt(greatest((ss - d * d) / (n - 1) - (d / (n - 1)) * (d / (n - 1)), 0.0)) + 1e-6), -5.0), 5.0) END''')} AS peer_z FROM d""")
def leave_one_out_z(spark, sf):
    return P.leave_one_out_z(kpi_events(spark, sf), PEER, "kpi").select("event_id", r6(F.col("peer_z")).alias("peer_z"))


@query("w7_inclusive_z", f"""WITH {KE}, x AS (SELECT event_id, kpi - avg(kpi) OVER w AS d, stddev_samp(kpi) OVER w AS s FROM ke WINDOW w AS (PARTITION BY day, cluster_id))
SELECT event_id, {sql_r6('CASE WHEN s > 0 THEN least(greatest(d / s, -5.0), 5.0) ELSE 0 END')} AS peer_z FROM x""")
def inclusive_z(spark, sf):
    return P.inclusive_z(kpi_events(spark, sf), PEER, "kpi").select("event_id", r6(F.col("peer_z")).alias("peer_z"))


@query("w8_percentile_rank", f"""WITH {KE}, kg AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN round(kpi) END AS kpi) FROM ke)
SELECT event_id, {sql_f32('''CASE WHEN kpi IS NOT NULL THEN (rank() OVER (PARTITION BY day, cluster_id ORDER BY kpi NULLS LAST)
 + (count(*) OVER (PARTITION BY day, cluster_id, kpi) - 1) / 2.0) / count(kpi) OVER (PARTITION BY day, cluster_id) END''')} AS rank_null,
 {sql_f32('''CASE WHEN kpi IS NOT NULL THEN (rank() OVER (PARTITION BY day, cluster_id ORDER BY kpi NULLS LAST)
 + (count(*) OVER (PARTITION BY day, cluster_id, kpi) - 1) / 2.0) / count(kpi) OVER (PARTITION BY day, cluster_id) ELSE 0.5 END''')} AS rank_half FROM kg""")
def percentile_rank(spark, sf):
    df = gappy_events(spark, sf).withColumn("kpi", F.round("kpi"))
    out = P.percentile_rank(df, PEER, "kpi")
    return out.select("event_id", f32(F.col("peer_rank")).alias("rank_null"),
                      f32(F.coalesce("peer_rank", F.lit(0.5))).alias("rank_half"))


@query("j1_enrich", """WITH d AS (SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 10 <> 3)
SELECT l_suppkey AS cell_id, coalesce(n_name, 'unknown') AS site, coalesce(r_name, 'unknown') AS cluster_id,
 CAST(max(CASE WHEN n_name IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS matched, count(*) AS n FROM lineitem LEFT JOIN d ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""")
def enrich(spark, sf):
    t = lambda n: table(spark, sf, n)
    dim = (t("supplier").where("s_suppkey % 10 <> 3")
           .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("s_suppkey").alias("cell_id"), "n_name", "r_name"))
    facts = t("lineitem").select(F.col("l_suppkey").alias("cell_id"))
    out = J.enrich(facts, dim, "cell_id", F.coalesce("r_name", F.lit("unknown")))
    return out.groupBy("cell_id", F.coalesce("n_name", F.lit("unknown")).alias("site"), "cluster_id").agg(
        F.max("matched").alias("matched"), F.count(F.lit(1)).alias("n"))


@query("j2_group_statistics", f"""WITH {KE} SELECT event_id, {sql_f32('avg(kpi) OVER w')} AS mean, max(kpi) OVER w AS top, count(*) OVER w AS n
FROM ke WINDOW w AS (PARTITION BY day, cluster_id)""")
def group_statistics(spark, sf):
    out = with_group_stats(kpi_events(spark, sf), PEER,
                           {"mean": F.avg("kpi"), "top": F.max("kpi"), "n": F.count(F.lit(1))})
    return out.select("event_id", f32(F.col("mean")).alias("mean"), "top", "n")


SITES = """cells AS (SELECT c_custkey AS id, c_custkey // 3 AS site, CAST(c_custkey % 2 AS INTEGER) AS band,
 -60 + ((c_custkey // 3) // 200 % 4000) * 0.03::DOUBLE + ((c_custkey // 3) * 37 % 101) / 101.0::DOUBLE * 0.01::DOUBLE AS lat,
 100 + ((c_custkey // 3) % 200) * 0.04::DOUBLE + ((c_custkey // 3) * 53 % 103) / 103.0::DOUBLE * 0.01::DOUBLE AS lon FROM customer)"""


def sites(spark, sf):
    site = F.floor(F.col("c_custkey") / 3)
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), site.alias("site"), F.pmod("c_custkey", F.lit(2)).cast("int").alias("band"),
        (F.lit(-60) + F.pmod(F.floor(site / 200), F.lit(4000)) * F.lit(0.03) + F.pmod(site * 37, F.lit(101)) / F.lit(101.0) * F.lit(0.01)).alias("lat"),
        (F.lit(100) + F.pmod(site, F.lit(200)) * F.lit(0.04) + F.pmod(site * 53, F.lit(103)) / F.lit(103.0) * F.lit(0.01)).alias("lon"))


@query("j4_neighbour_relations", f"""WITH {SITES}, p AS (SELECT a.id AS source, b.id AS target, a.site = b.site AS same_site, a.band = b.band AS same_band,
 2 * 6371.0 * asin(sqrt(least(power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat))
 * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0))) AS km FROM cells a JOIN cells b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.06),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY km, target) AS rn FROM p WHERE km <= 5.0 OR same_site)
SELECT source, target, round(km, 3) AS distance_km, same_site, same_band, round(CASE WHEN same_band THEN 1.5 ELSE 1.0 END / (1 + km), 4) AS edge_weight,
 CASE WHEN same_site THEN 'co_site' ELSE 'neighbour' END AS relation_type FROM q WHERE rn <= 8""")
def neighbour_relations(spark, sf):
    return geo.neighbour_relations(sites(spark, sf))


@query("j5_labels", """SELECT doc_id, coalesce(quality, 0) AS quality, CAST(quality IS NOT NULL AS INTEGER) AS labelled FROM documents LEFT JOIN labels USING (doc_id)""")
def labels(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("labelled"))
    seen = lab.select("doc_id", "labelled")
    docs = table(spark, sf, "documents").select("doc_id")
    out = J.with_labels(J.with_labels(docs, lab, ["doc_id"], "quality"), seen, ["doc_id"], "labelled")
    return out.select("doc_id", "quality", "labelled")


@query("j6_as_of", f"""WITH {KE}, f AS (SELECT cell_id, ts, arg_max(kpi, event_id) AS kpi FROM ke WHERE event_type = 'view' GROUP BY 1, 2),
s AS (SELECT event_id, cell_id, ts FROM ke WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN s.ts - f.ts <= INTERVAL 2 DAY THEN f.kpi END AS kpi,
 CASE WHEN s.ts - f.ts <= INTERVAL 2 DAY THEN epoch_us(f.ts) END AS feature_us FROM s ASOF LEFT JOIN f ON s.cell_id = f.cell_id AND s.ts >= f.ts""")
def as_of(spark, sf):
    ke = kpi_events(spark, sf)
    out = J.as_of(ke.where("event_type = 'purchase'").select("event_id", "cell_id", "ts"),
                  ke.where("event_type = 'view'").select("cell_id", "ts", "kpi", "event_id"),
                  ["cell_id"], "ts", ["kpi"], ttl_seconds=2 * 86400, feature_ties=["event_id"])
    return out.select("event_id", "kpi", F.unix_micros("feature_ts").alias("feature_us"))


@query("j7_ground_truth", """SELECT p.event_id AS prediction_id, p.value AS score, CAST(t.event_type = 'error' AS INTEGER) AS truth
FROM events p LEFT JOIN (SELECT * FROM events WHERE event_id % 4 = 0) t ON t.event_id = p.event_id""")
def ground_truth(spark, sf):
    ev = table(spark, sf, "events")
    truth = ev.where("event_id % 4 = 0").select(
        F.col("event_id").alias("prediction_id"), (F.col("event_type") == "error").cast("int").alias("truth"))
    return J.with_truth(ev.select(F.col("event_id").alias("prediction_id"), F.col("value").alias("score")), truth)


FLAGS = KE + """, fl AS (SELECT event_id, cluster_id, ts FROM ke WHERE event_type = 'error'),
al AS (SELECT cluster_id, ts FROM ke WHERE event_type = 'signup'),
cf AS (SELECT event_id, cluster_id, fl.ts, CASE WHEN al.ts - fl.ts <= INTERVAL 2 HOUR THEN al.ts END AS alarm_ts
 FROM fl ASOF LEFT JOIN al USING (cluster_id, ts))"""
FLAGS = FLAGS.replace("FROM fl ASOF LEFT JOIN al USING (cluster_id, ts)",
                      "FROM fl ASOF LEFT JOIN al ON fl.cluster_id = al.cluster_id AND fl.ts <= al.ts").replace(
                          "SELECT event_id, cluster_id, fl.ts, CASE", "SELECT event_id, fl.cluster_id, fl.ts, CASE")


def confirmed_flags(spark, sf):
    ke = kpi_events(spark, sf)
    return J.next_within(ke.where("event_type = 'error'").select("event_id", "cluster_id", "ts"),
                         ke.where("event_type = 'signup'"), ["cluster_id"], "ts", 2 * 3600)


@query("j8_confirmed_flags", f"WITH {FLAGS} SELECT event_id, epoch_us(alarm_ts) AS alarm_us, CAST(alarm_ts IS NOT NULL AS INTEGER) AS confirmed FROM cf")
def confirmed(spark, sf):
    return confirmed_flags(spark, sf).select("event_id", F.unix_micros("alarm_ts").alias("alarm_us"), "confirmed")


@query("j8_unconfirmed_rate", f"""WITH {FLAGS}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(CASE WHEN alarm_ts IS NULL THEN 1 ELSE 0 END) AS u FROM cf GROUP BY 1),
r AS (SELECT day, sum(u) OVER w / sum(n) OVER w AS rate FROM d WINDOW w AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
SELECT CAST(day AS VARCHAR) AS day, {sql_f32('rate')} AS rate, CAST(rate > 0.35 AS INTEGER) AS drifting FROM r""")
def unconfirmed_rate(spark, sf):
    from ropeway.operators.monitoring import rolling_rate
    daily = confirmed_flags(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("confirmed")).alias("u"))
    out = rolling_rate(daily, [], "day", "u", "n", 7)
    return out.select(F.col("day").cast("string").alias("day"), f32(F.col("rate")).alias("rate"),
                      (F.col("rate") > 0.35).cast("int").alias("drifting"))


@query("j9_orphans", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphans(spark, sf):
    known = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.orphans(table(spark, sf, "lineitem").select("l_orderkey"), known, "l_orderkey").distinct()


@query("j9_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, sf):
    return J.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("j10_members", f"""WITH {KE}, busy AS (SELECT cell_id, day FROM ke GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT event_id, kpi FROM ke SEMI JOIN busy USING (cell_id, day)""")
def members(spark, sf):
    ke = kpi_events(spark, sf)
    busy = ke.groupBy("cell_id", "day").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return J.members(ke, busy, ["cell_id", "day"]).select("event_id", "kpi")


@query("j11_label_rows", f"WITH {KE} SELECT event_id, cell_id, 'rule' AS label_source, 0.9::DOUBLE AS label_confidence FROM ke WHERE is_anomaly = 1")
def label_rows(spark, sf):
    return J.label_rows(kpi_events(spark, sf).select("event_id", "cell_id", "is_anomaly"),
                        F.col("is_anomaly") == 1, "rule", 0.9).drop("is_anomaly")


@query("j11_expand_intervals", f"""WITH {KE}, iv AS (SELECT event_id, date_trunc('hour', ts) AS s, 1 + event_id % 8 AS rops FROM ke WHERE is_anomaly = 1)
SELECT event_id, CAST(epoch(s) AS BIGINT) + 900 * unnest(range(rops)) AS rop_epoch FROM iv""")
def expand_intervals(spark, sf):
    iv = kpi_events(spark, sf).where("is_anomaly = 1").select(
        "event_id", F.date_trunc("hour", "ts").alias("s"), (1 + F.col("event_id") % 8).cast("int").alias("rops"))
    iv = iv.withColumn("e", F.col("s") + F.make_dt_interval(mins=F.col("rops") * 15))
    return J.expand_intervals(iv, "s", "e").select("event_id", F.unix_timestamp("rop_ts").alias("rop_epoch"))


CDR = """cdr AS (SELECT o_custkey AS caller, l_partkey AS callee, CASE WHEN l_returnflag = 'A' THEN 'sms' ELSE 'voice' END AS type,
 l_quantity AS duration, o_orderdate AS ts FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def call_records(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select(
        F.col("o_custkey").alias("caller"), F.col("l_partkey").alias("callee"),
        F.when(F.col("l_returnflag") == "A", "sms").otherwise("voice").alias("type"),
        F.col("l_quantity").alias("duration"), F.col("o_orderdate").alias("ts"))


@query("j12_resolve_endpoints", f"""WITH {CDR} SELECT caller, callee, count(*) AS n FROM cdr WHERE caller IN (SELECT c_custkey FROM customer)
 AND callee IN (SELECT c_custkey FROM customer) GROUP BY 1, 2""")
def resolve_endpoints(spark, sf):
    out = J.resolve_endpoints(call_records(spark, sf), table(spark, sf, "customer"), "c_custkey", ["caller", "callee"])
    return out.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))


@query("j13_valid_topology", f"""WITH {KE}, sn AS (SELECT cluster_id, min(ts) AS ts, count(DISTINCT cell_id) AS cells FROM ke GROUP BY cluster_id, dayofyear(ts) // 5)
SELECT event_id, sn.cells AS cells FROM ke ASOF LEFT JOIN sn ON ke.cluster_id = sn.cluster_id AND ke.ts >= sn.ts""")
def valid_topology(spark, sf):
    ke = kpi_events(spark, sf)
    snaps = ke.groupBy("cluster_id", F.floor(F.dayofyear("ts") / 5).alias("p")).agg(
        F.min("ts").alias("ts"), F.countDistinct("cell_id").alias("cells"))
    return J.as_of(ke.select("event_id", "cluster_id", "ts"), snaps, ["cluster_id"], "ts", ["cells"]).select("event_id", "cells")


@query("j14_skew_check", f"""WITH {KE}, a AS (SELECT cell_id, day, avg(kpi) AS offline FROM ke GROUP BY 1, 2),
b AS (SELECT cell_id, day, avg(kpi + CASE WHEN event_id % 90 = 0 THEN 0.5 ELSE 0 END) AS online FROM ke WHERE cell_id % 40 <> 7 GROUP BY 1, 2)
SELECT cell_id, CAST(day AS VARCHAR) AS day, {sql_f32('offline')} AS offline, {sql_f32('online')} AS online, {sql_r6('abs(offline - online)')} AS delta
FROM a FULL JOIN b USING (cell_id, day) WHERE offline IS NULL OR online IS NULL OR abs(offline - online) > 0.001""")
def skew_check(spark, sf):
    ke = kpi_events(spark, sf)
    late = F.when(F.col("event_id") % 90 == 0, 0.5).otherwise(0.0)
    a = ke.groupBy("cell_id", "day").agg(F.avg("kpi").alias("kpi"))
    b = ke.where("cell_id % 40 <> 7").groupBy("cell_id", "day").agg(F.avg(F.col("kpi") + late).alias("kpi"))
    out = J.skew_check(a, b, ["cell_id", "day"], "kpi")
    return out.select("cell_id", F.col("day").cast("string").alias("day"), f32(F.col("offline")).alias("offline"),
                      f32(F.col("online")).alias("online"), r6(F.col("delta")).alias("delta"))

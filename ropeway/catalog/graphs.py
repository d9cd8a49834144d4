"""Graph, privacy and document queries."""

from pyspark.sql import functions as F

from ropeway.catalog.aggregates import PROFILE
from ropeway.catalog.base import KE, NRT, kpi_events, query, r6, relations, sql_f32, sql_r6, table
from ropeway.catalog.joins import CDR, call_records
from ropeway.functions.scalar import f32
from ropeway.operators import documents as D, graph as G, privacy as K
from ropeway.operators.aggregates import diurnal_profile
from ropeway.operators.windows import cusum_flag
from ropeway.session import durable

DAILY = KE + f", {NRT}, dk AS (SELECT cell_id, day, avg(kpi) AS kpi FROM ke GROUP BY 1, 2)"


def daily(spark, sf):
    return kpi_events(spark, sf).groupBy("cell_id", "day").agg(F.avg("kpi").alias("kpi"))


def _stats(df, *extra):
    return df.select("cell_id", F.col("day").cast("string").alias("day"), *extra, *[
        f32(F.col(c)).alias(c) for c in ("nbr_mean", "nbr_min", "nbr_max")], f32(F.round("nbr_std", 6)).alias("nbr_std"))


@query("j3_g3_neighbour_statistics", f"""WITH {DAILY} SELECT n.source AS cell_id, CAST(day AS VARCHAR) AS day, {sql_f32('avg(kpi)')} AS nbr_mean, {sql_f32('min(kpi)')} AS nbr_min,
 {sql_f32('max(kpi)')} AS nbr_max, {sql_f32('round(stddev_pop(kpi), 6)')} AS nbr_std FROM nrt n JOIN dk ON dk.cell_id = n.target GROUP BY 1, 2""")
def neighbour_statistics(spark, sf):
    return _stats(G.neighbour_statistics(daily(spark, sf), relations(spark, sf), "cell_id", "day", "kpi"))


@query("g4_neighbour_features", f"""WITH {DAILY}, un AS (SELECT source, target, distance_km FROM nrt UNION SELECT target, source, distance_km FROM nrt),
nn AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance_km, target) AS rn FROM un) WHERE rn <= 3),
st AS (SELECT n.source AS cell_id, day, avg(kpi) AS a, min(kpi) AS b, max(kpi) AS c, stddev_pop(kpi) AS d FROM nn n JOIN dk ON dk.cell_id = n.target GROUP BY 1, 2)
SELECT cell_id, CAST(day AS VARCHAR) AS day, {sql_f32('coalesce(a, kpi)')} AS nbr_mean, {sql_f32('coalesce(b, kpi)')} AS nbr_min, {sql_f32('coalesce(c, kpi)')} AS nbr_max,
 {sql_f32('round(coalesce(d, 0), 6)')} AS nbr_std FROM dk LEFT JOIN st USING (cell_id, day)""")
def neighbour_features(spark, sf):
    near = G.nearest_undirected(relations(spark, sf), "source", "target", "distance_km", k=3)
    return _stats(G.neighbour_features(daily(spark, sf), near, "cell_id", "day", "kpi"))


@query("g1_components", f"""WITH RECURSIVE {NRT}, un AS (SELECT source, target FROM nrt UNION SELECT target, source FROM nrt),
r AS (SELECT source AS id, source AS seen FROM un UNION SELECT un.target, r.seen FROM r JOIN un ON un.source = r.id)
SELECT id, min(seen) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    return G.components(relations(spark, sf), "source", "target")


@query("g2_degrees", f"WITH {NRT} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM nrt UNION ALL SELECT target FROM nrt) GROUP BY 1")
def degrees(spark, sf):
    return G.degrees(relations(spark, sf), "source", "target")


@query("g5_typed_edges", """WITH c AS (SELECT DISTINCT o_custkey AS s, l_suppkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
e AS (SELECT s, t, 'calls' AS edge_type FROM c UNION ALL SELECT t, s, 'rev_calls' FROM c UNION ALL SELECT c_custkey, c_nationkey, 'account' FROM customer)
SELECT edge_type, count(*) AS n, CAST(sum(s) AS BIGINT) AS source_sum, CAST(sum(t) AS BIGINT) AS target_sum FROM e GROUP BY 1""")
def typed_edges(spark, sf):
    calls = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = G.typed_edges([("calls", calls, "o_custkey", "l_suppkey", True),
                         ("account", table(spark, sf, "customer").withColumn("n", F.col("c_nationkey").cast("long")), "c_custkey", "n", False)])
    return out.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum("source").alias("source_sum"), F.sum("target").alias("target_sum"))


@query("g5_node_index", "SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS index FROM (SELECT DISTINCT o_custkey FROM orders)")
def node_index(spark, sf):
    return G.node_index(table(spark, sf, "orders"), "o_custkey")


_CW = CDR + """, w0 AS (SELECT caller, callee, sum(CASE WHEN type = 'voice' THEN 1.0 ELSE 0.5 END::DOUBLE) AS w FROM cdr GROUP BY 1, 2),
cw AS (SELECT caller, callee, w / sum(w) OVER (PARTITION BY caller) AS weight FROM w0)"""


@query("g6_call_weights", f"WITH {_CW} SELECT caller, callee, {sql_f32('weight')} AS weight FROM cw")
def call_weights(spark, sf):
    return G.call_weights(call_records(spark, sf)).withColumn("weight", f32(F.col("weight")))


@query("g6_propagate", f"""WITH {_CW}, m AS (SELECT caller, sum(weight * c_acctbal) AS b FROM cw JOIN customer ON c_custkey = callee GROUP BY 1)
SELECT c_custkey, c_acctbal, {sql_f32('round(coalesce(b, 0), 6)')} AS nbr_c_acctbal FROM customer LEFT JOIN m ON m.caller = c_custkey""")
def propagate(spark, sf):
    feats = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = G.propagate(G.call_weights(call_records(spark, sf)), feats, "c_custkey", ["c_acctbal"])
    return out.withColumn("nbr_c_acctbal", f32(F.round("nbr_c_acctbal", 6)))


@query("g7_mutual_callers", f"WITH {CDR}, e AS (SELECT DISTINCT caller, callee FROM cdr) SELECT x.caller AS a, x.callee AS b FROM e x JOIN e y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller < x.callee")
def mutual_callers(spark, sf):
    return G.reciprocal_edges(call_records(spark, sf), "caller", "callee")


@query("g7_mutual_rings", f"""WITH RECURSIVE {CDR}, e AS (SELECT DISTINCT caller, callee FROM cdr),
mu AS (SELECT x.caller AS s, x.callee AS t FROM e x JOIN e y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller <> x.callee),
r AS (SELECT s AS id, s AS seen FROM mu UNION SELECT mu.t, r.seen FROM r JOIN mu ON mu.s = r.id)
SELECT id, min(seen) AS component FROM r GROUP BY 1""")
def mutual_rings(spark, sf):
    return G.components(
        G.reciprocal_edges(call_records(spark, sf), "caller", "callee"), "a", "b")


@query("g7_shared_device_links", """WITH p AS (SELECT DISTINCT user_id, CAST(props ->> '$.k' AS INTEGER) AS device FROM events), h AS (SELECT device, min(user_id) AS hub FROM p GROUP BY 1 HAVING count(*) > 1)
SELECT DISTINCT hub AS source, user_id AS target FROM p JOIN h USING (device) WHERE user_id <> hub""")
def shared_device_links(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("device"))
    return G.shared_key_links(rows, "user_id", "device")


@query("g7_short_call_suspects", f"""WITH {CDR}, p AS (SELECT caller, callee, count(*) AS n, count(*) FILTER (duration < 20) AS s FROM cdr WHERE type = 'voice' GROUP BY 1, 2)
SELECT caller, count(*) AS contacts, {sql_r6('sum(s) / sum(n)')} AS short_share, {sql_r6('avg(CAST(n = 1 AS INTEGER))')} AS one_off_share,
 CAST(sum(s) / sum(n) >= 0.5 AND count(*) >= 20 AS INTEGER) AS suspect FROM p GROUP BY 1""")
def short_call_suspects(spark, sf):
    out = G.short_call_suspects(call_records(spark, sf), short_below=20)
    return out.withColumns({c: r6(F.col(c)) for c in ("short_share", "one_off_share")})


@query("g8_ring_recall", f"""WITH p AS (SELECT c_nationkey AS ring, count(*) AS members, sum(CAST(c_acctbal > 4500 AS INTEGER)) AS flagged FROM customer GROUP BY 1)
SELECT ring, members, CAST(flagged AS BIGINT) AS flagged, {sql_r6('flagged / members')} AS rate, CAST(flagged / members >= 0.5 AS INTEGER) AS detected,
 {sql_r6('avg(CAST(flagged / members >= 0.5 AS INTEGER)) OVER ()')} AS overall, CAST(avg(CAST(flagged / members >= 0.5 AS INTEGER)) OVER () >= 0.7 AS INTEGER) AS gate_passed FROM p""")
def ring_recall(spark, sf):
    c = table(spark, sf, "customer")
    out = G.ring_recall(c.select(F.col("c_nationkey").alias("ring"), "c_custkey"),
                        c.select("c_custkey", (F.col("c_acctbal") > 4500).cast("int").alias("flag")), "ring", "c_custkey", "flag")
    return out.withColumns({"rate": r6(F.col("rate")), "overall": r6(F.col("overall"))})


def cell_sites(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("cell_id")).distinct().withColumn("site", F.floor(F.col("cell_id") / 12))


BLAST = NRT + """, loc AS (SELECT source AS cell_id, source // 12 AS site FROM cells), bm AS (SELECT source AS cell_id, target AS affected FROM nrt UNION
 SELECT a.cell_id, b.cell_id FROM loc a JOIN loc b ON a.site = b.site AND a.cell_id <> b.cell_id),
bs AS (SELECT loc.cell_id, site, count(affected) AS blast FROM loc LEFT JOIN bm USING (cell_id) GROUP BY 1, 2)"""


@query("g9_blast_sizes", f"WITH {BLAST} SELECT cell_id, site, blast FROM bs")
def blast_sizes(spark, sf):
    return G.blast_sizes(relations(spark, sf), cell_sites(spark, sf), "cell_id", "site")


@query("g9_blast_members", f"WITH {BLAST} SELECT cell_id, affected FROM bm")
def blast_members(spark, sf):
    return G.blast_members(cell_sites(spark, sf), relations(spark, sf), cell_sites(spark, sf), "cell_id", "site")


@query("g10_what_if", f"""WITH {KE}, {PROFILE}, {BLAST}, pr AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'power' ELSE 'tilt' END AS kind, (kpi - 50) / 39.7::DOUBLE AS d,
 CASE WHEN event_type <> 'signup' THEN std END AS std, blast FROM ke JOIN pf ON pf.cell_id = ke.cell_id AND pf.hour = hour(ke.ts) JOIN bs ON bs.cell_id = ke.cell_id),
x AS (SELECT *, CASE WHEN kind = 'tilt' THEN round(d * -0.8, 3) END AS c, CASE WHEN kind = 'tilt' THEN round(d * -0.5, 3) END AS h, CASE WHEN kind = 'power' THEN round(d * 0.8, 3) END AS t FROM pr)
SELECT event_id, CASE WHEN std IS NOT NULL THEN c END AS d_cqi, CASE WHEN std IS NOT NULL THEN h END AS d_handover, CASE WHEN std IS NOT NULL THEN t END AS d_throughput,
 {sql_f32('round(CASE WHEN c IS NOT NULL THEN 1.96 * std * abs(d) * 0.3 END, 6)')} AS half_cqi,
 CASE WHEN std IS NULL OR least(c, h, t) < -2 THEN 'BLOCK' WHEN blast > 10 OR least(c, h, t) < -0.5 THEN 'CAUTION' ELSE 'SAFE' END AS advice FROM x""")
def what_if(spark, sf):
    from ropeway.plans.skew import lookup_join
    ke = kpi_events(spark, sf)
    # the join counts the profile before it reads it
    prof = durable(diurnal_profile(ke, "cell_id", "ts", "kpi").select("cell_id", "hour", "std"))
    pr = ke.select("event_id", "cell_id", F.hour("ts").alias("hour"), F.when(F.col("event_type") == "click", "power").otherwise("tilt").alias("kind"),
                   ((F.col("kpi") - 50) / 39.7).alias("delta"), (F.col("event_type") != "signup").alias("known"))
    pr = lookup_join(pr, prof, ["cell_id", "hour"], "inner").join(
        G.blast_sizes(relations(spark, sf), cell_sites(spark, sf), "cell_id", "site"), "cell_id")
    std = F.when(F.col("known"), F.col("std"))
    out = G.what_if(pr.withColumns({"std_cqi": std, "std_handover": std, "std_throughput": std}))
    return out.select("event_id", "d_cqi", "d_handover", "d_throughput", f32(F.round("half_cqi", 6)).alias("half_cqi"), "advice")


_SNAPS = "sn AS (SELECT DISTINCT dayofyear(ts) // 5 AS snap, user_id AS a, CAST(props ->> '$.k' AS BIGINT) + 100000 AS b FROM events)"


def _snapshots(spark, sf):
    return table(spark, sf, "events").select(
        F.floor(F.dayofyear("ts") / 5).alias("snap"), F.col("user_id").alias("a"),
        (F.get_json_object("props", "$.k").cast("long") + 100000).alias("b")).distinct()


_SIG = _SNAPS + """, dg AS (SELECT snap, id, count(*) AS degree FROM (SELECT snap, a AS id FROM sn UNION ALL SELECT snap, b FROM sn) GROUP BY 1, 2),
sg AS (SELECT snap, count(*) AS cells, count(DISTINCT id // 10) AS sites, avg(degree) AS m, stddev_pop(degree) AS s, quantile_cont(degree, 0.1) AS p10, quantile_cont(degree, 0.25) AS p25,
 quantile_cont(degree, 0.5) AS p50, quantile_cont(degree, 0.75) AS p75, quantile_cont(degree, 0.9) AS p90 FROM dg GROUP BY 1)"""


@query("f14_topology_signature", f"""WITH RECURSIVE {_SIG}, n AS (SELECT snap, count(*) AS edges FROM sn GROUP BY 1),
rc AS (SELECT snap, a AS id, a AS seen FROM sn UNION SELECT x.snap, y.a, rc.seen FROM rc JOIN sn x ON x.snap = rc.snap AND x.a = rc.id JOIN sn y ON y.snap = x.snap AND y.b = x.b),
cp AS (SELECT snap, count(DISTINCT least_seen) AS components FROM (SELECT snap, id, min(seen) AS least_seen FROM rc GROUP BY 1, 2) GROUP BY 1), f AS (SELECT * FROM sg WHERE snap = (SELECT min(snap) FROM sg))
SELECT sg.snap, sg.cells, sg.sites, edges, components, {sql_f32('sg.m')} AS degree_mean, {sql_f32('sg.s')} AS degree_std, {sql_f32('sg.p50')} AS p50,
 {sql_f32('round(sqrt(power(sg.p10 - f.p10, 2) + power(sg.p25 - f.p25, 2) + power(sg.p50 - f.p50, 2) + power(sg.p75 - f.p75, 2) + power(sg.p90 - f.p90, 2)), 6)')} AS distance FROM sg JOIN n USING (snap) JOIN cp USING (snap), f""")
def topology_signature(spark, sf):
    sig = G.topology_signature(_snapshots(spark, sf), "snap", "a", "b", F.floor(F.col("id") / 10))
    out = G.signature_distance(sig, "snap")
    return out.select("snap", "cells", "sites", "edges", "components", *[f32(F.col(c)).alias(c) for c in ("degree_mean", "degree_std", "p50")],
                      f32(F.round("distance", 6)).alias("distance"))


@query("f14_topology_alarm", f"""WITH {_SIG}, f AS (SELECT * FROM sg WHERE snap = (SELECT min(snap) FROM sg)),
d AS (SELECT sg.snap, sqrt(power(sg.p10 - f.p10, 2) + power(sg.p25 - f.p25, 2) + power(sg.p50 - f.p50, 2) + power(sg.p75 - f.p75, 2) + power(sg.p90 - f.p90, 2)) AS x FROM sg, f),
c AS (SELECT snap, sum(x - 0.5) OVER (ORDER BY snap) AS c FROM d), s AS (SELECT snap, c - least(min(c) OVER (ORDER BY snap), 0) AS s FROM c)
SELECT snap, CAST(max(CAST(s > 3 AS INTEGER)) OVER (ORDER BY snap) AS INTEGER) AS alarm FROM s""")
def topology_alarm(spark, sf):
    sig = G.topology_signature(_snapshots(spark, sf), "snap", "a", "b", F.floor(F.col("id") / 10), labelled=False)
    far = G.signature_distance(sig, "snap").withColumn("view", F.lit("network"))
    return cusum_flag(far, ["view"], "snap", "distance").select("snap", "alarm")


@query("k1_pseudonym", f"""SELECT c_custkey, sha256(unhex('{{outer}}') || unhex(sha256(unhex('{{inner}}') || encode(CAST(c_custkey AS VARCHAR))))) AS token FROM customer""".format(
    **dict(zip(("inner", "outer"), (b.hex() for b in K.padded_keys(b"network-secret"))))))
def pseudonym(spark, sf):
    inner, outer = K.padded_keys(b"network-secret")
    secrets = spark.createDataFrame([(bytearray(inner), bytearray(outer))], "inner binary, outer binary")
    return K.pseudonymise(table(spark, sf, "customer"), "c_custkey", secrets).select("c_custkey", "token")


@query("k2_salted_token", "SELECT c_custkey, substr(sha256('2024Q1' || c_name), 1, 16) AS token FROM customer")
def salted_token(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.salted_token(F.col("c_name"), F.lit("2024Q1")).alias("token"))


@query("k3_query_rate", f"WITH {KE}, x AS (SELECT event_id, count(*) OVER (PARTITION BY cluster_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY cluster_id, ts) + row_number() OVER (PARTITION BY cluster_id, ts ORDER BY event_id) AS recent FROM ke) SELECT event_id, recent, CAST(recent > 10 AS INTEGER) AS limited FROM x")
def query_rate(spark, sf):
    out = K.query_rate(kpi_events(spark, sf).select("event_id", "cluster_id", "ts"), ["cluster_id"], "ts", "event_id", 6 * 3600)
    return out.select("event_id", F.col("recent").cast("long").alias("recent"), "limited")


@query("d1_chunks", """WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents), s AS (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((n - 2048) / 1792), 0) AS BIGINT) + 1)) AS i FROM n)
SELECT doc_id || '_' || i AS chunk_id, length(substr(text, i * 1792 + 1, 2048)) AS n, sha256(substr(text, i * 1792 + 1, 2048)) AS digest FROM s""")
def chunks(spark, sf):
    out = D.chunk(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("chunk_id", F.length("chunk_text").cast("long").alias("n"), F.sha2("chunk_text", 256).alias("digest"))


_MV = """mv AS (SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(embedding[dim]) AS x FROM {src}, range(1, 65) d(dim) GROUP BY 1, 2) GROUP BY 1)"""


@query("d2_nearest_vectors", f"""WITH {_MV.format(src='embeddings')}, s AS (SELECT CAST(mv.label AS BIGINT) AS query_id, vec_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS s FROM embeddings, mv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rn FROM s) SELECT query_id, vec_id, {sql_r6('s')} AS score, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 5""")
def nearest_vectors(spark, sf):
    emb = table(spark, sf, "embeddings")
    q = D.mean_vectors(emb, "label", "embedding").withColumn("query_id", F.col("label").cast("long"))
    return D.nearest_vectors(emb, q, "vec_id", "query_id", "embedding").withColumn("score", r6(F.col("score")))


@query("d3_filtered_search", f"""WITH {_MV.format(src='embeddings')}, c AS (SELECT vec_id, embedding FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en' AND source <= 'src30'),
s AS (SELECT CAST(mv.label AS BIGINT) AS query_id, vec_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS s FROM c, mv), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rn FROM s)
SELECT query_id, vec_id, {sql_r6('s')} AS score FROM r WHERE rn <= 3""")
def filtered_search(spark, sf):
    emb = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").where("lang = 'en' AND source <= 'src30'").select(F.col("doc_id").alias("vec_id"))
    q = D.mean_vectors(emb, "label", "embedding").withColumn("query_id", F.col("label").cast("long"))
    return D.nearest_vectors(emb.join(docs, "vec_id", "left_semi"), q, "vec_id", "query_id", "embedding", k=3).select(
        "query_id", "vec_id", r6(F.col("score")).alias("score"))


_AL = """al AS (SELECT o_orderkey AS alert_id, ['avg_cqi', 'dl_throughput_mbps', 'handover_success_rate', 'dl_prb_usage_rate', 'rrc_conn_setup_success_rate'][CAST(o_custkey % 5 AS INTEGER) + 1] AS k,
 CASE WHEN o_totalprice > 250000 THEN 'RED' ELSE 'YELLOW' END AS sev, CASE o_orderstatus WHEN 'F' THEN 'backhaul' WHEN 'O' THEN 'load' END AS cause,
 CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 10) / 10.0::DOUBLE END AS conf, o_totalprice FROM orders)"""


def alerts(spark, sf):
    """Orders as alert cards with an attribution map."""
    names = list(D.KPI_TERMS)
    kpi = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % 5 + 1).cast("int"))
    shap = F.create_map(F.concat(F.lit("peer_zscore_"), kpi), -F.lit(3.0), F.lit("rolling_other"), F.lit(1.0))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("alert_id"), shap.alias("shap"), (F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_totalprice") > 250000, "RED").otherwise("YELLOW").alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "backhaul").when(F.col("o_orderstatus") == "O", "load").alias("cause"),
        F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 10) / F.lit(10.0)).alias("confidence"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("N"), F.col("o_custkey").cast("string"))).alias("node"), "o_custkey")


_CASE = lambda terms, col: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in terms.items()) + " END"


@query("d4_retrieval_query", f"""WITH {_AL} SELECT alert_id, {_CASE(D.KPI_TERMS, 'k')} || ' ' || sev || ' anomaly investigation' || CASE WHEN cause IS NOT NULL AND (conf IS NULL OR conf >= 0.72)
 THEN ' ' || {_CASE(D.CAUSE_TERMS, 'cause')} || CASE WHEN alert_id % 7 = 0 THEN ' node N' || o_custkey ELSE '' END ELSE '' END AS query FROM al JOIN orders ON o_orderkey = alert_id""")
def retrieval_query(spark, sf):
    a = alerts(spark, sf)
    q = D.retrieval_query(D.main_feature(F.col("shap")), F.col("severity"), F.col("cause"), F.col("confidence"), F.col("node"))
    return a.select("alert_id", q.alias("query"))


_CH = """ch AS (SELECT doc_id, substr(text, i * 1792 + 1, 2048) AS t FROM (SELECT doc_id, text, unnest(range(CAST(greatest(ceil((length(text) - 2048) / 1792), 0) AS BIGINT) + 1)) AS i FROM documents))"""


def _faith(spark, sf):
    c = D.chunk(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return D.faithfulness(c.withColumn("kpi", F.lit("handover_rate_license")), "doc_id", "chunk_text", "kpi")


_FA = _CH + """, fa AS (SELECT doc_id, round(avg(CAST(contains(lower(t), 'handover') OR contains(lower(t), 'rate') OR contains(lower(t), 'license') AS INTEGER)), 3) AS f, count(*) AS n FROM ch GROUP BY 1)"""


@query("d5_faithfulness", f"WITH {_FA} SELECT doc_id, f AS faithfulness, n AS chunks FROM fa")
def faithfulness(spark, sf):
    return _faith(spark, sf)


@query("d5_retrieval_gate", f"WITH {_FA} SELECT round(avg(f), 4) AS avg_faithfulness, 1.0::DOUBLE AS avg_precision, count(*) AS n, CAST(avg(f) >= 0.85 AS INTEGER) AS gate_passed FROM fa")
def retrieval_gate(spark, sf):
    return D.retrieval_gate(_faith(spark, sf))


TEMPLATES = [
    ("avg_cqi", "{cell} quality index off by {delta} (score {score})", "inspect site"),
    ("dl_throughput_mbps", "{cell} throughput off by {delta} (score {score})", "check transport"),
    (None, "{cell} scored {score}", "review"),
]
_TEXT = {k: "'" + t.replace("{cell}", "' || alert_id || '").replace("{delta}", "' || (o_custkey % 9) || '").replace("{score}", "' || format('{:.2f}', o_totalprice / 500000) || '") + "'" for k, t, _ in TEMPLATES}


@query("d6_narration", f"WITH {_AL} SELECT alert_id, CASE k " + " ".join(f"WHEN '{k}' THEN {t}" for k, t in _TEXT.items() if k) + f" ELSE {_TEXT[None]} END AS narrative, CASE k "
       + " ".join(f"WHEN '{k}' THEN '{a}'" for k, _, a in TEMPLATES if k) + f" ELSE '{TEMPLATES[-1][2]}' END AS action FROM (SELECT al.*, o_custkey FROM al JOIN orders ON o_orderkey = alert_id)")
def narration(spark, sf):
    a = alerts(spark, sf).withColumns({"kpi": D.main_feature(F.col("shap")), "delta": F.col("o_custkey") % 9, "score": F.col("price") / 500000})
    templates = spark.createDataFrame(TEMPLATES, "kpi string, template string, action string")
    return D.narration(a, templates, "alert_id", "kpi", "delta", "score").select("alert_id", "narrative", "action")


@query("d7_injection", "SELECT conv_id, turn, CAST(" + " OR ".join(f"contains(lower(text), '{m}')" for m in D.INJECTION_MARKS) + " AS INTEGER) AS injection FROM conversations")
def injection(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", D.injection(F.col("text")).cast("int").alias("injection"))


@query("d8_prompt_record", f"""SELECT conv_id, turn, substr(sha256(text), 1, 16) AS prompt_hash, {sql_f32('(length(text) // 4 + 50) / 1000.0::DOUBLE * 0.0008::DOUBLE')} AS cost,
 CAST(least(length(text) / 500.0::DOUBLE, 1.0) >= 0.85 AND NOT (""" + " OR ".join(f"contains(lower(text), '{m}')" for m in D.INJECTION_MARKS) + ") AS INTEGER) AS passed FROM conversations")
def prompt_record(spark, sf):
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.floor(F.length("text") / 4).alias("tin"), F.lit(50).alias("tout"),
        F.least(F.length("text") / F.lit(500.0), F.lit(1.0)).alias("faith"))
    out = D.prompt_record(df, "text", "faith", "tin", "tout")
    return out.select("conv_id", "turn", "prompt_hash", f32(F.col("cost")).alias("cost"), "passed")


@query("d9_embedding_drift", f"""WITH p AS (SELECT label AS grp, vec_id % 2 AS label, embedding FROM embeddings), q AS (SELECT grp, label, dim, avg(embedding[dim]) AS x FROM p, range(1, 65) d(dim) GROUP BY 1, 2, 3),
v AS (SELECT grp, label, list(x ORDER BY dim) AS v FROM q GROUP BY 1, 2)
SELECT a.grp AS label, {sql_r6('list_cosine_similarity(a.v, b.v)')} AS similarity FROM v a JOIN v b ON a.grp = b.grp AND a.label = 0 AND b.label = 1""")
def embedding_drift(spark, sf):
    emb = table(spark, sf, "embeddings")
    period = lambda i, n: D.mean_vectors(emb.where(F.col("vec_id") % 2 == i), "label", "embedding").withColumnRenamed("embedding", n)
    return period(0, "a").join(period(1, "b"), "label").select("label", r6(D.cosine(F.col("a"), F.col("b"))).alias("similarity"))

"""Rule, routing and state-machine queries."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, NRT, SC, kpi_events, query, r6, relations, scored_events, sql_r6, table
from ropeway.operators import graph as G, rules as R

_CARD = """cd AS (SELECT s_suppkey AS model, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'svc-bot' ELSE s_name END AS approved_by, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 10000 END AS achieved_auc,
 0.4::DOUBLE AS target_auc, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal / 12000 END AS achieved_f1, 0.3::DOUBLE AS target_f1, s_suppkey % 5 AS n_sources, CASE WHEN s_nationkey % 2 = 0 THEN 'high_risk' ELSE 'limited_risk' END AS risk,
 s_nationkey % 3 = 0 AS oversight, s_name AS description FROM supplier)"""


def cards(spark, sf):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        k.alias("model"), F.when(k % 4 == 0, None).when(k % 4 == 1, "svc-bot").otherwise(F.col("s_name")).alias("approved_by"),
        F.when(k % 7 != 0, b / 10000).alias("achieved_auc"), F.lit(0.4).alias("target_auc"),
        F.when(k % 9 != 0, b / 12000).alias("achieved_f1"), F.lit(0.3).alias("target_f1"),
        F.slice(F.array(*[F.lit(f"s{i}") for i in range(5)]), F.lit(1), (k % 5).cast("int")).alias("data_sources"),
        F.when(F.col("s_nationkey") % 2 == 0, "high_risk").otherwise("limited_risk").alias("risk"),
        (F.col("s_nationkey") % 3 == 0).alias("oversight"), F.col("s_name").alias("description"), F.lit("ran").alias("squad"))


@query("r1_promotion_issues", f"""WITH {_CARD} SELECT model, concat_ws(';', CASE WHEN approved_by IS NULL THEN 'not approved' END, CASE WHEN achieved_auc IS NULL THEN 'no evaluation metrics' WHEN achieved_auc < target_auc THEN 'auc below target' END,
 CASE WHEN achieved_f1 IS NULL THEN 'f1 not recorded' WHEN achieved_f1 < target_f1 THEN 'f1 below target' END, CASE WHEN n_sources = 0 THEN 'no data sources' END, CASE WHEN risk = 'high_risk' AND approved_by IS NULL THEN 'high risk needs approval' END) AS issues FROM cd""")
def promotion_issues(spark, sf):
    return cards(spark, sf).select("model", F.concat_ws(";", R.promotion_issues()).alias("issues"))


_WR = """wr AS (SELECT DISTINCT l_suppkey AS model, l_partkey AS parameter, CASE WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS direction FROM lineitem),
kp AS (SELECT DISTINCT l_suppkey AS model, p_brand || p_type || p_size AS kpi FROM lineitem JOIN part ON l_partkey = p_partkey),
bl AS (SELECT a.model, count(DISTINCT a.parameter) AS conflicts FROM wr a JOIN wr b ON a.parameter = b.parameter AND a.model <> b.model AND a.direction <> b.direction GROUP BY 1),
sh AS (SELECT a.model, count(DISTINCT a.kpi) AS shared_kpis FROM kp a JOIN kp b ON a.kpi = b.kpi AND a.model <> b.model GROUP BY 1),
wc AS (SELECT model, coalesce(conflicts, 0) AS conflicts, coalesce(shared_kpis, 0) AS shared_kpis FROM (SELECT DISTINCT model FROM kp) LEFT JOIN bl USING (model) LEFT JOIN sh USING (model))"""


def _conflicts(spark, sf):
    li = table(spark, sf, "lineitem")
    writes = li.select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("parameter"),
                       F.when(F.col("l_linestatus") == "O", "up").otherwise("down").alias("direction"))
    kpis = li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("model"), F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("kpi"))
    return R.write_conflicts(writes, kpis)


@query("r3_write_conflicts", f"WITH {_WR} SELECT model, conflicts, shared_kpis, CASE WHEN conflicts > 0 THEN 'block' WHEN shared_kpis > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM wc")
def write_conflicts(spark, sf):
    return _conflicts(spark, sf)


@query("r2_promotion_policy", f"""WITH {_CARD}, {_WR}, x AS (SELECT cd.*, coalesce(conflicts, 0) > 0 AS bad, n_sources > 0 AS complete, coalesce(achieved_auc >= target_auc AND achieved_f1 >= target_f1, FALSE) AS good FROM cd LEFT JOIN wc USING (model))
SELECT model, CAST(complete AND good AND NOT bad AND (risk = 'limited_risk' OR (approved_by IS NOT NULL AND oversight)) AND approved_by IS NOT NULL AND NOT starts_with(approved_by, 'svc-') AS INTEGER) AS allow,
 concat_ws(';', CASE WHEN NOT complete THEN 'card incomplete' END, CASE WHEN NOT good THEN 'below target' END, CASE WHEN bad THEN 'write-set conflict' END, CASE WHEN risk = 'high_risk' AND approved_by IS NULL THEN 'high risk needs approval' END) AS violations FROM x""")
def promotion_policy(spark, sf):
    df = cards(spark, sf).join(_conflicts(spark, sf).select("model", "conflicts"), "model", "left").na.fill(0, ["conflicts"])
    p = R.promotion_policy()
    return df.select("model", F.coalesce(p["allow"], F.lit(0)).alias("allow"), F.concat_ws(";", p["violations"]).alias("violations"))


_PRIO = {"1-URGENT": "ANTENNA_TILT_ADJUST", "2-HIGH": "HO_PARAM_CHANGE", "3-MEDIUM": "POWER_REDUCTION", "4-NOT SPECIFIED": "CELL_BLOCK"}
_PR = """pr AS (SELECT o_orderkey AS id, CASE o_orderpriority """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRIO.items()) + """ ELSE 'READ_STATUS' END AS action_type, o_orderkey % 4 AS lvl, o_orderkey % 24 AS hr,
 (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_cells FROM orders),
pv AS (SELECT *, action_type = 'ANTENNA_TILT_ADJUST' AND n_cells > 6 AS a, action_type = 'HO_PARAM_CHANGE' AND (hr + 10) % 24 BETWEEN 7 AND 21 AS b, action_type <> 'READ_STATUS' AND lvl = 0 AS c FROM pr),
pp AS (SELECT *, CASE WHEN a OR b OR c THEN 'DENIED_POLICY' WHEN n_cells = 0 THEN 'AUTO' WHEN lvl = 3 THEN CASE WHEN n_cells <= 6 THEN 'AUTO' ELSE 'SUPERVISOR_REQUIRED' END
 WHEN lvl = 2 THEN CASE WHEN n_cells <= 1 THEN 'AUTO' WHEN n_cells <= 6 THEN 'OPERATOR_REQUIRED' ELSE 'SUPERVISOR_REQUIRED' END
 WHEN lvl = 1 THEN CASE WHEN n_cells > 7 THEN 'SUPERVISOR_REQUIRED' ELSE 'OPERATOR_REQUIRED' END ELSE 'DENIED_POLICY' END AS path FROM pv)"""


def proposals(spark, sf):
    o = table(spark, sf, "orders")
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("n"))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _PRIO.items() for x in kv]), F.col("o_orderpriority")), F.lit("READ_STATUS"))
    hour = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.join(cells, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), kind.alias("action_type"), (F.col("o_orderkey") % 4).cast("int").alias("requested_level"),
        (F.date_trunc("day", "o_orderdate") + hour).alias("now"), F.coalesce("n", F.lit(0)).alias("n_cells"), "o_custkey", "o_totalprice")


@query("r4_policy_violations", f"WITH {_PR} SELECT id, concat_ws(';', CASE WHEN a THEN 'tilt on more than one site' END, CASE WHEN b THEN 'handover change in peak hours' END, CASE WHEN c THEN 'write at suggest level' END) AS violations FROM pp")
def policy_violations(spark, sf):
    return proposals(spark, sf).select("id", F.concat_ws(";", R.policy_violations()).alias("violations"))


def routed(spark, sf):
    violated = F.size(R.policy_violations()) > 0
    return proposals(spark, sf).withColumn("path", R.approval_path(F.col("requested_level"), F.col("n_cells"), violated))


@query("r5_approval_path", f"WITH {_PR} SELECT id, n_cells, path FROM pp")
def approval_path(spark, sf):
    return routed(spark, sf).select("id", "n_cells", "path")


@query("r6_lock_decisions")
def lock_decisions(spark, sf):
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    p = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("l_suppkey").alias("cell"), F.col("o_orderdate").alias("ts"))
    return R.lock_decisions(p, "id", "cell", "ts", seconds=300)


_ARB = KE + f", {NRT}, hop AS (SELECT source, target FROM nrt UNION SELECT target, source FROM nrt), rc AS (SELECT source AS cell_id, source AS near FROM cells UNION SELECT source, target FROM hop UNION SELECT a.source, b.target FROM hop a JOIN hop b ON a.target = b.source)" + """,
ap AS (SELECT event_id AS id, cell_id, ts, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS w, CAST(event_type = 'error' AS INTEGER) AS safety, CAST(round(least(kpi / 400, 1.0) * 1e9) AS BIGINT) AS c FROM ke)"""


@query("r7_arbitration", f"""WITH {_ARB}, x AS (SELECT p.id, count(q.id) AS n, max(CAST(q.safety > p.safety OR (q.safety = p.safety AND (q.c > p.c + 50000000 OR (abs(q.c - p.c) <= 50000000 AND q.ts > p.ts))) AS INTEGER)) AS beaten,
 max(CAST(q.id <> p.id AND q.safety = p.safety AND abs(q.c - p.c) <= 50000000 AND q.ts = p.ts AS INTEGER)) AS tied FROM ap p JOIN rc USING (cell_id) JOIN ap q ON q.cell_id = rc.near AND q.w = p.w GROUP BY 1)
SELECT id, CASE WHEN n <= 1 THEN 'unopposed' WHEN beaten = 1 THEN 'suspended' WHEN tied = 1 THEN 'escalate' ELSE 'proceed' END AS verdict FROM x""")
def arbitration(spark, sf):
    p = kpi_events(spark, sf).select(
        F.col("event_id").alias("id"), "cell_id", "ts", F.floor(F.unix_timestamp("ts") / 21600).alias("w"),
        F.col("is_anomaly").alias("safety"), F.least(F.col("kpi") / 400, F.lit(1.0)).alias("confidence"))
    reach = R.two_hop_reach(relations(spark, sf), "source", "target", p.select("cell_id").distinct())
    return R.arbitration(p, reach.toDF("cell_id", "near"), "w", "cell_id").select("id", "verdict")


@query("r8_compatible_releases", """WITH c AS (SELECT p_partkey, (1 + p_size % 3) || '.' || p_partkey % 8 || '.' || p_size || CASE WHEN p_partkey % 11 = 0 THEN '-rc.1' WHEN p_partkey % 13 = 0 THEN '.bad' ELSE '' END AS version, 1 + p_size % 3 AS ma, p_partkey % 8 AS mi, p_size AS pa,
 p_type = 'PROMO' AS blocked, p_brand = 'Brand#3' AS listed, p_partkey % 5 = 0 AS crs, p_partkey % 6 = 0 AS skp FROM part WHERE NOT (p_partkey % 13 = 0 AND p_partkey % 11 <> 0))
SELECT p_partkey, version FROM c WHERE NOT blocked AND NOT listed AND (ma, mi, pa) > (2, 3, 10) AND CASE WHEN ma = 2 THEN mi - 3 <= 1 OR skp ELSE crs END""")
def compatible_releases(spark, sf):
    k = F.col("p_partkey")
    tail = F.when(k % 11 == 0, "-rc.1").when(k % 13 == 0, ".bad").otherwise("")
    cat = table(spark, sf, "part").select(
        "p_partkey", F.concat((1 + F.col("p_size") % 3).cast("string"), F.lit("."), (k % 8).cast("string"), F.lit("."), F.col("p_size").cast("string"), tail).alias("version"),
        (F.col("p_type") == "PROMO").alias("blocked"), F.when(F.col("p_brand") == "Brand#3", F.array(F.lit("2.3.10"))).otherwise(F.array().cast("array<string>")).alias("blocklist"),
        (k % 5 == 0).alias("cross_major_allowed"), (k % 6 == 0).alias("allow_skip"))
    return R.compatible_releases(cat, "2.3.10").select("p_partkey", "version")


@query("r9_breaker_timeline")
def breaker_timeline(spark, sf):
    calls = kpi_events(spark, sf).withColumn("ok", (F.col("event_type") != "error") & (F.col("kpi") <= 500))
    return R.breaker_timeline(calls, "cluster_id", "ts", "event_id", "ok")


@query("r10_budget_breach", "SELECT event_id, CAST(value * 5 > CASE event_type WHEN 'error' THEN 50 WHEN 'view' THEN 500 WHEN 'click' THEN 200 ELSE 3600000 END AS INTEGER) AS breached FROM events")
def budget_breach(spark, sf):
    tier = F.when(F.col("event_type") == "error", "ran_near_rt").when(F.col("event_type") == "view", "ran_non_rt").when(
        F.col("event_type") == "click", "cx_realtime").otherwise("batch_planning")
    return table(spark, sf, "events").select("event_id", R.budget_breach(tier, F.col("value") * 5).alias("breached"))


@query("r11_denied_reads", """WITH r AS (SELECT o_orderkey, o_custkey AS consumer, o_orderpriority AS view FROM orders), g AS (SELECT DISTINCT o_custkey AS consumer, o_orderpriority AS view FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, CAST(split_part(CASE WHEN o_orderkey % 3 = 0 THEN 'ran.kpi.x' ELSE 'misc.kpi.x' END, '.', 1) IN ('ran','cx','fraud','oss','energy') AS INTEGER) AS valid_namespace FROM r ANTI JOIN g USING (consumer, view)""")
def denied_reads(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("consumer"), F.col("o_orderpriority").alias("view"), "o_orderstatus")
    name = F.when(F.col("o_orderkey") % 3 == 0, "ran.kpi.x").otherwise("misc.kpi.x")
    return R.denied_reads(o, o.where("o_orderstatus = 'F'"), ["consumer", "view"]).select("o_orderkey", R.valid_namespace(name).alias("valid_namespace"))


_DAILY = SC + """, dy AS (SELECT cluster_id, day, count(*) FILTER (s1 >= 0.02 AND is_anomaly = 1) AS tp, count(*) FILTER (s1 >= 0.02 AND is_anomaly = 0) AS fp, count(*) FILTER (s1 < 0.02 AND is_anomaly = 1) AS fn FROM sc GROUP BY 1, 2),
ls AS (SELECT cluster_id, day, coalesce(2.0::DOUBLE * sum(tp) OVER w / nullif(2 * sum(tp) OVER w + sum(fp) OVER w + sum(fn) OVER w, 0), 0) AS f FROM dy WINDOW w AS (PARTITION BY cluster_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))"""


@query("r12_loop_state", f"WITH {_DAILY} SELECT cluster_id, CAST(day AS VARCHAR) AS day, {sql_r6('f')} AS rolling_f1, CASE WHEN f < 0.82 THEN 'SUSPENDED' ELSE 'ENABLED' END AS loop_state, CAST(cluster_id % 6 >= 2 AS INTEGER) AS can_simulate, CAST(cluster_id % 6 >= 3 AND f >= 0.82 AS INTEGER) AS can_change FROM ls")
def loop_state(spark, sf):
    hit, y = F.col("s1") >= 0.02, F.col("is_anomaly") == 1
    daily = scored_events(spark, sf).groupBy("cluster_id", "day").agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    out = R.loop_state(daily, "cluster_id", "day")
    level = F.col("cluster_id") % 6
    return out.select("cluster_id", F.col("day").cast("string").alias("day"), r6(F.col("rolling_f1")).alias("rolling_f1"), "loop_state",
                      R.tool_permitted(F.lit("simulation"), level, F.col("loop_state")).alias("can_simulate"),
                      R.tool_permitted(F.lit("reversible"), level, F.col("loop_state")).alias("can_change"))


@query("r13_plan_gate", f"""WITH {_PR}, {NRT}, rc AS (SELECT source AS cell, target AS affected FROM nrt UNION SELECT a.source, b.target FROM nrt a JOIN nrt b ON a.target = b.source),
pj AS (SELECT cell, min(CASE WHEN (affected - cell) > 20 THEN -0.4 ELSE -0.6 END * ((cell % 7) / 4.0::DOUBLE)) AS worst FROM rc GROUP BY 1),
x AS (SELECT pp.id, (o_custkey % 100) / 100.0::DOUBLE AS conf, o_custkey % 150 AS cell, (o_totalprice / 100000.0) - 2 AS delta, path FROM pp JOIN orders ON o_orderkey = id)
SELECT id, CAST(conf >= 0.72 AS INTEGER) AS confident, CAST(coalesce(worst, 0) >= -0.5 AS INTEGER) AS harmless, CAST(NOT starts_with(path, 'DENIED') AS INTEGER) AS permitted, CAST(abs(delta) <= 1.5 AS INTEGER) AS bounded,
 CAST(conf >= 0.72 AND coalesce(worst, 0) >= -0.5 AND NOT starts_with(path, 'DENIED') AND abs(delta) <= 1.5 AS INTEGER) AS go FROM x LEFT JOIN pj USING (cell)""")
def plan_gate(spark, sf):
    p = routed(spark, sf).select(
        "id", "path", ((F.col("o_custkey") % 100) / F.lit(100.0)).alias("confidence"), (F.col("o_custkey") % 150).alias("cell_id"),
        (F.col("o_totalprice") / 100000.0 - 2).alias("delta"), F.lit("tilt").alias("tool"))
    cells = table(spark, sf, "events").select(F.col("user_id").alias("cell_id")).distinct()
    reach = G.blast_members(cells, relations(spark, sf), cells.withColumn("site", F.col("cell_id")), "cell_id", "site", hops=2)
    far = F.when(F.col("affected") - F.col("cell_id") > 20, -0.4).otherwise(-0.6)
    projected = reach.withColumn("d_handover", far * ((F.col("cell_id") % 7) / F.lit(4.0)))
    out = R.plan_gate(p, projected, "cell_id", {"tilt": 1.5})
    return out.select("id", "confident", "harmless", "permitted", "bounded", "go")


@query("r14_deployment_stage", """WITH c AS (SELECT source, count(quality) AS n, avg(quality) AS q FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT *, CASE WHEN n * 8 >= 200 THEN 4 WHEN n * 8 >= 80 THEN 3 WHEN n * 8 >= 40 THEN 2 ELSE 1 END AS stage FROM c)
SELECT source, n AS labelled, CAST(stage AS INTEGER) AS stage, CAST(CASE stage WHEN 1 THEN FALSE WHEN 2 THEN q >= 0.55 WHEN 3 THEN q >= 0.78 ELSE q >= 0.8 AND q >= 0.6 END AS INTEGER) AS passed FROM s""")
def deployment_stage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    c = d.groupBy("source").agg(F.count("quality").alias("labelled"), F.avg("quality").alias("q")).withColumn(
        "stage", R.deployment_stage(F.col("labelled") * 8))
    q = F.col("q")
    return c.select("source", "labelled", "stage", R.stage_gate(F.col("stage"), q, q, q, F.lit(0.5), F.lit(0.04)).alias("passed"))

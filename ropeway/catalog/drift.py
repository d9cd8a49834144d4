"""Drift, data quality, SLO and retraining queries."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, KG, SC, gappy_events, kpi_events, query, r6, scored_events, sql_f32, sql_r6, table
from ropeway.catalog.evaluation import CURVE
from ropeway.functions.scalar import f32
from ropeway.operators import drift as D, evaluate as E, monitoring as M

LONG = """lg AS (SELECT feature, hour(ts) AS hour, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'ref' ELSE 'cur' END AS side, value FROM (
 SELECT ts, 'value' AS feature, value FROM events UNION ALL SELECT ts, 'k', CAST(props ->> '$.k' AS DOUBLE) FROM events
 UNION ALL SELECT ts, 'growth', value * (1 + dayofmonth(ts) / 10.0::DOUBLE) FROM events))"""


#: Fixed value: p-value below which an hour differs.
KS_P_VALUE = 0.01


def samples(spark, sf, *more):
    v = F.col("value")
    feats = F.explode(F.create_map(
        F.lit("value"), v, F.lit("k"), F.get_json_object("props", "$.k").cast("double"),
        F.lit("growth"), v * (1 + F.dayofmonth("ts") / F.lit(10.0)))).alias("feature", "value")
    return table(spark, sf, "events").select(
        F.hour("ts").alias("hour"),
        F.when(F.col("ts") < "2024-01-16", "ref").otherwise("cur").alias("side"), *more, feats)


def _dist(groups):
    g = ", ".join(groups)
    return f"""ct AS (SELECT {g}, value, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM lg GROUP BY {g}, value),
cd AS (SELECT {g}, value, nr, nc, abs(sum(nr) OVER w / sum(nr) OVER (PARTITION BY {g}) - sum(nc) OVER w / sum(nc) OVER (PARTITION BY {g})) AS gap,
 lead(value) OVER (PARTITION BY {g} ORDER BY value) - value AS step FROM ct WINDOW w AS (PARTITION BY {g} ORDER BY value ROWS UNBOUNDED PRECEDING)),
ds AS (SELECT {g}, sum(gap * coalesce(step, 0)) AS distance, max(gap) AS ks, sum(nr) AS n_ref, sum(nc) AS n_cur FROM cd GROUP BY {g}),
st AS (SELECT {g}, min(value) FILTER (side = 'ref') AS lo, max(value) FILTER (side = 'ref') AS hi, avg(value) FILTER (side = 'ref') AS ref_mean,
 avg(value) FILTER (side = 'cur') AS cur_mean, stddev_pop(value) FILTER (side = 'ref') AS ref_std, stddev_pop(value) FILTER (side = 'cur') AS cur_std FROM lg GROUP BY {g})"""


PSI = """bn AS (SELECT feature, CAST(least(greatest(floor((value - lo) / (hi - lo) * 10), 0), 9) AS INTEGER) AS bin,
 count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM lg JOIN (SELECT feature, lo, hi FROM st) USING (feature) GROUP BY 1, 2),
bt AS (SELECT feature, r / (sum(r) OVER (PARTITION BY feature) + 1e-7) AS r, c / (sum(c) OVER (PARTITION BY feature) + 1e-7) AS c FROM bn),
ps AS (SELECT feature, sum((greatest(c, 1e-7) - greatest(r, 1e-7)) * ln(greatest(c, 1e-7) / greatest(r, 1e-7))) AS psi FROM bt GROUP BY 1)"""


@query("f1_psi", f"WITH {LONG}, {_dist(['feature'])}, {PSI} SELECT feature, {sql_r6('psi')} AS psi FROM ps")
def psi(spark, sf):
    return D.psi(samples(spark, sf), ["feature"]).select("feature", r6(F.col("psi")).alias("psi"))


@query("f2_wasserstein", f"WITH {LONG}, {_dist(['feature'])} SELECT feature, {sql_r6('distance / (hi - lo)')} AS score FROM ds JOIN st USING (feature)")
def wasserstein(spark, sf):
    return D.min_max_distance(samples(spark, sf), ["feature"]).select("feature", r6(F.col("score")).alias("score"))


@query("f3_f4_feature_report", f"""WITH {LONG}, {_dist(['feature'])}, {PSI}, o AS (SELECT *, distance / greatest(ref_std, 1e-6) AS wd FROM ds JOIN st USING (feature) JOIN ps USING (feature)),
z AS (SELECT feature, psi, wd, ref_mean, cur_mean, ref_std, cur_std, CASE WHEN psi < 0.1 THEN 'OK' WHEN psi < 0.25 THEN 'YELLOW' ELSE 'RED' END AS psi_status,
 CASE WHEN wd < 0.15 THEN 'OK' WHEN wd < 0.35 THEN 'YELLOW' ELSE 'RED' END AS wass_status FROM o)
SELECT feature, {sql_r6('psi')} AS psi, {sql_r6('wd')} AS wasserstein, psi_status, wass_status, {sql_f32('ref_mean')} AS ref_mean, {sql_f32('cur_mean')} AS cur_mean,
 {sql_f32('ref_std')} AS ref_std, {sql_f32('cur_std')} AS cur_std, CAST(max(CAST(psi_status = 'RED' OR wass_status = 'RED' AS INTEGER)) OVER () AS INTEGER) AS retrain FROM z""")
def feature_report(spark, sf):
    out = D.feature_report(samples(spark, sf))
    return out.select("feature", *[r6(F.col(c)).alias(c) for c in ("psi", "wasserstein")], "psi_status", "wass_status",
                      *[f32(F.col(c)).alias(c) for c in ("ref_mean", "cur_mean", "ref_std", "cur_std")], "retrain")


@query("f5_model_report", f"""WITH {LONG}, {_dist(['feature'])}, s AS (SELECT feature, round(distance / (hi - lo), 4) AS score FROM ds JOIN st USING (feature)),
o AS (SELECT round(avg(score), 4) AS overall, count(*) AS n_features, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (score >= 0.3), '') AS drifted FROM s)
SELECT overall, n_features, drifted, CASE WHEN overall >= 0.5 THEN 'critical' WHEN overall >= 0.3 THEN 'alert' WHEN overall >= 0.15 THEN 'warn' ELSE 'ok' END AS status,
 CAST(overall >= 0.3 AS INTEGER) AS retrain FROM o""")
def model_report(spark, sf):
    return D.model_report(samples(spark, sf)).withColumn("drifted", F.concat_ws(",", "drifted"))


@query("f6_hourly_drift", f"WITH {LONG}, {_dist(['feature', 'hour'])} SELECT feature, CAST(hour AS INTEGER) AS hour, {sql_r6('distance / (hi - lo)')} AS score FROM ds JOIN st USING (feature, hour)")
def hourly_drift(spark, sf):
    return D.min_max_distance(samples(spark, sf), ["feature", "hour"]).select("feature", "hour", r6(F.col("score")).alias("score"))


@query("f7_robust_drift", f"""WITH {LONG}, {_dist(['feature'])}, q AS (SELECT feature, quantile_cont(value, 0.05) FILTER (side = 'ref') AS a, quantile_cont(value, 0.95) FILTER (side = 'ref') AS b,
 quantile_cont(value, 0.99) FILTER (side = 'cur') AS c FROM lg GROUP BY 1)
SELECT feature, {sql_r6('distance / (b - a)')} AS robust_score, {sql_r6('distance / (hi - lo)')} AS score, CAST(c > hi * 1.5 OR distance / (hi - lo) > 1.0 AS INTEGER) AS data_quality_alert
FROM ds JOIN st USING (feature) JOIN q USING (feature)""")
def robust_drift(spark, sf):
    out = D.robust_distance(samples(spark, sf), ["feature"])
    return out.select("feature", r6(F.col("robust_score")).alias("robust_score"), r6(F.col("score")).alias("score"), "data_quality_alert")


@query("f8_ks_test", f"""WITH {LONG.replace("hour(ts) AS hour", "hour(ts) AS hour, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot")},
sl AS (SELECT DISTINCT feature, hour, slot FROM lg WHERE side = 'cur' AND value IS NOT NULL),
pr AS (SELECT sl.feature, sl.hour, sl.slot, value, 1 AS r, 0 AS c FROM sl JOIN lg USING (feature, hour) WHERE side = 'ref' AND value IS NOT NULL
 UNION ALL SELECT feature, hour, slot, value, 0, 1 FROM lg WHERE side = 'cur' AND value IS NOT NULL),
ct AS (SELECT feature, hour, slot, value, sum(r) AS r, sum(c) AS c FROM pr GROUP BY 1, 2, 3, 4),
ds AS (SELECT feature, hour, slot, max(gap) AS ks, sum(r) AS n_ref, sum(c) AS n_cur FROM (SELECT *, abs(sum(r) OVER w / sum(r) OVER g - sum(c) OVER w / sum(c) OVER g) AS gap FROM ct
 WINDOW w AS (PARTITION BY feature, slot ORDER BY value ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY feature, slot)) GROUP BY 1, 2, 3),
p AS (SELECT feature, hour, slot, ks, (SELECT 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * ks * ks * n_ref * n_cur / (n_ref + n_cur))) FROM range(1, 21) t(k)) AS p FROM ds WHERE n_ref > 0),
c AS (SELECT *, least(greatest(p, 0), 1) AS pv FROM p)
SELECT feature, CAST(hour AS INTEGER) AS hour, slot, {sql_r6('ks')} AS ks, {sql_r6('pv')} AS p_value,
 CAST(sum(CAST(pv < {KS_P_VALUE} AS INTEGER)) OVER (PARTITION BY feature ORDER BY slot RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 AS INTEGER) AS sustained FROM c""")
def ks_test(spark, sf):
    from ropeway.operators.windows import sustained
    long = samples(spark, sf, F.floor(F.unix_timestamp("ts") / 3600).alias("slot"))
    d = D.calendar_ks(long.where("side = 'ref'"), long.where("side = 'cur'"), ["feature"], "hour", "slot")
    d = d.withColumn("p_value", D.ks_p_value(F.col("ks"), F.col("n_ref"), F.col("n_cur")))
    out = sustained(d, ["feature"], "slot", F.col("p_value") < KS_P_VALUE, periods=6, position=F.col("slot"))
    return out.select("feature", "hour", "slot", r6(F.col("ks")).alias("ks"), r6(F.col("p_value")).alias("p_value"), "sustained")


@query("f9_quality_profile", f"""WITH {KG} SELECT CAST(epoch(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_epoch, cluster_id, count(*) AS n,
 count(*) FILTER (kpi IS NULL) AS nulls, count(*) FILTER (kpi < 1 OR kpi > 200) AS out_of_range, count(*) FILTER (kpi = 0) AS zeros,
 CAST(count(kpi) > 0 AND count(*) FILTER (kpi = 0) = count(kpi) AS INTEGER) AS all_zero FROM kg GROUP BY 1, 2""")
def quality_profile(spark, sf):
    out = M.quality_profile(gappy_events(spark, sf), ["cluster_id"], "ts", "kpi", 1.0, 200.0)
    return out.withColumn("window_start", F.unix_timestamp("window_start")).withColumnRenamed("window_start", "window_epoch")


@query("f10_freshness", f"""WITH {KE} SELECT cell_id, CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS age_seconds,
 CAST(CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) > 2 * 14400 AS INTEGER) AS stale FROM ke GROUP BY 1""")
def freshness(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return M.freshness(kpi_events(spark, sf), ["cell_id"], "ts", now, 14400)


@query("f11_burn_rate", f"""WITH {KE}, m AS (SELECT cluster_id, CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) AS minute, count(*) AS n, sum(is_anomaly) AS bad FROM ke GROUP BY 1, 2),
r AS (SELECT cluster_id, minute, n, bad, sum(bad) OVER a / sum(n) OVER a / (1 - 0.98::DOUBLE) AS b1, sum(bad) OVER b / sum(n) OVER b / (1 - 0.98::DOUBLE) AS b6, 1 - sum(bad) OVER c / sum(n) OVER c / (1 - 0.98::DOUBLE) AS l
 FROM m WINDOW a AS (PARTITION BY cluster_id ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW), b AS (PARTITION BY cluster_id ORDER BY minute RANGE BETWEEN 359 PRECEDING AND CURRENT ROW),
 c AS (PARTITION BY cluster_id ORDER BY minute RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT cluster_id, minute, n, CAST(bad AS BIGINT) AS bad, {sql_r6('b1')} AS burn_1h, {sql_r6('b6')} AS burn_6h, {sql_r6('l')} AS budget_left,
 CASE WHEN b1 > 14.4 THEN 'P1' WHEN b6 > 6 THEN 'P2' ELSE 'none' END AS priority FROM r""")
def burn_rate(spark, sf):
    out = M.burn_rate(kpi_events(spark, sf), ["cluster_id"], "ts", "is_anomaly", 0.98)
    return out.select("cluster_id", "minute", "n", "bad", *[r6(F.col(c)).alias(c) for c in ("burn_1h", "burn_6h", "budget_left")], "priority")


@query("f12_alert_rules", f"""WITH {KE}, h AS (SELECT cluster_id, CAST(floor(floor(epoch(ts)) / 21600) AS BIGINT) * 21600 AS epoch, avg(is_anomaly) AS error_rate, quantile_cont(kpi, 0.95) AS p95, abs(avg(kpi) - 50) / 50 AS drift FROM ke GROUP BY 1, 2)
SELECT cluster_id, epoch, CAST(sum(CAST(drift > 0.3 AS INTEGER)) OVER w >= 3 AS INTEGER) AS drift_firing, CAST(drift > 0.5 AS INTEGER) AS critical_drift_firing, CAST(sum(CAST(error_rate > 0.05 AS INTEGER)) OVER w >= 3 AS INTEGER) AS error_firing, CAST(sum(CAST(p95 > 150 AS INTEGER)) OVER w >= 3 AS INTEGER) AS latency_firing FROM h
WINDOW w AS (PARTITION BY cluster_id ORDER BY epoch RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW)""")
def alert_rules(spark, sf):
    from ropeway.plans.prefix import exact_quantiles
    ke = kpi_events(spark, sf).withColumn("epoch", F.floor(F.unix_timestamp("ts") / 21600) * 21600)
    p95 = exact_quantiles(ke, ["cluster_id", "epoch"], "kpi", {"p95": 0.95})
    m = ke.groupBy("cluster_id", "epoch").agg(F.avg("is_anomaly").alias("error_rate"), (F.abs(F.avg("kpi") - 50) / 50).alias("drift")).join(p95, ["cluster_id", "epoch"])
    a = M.persistent_breach(m, ["cluster_id"], "epoch", F.col("error_rate") > 0.05, 21600, 3).withColumnRenamed("firing", "error_firing")
    b = M.persistent_breach(a, ["cluster_id"], "epoch", F.col("p95") > 150, 21600, 3).withColumnRenamed("firing", "latency_firing")
    c = M.persistent_breach(b, ["cluster_id"], "epoch", F.col("drift") > 0.30, 21600, 3).withColumnRenamed("firing", "drift_firing")
    d = M.persistent_breach(c, ["cluster_id"], "epoch", F.col("drift") > 0.50, 21600, 1).withColumnRenamed("firing", "critical_drift_firing")
    return d.select("cluster_id", "epoch", "error_firing", "latency_firing", "drift_firing", "critical_drift_firing")


@query("f13_retraining_decision", f"""WITH {CURVE}, {LONG}, {_dist(['feature'])}, s AS (SELECT round(avg(round(distance / (hi - lo), 4)), 4) AS o FROM ds JOIN st USING (feature)),
f AS (SELECT CASE WHEN o >= 0.5 THEN 'critical' WHEN o >= 0.3 THEN 'alert' WHEN o >= 0.15 THEN 'warn' ELSE 'ok' END AS status FROM s),
a AS (SELECT sum(n_neg * (tp - n_pos / 2.0)) / (max(p) * max(n)) AS auc, max(p) + max(n) AS labelled FROM cv),
x AS (SELECT status, labelled >= 50 AND (auc < 0.72 OR coalesce((SELECT f1 FROM cv WHERE score >= 0.1 ORDER BY score LIMIT 1), 0) < 0.6) AS weak FROM a, f)
SELECT CAST(1 AS INTEGER) AS retrain, CASE WHEN status = 'critical' THEN 'drift' WHEN weak THEN 'performance' WHEN status = 'alert' THEN 'drift' ELSE 'scheduled' END AS trigger,
 CASE WHEN status = 'critical' OR weak THEN 'immediate' ELSE 'next_cycle' END AS urgency,
 CAST(CASE WHEN status = 'critical' OR (status = 'alert' AND NOT weak) THEN 15 ELSE 30 END AS INTEGER) AS window_days, 'inactive' AS loop_state FROM x""")
def retraining_decision(spark, sf):
    sc = scored_events(spark, sf)
    auc = E.areas(E.score_counts(sc, [], "score", "is_anomaly"), [], "score").select(
        "roc_auc", (F.col("n_pos") + F.col("n_neg")).alias("labelled"))
    f1 = E.threshold_metrics(sc, [], "score", "is_anomaly", 0.1).select("f1").scalar()
    return D.retraining_decision(D.model_report(samples(spark, sf)).select("status", "overall"), auc.withColumn("f1", f1), F.lit(45))


@query("f15_disagreement", f"""WITH {SC} SELECT cluster_id, {sql_r6('avg(CAST((s1 >= 0.1) <> (s3 < 0.18) AS INTEGER))')} AS rate, CAST(avg(CAST((s1 >= 0.1) <> (s3 < 0.18) AS INTEGER)) > 0.05 AS INTEGER) AS alert FROM sc WHERE is_anomaly = 0 GROUP BY 1""")
def disagreement(spark, sf):
    sc = scored_events(spark, sf).withColumns({"a": F.col("s1") >= 0.1, "b": F.col("s3") < 0.18})
    return M.disagreement(sc, ["cluster_id"], "a", "b", F.col("is_anomaly") == 0).withColumn("rate", r6(F.col("rate")))


@query("f16_canary", """WITH m AS (SELECT median(l_quantity) FILTER (l_suppkey % 2 = 1) AS t, median(l_quantity) FILTER (l_suppkey % 2 = 0) AS c FROM lineitem)
SELECT t AS treated_median, c AS control_median, CAST(t > 1.1 * c AS INTEGER) AS rollback FROM m""")
def canary(spark, sf):
    df = table(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 1, "treated").otherwise("control").alias("arm"), "l_quantity")
    return M.canary(df, "arm", "l_quantity", "treated", "control")

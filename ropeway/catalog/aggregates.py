"""Aggregates, splits, scaling and set operations."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, NRT, SC, kpi_events, query, r6, relations, scored_events, sql_f32, sql_r6, table
from ropeway.catalog.evaluation import CASCADE, RATES, _cascade
from ropeway.catalog.joins import CDR, call_records
from ropeway.functions.scalar import f32
from ropeway.session import scratch_path
from ropeway.operators import aggregates as A, scaling as M, sets as U, splits as T

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _bucket(minutes):
    return f"CAST(epoch(time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '1970-01-01')) AS BIGINT)"


for _label, _min in (("15min", 15), ("1h", 60), ("24h", 1440)):
    @query(f"a1_tumbling_{_label}", f"""WITH {KE} SELECT {_bucket(_min)} AS window_epoch, cluster_id, {sql_f32('avg(kpi)')} AS mean, {sql_f32('quantile_cont(kpi, 0.95)')} AS p95,
 {sql_f32("avg(CAST(event_type <> 'error' AS INTEGER))")} AS success_rate, count(*) FILTER (kpi > 150) AS critical, count(*) AS n FROM ke GROUP BY 1, 2""")
    def tumbling(spark, sf, minutes=_min):
        out = A.tumbling(kpi_events(spark, sf), ["cluster_id"], "ts", "kpi", F.col("kpi") > 150,
                         F.col("event_type") != "error", f"{minutes} minutes")
        return out.select(F.unix_timestamp("window_start").alias("window_epoch"), "cluster_id",
                          *[f32(F.col(c)).alias(c) for c in ("mean", "p95", "success_rate")], "critical", "n")

PROFILE = f"""h AS (SELECT cell_id, hour(ts) AS hour, median(kpi) AS m, coalesce(stddev_samp(kpi), 0) AS s FROM ke GROUP BY 1, 2),
sp AS (SELECT DISTINCT cell_id, x.hour FROM h, range(24) x(hour)), ty AS (SELECT cell_id, median(m) AS tm, median(s) AS ts FROM h GROUP BY 1),
pf AS (SELECT sp.cell_id, CAST(sp.hour AS INTEGER) AS hour, coalesce(m, tm) AS median, coalesce(s, ts) AS std FROM sp LEFT JOIN h USING (cell_id, hour) JOIN ty USING (cell_id))"""


@query("a2_diurnal_profile", f"WITH {KE}, {PROFILE} SELECT cell_id, hour, {sql_f32('median')} AS median, {sql_f32('round(std, 6)')} AS std FROM pf")
def diurnal_profile(spark, sf):
    return A.diurnal_profile(kpi_events(spark, sf), "cell_id", "ts", "kpi").select(
        "cell_id", "hour", f32(F.col("median")).alias("median"), f32(F.round("std", 6)).alias("std"))


@query("a3_feature_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {sql_f32(f'avg({c})')} AS mean, {sql_f32(f'stddev_samp({c})')} AS std, min({c}) AS min, max({c}) AS max, "
    f"{sql_r6(f'100.0 * avg(CAST({c} IS NULL AS INTEGER))')} AS missing_pct, "
    + ", ".join(f"{sql_f32(f'quantile_cont({c}, {p})')} AS {n}" for n, p in A.PROFILE_PROBS.items()) + " FROM lineitem" for c in NUM))
def feature_profile(spark, sf):
    out = A.feature_profile(table(spark, sf, "lineitem"), NUM)
    return out.select("feature", f32(F.col("mean")).alias("mean"), f32(F.col("std")).alias("std"), "min", "max",
                      r6(F.col("missing_pct")).alias("missing_pct"), *[f32(F.col(p)).alias(p) for p in A.PROFILE_PROBS])


_FEATS = ["qty", "gross", "disc", "flat"]
_LF = "lf AS (SELECT l_quantity AS qty, l_quantity * 2.5 + l_tax AS gross, l_discount AS disc, 1.0::DOUBLE AS flat, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"


@query("a4_feature_diagnostics", f"WITH {_LF} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {sql_f32(f'var_samp({f})')} AS variance, {sql_r6(f'corr({f}, y)') if f != 'flat' else 'NULL::DOUBLE'} AS target_corr, "
    f"CAST(var_samp({f}) < 1e-6 AS INTEGER) AS low_variance, '{ {'qty': 'gross', 'gross': 'qty'}.get(f, '') }' AS collinear FROM lf" for f in _FEATS))
def feature_diagnostics(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("qty"), (F.col("l_quantity") * 2.5 + F.col("l_tax")).alias("gross"),
        F.col("l_discount").alias("disc"), F.lit(1.0).alias("flat"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return A.feature_diagnostics(df, _FEATS, "y").withColumns(
        {"variance": f32(F.col("variance")), "target_corr": r6(F.col("target_corr"))})


@query("a5_caller_statistics", f"""WITH {CDR} SELECT caller, count(DISTINCT callee) AS contacts, count(*) AS calls, count(*) FILTER (type = 'sms') AS sms,
 {sql_f32("avg(duration) FILTER (type = 'voice')")} AS mean_voice, {sql_f32("avg(CAST(type = 'sms' AS INTEGER))")} AS sms_ratio, strftime(min(ts), '%Y-%m-%d') AS first_seen FROM cdr GROUP BY 1""")
def caller_statistics(spark, sf):
    return A.caller_statistics(call_records(spark, sf)).withColumns({
        "mean_voice": f32(F.col("mean_voice")), "sms_ratio": f32(F.col("sms_ratio")),
        "first_seen": F.date_format("first_seen", "yyyy-MM-dd")})


@query("a6_false_alarm_grid", f"WITH {SC} SELECT cluster_id, " + ", ".join(
    f"{sql_r6(f'avg(CAST(s1 >= 0.1 AS INTEGER)) FILTER (hour(ts) = {h})')} AS h{h:02d}" for h in range(24)) + " FROM sc WHERE is_anomaly = 0 GROUP BY 1")
def false_alarm_grid(spark, sf):
    out = A.false_alarm_grid(scored_events(spark, sf), "cluster_id", F.hour("ts"), F.col("s1") >= 0.1, "is_anomaly")
    return out.select("cluster_id", *[r6(F.col(str(h))).alias(f"h{h:02d}") for h in range(24)])


PER_CELL = SC + """, pk AS (SELECT cell_id, score, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM sc GROUP BY 1, 2),
pa AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp FROM pk WINDOW w AS (PARTITION BY cell_id ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pc AS (SELECT cell_id, sum(n_pos) AS n_pos, sum(n_neg * (tp - n_pos / 2.0)) / nullif(sum(n_pos) * sum(n_neg), 0) AS auc, sum(n_pos * tp / (tp + fp)) / nullif(sum(n_pos), 0) AS ap FROM pa GROUP BY 1)"""


@query("a7_entity_errors", f"""WITH {PER_CELL}, c AS (SELECT cell_id, count(*) FILTER (score >= 0.1 AND is_anomaly = 1) AS tp, count(*) FILTER (score >= 0.1 AND is_anomaly = 0) AS fp,
 count(*) FILTER (score < 0.1 AND is_anomaly = 0) AS tn, count(*) FILTER (score < 0.1 AND is_anomaly = 1) AS fn, avg(score) AS ms FROM sc GROUP BY 1)
SELECT cell_id, tp, fp, tn, fn, {sql_f32('ms')} AS mean_score, {sql_r6('auc')} AS roc_auc, {sql_r6('coalesce(fp / nullif(fp + tn, 0), 0)')} AS false_alarm_rate,
 {sql_r6('coalesce(fn / nullif(fn + tp, 0), 0)')} AS miss_rate, CAST(coalesce(fp / nullif(fp + tn, 0), 0) > 0.1 AS INTEGER) AS high_far,
 CAST(coalesce(fn / nullif(fn + tp, 0), 0) > 0.3 AS INTEGER) AS high_miss FROM c JOIN pc USING (cell_id)""")
def entity_errors(spark, sf):
    out = A.entity_errors(scored_events(spark, sf), "cell_id", "score", "is_anomaly", 0.1)
    return out.withColumns({"mean_score": f32(F.col("mean_score")), **{c: r6(F.col(c)) for c in ("roc_auc", "false_alarm_rate", "miss_rate")}})


@query("a8_entity_ranking", f"WITH {PER_CELL} SELECT cell_id, {sql_r6('ap')} AS pr_auc, {sql_r6('auc')} AS roc_auc, CAST(n_pos AS BIGINT) AS n_pos FROM pc WHERE n_pos >= 2")
def entity_ranking(spark, sf):
    out = A.entity_ranking(scored_events(spark, sf), "cell_id", "score", "is_anomaly")
    return out.select("cell_id", r6(F.col("pr_auc")).alias("pr_auc"), r6(F.col("roc_auc")).alias("roc_auc"), "n_pos")


@query("a9_detection_rate", f"WITH {SC} SELECT event_type, {sql_r6('avg(CAST(s1 >= 0.1 AS INTEGER))')} AS rate, count(*) AS n FROM sc GROUP BY 1")
def detection_rate(spark, sf):
    return A.detection_rate(scored_events(spark, sf), "event_type", F.col("s1") >= 0.1).withColumn("rate", r6(F.col("rate")))


@query("a10_by_outcome", f"""WITH {SC} SELECT CASE WHEN s3 < 0.2 AND is_anomaly = 1 THEN 'TP' WHEN s3 < 0.2 THEN 'FP' WHEN is_anomaly = 1 THEN 'FN' ELSE 'TN' END AS outcome,
 {sql_f32('quantile_cont(kpi, 0.25)')} AS q1, {sql_f32('quantile_cont(kpi, 0.5)')} AS q2, {sql_f32('quantile_cont(kpi, 0.75)')} AS q3, count(*) AS n FROM sc GROUP BY 1""")
def by_outcome(spark, sf):
    out = A.by_outcome(scored_events(spark, sf), F.col("s3") < 0.2, "is_anomaly", "kpi")
    return out.withColumns({q: f32(F.col(q)) for q in ("q1", "q2", "q3")})


@query("a11_dataset_summary", f"""WITH {KE} SELECT coalesce(CAST(cluster_id AS VARCHAR), 'all') AS cluster, coalesce(event_type, 'all') AS kind, count(DISTINCT cell_id) AS cells,
 count(*) AS n, {sql_r6('avg(is_anomaly)')} AS anomaly_rate FROM ke GROUP BY GROUPING SETS ((cluster_id), (event_type), ())""")
def dataset_summary(spark, sf):
    ke = kpi_events(spark, sf).withColumn("cluster", F.col("cluster_id").cast("string"))
    out = ke.groupingSets([["cluster"], ["event_type"], []], "cluster", "event_type").agg(
        F.countDistinct("cell_id").alias("cells"), F.count(F.lit(1)).alias("n"), r6(F.avg("is_anomaly")).alias("anomaly_rate"))
    return out.select(F.coalesce("cluster", F.lit("all")).alias("cluster"), F.coalesce("event_type", F.lit("all")).alias("kind"), "cells", "n", "anomaly_rate")


@query("a12_serving_metrics", f"""WITH {SC} SELECT cluster_id, event_type, count(*) AS requests, count(*) FILTER (is_anomaly = 1) AS errors, count(*) FILTER (kpi > 100) AS fallbacks,
 {sql_r6('avg(s1)')} AS mean_score, {sql_f32('quantile_cont(kpi, 0.5)')} AS p50, {sql_f32('quantile_cont(kpi, 0.95)')} AS p95, {sql_f32('quantile_cont(kpi, 0.99)')} AS p99 FROM sc GROUP BY 1, 2""")
def serving_metrics(spark, sf):
    out = A.serving_metrics(scored_events(spark, sf), ["cluster_id", "event_type"], "kpi", "s1", F.col("is_anomaly") == 1, F.col("kpi") > 100)
    return out.withColumns({"mean_score": r6(F.col("mean_score")), **{p: f32(F.col(p)) for p in ("p50", "p95", "p99")}})


_TIER = "CASE role WHEN 'user' THEN 'cpu_tabular' WHEN 'assistant' THEN 'llm_rag' ELSE 'agent' END"


@query("a13_cost_attribution", f"""WITH c AS (SELECT {_TIER} AS tier, length(text) AS ms, length(text) // 4 AS tok FROM conversations),
k AS (SELECT tier, CASE tier WHEN 'llm_rag' THEN tok / 1000.0::DOUBLE * 0.0008::DOUBLE WHEN 'agent' THEN 0.02::DOUBLE ELSE 0.000001::DOUBLE END AS cost, ms / 1000.0::DOUBLE AS cpu,
 CASE WHEN tier = 'llm_rag' THEN ms / 1000.0::DOUBLE ELSE 0 END AS gpu FROM c)
SELECT coalesce(tier, 'total') AS tier, {sql_f32('sum(cost)')} AS cost, {sql_f32('sum(gpu)')} AS gpu_seconds, {sql_f32('sum(cpu)')} AS cpu_seconds, count(*) AS records FROM k GROUP BY ROLLUP (tier)""")
def cost_attribution(spark, sf):
    tier = F.when(F.col("role") == "user", "cpu_tabular").when(F.col("role") == "assistant", "llm_rag").otherwise("agent")
    df = table(spark, sf, "conversations").select(
        tier.alias("tier"), F.lit(1).alias("samples"), F.floor(F.length("text") / 4).alias("tokens"), F.length("text").alias("ms"))
    out = A.cost_summary(A.inference_cost(df, "tier", "samples", "tokens", "ms"), "tier")
    return out.withColumns({c: f32(F.col(c)) for c in ("cost", "gpu_seconds", "cpu_seconds")})


@query("a13_cumulative_cost", f"""WITH c AS (SELECT conv_id, turn, {_TIER} AS tier, length(text) // 4 AS tok FROM conversations),
k AS (SELECT *, CASE tier WHEN 'llm_rag' THEN tok / 1000.0::DOUBLE * 0.0008::DOUBLE WHEN 'agent' THEN 0.02::DOUBLE ELSE 0.000001::DOUBLE END AS cost FROM c)
SELECT conv_id, turn, tier, {sql_f32('sum(cost) OVER (PARTITION BY tier ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)')} AS cumulative_cost FROM k""")
def cumulative_cost(spark, sf):
    tier = F.when(F.col("role") == "user", "cpu_tabular").when(F.col("role") == "assistant", "llm_rag").otherwise("agent")
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", tier.alias("tier"), F.lit(1).alias("samples"), F.floor(F.length("text") / 4).alias("tokens"), F.length("text").alias("ms"))
    out = A.cumulative_cost(A.inference_cost(df, "tier", "samples", "tokens", "ms"), ["tier"], "conv_id", ["turn"])
    return out.select("conv_id", "turn", "tier", f32(F.col("cumulative_cost")).alias("cumulative_cost"))


@query("a14_alert_rollup", """SELECT coalesce(r_name, 'all') AS cluster, coalesce(n_name, 'all') AS site, CAST(max(CASE WHEN c_acctbal < 0 THEN 3 WHEN c_acctbal < 1000 THEN 2 ELSE 1 END) AS INTEGER) AS worst,
 count(*) AS n, CAST(grouping(r_name) * 2 + grouping(n_name) AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def alert_rollup(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    rank = F.when(F.col("c_acctbal") < 0, 3).when(F.col("c_acctbal") < 1000, 2).otherwise(1)
    df = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    out = A.alert_rollup(df.withColumn("severity", rank), ["r_name", "n_name"], "severity")
    return out.select(F.coalesce("r_name", F.lit("all")).alias("cluster"), F.coalesce("n_name", F.lit("all")).alias("site"), "worst", "n", "level")


@query("a15_k_anonymity", f"""WITH g AS (SELECT c_nationkey AS nation, o_orderpriority AS priority, count(DISTINCT o_custkey) AS s, avg(o_totalprice) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT nation, priority, CASE WHEN s >= 50 THEN s END AS subjects, {sql_f32('CASE WHEN s >= 50 THEN m END')} AS mean_price, CAST(50 AS INTEGER) AS k FROM g""")
def k_anonymity(spark, sf):
    df = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = A.k_anonymous(df.select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), "o_custkey", "o_totalprice"),
                        ["nation", "priority"], "o_custkey", {"mean_price": F.avg("o_totalprice")}, k=50)
    return out.withColumn("mean_price", f32(F.col("mean_price")))


def _secret(spark):
    """The noise secret as a protected one-row table holds it."""
    path = scratch_path(spark, "secret")
    spark.createDataFrame([("s3cret",)], "secret string").write.parquet(path)
    return spark.read.schema("secret string").parquet(path)


@query("a16_laplace_noise", f"""WITH g AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
u AS (SELECT nation, n, (CAST('0x' || substr(sha256('s3cret|' || nation), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE - 0.5::DOUBLE AS u FROM g)
SELECT nation, n, {sql_r6('n - sign(u) * (1.0 / 0.5) * ln(1 - 2 * abs(u))')} AS noisy, 0.5::DOUBLE AS epsilon FROM u""")
def laplace_noise(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return A.laplace_noise(g, "nation", "n", 0.5, 1.0, _secret(spark)).withColumn("noisy", r6(F.col("noisy")))


@query("a16_budget_ledger", f"""SELECT o_orderpriority AS view, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || quarter(o_orderdate) AS quarter, {sql_f32('count(*) * 0.01')} AS spent,
 CAST(count(*) * 0.01 > 1.1 AS INTEGER) AS exhausted FROM orders GROUP BY 1, 2""")
def budget_ledger(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("view"), "o_orderdate", F.lit(1).alias("u"))
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    out = A.budget_ledger(df, "view", q, "u", 110)
    return out.withColumn("spent", f32(F.col("spent") * 0.01))


@query("a17_run_health", f"""WITH {KE}, r AS (SELECT cluster_id, day, sum(kpi) AS dur, CAST(avg(is_anomaly) > 0.2 AS INTEGER) AS failed FROM ke GROUP BY 1, 2)
SELECT cluster_id, CAST(day AS VARCHAR) AS day, failed AS alert_failed, CAST(sum(failed) OVER (PARTITION BY cluster_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS INTEGER) AS alert_streak,
 coalesce(CAST(dur > 1.2 * quantile_cont(dur, 0.95) OVER (PARTITION BY cluster_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * (2 / 1.2::DOUBLE) AS INTEGER), 0) AS alert_slow FROM r""")
def run_health(spark, sf):
    runs = kpi_events(spark, sf).groupBy("cluster_id", "day").agg(
        F.sum("kpi").alias("dur"), (F.avg("is_anomaly") > 0.2).cast("int").alias("failed"))
    return A.run_health(runs, ["cluster_id"], "day", "failed", "dur").select(
        "cluster_id", F.col("day").cast("string").alias("day"), "alert_failed", "alert_streak", "alert_slow")


@query("a18_node_features", """SELECT s_nationkey AS nation, count(*) AS cells, coalesce(max(CASE WHEN s_nationkey % 5 <> 0 THEN s_acctbal END), 0) AS balance, coalesce(max(s_name), 'unknown') AS s_name FROM supplier GROUP BY 1""")
def node_features(spark, sf):
    df = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), "s_name",
                                             F.when(F.col("s_nationkey") % 5 != 0, F.col("s_acctbal")).alias("balance"))
    return A.node_features(df, "nation", {"balance": 0.0, "s_name": "unknown"})


@query("a19_fingerprint", """SELECT bit_xor(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS hash, CAST(sum(CAST('0x' || substr(h, 16, 8) AS BIGINT)) % 4294967296 AS BIGINT) AS total, count(*) AS rows
 FROM (SELECT sha256(l_orderkey || '|' || l_partkey || '|' || l_linenumber || '|' || l_returnflag) AS h FROM lineitem)""")
def fingerprint(spark, sf):
    return A.fingerprint(table(spark, sf, "lineitem"), [F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")])


@query("a20_metric_summary", f"WITH {CASCADE}, m AS (SELECT {RATES['precision']} AS p, {RATES['recall']} AS r FROM cc) SELECT CAST(p >= 0.7 AND r >= 0.65 AS INTEGER) AS overall_pass, "
       "format('precision {:.3f}, recall {:.3f}, gate {}', p, r, CASE WHEN p >= 0.7 AND r >= 0.65 THEN 'passed' ELSE 'failed' END) AS narrative FROM m")
def metric_summary(spark, sf):
    return A.metric_summary(_cascade(spark, sf), [("precision", 0.70), ("recall", 0.65)]).select("overall_pass", "narrative")


@query("t1_top_n", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def top_n(spark, sf):
    return T.top_n(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "n", "l_suppkey", 20)


@query("t2_top_k_per_group", """SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5""")
def top_k_per_group(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return T.top_k_per_group(df, ["l_suppkey"], F.col("l_extendedprice"), ["l_orderkey", "l_linenumber", "l_partkey"], 5)


def _sql_split(a, b, floor):
    def cut(x):
        e = f"CAST(floor(min(epoch_us(l_shipdate)) + (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) * {x}::DOUBLE) AS BIGINT)"
        return f"({e}) // 900000000 * 900000000" if floor else e
    return f"""WITH b AS (SELECT {cut(a)} AS a, {cut(a + b)} AS b FROM lineitem),
x AS (SELECT epoch_us(l_shipdate) AS us, CASE WHEN epoch_us(l_shipdate) < a THEN 'train' WHEN epoch_us(l_shipdate) < b THEN 'val' ELSE 'test' END AS split, l_returnflag FROM lineitem, b)
SELECT split, count(*) AS rows, min(us) AS first_us, max(us) AS last_us, {sql_r6("avg(CAST(l_returnflag = 'R' AS INTEGER))")} AS label_rate FROM x GROUP BY 1"""


def _split(spark, sf, shares, floor):
    df = table(spark, sf, "lineitem").select("l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    out = T.split_report(T.temporal_split(df, "l_shipdate", shares, floor), "l_shipdate", "y")
    return out.withColumn("label_rate", r6(F.col("label_rate")))


@query("t3_temporal_split", _sql_split(0.6, 0.2, True))
def temporal_split(spark, sf):
    return _split(spark, sf, T.COUNTER_SPLIT, 15)


@query("t3_temporal_split_exact", _sql_split(0.7, 0.15, False))
def temporal_split_exact(spark, sf):
    return _split(spark, sf, T.INVENTORY_SPLIT, None)


@query("t4_gapped_folds", """WITH d AS (SELECT CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS d, (SELECT max(CAST(l_shipdate AS DATE)) - DATE '1970-01-01' FROM lineitem) AS last FROM lineitem),
f AS (SELECT i AS fold, d, last - (3 - i) * 60 AS e FROM d, range(4) t(i)),
r AS (SELECT fold, CASE WHEN d > e - 60 AND d <= e THEN 'val' WHEN d > e - 60 - 2 - 300 AND d <= e - 60 - 2 THEN 'train' END AS role, d FROM f)
SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, CAST(min(d) AS INTEGER) AS first_day, CAST(max(d) AS INTEGER) AS last_day FROM r WHERE role IS NOT NULL GROUP BY 1, 2""")
def gapped_folds(spark, sf):
    df = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    out = T.gapped_folds(df, "day", 4, 300, 60, 2)
    return out.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.unix_date(F.min("day")).alias("first_day"), F.unix_date(F.max("day")).alias("last_day"))


@query("t4_holdout", """WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, max(CAST(l_shipdate AS DATE)) OVER () AS last FROM lineitem)
SELECT CASE WHEN day > last - 14 THEN 'holdout' ELSE 'develop' END AS role, count(*) AS n, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM d GROUP BY 1""")
def holdout(spark, sf):
    df = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return T.last_days_holdout(df, "day").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


@query("t5_positional_split", """WITH f AS (SELECT o_custkey, min(o_orderdate) AS seen FROM orders GROUP BY 1), p AS (SELECT o_custkey, row_number() OVER (ORDER BY seen, o_custkey) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT o_custkey, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM p""")
def positional_split(spark, sf):
    f = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("seen"))
    return T.positional_split(f, "seen", "o_custkey").select("o_custkey", "split")


@query("t6_hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('42|' || o_orderkey), o_orderkey LIMIT 500")
def hash_sample(spark, sf):
    return T.hash_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("t7_percentile_labels", f"WITH {KE} SELECT event_id, CAST(kpi >= (SELECT quantile_cont(kpi, 0.97) FROM ke) AS INTEGER) AS pseudo_label FROM ke")
def percentile_labels(spark, sf):
    return T.percentile_labels(kpi_events(spark, sf), "kpi").select("event_id", "pseudo_label")


_T8 = SC + ", lb AS (SELECT *, CAST(s1 > 0.3 AS INTEGER) AS a, CAST(s3 > 0.2 AS INTEGER) AS b FROM sc)"


@query("t8_combine_labels", f"""WITH {_T8}, bd AS (SELECT min(s1) AS a0, max(s1) AS a1, min(s3) AS b0, max(s3) AS b1 FROM lb)
SELECT event_id, CAST(a + b >= 1 AS INTEGER) AS auto_union, CAST(a + b >= 2 AS INTEGER) AS auto_both, {sql_r6('((s1 - a0) / (a1 - a0 + 1e-10) + (s3 - b0) / (b1 - b0 + 1e-10)) / 2')} AS auto_score FROM lb, bd""")
def combine_labels(spark, sf):
    df = scored_events(spark, sf).withColumns({"a": (F.col("s1") > 0.3).cast("int"), "b": (F.col("s3") > 0.2).cast("int")})
    u = T.combine_labels(df, ["a", "b"], ["s1", "s3"], "union").withColumnRenamed("auto_label", "auto_union").drop("auto_score")
    return T.combine_labels(u, ["a", "b"], ["s1", "s3"], "intersection").select(
        "event_id", "auto_union", F.col("auto_label").alias("auto_both"), r6(F.col("auto_score")).alias("auto_score"))


@query("t8_label_agreement", f"WITH {_T8} " + " UNION ALL ".join(
    f"SELECT '{n}' AS detector, {sql_r6(f'coalesce(2.0::DOUBLE * sum({e} * is_anomaly) / nullif(sum({e}) + sum(is_anomaly), 0), 0)')} AS f1 FROM lb"
    for n, e in (("first", "a"), ("second", "b"), ("union", "greatest(a, b)"))))
def label_agreement(spark, sf):
    df = scored_events(spark, sf).withColumns({"a": (F.col("s1") > 0.3).cast("int"), "b": (F.col("s3") > 0.2).cast("int")})
    long = df.select("is_anomaly", F.explode(F.create_map(F.lit("first"), "a", F.lit("second"), "b", F.lit("union"), F.greatest("a", "b"))).alias("detector", "p"))
    from ropeway.operators.evaluate import confusion, rates
    return confusion(long, ["detector"], F.col("p") == 1, "is_anomaly").select("detector", r6(rates()["f1"]).alias("f1"))


_TRAIN = "(SELECT CAST(floor(min(epoch_us(l_shipdate)) + (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) * 0.6::DOUBLE) AS BIGINT) // 900000000 * 900000000 FROM lineitem)"


def _scale_sql(stats):
    return (f"WITH tr AS (SELECT * FROM lineitem WHERE epoch_us(l_shipdate) < {_TRAIN}), st AS (SELECT " + ", ".join(
        stats.format(c=c) for c in NUM) + " FROM tr) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(
        f"{sql_r6(f'({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END')} AS {c}" for c in NUM) + " FROM lineitem, st")


def _scaled(spark, sf, fit):
    df = T.temporal_split(table(spark, sf, "lineitem"), "l_shipdate")
    stats = fit(df.where("split = 'train'"), NUM)
    return M.apply_scaler(df, stats, NUM).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in NUM])


@query("m1_robust_scaler", _scale_sql("median({c}) AS c_{c}, quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) AS s_{c}"))
def robust_scaler(spark, sf):
    return _scaled(spark, sf, M.fit_robust)


@query("m2_standard_scaler", _scale_sql("avg({c}) AS c_{c}, stddev_pop({c}) AS s_{c}"))
def standard_scaler(spark, sf):
    return _scaled(spark, sf, M.fit_standard)


@query("u1_union", "SELECT l_returnflag AS kind, count(*) AS n, count(extra) AS n_extra FROM (SELECT l_returnflag, NULL AS extra FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_returnflag, l_tax FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def union(spark, sf):
    li = table(spark, sf, "lineitem")
    out = U.append([li.where("l_linestatus = 'O'").select("l_returnflag"),
                    li.where("l_linestatus = 'F'").select("l_returnflag", F.col("l_tax").alias("extra"))])
    return out.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


@query("u2_id_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def id_difference(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return U.difference(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), o)


@query("u3_shared_sets", """WITH s AS (SELECT l_suppkey, list(DISTINCT p_type ORDER BY p_type) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_suppkey, array_to_string(list_filter(w, lambda x: x IN ('ECONOMY', 'LARGE', 'PROMO')), ',') AS shared, CAST(len(list_filter(w, lambda x: x IN ('ECONOMY', 'LARGE', 'PROMO'))) > 0 AS INTEGER) AS overlaps FROM s""")
def shared_sets(spark, sf):
    # a supplier's set of part types is bounded by the catalogue of types
    s = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.collect_set("p_type").alias("w"))
    return U.shared(s, "w", F.array(*[F.lit(x) for x in ("ECONOMY", "LARGE", "PROMO")])).select("l_suppkey", F.concat_ws(",", "shared").alias("shared"), "overlaps")


_SNAP = "SELECT DISTINCT o_custkey AS s, l_suppkey AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) = {y}"


@query("u4_edge_delta", f"""WITH a AS ({_SNAP.format(y=1997)}), b AS ({_SNAP.format(y=1998)}), j AS (SELECT a.s IS NOT NULL AS ina, b.s IS NOT NULL AS inb FROM a FULL JOIN b USING (s, t))
SELECT count(*) FILTER (inb AND NOT ina) AS added, count(*) FILTER (ina AND NOT inb) AS removed, count(*) FILTER (ina AND inb) AS kept,
 CAST(count(*) FILTER (ina <> inb) > 0.05 * count(*) FILTER (ina) AS INTEGER) AS trigger FROM j""")
def edge_delta(spark, sf):
    e = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("s"), F.col("l_suppkey").alias("t"))
    return U.edge_delta(e.where("y = 1997").select("s", "t"), e.where("y = 1998").select("s", "t"))


@query("u5_symmetric_edges", f"WITH {NRT} SELECT source AS a, target AS b FROM nrt UNION SELECT target, source FROM nrt")
def symmetric_edges(spark, sf):
    return U.symmetrise(relations(spark, sf), "source", "target").select(F.col("source").alias("a"), F.col("target").alias("b"))

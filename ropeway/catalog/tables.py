"""Sources, sinks, contracts, uplift and process-rate queries."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, kpi_events, query, r6, sql_f32, sql_r6, table
from ropeway.catalog.joins import FLAGS, confirmed_flags
from ropeway.functions.scalar import f32
from ropeway.operators import privacy, uplift
from ropeway.operators.aggregates import diurnal_profile
from ropeway.operators.joins import next_within
from ropeway.operators.monitoring import rolling_rate
from ropeway.operators.splits import temporal_split
from ropeway.session import scratch_path
from ropeway.sources import alarms, sinks, tables


@query("s1_contract_scan", "SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events")
def contract_scan(spark, sf):
    df = tables.load_counters(spark, f"{sf}/events.parquet", ["event_id", "ts", "user_id", "value"], "ts")
    return df.select("event_id", "user_id", F.unix_micros("ts").alias("us"), "value")


@query("s2_minimal_inventory", "SELECT DISTINCT user_id AS cell_id FROM events")
def minimal_inventory(spark, sf):
    return tables.load_inventory(spark, f"{sf}/no_inventory_here.parquet", kpi_events(spark, sf))


@query("s3_split_table", """WITH b AS (SELECT CAST(floor(min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * 0.6::DOUBLE) AS BIGINT) // 900000000 * 900000000 AS a,
 CAST(floor(min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT) // 900000000 * 900000000 AS b FROM events)
SELECT CASE WHEN epoch_us(ts) < a THEN 'train' WHEN epoch_us(ts) < b THEN 'val' ELSE 'test' END AS split, event_id FROM events, b""")
def split_table(spark, sf):
    path = scratch_path(spark, "splits")
    sinks.write_splits(temporal_split(kpi_events(spark, sf).select("event_id", "ts"), "ts"), path)
    return spark.read.parquet(path).select("split", "event_id")


@query("s4_json_report", f"WITH {KE} SELECT cluster_id, count(*) AS n, max(kpi) AS top FROM ke GROUP BY 1")
def json_report(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_report(kpi_events(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("kpi").alias("top")), path)
    return spark.read.schema("cluster_id int, n bigint, top double").json(path)


def alarm_payloads(spark, sf):
    """Events as alarm JSON: single, offset-bearing, batch of two, and broken text."""
    def event(suffix):
        return F.struct(
            F.struct(F.lit("fault").alias("domain"), F.concat(F.col("event_id").cast("string"), F.lit(suffix)).alias("eventId"),
                     F.col("user_id").cast("string").alias("sourceName"), F.unix_micros("ts").alias("startEpochMicrosec"),
                     F.when(F.col("event_id") % 5 == 0, "UTC+10").alias("timeZoneOffset")).alias("commonEventHeader"),
            F.struct(F.col("event_type").alias("alarmCondition"), F.lit("MAJOR").alias("eventSeverity")).alias("faultFields"))
    k = F.col("event_id")
    text = (F.when(k % 13 == 0, F.lit('{"event": {'))
            .when(k % 13 == 1, F.lit('{"other": 1}'))
            .when(k % 2 == 0, F.to_json(F.struct(F.array(event("a"), event("b")).alias("eventList"))))
            .otherwise(F.to_json(F.struct(event("").alias("event")))))
    return table(spark, sf, "events").select("event_id", text.alias("value")).withColumnRenamed("event_id", "source_row")


_AL = """SELECT event_id AS source_row, CAST(event_id AS VARCHAR) || s AS event_id, CASE WHEN event_id % 2 = 0 OR event_id % 5 = 0 THEN '7.2' ELSE '7.1' END AS version, CAST(user_id AS VARCHAR) AS source_name, epoch_us(ts) AS start_us,
 event_type AS alarm_condition, 'MAJOR' AS severity, 'Normal' AS priority FROM events, (VALUES ('a', 0), ('b', 0), ('', 1)) v(s, m) WHERE event_id % 13 > 1 AND event_id % 2 = m"""


@query("s5_alarms", _AL)
def alarm_rows(spark, sf):
    good, _ = alarms.parse_alarms(alarm_payloads(spark, sf))
    return good.select("source_row", "event_id", "version", "source_name", F.unix_micros("start_ts").alias("start_us"), "alarm_condition", "severity", "priority")


@query("s5_rejects", "SELECT event_id AS source_row FROM events WHERE event_id % 13 <= 1")
def alarm_rejects(spark, sf):
    return alarms.parse_alarms(alarm_payloads(spark, sf))[1].select("source_row")


NAMES = ["dl_mbps", "ul_mbps", "rrc_att", "rrc_succ"]
_MAP = [("va", "click", "dl_mbps", "kbit_volume"), ("va", "view", "ul_mbps", "kbyte_volume"), ("va", "signup", "rrc_att", "count"), ("va", "purchase", "rrc_succ", "count"),
        ("vb", "view", "dl_mbps", "kbyte_volume"), ("vb", "click", "ul_mbps", "rate"), ("vb", "purchase", "rrc_att", "count"), ("vb", "error", "rrc_succ", "count")]


@query("s6_vendor_counters", f"""WITH m(vendor, counter, name, unit) AS (VALUES {', '.join(map(str, _MAP))}),
r AS (SELECT user_id AS cell_id, CAST(ts AS DATE) AS d, name, CASE unit WHEN 'kbit_volume' THEN value / 1000 / 900 WHEN 'kbyte_volume' THEN value * 8 / 1000 / 900 ELSE value END AS v FROM events JOIN m ON counter = event_type AND vendor = CASE WHEN user_id % 2 = 0 THEN 'va' ELSE 'vb' END)
SELECT cell_id, CAST(d AS VARCHAR) AS day, """ + ", ".join(sql_f32(f"max(v) FILTER (name = '{n}')") + f" AS {n}" for n in NAMES) + " FROM r GROUP BY 1, 2")
def vendor_counters(spark, sf):
    mapping = spark.createDataFrame(_MAP, "vendor string, counter string, name string, unit string")
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("cell_id"), F.to_date("ts").cast("string").alias("day"),
        F.when(F.col("user_id") % 2 == 0, "va").otherwise("vb").alias("vendor"), F.col("event_type").alias("counter"), "value")
    out = tables.normalise_counters(raw, mapping, ["cell_id", "day"], NAMES)
    return out.select("cell_id", "day", *[f32(F.col(n)).alias(n) for n in NAMES])


@query("s7_binned_mean", f"SELECT p_brand, {sql_f32('avg(p_size % 16)')} AS mean_bin FROM part GROUP BY 1")
def binned_mean(spark, sf):
    bins = table(spark, sf, "part").withColumn("b", F.col("p_size") % 16)
    wide = bins.groupBy("p_brand").pivot("b", list(range(16))).agg(F.count(F.lit(1)))
    return wide.select("p_brand", f32(tables.binned_mean([F.col(str(i)) for i in range(16)])).alias("mean_bin"))


@query("s9_latest_push", f"WITH {KE}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ts DESC) AS rn FROM ke) SELECT cell_id, epoch_us(ts) AS us, {sql_f32('kpi')} AS kpi FROM r WHERE rn = 1")
def latest_push(spark, sf):
    path = scratch_path(spark, "push")
    df = kpi_events(spark, sf).withColumnRenamed("ts", "event_timestamp")
    sinks.push_features(df, ["kpi"], path)
    return sinks.latest_features(spark, path).select("cell_id", F.unix_micros("event_timestamp").alias("us"), F.col("kpi").cast("double").alias("kpi"))


@query("s10_recent_predictions", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    df = table(spark, sf, "events").select("event_id", "ts", "value")
    half = F.lit("2024-01-16").cast("timestamp")
    sinks.log_predictions(df.where(F.col("ts") < half), path, "ts")
    sinks.log_predictions(df.where(F.col("ts") >= half), path, "ts")
    return sinks.recent_predictions(spark, path, "ts", "event_id", 100).select("event_id", "value")


_FEATURES = [
    ("cell_id", "bigint", "identifier"), ("kpi", "double", "other"), ("day", "date", "temporal"), ("is_anomaly", "int", "label"),
    ("cluster_id", "int", "identifier"), ("dl_throughput_mbps", "double", "raw_kpi"), ("handover_success_rate", "double", "cross_kpi_ratio"),
    ("kpi_is_reset", "int", "data_quality_flag"), ("avg_cqi_peer_zscore", "double", "peer_group_spatial")]


@query("s11_feature_catalogue", f"""WITH {KE}, fe AS (SELECT *, nullif(kpi, 0) AS dl_throughput_mbps, CASE WHEN is_anomaly = 0 THEN kpi END AS handover_success_rate,
 CAST(kpi < 1 AS INTEGER) AS kpi_is_reset, CASE WHEN cluster_id > 4 THEN kpi END AS avg_cqi_peer_zscore FROM ke)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{t}' AS dtype, '{k}' AS category, '{tables.DESCRIPTIONS.get(c, 'Feature column: ' + c)}' AS description, count({c}) AS filled FROM fe"
    for c, t, k in _FEATURES))
def feature_catalogue(spark, sf):
    kpi = F.col("kpi")
    df = kpi_events(spark, sf).withColumns({
        "dl_throughput_mbps": F.nullif(kpi, F.lit(0.0)), "handover_success_rate": F.when(F.col("is_anomaly") == 0, kpi),
        "kpi_is_reset": (kpi < 1).cast("int"), "avg_cqi_peer_zscore": F.when(F.col("cluster_id") > 4, kpi)})
    return tables.feature_catalogue(df.select(*[c for c, _, _ in _FEATURES]))


@query("s12_retention", f"WITH {KE} SELECT CAST(day AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts)) <= 2 * 86400) AS online FROM ke WHERE day > DATE '2024-01-31' - 10 GROUP BY 1")
def retention(spark, sf):
    kept = sinks.retained(kpi_events(spark, sf), "day", F.lit("2024-01-31").cast("date"), 10)
    now = F.lit("2024-01-31").cast("timestamp")
    live = sinks.online_live(kept, "ts", now, 86400).groupBy("day").agg(F.count(F.lit(1)).alias("online"))
    out = kept.groupBy("day").agg(F.count(F.lit(1)).alias("n")).join(live, "day", "left")
    return out.select(F.col("day").cast("string").alias("day"), "n", F.coalesce("online", F.lit(0)).cast("long").alias("online"))


@query("s13_erasure", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def erasure(spark, sf):
    tokens = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    source, target = scratch_path(spark, "store"), scratch_path(spark, "erased")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.parquet(source)
    sinks.erase_from_store(spark, source, target, tokens, "o_custkey")
    return spark.read.parquet(target)


@query("s13_erasure_audit", "SELECT 'orders' AS store, count(*) AS removed FROM orders SEMI JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_acctbal < 0")
def erasure_audit(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return privacy.erasure_audit({"orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "customer": c},
                                 c.where("c_acctbal < 0"), "k").select("store", "removed")


@query("p11_contract_report", """WITH x AS (SELECT count(*) FILTER (l_quantity < 1 - 0.06 OR l_quantity > 49 + 0.06) AS a, count(*) FILTER (l_discount < 0 - 0.01009 OR l_discount > 0.09 + 0.01009) AS b,
 count(*) FILTER (NOT regexp_matches(CAST(l_suppkey AS VARCHAR), '^[0-9]{1,2}$')) AS c, CAST(NOT avg(CAST(l_returnflag = 'R' AS INTEGER)) BETWEEN 0.005 AND 0.08 AS BIGINT) AS d FROM lineitem)
SELECT 'range_l_quantity' AS "check", a AS n_bad, CAST(a = 0 AS INTEGER) AS passed FROM x UNION ALL SELECT 'range_l_discount', b, CAST(b = 0 AS INTEGER) FROM x UNION ALL SELECT 'id_format', c, CAST(c = 0 AS INTEGER) FROM x
 UNION ALL SELECT 'label_rate', d, CAST(d = 0 AS INTEGER) FROM x UNION ALL SELECT 'duplicates', n, CAST(n = 0 AS INTEGER) FROM (SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber))
 UNION ALL SELECT 'orphans', n, CAST(n = 0 AS INTEGER) FROM (SELECT count(*) AS n FROM lineitem ANTI JOIN (SELECT * FROM supplier WHERE s_nationkey <> 3) ON l_suppkey = s_suppkey)
 UNION ALL SELECT 'monotone_time', n, CAST(n = 0 AS INTEGER) FROM (SELECT count(*) FILTER (l_shipdate < p) AS n FROM (SELECT l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS p FROM lineitem))""")
def contract_report(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("flag", (F.col("l_returnflag") == "R").cast("int"))
    inv = table(spark, sf, "supplier").where("s_nationkey <> 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return tables.contract_report(df, {"l_quantity": (1, 49), "l_discount": (0, 0.09)}, "l_suppkey", "^[0-9]{1,2}$",
                                  ["l_orderkey", "l_linenumber"], inv, "flag", (0.005, 0.08), ("l_orderkey", "l_linenumber", "l_shipdate"))


@query("p17_feature_columns", f"SELECT {', '.join(f'{sql_f32(f'avg({c})')} AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} FROM lineitem")
def feature_columns(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = tables.numeric_features(df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return df.agg(*[f32(F.avg(c)).alias(c) for c in cols])


@query("p19_absent_periods", """WITH s AS (SELECT DISTINCT user_id AS cell_id, CAST(floor(floor(epoch(ts)) / 21600) AS BIGINT) AS slot FROM events), b AS (SELECT min(slot) AS a, max(slot) AS z FROM s),
g AS (SELECT cell_id, t.slot, CAST(s.slot IS NOT NULL AS INTEGER) AS present FROM (SELECT DISTINCT cell_id FROM s) c CROSS JOIN (SELECT unnest(range(a, z + 1)) AS slot FROM b) t LEFT JOIN s USING (cell_id, slot))
SELECT cell_id, slot, present, CAST(coalesce(present = 0 AND lag(present) OVER (PARTITION BY cell_id ORDER BY slot) = 0, FALSE) AS INTEGER) AS absent FROM g""")
def absent_periods(spark, sf):
    return tables.absent_periods(kpi_events(spark, sf), "cell_id", "ts", 21600)


@query("p19_availability", """WITH s AS (SELECT DISTINCT user_id AS cell_id, CAST(floor(floor(epoch(ts)) / 21600) AS BIGINT) AS slot FROM events), b AS (SELECT min(slot) AS a, max(slot) AS z, count(DISTINCT cell_id) AS c FROM s),
d AS (SELECT slot // 4 AS day, count(*) AS n FROM s GROUP BY 1), g AS (SELECT unnest(range(a, z + 1)) // 4 AS day FROM b), t AS (SELECT day, count(*) AS k FROM g GROUP BY 1)
SELECT CAST(t.day AS BIGINT) AS day, round(coalesce(n, 0) / (k * c), 6) + 0.0 AS availability, CAST(coalesce(n, 0) / (k * c) >= 0.995 AS INTEGER) AS met FROM t LEFT JOIN d USING (day), b""")
def availability(spark, sf):
    grid = tables.absent_periods(kpi_events(spark, sf), "cell_id", "ts", 21600)
    out = grid.groupBy(F.floor(F.col("slot") / 4).alias("day")).agg(F.avg("present").alias("a"))
    return out.select("day", r6(F.col("a")).alias("availability"), (F.col("a") >= 0.995).cast("int").alias("met"))


@query("e20_profile_validation", f"""WITH {KE}, cut AS (SELECT CAST(floor(min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * 0.8::DOUBLE) AS BIGINT) AS c FROM ke),
h AS (SELECT cell_id, hour(ts) AS hour, median(kpi) AS m, coalesce(stddev_samp(kpi), 0) AS s FROM ke, cut WHERE epoch_us(ts) < c GROUP BY 1, 2),
sp AS (SELECT DISTINCT cell_id, x.hour FROM h, range(24) x(hour)), ty AS (SELECT cell_id, median(m) AS tm, median(s) AS ts FROM h GROUP BY 1),
pf AS (SELECT sp.cell_id, sp.hour, coalesce(m, tm) AS median, coalesce(s, ts) AS std FROM sp LEFT JOIN h USING (cell_id, hour) JOIN ty USING (cell_id)),
a AS (SELECT cell_id, hour(ts) AS hour, median(kpi) AS actual FROM ke, cut WHERE epoch_us(ts) >= c GROUP BY 1, 2),
v AS (SELECT cell_id, actual - median AS e, std <= 0 OR abs(actual - median) <= 1.96 * std AS w FROM a JOIN pf USING (cell_id, hour))
SELECT count(DISTINCT cell_id) AS entities, count(*) AS pairs, {sql_r6('avg(CAST(w AS INTEGER))')} AS coverage, {sql_f32('avg(abs(e))')} AS mae FROM v""")
def profile_validation(spark, sf):
    # fitted on the first 80 % of the time span only
    df = temporal_split(kpi_events(spark, sf), "ts", (0.8, 0.0), None)
    prof = diurnal_profile(df.where("split = 'train'"), "cell_id", "ts", "kpi")
    v = uplift.validate_profile(prof, df.where("split <> 'train'"), "cell_id", "ts", "kpi")
    out = uplift.validation_summary(v, "cell_id")
    return out.select("entities", "pairs", r6(F.col("coverage")).alias("coverage"), f32(F.col("mae")).alias("mae"))


_SER = """se AS (SELECT l_suppkey AS unit, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 23941 AS INTEGER) AS period, avg(l_discount * 6) AS kpi, CAST(max(s_acctbal) < 3000 AS INTEGER) AS treated FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


@query("e21_counterfactual", f"""WITH {_SER}, dm AS (SELECT period, avg(kpi) AS d FROM se WHERE treated = 0 GROUP BY 1), b AS (SELECT min(period) AS a, count(DISTINCT unit) FILTER (treated = 0) AS nd FROM se),
g AS (SELECT unit, count(*) FILTER (period < 48) AS n0, count(*) FILTER (period >= 48) AS n1, sqrt(avg((kpi - d) * (kpi - d)) FILTER (period BETWEEN 34 AND 47)) AS rmse, avg(kpi - d) FILTER (period >= 48) AS sy,
 regr_slope(kpi, period - 48) FILTER (period < 48) AS s0, regr_intercept(kpi, period - 48) FILTER (period < 48) AS i0, regr_slope(kpi, period - 48) FILTER (period >= 48) AS s1, regr_intercept(kpi, period - 48) FILTER (period >= 48) AS i1
 FROM se JOIN dm USING (period) WHERE treated = 1 GROUP BY 1),
m AS (SELECT *, CASE WHEN n0 < 7 OR 1 - n0 / (48 - a) > 0.2 OR n1 = 0 THEN 'INSUFFICIENT_DATA' WHEN nd >= 10 AND rmse <= 0.08 THEN 'SYNTHETIC_CONTROL' ELSE 'ITS_ONLY' END AS method FROM g, b)
SELECT unit, method, {sql_r6('rmse')} AS pre_rmse, {sql_r6("CASE WHEN method = 'SYNTHETIC_CONTROL' THEN sy END")} AS uplift, {sql_r6("CASE WHEN method = 'ITS_ONLY' THEN i1 - i0 END")} AS level_change,
 {sql_r6("CASE WHEN method = 'ITS_ONLY' THEN s1 - s0 END")} AS slope_change FROM m""")
def counterfactual(spark, sf):
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    period = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 23941
    ser = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_suppkey").alias("unit"), period.alias("period")).agg(
        F.avg(F.col("l_discount") * 6).alias("kpi"), (F.max("s_acctbal") < 3000).cast("int").alias("treated"))
    out = uplift.counterfactual(ser, "unit", "period", "kpi", "treated", 48)
    return out.select("unit", "method", *[r6(F.col(c)).alias(c) for c in ("pre_rmse", "uplift", "level_change", "slope_change")])


@query("e21_arm_difference", f"WITH m AS (SELECT avg(l_discount) FILTER (l_linestatus = 'O') AS t, avg(l_discount) FILTER (l_linestatus = 'F') AS c FROM lineitem) SELECT {sql_r6('t')} AS treated, {sql_r6('c')} AS control, {sql_r6('t - c')} AS uplift FROM m")
def arm_difference(spark, sf):
    out = uplift.arm_difference(table(spark, sf, "lineitem"), "l_linestatus", "l_discount", "O", "F")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("e24_health_rates", f"""WITH {FLAGS}, rv AS (SELECT p.event_id, v.ts - p.ts <= INTERVAL 30 MINUTE AS rev FROM (SELECT * FROM ke WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM ke WHERE event_type = 'view') v ON p.cluster_id = v.cluster_id AND p.ts <= v.ts)
SELECT {sql_f32('(SELECT avg((epoch_us(alarm_ts) - epoch_us(ts)) / 1000000.0::DOUBLE) FROM cf)')} AS mean_latency_s, {sql_r6('(SELECT avg(CAST(coalesce(rev, FALSE) AS INTEGER)) FROM rv)')} AS reversed_share""")
def health_rates(spark, sf):
    cf = confirmed_flags(spark, sf)
    lag = (F.unix_micros("alarm_ts") - F.unix_micros("ts")) / 1e6
    ke = kpi_events(spark, sf)
    rv = next_within(ke.where("event_type = 'purchase'").select("event_id", "cluster_id", "ts"), ke.where("event_type = 'view'"), ["cluster_id"], "ts", 1800)
    share = rv.agg(F.avg("confirmed")).scalar()
    return cf.agg(f32(F.avg(lag)).alias("mean_latency_s")).withColumn("reversed_share", r6(share))


@query("e24_false_positive_rate", f"""WITH {FLAGS}, d AS (SELECT cluster_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(CAST(alarm_ts IS NULL AS INTEGER)) AS f FROM cf GROUP BY 1, 2)
SELECT cluster_id, CAST(day AS VARCHAR) AS day, {sql_r6('sum(f) OVER w / sum(n) OVER w')} AS rate FROM d WINDOW w AS (PARTITION BY cluster_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def false_positive_rate(spark, sf):
    d = confirmed_flags(spark, sf).groupBy("cluster_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("confirmed")).alias("f"))
    return rolling_rate(d, ["cluster_id"], "day", "f", "n", 7).select(
        "cluster_id", F.col("day").cast("string").alias("day"), r6(F.col("rate")).alias("rate"))


@query("e25_outcome_rates", f"""SELECT {sql_r6("avg(CAST(o_orderstatus = 'F' AS INTEGER))")} AS completion, {sql_r6("avg(CAST(o_totalprice < 400000 AS INTEGER)) FILTER (o_orderstatus <> 'P')")} AS safety,
 {sql_r6("avg(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER)) FILTER (o_totalprice >= 400000)")} AS escalation FROM orders""")
def outcome_rates(spark, sf):
    big = F.col("o_totalprice") >= 400000
    out = uplift.outcome_rates(table(spark, sf, "orders"), {
        "completion": (F.col("o_orderstatus") == "F", F.lit(True)),
        "safety": (~big, F.col("o_orderstatus") != "P"),
        "escalation": (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), big)})
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])

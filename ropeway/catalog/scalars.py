"""Scalar expressions over line items, events and customers."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, SC, kpi_events, query, r6, scored_events, sql_f32, sql_r6, table
from ropeway.functions import scalar as S
from ropeway.functions import timefeat as T
from ropeway.plans.prefix import exact_quantiles

KEYS = ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"]


def lines(spark, sf):
    """Counter roles: attempts, successes, two loads, two throughputs, CQI."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("l_linenumber") == 7, 0.0).otherwise(q).alias("att"),
        (q * (1 - F.col("l_discount") * 2)).alias("succ"),
        (F.col("l_discount") * 10).alias("prb_dl"),
        (F.col("l_tax") * 10).alias("prb_ul"),
        (p / 1000).alias("tput_dl"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(p / 5000).alias("tput_ul"),
        F.floor(q / 4).cast("int").alias("cqi"),
    )


LN = """ln AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day,
  CASE WHEN l_linenumber = 7 THEN 0.0::DOUBLE ELSE l_quantity END AS att,
  l_quantity * (1 - l_discount * 2) AS succ, l_discount * 10 AS prb_dl, l_tax * 10 AS prb_ul,
  l_extendedprice / 1000 AS tput_dl,
  CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / 5000 END AS tput_ul,
  CAST(floor(l_quantity / 4) AS INTEGER) AS cqi FROM lineitem)"""
ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber, day"
IDS = ID.split(", ")


@query("p1_success_ratio", f"WITH {LN} SELECT {ID}, "
       + sql_f32("least(greatest(succ / greatest(att, 1e-9), 0.0), 1.0)") + " AS ratio FROM ln")
def success_ratio(spark, sf):
    return lines(spark, sf).select(*IDS, S.f32(S.success_ratio(F.col("succ"), F.col("att"))).alias("ratio"))


@query("p2_success_percent", f"WITH {LN} SELECT {ID}, "
       + sql_f32("CASE WHEN att = 0 THEN 100.0 ELSE least(greatest(succ / att * 100, 0.0), 100.0) END")
       + " AS pct FROM ln")
def success_percent(spark, sf):
    return lines(spark, sf).select(*IDS, S.f32(S.success_percent(F.col("succ"), F.col("att"))).alias("pct"))


@query("p3_direction_ratio", f"WITH {LN} SELECT {ID}, "
       + sql_f32("CASE WHEN tput_ul = 0 THEN 1.0 ELSE least(tput_dl / tput_ul, 50.0) END") + " AS capped, "
       + sql_f32("least(greatest(tput_dl / (tput_ul + 1e-6), 0.0), 100.0)") + " AS guarded FROM ln")
def direction_ratio(spark, sf):
    dl, ul = F.col("tput_dl"), F.col("tput_ul")
    return lines(spark, sf).select(
        *IDS, S.f32(S.direction_ratio(dl, ul)).alias("capped"),
        S.f32(S.direction_ratio(dl, ul, idle_as_one=False)).alias("guarded"))


@query("p4_guarded_ratios", f"WITH {LN} SELECT {ID}, "
       + ", ".join(f"{sql_f32(f'CASE WHEN {b} > 1e-6 THEN {a} / ({b} + 1e-6) END')} AS {n}" for n, a, b in [
           ("tput_per_prb_dl", "tput_dl", "prb_dl"), ("tput_per_prb_ul", "tput_ul", "prb_ul"),
           ("ue_per_prb", "att", "prb_dl"), ("tput_per_cqi", "tput_dl", "cqi")])
       + ", " + sql_f32("coalesce(least(tput_dl / nullif(prb_dl, 0), CASE WHEN prb_dl <> 0 THEN 20.0 END), 0.0)")
       + " AS prb_efficiency FROM ln")
def guarded_ratios(spark, sf):
    pairs = [("tput_per_prb_dl", "tput_dl", "prb_dl"), ("tput_per_prb_ul", "tput_ul", "prb_ul"),
             ("ue_per_prb", "att", "prb_dl"), ("tput_per_cqi", "tput_dl", "cqi")]
    return lines(spark, sf).select(
        *IDS, *[S.f32(S.guarded_ratio(F.col(a), F.col(b))).alias(n) for n, a, b in pairs],
        S.f32(S.prb_efficiency(F.col("tput_dl"), F.col("prb_dl"))).alias("prb_efficiency"))


@query("p5_compound_indices", f"WITH {LN} SELECT {ID}, " + ", ".join([
    sql_f32("cqi * (1.0 - least(greatest(prb_ul, 0.0), 1.0))") + " AS quality",
    sql_f32("least(greatest(succ / greatest(att, 1e-9), 0.0), 1.0) * least(greatest(prb_ul, 0.0), 1.0)") + " AS access",
    sql_f32("sqrt(least(greatest(prb_dl, 0.0), 1.0) * least(greatest(prb_ul, 0.0), 1.0))") + " AS load",
    "CAST(prb_dl > 0.80 AS INTEGER) AS saturated",
    sql_f32("tput_dl - tput_ul") + " AS spread"]) + " FROM ln")
def compound_indices(spark, sf):
    c = F.col
    return lines(spark, sf).select(
        *IDS, S.f32(S.quality_index(c("cqi"), c("prb_ul"))).alias("quality"),
        S.f32(S.accessibility(S.success_ratio(c("succ"), c("att")), c("prb_ul"))).alias("access"),
        S.f32(S.load_index(c("prb_dl"), c("prb_ul"))).alias("load"),
        S.saturation_flag(c("prb_dl")).alias("saturated"),
        S.f32(S.signal_spread(c("tput_dl"), c("tput_ul"))).alias("spread"))


@query("p6_cqi_consistency", f"""WITH {LN}, p AS (SELECT quantile_cont(tput_dl, 0.95) AS p95 FROM ln)
SELECT {ID}, """ + sql_f32("""CASE WHEN cqi = 0 THEN 0.5 ELSE least(greatest(least(greatest(tput_dl / CASE WHEN p95 <= 0 THEN 1 ELSE p95 END, 0.0), 1.0)
  / (cqi / 15.0), 0.0), 2.0) END""") + " AS consistency, " + sql_f32("p95") + " AS p95 FROM ln, p")
def cqi_consistency(spark, sf):
    df = lines(spark, sf)
    p95 = exact_quantiles(df, [], "tput_dl", {"p95": 0.95}).scalar()
    return df.select(*IDS, S.f32(S.cqi_consistency(F.col("tput_dl"), F.col("cqi"), p95)).alias("consistency"),
                     S.f32(p95).alias("p95"))


def _sql_cycle(name, value, period):
    return [sql_r6(f"sin(2 * pi() * {value} / {period})") + f" AS {name}_sin",
            sql_r6(f"cos(2 * pi() * {value} / {period})") + f" AS {name}_cos"]


_H, _D = "hour(ts)", "(isodow(ts) - 1)"
_ROP = "(hour(ts) * 4 + minute(ts) // 15)"


@query("p7_time_counter", "SELECT event_id, " + ", ".join(
    _sql_cycle("hour", _H, "24.0") + _sql_cycle("dow", _D, "7.0") + _sql_cycle("month", "(month(ts) - 1)", "12.0") + [
        f"CAST({_D} >= 5 AS INTEGER) AS is_weekend",
        f"CAST({_H} IN (8,9,10,12,13,14,18,19,20,21) AS INTEGER) AS is_peak_hour",
        f"CAST({_H} AS INTEGER) AS hour_of_day", f"CAST({_D} AS INTEGER) AS day_of_week"]) + " FROM events")
def time_counter(spark, sf):
    return _time(spark, sf, T.counter_time_features)


@query("p7_time_inventory", "SELECT event_id, " + ", ".join(
    [f"CAST({_H} AS INTEGER) AS hour_of_day", f"CAST({_D} AS INTEGER) AS day_of_week",
     "CAST(dayofyear(ts) AS INTEGER) AS day_of_year", "CAST(weekofyear(ts) AS INTEGER) AS week_of_year",
     f"CAST({_ROP} AS INTEGER) AS rop_of_day"]
    + _sql_cycle("hour", _H, "24.0") + _sql_cycle("dow", _D, "7.0") + _sql_cycle("doy", "dayofyear(ts)", "365.0")
    + _sql_cycle("rop", _ROP, "96.0") + [
        f"CAST({_D} >= 5 AS INTEGER) AS is_weekend",
        f"CAST({_H} BETWEEN 7 AND 9 AS INTEGER) AS is_morning_peak",
        f"CAST({_H} BETWEEN 17 AND 21 AS INTEGER) AS is_evening_peak",
        f"CAST({_H} BETWEEN 7 AND 9 OR {_H} BETWEEN 17 AND 21 AS INTEGER) AS is_peak_hour",
        f"CAST({_H} BETWEEN 8 AND 18 AND {_D} < 5 AS INTEGER) AS is_business_hours"]) + " FROM events")
def time_inventory(spark, sf):
    return _time(spark, sf, T.inventory_time_features)


@query("p7_time_serving", "SELECT event_id, " + ", ".join(
    _sql_cycle("hour", "(hour(ts) + minute(ts) / 60.0)", "24.0") + _sql_cycle("dow", _D, "7.0") + [
        f"CAST({_H} BETWEEN 7 AND 9 OR {_H} BETWEEN 17 AND 20 AS INTEGER) AS is_peak_hour",
        f"CAST({_D} >= 5 AS INTEGER) AS is_weekend"]) + " FROM events")
def time_serving(spark, sf):
    return _time(spark, sf, T.serving_time_features)


def _time(spark, sf, build):
    cols = build(F.col("ts"))
    return table(spark, sf, "events").select(
        "event_id", *[(r6(c) if n.endswith(("_sin", "_cos")) else c.cast("int")).alias(n) for n, c in cols.items()])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("p8_one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS segment_{s.lower()}" for s in SEGMENTS)
    + """, CAST(c_nationkey * 5 <= 32 AS INTEGER) AS band_low,
  CAST(c_nationkey * 5 > 32 AND c_nationkey * 5 <= 77 AS INTEGER) AS band_mid,
  CAST(c_nationkey * 5 > 77 AS INTEGER) AS band_high FROM customer""")
def one_hot(spark, sf):
    cols = {**T.one_hot(F.col("c_mktsegment"), "segment", SEGMENTS), **T.band_bucket(F.col("c_nationkey") * 5)}
    return table(spark, sf, "customer").select("c_custkey", *[c.alias(n) for n, c in cols.items()])


@query("p9_online_features", f"""WITH {LN}, r AS (SELECT *, least(greatest(succ / greatest(att, 1.0), 0.0), 1.0) AS rrc,
  least(greatest(prb_dl / greatest(prb_ul, 1.0), 0.0), 1.0) AS erab,
  least(greatest(cqi / greatest(att, 1.0), 0.0), 1.0) AS ho FROM ln)
SELECT {ID}, {sql_f32('least(greatest(prb_dl, 0.0), 1.0)')} AS dl_prb_utilisation,
 {sql_f32('least(greatest(prb_ul, 0.0), 1.0)')} AS ul_prb_utilisation, {sql_f32('rrc')} AS rrc_setup_success_rate,
 {sql_f32('erab')} AS erab_setup_success_rate, {sql_f32('ho')} AS ho_success_rate,
 {sql_f32('tput_dl * 1000 / 1000 / 900')} AS dl_throughput_mbps, {sql_f32('tput_ul * 1000 / 1000 / 900')} AS ul_throughput_mbps,
 {sql_f32('greatest(att, 0.0)')} AS active_ue_count,
 {sql_r6('least(greatest(prb_dl, 0.0), 1.0) - least(greatest(prb_ul, 0.0), 1.0)')} AS prb_imbalance,
 {sql_f32('tput_dl * 1000 / 1000 / 900 / greatest(att, 1.0)')} AS dl_tput_per_ue,
 {sql_f32('exp((ln(greatest(rrc, 1e-6)) + ln(greatest(erab, 1e-6)) + ln(greatest(ho, 1e-6))) / 3)')} AS quality_score
FROM r""")
def online_features(spark, sf):
    c = F.col
    raw = {"rrc_succ": c("succ"), "rrc_att": c("att"), "erab_succ": c("prb_dl"), "erab_att": c("prb_ul"),
           "ho_succ": c("cqi").cast("double"), "ho_att": c("att"), "dl_prb": c("prb_dl"), "ul_prb": c("prb_ul"),
           "dl_kbits": c("tput_dl") * 1000, "ul_kbits": c("tput_ul") * 1000, "active_ue": c("att")}
    out = S.online_features(raw)
    return lines(spark, sf).select(
        *IDS, *[(r6(v) if n == "prb_imbalance" else S.f32(v)).alias(n) for n, v in out.items()])


@query("p10_feature_violations", """SELECT event_id, concat_ws(',',
  CASE WHEN event_id % 11 = 0 OR value IS NULL THEN 'load' END,
  CASE WHEN value <= 1 THEN 'log_value' END) AS problems,
  CAST((CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) + (CASE WHEN value <= 1 THEN 1 ELSE 0 END) AS INTEGER) AS n_problems
FROM events""")
def feature_violations(spark, sf):
    v = F.col("value")
    load = F.when(F.col("event_id") % 11 != 0, v)
    broken = F.when(v > 1, F.log(F.greatest(v, F.lit(1.0)))).otherwise(F.lit(float("nan")))
    found = S.violations({"load": load, "log_value": broken})
    return table(spark, sf, "events").select(
        "event_id", F.concat_ws(",", found).alias("problems"), F.size(found).alias("n_problems"))


@query("p12_fallback_rule", f"""WITH {KE} SELECT event_id,
 CASE WHEN kpi / 100 > 0.95 THEN 'overload' WHEN kpi / 50 < 0.85 THEN 'failure' ELSE 'none' END AS label,
 CASE WHEN kpi / 100 > 0.95 THEN 0.85::DOUBLE WHEN kpi / 50 < 0.85 THEN 0.90::DOUBLE ELSE 0.70::DOUBLE END AS confidence
 FROM ke""")
def fallback_rule(spark, sf):
    rule = S.fallback_rule(F.col("kpi") / 100, F.col("kpi") / 50)
    return kpi_events(spark, sf).select("event_id", rule.alias("r")).select(
        "event_id", F.col("r.label").alias("label"), F.col("r.confidence").alias("confidence"))


@query("p13_severity", f"""WITH {SC} SELECT event_id, CASE WHEN s1 >= 0.5 THEN 'RED' WHEN s1 >= 0.3 THEN 'YELLOW' ELSE 'CLEAR' END AS severity,
 CAST(s1 >= 0.5 AS INTEGER) AS flagged FROM sc""")
def severity(spark, sf):
    return scored_events(spark, sf).select(
        "event_id", S.severity(F.col("s1")).alias("severity"),
        (S.severity(F.col("s1")) == "RED").cast("int").alias("flagged"))


@query("p14_ensemble_score", f"""WITH {SC}, x AS (SELECT event_id, s1, CASE WHEN event_id % 3 <> 0 THEN s2 END AS s2, s3 FROM sc)
SELECT event_id, {sql_f32('(s1 * 0.2 + coalesce(s2 * 0.5, 0) + s3 * 0.3) / (0.5 + CASE WHEN s2 IS NULL THEN 0 ELSE 0.5 END)')} AS score FROM x""")
def ensemble_score(spark, sf):
    s2 = F.when(F.col("event_id") % 3 != 0, F.col("s2"))
    return scored_events(spark, sf).select(
        "event_id", S.f32(S.weighted_score([F.col("s1"), s2, F.col("s3")], S.ENSEMBLE_WEIGHTS)).alias("score"))


@query("p15_min_max", f"""WITH {KE}, b AS (SELECT min(kpi) AS lo, max(kpi) AS hi FROM ke)
SELECT event_id, {sql_f32('(kpi - lo) / (hi - lo)')} AS scaled,
 {sql_f32('((hi - 100) - (kpi - 100)) / ((hi - 100) - (lo - 100))')} AS flipped FROM ke, b""")
def min_max(spark, sf):
    ke = kpi_events(spark, sf)
    b = ke.agg(F.struct(F.min("kpi").alias("lo"), F.max("kpi").alias("hi"))).scalar()
    lo, hi, v = b["lo"], b["hi"], F.col("kpi")
    return ke.select("event_id", S.f32(S.min_max(v, lo, hi)).alias("scaled"),
                     S.f32(S.min_max(v - 100, lo - 100, hi - 100, flip_negative=True)).alias("flipped"))


@query("p16_non_finite", f"""WITH {LN}, x AS (SELECT *, CASE WHEN cqi = 0 THEN NULL ELSE ln(cqi) END AS raw FROM ln),
m AS (SELECT median(raw) AS med FROM x)
SELECT {ID}, {sql_f32('coalesce(raw, med)')} AS by_median, {sql_f32('coalesce(raw, 0)')} AS by_zero FROM x, m""")
def non_finite(spark, sf):
    raw = F.when(F.col("cqi") == 0, F.lit(float("-inf"))).otherwise(F.log(F.greatest("cqi", F.lit(1))))
    df = lines(spark, sf).withColumn("raw", S.finite(raw))
    med = exact_quantiles(df, [], "raw", {"m": 0.5}).scalar()
    return df.select(*IDS, S.f32(F.coalesce("raw", med)).alias("by_median"),
                     S.f32(F.coalesce("raw", F.lit(0.0))).alias("by_zero"))


@query("p18_published_score", f"WITH {SC} SELECT event_id, round_even(s1 * 1.0, 1) + 0.0 AS published FROM sc")
def published_score(spark, sf):
    return scored_events(spark, sf).select("event_id", (S.published_score(F.col("s1")) + 0.0).alias("published"))

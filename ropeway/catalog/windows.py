"""Window operators over the event series."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, KG, gappy_events, kpi_events, query, r6, sql_f32, sql_r6, table
from ropeway.functions.scalar import f32
from ropeway.operators import windows as W
from ropeway.spec import COUNTER_WINDOWS, INVENTORY_MIN_PERIODS, INVENTORY_WINDOWS, KpiSpec

SERIES = KpiSpec(ties=("event_id",), kpis=("kpi",), windows=COUNTER_WINDOWS)
INVENTORY = KpiSpec(ties=("event_id",), kpis=("kpi",), windows=INVENTORY_WINDOWS,
                    min_periods=INVENTORY_MIN_PERIODS)
ORD = "PARTITION BY cell_id ORDER BY ts, event_id"


def _fr(a, b):
    return f"({ORD} ROWS BETWEEN {a} AND {b})"


def _stats(frame, need, label, std_gate):
    gate = f"count(kpi) OVER {frame} >= {need}"
    std = f"stddev_samp(kpi) OVER {frame}"
    std = f"coalesce(CASE WHEN {gate} THEN {std} END, 0)" if std_gate else f"coalesce({std}, 0)"
    return (f"{sql_f32(f'CASE WHEN {gate} THEN avg(kpi) OVER {frame} END')} AS kpi_mean_{label}, "
            f"{sql_f32(f'round({std}, 6)')} AS kpi_std_{label}, "
            f"CASE WHEN {gate} THEN max(kpi) OVER {frame} END AS kpi_max_{label}, "
            f"CASE WHEN {gate} THEN min(kpi) OVER {frame} END AS kpi_min_{label}")


def _tidy(df, keep):
    cols = []
    for c in df.columns:
        if "_mean_" in c:
            cols.append(f32(F.col(c)).alias(c))
        elif "_std_" in c:
            cols.append(f32(F.round(c, 6)).alias(c))
        elif c in keep or c.startswith("kpi_"):
            cols.append(F.col(c))
    return df.select(*cols)


@query("w1_rolling_statistics", f"WITH {KG} SELECT event_id, " + ", ".join(
    _stats(_fr(f"{w} PRECEDING", "1 PRECEDING"), max(1, w // 2), lab, False)
    for lab, w in COUNTER_WINDOWS.items()) + " FROM kg")
def rolling_statistics(spark, sf):
    return _tidy(W.rolling_statistics(gappy_events(spark, sf), SERIES), ["event_id"])


@query("w2_rolling_features", f"WITH {KG} SELECT event_id, " + ", ".join(
    _stats(_fr(f"{w} PRECEDING", "1 PRECEDING"), INVENTORY_MIN_PERIODS[lab], lab, True)
    + f", CASE WHEN count(kpi) OVER {_fr(f'{w} PRECEDING', '1 PRECEDING')} >= {INVENTORY_MIN_PERIODS[lab]} THEN "
    + sql_f32(f"max(kpi) OVER {_fr(f'{w} PRECEDING', '1 PRECEDING')} - min(kpi) OVER {_fr(f'{w} PRECEDING', '1 PRECEDING')}")
    + f" END AS kpi_range_{lab}"
    for lab, w in INVENTORY_WINDOWS.items()) + " FROM kg")
def rolling_features(spark, sf):
    out = W.rolling_features(gappy_events(spark, sf), INVENTORY)
    ranges = {c: f32(F.col(c)) for c in out.columns if "_range_" in c}
    return _tidy(out.withColumns(ranges), ["event_id"])


@query("w3_lag_delta_guard", f"WITH {KG}, x AS (SELECT event_id, kpi, " + ", ".join(
    f"lag(kpi, {n}) OVER ({ORD}) AS p{n}" for n in (1, 4)) + " FROM kg) SELECT event_id, " + ", ".join(
    f"p{n} AS kpi_lag_{n}, " + sql_f32(
        f"CASE WHEN NOT coalesce(kpi - p{n} < -0.9 * p{n} AND p{n} > 0, FALSE) THEN kpi - p{n} END")
    + f" AS kpi_delta_{n}" for n in (1, 4)) + " FROM x")
def lag_delta_guard(spark, sf):
    out = W.lag_deltas(gappy_events(spark, sf), SERIES)
    return out.select("event_id", *[c for n in (1, 4) for c in (
        F.col(f"kpi_lag_{n}"), f32(F.col(f"kpi_delta_{n}")).alias(f"kpi_delta_{n}"))])


@query("w4_change_features", f"WITH {KG}, x AS (SELECT event_id, " + ", ".join(
    f"kpi - lag(kpi, {n}) OVER ({ORD}) AS d{n}" for n in (1, 4)) + " FROM kg) SELECT event_id, " + ", ".join(
    f"{sql_f32(f'd{n}')} AS kpi_delta_{n}, {sql_f32(f'abs(d{n})')} AS kpi_abs_{n}, "
    f"CAST(coalesce(sign(d{n}), 0) AS INTEGER) AS kpi_dir_{n}" for n in (1, 4)) + " FROM x")
def change_features(spark, sf):
    out = W.change_features(gappy_events(spark, sf), SERIES)
    return out.select("event_id", *[
        (F.col(c) if "_dir_" in c else f32(F.col(c))).alias(c) for c in out.columns if c.startswith("kpi_")])


@query("w5_rolling_z", f"""WITH {KG}, x AS (SELECT event_id, kpi, count(kpi) OVER w AS n, avg(kpi) OVER w AS m,
 stddev_samp(kpi) OVER w AS s FROM kg WINDOW w AS {_fr('96 PRECEDING', '1 PRECEDING')})
SELECT event_id, {sql_r6('CASE WHEN n >= 24 AND s > 0 AND kpi IS NOT NULL THEN least(greatest((kpi - m) / s, -5.0), 5.0) ELSE 0 END')} AS kpi_z FROM x""")
def rolling_z(spark, sf):
    return W.rolling_z(gappy_events(spark, sf), SERIES).select("event_id", r6(F.col("kpi_z")).alias("kpi_z"))


@query("w9_row_index", f"WITH {KE} SELECT event_id, row_number() OVER ({ORD}) - 1 AS row_index FROM ke")
def row_index(spark, sf):
    return W.row_index(kpi_events(spark, sf), SERIES).select("event_id", "row_index")


@query("w10_forward_fill", f"""WITH {KG}, x AS (SELECT event_id, last_value(kpi IGNORE NULLS) OVER
 {_fr('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS seen FROM kg)
SELECT event_id, coalesce(seen, (SELECT median(kpi) FROM kg)) AS kpi FROM x""")
def forward_fill(spark, sf):
    df = gappy_events(spark, sf)
    return W.forward_fill(df, SERIES, {"kpi": W.global_median(df, "kpi")}).select("event_id", "kpi")


@query("w11_short_fill", f"""WITH {KE}, kh AS (SELECT event_id, cell_id, ts, CASE WHEN event_id % 3 = 0 THEN kpi END AS kpi FROM ke)
SELECT event_id, {sql_f32(f'''coalesce(last_value(kpi IGNORE NULLS) OVER {_fr('2 PRECEDING', 'CURRENT ROW')},
 CASE WHEN count(kpi) OVER {_fr('96 PRECEDING', '1 PRECEDING')} >= 12 THEN avg(kpi) OVER {_fr('96 PRECEDING', '1 PRECEDING')} END,
 (SELECT median(kpi) FROM kh), 0)''')} AS kpi FROM kh""")
def short_fill(spark, sf):
    df = kpi_events(spark, sf).withColumn("kpi", F.when(F.col("event_id") % 3 == 0, F.col("kpi")))
    out = W.short_fill(df, SERIES, {"kpi": W.global_median(df, "kpi")}, need=12)
    return out.select("event_id", f32(F.col("kpi")).alias("kpi"))


@query("w12_reset_flags", f"""WITH {KE} SELECT event_id, CAST(coalesce(kpi - lag(kpi) OVER ({ORD}) < -0.5 *
 CASE WHEN count(kpi) OVER w >= 12 THEN greatest(max(kpi) OVER w, 1.0) END, FALSE) AS INTEGER) AS kpi_is_reset
FROM ke WINDOW w AS {_fr('96 PRECEDING', '1 PRECEDING')}""")
def reset_flags(spark, sf):
    return W.reset_flags(kpi_events(spark, sf), SERIES, need=12).select("event_id", "kpi_is_reset")


@query("w13_sequences", f"""WITH {KE}, x AS (SELECT event_id, cell_id, row_number() OVER ({ORD}) - 1 AS pos,
 sum(kpi) OVER w AS s, max(is_anomaly) OVER w AS label FROM ke WINDOW w AS {_fr('7 PRECEDING', 'CURRENT ROW')})
SELECT event_id, cell_id, pos - 7 AS start_index, {sql_f32('s')} AS total, label, 8 AS n FROM x WHERE pos >= 7 AND (pos - 7) % 4 = 0""")
def sequences(spark, sf):
    out = W.sequences(kpi_events(spark, sf), SERIES, "is_anomaly", length=8, stride=4)
    total = F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["kpi"])
    return out.select("event_id", "cell_id", "start_index", f32(total).alias("total"), "label",
                      F.size("steps").alias("n"))


@query("w14_sigma_drop", f"""WITH {KE}, x AS (SELECT event_id, CASE WHEN count(kpi) OVER w >= 2 THEN
 greatest((avg(kpi) OVER w - kpi) / greatest(stddev_samp(kpi) OVER w, 1e-6), 0.0) ELSE 0 END AS raw
 FROM ke WINDOW w AS {_fr('3 PRECEDING', 'CURRENT ROW')})
SELECT event_id, {sql_r6('raw')} AS raw_score, {sql_r6('raw / (SELECT max(raw) FROM x)')} AS score, CAST(raw >= 1.4 AS INTEGER) AS flag FROM x""")
def sigma_drop(spark, sf):
    out = W.sigma_drop(kpi_events(spark, sf), SERIES, "kpi", sigmas=1.4)
    return out.select("event_id", r6(F.col("raw_score")).alias("raw_score"), r6(F.col("score")).alias("score"), "flag")


@query("w15_deviation_score", f"""WITH {KE}, x AS (SELECT event_id, greatest(coalesce(CASE WHEN count(kpi) OVER w >= 8 THEN avg(kpi) OVER w - kpi END, 0.0), 0.0) AS fall
 FROM ke WINDOW w AS {_fr('16 PRECEDING', '1 PRECEDING')})
SELECT event_id, {sql_r6('fall / (SELECT max(fall) FROM x)')} AS score FROM x""")
def deviation_score(spark, sf):
    return W.deviation_score(kpi_events(spark, sf), SERIES, "kpi").select("event_id", r6(F.col("score")).alias("score"))


@query("w16_centred_mean", f"WITH {KE} SELECT event_id, {sql_f32('avg(kpi) OVER ' + _fr('2 PRECEDING', '1 FOLLOWING'))} AS smooth FROM ke")
def centred_mean(spark, sf):
    return W.centred_mean(kpi_events(spark, sf), SERIES, "kpi", "smooth").select("event_id", f32(F.col("smooth")).alias("smooth"))


@query("w17_buffer_features", f"WITH {KG} SELECT event_id, " + ", ".join(
    f"{sql_f32(f'coalesce(avg(kpi) OVER {_fr(f'{w - 1} PRECEDING', 'CURRENT ROW')}, 0)')} AS kpi_mean_{lab}, "
    f"{sql_f32(f'round(coalesce(stddev_samp(kpi) OVER {_fr(f'{w - 1} PRECEDING', 'CURRENT ROW')}, 0), 6)')} AS kpi_std_{lab}"
    for lab, w in (("4h", 16), ("24h", 96)))
    + f", {sql_f32(f'coalesce(kpi - lag(kpi) OVER ({ORD}), 0)')} AS kpi_delta_1 FROM kg")
def buffer_features(spark, sf):
    out = W.buffer_features(gappy_events(spark, sf), SERIES, "kpi")
    return _tidy(out.withColumn("kpi_delta_1", f32(F.col("kpi_delta_1"))), ["event_id"])


@query("w18_external_z", f"""WITH {KE}, g AS (SELECT cluster_id, avg(kpi) AS m, stddev_samp(kpi) AS s FROM ke WHERE day < DATE '2024-01-16' GROUP BY 1)
SELECT event_id, {sql_r6('least(greatest((kpi - m) / greatest(s, 1e-6), -6.0), 6.0)')} AS z FROM ke JOIN g USING (cluster_id)""")
def external_z(spark, sf):
    ke = kpi_events(spark, sf)
    stats = ke.where(F.col("day") < "2024-01-16").groupBy("cluster_id").agg(
        F.avg("kpi").alias("m"), F.stddev_samp("kpi").alias("s"), F.count(F.lit(1)).alias("n"))
    from ropeway.plans.skew import attach
    return attach(ke, stats, ["cluster_id"], rows="n").select(
        "event_id", r6(W.external_z(F.col("kpi"), F.col("m"), F.col("s"))).alias("z"))


@query("w19_cusum", f"""WITH RECURSIVE {KE}, d AS (SELECT cluster_id, CAST(day AS VARCHAR) AS day, abs(avg(kpi) - 50) / 2 AS dist,
 row_number() OVER (PARTITION BY cluster_id ORDER BY ke.day) AS i FROM ke GROUP BY cluster_id, ke.day),
r AS (SELECT cluster_id, day, i, greatest(0.0, dist - 0.5) AS s, CAST(greatest(0.0, dist - 0.5) > 3 AS INTEGER) AS alarm FROM d WHERE i = 1
 UNION ALL SELECT d.cluster_id, d.day, d.i, greatest(0.0, r.s + d.dist - 0.5), greatest(r.alarm, CAST(greatest(0.0, r.s + d.dist - 0.5) > 3 AS INTEGER))
 FROM r JOIN d ON d.cluster_id = r.cluster_id AND d.i = r.i + 1)
SELECT cluster_id, day, alarm FROM r""")
def cusum(spark, sf):
    daily = kpi_events(spark, sf).groupBy("cluster_id", "day").agg((F.abs(F.avg("kpi") - 50) / 2).alias("dist"))
    out = W.cusum_flag(daily, ["cluster_id"], "day", "dist")
    return out.select("cluster_id", F.col("day").cast("string").alias("day"), "alarm")


@query("w20_last_n_mean", f"""SELECT conv_id, turn, {sql_f32("coalesce(avg(CASE WHEN role = 'assistant' THEN least(length(text) / 500.0, 1.0) END) OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 1.0)")} AS rolling_score FROM conversations""")
def last_n_mean(spark, sf):
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.pmod("conv_id", F.lit(8)).alias("model_id"),
        F.when(F.col("role") == "assistant", F.least(F.length("text") / 500.0, F.lit(1.0))).alias("score"))
    spec = KpiSpec(entity=("model_id",), time="conv_id", ties=("turn",))
    return W.last_n_mean(df, spec, "score").select("conv_id", "turn", f32(F.col("rolling_score")).alias("rolling_score"))


@query("w21_sustained_breach", f"""WITH {KE}, d AS (SELECT cluster_id, day, avg(is_anomaly) AS rate FROM ke GROUP BY 1, 2)
SELECT cluster_id, CAST(day AS VARCHAR) AS day, CAST(sum(CAST(rate > 0.2 AS INTEGER)) OVER (PARTITION BY cluster_id ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) = 2 AS INTEGER) AS sustained FROM d""")
def sustained_breach(spark, sf):
    daily = kpi_events(spark, sf).groupBy("cluster_id", "day").agg(F.avg("is_anomaly").alias("rate"))
    return W.sustained(daily, ["cluster_id"], "day", F.col("rate") > 0.2, position=F.unix_date("day")).select(
        "cluster_id", F.col("day").cast("string").alias("day"), "sustained")

"""Classification evaluation over the derived scores."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, SC, kpi_events, query, r6, scored_events, sql_f32, sql_r6, table
from ropeway.functions.scalar import f32
from ropeway.operators import evaluate as E
from ropeway.operators import resample

CM = """SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND NOT y) AS tn,
 count(*) FILTER (NOT p AND y) AS fn FROM (SELECT {pred} AS p, is_anomaly = 1 AS y FROM {src})"""
RATES = {"precision": "coalesce(tp / nullif(tp + fp, 0), 0)", "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
         "f1": "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)", "specificity": "coalesce(tn / nullif(tn + fp, 0), 0)",
         "false_alarm_rate": "coalesce(fp / nullif(fp + tn, 0), 0)",
         "prevalence": "coalesce((tp + fn) / nullif(tp + fp + tn + fn, 0), 0)",
         "mcc": "coalesce((1.0 * tp * tn - 1.0 * fp * fn) / nullif(sqrt(1.0::DOUBLE * (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"}
CURVE = SC + """, sk AS (SELECT score, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM sc GROUP BY 1),
ac AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp, sum(n_pos) OVER () AS p, sum(n_neg) OVER () AS n
 FROM sk WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT score, n_pos, n_neg, tp, fp, p, n, tp / (tp + fp) AS precision, tp / p AS recall,
 2.0::DOUBLE * tp / (p + tp + fp) AS f1, fp / n AS fpr, tp / p - fp / n AS youden FROM ac)"""


def _r(df, *plain):
    return df.select(*[F.col(c) if c in plain else r6(F.col(c)).alias(c) for c in df.columns])


@query("e1_threshold_metrics", f"WITH {SC}, c AS ({CM.format(pred='s1 >= 0.1', src='sc')}) SELECT tp, fp, tn, fn, "
       + ", ".join(f"{sql_r6(RATES[n])} AS {n}" for n in RATES) + " FROM c")
def threshold_metrics(spark, sf):
    return _r(E.threshold_metrics(scored_events(spark, sf), [], "s1", "is_anomaly", 0.1), "tp", "fp", "tn", "fn")


@query("e2_mcc_brier", f"WITH {SC}, c AS ({CM.format(pred='s1 > 0.2', src='sc')}) SELECT {sql_r6(RATES['mcc'])} AS mcc, "
       + sql_r6("(SELECT avg((s1 - is_anomaly) * (s1 - is_anomaly)) FROM sc)") + " AS brier FROM c")
def mcc_brier(spark, sf):
    sc = scored_events(spark, sf)
    b = E.brier(sc, [], "s1", "is_anomaly").scalar()
    out = E.threshold_metrics(sc, [], "s1", "is_anomaly", 0.2, strict=True)
    return out.select(r6(F.col("mcc")).alias("mcc"), r6(b).alias("brier"))


@query("e3_e4_areas", f"WITH {CURVE} SELECT {sql_r6('sum(n_neg * (tp - n_pos / 2.0)) / (max(p) * max(n))')} AS roc_auc, "
       f"{sql_r6('sum(n_pos * precision) / max(p)')} AS pr_auc FROM cv")
def areas(spark, sf):
    counts = E.score_counts(scored_events(spark, sf), [], "score", "is_anomaly")
    return _r(E.areas(counts, [], "score").select("roc_auc", "pr_auc"))


@query("e4_curve", f"WITH {CURVE} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {sql_r6('precision')} AS precision, "
       f"{sql_r6('recall')} AS recall, {sql_r6('fpr')} AS fpr FROM cv")
def curve(spark, sf):
    pts = E.curve(E.score_counts(scored_events(spark, sf), [], "score", "is_anomaly"), [], "score")
    return _r(pts.select("score", "tp", "fp", "precision", "recall", "fpr"), "score", "tp", "fp")


def _points(spark, sf):
    return E.curve(E.score_counts(scored_events(spark, sf), [], "score", "is_anomaly"), [], "score")


@query("e5_best_thresholds", f"""WITH {CURVE} SELECT (SELECT score FROM cv ORDER BY f1 DESC, score LIMIT 1) AS f1_threshold, {sql_r6('max(f1)')} AS f1,
 coalesce(max(score) FILTER (precision >= 0.85), (SELECT score FROM cv ORDER BY precision DESC, score LIMIT 1)) AS precision_threshold,
 coalesce(min(score) FILTER (recall >= 0.9), (SELECT score FROM cv ORDER BY recall DESC, score LIMIT 1)) AS recall_threshold FROM cv""")
def best_thresholds(spark, sf):
    out = E.best_thresholds(_points(spark, sf), [], "score")
    return out.withColumn("f1", r6(F.col("f1")))


@query("e6_grid_search", f"""WITH {SC}, g AS (SELECT DISTINCT unnest(quantile_cont(score, {[(1 + 98 * i / 199) / 100 for i in range(200)]})) AS t FROM sc),
m AS (SELECT t, count(*) FILTER (score >= t AND is_anomaly = 1) AS tp, count(*) FILTER (score >= t AND is_anomaly = 0) AS fp,
 sum(is_anomaly) AS p, sum(1 - is_anomaly) AS n FROM g, sc GROUP BY t),
c AS (SELECT t, tp / (tp + fp) AS precision, tp / p AS recall, 2.0::DOUBLE * tp / (p + tp + fp) AS f1, (tp / p + 1 - fp / n) / 2 AS balanced_accuracy
 FROM m WHERE tp + fp > 0 AND tp + fp < p + n)
SELECT """ + ", ".join(f"round((SELECT t FROM c ORDER BY round({m}, 12) DESC, t LIMIT 1), 9) AS {m}_threshold, {sql_r6(f'(SELECT max({m}) FROM c)')} AS {m}"
                       for m in ("f1", "precision", "recall", "balanced_accuracy")))
def grid_search(spark, sf):
    out = E.grid_search(scored_events(spark, sf), "score", "is_anomaly")
    return out.select(*[(F.round(c, 9) if c.endswith("_threshold") else r6(F.col(c))).alias(c) for c in out.columns])


@query("e7_youden", f"WITH {CURVE} SELECT score AS threshold, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, {sql_r6('f1')} AS f1, "
       f"{sql_r6('youden')} AS youden FROM cv WHERE precision >= 0.1 ORDER BY cv.youden DESC, score LIMIT 1")
def youden(spark, sf):
    return _r(E.youden_threshold(_points(spark, sf), [], "score"), "threshold")


_GRID = [f"SELECT {i} AS grid_id, round(s1 * {a} + s2 * {b} + s3 * {c}, 9) AS e, is_anomaly FROM sc"
         for i, (a, b, c) in enumerate(E.WEIGHT_GRID)]


@query("e8_weight_search", f"""WITH {SC}, g AS ({' UNION ALL '.join(_GRID)}),
k AS (SELECT grid_id, e, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM g GROUP BY 1, 2),
a AS (SELECT *, sum(n_pos) OVER (PARTITION BY grid_id ORDER BY e DESC ROWS UNBOUNDED PRECEDING) AS tp FROM k),
u AS (SELECT grid_id, sum(n_neg * (tp - n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) AS auc FROM a GROUP BY 1)
SELECT CAST(grid_id AS INTEGER) AS grid_id, {sql_r6('auc')} AS roc_auc, CAST(grid_id = (SELECT grid_id FROM u ORDER BY round(auc, 12) DESC, grid_id LIMIT 1) AS INTEGER) AS best FROM u""")
def weight_search(spark, sf):
    out = E.weight_search(scored_events(spark, sf), ["s1", "s2", "s3"], "is_anomaly")
    return out.select("grid_id", r6(F.col("roc_auc")).alias("roc_auc"), "best")


#: Replicates and seed of the bootstraps, and the most rows of one score that their SQL draws for.
REPLICATES, SEED, SQL_ROWS = 1000, 42, 20


def digit_key(tag, value):
    """The key of a draw from the digits of a SHA-256, which SQL has too."""
    digits = F.concat(F.lit(f"{tag}:"), F.floor(value * float(1 << 40)).cast("bigint").cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(digits, 256), 1, 15), 16, 10).cast("bigint"), F.lit(resample.PRIME))


def sql_key(tag, value):
    digits = f"sha256('{tag}:' || CAST(CAST(floor({value} * {float(1 << 40)!r}::DOUBLE) AS BIGINT) AS VARCHAR))"
    return f"('0x' || substr({digits}, 1, 15))::BIGINT % {resample.PRIME}"


SQL_REPLICATES = "rep AS (SELECT r, " + ", ".join(
    f"('0x' || substr(sha256('{SEED}:' || r), {8 * i + 1}, 8))::BIGINT % {resample.PRIME} AS {c}" for i, c in enumerate("abcd")) + (
    f" FROM range(1, {REPLICATES + 1}) t(r))")


def sql_weight(key, n):
    """Poisson weight of ``n`` rows in a replicate, by the bounds of the inverse distribution."""
    prime = resample.PRIME
    u = f"(((a * {key} + b) % {prime} * {key} + c) % {prime} * {key} + d) % {prime}"
    at = lambda k: " + ".join(f"CAST(u >= {x} AS BIGINT)" for x in resample.poisson_bounds(k)[1].tolist())
    cases = " ".join(f"WHEN {k} THEN {at(k)}" for k in range(1, SQL_ROWS + 1))
    return f"(SELECT CASE {n} WHEN 0 THEN 0 {cases} END FROM (SELECT {u} AS u))"


BOOT_METRICS = {"roc_auc": "auc / (p * n)", "pr_auc": "ap / p", "f1": "2 * tp / (p + tp + fp)", "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
                "recall": "tp / p", "mcc": "coalesce((tp * (n - fp) - fp * (p - tp)) / nullif(sqrt((tp + fp) * p * n * (n - fp + p - tp)), 0), 0)"}


@query("e9_bootstrap_interval", f"""WITH {SC}, k AS (SELECT s1, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM sc GROUP BY 1),
kk AS (SELECT *, {sql_key('pos', 's1')} AS kp, {sql_key('neg', 's1')} AS kn FROM k), {SQL_REPLICATES},
w AS (SELECT r, s1, {sql_weight('kp', 'n_pos')} AS wp, {sql_weight('kn', 'n_neg')} AS wn FROM kk, rep),
c AS (SELECT r, s1, wp, wn, sum(wp) OVER o AS tp, sum(wn) OVER o AS fp FROM w WINDOW o AS (PARTITION BY r ORDER BY s1 DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT r, sum(wp)::DOUBLE AS p, sum(wn)::DOUBLE AS n, sum(CASE WHEN s1 >= 0.5 THEN wp ELSE 0 END)::DOUBLE AS tp,
 sum(CASE WHEN s1 >= 0.5 THEN wn ELSE 0 END)::DOUBLE AS fp, sum(wn * (tp - wp / 2.0::DOUBLE)) AS auc,
 sum(wp * tp / greatest(tp + fp, 1)::DOUBLE) AS ap FROM c GROUP BY r HAVING sum(wp) > 0 AND sum(wn) > 0),
m AS (SELECT {', '.join(f'{e} AS {m}' for m, e in BOOT_METRICS.items())} FROM s)
SELECT {', '.join(f"{sql_r6(f'avg({m})')} AS {m}_mean, {sql_r6(f'quantile_cont({m}, 0.025)')} AS {m}_low, {sql_r6(f'quantile_cont({m}, 0.975)')} AS {m}_high" for m in BOOT_METRICS)},
 count(*) AS replicates FROM m""")
def bootstrap(spark, sf):
    counts = E.score_counts(scored_events(spark, sf), [], "s1", "is_anomaly")
    return _r(resample.bootstrap_metrics(counts, "s1", REPLICATES, seed=SEED, key=digit_key), "replicates")


CASCADE = SC + f""", cs AS (SELECT *, s1 >= 0.05 AS f, s1 >= 0.05 AND s2 >= 0.95 AS b, CASE WHEN s1 >= 0.05 THEN s2 ELSE s1 / 2 END AS e FROM sc),
cc AS ({CM.format(pred='b', src='cs')}),
ck AS (SELECT e, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM cs GROUP BY 1),
ca AS (SELECT *, sum(n_pos) OVER (ORDER BY e DESC ROWS UNBOUNDED PRECEDING) AS tp FROM ck)"""


@query("e10_cascade", f"WITH {CASCADE} SELECT tp, fp, tn, fn, " + ", ".join(f"{sql_r6(RATES[n])} AS {n}" for n in
       ("precision", "recall", "f1", "false_alarm_rate")) + f""", (SELECT count(*) FROM cs) AS n_items, (SELECT count(*) FROM cs WHERE f) AS n_first,
 {sql_r6('1 - (SELECT count(*) FROM cs WHERE f) / (SELECT count(*) FROM cs)')} AS reduction_rate,
 {sql_r6('(SELECT sum(n_neg * (tp - n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) FROM ca)')} AS roc_auc FROM cc""")
def cascade(spark, sf):
    return _r(_cascade(spark, sf), "tp", "fp", "tn", "fn", "n_items", "n_first")


def _cascade(spark, sf):
    return E.cascade(scored_events(spark, sf), "s1", "s2", "is_anomaly", 0.05, 0.95)


@query("e11_baselines", f"""WITH l AS (SELECT l_quantity AS a, l_extendedprice AS b, l_tax AS c, CAST(l_returnflag = 'R' AS INTEGER) AS is_anomaly FROM lineitem),
best AS (SELECT f FROM (SELECT 'a' AS f, abs(corr(a, is_anomaly)) AS v FROM l UNION ALL SELECT 'b', abs(corr(b, is_anomaly)) FROM l UNION ALL SELECT 'c', abs(corr(c, is_anomaly)) FROM l) ORDER BY round(v, 12) DESC, f LIMIT 1),
x AS (SELECT CASE (SELECT f FROM best) WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END AS v, is_anomaly FROM l),
q AS (SELECT quantile_cont(v, 0.95) AS t FROM x), k AS ({CM.format(pred='v > (SELECT t FROM q)', src='x')}), s AS (SELECT avg(is_anomaly) AS s FROM l)
SELECT (SELECT f FROM best) AS feature, {sql_f32('(SELECT t FROM q)')} AS threshold, {sql_r6(RATES['precision'])} AS precision, {sql_r6(RATES['recall'])} AS recall, {sql_r6(RATES['f1'])} AS f1,
 {sql_r6('greatest(s, 1 - s)')} AS majority_accuracy, {sql_r6('CASE WHEN s > 0.5 THEN 2 * s / (1 + s) ELSE 0 END')} AS majority_f1 FROM k, s""")
def baselines(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_tax").alias("c"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_anomaly"))
    out = E.correlation_baseline(df, ["a", "b", "c"], "is_anomaly")
    return _r(out.withColumn("threshold", f32(F.col("threshold"))), "feature", "threshold")


@query("e12_calibration", f"""WITH {SC} SELECT CAST(greatest(ceil(round(score * 10, 9)) - 1, 0) AS INTEGER) AS bin, {sql_r6('avg(score)')} AS mean_score,
 {sql_r6('avg(is_anomaly)')} AS positive_rate, count(*) AS n FROM sc GROUP BY 1""")
def calibration(spark, sf):
    return _r(E.calibration(scored_events(spark, sf), "score", "is_anomaly"), "bin", "n")


@query("e13_sensitivity", f"WITH {CURVE} SELECT score, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, {sql_r6('f1')} AS f1 FROM cv")
def sensitivity(spark, sf):
    return _r(_points(spark, sf).select("score", "precision", "recall", "f1"), "score")


@query("e14_ranked_precision", f"""WITH {CURVE}, t AS (SELECT is_anomaly FROM sc ORDER BY score DESC, event_id LIMIT 50)
SELECT {sql_r6('(SELECT max(precision) FROM cv WHERE recall >= 0.05)')} AS precision_at_recall, {sql_r6('(SELECT avg(is_anomaly) FROM t)')} AS precision_at_k""")
def ranked_precision(spark, sf):
    top = E.precision_at(scored_events(spark, sf), "score", "is_anomaly", "event_id").scalar()
    return _r(E.fixed_recall_precision(_points(spark, sf), []).withColumn("precision_at_k", top))


@query("e14_forecast_error", f"""SELECT o_orderstatus, {sql_r6("avg(abs(o_totalprice - m) / o_totalprice)")} AS mape, {sql_r6("100 * (1 - sum(least(o_totalprice, m)) / sum(o_totalprice))")} AS saving_pct
FROM orders JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1) USING (o_orderpriority) WHERE o_totalprice > 0 GROUP BY 1""")
def forecast_error(spark, sf):
    from ropeway.plans.skew import with_group_stats
    df = with_group_stats(table(spark, sf, "orders"), ["o_orderpriority"], {"m": F.avg("o_totalprice")})
    a, p = F.col("o_totalprice"), F.col("m")
    return _r(df.where(a > 0).groupBy("o_orderstatus").agg(
        F.avg(F.abs(a - p) / a).alias("mape"),
        (100 * (1 - F.sum(F.least(a, p)) / F.sum(a))).alias("saving_pct")), "o_orderstatus")


_IMPACT = CASCADE + ", im AS (SELECT fp, fn, tp, tp + fp + tn + fn AS n_items, (tp + fn) / (tp + fp + tn + fn) AS prev FROM cc)"


@query("e15_daily_impact", f"""WITH {_IMPACT}, v AS (SELECT 1920.0::DOUBLE * prev AS anom, fp * 1920.0::DOUBLE / n_items AS f, fn * 1920.0::DOUBLE / n_items AS m,
 greatest(1920 * 0.12::DOUBLE - fp * (1920.0::DOUBLE / n_items), 0) AS fl, greatest(1920.0::DOUBLE * prev * (1 - 0.68::DOUBLE) - fn * (1920.0::DOUBLE / n_items), 0) AS ml FROM im)
SELECT round(anom, 1) AS daily_anomalies, round(f, 1) AS daily_false_alarms, round(m, 1) AS daily_missed, round(fl, 1) AS false_alarms_avoided,
 round(ml, 1) AS misses_avoided, round(fl * 45 + ml * 500, 0) AS daily_saving, round((fl * 45 + ml * 500) * 365, 0) AS annual_saving FROM v""")
def daily_impact(spark, sf):
    m = _cascade(spark, sf).withColumn("prevalence", (F.col("tp") + F.col("fn")) / F.col("n_items"))
    return E.daily_impact(m)


@query("e16_annual_impact", f"""WITH {_IMPACT}, v AS (SELECT fp / 0.25::DOUBLE AS f, tp / 0.25::DOUBLE AS t FROM im)
SELECT f AS false_alarms, t AS detections, {sql_f32('(10000 - f) * 25 / 60')} AS hours_saved, {sql_f32('(10000 - f) * 25 / 60 * 85')} AS cost_saved,
 {sql_f32('100 * (10000 - f) / (10000 + 1e-9)')} AS reduction_pct, {sql_f32('f * 25 / 60 * 85 / (t + 1e-9)')} AS cost_per_detection FROM v""")
def annual_impact(spark, sf):
    out = E.annual_impact(_cascade(spark, sf))
    return out.select(*[(F.col(c) if c in ("false_alarms", "detections") else f32(F.col(c))).alias(c) for c in out.columns])


@query("e17_score_histogram", f"WITH {SC} SELECT CAST(least(floor(round(score * 50, 9)), 49) AS INTEGER) AS bin, is_anomaly, count(*) AS n FROM sc GROUP BY 1, 2")
def score_histogram(spark, sf):
    return E.histogram(scored_events(spark, sf), "score", "is_anomaly")


@query("e18_root_cause_ranking", f"""WITH c AS (SELECT l_orderkey AS inc, l_extendedprice AS s, CAST(l_returnflag = 'R' AND l_linestatus = 'F' AS INTEGER) AS is_anomaly,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS rn FROM lineitem),
i AS (SELECT inc, max(is_anomaly) AS lab, max(CASE WHEN rn = 1 THEN is_anomaly END) AS h1, max(CASE WHEN rn <= 3 THEN is_anomaly END) AS h3 FROM c GROUP BY 1),
k AS (SELECT s, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM c GROUP BY 1),
a AS (SELECT *, sum(n_pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp FROM k)
SELECT {sql_r6('avg(CASE WHEN lab = 1 THEN h1 END)')} AS top1, {sql_r6('avg(CASE WHEN lab = 1 THEN h3 END)')} AS top_k, {sql_r6('avg(lab)')} AS coverage, count(*) AS incidents,
 {sql_r6('(SELECT sum(n_neg * (tp - n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) FROM a)')} AS node_auc FROM i""")
def root_cause_ranking(spark, sf):
    root = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    c = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_partkey", root.cast("int").alias("is_root"))
    return _r(E.root_cause_ranking(c, "l_orderkey", "l_extendedprice", "is_root", "l_partkey"), "incidents")


LIMITS = [("precision", ">=", 0.70), ("recall", ">=", 0.65), ("false_alarm_rate", "<=", 0.05), ("f1", ">=", 0.15)]


@query("e19_gate", f"WITH {CASCADE}, m AS (SELECT " + ", ".join(f"{RATES[m]} AS {m}" for m, _, _ in LIMITS) + " FROM cc), g AS ("
       + " UNION ALL ".join(f"SELECT '{m}' AS metric, '{op}' AS op, {v}::DOUBLE AS lim, {m}::DOUBLE AS v, {m} {op} {v} AS passed FROM m" for m, op, v in LIMITS)
       + f") SELECT metric, op, lim AS \"limit\", {sql_r6('v')} AS value, passed, bool_and(passed) OVER () AS all_passed FROM g")
def gate(spark, sf):
    return E.gate(_cascade(spark, sf), LIMITS).withColumn("value", r6(F.col("value")))


@query("e22_off_policy", f"""WITH {KE}, r AS (SELECT kpi, CASE WHEN event_type = 'purchase' THEN 0.4 ELSE 0.15 END::DOUBLE / 0.2::DOUBLE AS w FROM ke),
k AS (SELECT w * kpi AS v, count(*) AS n FROM r WHERE w * kpi IS NOT NULL GROUP BY 1), kk AS (SELECT *, {sql_key('mean', 'v')} AS kv FROM k), {SQL_REPLICATES},
d AS (SELECT r, v, {sql_weight('kv', 'n')} AS x FROM kk, rep), m AS (SELECT sum(x * v) / sum(x) AS mean FROM d GROUP BY r HAVING sum(x) > 0),
i AS (SELECT quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m)
SELECT {sql_f32('avg(w * kpi)')} AS value, (SELECT {sql_f32('low')} FROM i) AS low, (SELECT {sql_f32('high')} FROM i) AS high,
 {sql_r6('max(w)')} AS max_weight, {sql_f32('avg(kpi)')} AS logged, (SELECT CAST(low > 0 OR high < 0 AS INTEGER) FROM i) AS excludes_zero FROM r""")
def off_policy(spark, sf):
    target = F.when(F.col("event_type") == "purchase", 0.4).otherwise(0.15)
    out = E.off_policy(kpi_events(spark, sf), "kpi", target, F.lit(0.2), REPLICATES, seed=SEED, key=digit_key)
    return out.select(*[f32(F.col(c)).alias(c) for c in ("value", "low", "high", "logged")], r6(F.col("max_weight")).alias("max_weight"), "excludes_zero")


@query("e23_attribution_ranking", f"""WITH a AS (SELECT 'quantity' AS feature, l_quantity - 25 AS v FROM lineitem UNION ALL SELECT 'discount', l_discount * 100 FROM lineitem
 UNION ALL SELECT 'tax', l_tax * 100 - 4 FROM lineitem), i AS (SELECT feature, avg(abs(v)) AS importance FROM a GROUP BY 1)
SELECT feature, {sql_r6('importance')} AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i""")
def attribution_ranking(spark, sf):
    c = F.col
    long = table(spark, sf, "lineitem").select(F.explode(F.create_map(
        F.lit("quantity"), c("l_quantity") - 25, F.lit("discount"), c("l_discount") * 100,
        F.lit("tax"), c("l_tax") * 100 - 4)).alias("feature", "v"))
    return _r(E.attribution_ranking(long, "feature", "v"), "feature", "rank")


def _tier_sql(name, score, threshold):
    return f"""{name}c AS ({CM.format(pred=f'{score} >= {threshold}', src='sc')}),
{name}k AS (SELECT {score} AS e, sum(is_anomaly) AS n_pos, sum(1 - is_anomaly) AS n_neg FROM sc GROUP BY 1),
{name}a AS (SELECT *, sum(n_pos) OVER w AS tp, sum(n_neg) OVER w AS fp FROM {name}k WINDOW w AS (ORDER BY e DESC ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT *, (SELECT sum(n_neg * (tp - n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) FROM {name}a) AS roc_auc,
 (SELECT sum(n_pos * (tp / (tp + fp))) / sum(n_pos) FROM {name}a) AS pr_auc, (SELECT avg(({score} - is_anomaly) * ({score} - is_anomaly)) FROM sc) AS brier FROM {name}c)"""


_TIER = {"n_positive": "tp + fn", "n_negative": "tn + fp"} | {
    m: RATES[m] for m in ("prevalence", "precision", "recall", "f1", "specificity", "mcc")} | {
    "roc_auc": "roc_auc", "pr_auc": "pr_auc", "brier_score": "brier"}
_BOTH = {"n_total_items": "tp + fp + tn + fn", "n_true_anomalies": "tp + fn", "cascade_precision": RATES["precision"],
         "cascade_recall": RATES["recall"], "cascade_f1": RATES["f1"],
         "cascade_roc_auc": "(SELECT sum(n_neg * (tp - n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) FROM ca)",
         "tier1_reduction_rate": "1 - (SELECT count(*) FROM cs WHERE f) / (SELECT count(*) FROM cs)",
         "total_false_alarm_rate": RATES["false_alarm_rate"], "total_miss_rate": "coalesce(fn / nullif(tp + fn, 0), 0)",
         "n_cascade_positives": "tp + fp", "n_cascade_true_positives": "tp", "n_cascade_false_positives": "fp", "n_cascade_false_negatives": "fn"}
_SAVED = {"daily_anomalies": "round(anom, 1)", "daily_false_alarms": "round(f, 1)", "daily_missed": "round(m, 1)",
          "false_alarms_avoided": "round(fl, 1)", "misses_avoided": "round(ml, 1)",
          "daily_saving": "round(fl * 45 + ml * 500, 0)", "annual_saving": "round((fl * 45 + ml * 500) * 365, 0)"}
_MET = {"tier1_pr_auc": ("(SELECT pr_auc FROM t1)", 0.6), "cascade_precision": (RATES["precision"], 0.7), "cascade_recall": (RATES["recall"], 0.65)}
_GATES = {f"{n}_minimum": least for n, (_, least) in _MET.items()} | {f"{n}_met": f"CAST({m} >= {least} AS INTEGER)" for n, (m, least) in _MET.items()} | {
    "overall_pass": "CAST(" + " AND ".join(f"{m} >= {least}" for m, least in _MET.values()) + " AS INTEGER)"}
_COMPARED = {"val_pr_auc": "v.pr_auc", "test_pr_auc": "t.pr_auc", "pr_auc_delta": "round(t.pr_auc - v.pr_auc, 4)",
             "overfitting_warning": "CAST(t.pr_auc - v.pr_auc < -0.1 AS INTEGER)"}


def _rows_sql(block, metrics, source):
    return [f"SELECT '{block}' AS block, '{m}' AS metric, {sql_r6(f'CAST({e} AS DOUBLE)')} AS value FROM {source}" for m, e in metrics.items()]


@query("a20_metrics_record", f"""WITH {_IMPACT}, {_tier_sql('t1', 's1', 0.1)}, {_tier_sql('t2', 's2', 0.95)}, {_tier_sql('va', 's3', 0.1)},
v AS (SELECT 1920.0::DOUBLE * prev AS anom, fp * 1920.0::DOUBLE / n_items AS f, fn * 1920.0::DOUBLE / n_items AS m,
 greatest(1920 * 0.12::DOUBLE - fp * (1920.0::DOUBLE / n_items), 0) AS fl, greatest(1920.0::DOUBLE * prev * (1 - 0.68::DOUBLE) - fn * (1920.0::DOUBLE / n_items), 0) AS ml FROM im)
""" + " UNION ALL ".join(
    _rows_sql("tier1", {"threshold": 0.1} | _TIER, "t1") + _rows_sql("tier2", {"threshold": 0.95} | _TIER, "t2") + _rows_sql("cascade", _BOTH, "cc")
    + _rows_sql("operational_impact", _SAVED, "v") + _rows_sql("governance_gates", _GATES, "cc")
    + _rows_sql("train_test_comparison", _COMPARED, "t1 AS t, va AS v")))
def metrics_record(spark, sf):
    scored, both = scored_events(spark, sf), _cascade(spark, sf)
    impact = E.daily_impact(both.withColumn("prevalence", (F.col("tp") + F.col("fn")) / F.col("n_items")))
    # the third score stands for the validation run of the first tier
    validation = E.areas(E.score_counts(scored, [], "s3", "is_anomaly"), [], "s3").select(F.col("pr_auc").alias("val_pr_auc"))
    record = E.metrics_record(
        E.tier_block(scored, "s1", "is_anomaly", 0.1), E.tier_block(scored, "s2", "is_anomaly", 0.95), E.cascade_block(both), impact, validation)
    rows = [F.struct(F.lit(b.name).alias("block"), F.lit(m.name).alias("metric"), r6(F.col(f"{b.name}.{m.name}").cast("double")).alias("value"))
            for b in record.schema for m in b.dataType]
    return record.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

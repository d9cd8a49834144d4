"""Feature lineage and model-fitting queries."""

from pyspark.sql import functions as F

from ropeway.catalog.base import KE, kpi_events, query
from ropeway.catalog.windows import SERIES, _fr
from ropeway.functions.scalar import severity
from ropeway.operators import models as M
from ropeway.operators.aggregates import alert_rollup
from ropeway.operators.splits import temporal_split
from ropeway.plans.features import feature_names, feature_table, impute
from ropeway.session import durable


def flagship(spark, sf):
    """Features, peer z, score, severity and the alert rollup per cluster and cell."""
    ft = feature_table(kpi_events(spark, sf), SERIES, ["day", "cluster_id"])
    deviation = F.greatest(F.abs("kpi_z"), F.abs(F.coalesce("peer_z", F.lit(0.0)))) / 5.0
    scored = ft.withColumn("severity", severity(deviation))
    rank = F.when(F.col("severity") == "RED", 3).when(F.col("severity") == "YELLOW", 2).otherwise(1)
    return alert_rollup(scored.withColumn("severity_rank", rank), ["cluster_id", "cell_id"], "severity_rank")


@query("flagship_alert_rollup", f"""WITH {KE}, x AS (SELECT event_id, cell_id, cluster_id, day, kpi, count(kpi) OVER w AS c, avg(kpi) OVER w AS m, stddev_samp(kpi) OVER w AS s FROM ke WINDOW w AS {_fr('96 PRECEDING', '1 PRECEDING')}),
g AS (SELECT day, cluster_id, count(*) AS n, avg(kpi) AS mu FROM ke GROUP BY 1, 2), d AS (SELECT x.*, n, kpi - mu AS d, sum((kpi - mu) * (kpi - mu)) OVER (PARTITION BY day, cluster_id) AS ss FROM x JOIN g USING (day, cluster_id)),
z AS (SELECT cluster_id, cell_id, greatest(abs(CASE WHEN c >= 24 AND s > 0 THEN least(greatest((kpi - m) / s, -5.0), 5.0) ELSE 0 END),
 abs(CASE WHEN n <= 2 THEN 0 ELSE least(greatest(d * n / (n - 1) / (sqrt(greatest((ss - d * d) / (n - 1) - (d / (n - 1)) * (d / (n - 1)), 0.0)) + 1e-6), -5.0), 5.0) END)) / 5 AS dev FROM d)
SELECT cluster_id, cell_id, CAST(max(CASE WHEN dev >= 0.5 THEN 3 WHEN dev >= 0.3 THEN 2 ELSE 1 END) AS INTEGER) AS worst, count(*) AS n, CAST(grouping(cluster_id) * 2 + grouping(cell_id) AS INTEGER) AS level FROM z GROUP BY ROLLUP (cluster_id, cell_id)""")
def flagship_query(spark, sf):
    return flagship(spark, sf)


def _frames(spark, sf):
    ft = feature_table(kpi_events(spark, sf), SERIES, ["day", "cluster_id"])
    names = feature_names(ft, SERIES)
    ready = impute(ft, names).select("event_id", "ts", "is_anomaly", *names)
    # fitting scans the features once per tree level, so they are materialised first
    split = durable(temporal_split(ready, "ts"))
    return names, *(split.where(F.col("split") == s) for s in ("train", "val", "test"))


@query("m3_random_forest")
def random_forest(spark, sf):
    names, train, val, test = _frames(spark, sf)
    return M.held_out(M.fit_forest(train, names, "is_anomaly"), val, test, "is_anomaly")


@query("m4_forest_grid")
def forest_grid(spark, sf):
    names, train, val, test = _frames(spark, sf)
    return M.grid_search(train, val, names, "is_anomaly", test=test)


@query("m5_logistic_baseline")
def logistic_baseline(spark, sf):
    names, train, val, test = _frames(spark, sf)
    return M.held_out(M.fit_logistic(train, names, "is_anomaly"), val, test, "is_anomaly")


@query("m6_feature_importance")
def feature_importance(spark, sf):
    names, train, _, _ = _frames(spark, sf)
    return M.importances(M.fit_forest(train, names, "is_anomaly"), names, train)

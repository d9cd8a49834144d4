"""Scans with contracts, inventories, vendor counters and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ropeway.functions.scalar import finite
from ropeway.operators.joins import first_of_key
from ropeway.plans.segments import windowed
from ropeway.plans.skew import lookup_join


class ContractError(ValueError):
    """A table lacks required columns."""


def check_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def load_counters(spark: SparkSession, path: str, required: Sequence[str], time: str) -> DataFrame:
    """Parquet scan with required columns, UTC time and no NaN or infinities."""
    df = check_columns(spark.read.parquet(path), required)
    floats = {c: finite(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({**floats, time: F.col(time).cast("timestamp")})


def load_inventory(spark: SparkSession, path: str | None, facts: DataFrame, key: str = "cell_id") -> DataFrame:
    """De-duplicated dimension; without a file, the distinct keys of the facts."""
    from pyspark.errors import AnalysisException

    if path is not None:
        try:
            return first_of_key(spark.read.parquet(path), key)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return facts.select(key).distinct()


# Seconds of a reporting period; kbit and kbyte volumes become Mbit/s.
ROP_SECONDS = 900


def normalise_counters(raw: DataFrame, mapping: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Vendor counters to one wide row per key.

    ``raw`` is (keys, vendor, counter, value), ``mapping`` (vendor, counter, name, unit).
    Volumes are divided by the period, rates are left alone.
    """
    v = F.col("value")
    to_mbps = (
        F.when(F.col("unit") == "kbit_volume", v / 1000.0 / ROP_SECONDS)
        .when(F.col("unit") == "kbyte_volume", v * 8.0 / 1000.0 / ROP_SECONDS).otherwise(v))
    long = lookup_join(raw, mapping, ["vendor", "counter"], "inner").select(*keys, "name", to_mbps.alias("v"))
    return long.groupBy(*keys).pivot("name", list(names)).agg(F.max("v"))


def binned_mean(bins: Sequence[Column]) -> Column:
    """Count-weighted mean bin number."""
    counts = [F.coalesce(b, F.lit(0)) for b in bins]
    total = sum(counts[1:], counts[0])
    weighted = sum((c * i for i, c in enumerate(counts)), F.lit(0))
    return weighted / F.nullif(total.cast("double"), F.lit(0.0))


def contract_report(df: DataFrame, ranges: dict[str, tuple[float, float]], id_col: str, id_pattern: str,
                    keys: Sequence[str], inventory: DataFrame, label: str, rate: tuple[float, float],
                    monotone: tuple[str, str, str] | None = None) -> DataFrame:
    """(check, n_bad, passed): ranges with margin, id format, duplicates, orphans, label rate.

    ``monotone`` names an entity, its row order and a time that must not go back along it.
    """
    aggs = []
    for c, (lo, hi) in ranges.items():
        margin = abs(lo) * 0.001 + abs(hi) * 0.001 + 0.01
        aggs.append(F.count_if((F.col(c) < lo - margin) | (F.col(c) > hi + margin)).alias(f"range_{c}"))
    bad_id = ~F.rlike(F.col(id_col).cast("string"), F.lit(id_pattern))
    outside = ~F.avg(label).between(*rate)
    one = df.agg(*aggs, F.count_if(bad_id).alias("id_format"), outside.cast("long").alias("label_rate"))
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    lost = df.join(inventory.select(id_col).distinct(), id_col, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    names = [f"range_{c}" for c in ranges] + ["id_format", "label_rate"]
    parts = one.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("check", "n_bad"))
    extras = [dup, lost]
    if monotone:
        entity, order, time = monotone
        back = F.col(time) < F.col("_before")
        steps = windowed(
            df.select(entity, order, time), [entity], order, 1,
            lambda d, k: d.withColumn("_before", F.lag(time).over(Window.partitionBy(*k).orderBy(order, time))))
        extras.append(steps.agg(F.count_if(back).alias("monotone_time")))
    for extra in extras:
        name = extra.columns[0]
        parts = parts.union(extra.select(F.lit(name), F.col(name)))
    return parts.withColumn("passed", (F.col("n_bad") == 0).cast("int"))


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns outside the exclusion list, each once, in table order."""
    seen = dict.fromkeys(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType))
    return [c for c in seen if c not in set(exclude)]


# Category rules in order of precedence.
IDENTIFIERS = ("cell_id", "site_id", "timestamp", "environment", "cluster_id", "latitude", "longitude", "lat", "lon")
CATEGORY_RULES = (
    ("temporal", ("hour", "day", "week", "rop", "peak", "weekend", "business")),
    ("rolling_statistic", ("_roll",)), ("delta", ("_delta", "_abs_change", "_direction")),
    ("rolling_zscore", ("_zscore",)), ("peer_group_spatial", ("_peer_",)), ("graph_neighbour", ("_neighbour_",)),
    ("data_quality_flag", ("_is_reset",)),
)
RATIOS = ("handover_success_rate", "dl_ul_tput_ratio", "prb_efficiency_mbps_per_pct", "cqi_tput_consistency", "rsrq_rsrp_spread")
RAW_KPIS = ("rsrp_dbm", "rsrq_db", "sinr_db", "avg_cqi", "dl_throughput_mbps", "ul_throughput_mbps", "dl_prb_usage_rate",
            "ul_prb_usage_rate", "active_ue_count", "rrc_conn_setup_success_rate", "cell_availability_pct")

#: What the key columns hold; other columns are described by their name.
DESCRIPTIONS = {
    "rsrp_dbm": "Received power of the reference signal, in dBm; tells coverage.",
    "rsrq_db": "Received quality of the reference signal, in dB; falls with interference.",
    "sinr_db": "Signal over interference and noise, in dB.",
    "avg_cqi": "Mean channel quality that terminals report, 0 to 15.",
    "dl_throughput_mbps": "Downlink throughput of the cell, in Mbps.",
    "ul_throughput_mbps": "Uplink throughput of the cell, in Mbps.",
    "dl_prb_usage_rate": "Used share of downlink resource blocks, in percent.",
    "ul_prb_usage_rate": "Used share of uplink resource blocks, in percent.",
    "active_ue_count": "Terminals scheduled in the period.",
    "rrc_conn_setup_success_rate": "Share of connection setups that succeed, in percent.",
    "ho_attempt_count": "Handovers tried in the period.",
    "ho_success_count": "Handovers completed in the period.",
    "cell_availability_pct": "Share of the period in which the cell is in service, in percent.",
    "handover_success_rate": "Completed over tried handovers, in percent; 100 without a try.",
    "dl_ul_tput_ratio": "Downlink over uplink throughput.",
    "prb_efficiency_mbps_per_pct": "Downlink Mbps for each percent of used resource blocks.",
    "cqi_tput_consistency": "Throughput over what the channel quality promises; about 1 in a healthy cell.",
    "rsrq_rsrp_spread": "Power less quality of the reference signal, in dB; grows with interference.",
}


def category(name: str, labels: Sequence[str] = ("is_anomaly", "anomaly_type")) -> str:
    if name in IDENTIFIERS:
        return "identifier"
    if name in labels:
        return "label"
    for kind, marks in CATEGORY_RULES:
        if kind == "data_quality_flag" and name in RATIOS + RAW_KPIS:
            return "cross_kpi_ratio" if name in RATIOS else "raw_kpi"
        if any(m in name for m in marks) and not (kind == "rolling_zscore" and "peer" in name):
            return kind
    return "other"


def feature_catalogue(df: DataFrame) -> DataFrame:
    """One row per column with its type, category, description and filled rows."""
    parts = [
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.lit(category(f.name)).alias("category"), F.lit(DESCRIPTIONS.get(f.name, f"Feature column: {f.name}")).alias("description"),
                 F.count(f.name).alias("filled"))
        for f in df.schema.fields]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("r")).select("r.*")


def absent_periods(df: DataFrame, cell: str, time: str, seconds: int) -> DataFrame:
    """Period grid per cell with ``present`` and ``absent`` (missing twice in a row)."""
    from pyspark.sql import Window

    slot = F.floor(F.unix_timestamp(time) / seconds)
    seen = df.select(cell, slot.alias("slot")).distinct()
    span = seen.agg(F.struct(F.min("slot").alias("a"), F.max("slot").alias("b"))).scalar()
    spine = seen.select(cell).distinct().withColumn("slot", F.explode(F.sequence(span["a"], span["b"])))
    grid = spine.join(seen.withColumn("present", F.lit(1)), [cell, "slot"], "left").withColumn(
        "present", F.coalesce("present", F.lit(0)))
    # one row per cell and period: bounded by the length of the period grid
    before = F.lag("present").over(Window.partitionBy(cell).orderBy("slot"))
    return grid.withColumn("absent", ((F.col("present") == 0) & (before == 0)).cast("int")).withColumn(
        "absent", F.coalesce("absent", F.lit(0)))

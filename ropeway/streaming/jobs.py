"""Sources, sinks and stateless or built-in stateful stream jobs.

A stateful query keeps for life the number of state partitions that
``spark.sql.shuffle.partitions`` has when it first starts.  The caller chooses it on
the session the stream is read with (``spark.newSession()`` gives a stream its own).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ropeway.operators.aggregates import tumbling
from ropeway.operators.drift import count_report
from ropeway.plans.prefix import value_counts
from ropeway.streaming.stateful import corroborated  # noqa: F401


def file_stream(spark: SparkSession, folder: str, schema, name: str = "*.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Parquet file source; the schema is explicit, so new columns need a restart (see ``project_payload``)."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """One topic per interface; needs the Kafka connector on the classpath."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_per_trigger).load()
    )


def append_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").format("parquet")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
               once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()


def window_features(stream: DataFrame, keys: Sequence[str], time: str, kpi: str, critical: Column, success: Column,
                    width: str, delay: str = "30 minutes") -> DataFrame:
    """Same aggregation as the batch one; p95 comes from the mergeable sketch."""
    return tumbling(stream.withWatermark(time, delay), keys, time, kpi, critical, success, width, streaming=True)


def sliding_count(stream: DataFrame, keys: Sequence[str], time: str, critical: Column, width: str = "1 hour",
                  slide: str = "15 minutes", delay: str = "30 minutes") -> DataFrame:
    marked = stream.withWatermark(time, delay) if stream.isStreaming else stream
    out = marked.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count_if(critical).alias("critical"))
    return out.select(F.col("w.end").alias("window_end"), *keys, "critical")


def route_late(main: str, late: str, high_water: str, time: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: rows behind the high-water mark go to the late table.

    The mark is the largest event time of earlier batches less the delay, kept as
    one row per batch, so a replayed batch reads the mark it saw the first time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        from pyspark.errors import AnalysisException

        try:
            seen = spark.read.parquet(high_water).where(F.col("batch") < batch_id)
            mark = seen.agg(F.max("top")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            mark = None  # the first batch
        limit = F.lit(mark) - F.make_dt_interval(secs=F.lit(delay_seconds).cast("decimal(18,6)")) if mark else None
        behind = (F.col(time) < limit) if mark else F.lit(False)
        batch = batch.persist()
        try:
            for path, rows in ((main, batch.where(~behind)), (late, batch.where(behind))):
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            top = batch.agg(F.max(time).alias("top"))
            top.write.mode("overwrite").parquet(f"{high_water}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def project_payload(raw: DataFrame, fields: dict[str, str], payload: str = "value") -> DataFrame:
    """Known fields of a JSON payload; an added field never stops the query and stays in ``payload``."""
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    return raw.withColumn("_p", F.from_json(payload, schema)).select("*", *[F.col(f"_p.{n}") for n in fields]).drop("_p")


def drop_repeats(stream: DataFrame, event_id: str, time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])


def incidents(df: DataFrame, keys: Sequence[str], time: str, gap: str = "30 minutes", delay: str = "30 minutes") -> DataFrame:
    """Consecutive flagged rows as one session."""
    marked = df.withWatermark(time, delay) if df.isStreaming else df
    out = marked.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("flags"))
    return out.select(*keys, F.col("s.start").alias("started"), F.col("s.end").alias("closed"), "flags")


def with_delayed_truth(predictions: DataFrame, truth: DataFrame, key: str, time: str, truth_time: str,
                       horizon: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Prediction with its later ground truth; unlabelled ones leave after the horizon."""
    p = predictions.withWatermark(time, delay)
    t = truth.withColumnRenamed(key, "_truth_key").withWatermark(truth_time, delay)
    near = f"_truth_key = {key} AND {truth_time} >= {time} AND {truth_time} <= {time} + INTERVAL {horizon}"
    return p.join(t, F.expr(near), "leftOuter").drop("_truth_key")


def newest(rows: DataFrame, time: str, tie: str, keep: int) -> DataFrame:
    """The last ``keep`` rows of each feature: the last ones of every hashed share first, then those of all shares.

    No task sorts more of a feature than its share or ``keep`` rows a share.
    """
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for by in (["feature", "_share"], ["feature"]):
        order = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col(tie).desc())
        if "_share" in by:
            rows = rows.withColumn("_share", F.pmod(F.xxhash64(time, tie), F.lit(shares)))
        rows = rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= keep).drop("_rn")
    return rows.drop("_share")


def monitor_drift(reference: DataFrame, state: str, reports: str, time: str, tie: str, keep: int = 5000) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: newest ``keep`` values per feature and their drift report.

    Batches are (feature, value, time, tie); values that are no number are not kept.
    The reference (feature, value) is counted once, its counts are part of the state
    and every report reads them.  The kept rows of batch n are written beside those
    of n-1, so a retried batch starts from the same state.
    """
    counts = f"{state}/reference"
    value_counts(reference, ["feature"], "value", {"n_ref": F.lit(1)}).write.mode("overwrite").parquet(counts)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("feature", "value", time, tie).where("value IS NOT NULL AND NOT isnan(value)")
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{state}/{batch_id - 1}"))
        newest(rows, time, tie, keep).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        ref = spark.read.parquet(counts).withColumn("n_cur", F.lit(0).cast("long"))
        cur = value_counts(spark.read.parquet(f"{state}/{batch_id}"), ["feature"], "value", {"n_cur": F.lit(1)})
        both = ref.unionByName(cur.withColumn("n_ref", F.lit(0).cast("long"))).groupBy("feature", "value").agg(
            F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
        # features without a reference have no report
        known = both.join(spark.read.parquet(counts).select("feature").distinct(), "feature", "left_semi")
        count_report(known).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{reports}/{batch_id}")

    return write

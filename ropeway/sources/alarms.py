"""Alarm JSON of both event-format versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "struct<commonEventHeader: struct<domain: string, eventId: string, eventName: string, sourceName: string,"
    " reportingEntityId: string, reportingEntityName: string, priority: string, startEpochMicrosec: bigint,"
    " lastEpochMicrosec: bigint, sequence: int, timeZoneOffset: string>,"
    " faultFields: struct<alarmCondition: string, eventSeverity: string, specificProblem: string, vfStatus: string>>"
)
PAYLOAD = f"struct<event: {EVENT}, eventList: array<{EVENT}>, _corrupt_record: string>"


def _default(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def parse_alarms(raw: DataFrame, payload: str = "value") -> tuple[DataFrame, DataFrame]:
    """(alarms, rejects): a batch yields one row per event, a single event one row.

    Works on batch and streaming frames; text that is neither form is a reject.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = raw.withColumn("_p", F.from_json(F.col(payload), PAYLOAD, options))
    p = F.col("_p")
    batch = p["eventList"].isNotNull()
    good = p["_corrupt_record"].isNull() & (batch | p["event"].isNotNull())
    good = F.coalesce(good, F.lit(False))
    rejects = parsed.where(~good).drop("_p")
    offset = p["event"]["commonEventHeader"]["timeZoneOffset"]
    version = F.when(batch | offset.isNotNull(), "7.2").otherwise("7.1")
    keep = [c for c in raw.columns if c != payload]
    rows = parsed.where(good).select(
        *keep, version.alias("version"), F.explode(F.coalesce(p["eventList"], F.array(p["event"]))).alias("e"))
    h, f = F.col("e.commonEventHeader"), F.col("e.faultFields")
    alarms = rows.select(
        *keep, "version", _default(h["domain"], "fault").alias("domain"), _default(h["eventId"], "").alias("event_id"),
        _default(h["eventName"], "").alias("event_name"), _default(h["sourceName"], "").alias("source_name"),
        F.timestamp_micros(_default(h["startEpochMicrosec"], 0)).alias("start_ts"),
        F.timestamp_micros(_default(h["lastEpochMicrosec"], 0)).alias("last_ts"),
        _default(h["priority"], "Normal").alias("priority"), _default(h["sequence"], 0).alias("sequence"),
        h["reportingEntityId"].alias("reporting_entity_id"), h["reportingEntityName"].alias("reporting_entity_name"),
        h["timeZoneOffset"].alias("time_zone_offset"), f["alarmCondition"].alias("alarm_condition"),
        f["eventSeverity"].alias("severity"), f["specificProblem"].alias("specific_problem"), f["vfStatus"].alias("vf_status"))
    return alarms, rejects

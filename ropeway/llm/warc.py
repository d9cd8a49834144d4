"""WARC archives: a distributed writer and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.llm.base import query, stored, table
from ropeway.session import scratch_path

#: Payload bytes from which an equal payload is written as a revisit.
REVISIT_FROM = 1000
#: Records of one archive at most, which bounds what a reading task holds.
RECORDS_PER_FILE = 5_000
#: Bytes given to the decompressor at once.
STEP = 1 << 16
#: Rows that the reader hands on at once.
ROWS_OUT = 256

# The version line, a record's end, mandatory fields and the profile of identical payloads.
VERSION, END = b"WARC/1.0\r\n", b"\r\n\r\n"
NEEDED = {"warc-record-id", "warc-type", "warc-date", "content-length"}
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: An empty gzip member; its last byte is zero and stands for the text writer's separator.
_EMPTY = gzip.compress(b"", mtime=0)


def _labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record, ending in two line ends; a revisit when ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    lines += [
        f"WARC-Payload-Digest: {_labelled(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: {_labelled(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def _records(batches: Iterator[pa.RecordBatch], compress: bool, date: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = ("record_id", "url", "payload", "refers_to")
        for row in zip(*(batch[n].to_pylist() for n in names), strict=True):
            data = record(*row, date)
            out = gzip.compress(data, 6, mtime=0) + _EMPTY if compress else data
            yield pa.RecordBatch.from_pydict({"data": pa.array([out[:-1]], pa.binary())})


def record_id(page: Column, sha: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), sha)


def write_warc(pages: DataFrame, path: str, compress: bool = True, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to archives in folder ``path``.

    The payload is the html in UTF-8, empty for NULL.  Of equal payloads of at least
    1000 bytes that with the largest page_id is a response, the others are revisits
    that refer to it; smaller ones are all responses.  Rows without page_id can only
    be a response where no row of their group has one, rows that repeat the largest
    id are all responses.  A NULL url leaves its header out, an empty table writes no
    record.  Archives are written by Spark's text writer, so a lost task leaves
    nothing behind; a record keeps all but its last byte, which the writer adds.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    groups = stored(
        pages.select("page_id", payload.alias("payload"))
        .where(F.octet_length("payload") >= REVISIT_FROM)
        .groupBy(F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n"))
        .agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("sha", "n", "target"),
        "equal-payloads",
    )
    same = (rows["sha"] == groups["sha"]) & (F.octet_length("payload") == groups["n"])
    joined = rows.join(groups.hint("merge"), same, "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    ready = joined.select(
        record_id(F.col("page_id"), rows["sha"]).alias("record_id"),
        "url",
        "payload",
        F.when(revisit, record_id(F.col("target"), rows["sha"])).alias("refers_to"),
    )
    data = ready.mapInArrow(lambda batches: _records(batches, compress, date), "data binary")
    (
        data.select(F.col("data").cast("string").alias("value"))
        .write.option("lineSep", "\0" if compress else "\n")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


class Damaged(ValueError):
    """A record or member that fails a check."""


def parse_record(data, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and where it ends; raises Damaged where a check fails."""
    if data[at : at + 5] != b"WARC/":
        raise Damaged("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damaged("header without end")
    head = data[at:stop].split(b"\r\n")
    fields: dict[str, str] = {}
    for line in head[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not NEEDED <= fields.keys():
        raise Damaged("header lacks a mandatory field")
    if head[0] not in (b"WARC/1.0", b"WARC/1.1") or not fields.get("content-length", "").isdecimal():
        raise Damaged("version or length unreadable")
    start = stop + len(END)
    end = start + int(fields["content-length"])
    if data[end : end + len(END)] != END:
        raise Damaged("block without end")
    block = data[start:end]
    _check(fields.get("warc-block-digest"), block, "block")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(END)[2]
    if fields.get("warc-type") != "revisit":
        _check(fields.get("warc-payload-digest"), payload, "payload")
    return fields | {"payload": payload}, end + len(END)


def _check(label: str | None, data: bytes, what: str) -> None:
    if label and label.startswith("sha1:") and label != _labelled(hashlib.sha1(data).digest()):
        raise Damaged(f"{what} digest differs")


def inflate(data, at: int) -> tuple[bytes, int]:
    """The gzip member that starts at ``at`` and where it ends; its checksum is verified."""
    stream, out, pos = zlib.decompressobj(31), [], at
    try:
        while not stream.eof:
            if pos >= len(data):
                raise Damaged("member without end")
            out.append(stream.decompress(data[pos : pos + STEP]))
            pos += STEP
    except zlib.error as e:
        raise Damaged(str(e)) from e
    return b"".join(out), min(pos, len(data)) - len(stream.unused_data)


def _unit(data, at: int) -> tuple[list[tuple], int]:
    """What starts at ``at``: a record, or a member with its records and inner gaps."""
    if data[at : at + 2] != b"\x1f\x8b":
        fields, end = parse_record(data, at)
        return [("record", at, end - at, fields)], end
    content, end = inflate(data, at)
    inside = list(salvage(content))
    if content and not any(kind == "record" for kind, *_ in inside):
        raise Damaged("member without a valid record")
    return [(kind, at, end - at, x if kind == "record" else f"inside member: {x}") for kind, _, _, x in inside], end


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, length, fields) and ("gap", offset, length, reason) of an archive, in order.

    After a failed check the search goes on from the next byte for a member or a
    version line that passes all checks; the bytes between are one gap.
    """
    at, n = 0, len(data)
    while at < n:
        if data[at] in b"\r\n\0":  # padding between records
            at += 1
            continue
        try:
            found, end = _unit(data, at)
        except Damaged as e:
            reason, begin = str(e), at
            at, found, end = _next(data, at + 1)
            yield "gap", begin, at - begin, reason
        yield from found
        at = max(at, end)


def _next(data, at: int) -> tuple[int, list, int]:
    """The next place from ``at`` where a valid unit starts, the unit and its end."""
    while True:
        places = [p for p in (data.find(b"\x1f\x8b\x08", at), data.find(b"WARC/1.", at)) if p >= 0]
        if not places:
            return len(data), [], len(data)
        at = min(places)
        try:
            found, end = _unit(data, at)
            return at, found, end
        except Damaged:
            at += 1


_COLUMNS = {
    "kind": pa.string(), "offset": pa.int64(), "length": pa.int64(), "reason": pa.string(), "record_type": pa.string(),
    "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "payload_label": pa.string(), "payload": pa.binary(),
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), *_COLUMNS.items()])
    for batch in batches:
        for i in range(batch.num_rows):
            path, rows = batch["path"][i].as_py(), []
            for kind, at, size, x in salvage(batch["content"][i].as_py()):
                got = x if kind == "record" else {}
                bare = {k: got[k].strip("<>") for k in ("warc-record-id", "warc-refers-to") if k in got}
                rows.append((path, kind, at, size, None if got else x, got.get("warc-type"), bare.get("warc-record-id"),
                             bare.get("warc-refers-to"), got.get("warc-target-uri"), got.get("warc-payload-digest"), got.get("payload")))
                if len(rows) == ROWS_OUT:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of all archives in folder ``path``.

    One row each: path, kind (record or gap), offset and length in the file, reason
    (of a gap), record_type, record_id, refers_to, target_uri, payload_label (the
    digest its header states) and payload.  A record passes its framing, its block and
    payload digests and, in a member, the checksum.  A record in a damaged stretch is
    a gap up to the next one that passes.  Each archive is read by one task, which
    holds it whole (2 GB at most).  An empty folder or file gives no row.
    """
    names = "path string, kind string, offset bigint, length bigint, reason string, record_type string, record_id string, " \
        "refers_to string, target_uri string, payload_label string, payload binary"
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read, names)


def captures(records: DataFrame) -> DataFrame:
    """record_id, record_type, payload_bytes, payload_digest and refers_to of every record.

    A revisit has size and digest of the response it refers to; they are NULL where
    that response is lost.
    """
    own = stored(
        records.where("kind = 'record'").select(
            "record_id", "record_type", "refers_to",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")),
        "captures",
    )
    responses = own.where("record_type = 'response'")
    # a table of its own keeps both sides of the join bare exchanges, whose hot partitions can be split
    held = stored(
        responses.join(own.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("refers_to"))
        .agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest")),
        "referred",
    )
    revisits = own.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(held.hint("merge"), "refers_to", "left")
    return responses.unionByName(revisits)


@query(
    "op2_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS n, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS target FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> target THEN target END AS refers_to FROM g
""",
)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf, "pages"), path)

    def page(c):
        return F.regexp_extract(c, r"^urn:page:(-?\d+):", 1).try_cast("bigint")

    return captures(read_warc(spark, path)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))

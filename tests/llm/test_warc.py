import gzip
import random

import pytest

from ropeway.llm import warc
from ropeway.session import scratch_path

DATE = "2000-01-01T00:00:00Z"


def archive(n, compress):
    parts = [warc.record(f"urn:page:{i}:x", f"http://h/{i}", (f"<p>{i}</p>" * (i + 1)).encode(), None, DATE) for i in range(n)]
    return [gzip.compress(p, mtime=0) for p in parts] if compress else parts


@pytest.mark.parametrize("compress", [True, False])
def test_damage_loses_only_what_it_hits(compress):
    r = random.Random(6)
    for _ in range(40):
        parts = archive(12, compress)
        hit = set(r.sample(range(12), r.randint(1, 4)))
        damaged = []
        for i, p in enumerate(parts):
            if i in hit:
                p = bytearray(p)
                way = r.randrange(3)
                if way == 0:
                    at = r.randrange(10, len(p) - 8)
                    p[at] ^= 0x55
                elif way == 1:
                    del p[len(p) // 2 :]
                else:
                    p = bytearray(r.randbytes(30))
            damaged.append(bytes(p))
        data = b"".join(damaged)
        out = list(warc.salvage(data))
        found = {x["warc-record-id"] for kind, *_, x in out if kind == "record"}
        assert {f"<urn:page:{i}:x>" for i in range(12) if i not in hit} <= found
        # every byte is in a record, a gap or padding, and nothing overlaps
        at = 0
        for _, offset, length, _ in sorted(set((k, o, n, "") for k, o, n, _ in out), key=lambda x: x[1]):
            assert not data[at:offset].strip(b"\r\n\0")
            assert offset >= at
            at = offset + length
        assert not data[at:].strip(b"\r\n\0")


def test_damage_without_error_leaves_no_gap():
    assert [k for k, *_ in warc.salvage(b"".join(archive(5, True)))] == ["record"] * 5
    assert list(warc.salvage(b"")) == []
    assert [k for k, *_ in warc.salvage(b"junk only")] == ["gap"]


def test_round_trip(spark):
    long = "é" * 700
    rows = [(1, "u", long), (2, None, long), (3, "u\r\nx", long), (4, "u", "short"), (5, "u", "short"), (6, None, None), (7, "u", ""),
            (None, "u", long), (3, "u", long), (8, "u", "WARC/1.0\r\nContent-Length: 3\r\n\r\n" * 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS sha", "2 AS payload")
    for compress in (True, False):
        path = scratch_path(spark, "t-warc")
        warc.write_warc(pages, path, compress=compress)
        read = warc.read_warc(spark, path)
        assert read.where("kind = 'gap'").count() == 0
        out = warc.captures(read).collect()
        assert len(out) == len(rows)
        by = sorted((r.record_id.split(":")[2], r.record_type, r.payload_bytes) for r in out)
        assert by == sorted([("1", "revisit", 1400), ("2", "revisit", 1400), ("3", "response", 1400), ("3", "response", 1400), ("none", "revisit", 1400),
                             ("4", "response", 5), ("5", "response", 5), ("6", "response", 0), ("7", "response", 0), ("8", "response", len(rows[-1][2]))])
        assert {r.refers_to.split(":")[2] for r in out if r.refers_to} == {"3"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = scratch_path(spark, "t-warc")
    warc.write_warc(pages, path)
    assert warc.captures(warc.read_warc(spark, path)).count() == 0

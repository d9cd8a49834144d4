import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ropeway.operators import documents as DOC
from ropeway.operators import geo
from ropeway.operators import graph as G
from ropeway.operators import rules as R
from ropeway.operators.privacy import padded_keys, pseudonymise
from ropeway.session import ROWS_PER_TASK

T0 = datetime(2024, 1, 1)


def test_components_of_paths_stars_and_long_chains(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 7), (7, 6)] + [(100 + i, 101 + i) for i in range(64)] + [(300, 301 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in G.components(df, "a", "b").collect()}
    assert got[3] == 1 and got[5] == 4 and got[7] == 6 and got[164] == 100 and got[330] == 300
    assert len(set(got.values())) == 5


def test_shared_key_is_a_star(spark):
    rows = spark.createDataFrame([(m, "d") for m in range(50)] + [(99, "solo")], "m long, k string")
    links = G.shared_key_links(rows, "m", "k")
    assert links.count() == 49 and links.select("source").distinct().first()[0] == 0


def brute_relations(cells, k, reach):
    import math

    def km(a, b):
        p1, p2 = math.radians(a[3]), math.radians(b[3])
        x = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(b[4]) - math.radians(a[4])) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))

    out = set()
    for a in cells:
        near = sorted((km(a, b), b[0]) for b in cells if b[0] != a[0] and (km(a, b) <= reach or a[1] == b[1]))
        out |= {(a[0], b) for _, b in near[:k]}
    return out


@pytest.mark.parametrize("rows_per_task", ["2000000", "8"])
def test_crowded_spots_and_sparse_sites_equal_brute_force(spark, rows_per_task):
    rng = random.Random(9)
    cells = [(i, i // 3, i % 2, -37.0, 144.0) for i in range(30)]                       # one spot holds a third
    cells += [(30 + i, 50 + i, i % 2, -37.0 + rng.uniform(0, 0.002), 144.0 + rng.uniform(0, 0.002)) for i in range(30)]
    cells += [(60 + i, 100 + i // 2, i % 2, -37.0 + rng.uniform(-0.1, 0.1), 144.0 + rng.uniform(-0.1, 0.1)) for i in range(30)]
    df = spark.createDataFrame(cells, "id long, site long, band int, lat double, lon double")
    spark.conf.set(ROWS_PER_TASK, rows_per_task)
    try:
        got = {(r["source"], r["target"]) for r in geo.neighbour_relations(df, 4, 5.0).collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    assert got == brute_relations(cells, 4, 5.0)


def brute_locks(props, seconds):
    held, out = {}, {}
    for t, a, cells in sorted(props):
        free = all(c not in held or (t - held[c]).total_seconds() >= seconds for c in cells)
        out[a] = int(free)
        if free:
            held.update({c: t for c in cells})
    return out


@pytest.mark.parametrize("rows_per_task", ["2000000", "8"])
def test_locks_equal_sequential_registry(spark, rows_per_task):
    rng = random.Random(6)
    props = [(T0 + timedelta(seconds=rng.randint(0, 1500)), a, sorted({rng.randint(0, 5) if rng.random() < 0.6 else 0 for _ in range(2)})) for a in range(24)]
    df = spark.createDataFrame([(a, c, t) for t, a, cs in props for c in cs], "a long, c long, ts timestamp")
    spark.conf.set(ROWS_PER_TASK, rows_per_task)
    try:
        got = {r["a"]: r["approved"] for r in R.lock_decisions(df, "a", "c", "ts").collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    assert got == brute_locks(props, 300)


def test_two_proposals_on_one_cell(spark):
    df = spark.createDataFrame([(1, 1, T0), (2, 1, T0 + timedelta(seconds=100)), (3, 1, T0 + timedelta(seconds=400))], "a long, c long, ts timestamp")
    assert {r["a"]: r["approved"] for r in R.lock_decisions(df, "a", "c", "ts").collect()} == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("rows_per_task", ["2000000", "15"])
def test_breaker_segments_equal_the_sequential_machine(spark, rows_per_task):
    rng = random.Random(12)
    calls, t = [], 0.0
    for i in range(240):
        t += rng.choice([1, 5, 30, 70])
        calls.append((i, 0 if i % 4 else 1, T0 + timedelta(seconds=t), rng.random() > (0.6 if (i // 40) % 2 else 0.1)))
    df = spark.createDataFrame(calls, "i long, e long, ts timestamp, ok boolean")
    spark.conf.set(ROWS_PER_TASK, rows_per_task)
    try:
        got = {r["i"]: (r["state_before"], r["tried"], r["state_after"]) for r in R.breaker_timeline(df, "e", "ts", "i", "ok").collect()}
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    names = {"C": "closed", "O": "open", "H": "half_open"}
    machines, want = {}, {}
    for i, e, at, ok in calls:
        m = machines.setdefault(e, R.Breaker())
        seen, used = m.call((at - datetime(1970, 1, 1)).total_seconds(), ok)
        want[i] = (names[seen], int(used), names[m.state])
    assert got == want


def test_five_failures_open_and_three_successes_close():
    m = R.Breaker()
    for k in range(5):
        m.call(k, False)
    assert m.state == "O" and m.call(30, True) == ("O", False)
    assert m.call(70, True) == ("H", True)
    m.call(71, True), m.call(72, True)
    assert m.state == "C" and R.Breaker(m.dump()).dump() == m.dump()


def test_releases(spark):
    cat = spark.createDataFrame(
        [("1.3.0", False, [], False, False), ("1.4.0", False, [], False, False), ("1.4.1", False, [], False, True), ("2.0.0", False, [], False, False),
         ("2.1.0", False, [], True, False), ("1.2.9", True, [], False, False), ("1.2.5", False, ["1.2.0"], False, False), ("bad", False, [], False, False)],
        "version string, blocked boolean, blocklist array<string>, cross_major_allowed boolean, allow_skip boolean")
    assert [r["version"] for r in R.compatible_releases(cat, "1.2.0").collect()] == ["1.3.0", "1.4.1", "2.1.0"]
    with pytest.raises(ValueError):
        R.compatible_releases(cat, "next")


def test_chunk_lengths(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (10, 2048, 2049, 5000)], "d long, t string")
    out = DOC.chunk(df, "d", "t")
    assert {r["d"]: r["count"] for r in out.groupBy("d").count().collect()} == {10: 1, 2048: 1, 2049: 2, 5000: 3}
    end = out.where("d = 5000 AND chunk_no = 2").select(F.length("chunk_text")).first()[0]
    assert 2 * 1792 + end == 5000


def test_vector_search_in_query_blocks(spark):
    rng = random.Random(1)
    vec = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(99, None)]
    corpus = spark.createDataFrame(vec, "vec_id long, v array<double>")
    queries = spark.createDataFrame(vec[:30], "q long, v array<double>")
    rows = lambda *b: sorted((r["q"], r["rank"], r["vec_id"]) for r in DOC.nearest_vectors(corpus, queries, "vec_id", "q", "v", 3, *b).collect())
    whole = rows()
    assert len(whole) == 90 and whole == rows(8, 60)
    assert all(v == q for q, rank, v in whole if rank == 1)
    assert DOC.nearest_vectors(corpus.where("false"), queries, "vec_id", "q", "v").count() == 0
    assert DOC.nearest_vectors(corpus, queries.where("false"), "vec_id", "q", "v").count() == 0


def test_many_queries_equal_brute_force(spark, monkeypatch):
    """More queries than any block, ties by id, and a plan that does not grow with them."""
    monkeypatch.setattr(DOC, "STEP", 16)
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(120, 4)).round(1) + 0.05
    vecs[60:70] = vecs[0]
    asked = rng.normal(size=(10_500, 4)) + 0.01
    corpus = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(vecs)], "c string, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q int, v array<double>").repartition(4)
    found = DOC.nearest_vectors(corpus, queries, "c", "q", "v", 4, 3000, 200)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append((r["c"], round(r["score"], 9)))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = (unit(asked) @ unit(vecs).T).round(9)
    for i in range(len(asked)):
        best = sorted(range(120), key=lambda c: (-scores[i, c], c))[:4]
        assert [s for _, s in got[i]] == [scores[i, c] for c in best]
        if len({scores[i, c] for c in best}) == 4:
            assert [c for c, _ in got[i]] == [f"c{c:03d}" for c in best]


def test_hmac_equals_library(spark):
    import hashlib
    import hmac

    inner, outer = padded_keys(b"k" * 100)
    secrets = spark.createDataFrame([(bytearray(inner), bytearray(outer))], "inner binary, outer binary")
    got = pseudonymise(spark.createDataFrame([("msisdn-1",)], "s string"), "s", secrets).first()["token"]
    assert got == hmac.new(b"k" * 100, b"msisdn-1", hashlib.sha256).hexdigest()

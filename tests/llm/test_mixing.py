import random
from collections import Counter

import pytest

from ropeway.llm import mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by dealing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > most * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture
def corpus(docs):
    r = random.Random(3)
    rows = []
    for i in range(300):
        source = r.choice(["a"] * 5 + ["b", "c", "é", None])
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 40, 90])) or None, "en", source))
    rows += [rows[7], rows[7], (None, "x y z", None, "a")]
    return docs(rows), rows


def test_targets_and_words_are_exact(spark, corpus):
    frame, rows = corpus
    sizes = mixing.sized(frame)
    own = Counter()
    for _, text, _, source in rows:
        own[source] += len((text or "").split())
    want = fill(own)
    got = {r.origin[1:] or None: r.target for r in mixing.targets(sizes).collect()}
    assert got == pytest.approx({s if s else None: t for s, t in want.items()})
    manifest = mixing.mix(sizes, block_words=16, shard_words=200).cache()
    taken = Counter()
    for r in mixing.taken(sizes, manifest).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[r.origin[1:] or None] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 16 * 3
    places = manifest.groupBy("doc_id", "source", "size", "pass", "block").count()
    assert places.where("count > 1").count() == 0
    shards = {r.shard: r["count"] for r in manifest.groupBy("shard").count().collect()}
    assert len(shards) >= 8 and len(shards) & (len(shards) - 1) == 0
    assert max(shards.values()) - min(shards.values()) <= 1
    assert mixing.mix(sizes, block_words=16, shard_words=200).exceptAll(manifest).count() == 0


def test_quotas_follow_the_hypergeometric_law(spark):
    """Over many seeds the left child's share has the mean and spread of drawing without replacement."""
    quotas = spark.createDataFrame([("sa", 40), ("sb", 25), ("sc", 1)], "origin string, n bigint")
    lefts = []
    for seed in range(60):
        out = mixing.shard_quotas(quotas, 2, f"s{seed}").collect()
        by = {(r.shard, r.origin): r.n for r in out}
        assert sum(n for (s, _), n in by.items() if s == 0) == 33
        assert {o: sum(n for (_, p), n in by.items() if p == o) for o in ("sa", "sb", "sc")} == {"sa": 40, "sb": 25, "sc": 1}
        lefts.append(by.get((0, "sa"), 0))
    mean = sum(lefts) / len(lefts)
    spread = sum((x - mean) ** 2 for x in lefts) / len(lefts)
    assert abs(mean - 20) < 1.2 and 1.5 < spread < 8  # 20 and 4


def test_large_quotas(spark):
    quotas = spark.createDataFrame([("sa", 300_000), ("sb", 1), ("sc", 99_999)], "origin string, n bigint")
    out = mixing.shard_quotas(quotas, 16).collect()
    assert {o: sum(r.n for r in out if r.origin == o) for o in ("sa", "sb", "sc")} == {"sa": 300_000, "sb": 1, "sc": 99_999}
    for shard in range(16):
        assert sum(r.n for r in out if r.shard == shard) == 25_000
        a = next(r.n for r in out if r.shard == shard and r.origin == "sa")
        assert abs(a - 18_750) < 600


def test_materialised_rows(spark, docs):
    frame = docs([(1, " a  b c d ", "en", "s"), (2, "e f", "en", "s"), (3, None, None, None), (4, "", None, "t")])
    frame = frame.withColumnRenamed("lang", "size").selectExpr("*", "'x' AS start")
    out = mixing.mixed(spark, frame)
    assert out.columns == frame.columns
    words = sum(len(r.text.split()) for r in out.collect())
    assert words == 9  # 150 % of six
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_empty(spark, docs):
    empty = docs([(1, "a", None, "s")]).where("false")
    assert mixing.mixed(spark, empty).count() == 0
    assert mixing.taken(mixing.sized(empty), mixing.mix(mixing.sized(empty))).count() == 0

from ropeway.llm import exact
from ropeway.llm.base import stored


def test_groups_and_repeats(spark, docs):
    rows = [(5, "a  b"), (2, "a\tb"), (9, None), (7, ""), (None, "a b"), (3, "x" * 200_000), (4, "x" * 200_000), (2, "a b"), (None, "only"), (8, " ")]
    frame = docs(rows).selectExpr("*", "1 AS digest", "2 AS keep_id", "3 AS _row")
    digests = stored(exact.digests(frame), "t")
    out = exact.decide(exact.build_index(spark, digests), digests).collect()
    kept = sorted((r.doc_id is None, r.doc_id) for r in out if r.kept)
    assert kept == [(False, 2), (False, 3), (False, 7), (False, 8), (True, None)]
    assert {r.group_size for r in out if r.doc_id in (2, 5)} == {4}
    left = exact.deduplicated(spark, frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 2, 3, 7, 8]


def test_index_over_batches_and_replays(spark, docs):
    from ropeway.session import scratch_path

    index = exact.DigestIndex(spark, scratch_path(spark, "t-index"), 16)
    first = exact.digests(docs([(1, "a"), (2, "b"), (3, "a")]))
    later = exact.digests(docs([(0, "b"), (9, "c"), (10, "c")]))
    index.ingest(first)
    index.ingest(first)  # a replay adds nothing
    index.ingest(later)
    assert {r.keep_id for r in index.rows().collect()} == {1, 2, 9}
    out = {r.doc_id: r.keep_id for r in exact.decide(index, later).collect()}
    assert out == {0: 2, 9: 9, 10: 9}  # what an earlier batch brought stays
    plan = index.rows().join(later.hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    reopened = exact.DigestIndex(spark, index.path, 16)
    assert reopened.rows().count() == 3


def test_empty(spark, docs):
    empty = docs([(1, "a")]).where("false")
    assert exact.deduplicated(spark, empty).count() == 0

import random

import pytest

from ropeway.llm import edits
from ropeway.llm.bpe import SPLIT, remembered, VOCABULARY


def count(text):
    known = remembered(VOCABULARY, len)
    return sum(known[p] for p in SPLIT.findall(text))


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_edits_equal_counting_again(monkeypatch, leaf):
    monkeypatch.setattr(edits, "LEAF", leaf)
    known, r = remembered(VOCABULARY, len), random.Random(leaf)
    parts = [" the", "   ", "\n\n", "'re", "'", "r", "ee", " 12", "!?", "é", " \t", "word", "日本", " x", "'l", "　", "'ve"]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        made = edits.leaves(text, known)
        tree = edits.Tree.of(made)
        assert tree.total == count(text)
        for _ in range(6):
            start = r.randint(0, len(text))
            stop = r.randint(start, min(len(text), start + r.choice([0, 1, 3, 50])))
            new = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 2, 8])))
            want = text[:start] + new + text[stop:]
            text, _ = tree.edit(text, start, stop, new, known)
            assert text == want
            n = tree.places
            assert tree.chars[1] == sum(tree.chars[n:]) == len(text)
            assert tree.total == count(text) == sum(tree.tokens[n:])
            assert all(heap[i] == heap[2 * i] + heap[2 * i + 1] for heap in (tree.chars, tree.tokens) for i in range(1, n))
            at = 0  # every leaf starts at a border of pre-tokens
            borders = {0, *(m.end() for m in SPLIT.finditer(text))}
            for c, _ in tree.leaves():
                at += c
                assert at in borders


def test_only_leaves_near_the_edit_are_encoded():
    known = remembered(VOCABULARY, len)
    text = " word" * 100_000
    made = edits.leaves(text, known)
    tree = edits.Tree.of(made)
    _, again = tree.edit(text, 250_000, 250_003, "x y z", known)
    assert again <= 4


def test_operator(spark, docs):
    frame = docs([(1, "One two three. " * 50), (2, ""), (3, None), (4, "short"), (5, "kept")]).selectExpr("*", "1 AS chars", "2 AS edits")
    trees = edits.count_trees(frame)
    changes = spark.createDataFrame(
        [(1, 0, 10, 20, "X"), (1, 1, None, None, " end"), (2, 0, 5, 2, "new"), (3, 0, 0, 0, None), (4, 0, -3, 99, ""), (9, 0, 0, 0, "none")],
        "doc_id bigint, seq int, start bigint, stop bigint, new string")
    out = {r.doc_id: r for r in edits.apply_edits(frame, trees, changes).collect()}
    text = "One two three. " * 50
    assert out[1].text == text[:10] + "X" + text[20:] + " end"
    assert (out[2].text, out[3].text, out[4].text, out[5].text) == ("new", "", "", "kept")
    before = {1: text, 2: "", 3: "", 4: "short", 5: "kept"}
    for i, r in out.items():
        assert r.n_after == count(r.text) and r.n_before == count(before[i])
    assert out[5].n_encoded == 0
    empty = frame.where("false")
    assert edits.apply_edits(empty, edits.count_trees(empty), changes).count() == 0


def test_latin_pattern_equals_the_public_one():
    r = random.Random(9)
    parts = [chr(c) for c in range(256)] + ["'s", "'re", "'ll", "  ", "ab", "12", " x", "\r\n"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert edits.pattern(text) is edits._LATIN
        assert edits._LATIN.findall(text) == SPLIT.findall(text)
    assert edits.pattern("a\u0100") is SPLIT


def test_a_place_is_found_by_descending():
    sizes = [3, 0, 2, 5, 0, 0, 1]
    tree = edits.Tree([0] * 8 + sizes + [0], [0] * 16)
    tree._sum(0, 8)
    ends = [sum(sizes[: i + 1]) for i in range(7)]
    for at in range(11):
        want = next(i for i, e in enumerate(ends) if e > at)
        assert tree.find(at) == (want, ends[want] - sizes[want])


def test_rows_without_or_with_repeated_ids(docs, spark, monkeypatch):
    long = "A very long text, indeed. " * 40_000
    rows = [(None, "no id"), (None, "no id"), (None, None), (7, "one text"), (7, "one text"), (7, "another text"), (7, None), (8, long), (8, "")]
    frame = docs(rows)
    changes = spark.createDataFrame(
        [(7, 0, 0, 3, "1"), (7, 0, 0, 0, "tie "), (None, 0, 0, 0, "lost"), (8, 1, 500_000, 500_004, " now"), (8, 0, None, None, None)],
        "doc_id bigint, seq int, start bigint, stop bigint, new string")
    out = edits.apply_edits(frame, edits.count_trees(frame), changes).collect()

    def edited(i, text):
        text = text or ""
        if i == 7:  # edits that tie in seq go by position
            text = "tie " + text
            text = "1" + text[3:]
        if i == 8:
            n = min(500_000, len(text))
            text = text[:n] + " now" + text[n + 4 :]
        return text

    want = sorted((str(i), edited(i, t), count(t or ""), count(edited(i, t))) for i, t in rows)
    assert sorted((str(x.doc_id), x.text or "", x.n_before, x.n_after) for x in out) == want
    assert max(x.n_encoded for x in out) <= 4

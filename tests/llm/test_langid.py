import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ropeway.llm import langid


def brute(word, column):
    known, word = langid.pieces(), "▁" + word
    total = {len(word): 1.0}
    for i in range(len(word) - 1, -1, -1):
        total[i] = sum(column[known[word[i:j]]] * total[j] for j in range(i + 1, len(word) + 1) if word[i:j] in known)
        if word[i] not in known:
            total[i] += langid.UNKNOWN * total[i + 1]
    return math.log(total[0])


@pytest.fixture(scope="module")
def rows():
    own = langid.lattice()
    made = np.random.default_rng(3).gamma(0.3, size=(own.pieces, 2)) + 1e-6
    return np.vstack([made / made.sum(0), np.full(2, langid.UNKNOWN), np.zeros(2)])


def test_sums_over_segmentations(rows):
    own = langid.lattice()
    words = ["the", "und", "niño", "日本語", "a", "zażółć", "internationalisation", "x" * 31, "therefore" * 5, "q" * 40]
    got = own.log_likelihoods(words, rows)
    for i, word in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(brute(word, rows[:, k]), rel=1e-9)


def test_long_words_do_not_underflow(rows):
    assert np.isfinite(langid.lattice().long("é" * 10_000, rows)).all()


def test_expected_counts_are_the_derivative(rows):
    own, column = langid.lattice(), rows[:, 0]
    got = own.expected(["there", "then"], np.array([2.0, 1.0]), column)
    known = langid.pieces()
    for piece in ("▁the", "re", "n"):
        up = column.copy()
        up[known[piece]] *= 1 + 1e-6
        slope = sum(n * (brute(w, up) - brute(w, column)) for w, n in (("there", 2), ("then", 1))) / 1e-6
        assert got[known[piece]] == pytest.approx(slope, abs=1e-4)


def test_memory_gives_what_counting_gives(rows, monkeypatch):
    """Whatever a small memory forgets, sums are those of all words."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["w" * 50]
    texts = [" ".join(r.choice(vocabulary) + r.choice(["", ",", "!"]) for _ in range(r.randint(1, 30))) for _ in range(120)] + ["... a", "!!"]
    for most, step in ((40, 20), (200, 100), (100_000, 100_000)):
        monkeypatch.setattr(langid, "REMEMBERED", most)
        monkeypatch.setattr(langid, "STEP_WORDS", step)
        scorer = langid.Scorer(langid.VOCABULARY, rows[:-1])
        for _ in range(2):
            got = [scorer.texts([langid.cores(t)])[0] for t in texts]
            for text, sums in zip(texts, got, strict=True):
                want = sum((scorer.own.log_likelihoods([w], rows)[0] for w in langid.cores(text)), np.zeros(2))
                assert sums == pytest.approx(want, rel=1e-9)
            found = langid.told([*texts, None], scorer)
            assert [x and x[0] for x in found] == [int(s.argmax()) if any(map(str.isalpha, t)) else None for s, t in zip(got, texts, strict=True)] + [None]
        assert len(scorer.memory.keys) <= max(most, 100)


def brute_fit(docs, rounds):
    """Expectation maximisation over single words, by the derivative of each word's likelihood."""
    known = langid.pieces()
    column = np.append(np.full(len(known), 1 / len(known)), langid.UNKNOWN)
    counts = {}
    for text in docs:
        for w in langid.cores(text):
            for k in range(0, len(w), langid.SHORT):
                counts[w[k : k + langid.SHORT]] = counts.get(w[k : k + langid.SHORT], 0) + 1
    for _ in range(rounds):
        total = np.full(len(known), langid.PRIOR)
        for word, n in counts.items():
            marked, size = "▁" + word, len(word) + 1
            ahead = [1.0] + [0.0] * size
            for j in range(1, size + 1):
                for i in range(j):
                    piece = marked[i:j]
                    p = column[known[piece]] if piece in known else langid.UNKNOWN if j - i == 1 else 0
                    ahead[j] += ahead[i] * p
            behind = [0.0] * size + [1.0]
            for i in range(size - 1, -1, -1):
                for j in range(i + 1, size + 1):
                    piece = marked[i:j]
                    p = column[known[piece]] if piece in known else langid.UNKNOWN if j - i == 1 else 0
                    behind[i] += p * behind[j]
            for i in range(size):
                for j in range(i + 1, size + 1):
                    if (piece := marked[i:j]) in known:
                        total[known[piece]] += n * ahead[i] * column[known[piece]] * behind[j] / ahead[size]
        column[:-1] = (1 - langid.UNKNOWN) * total / total.sum()
    return column


def test_fit_equals_a_plain_one(spark, docs):
    texts = {"xx": ["there then the cat", "the other-cat, thereof " + "longwordwithoutanyend" * 3], "yy": ["und die katze und", "日本語 die"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    model = langid.fit(docs(rows).repartition(3), rounds=2)
    assert model["langs"] == ["xx", "yy"]
    for k, lang in enumerate(model["langs"]):
        assert model["table"][:, k] == pytest.approx(brute_fit(texts[lang], 2), rel=1e-8)


def test_held_out_accuracy_and_cases(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.predict(real, langid.fit(real.where(~langid.held_out(F.col("doc_id"))))).join(real, "doc_id").where(
        langid.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.93 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
    frame = docs([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !!", "de"),
                  (None, "the dog", None), (6, "", None), (7, "x" * 20_000, None), (1, "the cat and the dog", "en")]).selectExpr("*", "1 AS score")
    model = langid.fit(frame)
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(frame, model).collect()}
    assert {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "en"), (6, "und")} <= got
    assert langid.predict(frame, model).count() == 8
    kept = langid.accepted(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= {1, 2, None}
    unlabelled = frame.withColumn("lang", frame["lang"].substr(9, 1).cast("string")).where("lang IS NULL")
    assert langid.accepted(unlabelled).count() == unlabelled.where("text RLIKE '[a-z]'").count()
    empty = frame.where("false")
    assert langid.predict(empty, langid.fit(empty)).count() == 0

import hashlib
import random
from fractions import Fraction

import numpy as np

from ropeway.llm import periods


def brute(words, least=periods.LEAST_WORDS, most=periods.LEAST_PERIODS):
    """All runs by walking along every period."""
    found, n = {}, len(words)
    for p in range(1, n // most + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, most * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(r):
    out = []
    while len(out) < r.choice([0, 5, 60, 200, 400]):
        unit = [r.choice("abc") for _ in range(r.choice([1, 1, 2, 3, 7, 20]))]
        out += unit * r.choice([1, 1, 2, 4, 9, 30])
        if r.random() < 0.3 and out:
            out[r.randrange(len(out))] = "x"
    return out


def test_runs_equal_brute_force():
    r = random.Random(11)
    for _ in range(60):
        texts = [random_words(r) for _ in range(r.choice([1, 4, 12]))]
        found = periods.runs_of(texts)
        for k, words in enumerate(texts):
            assert [tuple(x) for x in found.get(k, np.zeros((0, 3), int)).tolist()] == brute(words)


def test_small_bounds_and_small_steps(monkeypatch):
    monkeypatch.setattr(periods, "QUERIES", 7)
    monkeypatch.setattr(periods, "GRAMMAR_WORDS", 50)
    r = random.Random(12)
    for _ in range(40):
        texts = [random_words(r) for _ in range(6)]
        for least, most in ((4, 2), (6, 3), (1, 4)):
            found = periods.runs_of(texts, least, most)
            for k, words in enumerate(texts):
                assert [tuple(x) for x in found.get(k, np.zeros((0, 3), int)).tolist()] == brute(words, least, most)


def test_common_extensions():
    r = random.Random(13)
    words = random_words(random.Random(3)) + [r.choice("ab") for _ in range(300)] + ["a"] * 70 + ["b"] + ["a"] * 64
    code = {w: 2 + i for i, w in enumerate(sorted(set(words)))}
    text = np.array([0, *map(code.get, words), 1])
    grammar = periods.Grammar(text, 1)
    pairs = [sorted(r.sample(range(1, len(text) - 1), 2)) for _ in range(3000)]
    i, j = np.array(pairs).T
    ahead, behind = grammar.common(i, j), grammar.common(i, j, back=True)
    for a, b, x, y in zip(i, j, ahead, behind, strict=True):
        n = 0
        while text[a + n] == text[b + n]:
            n += 1
        m = 0
        while text[a - 1 - m] == text[b - 1 - m]:
            m += 1
        assert (x, y) == (n, m)


def expected(doc_id, text):
    words = periods.planted(doc_id, [w.decode() for w in (text or "").encode().split()])
    runs = brute(words)
    best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_query_columns(spark, docs):
    r = random.Random(14)
    rows = [(i, " ".join(random_words(r))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "word " * 20_000), (104, "x" * 50_000), (None, "a b " * 30),
             (105, "é è " * 40), (105, "é è " * 40), (106, "a\x1cb c\x85d " * 30)]
    frame = docs(rows).selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS start", "4 AS _best").repartition(3)
    out = periods.digests(periods.periodic_runs(frame, periods.planted))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted((expected(*x) for x in rows), key=key)
    assert periods.digests(periods.periodic_runs(frame.where("false"))).count() == 0


def test_planted_runs_are_found(spark, docs):
    changed = [i for i in range(400) if periods.planted(i, list(range(500))) != list(range(500))]
    assert 20 < len(changed) < 60
    out = periods.periodic_runs(docs([(i, " ".join(f"w{k}" for k in range(500))) for i in changed]), periods.planted).collect()
    for row in out:
        words = periods.planted(row.doc_id, [f"w{k}" for k in range(500)])
        assert [tuple(x) for x in row.runs] == brute(words) and row.collapsed == collapsed(words, brute(words))

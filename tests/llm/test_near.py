import random

import numpy as np
import pytest

from ropeway.llm import chosen, rotated


def brute_documents(rows):
    sets, up = [], {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append((i, s))
        up[i] = i

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("small,block", [(250, 300), (4, 5)])
def test_documents_match_brute_force(docs, monkeypatch, small, block):
    monkeypatch.setattr(chosen, "SMALL", small)
    monkeypatch.setattr(chosen, "BLOCK", block)
    monkeypatch.setattr(chosen, "LEVELS", 2)
    r = random.Random(11)
    rows, n = [], 0
    for size in (5, 8, 20, 60, 200):
        for _ in range(3):
            base = [f"w{r.randrange(10**6)}" for _ in range(size)]
            for _ in range(8):
                copy = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, size // 30])):
                    copy[r.randrange(size)] = f"w{r.randrange(10**6)}"
                rows.append((n, " ".join(copy)))
                n += 1
    rows += [(900, "a b"), (901, "A  b"), (902, ""), (903, None), (904, "a b c"), (905, "x " * 30_000), (906, "x " * 20_000)]
    r.shuffle(rows)
    frame = docs(rows).selectExpr("*", "1 AS rep", "2 AS key", "3 AS n")
    got = {x.doc_id: (x.n_shingles, x.component) for x in chosen.near_duplicates(frame).collect()}
    assert got == brute_documents(rows)
    left = chosen.one_of_each(frame)
    assert left.columns == frame.columns
    assert {x.doc_id for x in left.collect()} == {c if s else i for i, (s, c) in got.items()}


def test_documents_without_id_and_repeats(docs):
    text = "one two three four five six"
    out = chosen.near_duplicates(docs([(None, text), (3, text), (3, text), (8, text)])).collect()
    assert sorted((x.doc_id is None, x.doc_id, x.component, x.kept) for x in out) == [
        (False, 3, 3, True), (False, 3, 3, True), (False, 8, 3, False), (True, None, None, True)]
    assert chosen.near_duplicates(docs([(1, text)]).where("false")).count() == 0
    assert chosen.near_duplicates(docs([(1, None)])).count() == 1


def brute_vectors(rows):
    ok = [(i, np.array(v, float), g) for i, v, g in rows
          if i is not None and g is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for a, (i, v, g) in enumerate(ok):
        for j, w, h in ok[:a]:
            if g == h and i != j and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= rotated.THRESHOLD:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min((x for x in seen if x is not None), default=None))
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rotated, "BLOCK", block)
    r = np.random.default_rng(13)
    rows = []
    for i in range(220):
        if i % 4 and rows and rows[-1][1]:
            v = np.array(rows[-1][1]) + r.normal(0, r.choice([0.0, 0.05, 0.12, 0.2]), 24)
        else:
            v = r.normal(size=24)
        rows.append((i, v.tolist(), int(i // 100)))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [1.0, None], 1), (304, rows[0][1], None), (305, [], 1),
             (306, [1.0], 1), (307, [2.0], 1), (308, [-1.0], 1), (309, [1e200, 1e200], 1), (310, [1e-200, 1e-200], 1), (0, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS key")
    got = {x.id: (x.n_links, x.component) for x in rotated.near_vectors(frame).collect()}
    want = brute_vectors(rows)
    want[309], want[310] = (1, 309), (1, 309)  # squares of these leave the range of the brute force
    assert got == want


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(17)
    size = 64
    o = r.normal(size=(400, size))
    q = o + r.normal(size=(400, size))
    o, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (o, q))
    a, b = rotated.Codes(o), rotated.Codes(q)
    estimate = (a.signs * b.turned).sum(1) / a.factor
    error = estimate - (o * q).sum(1)
    assert abs(error.mean()) < 0.02
    assert (abs(error) <= a.margin).mean() > 0.99


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert rotated.near_vectors(frame).count() == 0
    one = spark.createDataFrame([(None, [1.0], 1), (2, None, None)], "vec_id bigint, embedding array<float>, label int")
    assert {(x.id, x.n_links, x.kept) for x in rotated.near_vectors(one).collect()} == {(None, 0, True), (2, 0, True)}

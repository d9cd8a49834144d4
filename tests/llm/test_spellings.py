import random
import re
import zlib
from collections import Counter

import pytest

from ropeway.llm import spellings


def near(u, v):
    """Whether one inserted, deleted or replaced code point turns one into the other."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    around = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(around[w]), words.get(forms[w])))
    return sorted(out)


def counted(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if i is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return total


def vocabulary(r, size, letters, lengths):
    words = {"".join(r.choice(letters) for _ in range(r.choice(lengths))) for _ in range(size)}
    for w in list(words):
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            words.add(r.choice([w[:at] + r.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at + 1 :]]))
    return {w: r.choice([1, 2, 3, 4, 6, 8, 12, 24, 100]) for w in words}


@pytest.mark.parametrize("block", [1000, 4])
def test_variants_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spellings, "BLOCK", block)
    monkeypatch.setattr(spellings, "PAIR_BYTES", 4000)
    r = random.Random(13)
    counts = vocabulary(r, 150, "ab", range(4, 9)) | vocabulary(r, 150, "aé×z", range(3, 16)) | {"a" * 40: 5, "a" * 41: 11, "a" * 42: 30, "b" + "a" * 41: 9}
    frame = spark.createDataFrame([*counts.items(), (None, 9)], "word string, n bigint").repartition(4)
    out = spellings.spelling_variants(frame)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, out.collect())) == brute(counts)


def test_windows_cover_every_edit():
    for m in range(5, 40):
        borders = spellings.cuts(m)
        assert borders[0] == 0 and borders[-1] == m and all(0 < b - a <= 5 for a, b in zip(borders[:-1], borders[1:], strict=True))


def test_query_from_documents(spark, docs):
    r = random.Random(7)
    words = ["Reading", "reading", "readin", "Élève", "élève", "naïve", "naive", "x" * 3000, "y" * 3001, "short", "shorty", "a×b÷c", "tie_tie", "don't"]
    rows = [(i, " ".join(r.choice(words) for _ in range(120))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "reading readng readng readng"), (202, "shrt shrt shrt"), (202, "shrt shrt shrt"), (203, "İstanbul K ſ")]
    frame = docs(rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS tile").repartition(3)
    out = spellings.spelling_variants(spellings.word_counts(frame, spellings.misspelt))
    assert sorted(map(tuple, out.collect())) == brute(counted(rows))
    plain = {x.word: x.n for x in spellings.word_counts(frame).collect()}
    assert plain["readng"] == 3
    assert spellings.spelling_variants(spellings.word_counts(frame.where("false"))).count() == 0

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ropeway.llm import tokenfiles


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out.encode_special_tokens = True
    return out


def random_text(r):
    parts = list("abcdeTHS ingéü中\U0001f600!?.,;:  \n\n\t1234'sre　\x1c\x85é ́İΣΑΣ") + ["<|endoftext|>", "it's", "L'Été.", "...", "word. ", "9, "]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 80)))


def test_words_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 300)
    r, own = random.Random(12), tokenfiles.Words()
    for _ in range(300):
        texts = [random_text(r) for _ in range(r.randint(0, 6))] + ["x" * r.choice([3, 70, 200]), ""]
        ids, counts = own.encode([t.encode() for t in texts])
        direct = [[*library.encode(t, add_special_tokens=False).ids, tokenfiles.END_ID] for t in texts]
        assert ids.tolist() == sum(direct, []) and counts.tolist() == list(map(len, direct))


def samples():
    r = np.random.default_rng(12)
    yield np.zeros(0, np.uint32)
    yield np.array([7], np.uint32)
    yield np.full(1001, 9, np.uint32)
    yield np.tile(np.array([5, 5, 8], np.uint32), 400)
    for size, ids in ((50, 3), (3000, 2), (3000, 40), (20_000, 49_000)):
        yield r.integers(0, ids, size).astype(np.uint32)
    yield np.concatenate([r.integers(0, 9, 300), np.full(500, 4), np.tile(r.integers(0, 50, 90), 30)]).astype(np.uint32)


@pytest.mark.parametrize("least", [2, 3, 16])
def test_grammar_gives_all_ids_back(least):
    r = random.Random(3)
    for ids in samples():
        cuts = sorted({0, len(ids), *(r.randint(0, len(ids)) for _ in range(5))})
        sizes = [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [0]
        data = tokenfiles.pack_shard(3, 4, [None, *range(1, len(sizes))], sizes, ids, least)
        shard = tokenfiles.Shard(data + b"\n")
        assert (shard.task, shard.number, shard.doc_ids[0]) == (3, 4, None)
        assert shard.all().tolist() == ids.tolist()
        for _ in range(40):
            a, b = sorted((r.randint(0, len(ids)), r.randint(0, len(ids))))
            assert shard.read(a, b).tolist() == ids[a:b].tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            assert shard.document(k).tolist() == ids[a:b].tolist()
        with pytest.raises(IndexError):
            shard.read(0, len(ids) + 1)


def test_no_frequent_pair_is_left():
    for ids in samples():
        terminals, rules, symbols = tokenfiles.compress(ids, 16)
        uses = {}
        for pair in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
            uses[pair] = uses.get(pair, 0) + 1
        assert max(uses.values(), default=0) < 16
        known = len(terminals)
        assert all(max(rule) < known + k for k, rule in enumerate(rules.tolist()))
    assert len(tokenfiles.compress(np.full(1 << 16, 9, np.uint32), 16)[2]) <= 32


def test_a_damaged_shard_is_told():
    data = bytearray(tokenfiles.pack_shard(0, 0, [1], [500], np.arange(500, dtype=np.uint32) % 7))
    data[-30] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.Shard(bytes(data))


def test_files_and_query_columns(spark, docs, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "TASK_BYTES", 40_000)
    monkeypatch.setattr(tokenfiles, "GROUP", 2)
    r = random.Random(5)
    rows = [(i, random_text(r)) for i in range(-20, 150)]
    rows += [(200, None), (201, ""), (202, "word " * 20_000), (203, "x" * 5000), (None, "no id"), (204, "same"), (204, "same"), (204, "other")]
    r.shuffle(rows)
    frame = docs(rows).selectExpr("*", "1 AS ids", "2 AS task", "3 AS start").repartition(3)
    path = str(tmp_path / "shards")
    tokenfiles.write_tokens(frame, path, shard_ids=400)
    out = tokenfiles.placed_in_corpus(tokenfiles.read_digests(spark, path)).collect()
    assert len({(x.task, x.number) for x in out}) > 5 and len({x.task for x in out}) > 1
    out.sort(key=lambda x: x.start)
    assert [x.doc_id for x in out] == sorted((x[0] for x in rows), key=lambda i: (i is not None, i))
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    crc = {t: zlib.crc32(np.array(i, "<u4").tobytes()) for t, i in ids.items()}
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens, x.ids_crc32) for x in out) == sorted((i is None, i or 0, len(ids[t]), crc[t]) for i, t in rows)
    total = 0
    for x in out:
        assert x.start == total
        total += x.n_tokens
    back = tokenfiles.read_tokens(spark, path).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.ids) for x in back) == sorted((i is None, i or 0, ids[t]) for i, t in rows)


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    tokenfiles.write_tokens(docs([(1, "a")]).where("false"), path)
    assert tokenfiles.placed_in_corpus(tokenfiles.read_digests(spark, path)).count() == 0
    assert tokenfiles.read_tokens(spark, path).count() == 0

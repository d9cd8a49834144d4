import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ropeway.llm import bpe


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(r):
    return "".join(r.choice("abcdeth ingéü中\U0001f600!?  \n\n\t1234'sre　\x1c") for _ in range(r.randint(0, 80)))


def test_pieces_equal_the_library(reference):
    r, own = random.Random(8), bpe.encoder()
    for _ in range(2000):
        text = random_text(r)
        ids = [i for p in bpe.SPLIT.findall(text) for i in own.encode(p.encode())]
        assert ids == reference.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_token_is_its_own_encoding():
    own = bpe.encoder()
    r = random.Random(2)
    for token in r.sample(sorted(own.tokens), 3000):
        assert own.walk(own.prefixes(own.tokens[token])) == [token]


def test_appends_and_edits_inside_a_piece():
    r, own = random.Random(9), bpe.encoder()
    for _ in range(300):
        piece = bytes(r.choice(b"therinagoustd") for _ in range(r.randint(1, 40)))
        more = bytes(r.choice(b"therinagoustd") for _ in range(r.randint(0, 10)))
        last = own.prefixes(piece)
        grown = own.append(last, piece, more)
        assert grown == own.prefixes(piece + more) and grown[: len(last)] == last
        start = r.randint(0, len(piece))
        stop = r.randint(start, len(piece))
        edited, table = own.replace(last, piece, start, stop, more)
        assert edited == piece[:start] + more + piece[stop:] and table == own.prefixes(edited)


def test_operators(spark, docs, reference):
    texts = ["Hello world", None, "", "   ", "word " * 20_000, "x" * 5000, "<|endoftext|> é　", "Hello world"]
    frame = docs([(i if i != 3 else None, t) for i, t in enumerate(texts)]).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    out = bpe.round_trip(frame).collect()
    for r, text in zip(out, texts, strict=True):
        ids = reference.encode_ordinary(text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(frame)
    back = bpe.decode(encoded).collect()
    assert [bytes(r.data).decode() for r in back] == [t or "" for t in texts]
    assert bpe.round_trip(frame.where("false")).count() == 0

import random

import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from ropeway.llm.base import stored
from tests_llm_tools import brute_near, fill_targets


def test_stages_on_a_small_corpus(spark, docs):
    r = random.Random(21)
    vocabulary = {"en": "the cat and dog of that with tion ing".split(), "de": "der die und schaft keit ich zu ein über".split()}
    rows, n = [], 0
    for lang, known in vocabulary.items():
        for _ in range(40):
            text = " ".join(r.choice(known) + r.choice(["", "s", "er"]) + str(r.randrange(100)) for _ in range(r.choice([6, 40, 80])))
            rows.append((n, text, lang, r.choice(["a", "b", None])))
            n += 1
    texts = dict((i, t) for i, t, *_ in rows)
    rows += [(n + i, texts[i] + " ", "en", "a") for i in range(10)]  # exact but for white space: trailing space differs
    rows += [(n + 10 + i, texts[i], "en", "b") for i in range(10)]
    rows += [(n + 20 + i, texts[i].rsplit(" ", 1)[0] + " changed", "en", "b") for i in range(20) if len(texts[i].split()) > 30]
    rows += [(500, "", "en", "a"), (501, None, "en", "a"), (502, "12 34 !!", "de", "b")]
    frame = docs(rows).selectExpr("*", "1 AS key", "2 AS size")
    frame = stored(frame, "t-docs")
    left = frame
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {x.doc_id: x.text for x in left.select("doc_id", "text").collect()} if number < 4 else {}
        left = stored(stage(spark, left, ""), f"t-stage-{number}")
        if number < 4:
            assert left.columns == frame.columns
        seen.append((before, left.collect()))
    # language: only texts without letters go
    assert {x.doc_id for x in seen[0][1]} == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    # exact: the smallest id of each normalised text
    first = {}
    for i, t in sorted(seen[1][0].items()):
        first.setdefault(" ".join(t.split()) + (" " if t.endswith(" ") else ""), i)
    assert {x.doc_id for x in seen[1][1]} == set(first.values())
    # near: one document of each component
    comps = brute_near(seen[2][0])
    assert {x.doc_id for x in seen[2][1]} == {i for i, c in comps.items() if i == c}
    # mixing: the targets by word, whole texts or parts of them
    inputs = {x.doc_id: x for x in seen[2][1]}
    own, got = {}, {}
    for x in inputs.values():
        own[x.source] = own.get(x.source, 0) + len(x.text.split())
    for x in seen[3][1]:
        got[x.source] = got.get(x.source, 0) + len(x.text.split())
        assert set(x.text.split()) <= set(inputs[x.doc_id].text.split()) and x.n_chars == len(x.text)
    for source, target in fill_targets(own).items():
        assert abs(got.get(source, 0) - target) <= 1
    # encoding: as the library counts
    from ropeway.llm import bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})
    want = sorted((x.doc_id, len(library.encode_ordinary(x.text))) for x in seen[3][1])
    assert sorted((x.doc_id, x.n_tokens) for x in seen[4][1]) == want


def test_run_is_registered_and_empty_tables_pass(spark, docs):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    left = docs([(1, "a")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        left = stored(stage(spark, left, ""), "t-empty")
    assert left.count() == 0

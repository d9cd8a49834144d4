import random
from collections import defaultdict

from ropeway.llm import spans


def brute_windows(rows):
    first, removed = {}, defaultdict(set)
    for i, text in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        lines = text.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            at = first.setdefault(w, (i, k))
            if at != (i, k):
                own = set(range(at[1], at[1] + 3)) if at[0] == i else set()
                removed[i] |= set(range(k, k + 3)) - own
    return {i: v for i, v in removed.items() if v}


def test_windows_match_brute_force(docs):
    r = random.Random(4)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, "same\n" * 50 + "end"), (101, None), (102, ""), (None, "a\nb\nc"), (103, "a\nb"), rows[3]]
    frame = docs(rows).selectExpr("*", "1 AS line", "2 AS first")
    got = defaultdict(set)
    for x in spans.repeated_windows(frame).collect():
        assert not got[x.doc_id] & set(range(x.first_line, x.last_line + 1))
        got[x.doc_id] |= set(range(x.first_line, x.last_line + 1))
        text = dict(rows)[x.doc_id]
        assert text[x.start : x.stop] == "\n".join(text.split("\n")[x.first_line : x.last_line + 1])
    assert dict(got) == brute_windows(rows)


def test_run_of_one_line_shrinks_to_a_window(docs):
    frame = docs([(1, "\n".join(["x"] * 10))])
    out = spans.without(frame, spans.repeated_windows(frame)).first()
    assert out.text == "x\nx\nx"


def test_units_match_brute_force(docs):
    r = random.Random(5)
    lines = ["one two THREE", "one  two three", "four five", "six seven eight nine", "", " ", "é  É z"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 6)))) for i in range(40)]
    rows += [(50, None), (None, "one two three"), (51, "long " * 30_000), (52, "LONG " * 30_000), rows[0]]
    got = {(x.doc_id, x.unit): (x.keep_doc_id, x.keep_unit, x.start, x.stop) for x in spans.repeated_units(docs(rows), 3).collect()}
    first, want = {}, {}
    for i, text in sorted({x for x in rows if x[0] is not None and x[1] is not None}):
        at = 0
        for k, line in enumerate(text.split("\n")):
            norm = " ".join(line.split()).lower()
            if len(norm.split()) >= 3:
                keep = first.setdefault(norm, (i, k))
                if keep != (i, k):
                    want[i, k] = (*keep, at, at + len(line))
            at += len(line) + 1
    assert got == want


def test_cutting_keeps_the_rest(docs, spark):
    frame = docs([(1, "keep\ncut\nkeep too"), (2, "a\nb"), (3, None), (4, "cut me")]).selectExpr("*", "5 AS start")
    cuts = spark.createDataFrame([(1, 5, 8), (2, 2, 3), (4, 0, 6)], "doc_id bigint, start bigint, stop bigint")
    out = spans.without(frame, cuts)
    assert out.columns == frame.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "keep\nkeep too", 2: "a", 3: None, 4: ""}


def test_empty(docs):
    empty = docs([(1, "a")]).where("false")
    assert spans.repeated_windows(empty).count() == 0 == spans.repeated_units(empty).count()


def words(r, n):
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 999)) for _ in range(n))


def test_passages_inside_differing_lines(docs, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 64)
    r = random.Random(6)
    rows, passages = [], []
    for i in range(0, 60, 2):
        passages.append(words(r, r.randint(50, 90)))
        rows.append((i, f"{words(r, r.randint(0, 200))} {passages[-1]} {words(r, 30)}"))
        again = passages[-1].upper().replace(" ", r.choice([" ", "  ", "\n"]))
        rows.append((i + 1, f"\u0130\U0001f600 {words(r, r.randint(0, 200))} {again} {words(r, 30)}"))
    rows += [(90, None), (91, ""), (None, rows[0][1]), rows[0]]
    frame = docs(rows)
    got = defaultdict(list)
    for x in spans.repeated_passages(frame).collect():
        got[x.doc_id].append(dict(rows)[x.doc_id][x.start : x.stop].lower().split())
    assert sorted(got) == list(range(1, 60, 2))
    for i, ((found,), passage) in enumerate(zip((got[k] for k in sorted(got)), passages, strict=True)):
        assert len(found) >= max(spans.GRAM, len(passage.split()) - 2 * (spans.PASSAGE - spans.GRAM)), i
        assert " ".join(found) in passage.lower()
    left = {x.doc_id: x.text for x in spans.without(frame, spans.repeated_passages(frame)).collect()}
    assert left[0] == rows[0][1] and left[90] is None
    assert [len(left[i].split()) for i in got] == [len(dict(rows)[i].split()) - len(got[i][0]) for i in got]


def test_passage_that_repeats_itself_keeps_one(docs):
    frame = docs([(1, " ".join(["x"] * 300))])
    left = spans.without(frame, spans.repeated_passages(frame)).first().text
    assert set(left.split()) == {"x"} and spans.GRAM <= len(left.split()) <= spans.GRAM + spans.PASSAGE


def test_no_passages_in_an_empty_table(docs):
    assert spans.repeated_passages(docs([(1, "a")]).where("false")).count() == 0


def test_runs_of_short_lines(docs):
    r = random.Random(7)
    wrapped = "\n".join(words(r, 6) for _ in range(5))
    short = "\n".join(words(r, 6) for _ in range(4))
    rows = [(1, f"a\n{wrapped}\nb\n{short}\nc"), (2, f"d\n{wrapped.upper()}\ne"), (3, f"f\n{short}\ng"),
            (4, "h\n" + wrapped.replace("\n", "\n \n") + "\ni"), (5, "".join(f"{x}\nown {k}\n" for k, x in enumerate(wrapped.split("\n"))))]
    got = {x.doc_id: dict(rows)[x.doc_id][x.start : x.stop] for x in spans.repeated_passages(docs(rows)).collect()}
    # 24 words in a row are too few, and so is each line by itself
    assert got == {2: wrapped.upper(), 4: wrapped.replace("\n", "\n \n")}


def brute_runs(rows, least):
    first, want = {}, set()
    for i, text in sorted({x for x in rows if x[0] is not None and x[1] is not None}):
        cut = list(text)
        for k in range(1, len(text)):
            if text[k] in " \t\n\v\f\r" and text[k - 1] in ".!?":
                cut[k] = "\n"
        at, run = 0, []

        def close():
            if sum(n for _, _, n in run) >= least:
                want.add((i, run[0][0], run[-1][1], len(run), sum(n for _, _, n in run)))
            run.clear()

        number = 0
        for unit in "".join(cut).split("\n"):
            norm = " ".join(unit.lower().split())
            if norm:
                if first.setdefault(norm, (i, number)) != (i, number):
                    run.append((at, at + len(unit), len(norm.split())))
                else:
                    close()
                number += 1
            at += len(unit) + 1
        close()
    return want


def test_runs_of_sentences_match_brute_force(docs):
    r = random.Random(8)
    parts = ["One two THREE.", "one  two three.", "Four?! five", "v1.2 is out!", "six seven eight nine", "é  É z.", ".", "...", "end"]
    glue = [" ", "\n", "  ", "\n \n", "\t", ""]
    rows = [(i, "".join(r.choice(parts) + r.choice(glue) for _ in range(r.randint(0, 12)))) for i in range(80)]
    rows += [(90, None), (91, ""), (None, rows[0][1]), rows[3], rows[3], (92, "long. " * 30_000), (93, "LONG. " * 30_000)]
    frame = docs(rows).selectExpr("*", "1 AS line", "2 AS words", "3 AS stop")
    for least in (1, 6):
        got = {tuple(x) for x in spans.repeated_runs(frame, least, sentences=True).select("doc_id", "start", "stop", "n_units", "n_words").collect()}
        assert got == brute_runs(rows, least)
    assert spans.repeated_runs(frame.where("false"), sentences=True).count() == 0


def test_wrapped_paragraph_and_sentences_inside_lines_go(docs):
    r = random.Random(10)
    wrapped = "\n".join(words(r, 12) for _ in range(5))
    inside = ". ".join(words(r, 10) for _ in range(5)) + "."
    rows = [(1, f"{words(r, 40)}\n{wrapped}\n{words(r, 9)}. {inside} {words(r, 9)}"), (2, f"{wrapped}\n{words(r, 8)}"),
            (3, f"{words(r, 30)}. {inside} {words(r, 30)}"), (4, words(r, 300))]
    frame = docs(rows)
    got = {x.doc_id: dict(rows)[x.doc_id][x.start : x.stop] for x in spans.repeated_runs(frame, sentences=True).collect()}
    assert got == {2: wrapped, 3: inside}
    left = {x.doc_id: x.text for x in spans.without(frame, spans.repeated_runs(frame, sentences=True)).collect()}
    assert left[4] == rows[3][1] and left[1] == rows[0][1] and inside not in left[3]

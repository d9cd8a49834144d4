"""Token counts that follow edits, from a segment tree of pre-tokens per document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.llm.base import query, stored, table
from ropeway.llm.bpe import SPLIT, VOCABULARY, remembered

#: Pre-tokens of one leaf.
LEAF = 32
#: Pieces whose number of tokens a worker remembers; numbers take little room.
REMEMBERED = 1_000_000
#: Characters that the splitting pattern may look beyond the end of a match.
AHEAD = 3

TREE = "chars array<int>, tokens array<int>"

#: Letters, numbers and white space of Latin-1, and the splitting pattern over it: the same matches in half the time.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f" ?(?:[{_L}]+|[{_N}]+)|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile("[^\0-\xff]")


def pattern(text: str):
    """The splitting pattern, in the form that suits the text."""
    return SPLIT if _WIDE.search(text) else _LATIN


def leaves(text: str, known) -> list[tuple[int, int]]:
    """(characters, tokens) of each leaf of the text."""
    pieces = pattern(text).findall(text)
    sizes, counts = list(map(len, pieces)), list(map(known.__getitem__, pieces))
    return [(sum(sizes[i : i + LEAF]), sum(counts[i : i + LEAF])) for i in range(0, len(pieces), LEAF)]


class Tree:
    """Characters and tokens of the leaves, with the sums of both over all subtrees.

    ``chars`` and ``tokens`` are binary heaps: node i has children 2i and 2i + 1, and
    the places of the leaves follow the inner nodes.  An empty place has 0 characters.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of(cls, made: list[tuple[int, int]]) -> Tree:
        places = 1
        while places < len(made):
            places *= 2
        free = [0] * (places - len(made))
        tree = cls([0] * places + [c for c, _ in made] + free, [0] * places + [t for _, t in made] + free)
        tree._sum(0, places)
        return tree

    @property
    def places(self) -> int:
        return len(self.chars) // 2

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> list[tuple[int, int]]:
        return [(c, t) for c, t in zip(self.chars[self.places :], self.tokens[self.places :], strict=True) if c]

    def _sum(self, first: int, last: int) -> None:
        """Sum again the nodes above the places from ``first`` to before ``last``."""
        low, high = (self.places + first) // 2, (self.places + last - 1) // 2
        while low:
            for heap in (self.chars, self.tokens):
                for i in range(low, high + 1):
                    heap[i] = heap[2 * i] + heap[2 * i + 1]
            low, high = low // 2, high // 2

    def find(self, position: int) -> tuple[int, int]:
        """The place of the first leaf that ends behind the character, and where it begins."""
        node, begin = 1, 0
        if position >= self.chars[1]:
            raise IndexError(position)
        while node < self.places:
            node *= 2
            if position >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.places, begin

    def splice(self, first: int, last: int, made: list[tuple[int, int]]) -> None:
        """Put leaves in the places from ``first`` to before ``last``.

        Up to twice as many as there are places share them in pairs, and only the paths
        from these places to the root are summed again; more are laid out anew together
        with all others, from the stored counts and without encoding.
        """
        room, base = last - first, self.places
        if len(made) > room:
            made = [tuple(map(sum, zip(*made[i : i + 2], strict=True))) for i in range(0, len(made), 2)] if len(made) <= 2 * room else made
        if len(made) > room:
            old = list(zip(self.chars[base:], self.tokens[base:], strict=True))
            new = Tree.of([x for x in old[:first] + made + old[last:] if x[0]])
            self.chars, self.tokens = new.chars, new.tokens
            return
        made = made + [(0, 0)] * (room - len(made))
        self.chars[base + first : base + last] = [c for c, _ in made]
        self.tokens[base + first : base + last] = [t for _, t in made]
        self._sum(first, last)

    def edit(self, text: str, start: int, stop: int, new: str, known) -> tuple[str, int]:
        """Replace characters of ``text``; returns the edited text and the leaves encoded again.

        Encoding starts at the last leaf border that lies far enough before the edit
        for the pattern not to look into it, found by descending the tree, and ends at
        the first match after the edit that ends where an old leaf ended: from there on
        all matches are the old ones.
        """
        base, size = self.places, self.chars[1]
        first, begin = self.find(max(start - AHEAD, 0)) if size else (0, 0)
        edited = text[:start] + new + text[stop:]
        shift, after = len(new) - (stop - start), start + len(new)
        made: list[tuple[int, int]] = []
        n = chars = tokens = 0
        last, end, met = first, begin, False
        for match in pattern(edited).finditer(edited, begin):
            piece = match.group()
            n, chars, tokens = n + 1, chars + len(piece), tokens + known[piece]
            if match.end() >= after:
                at = match.end() - shift
                while last < base and (last == first or end < at):
                    end += self.chars[base + last]
                    last += 1
                met = end == at
            if n == LEAF or met:
                made.append((chars, tokens))
                n = chars = tokens = 0
            if met:
                break
        if n:
            made.append((chars, tokens))
        if not met:
            # all leaves up to the end of the text go, and free places behind it may be used
            while last < base and (last == first or end < size):
                end += self.chars[base + last]
                last += 1
            last = max(last, min(base, first + len(made)))
        self.splice(first, last, made)
        return edited, len(made)


def _keys() -> list:
    """128 bits of a row's id and text, by which a row meets its tree."""
    return [F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id").alias("key_b")]


def count_trees(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(key_a, key_b, doc_id, chars, tokens): the tree of every row's text, with the key of the row.

    NULL and empty texts have a tree of one empty place.  Rows are independent, also
    those that repeat an id or have none; a text is handled whole, by one task.  Other
    columns are not read.  An empty table gives an empty table.  Store the result: it
    is what ``apply_edits`` starts from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, len, REMEMBERED)
        for batch in batches:
            trees = [Tree.of(leaves(text or "", known)) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["key_a"], batch["key_b"], batch["doc_id"],
                 *[pa.array([getattr(t, n) for t in trees], pa.list_(pa.int32())) for n in ("chars", "tokens")]],
                names=["key_a", "key_b", "doc_id", "chars", "tokens"])

    return docs.select(*_keys(), "doc_id", "text").mapInArrow(
        run, f"key_a bigint, key_b bigint, doc_id {dict(docs.dtypes)['doc_id']}, {TREE}")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Edited texts and their trees, encoding only around the edits.

    ``trees`` comes from ``count_trees(docs)``.  ``edits`` has doc_id, seq, start, stop
    and new: in the order of seq the characters from start to before stop are replaced
    by new.  Positions refer to the text as the edits before left it and are cut to
    its ends; a stop before start counts as start, a NULL position as the end, a NULL
    new as nothing; edits that tie in seq go by position and text.  Edits of no
    document, or without doc_id, have no effect; a document without edits, or without
    doc_id, keeps text and tree.  A NULL text is edited like an empty one.  Rows that
    repeat an id are edited each; one row comes out for each that goes in, and other
    columns are not read.  The edits of one id are held together by one task, as its
    text is.

    Returns doc_id, text, chars, tokens, n_before, n_after, n_leaves and n_encoded
    (leaves encoded again).
    """
    kind = dict(docs.dtypes)["doc_id"]
    keys = ["key_a", "key_b"]
    own = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
    # ids alone meet the edits; texts move once, by their keys
    wanted = trees.select(*keys, "doc_id").join(own, "doc_id").select(*keys, "edits").dropDuplicates(keys)
    joined = (
        docs.select(*_keys(), "doc_id", "text")
        .join(trees.drop("doc_id").dropDuplicates(keys), keys, "left")
        .join(wanted, keys, "left")
        .select("doc_id", "text", "chars", "tokens", "edits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, len, REMEMBERED)
        for batch in batches:
            ids, out = batch["doc_id"], []
            for text, chars, tokens, changes in zip(
                    *(batch[c].to_pylist() for c in ("text", "chars", "tokens", "edits")), strict=True):
                if chars is None or chars[1] != len(text or ""):
                    raise ValueError("a row has no tree of its own text: trees must come from these documents")
                tree = Tree(chars, tokens)
                before, redone = tree.total, 0
                for e in changes or ():
                    own_text = text or ""
                    n = len(own_text)
                    start = n if e["start"] is None else min(max(e["start"], 0), n)
                    stop = n if e["stop"] is None else min(max(e["stop"], start), n)
                    text, again = tree.edit(own_text, start, stop, e["new"] or "", known)
                    redone += again
                out.append((text, tree.chars, tree.tokens, before, tree.total, len(tree.leaves()), redone))
            columns = list(zip(*out, strict=True)) or [()] * 7
            ints = pa.list_(pa.int32())
            types = [pa.string(), ints, ints, pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=["doc_id", "text", "chars", "tokens", "n_before", "n_after", "n_leaves", "n_encoded"])

    return joined.mapInArrow(
        run, f"doc_id {kind}, text string, {TREE}, n_before bigint, n_after bigint, n_leaves int, n_encoded int")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every text: a replacement in the middle, a deletion near the start, an addition at the end."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    edit = lambda seq, start, stop, new: F.struct(
        F.lit(seq).alias("seq"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"), new.alias("new"))
    middle = F.floor(n / 2)
    every = F.array(
        edit(0, middle, middle + 12, F.concat(F.lit(" revised in "), F.coalesce(F.col("source"), F.lit("none")))),
        edit(1, F.floor(n / 10), F.floor(n / 10) + 5, F.lit("")),
        edit(2, F.lit(None), F.lit(None), F.concat(F.lit("\nEnd of document "), F.col("doc_id").cast("string"))),
    )
    return docs.select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.*")


@query("op3_edited_counts")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts of all documents before and after three edits each, from stored trees."""
    docs = table(spark, sf, "documents")
    trees = stored(count_trees(docs), "count-trees")
    return apply_edits(docs, trees, sample_edits(docs)).select(
        "doc_id", F.length("text").alias("n_chars"), "n_before", "n_after", "n_leaves", "n_encoded")

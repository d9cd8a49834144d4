"""Spelling variants: words one edit apart, by tiles of prefix and suffix lengths."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.llm.base import query, stored, table
from ropeway.llm.streams import sorted_groups

#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: How many times as frequent a word's form is.
TIMES = 2
#: Code points of a word in which two words of a block may differ.
WINDOW = 3
#: Words of a block of a tile, bytes of the matrices of pairs compared at once.
BLOCK, PAIR_BYTES = 1000, 32 << 20
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000

#: Letters after A-Z became a-z.
_LETTERS = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, change: Callable | None = None) -> DataFrame:
    """(word, n) of all runs of letters A-Z, a-z and U+00C0 to U+00FF in ``docs``, A-Z lower-cased.

    ``change(doc_id, word)`` may replace the word in one document.  NULL and empty
    texts have no words.  Each task adds up its own words before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                own = Counter(_LETTERS.findall((text or b"").lower().decode()))
                if change is None:
                    total.update(own)
                else:
                    for word, n in own.items():
                        total[change(doc_id, word)] += n
                if len(total) >= COUNTED:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def misspelt(doc_id, word: str) -> str:
    """The word without one code point in every 97th pair of document and word; without an id as it is."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if doc_id is None or h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def cuts(m: int) -> list[int]:
    """Borders of the windows of words of ``m`` code points."""
    parts = max(2, m // WINDOW)
    return [k * m // parts for k in range(parts + 1)]


def keyed(words: DataFrame) -> DataFrame:
    """A row for each window of each word: key, m (code points of the shorter word), k (window), word, n.

    Of two words one edit apart the common prefix and suffix together reach all of
    the longer one but one code point.  So both hold the same code points before and
    behind the window of the shorter word in which the prefix ends.  A word takes
    part as the shorter one (or one of equal length), and as the one that is a code
    point longer.
    """
    parts = "greatest(2, m div {w})".format(w=WINDOW)
    roles = words.select("word", "n", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), x -> x >= {LEAST_LENGTH})")).alias("m"))
    windows = roles.select("*", F.explode(F.expr(f"sequence(0, {parts} - 1)")).alias("k"))
    before = f"substring(word, 1, k * m div {parts})"
    behind = f"right(word, cast(m - (k + 1) * m div {parts} AS int))"
    return windows.select(F.expr(f"xxhash64(m, k, {before}, {behind})").alias("key"), "m", "k", "word", "n")


def tiled(rows: DataFrame) -> DataFrame:
    """Rows dealt to tiles: tile, side, own, m, k, word, n.

    Words with one key are dealt to blocks of about BLOCK by their hashes, and every
    pair of blocks is a tile; ``own`` marks the tiles of a block with itself.  Keys
    that cannot hold a pair go.
    """
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max((F.length("word") == F.col("m")).cast("int")).alias("_short"))
    groups = stored(groups.where("_n > 1 AND _short = 1").select("key", F.expr(f"cast(ceil(_n / {BLOCK}) AS int)").alias("blocks")), "word-blocks")
    dealt = rows.join(groups.hint("merge"), "key").withColumn("_b", F.expr("cast(pmod(xxhash64(word, 13), blocks) AS int)"))
    dealt = dealt.withColumn("_c", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select(
        F.xxhash64("key", F.least("_b", "_c"), F.greatest("_b", "_c")).alias("tile"),
        (F.col("_b") > F.col("_c")).alias("side"), (F.col("_b") == F.col("_c")).alias("own"), "m", "k", "word", "n")


def _matrices(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each, padded behind and in front."""
    from_left = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    at = np.arange(width) - (width - sizes)[:, None]
    from_right = np.where(at >= 0, np.take_along_axis(from_left, np.maximum(at, 0), 1), 0)
    return from_left, from_right[:, ::-1].copy()


def _equal_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the number of leading columns that agree."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def near_pairs(words: list[str], m: int, k: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart: row r is compared with the rows from ``first[r]`` up to ``last[r]``.

    All words have m or m + 1 code points.  A pair counts in the window in which its
    common prefix ends, so that it is found once.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    heads, tails = _matrices(words, m + 1)
    borders = np.array(cuts(m))
    partners = np.maximum(last - first, 0)
    ends = np.cumsum(partners)
    step, found = max(1, PAIR_BYTES // (4 * (m + 1))), []
    for low in range(0, int(ends[-1]) if len(ends) else 0, step):
        pair = np.arange(low, min(low + step, int(ends[-1])))
        a = np.searchsorted(ends, pair, "right")
        b = first[a] + pair - (ends[a] - partners[a])
        short, long = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        use = short == m
        a, b, long = a[use], b[use], long[use]
        prefix, suffix = _equal_length(heads[a], heads[b]), _equal_length(tails[a], tails[b])
        window = np.searchsorted(borders, np.minimum(prefix, m - 1), "right") - 1
        near = (prefix + suffix >= long - 1) & (window == k[a])
        found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, n, near): for a word of a tile its near words there, and the first of the most frequent."""
    for frame in sorted_groups(batches, "tile"):
        for m in np.unique(frame["m"].to_numpy()).tolist():
            part = frame[frame["m"] == m]
            tile, side, words = part["tile"].to_numpy(), part["side"].to_numpy(), part["word"].tolist()
            n = part["n"].to_numpy()
            edges = np.append(np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(tile))
            last = edges[np.searchsorted(edges, np.arange(len(tile)), "right")]
            # of a tile of two blocks the first one's rows come first
            other = np.append(0, np.cumsum(~side))[last] - np.append(0, np.cumsum(~side))[np.arange(len(tile))]
            first = np.where(part["own"].to_numpy(), np.arange(len(tile)) + 1, np.arange(len(tile)) + other)
            a, b = near_pairs(words, m, part["k"].to_numpy(), first, np.where(side, first, last))
            if not len(a):
                continue
            a, b = np.append(a, b), np.append(b, a)
            place = np.empty(len(words), np.int64)
            place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            order = np.lexsort((place[b], -n[b], a))
            a, b = a[order], b[order]
            begins = np.append(0, np.flatnonzero(np.diff(a)) + 1)
            counts = np.diff(np.append(begins, len(a)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[i] for i in a[begins].tolist()], pa.string()), pa.array(counts, pa.int64()),
                 pa.array(n[b[begins]], pa.int64()), pa.array([words[i] for i in b[begins].tolist()], pa.string())],
                names=["word", "n_near", "n", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of each of ``words`` (word, n) with words one edit away.

    ``near`` is the most frequent of them, the smallest in code-point order among
    equals.  Pairs never leave a task.
    """
    tiles = tiled(keyed(words))
    parts = tiles.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_compared, "word string, n_near bigint, n bigint, near string")
    # the smallest struct: the largest n, then the smallest word
    best = F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("_best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("_best.n")).alias("near_n"), F.col("_best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), whose chains have an end; each round doubles the steps.

    A form is at least TIMES as frequent as its word, so chains have at most
    log2(n) links and about log2(log2(n)) rounds follow them.
    """
    here = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("_on")), "word-roots")
    while here.where("_on").limit(1).count():
        ahead = here.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = here.join(ahead.hint("merge"), F.col("root") == F.col("_word"), "left")
        here = stored(moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_on")), "word-roots")
    return here.select("word", "root")


def spelling_variants(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words in ``counts`` (word, n) that are long and frequent enough.

    Two words are near when one inserted, deleted or replaced code point turns one
    into the other.  A word's form is its near word of largest n (ties: smallest in
    code-point order) where that is at least TIMES its own n, else NULL; its root is
    the last form reached, or itself.  NULL words go, an empty table stays empty.
    Words have the letters that ``word_counts`` finds, one byte each in Latin-1.
    """
    words = stored(counts.where(F.length("word") >= LEAST_LENGTH).where(F.col("n") >= LEAST_COUNT).select("word", "n"), "spellings")
    near = near_words(words)
    formed = F.col("near_n") >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(formed, F.col("near_n")).alias("form_n"))
    found = stored(found, "spelling-forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Spelling variants among the words of all documents, some of which were misspelt."""
    return spelling_variants(word_counts(table(spark, sf, "documents"), misspelt))

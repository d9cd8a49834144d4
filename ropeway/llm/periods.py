"""Periodic runs of words by recompression into a run-length grammar."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.llm.base import query, table

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the texts that share a grammar; a longer text has one of its own.
GRAMMAR_WORDS = 300_000
#: Pairs of positions extended at once.
QUERIES = 500_000


@dataclass
class Level:
    """Symbols of one level, and how the next one groups them.

    Symbol ``x`` of the next level begins at ``first[x]`` and symbol ``i`` belongs to
    ``up[i]``; ``blocks`` tells whether repeated neighbours were joined or pairs.
    """

    names: np.ndarray
    first: np.ndarray | None = None
    up: np.ndarray | None = None
    blocks: bool = False

    def mirrored(self) -> Level:
        if self.first is None:
            return Level(self.names[::-1])
        last = len(self.first) - 2
        return Level(self.names[::-1], len(self.names) - self.first[::-1], last - self.up[::-1], self.blocks)


def _fresh(left: np.ndarray, right: np.ndarray, begin: int) -> tuple[np.ndarray, int]:
    """Names for pairs of numbers from ``begin`` on, equal pairs sharing one: the rules of a level."""
    keys, names = np.unique(left << np.int64(32) | right, return_inverse=True)
    return names + begin, begin + len(keys)


class Grammar:
    """Run-length grammar of several texts and the exact common extensions it answers.

    ``text`` holds word numbers from ``texts + 1`` on; smaller ones occur once each:
    they stand before, between and after the texts and no rule takes them in.  Levels
    alternate: maximal blocks of one symbol become one symbol, then each symbol of
    the left class goes together with a following one of the right class.  Both
    depend on the symbols alone, so equal stretches are grouped alike but for their
    ends.
    """

    def __init__(self, text: np.ndarray, texts: int):
        self.levels = [Level(text.astype(np.int64))]
        fresh = int(text.max()) + 1
        while len(self.levels[-1].names) > 2 * texts + 1 and len(self.levels) < 400:
            fresh = self._block(fresh)
            fresh = self._pair(fresh, texts)
        self.mirror = [x.mirrored() for x in self.levels]

    def _close(self, begins: np.ndarray, names: np.ndarray, blocks: bool) -> None:
        top = self.levels[-1]
        top.first, top.blocks = np.append(np.flatnonzero(begins), len(begins)), blocks
        top.up = np.cumsum(begins) - 1
        self.levels.append(Level(names))

    def _block(self, fresh: int) -> int:
        names = self.levels[-1].names
        begins = np.append(True, names[1:] != names[:-1])
        if begins.all():
            return fresh
        at = np.flatnonzero(begins)
        out, size = names[at], np.diff(np.append(at, len(names)))
        long = size > 1
        out[long], fresh = _fresh(out[long], size[long], fresh)
        self._close(begins, out, True)
        return fresh

    def _pair(self, fresh: int, texts: int) -> int:
        names = self.levels[-1].names
        mixed = (names.astype(np.uint64) + np.uint64(len(self.levels))) * np.uint64(0x9E3779B97F4A7C15)
        left = (mixed >> np.uint64(41) & np.uint64(1)).astype(bool)
        word = names > texts
        pairs = np.flatnonzero((left & word)[:-1] & (~left & word)[1:])
        begins = np.ones(len(names), bool)
        begins[pairs + 1] = False
        new, fresh = _fresh(names[pairs], names[pairs + 1], fresh)
        out = names.copy()
        out[pairs] = new
        self._close(begins, out[begins], False)
        return fresh

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words agree from positions ``i`` and ``j`` on (i < j), or before them with ``back``."""
        levels = self.mirror if back else self.levels
        if back:
            i, j = len(levels[0].names) - i, len(levels[0].names) - j
        who, a, b, left = np.arange(len(i)), i, j, []
        for level in levels[:-1]:
            names, first, up = level.names, level.first, level.up
            same = names[a] == names[b]
            ended = [(who[~same], a[~same], b[~same])]
            who, a, b = who[same], a[same], b[same]
            x, y = up[a], up[b]
            whole = (first[x] == a) & (first[y] == b)
            if level.blocks:
                # inside a block the rest of the shorter one is taken at once
                m, n = first[x + 1] - a, first[y + 1] - b
                on = whole | (m == n)
                least = np.minimum(m, n)[~on]
                ended.append((who[~on], a[~on] + least, b[~on] + least))
                who, a, b = who[on], (x + ~whole)[on], (y + ~whole)[on]
            else:
                # the second of a pair, or a first whose second differs on the other side
                a, b = up[a + ~whole], up[b + ~whole]
            left.append(ended)
        names, ended = levels[-1].names, []
        while len(who):
            same = names[a] == names[b]
            ended.append((who[~same], a[~same], b[~same]))
            who, a, b = who[same], a[same] + 1, b[same] + 1
        for level, more in zip(reversed(levels[:-1]), reversed(left), strict=True):
            down = [(w, level.first[x], level.first[y]) for w, x, y in ended]
            who, a, b = (np.concatenate(c) for c in zip(*down, *more, strict=True))
            same = level.names[a] == level.names[b]
            if level.blocks:
                same = same * np.minimum(level.first[level.up[a] + 1] - a, level.first[level.up[b] + 1] - b)
            ended = [(who, a + same, b + same)]
        out = np.zeros(len(i), np.int64)
        for who, a, _ in ended:
            out[who] = a - i[who]
        return out


def _distinct(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch, that of its smallest period; rows are (start, stop, period)."""
    runs = runs[np.lexsort(runs.T[::-1])]
    keep = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(1)) if len(runs) else slice(0)
    return runs[keep]


def find_runs(text: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """(start, stop, period) of all runs in ``text`` as laid out for ``Grammar``, ``sizes`` falling.

    A run of period p holds max(least, periods * p) - p neighbouring positions whose
    word comes again p later, so one of them lies on the grid of that step.  Grid
    positions whose word does come again are extended to both sides.  The grids of
    all periods have about n log n positions.
    """
    grammar, ends = Grammar(text, len(sizes)), np.cumsum(sizes + 1)
    found, waiting, held = [np.zeros((0, 3), np.int64)], [], 0

    def extend() -> None:
        i, p = (np.concatenate(c) for c in zip(*waiting, strict=True))
        for k in range(0, len(i), QUERIES):
            at, period = i[k : k + QUERIES], p[k : k + QUERIES]
            start = at - grammar.common(at, at + period, back=True)
            stop = at + period + grammar.common(at, at + period)
            good = stop - start >= np.maximum(least, periods * period)
            found.append(np.stack([start, stop, period], 1)[good])
        found[:] = [_distinct(np.concatenate(found))]

    for p in range(1, int(sizes[0]) // periods + 1):
        need = max(least, periods * p)
        texts = np.searchsorted(-sizes, -need, "right")
        if not texts:
            break
        n = int(ends[texts - 1]) + 1
        step = need - p
        at = np.flatnonzero(text[step : n - p : step] == text[step + p : n : step]) * step + step
        if len(at):
            waiting.append((at, np.full(len(at), p)))
            held += len(at)
            if held >= QUERIES:
                extend()
                waiting, held = [], 0
    if waiting:
        extend()
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found))


def runs_of(texts: list[list], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> dict[int, np.ndarray]:
    """(start, length, period) rows, by start and then period, of each text that has a run."""
    out: dict[int, np.ndarray] = {}
    order = sorted((k for k, t in enumerate(texts) if len(t) >= least), key=lambda k: -len(texts[k]))
    while order:
        total, take = 0, 0
        while take < len(order) and (not take or total + len(texts[order[take]]) <= GRAMMAR_WORDS):
            total += len(texts[order[take]])
            take += 1
        part, order = order[:take], order[take:]
        sizes = np.array([len(texts[k]) for k in part])
        known: dict = {}
        fresh = count(take + 1)
        text = np.zeros(total + take + 1, np.int64)
        begins = np.cumsum(sizes + 1) - sizes
        for number, (k, begin) in enumerate(zip(part, begins.tolist(), strict=True), 1):
            words = texts[k]
            for w in set(words).difference(known):
                known[w] = next(fresh)
            text[begin : begin + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            text[begin + len(words)] = number
        runs = find_runs(text, sizes, least, periods)
        owner = np.searchsorted(begins, runs[:, 0], "right") - 1
        for cut in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(owner)) + 1):
            if len(cut):
                own = runs[cut] - [begins[owner[cut[0]]], 0, 0]
                own[:, 1] -= runs[cut][:, 0]
                out[part[owner[cut[0]]]] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def collapse(words: list, runs: np.ndarray) -> list:
    """The words outside of runs, and of each run its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, prepare: Callable | None = None, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs``.

    Words are what ASCII white space leaves.  A run is a maximal stretch with its
    smallest period, at least ``periods`` periods and ``least`` words long; ``runs``
    lists them as (start, length, period) by start and then period, ``collapsed`` is
    the text of the words that stay when of every run only the first period stays,
    joined by single spaces.  ``prepare(doc_id, words)`` may change a row's words
    beforehand.

    NULL and empty texts have no run and collapse to an empty text.  Rows are
    independent: repeated rows and NULL ids give a row each, an empty table an empty
    table; other columns are not looked at, whatever their names.  A text is handled
    whole, so the longest one bounds a task's memory (some hundred bytes a word).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            # bytes.split cuts at ASCII white space only
            texts = [(t or b"").split() for t in batch["text"].cast(pa.binary()).to_pylist()]
            if prepare:
                texts = list(map(prepare, ids, texts))
            found = runs_of(texts, least, periods)
            lists = [found[k].tolist() if k in found else [] for k in range(len(texts))]
            kept = [b" ".join(collapse(t, found[k]) if k in found else t) for k, t in enumerate(texts)]
            fields = [pa.field(n, pa.int64()) for n in ("start", "length", "period")]
            flat = [pa.array([r[k] for x in lists for r in x], pa.int64()) for k in range(3)]
            offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, fields=fields)),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(doc_id, words: list) -> list:
    """The words of a tenth of the documents, repeated from some word on; a NULL id changes nothing."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the largest length by period (ties: first start, then period), and digests."""
    # exponents are compared as products, ties by the order of the list
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>),
      (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("_best")[n].alias(n) for n in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of all documents after a tenth of them were given periodic ends."""
    return digests(periodic_runs(table(spark, sf, "documents"), planted))

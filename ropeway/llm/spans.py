"""Repeated line windows and repeated lines, as spans of the original texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ropeway.llm.base import pack, query, stored, table

#: Lines of one window.
WINDOW = 3
#: Words from which a run of repeated units counts as a passage whose repetition matters.
MIN_WORDS = 25
#: Words of a repeated passage that is found wherever it starts, and of the windows that find it.
PASSAGE, GRAM = 50, 41
#: Words of a text that are hashed at a time.
BLOCK = 1 << 15

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: The white-space character behind the end of a sentence.
_ENDED = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that can be ranked and have a text."""
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            lines = text.split("\n")
            starts = [0]
            for line in lines:
                starts.append(starts[-1] + len(line) + 1)
            n = len(lines) - WINDOW + 1
            if n < 1:
                continue
            raw = [line.encode() for line in lines]
            yield pa.RecordBatch.from_pydict(
                {
                    "digest": [xxhash.xxh3_128_digest(b"\n".join(raw[i : i + WINDOW])) for i in range(n)],
                    "doc_id": [doc] * n,
                    "line": list(range(n)),
                    "starts": [starts[i : i + WINDOW] for i in range(n)],
                    "stop": [starts[i + WINDOW] - 1 for i in range(n)],
                },
                schema=_WINDOWS,
            )


_WINDOWS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int32()),
                      ("starts", pa.list_(pa.int64())), ("stop", pa.int64())])


def line_windows(docs: DataFrame) -> DataFrame:
    """Every run of three lines: 128-bit digest, doc_id, first line, start of each line, end."""
    return _texts(docs).mapInArrow(
        _window_batches, "digest binary, doc_id bigint, line int, starts array<bigint>, stop bigint")


def _later(units: DataFrame, position: str) -> DataFrame:
    """Units that repeat an earlier one, with the first of their digest.

    The first is found by partial aggregation; the units then meet only the digests
    that repeat, in a sort-merge join whose hot digests adaptive execution splits.
    """
    rank = F.struct("doc_id", position)
    firsts = (
        units.groupBy("digest")
        .agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
        .where("first < last")
        .select("digest", "first")
    )
    # read from a table both sides of the join are bare exchanges, whose hot partitions can be split
    firsts = stored(firsts, "repeated")
    return units.hint("merge").join(firsts, "digest").where(rank > F.col("first"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Spans to remove: the merged positions of all windows that occurred before.

    The occurrence with the smallest (doc_id, line) stays.  Where a later occurrence
    overlaps the first one of the same window, the lines of the first one stay, so a
    run of one repeated line shrinks to one window.  Returns doc_id, first_line,
    last_line (from 0, inclusive), start and stop (characters, stop exclusive),
    n_windows.  Texts with fewer than three lines, empty or NULL texts and rows
    without doc_id have no windows and lose nothing; rows that repeat an id and text
    count as one document.  An empty table gives an empty table.
    """
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line") - F.col("first.line") < WINDOW)
    skip = F.when(own, F.col("first.line") + WINDOW - F.col("line")).otherwise(0).cast("int")
    covered = _later(line_windows(docs), "line").select(
        "doc_id",
        (F.col("line") + skip).alias("first_line"),
        (F.col("line") + WINDOW - 1).alias("last_line"),
        F.get("starts", skip).alias("start"),
        "stop",
    ).distinct()
    before = Window.partitionBy("doc_id").orderBy("first_line", "last_line").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("first_line", "last_line").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("first_line") > F.max("last_line").over(before) + 1, F.lit(True))
    return (
        covered.withColumn("_opens", opens.cast("int"))
        .withColumn("_run", F.sum("_opens").over(upto))
        .groupBy("doc_id", "_run")
        .agg(
            F.min("first_line").alias("first_line"),
            F.max("last_line").alias("last_line"),
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.count(F.lit(1)).alias("n_windows"),
        )
        .drop("_run")
    )


def _unit_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                start = 0
                for number, line in enumerate(text.split("\n")):
                    words = _SPACE.sub(" ", line).strip(" ")
                    if words and words.count(" ") + 1 >= min_words:
                        rows.append((xxhash.xxh3_128_digest(words.lower().encode()), doc, number, start, start + len(line)))
                    start += len(line) + 1
            columns = list(zip(*rows, strict=True)) or [()] * len(_UNITS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNITS, strict=True)], schema=_UNITS)

    return run


_UNITS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("unit", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines of at least ``min_words`` words: 128-bit digest of the normalised line and its place.

    Normalising trims, makes each run of ASCII white space one space and lower-cases.
    """
    return _texts(docs).mapInArrow(
        _unit_batches(min_words), "digest binary, doc_id bigint, unit int, start bigint, stop bigint")


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to remove because an earlier one is equal after normalising.

    Of equal lines that with the smallest (doc_id, line number) stays.  Returns one
    row per removed line: doc_id, unit (its number, from 0), start and stop
    (characters of the original text, stop exclusive), keep_doc_id, keep_unit.
    Lines under ``min_words`` words (also empty ones), NULL texts and rows without
    doc_id lose nothing; rows that repeat an id and text count as one document.  An
    empty table gives an empty table.
    """
    return _later(units(docs, min_words), "unit").select(
        "doc_id", "unit", "start", "stop",
        F.col("first.doc_id").alias("keep_doc_id"), F.col("first.unit").alias("keep_unit"),
    ).distinct()


_POWERS = np.cumprod(np.full(BLOCK + PASSAGE, 0x9E3779B97F4A7C15, np.uint64))
_INVERSES = np.cumprod(np.full(BLOCK + PASSAGE, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))


def _chosen(words: list[bytes]) -> list[int]:
    """First words of the windows that are digested.

    Of each PASSAGE - GRAM + 1 neighbouring windows the one with the smallest hash is
    taken, so equal passages of PASSAGE words choose the same window inside them.
    """
    out = set()
    for at in range(0, len(words) - PASSAGE + 1, BLOCK):
        block = words[at : at + BLOCK + PASSAGE - 1]
        values = np.fromiter(map(xxhash.xxh3_64_intdigest, block), np.uint64, len(block))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _POWERS[: len(block)])))
        hashes = (sums[GRAM:] - sums[:-GRAM]) * _INVERSES[: len(block) - GRAM + 1]
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        near = np.lib.stride_tricks.sliding_window_view(hashes, PASSAGE - GRAM + 1)
        out.update((np.unique(near.argmin(axis=1) + np.arange(len(near))) + at).tolist())
    return sorted(out)


def _passage_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = text.lower().encode().split()
            if len(words) < PASSAGE:
                continue
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            space = np.concatenate(([True], (code == 32) | ((code >= 9) & (code <= 13)), [True]))
            starts, stops = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
            first = _chosen(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(b" ".join(words[k : k + GRAM])) for k in first], pa.binary()),
                    pa.array([doc] * len(first), pa.int64()),
                    pa.array(starts[first], pa.int64()),
                    pa.array(stops[np.array(first) + GRAM - 1], pa.int64()),
                ],
                schema=_PASSAGES,
            )


_PASSAGES = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def word_windows(docs: DataFrame) -> DataFrame:
    """Chosen windows of GRAM normalised words, across lines: 128-bit digest, doc_id, start, stop."""
    return _texts(docs).mapInArrow(_passage_batches, "digest binary, doc_id bigint, start bigint, stop bigint")


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch, as one."""
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    opens = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    return (
        spans.withColumn("_opens", opens.cast("int"))
        .withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .drop("_run")
    )


def _line_batches(sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                start, rows = 0, []
                # one character takes the place of one, so offsets stay those of the text
                for line in (_ENDED.sub("\n", text) if sentences else text).split("\n"):
                    words = line.lower().encode().split()
                    if words:
                        rows.append((xxhash.xxh3_128_digest(b" ".join(words)), doc, len(rows), len(words), start, start + len(line)))
                    start += len(line) + 1
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True)], schema=_LINES)

    return run


_LINES = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int32()), ("words", pa.int32()),
                    ("start", pa.int64()), ("stop", pa.int64())])


def lines(docs: DataFrame, sentences: bool = False) -> DataFrame:
    """Every line with a word: digest as in ``units``, doc_id, number among these lines, words, start, stop.

    With ``sentences`` a line also ends at each white-space character behind ``.``, ``!``
    or ``?``, so a unit is a sentence of a line, or what a line holds of one.
    """
    return _texts(docs).mapInArrow(
        _line_batches(sentences), "digest binary, doc_id bigint, line int, words int, start bigint, stop bigint")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, sentences: bool = False) -> DataFrame:
    """Runs of neighbouring repeated lines, or sentences, of ``min_words`` words in all.

    Every unit with a word is digested, however short.  Of equal units that with the
    smallest (doc_id, number) stays; the others are joined to runs of neighbours, and a
    run goes when it has ``min_words`` words.  Units without a word between two of them
    neither end a run nor count.  Returns doc_id, start and stop (characters of the
    original text, stop exclusive), n_units and n_words.

    NULL and empty texts and rows without doc_id lose nothing; rows that repeat an id
    and text count as one document; a text is cut into units whole, by one task, and
    only digests and places move.  Other columns are not read.  An empty table gives
    an empty table.
    """
    order = Window.partitionBy("doc_id").orderBy("line", "start", "stop", "words")
    unit = F.struct("line", "start", "stop", "words")
    later = _later(lines(docs, sentences), "line").select("doc_id", "line", "words", "start", "stop")
    return (
        later.select("*", (F.col("line") - F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line"))).alias("_run"),
                     F.coalesce(F.lag(unit).over(order) < unit, F.lit(True)).alias("_new"))
        .where("_new")
        .groupBy("doc_id", "_run")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"))
        .where(F.col("n_words") >= min_words)
        .drop("_run")
    )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Spans to remove: runs of repeated lines and passages of words wherever they start.

    Neighbouring lines that all occurred before go when they have MIN_WORDS words in all.

    Each word of a removed passage lies in GRAM words in a row that occurred before, in
    an earlier document or earlier in its own; white space and case do not count.
    Every passage of PASSAGE words that repeats loses GRAM words at least; up to
    PASSAGE - GRAM words at either end stay.  Where a passage overlaps the one it
    repeats, that one stays.  Returns doc_id, start and stop (characters of the
    original text, stop exclusive), which do not overlap.  Shorter passages inside
    lines, NULL texts and rows without doc_id lose nothing; rows that repeat an id and
    text count as one document.  An empty table gives an empty table.
    """
    windows = word_windows(docs)
    rank = F.struct("doc_id", "start", "stop")
    firsts = windows.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last")
    later = windows.hint("merge").join(stored(firsts.select("digest", "first"), "passages"), "digest").where(rank > F.col("first"))
    own = F.col("doc_id") == F.col("first.doc_id")
    start = F.when(own, F.greatest("start", F.col("first.stop") + 1)).otherwise(F.col("start"))
    passages = later.select("doc_id", start.alias("start"), "stop")
    return _merged(passages.union(repeated_runs(docs).select("doc_id", "start", "stop")).distinct())


def _cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    def one(text, spans):
        if text is None or spans is None:
            return text
        kept, at = [], 0
        for span in spans:
            kept.append(text[at : span["start"]])
            at = span["stop"] + 1
        # a cut last line takes the line end before it along
        return "".join(kept) + text[at:] if at <= len(text) else "".join(kept).removesuffix("\n")

    return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)], dtype=object)


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut from their texts, other columns untouched.

    ``spans`` has doc_id, start and stop and covers whole lines, or whole words, that do
    not overlap; a cut takes the line end or white space behind it along.  A text that
    loses all lines becomes empty.
    """
    cuts = spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_cuts"))
    joined = pack(docs, _key=F.col("doc_id").cast("bigint")).join(cuts, F.col("_key") == F.col("_id"), "left")
    cut = F.pandas_udf(_cut, "string")(F.col("_row.text"), F.col("_cuts"))
    return joined.select(*[(cut if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])


@query(
    "op1_line_windows",
    """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT doc_id, a, unnest(range(len(a) - 2)) AS line FROM l WHERE len(a) >= 3),
w AS (SELECT doc_id, line, a[line + 1] || chr(10) || a[line + 2] || chr(10) || a[line + 3] AS win,
  [coalesce(list_sum(list_transform(a[:line], lambda x: length(x) + 1)), 0),
   list_sum(list_transform(a[:line + 1], lambda x: length(x) + 1)),
   list_sum(list_transform(a[:line + 2], lambda x: length(x) + 1)),
   list_sum(list_transform(a[:line + 3], lambda x: length(x) + 1))] AS s FROM n),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(line) OVER o AS fl FROM w
  WINDOW o AS (PARTITION BY win ORDER BY doc_id, line)),
c AS (SELECT DISTINCT doc_id, line + k AS first_line, line + 2 AS last_line, s[k + 1] AS start, s[4] - 1 AS stop
  FROM (SELECT *, CASE WHEN doc_id = fd AND line - fl < 3 THEN fl + 3 - line ELSE 0 END AS k FROM f
    WHERE (doc_id, line) > (fd, fl))),
o AS (SELECT *, CASE WHEN first_line <= max(last_line) OVER (PARTITION BY doc_id ORDER BY first_line, last_line
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS opens FROM c),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY first_line, last_line ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT doc_id, CAST(min(first_line) AS INTEGER) AS first_line, CAST(max(last_line) AS INTEGER) AS last_line,
  CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, count(*) AS n_windows
FROM r GROUP BY doc_id, run
""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Line spans of ``documents`` that repeat an earlier three-line window."""
    return repeated_windows(table(spark, sf, "documents"))


@query(
    "op9_repeated_lines",
    r"""
WITH l AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\x20\x09-\x0D]', '\1' || chr(10), 'g'), chr(10)) AS a FROM l),
u AS (SELECT doc_id, unnest(a) AS unit, unnest(range(len(a))) AS pos FROM s),
o AS (SELECT *, sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS stop,
  lower(trim(regexp_replace(unit, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM o WHERE norm <> ''),
f AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(k) OVER w AS fk FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id, k)),
r AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f WHERE (doc_id, k) > (fd, fk))
SELECT doc_id, CAST(min(stop - length(unit)) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, count(*) AS n_units,
  CAST(sum(len(string_split(norm, ' '))) AS BIGINT) AS n_words
FROM r GROUP BY doc_id, run HAVING sum(len(string_split(norm, ' '))) >= 25
""",
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of ``documents`` to remove: runs of sentences and lines that all occurred before, with their original offsets."""
    return repeated_runs(table(spark, sf, "documents"), sentences=True)


@query("op9_repeated_passages")
def op9_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of ``documents`` to remove: repeated lines and passages that repeat inside lines or across them."""
    return repeated_passages(table(spark, sf, "documents"))

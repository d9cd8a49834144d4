"""Language identification by unigram piece models, summed over all segmentations."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ropeway.llm.base import query, stored, table, worker_memory

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Labelled documents a language is fitted on, those with the smallest hashes.
FIT_DOCS = 1000
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Count added to every piece, and the probability of a character outside the vocabulary.
PRIOR, UNKNOWN = 0.01, 1e-7
#: Fitting documents up to which their ids are broadcast.
FEW = 100_000
#: Words one worker remembers.
REMEMBERED = 1_500_000
#: Characters of a word that is summed with others at once, words of one such step, characters of a step of a longer word.
SHORT, CHUNK, LONG_STEP = 31, 4096, 4096
#: Words that are looked up together.
STEP_WORDS = 300_000
#: Punctuation that is cut from the edges of words.
EDGES = string.punctuation + "«»“”„‘’…¿¡–—"
#: Smallest score with which a document passes.
PASS = 0.5

_MARK = "▁"


@lru_cache(maxsize=2)
def pieces(path: str = VOCABULARY) -> dict[str, int]:
    """Lower-cased pieces of the vocabulary without control and byte pieces, numbered in order."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            out.setdefault(model.id_to_piece(i).lower(), len(out))
    return out


def words(text: str) -> list[str]:
    return text.lower().split()


class Lattice:
    """Finds vocabulary pieces in many words at once and sums over their segmentations.

    Words are rows of code points with the word mark in front.  A piece is found by a
    64-bit polynomial hash of its characters, compared among the pieces of its length.
    """

    def __init__(self, path: str = VOCABULARY):
        known = pieces(path)
        self.pieces = len(known)
        by_length: dict[int, list[str]] = {}
        for piece in known:
            by_length.setdefault(len(piece), []).append(piece)
        self.longest = max(by_length)
        self.keys, self.ids = {}, {}
        for n, group in by_length.items():
            hashes = self._hashes(self._codes(group))[-1][:, n - 1]
            order = np.argsort(hashes)
            self.keys[n], self.ids[n] = hashes[order], np.array([known[p] for p in group])[order]

    @staticmethod
    def _codes(marked: list[str]) -> np.ndarray:
        width = max(map(len, marked))
        return np.array(marked, dtype=f"<U{width}").view(np.uint32).reshape(len(marked), width).astype(np.uint64)

    def _hashes(self, codes: np.ndarray, most: int | None = None) -> list[np.ndarray]:
        """For each length the hashes of the substrings that end at each position."""
        mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out = [mixed]
        for n in range(2, min(codes.shape[1], most or codes.shape[1]) + 1):
            grown = np.zeros_like(mixed)
            grown[:, n - 1 :] = out[-1][:, n - 2 : -1] * np.uint64(0xBF58476D1CE4E5B9) + mixed[:, n - 1 :]
            out.append(grown)
        return out

    def arcs(self, marked: list[str]) -> dict[int, np.ndarray]:
        """For each piece length the piece that ends at each position of each word.

        No piece is the number of pieces plus one, an unknown single character the
        number of pieces.
        """
        out = {}
        for n, hashes in enumerate(self._hashes(self._codes(marked), self.longest), 1):
            none = self.pieces + (n > 1)
            if n not in self.keys:
                found = np.full(hashes.shape, none)
            else:
                at = np.minimum(np.searchsorted(self.keys[n], hashes), len(self.keys[n]) - 1)
                found = np.where(self.keys[n][at] == hashes, self.ids[n][at], none)
            found[:, : n - 1] = self.pieces + 1
            out[n] = found
        return out

    def forward(self, arcs: dict[int, np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Probabilities of all prefixes: words by positions by languages.  ``rows`` ends in a row of zeros."""
        w, width = arcs[1].shape
        alpha = np.zeros((w, width + 1, rows.shape[1]))
        alpha[:, 0] = 1.0
        for stop in range(1, width + 1):
            for n in range(1, min(stop, len(arcs)) + 1):
                alpha[:, stop] += alpha[:, stop - n] * rows[arcs[n][:, stop - 1]]
        return alpha

    def log_likelihoods(self, own: list[str], rows: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word, a column per language."""
        out = np.empty((len(own), rows.shape[1]))
        sizes = np.array([len(x) for x in own])
        for low, high in zip((0, 7, 11, 15, 23), (7, 11, 15, 23, SHORT), strict=True):
            for at in np.array_split(np.flatnonzero((sizes > low) & (sizes <= high)), max(1, (sizes <= high).sum() // CHUNK)):
                if len(at):
                    alpha = self.forward(self.arcs([_MARK + own[i] for i in at]), rows)
                    out[at] = np.log(alpha[np.arange(len(at)), sizes[at] + 1])
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self.long(own[i], rows)
        return out

    def long(self, word: str, rows: np.ndarray) -> np.ndarray:
        """The same for one long word, rescaled at every character so that nothing underflows."""
        marked = _MARK + word
        window = [np.ones(rows.shape[1])]
        total = np.zeros(rows.shape[1])
        for begin in range(0, len(marked), LONG_STEP):
            low = max(0, begin - self.longest)
            arcs = self.arcs([marked[low : begin + LONG_STEP]])
            for stop in range(begin + 1, min(begin + LONG_STEP, len(marked)) + 1):
                new = np.zeros(rows.shape[1])
                for n in range(1, min(stop, len(arcs), len(window)) + 1):
                    new += window[-n] * rows[arcs[n][0, stop - low - 1]]
                total += np.log(new)
                window = [x / new for x in window[-self.longest :]] + [np.ones_like(new)]
        return total

    def expected(self, own: list[str], counts: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in counted words of at most SHORT characters, under one language."""
        rows = column[:, None]
        out = np.zeros(self.pieces)
        sizes = np.array([len(x) for x in own])
        order = np.argsort(sizes, kind="stable")
        for at in np.array_split(order, max(1, len(order) // CHUNK)):
            arcs = self.arcs([_MARK + own[i] for i in at])
            alpha = self.forward(arcs, rows)[:, :, 0]
            width = arcs[1].shape[1]
            beta = np.zeros_like(alpha)
            beta[np.arange(len(at)), sizes[at] + 1] = 1.0
            for start in range(width - 1, -1, -1):
                for n in range(1, min(width - start, len(arcs)) + 1):
                    beta[:, start] += beta[:, start + n] * column[arcs[n][:, start + n - 1]]
            scale = counts[at] / beta[:, 0]
            for n, found in arcs.items():
                used = alpha[:, : width + 1 - n] * column[found[:, n - 1 :]] * beta[:, n:] * scale[:, None]
                out += np.bincount(found[:, n - 1 :].ravel(), used.ravel(), self.pieces + 2)[: self.pieces]
        return out


@lru_cache(maxsize=2)
def lattice(path: str = VOCABULARY) -> Lattice:
    return Lattice(path)


def fit(labelled: DataFrame, path: str = VOCABULARY, docs: int = FIT_DOCS, rounds: int = ROUNDS) -> dict:
    """Piece probabilities of every language in ``labelled`` (doc_id, text, lang).

    A language is fitted on its ``docs`` documents with the smallest id hashes (at
    times a few less, where hashes lie unevenly).  Their
    distinct words and counts stay distributed; each round computes expected piece
    counts by forward and backward sums in tasks and adds them up.  What reaches the
    driver is a count per language and one number per piece and language, bounded by
    the vocabulary times the number of labels.  Words over SHORT characters are fitted
    in stretches of that length.  Returns {"langs": [...], "table": pieces + 1 rows by language}.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    # of each language only hashes that can be among the smallest reach its window, however many tasks read it
    enough = docs + 10 * math.sqrt(docs) + 20
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, enough / n)]) if rows else F.create_map(F.lit(""), F.lit(0.0))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    # a literal per language, so that only the few rows below it are shuffled
    near = usable.select("doc_id", "lang", place.alias("_place")).where(F.col("_place") < share[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("_place", "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= docs)
    chosen = chosen.select("doc_id", F.col("lang").alias("_lang")).distinct()
    few = chosen.count() <= FEW  # the bound on what is broadcast: some numbers and names a row
    own = usable.join(F.broadcast(chosen) if few else chosen, (usable["doc_id"] == chosen["doc_id"]) & (usable["lang"] == chosen["_lang"]), "left_semi")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                parts = [w[k : k + SHORT] for w in cores(text) for k in range(0, len(w), SHORT)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(parts), pa.string()), "word": pa.array(parts, pa.string())})

    counts = stored(
        own.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")),
        "word-counts",
    )
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    known = pieces(path)
    table_ = np.full((len(known) + 1, len(langs)), 1.0 / len(known))
    table_[-1] = UNKNOWN
    for _ in range(rounds if langs else 0):
        total = np.full((len(known), len(langs)), PRIOR)
        for r in _expectations(counts, path, langs, table_).collect():
            total[r.piece, langs.index(r.lang)] += r.n
        table_[:-1] = (1 - UNKNOWN) * total / total.sum(0)
    return {"langs": langs, "table": table_}


def _expectations(counts: DataFrame, path: str, langs: list[str], table_: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path)
        sums = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                column = np.append(table_[:, langs.index(lang)], 0.0)
                more = own.expected(part["word"].tolist(), part["n"].to_numpy(float), column)
                sums[lang] = sums.get(lang, 0.0) + more
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(used), pa.string()), "piece": pa.array(used, pa.int32()), "n": pa.array(total[used])})

    return counts.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Remembered:
    """Log likelihoods of words by 64-bit hashes, in sorted arrays of at most ``most`` words.

    Hashes take an eighth of what words take; that two of a worker's words share one
    has a chance of 10^-7.  Beyond ``most`` words those stay that were asked for since
    the last time.
    """

    def __init__(self, width: int, most: int):
        self.most, self.width = most, width
        self._keep(slice(0), np.zeros(0, np.int64), np.zeros((0, width)))

    def _keep(self, which, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys, self.rows = keys[which], rows[which]
        self.asked = np.zeros(len(self.keys), bool)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``keys`` and which of them are known."""
        out, known = np.zeros((len(keys), self.width)), np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            self.asked[at[known]] = True
            out[known] = self.rows[at[known]]
        return out, known

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Takes in sorted new ``keys``."""
        if len(self.keys) + len(keys) > self.most:
            self._keep(self.asked.copy(), self.keys, self.rows)
            if len(self.keys) + len(keys) > self.most:
                self._keep(slice(0), self.keys, self.rows)
        at = np.searchsorted(self.keys, keys)
        asked = np.insert(self.asked, at, True)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows, axis=0)
        self.asked = asked


class Scorer:
    """Sums of word log likelihoods; a step looks each distinct word up once."""

    def __init__(self, path: str, table_: np.ndarray):
        self.own = lattice(path)
        self.rows = np.vstack([table_, np.zeros(table_.shape[1])])
        self.memory = Remembered(table_.shape[1], REMEMBERED)

    def texts(self, split: list[list[str]]) -> np.ndarray:
        """Log likelihood of the words of every text under every language, a row for each text."""
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        total = np.zeros((len(split), self.rows.shape[1]))
        if not sizes.any():
            return total
        flat = list(chain.from_iterable(split))
        keys, first, place = np.unique(np.fromiter(map(hash, flat), np.int64, len(flat)), return_index=True, return_inverse=True)
        rows, known = self.memory.find(keys)
        new = np.flatnonzero(~known)
        if len(new):
            rows[new] = self.own.log_likelihoods([flat[i] for i in first[new].tolist()], self.rows)
            self.memory.add(keys[new], rows[new])
        full = np.flatnonzero(sizes)
        total[full] = np.add.reduceat(rows[place], (np.cumsum(sizes) - sizes)[full])
        return total


def cores(text: str) -> list[str]:
    """Words without the punctuation at their edges, which says nothing."""
    return [c for w in words(text) if (c := w.strip(EDGES))]


def told(texts: list[str | None], scorer: Scorer | None) -> list[tuple[int, float] | None]:
    """The best language and its posterior for each text; None for texts that say nothing."""
    out: list[tuple[int, float] | None] = [None] * len(texts)
    split, part, held = [], [], 0

    def score() -> None:
        for i, sums in zip(part, scorer.texts(split), strict=True):
            best = int(sums.argmax())
            out[i] = best, float(1 / np.exp(np.maximum(sums - sums[best], -700)).sum())
        split.clear()
        part.clear()

    for i, text in enumerate(texts):
        if scorer is None or text is None or not any(map(str.isalpha, text)):
            continue
        split.append(cores(text))
        part.append(i)
        held += len(split[-1])
        if held >= STEP_WORDS:
            score()
            held = 0
    if part:
        score()
    return out


def predict(docs: DataFrame, model: dict, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its whole text.

    ``lang_pred`` has the largest sum over words of the log of the probability of all
    their segmentations, ties going to the first in order; ``score`` is its posterior
    with equal priors.  NULL texts and texts without a letter are ``und`` with score
    0, and so are all when no language was learned.  Repeated rows and NULL ids give
    a row each; an empty table gives an empty table.
    """
    langs, table_ = model["langs"], model["table"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(path, table_) if langs else None
        for batch in batches:
            found = told(batch["text"].to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([langs[x[0]] if x else "und" for x in found], pa.string()),
                pa.array([x[1] if x else 0.0 for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def _scorer(path: str, table_: np.ndarray) -> Scorer:
    """One memory for all tasks of a worker, for the model used last."""
    return worker_memory(("language", path, table_.tobytes()), lambda: Scorer(path, table_))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The rows whose language is told with a score of at least one half, with all their columns.

    The models are fitted on the labelled rows that are not held out.  Where nothing
    can be learned, for want of labels, nothing is rejected but texts without a
    letter.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), path)
    langs, table_ = model["langs"], model["table"]

    def passes(texts: pd.Series) -> pd.Series:
        if not langs:
            return texts.map(lambda t: t is not None and any(map(str.isalpha, t))).astype(bool)
        return pd.Series([x is not None and x[1] >= PASS for x in told(texts.tolist(), _scorer(path, table_))], dtype=bool)

    return docs.where(F.pandas_udf(passes, "boolean")("text"))


@query("op7_language")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the labelled documents that are not held out."""
    docs = table(spark, sf, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

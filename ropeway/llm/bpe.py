"""Byte-level BPE by prefix dynamic programming."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ropeway.llm.base import query, table, worker_memory

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces one worker remembers.
REMEMBERED = 400_000
#: Pairs of tokens whose fit it remembers.
PAIRS = 150_000


class PrefixBpe:
    """Encodes one piece of text at a time.

    Every prefix of a piece has one valid last token: the longest token that ends
    there and may follow the last token of the prefix before it.  Storing that token
    for each prefix gives the encoding by walking back from the end, an append by
    going on from the stored tokens, and a re-encoding by starting where the bytes
    first differ.
    """

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None for a single byte."""
        if token not in self._parts:
            whole, found = self.tokens[token], None
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if left is not None and right is not None and max(left, right) < token and self._meet(left, right, token):
                    found = (left, right)
                    break
            if found is None and len(whole) > 1:
                raise ValueError(f"token {token} is no merge of two others")
            self._parts[token] = found
        return self._parts[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._meet(left, right, len(self.tokens) + 1)
        return known

    def _meet(self, left: int, right: int, bound: int) -> bool:
        """Whether no merge of a rank below ``bound`` ever joins the two across their border.

        Merges are undone latest first.  The pair at the border then stood until the
        undone merge took place, so it must not have merged at a lower rank; of equal
        ranks the left one comes first.
        """
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                return False
            one, other = self.parts(left), self.parts(right)
            if one is None and other is None:
                return True
            if other is None or (one is not None and left > right):
                bound, left = left, one[1]
            else:
                # an equal rank across the border lies to the left of the undone merge
                bound, right = right + 1, other[0]

    def prefixes(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of ``piece``; ``last`` holds those already known."""
        ranks, longest, fits = self.ranks, self.longest, self.fits
        last = list(last or ())
        for stop in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, stop - longest), stop):
                token = ranks.get(piece[start:stop])
                if token is not None and (start == 0 or fits(last[start - 1], token)):
                    last.append(token)
                    break
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The tokens of a piece from the last tokens of its prefixes."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.prefixes(piece))

    def append(self, last: list[int], piece: bytes, more: bytes) -> list[int]:
        """Last tokens of ``piece + more`` from those of ``piece``."""
        return self.prefixes(piece + more, last)

    def replace(self, last: list[int], piece: bytes, start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The edited piece and its last tokens; those of the prefixes before the edit are kept."""
        edited = piece[:start] + new + piece[stop:]
        return edited, self.prefixes(edited, last[:start])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> PrefixBpe:
    return PrefixBpe(path)


SPLIT = regex.compile(public_tokenizers.PATTERN)


class Remembered(dict):
    """Pieces already encoded, as ``make`` renders their ids.

    Beyond ``most`` pieces the older half of them makes room, except for those
    that are asked for again.
    """

    def __init__(self, path: str, make, most: int):
        self.bpe, self.make, self.most, self.old = encoder(path), make, most, {}

    def __missing__(self, piece: str):
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        made = self.old.get(piece)
        if made is None:
            made = self.make(self.bpe.encode(piece.encode()))
        if len(piece) <= 64:
            self[piece] = made
        return made


def _joined(ids: list[int]) -> str:
    return " ".join(map(str, ids))


def remembered(path: str, make, most: int = REMEMBERED) -> Remembered:
    """One memory for all tasks of a worker."""
    return worker_memory(("pieces", path, make), lambda: Remembered(path, make, most))


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row, ids as array<int>.

    Whole texts are split by the public pattern and each match is encoded by itself,
    as ordinary text.  NULL and empty texts have no ids.  Rows are independent:
    repeated rows and NULL ids give a row each, an empty table an empty table.
    ``path`` names the rank file, which every worker reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, tuple)
        for batch in batches:
            ids = [[i for p in SPLIT.findall(t or "") for i in known[p]] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, data) of encoded rows, data as the bytes of their ids; NULL ids give NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            data = [None if i is None else bpe.decode(i) for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, data binary")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Digests of encoding and decoding every row in one pass, without moving the ids.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the bytes the ids decode to); see ``encode`` for the cases.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, _joined)
        data = {str(i): t for t, i in known.bpe.ranks.items()}
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch["text"].to_pylist():
                joined = " ".join(map(known.__getitem__, SPLIT.findall(text or "")))
                tokens = joined.split(" ") if joined else []
                counts.append(len(tokens))
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(data.__getitem__, tokens))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@query("op8_prefix_bpe")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and digests of all documents' tokens, and of the texts they decode to."""
    return round_trip(table(spark, sf, "documents"))

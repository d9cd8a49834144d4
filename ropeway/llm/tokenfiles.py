"""Token ids in binary shards, compressed by a Re-Pair grammar each."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from ropeway.llm.base import query, stored, table, worker_memory
from ropeway.session import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Id after each document.
END_ID = 2
#: Ids after which a shard ends with the document, and bytes of text that one writing task gets.
SHARD_IDS, TASK_BYTES = 1_000_000, 24 << 20
#: A pair becomes a rule from so many uses on; one round takes the pairs down to this part of the most frequent one's uses.
LEAST_USES, ROUND_SHARE = 32, 16
#: Entries of a table of pairs, beyond which pairs are searched.
TABLE = 1 << 22
#: Symbols of the sequence between two stored positions.
ANCHOR = 256
#: Words a worker remembers, their characters at most, and texts encoded together.
REMEMBERED, LONGEST_WORD, TEXTS = 1_000_000, 64, 1024
#: Writing tasks whose totals meet in one window.
GROUP = 1000

#: One mark between an ASCII letter or digit and white space: a token border for the vocabulary's pattern.
_MARK = re.compile(rb"[.,;:!?](?<=[a-z0-9].)(?=[\x20\x09-\x0d]|\Z)")

#: Words that are in composed form and lower case already: ASCII without capitals, small letters of Latin-1.
_PLAIN = re.compile("[!-@\\[-~ß-öø-ÿ]+")

MAGIC = b"TIDS0001"
#: Task, number within the task, documents, terminals, rules, symbols, ids, bytes of a symbol.
_HEAD = struct.Struct("<8s8Q")


def pairs_to_replace(symbols: np.ndarray, known: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Left positions, rule of each and the rules (left, right) of one round; None when no pair is frequent.

    All pairs are counted.  Taken are those down to a share of the most frequent
    pair's uses; where two overlap the more frequent one stays, and in a stretch of
    one symbol every other one.
    """
    if len(symbols) < 2:
        return None
    wide = np.uint32 if known <= 1 << 16 else np.uint64
    keys = symbols[:-1].astype(wide) * wide(known) + symbols[1:].astype(wide)
    ordered = np.sort(keys)
    begins = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
    uses = np.diff(np.append(begins, len(ordered)))
    if uses.max() < least:
        return None
    taken = np.flatnonzero(uses >= max(least, uses.max() // ROUND_SHARE))
    wanted, rank = ordered[begins[taken]], np.empty(len(taken), np.int64)
    rank[np.lexsort((taken, -uses[taken]))] = np.arange(len(taken))
    firsts, seconds = (wanted // wide(known)).astype(np.int64), (wanted % wide(known)).astype(np.int64)
    rows, columns = np.zeros(known, np.int32), np.zeros(known, np.int32)
    rows[firsts], columns[seconds] = 1, 1
    rows *= np.cumsum(rows, dtype=np.int32)
    columns *= np.cumsum(columns, dtype=np.int32)
    width = int(columns.max()) + 1
    if (size := (int(rows.max()) + 1) * width) <= TABLE:
        # first and second symbols that occur in wanted pairs, against each other
        rows *= width
        ranked = np.full(size, -1, np.int32)
        ranked[rows[firsts] + columns[seconds]] = rank
        ranks = ranked[rows[symbols[:-1]] + columns[symbols[1:]]]
        at = np.flatnonzero(ranks >= 0)
        ranks = ranks[at]
    else:
        at = np.flatnonzero((rows[symbols[:-1]] > 0) & (columns[symbols[1:]] > 0))
        own = keys[at]
        place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
        hit = wanted[place] == own
        at, ranks = at[hit], rank[place[hit]]
    # a chain of one rank is a stretch of one symbol
    chained = np.append(False, (np.diff(at) == 1) & (ranks[1:] == ranks[:-1]))
    place = np.arange(len(at))
    even = (place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0
    at, ranks = at[even], ranks[even]
    meets = np.diff(at) == 1
    loses = np.append(False, meets & (ranks[:-1] < ranks[1:])) | np.append(meets & (ranks[1:] < ranks[:-1]), False)
    at, ranks = at[~loses], ranks[~loses]
    realised = np.bincount(ranks, minlength=len(taken))
    # the most frequent pair loses nothing, or every other place to itself
    made = realised >= max(1, least // 2)
    number = np.cumsum(made) - 1
    keep = made[ranks]
    by_rank = np.empty(len(taken), wanted.dtype)
    by_rank[rank] = wanted
    rules = by_rank[made].astype(np.uint64)
    return at[keep], number[ranks[keep]], np.stack([rules // np.uint64(known), rules % np.uint64(known)], 1).astype(np.int64)


def compress(ids: np.ndarray, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terminals, rules and sequence: symbols below the number of terminals stand for these, the others for rules."""
    used = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    used[ids] = True
    terminals = np.flatnonzero(used)
    symbols = (np.cumsum(used) - 1)[ids] if len(ids) else np.zeros(0, np.int64)
    symbols, rules, known = symbols.astype(np.uint32), [np.zeros((0, 2), np.int64)], len(terminals)
    while (found := pairs_to_replace(symbols, known, least)) is not None:
        at, number, more = found
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols[at] = known + number
        symbols = symbols[stay]
        rules.append(more)
        known += len(more)
    return terminals, np.concatenate(rules), symbols


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Number of ids that each symbol stands for; a rule refers to earlier symbols only."""
    lengths = [1] * terminals
    for left, right in rules.tolist():
        lengths.append(lengths[left] + lengths[right])
    return np.array(lengths, np.int64)


def pack_shard(task: int, number: int, doc_ids: list, sizes: list[int], ids: np.ndarray, least: int = LEAST_USES) -> bytes:
    """One shard: head, terminals, rules, expansion lengths, documents, positions, sequence, checksum.

    All numbers are little-endian.  Documents are their ids (0 where NULL), a byte
    that tells known ids, and the ids before each of them in the shard; positions are
    the ids before every ANCHOR-th symbol.
    """
    terminals, rules, symbols = compress(ids, least)
    lengths = expansion_lengths(rules, len(terminals))
    before = np.cumsum(lengths[symbols]) - lengths[symbols]
    known = [i is not None for i in doc_ids]
    width = 2 if len(lengths) <= 1 << 16 else 4
    body = b"".join([
        _HEAD.pack(MAGIC, task, number, len(doc_ids), len(terminals), len(rules), len(symbols), len(ids), width),
        terminals.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths[len(terminals) :].astype("<u8").tobytes(),
        np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array(known, "u1").tobytes(),
        np.append(0, np.cumsum(sizes, dtype=np.int64)).astype("<u8").tobytes(),
        before[::ANCHOR].astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's content; ``read`` expands only the symbols that hold the asked ids."""

    def __init__(self, data: bytes):
        magic, self.task, self.number, docs, terminals, rules, symbols, self.n_ids, width = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        if magic != MAGIC:
            raise ValueError("no token shard")
        self.terminals = take("<u4", terminals)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = np.append(np.ones(terminals, np.int64), take("<u8", rules).astype(np.int64))
        ids, known = take("<i8", docs).tolist(), take("u1", docs).tolist()
        self.doc_ids = [i if k else None for i, k in zip(ids, known, strict=True)]
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.anchors = take("<u8", -(-symbols // ANCHOR)).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        if struct.unpack_from("<I", data, at)[0] != zlib.crc32(memoryview(data)[:at]):
            raise ValueError("token shard is damaged")

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of some symbols; each step takes one rule out of every symbol that is one."""
        symbols = symbols.astype(np.int64)
        while len(rules := np.flatnonzero(symbols >= len(self.terminals))):
            size = np.ones(len(symbols), np.int64)
            size[rules] = 2
            at = np.cumsum(size) - size
            out = np.repeat(symbols, size)
            out[at[rules]], out[at[rules] + 1] = self.rules[symbols[rules] - len(self.terminals)].T
            symbols = out
        return self.terminals[symbols]

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``, counted within the shard."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError("outside of the shard")
        if start == stop:
            return np.zeros(0, "<u4")
        first = (int(np.searchsorted(self.anchors, start, "right")) - 1) * ANCHOR
        last = int(np.searchsorted(self.anchors, stop, "left")) * ANCHOR
        symbols = self.symbols[first:last]
        ends = self.anchors[first // ANCHOR] + np.cumsum(self.lengths[symbols])
        low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        begin = int(ends[low] - self.lengths[symbols[low]])
        return self._expand(symbols[low:high])[start - begin : stop - begin]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def all(self) -> np.ndarray:
        """All ids at once: every rule is expanded once and then copied."""
        n, numbers = len(self.terminals), np.arange(len(self.lengths))
        ends = np.cumsum(self.lengths)
        flat, begins = self._expand(numbers), ends - self.lengths
        size = self.lengths[self.symbols]
        stops = np.cumsum(size)
        if not len(self.rules):
            return self.terminals[self.symbols] if n else np.zeros(0, "<u4")
        return flat[np.repeat(begins[self.symbols] - (stops - size), size) + np.arange(self.n_ids)]


class Numbers(dict):
    """Numbers words as they are first asked for, and notes them down."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Words:
    """Ids of words by the tokenizers library, each new word asked once.

    The vocabulary's file lower-cases, and splits at white space before anything else
    looks at two words together, so a text's ids are those of its lower-cased words.
    Words that its normaliser leaves as they are go to the library's model piece by
    piece, the pieces cut by the file's pattern; other words take the whole way.
    A word over LONGEST_WORD characters is not kept for later texts.
    """

    def __init__(self, path: str = VOCABULARY):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
        # the byte step's letters for the code points that _PLAIN lets through
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))}
        self._forget()

    def _forget(self) -> None:
        self.number = Numbers()
        self.sizes, self.begins, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self) -> None:
        """Encodes the words that were numbered since the last call, the last numbers being new."""
        found = list(map(self._ids, self.number.fresh))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begins = np.append(self.begins, len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32))

    def _ids(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII letters, one piece
            return [x.id for x in self.model.tokenize(word.decode())]
        text = word.decode()
        if not _PLAIN.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces = self.pieces.findall(text)
        return [x.id for p in pieces for x in self.model.tokenize(p if p.isascii() else p.translate(self.letters))]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, END_ID after each, and how many belong to each."""
        if len(self.number) > REMEMBERED:
            self._forget()
        split = [_MARK.sub(rb" \g<0>", t.lower()).split() for t in texts]  # ASCII capitals and white space
        counts = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        if self.number.fresh:
            self._learn()
        size = self.sizes[codes]
        stops = np.cumsum(size)
        ends = np.append(0, stops)[np.cumsum(counts)]
        at = np.repeat(self.begins[codes] - (stops - size), size) + np.arange(len(stops) and stops[-1])
        ids = np.insert(self.flat[at], ends, END_ID)
        if any(len(w) > LONGEST_WORD for w in self.number.fresh):
            for w in reversed(self.number.fresh):
                del self.number[w]
            self.flat = self.flat[: self.begins[len(self.number)]]
            self.sizes, self.begins = self.sizes[: len(self.number)], self.begins[: len(self.number)]
        self.number.fresh.clear()
        return ids, np.diff(ends, prepend=0) + 1


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every row's text to shards in folder ``path``, in ascending doc_id order.

    Texts are dealt to tasks by ranges of doc_id and sorted there; a task encodes
    them and closes a shard with the document that reaches ``shard_ids`` ids.  Rows
    without an id come first, rows that share one follow each other by their texts'
    hashes.  NULL and empty texts have the end id alone; an empty table writes no
    shard; other columns are not looked at.  A document never spans shards, so the
    longest one bounds a task's memory.  Spark's text writer commits one file a
    shard, so a lost task leaves nothing behind; it adds a byte after the checksum.
    """
    rows = docs.select("doc_id", "text")
    volume = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange(max(1, -(-volume // TASK_BYTES)), "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory(("words", vocabulary), lambda: Words(vocabulary))
        task, number, names, sizes, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            data = pack_shard(task, number, names, sizes, np.concatenate(parts))
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

        for batch in batches:
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                ids, counts = known.encode([t or b"" for t in part["text"].cast(pa.binary()).to_pylist()])
                cut = 0
                for name, size in zip(part["doc_id"].to_pylist(), counts.tolist(), strict=True):
                    names.append(name)
                    sizes.append(size)
                    parts.append(ids[cut : cut + size])
                    cut += size
                    held += size
                    if held >= shard_ids:
                        yield shard()
                        number, names, sizes, parts, held = number + 1, [], [], [], 0
        if names:
            yield shard()

    data = placed.mapInArrow(run, "data binary")
    data.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(task, number, doc_id, start, ids) of every document in the shards at ``path``; ``start`` counts within its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                shard = Shard(data.as_py())
                # no more than about a shard's usual ids in a batch
                ids, n = shard.all(), len(shard.doc_ids)
                lists = pa.LargeListArray.from_arrays(pa.array(shard.starts, pa.int64()), pa.array(ids.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.task] * n, pa.int64()), pa.array([shard.number] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()),
                     pa.array(shard.starts[:-1], pa.int64()), lists.cast(pa.list_(pa.int32()))],
                    names=["task", "number", "doc_id", "start", "ids"])

    return _files(spark, path).mapInArrow(run, "task bigint, number bigint, doc_id bigint, start bigint, ids array<int>")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(task, number, doc_id, start, n_tokens, ids_crc32) of every document, digests taken where the shards are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                shard = Shard(data.as_py())
                raw, n = memoryview(shard.all().astype("<u4").tobytes()), len(shard.doc_ids)
                cuts = (4 * shard.starts).tolist()
                digests = [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.task] * n, pa.int64()), pa.array([shard.number] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()),
                     pa.array(shard.starts[:-1], pa.int64()), pa.array(np.diff(shard.starts), pa.int64()), pa.array(digests, pa.int64())],
                    names=["task", "number", "doc_id", "start", "n_tokens", "ids_crc32"])

    return _files(spark, path).mapInArrow(
        run, "task bigint, number bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def placed_in_corpus(rows: DataFrame) -> DataFrame:
    """``rows`` of shards with ``start`` counted over all shards, in order of task and number.

    Totals are one row a shard; those of GROUP tasks meet in a window, then the totals of these groups.
    """
    group = F.floor(F.col("task") / GROUP)
    shards = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("_n")).withColumn("_group", group)
    inside = Window.partitionBy("_group").orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    over = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = shards.groupBy("_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_group", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    base = shards.join(groups, "_group").select("task", "number", (F.col("_before") + F.col("_base")).alias("_before"))
    return rows.join(base, ["task", "number"]).withColumn("start", F.col("start") + F.col("_before")).drop("_before")


@query("op12_token_shards")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all documents written to shards, and what reading these gives."""
    path = scratch_path(spark, "token-shards")
    write_tokens(table(spark, sf, "documents"), path)
    rows = placed_in_corpus(stored(read_digests(spark, path), "token-digests"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")

"""Near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.llm.base import bucketed, pack, query, stored, table, worker_memory
from ropeway.llm.components import components
from ropeway.llm.streams import Sets, runs, sorted_groups

#: Words of a shingle and the similarity of linked documents, as a fraction of whole numbers.
WORDS, NEAR, OF = 5, 75, 100
#: Minwise values of a document.
SKETCH = 128
#: Independent trees, and documents of a node that is compared exhaustively.
TREES, SMALL = 12, 250
#: Levels after which a node is one group of candidates without further branching.
LEVELS = 3
#: Deviations that an estimate may fall short of the threshold by.
DEVIATIONS = 4.0
#: Documents of a block that is compared on whole sets in one task.
BLOCK = 300
#: Words whose hashes a worker remembers.
REMEMBERED = 250_000
#: Representatives of one bucket of their table, about 300 MB.
REPS_PER_BUCKET = 500_000

_MULTIPLY = np.random.default_rng(75).integers(0, 2**63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(5).integers(0, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        made = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = made
        return made


def _hashes() -> _Hashes:
    return worker_memory("words", _Hashes)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence when it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = _hashes()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        size = np.full(1, len(h), np.uint64)
        return _mix((h * _PLACES[: len(h)]).sum(keepdims=True) + _PLACES[WORDS:] * size)
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(_mix(total))


def sketch(own: np.ndarray) -> np.ndarray:
    """Minwise values of a non-empty set under SKETCH hash functions."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max)
    for begin in range(0, len(own), 512):
        np.minimum(best, (own[begin : begin + 512, None] * _MULTIPLY[0] + _MULTIPLY[1]).min(0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, sketch) of every row: set size, digest of the set, minwise values.

    Key and sketch are NULL for texts without words and for rows without doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, rows = [], [], []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = shingles(text)
                sizes.append(len(own))
                use = len(own) and i is not None
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if use else None)
                rows.append(sketch(own).tobytes() if use else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())],
                names=["doc_id", "n", "key", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n bigint, key binary, sketch binary")


def _coordinates(nodes: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows that branch and the coordinate each takes, once or twice a row.

    A node branches by one coordinate, a third of the nodes by two, so that a pair at
    the threshold is expected to meet in one child.  Choices depend on the node alone.
    """
    draw = _mix(nodes.view(np.uint64) + np.uint64(level * 2 + 1))
    first = (draw % np.uint64(SKETCH)).astype(np.int64)
    second = ((draw >> np.uint64(20)) % np.uint64(SKETCH - 1) + np.uint64(1)).astype(np.int64)
    twice = np.flatnonzero((draw >> np.uint64(40)) % np.uint64(3) == 0)
    return [(np.arange(len(nodes)), first), (twice, (first[twice] + second[twice]) % SKETCH)]


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), SKETCH)


def _children(level: int):
    """Child nodes of (node, rep, sketch) rows; at level 0 the node is a tree's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _matrix(batch["sketch"], np.uint32)
            reps = batch["rep"]
            if level == 0:
                picked = np.random.default_rng(10).permutation(SKETCH)[:TREES]
                pairs = [(np.full(len(values), tree), np.full(len(values), c), np.arange(len(values))) for tree, c in enumerate(picked.tolist())]
            else:
                nodes = batch["node"].to_numpy(zero_copy_only=False)
                pairs = [(nodes[at], c, at) for at, c in _coordinates(nodes, level)]
            for node, c, at in pairs:
                made = _mix(_mix(node.astype(np.int64).view(np.uint64) + np.uint64(level)) ^ (values[at, c].astype(np.uint64) << np.uint64(8)) ^ c.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), reps.take(pa.array(at))], names=["node", "rep"])

    return run


def least_estimate() -> float:
    """Share of equal minwise values below which a pair is taken to lie under the threshold."""
    share = NEAR / OF
    return share - DEVIATIONS * math.sqrt(share * (1 - share) / SKETCH)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, root) of rows in a small node that resemble each other: sorted by node, all pairs of a node."""
    least = least_estimate() * SKETCH
    for frame in sorted_groups(batches, "node"):
        node, n = frame["node"].to_numpy(), frame["n"].to_numpy()
        values = np.frombuffer(b"".join(frame["sketch"]), np.uint32).reshape(len(frame), SKETCH)
        sets, linked = Sets(len(frame)), []
        for step in range(1, len(frame)):
            i = np.flatnonzero(node[step:] == node[:-step])
            if not len(i):
                break
            low, high = np.minimum(n[i], n[i + step]), np.maximum(n[i], n[i + step])
            i = i[low * OF >= high * NEAR]
            for begin in range(0, len(i), 8192):
                part = i[begin : begin + 8192]
                part = part[(values[part] == values[part + step]).sum(1) >= least]
                linked += zip(part.tolist(), (part + step).tolist(), strict=True)
        for i, j in linked:
            sets.join(i, j)
        used = sorted({x for pair in linked for x in pair})
        roots = [sets.root(x) for x in used]
        rep = frame["rep"].to_numpy()
        away = [(a, b) for a, b in zip(used, roots, strict=True) if rep[a] != rep[b]]
        if away:
            yield pa.RecordBatch.from_arrays([pa.array(rep[[a for a, _ in away]]), pa.array(rep[[b for _, b in away]])], names=["rep", "root"])


def candidates(reps: DataFrame) -> DataFrame:
    """(rep, root) edges that connect at least all likely pairs which a tree brings into one node.

    ``reps`` has rep, n and sketch.  Nodes are counted by partial aggregation; those
    of at most SMALL documents are compared exhaustively on their sketches, larger
    ones branch again.  What is still large after LEVELS choices agrees in all of them
    and becomes one group as it is: groups may be too large here, never too small,
    since exact comparison follows.
    """
    kind = dict(reps.dtypes)["rep"]
    plain = f"node bigint, rep {kind}"
    level, leaves, rest = 0, None, None
    rows = stored(reps.select("rep", "sketch").mapInArrow(_children(0), plain), "nodes")
    while True:
        counts = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("root")).where("size > 1"), "node-sizes")
        small = rows.hint("merge").join(counts.where(F.col("size") <= SMALL).select("node"), "node")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = counts.where(F.col("size") > SMALL)
        if not large.limit(1).count():
            break
        if level == LEVELS:
            rest = rows.hint("merge").join(large.select("node", "root"), "node").where("rep <> root").select("rep", "root")
            break
        level += 1
        inside = rows.hint("merge").join(large.select("node"), "node")
        rows = stored(inside.hint("merge").join(reps.select("rep", "sketch"), "rep").mapInArrow(_children(level), plain), "nodes")
    near = (
        leaves.hint("merge").join(reps, "rep").select("node", "rep", "n", "sketch")
        .repartition("node").sortWithinPartitions("node")
        .mapInArrow(_compared, f"rep {kind}, root {kind}")
    )
    return near if rest is None else near.unionByName(rest)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, root) of parts linked on whole sets: within a task, or across its two sides.

    Rows: task, side (0 or 1, or -1 when all pairs count), rep, key, part and text.
    Rows of equal ``part`` are known to be connected and are not compared; ``root`` is
    the smallest part that a part is linked to in the task.
    """
    for frame in sorted_groups(batches, "task"):
        out = []
        for begin, end in runs(frame["task"].to_numpy()):
            if end - begin > 1:
                out += _linked(frame.iloc[begin:end])
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["part", "root"])


def _linked(own) -> list[tuple]:
    sets_of, sides, parts, seen = [], [], [], set()
    for rep, key, side, part, text in zip(own["rep"], own["key"], own["side"], own["part"], own["text"], strict=True):
        found = shingles(text)
        # rows that repeat the id with another text are not the one that was sketched
        if xxhash.xxh3_128_digest(found.tobytes()) == key and (rep, key, side) not in seen:
            seen.add((rep, key, side))
            sets_of.append(found)
            sides.append(side)
            parts.append(part)
    n = len(parts)
    if n < 2:
        return []
    values = np.array([sketch(x) for x in sets_of])
    sizes = np.array([len(x) for x in sets_of])
    side, joined = np.array(sides), Sets(n)
    first: dict = {}
    for i, part in enumerate(parts):
        joined.join(first.setdefault(part, i), i)
    least = least_estimate() * SKETCH
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        ok = np.minimum(sizes[i], sizes[rest]) * OF >= np.maximum(sizes[i], sizes[rest]) * NEAR
        if side[i] >= 0:
            ok &= side[rest] != side[i]
        rest = rest[ok]
        score = (values[i] == values[rest]).sum(1)
        order = np.argsort(-score, kind="stable")
        for j in rest[order[score[order] >= least]].tolist():
            if joined.root(i) == joined.root(j):
                continue
            both = len(np.intersect1d(sets_of[i], sets_of[j], assume_unique=True))
            if OF * both >= NEAR * (len(sets_of[i]) + len(sets_of[j]) - both):
                joined.join(i, j)
    smallest: dict = {}
    for i, part in enumerate(parts):
        root = joined.root(i)
        smallest[root] = min(smallest.get(root, part), part)
    return sorted({(p, smallest[joined.root(i)]) for i, p in enumerate(parts) if p != smallest[joined.root(i)]})


def _run_exact(rows: DataFrame, kind: str, label: str) -> DataFrame:
    dealt = rows.repartition("task").sortWithinPartitions("task", "side", "rep")
    return stored(dealt.mapInArrow(_exact, f"part {kind}, root {kind}"), label)


def _renamed(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (.., class) with each class under the smallest one that the links connect it to."""
    if not links.limit(1).count():
        return classes
    merged = components(links, "part", "root").select(F.col("id").alias("class"), F.col("component").alias("_to"))
    return classes.join(merged, "class", "left").withColumn("class", F.coalesce("_to", "class")).drop("_to")


def exact_classes(docs: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, class): the class of every document that is linked on whole sets to one of its group.

    ``groups`` has rep and grp.  A group is dealt to blocks by id and every block is
    compared within, which settles groups of one block.  Of larger groups the first
    documents of the blocks' classes are compared next; then all documents outside the
    group's largest class meet all others, block by block, and whoever is in the same
    class already is skipped.  Texts, not sets, are moved.
    """
    kind = dict(reps.dtypes)["rep"]
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = groups.hint("merge").join(stored(sizes, "group-sizes"), "grp").select(
        "rep", "grp", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    # through a table of its own, else the texts would be dealt to the few buckets of the representatives
    keyed = stored(placed.join(reps.select("rep", "key"), "rep"), "placed")
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    members = stored(keyed.hint("merge").join(texts, "rep"), "members")
    alone = F.lit(-1).cast("int").alias("side")
    within = _run_exact(members.select(
        F.concat_ws("|", F.col("grp").cast("string"), "block").alias("task"), alone, "rep", "key", F.col("rep").alias("part"), "text"), kind, "within")
    near = within.select(F.col("part").alias("rep"), F.col("root").alias("class"))
    if not members.where("blocks > 1").limit(1).count():
        return near
    # the first of each class of a block stands for it
    own = members.where("blocks > 1").select("rep", "grp").distinct().join(near, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    own = stored(own, "classes")
    heads = own.select("grp", "class").distinct()
    cuts = stored(heads.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cuts")), "class-counts")
    firsts = heads.join(cuts, "grp").select(
        F.col("class").alias("rep"), F.concat_ws("|", F.col("grp").cast("string"), F.pmod(F.xxhash64("class", F.lit(1)), F.col("cuts"))).alias("task"))
    among = _run_exact(members.drop("grp").join(firsts, "rep").select("task", alone, "rep", "key", F.col("rep").alias("part"), "text"), kind, "among")
    own = stored(_renamed(own, among), "merged-classes")
    totals = own.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("rows"))
    best = F.max(F.struct("rows", "class"))
    outside = totals.groupBy("grp").agg(best.alias("b"), F.sum("rows").alias("all")).select(
        "grp", F.col("b.class").alias("top"), (F.col("all") - F.col("b.rows")).alias("out"), "all")
    outside = stored(outside.where("out > 0").select(
        "grp", "top", F.ceil(F.col("out") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns")), "outside")
    # the rows that meet: documents outside the largest class on one side, all of the group on the other
    dealt = own.join(outside, "grp").select(
        "rep", "class", (F.col("class") != F.col("top")).alias("away"), "rows", "columns",
        F.pmod(F.xxhash64("rep", F.lit(2)), "rows").cast("int").alias("row"), F.pmod(F.xxhash64("rep", F.lit(3)), "columns").cast("int").alias("column"), "grp")
    every = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("row"), F.col("column").alias("column"), F.lit(1).alias("side")))
    apart = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.struct(F.col("row").alias("row"), c.alias("column"), F.lit(0).alias("side")))
    spread = dealt.select("rep", "class", "grp", F.explode(F.when(F.col("away"), F.concat(every, apart)).otherwise(every)).alias("m"))
    meet = spread.select(F.concat_ws("|", F.col("grp").cast("string"), "m.row", "m.column").alias("task"), "m.side", "rep", F.col("class").alias("part"))
    across = _run_exact(meet.hint("merge").join(members.select("rep", "key", "text"), "rep").select("task", "side", "rep", "key", "part", "text"), kind, "across")
    settled = members.where("blocks = 1").select("rep").distinct().join(near, "rep")
    return settled.unionByName(_renamed(own, across).select("rep", "class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Set size, component and kept of every row of ``docs`` (doc_id, text).

    Words are runs of other than ASCII white space, lower-cased in A-Z; the set of a
    text is its distinct five-word shingles, of a shorter one its whole sequence.
    Documents are linked when their sets share 75 % of their union.  Texts of equal
    sets are one representative, under the smallest id.  Trees of chosen paths over
    minwise values give groups of candidates; whole sets decide inside them.

    Returns doc_id, n_shingles, component (smallest id reachable) and kept (whether
    that is its own).  Texts without words and rows without doc_id link with nothing
    and stay; rows that repeat an id are one document, which is linked where any of
    them is.  An empty table gives an empty table.
    """
    own = stored(sketches(docs), "sketches")
    made = own.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    # bucketed by id, so the levels and the comparison move their own rows to it and never the sketches
    reps = bucketed(made, "reps", "rep", max(16, -(-own.count() // REPS_PER_BUCKET)))
    edges = stored(candidates(reps.select("rep", "n", "sketch")), "candidates")
    groups = components(edges, "rep", "root").select(F.col("id").alias("rep"), F.col("component").alias("grp"))
    comps = exact_classes(docs, reps.select("rep", "key"), groups).withColumnRenamed("class", "component")
    results = stored(
        reps.select("key", "rep").join(comps.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left").select("key", F.coalesce("component", "rep").alias("component")), "document-classes")
    out = own.select("doc_id", "n", "key").join(results.hint("merge"), "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document per component, with all their columns."""
    gone = stored(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")), "near-gone")
    packed = pack(docs, _id=F.col("doc_id"))
    return packed.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


@query(
    "op4_near_documents",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")

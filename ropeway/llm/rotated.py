"""Near duplicates among embeddings, from binary codes of randomly rotated vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.llm.base import query, stored, table
from ropeway.llm.streams import Sets, runs, sorted_groups
from ropeway.llm.components import components

#: Cosine from which two vectors are linked, and the share of such pairs that the codes should bring together.
THRESHOLD, RECALL = 0.98, 0.9999
#: Standard deviations of the estimate that a pair may fall short by before it is ruled out.
DEVIATIONS = 4.0
#: Vectors of one block; larger buckets are compared block by block.
BLOCK = 512
#: Unlike vectors that a bucket of a label should hold.
OCCUPANCY = 32
SEED = 20240229


@lru_cache(maxsize=64)
def rotation(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, size, number)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def plan_bands(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands, for the label with the most distinct vectors.

    A bit agrees with probability 1 - angle / pi.  Bits grow with the logarithm of the
    vectors so that unlike ones rarely share a band; bands follow from the recall.
    """
    bits = min(48, max(4, math.ceil(math.log2(max(2, vectors) / OCCUPANCY))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def band_values(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The value of every band for each unit vector: signs after as many rotations as it takes."""
    size = unit.shape[1]
    turned = [unit @ rotation(size, i) > 0 for i in range(-(-bits * bands // size))]
    signs = np.concatenate(turned, axis=1)[:, : bits * bands].reshape(len(unit), bands, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


class Codes:
    """One sign per rotated component, with the factor that corrects inner products with it.

    With x the sign vector over the root of the size and o the rotated unit vector,
    <x, q> / <x, o> estimates <o, q> without bias for a unit vector q.  Its deviation
    is at most sqrt((1 - <x, o>^2) / (size - 1)) / <x, o>.
    """

    def __init__(self, unit: np.ndarray):
        size = unit.shape[1]
        self.turned = unit @ rotation(size, 0)
        self.signs = np.where(self.turned > 0, 1.0, -1.0) / math.sqrt(size)
        self.factor = (self.signs * self.turned).sum(1)
        spread = np.sqrt(np.maximum(1 - self.factor**2, 0) / max(1, size - 1))
        self.margin = DEVIATIONS * spread / self.factor

    def possible(self, i, j, threshold: float) -> np.ndarray:
        """Whether both estimates of each pair of rows leave a cosine of ``threshold`` possible."""
        a, b = self, self
        first = a.signs[i] @ b.turned[j].T / a.factor[i][:, None] + a.margin[i][:, None]
        second = a.turned[i] @ b.signs[j].T / b.factor[j][None, :] + b.margin[j][None, :]
        return (first >= threshold) & (second >= threshold)


def vectors(table_: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, label, data, key): components as bytes and a digest of label and components.

    The key is NULL for rows that link with nothing: without id or label, and vectors
    that are NULL, empty, zero or hold NULL or non-finite components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, keys = [], []
            for i, own, values in zip(*(batch[c].to_pylist() for c in ("id", "label", "vector")), strict=True):
                raw = None
                if i is not None and own is not None and values and None not in values:
                    x = np.asarray(values, dtype=np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                data.append(raw)
                keys.append(None if raw is None else xxhash.xxh3_128_digest(f"{own}|".encode() + raw))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], pa.array(data, pa.binary()), pa.array(keys, pa.binary())], names=["id", "label", "data", "key"])

    picked = table_.select(F.col(id_column).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return picked.mapInArrow(run, f"id {dict(table_.dtypes)[id_column]}, label string, data binary, key binary")


def _units(data) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(data), dtype=np.float64).reshape(len(data), -1)
    # scaling first keeps squares of very large and very small components in range
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return raw, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _banded(bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for size, part in frame.groupby(frame["data"].str.len()):
                for begin in range(0, len(part), 2048):
                    own = part.iloc[begin : begin + 2048]
                    values = band_values(_units(own["data"].tolist())[1], bits, bands)
                    names = [f"{label}|{size}".encode() for label in own["label"]]
                    buckets = [
                        xxhash.xxh3_128_digest(n + b"|%d|%d" % (k, v)) for n, row in zip(names, values.tolist(), strict=True) for k, v in enumerate(row)]
                    repeated = own.loc[own.index.repeat(bands)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(buckets, pa.binary()), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(own))),
                        pa.array(repeated["rep"].to_numpy()), pa.array(repeated["copies"].to_numpy()), pa.array(repeated["data"], pa.binary())],
                        names=["bucket", "band", "rep", "copies", "data"])

    return run


def _compared(bits: int, bands: int, threshold: float):
    """Links inside one block, or between two blocks of one bucket."""

    def links(own) -> tuple[np.ndarray, np.ndarray]:
        _, unit = _units(own["data"].tolist())
        side = own["side"].to_numpy()
        n = len(own)
        a, b = (np.arange(n), np.arange(n)) if side[0] == side[-1] else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        i, j = np.nonzero(Codes(unit).possible(a, b, threshold))
        i, j = a[i], b[j]
        if side[0] == side[-1]:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return i, j
        # a pair counts in the first band that both share
        values = band_values(unit, bits, bands)
        band = int(own["band"].iloc[0])
        keep = np.ones(len(i), bool)
        for k in range(band):
            keep &= values[i, k] != values[j, k]
        i, j = i[keep], j[keep]
        near = np.empty(len(i), bool)
        for begin in range(0, len(i), 1 << 16):
            part = slice(begin, begin + (1 << 16))
            near[part] = (unit[i[part]] * unit[j[part]]).sum(1) >= threshold
        return i[near], j[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in sorted_groups(batches, "task"):
            out = []
            for begin, end in runs(frame["task"].to_numpy()):
                if end - begin < 2:
                    continue
                own = frame.iloc[begin:end]
                i, j = links(own)
                if not len(i):
                    continue
                rep, copies = own["rep"].to_numpy(), own["copies"].to_numpy()
                sums = np.zeros(len(own), np.int64)
                np.add.at(sums, i, copies[j])
                np.add.at(sums, j, copies[i])
                sets = Sets(len(own))
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    sets.join(x, y)
                used = np.flatnonzero(sums)
                out.append((rep[used], sums[used], rep[[sets.root(x) for x in used.tolist()]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "links", "root"])

    return run


def near_vectors(table_: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Links and component of every vector among those of its label.

    Equal vectors of a label are one representative with a number of copies.  Bands of
    sign bits of rotated representatives bring candidates together; corrected
    estimates with their bounds rule most of them out; the rest is decided by the
    cosine in double precision.  A bucket larger than a block is compared block by
    block in as many tasks as it has pairs of blocks, so no bucket is cut short.
    Pairs never leave a task: it hands on a count and a root per vector.

    Returns id, n_links (other vectors linked directly), component (smallest id
    reachable) and kept (whether that is its own).  Rows without id or label and
    vectors that are NULL, empty, zero or hold NULL or non-finite components link with
    nothing, nor do vectors of different sizes.  Rows that repeat id, label and vector
    count once.  Bands share at least ``recall`` of the pairs at the threshold and
    more of those above.  An empty table gives an empty table.
    """
    own = stored(vectors(table_, id_column, vector, label), "vectors")
    reps = stored(
        own.where("key IS NOT NULL").groupBy("key", "id").agg(F.min("data").alias("data"), F.min("label").alias("label"))
        .groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("data").alias("data"), F.min("label").alias("label")),
        "representatives",
    )
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan_bands(most, threshold, recall)
    kind = dict(reps.dtypes)["rep"]
    banded = reps.select("rep", "copies", "data", "label").mapInArrow(
        _banded(bits, bands), f"bucket binary, band int, rep {kind}, copies bigint, data binary")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = banded.hint("merge").join(stored(sizes, "buckets"), "bucket").select(
        "bucket", "band", "rep", "copies", "data", blocks.alias("blocks"),
        F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = paired.select(
        F.concat(F.hex("bucket"), F.lit("|"), F.least("block", "other").cast("string"), F.lit("|"), F.greatest("block", "other").cast("string")).alias("task"),
        F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "band", "rep", "copies", "data")
    found = stored(
        tasks.repartition("task").sortWithinPartitions("task", "side").mapInArrow(
            _compared(bits, bands, threshold), f"rep {kind}, links bigint, root {kind}"),
        "links",
    )
    edges = found.where("rep <> root").select("rep", "root").distinct()
    if edges.limit(1).count():
        comps = components(edges, "rep", "root")
    else:
        comps = edges.select(F.col("rep").alias("id"), F.col("root").alias("component"))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    results = stored(
        reps.select("key", "rep", "copies").join(sums, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
            "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "vector-results",
    )
    out = own.select("id", "key").join(results.hint("merge"), "key", "left")
    component = F.coalesce("component", "id")
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


@query(
    "op10_near_vectors",
    """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = e.vec_id
""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")

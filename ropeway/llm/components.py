"""Connected components of star-like edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ropeway.llm.base import stored
from ropeway.llm.streams import Sets, sorted_groups

#: Rounds after which something must be wrong: the depth of a component halves in each.
MOST_ROUNDS = 60
#: Edges that a task contracts at once.
HELD = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the components that the edges of this task make by themselves, HELD edges at a time."""
    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch)
            held += batch.num_rows
        if held >= HELD:
            yield _stars(parts)
            parts, held = [], 0
    if parts:
        yield _stars(parts)


def _stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Each node under the smallest of its component."""
    ends = [np.concatenate([b[n].to_numpy(zero_copy_only=False) for b in parts]) for n in ("a", "b")]
    ids, place = np.unique(np.concatenate(ends), return_inverse=True)
    sets = Sets(len(ids))
    for i, j in zip(*(x.tolist() for x in np.split(place, 2)), strict=True):
        sets.join(i, j)
    # ids are in order, so the root of a set is its smallest
    root = np.fromiter(map(sets.root, range(len(ids))), np.int64, len(ids))
    away = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[root[away]])], names=["a", "b"])


def _small_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the smallest lower neighbour of each node; rows sorted by node and neighbour.

    A lower neighbour may be hung on several nodes here; the next round sees to that.
    """
    for frame in sorted_groups(batches, "a"):
        a, b = frame["a"].to_numpy(), frame["b"].to_numpy()
        first = np.concatenate([[True], a[1:] != a[:-1]])
        least = b[np.flatnonzero(first)][np.cumsum(first) - 1]
        # the node itself and all its other lower neighbours hang on the smallest
        node = np.where(first, a, b)
        keep = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], names=["a", "b"])


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _contracted(_small_star(batches))


def components(edges: DataFrame, node: str, other: str) -> DataFrame:
    """(id, component) of every end of the edges, the component being its smallest id.

    A round joins every larger neighbour of a node to the node's smallest neighbour,
    and then all smaller neighbours of a node to the smallest of them, until the edges
    are one star per component.  Minima are found by partial aggregation and a hub's
    edges meet its minimum in a join whose hot keys are split, so no task gathers a
    component.
    """
    ends = edges.select(F.least(node, other).alias("b"), F.greatest(node, other).alias("a")).where("a <> b").select("a", "b")
    kind = dict(ends.dtypes)["a"]
    now = stored(ends.mapInArrow(_contracted, f"a {kind}, b {kind}"), "edges")
    for _ in range(MOST_ROUNDS):
        # the smallest neighbour of a node is the smallest of its lower ones, or itself
        lower = stored(now.groupBy("a").agg(F.min("b").alias("m")), "minima").withColumnRenamed("a", "u")
        hung = now.hint("merge").join(lower, now["b"] == lower["u"], "left").select("a", F.coalesce("m", "b").alias("b"))
        down = hung.unionByName(lower.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stored(down.repartition("a").sortWithinPartitions("a", "b").mapInArrow(_hung, f"a {kind}, b {kind}"), "edges")
        # a row for each end: settled when every node has one root, and roots have themselves
        ends = now.unionByName(now.select(F.col("b").alias("a"), "b"))
        roots = stored(ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"), F.max("b").alias("_last")), "roots")
        if not roots.where("component <> _last").limit(1).count():
            return roots.select("id", "component")
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")

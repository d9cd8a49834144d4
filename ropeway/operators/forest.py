"""Random forest grown level by level: histograms in tasks, one shuffle and one best split per open node."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ropeway.session import durable

# Bins of a feature, rows a task counts at once, nodes whose counts travel together, nodes judged at
# once, bytes a task gathers before it sends them or a reducer takes at once.
BINS, TASK_ROWS, NODE_CHUNK, NODE_SLICE, GATHER = 32, 500_000, 256, 32, 16 << 20
LEAF = 255
#: Poisson(1) draws by 16 random bits.
_DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def bin_cuts(rows: DataFrame, width: int) -> list[list[float]]:
    """Upper ends of the bins of every feature: all its values if they are few, else quantiles over all rows."""
    x = [F.col("_a")[i] for i in range(width)]
    ranks = [i / BINS for i in range(1, BINS)]
    near = rows.agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(x)],
                    *[F.percentile_approx(c, ranks, 10_000).alias(f"q{i}") for i, c in enumerate(x)]).first()
    few = [i for i in range(width) if near[f"n{i}"] <= 2 * BINS]
    values = rows.agg(*[F.collect_set(x[i]).alias(f"v{i}") for i in few]).first() if few else {}
    cuts = []
    for i in range(width):
        known = sorted({v + 0.0 for v in values[f"v{i}"] if not math.isnan(v)}) if i in few else []
        if i not in few or len(known) > BINS:
            known = sorted({v + 0.0 for v in near[f"q{i}"] if not math.isnan(v)})
        elif not any(math.isnan(v) for v in values[f"v{i}"]):
            known = known[:-1]
        cuts.append(known[:BINS - 1])
    return cuts


def _binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _subsets(seed: int, tree: int, level: int, width: int, take: int, places: np.ndarray) -> np.ndarray:
    """The features each of these nodes of a level may split on."""
    draws = np.random.Generator(np.random.Philox(key=[seed, (1 << 40) + tree * 64 + level])).random((1 << level, width), dtype=np.float32)
    return np.argsort(draws[places], axis=1)[:, :take].astype(np.uint8)


def _counts(seed: int, tree: int, part: int, n: int) -> np.ndarray:
    """How often a tree draws each row of a partition; equal in every pass over it."""
    bits = np.random.Generator(np.random.Philox(key=[seed, (tree << 32) + part])).bytes(2 * n)
    return _DRAWS[np.frombuffer(bits, np.uint16)]


def _below(flat: np.ndarray, base: np.ndarray, asks: np.ndarray, cut: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next nodes of rows at these nodes."""
    right = flat.take(base + asks.take(at)) > cut.take(at)
    at += at
    at += 1
    at += right
    return at


def _descend(flat: np.ndarray, base: np.ndarray, feat: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """Nodes the rows reach after ``steps`` splits; rows of a leaf go on below it, where no node is open."""
    at = np.zeros(len(base), np.intp)
    asks = np.where(feat == LEAF, 0, feat).astype(np.intp)
    for _ in range(steps):
        at = _below(flat, base, asks, cut, at)
    return at


def _best(counts: np.ndarray, weights: tuple[float, float], min_leaf: int) -> tuple[np.ndarray, ...]:
    """Gini gain, subset place, bin and class counts on both sides of each node's best split."""
    left = counts.cumsum(axis=2)[:, :, :-1]
    total = counts[:, :1].sum(axis=2)[:, :, None]
    right = total - left

    def spread(c):
        a, b = c[..., 0] * weights[0], c[..., 1] * weights[1]
        return 2.0 * a * b / np.maximum(a + b, 1e-300)

    whole = spread(total)
    gain = whole - spread(left) - spread(right)
    allowed = (left.sum(axis=-1) >= min_leaf) & (right.sum(axis=-1) >= min_leaf)
    # sums of many weights leave a rest of rounding where nothing is gained
    gain = np.where(allowed & (gain > 1e-12 * np.maximum(whole, 1e-300)), gain, 0.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    row, (place, cut) = np.arange(len(counts)), np.divmod(best, BINS - 1)
    return gain[row, best], place, cut, left[row, place, cut], right[row, place, cut]


class Forest(Transformer):
    """Trees as arrays over heap-numbered nodes: feature (255: leaf), bin, class counts, gain."""

    def __init__(self, feat, cut, counts, gain, cuts, weights):
        super().__init__()
        self.feat, self.cut, self.counts, self.gain, self.cuts, self.weights = feat, cut, counts, gain, cuts, weights
        self.column = "_x"

    def setFeaturesCol(self, column: str) -> Forest:  # noqa: N802
        self.column = column
        return self

    def part(self, some: slice) -> Forest:
        return Forest(self.feat[some], self.cut[some], self.counts[some], self.gain[some], self.cuts, self.weights)

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.feat)

    @property
    def trees(self) -> list[Forest]:
        return [self.part(slice(i, i + 1)) for i in range(len(self.feat))]

    @property
    def toDebugString(self) -> str:  # noqa: N802
        lines = []

        def walk(tree: int, node: int, depth: int) -> None:
            f = self.feat[tree, node]
            n0, n1 = self.counts[tree, node]
            if f == LEAF:
                lines.append(f"{' ' * depth}{n0:.0f}:{n1:.0f}")
                return
            lines.append(f"{' ' * depth}feature {f} <= {self.cuts[f][self.cut[tree, node]]!r}")
            walk(tree, 2 * node + 1, depth + 1)
            walk(tree, 2 * node + 2, depth + 1)

        for t in range(len(self.feat)):
            walk(t, 0, 0)
        return "\n".join(lines)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Weighted impurity decrease per feature, every tree scaled to one."""
        out = np.zeros(len(self.cuts))
        for feat, gain in zip(self.feat, self.gain, strict=True):
            one = np.bincount(feat[feat != LEAF], gain[feat != LEAF], len(self.cuts))
            out += one / (one.sum() or 1.0)
        return DenseVector(out / (out.sum() or 1.0))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # else a filter on the score would run the trees a second time
        p = votes(dataset.sparkSession, [self])(vector_to_array(self.column))[0]
        return dataset.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")

    @property
    def depth(self) -> int:
        return (self.feat.shape[1] + 1).bit_length() - 2

    def begins(self, other: Forest) -> bool:
        """Whether these are the upper levels of the first trees of another forest."""
        trees, inner, size = len(self.feat), 2 ** self.depth - 1, self.feat.shape[1]
        return (trees <= len(other.feat) and size <= other.feat.shape[1] and self.cuts == other.cuts and self.weights == other.weights
                and np.array_equal(self.feat[:, :inner], other.feat[:trees, :inner])
                and np.array_equal(self.cut[:, :inner], other.cut[:trees, :inner])
                and np.array_equal(self.counts, other.counts[:trees, :size]))

    def shares(self) -> np.ndarray:
        """Share of the positive class per node; nodes below a leaf have the leaf's."""
        weighted = self.counts * np.array(self.weights)
        out = weighted[..., 1] / np.maximum(weighted.sum(axis=-1), 1e-300)
        for level in range(self.depth):
            first, n = 2 ** level - 1, 2 ** level
            leaf = np.repeat(self.feat[:, first:first + n] == LEAF, 2, axis=1)
            below = slice(first + n, first + 3 * n)
            out[:, below] = np.where(leaf, np.repeat(out[:, first:first + n], 2, axis=1), out[:, below])
        return out


def votes(spark: SparkSession, forests: Sequence[Forest]):
    """Function of a feature array: the positive probability by each forest.

    Rows go down each tree once: a forest that begins another one reads its nodes on the way.
    """
    if any(f.cuts != forests[0].cuts for f in forests):
        raise ValueError("forests that score together need the same bins")
    whole: list[int] = []
    for i in sorted(range(len(forests)), key=lambda i: (-forests[i].depth, -len(forests[i].feat))):
        if not any(forests[i].begins(forests[w]) for w in whole):
            whole.append(i)
    runs = []
    for w in whole:
        readers = [(i, f.depth, len(f.feat)) for i, f in enumerate(forests) if next(k for k in whole if f.begins(forests[k])) == w]
        f = forests[w]
        runs.append((np.where(f.feat == LEAF, 0, f.feat), f.cut, f.shares(), readers))
    held, many = spark.sparkContext.broadcast((runs, forests[0].cuts)), len(forests)

    @F.pandas_udf("array<double>")
    def positive(x: pd.Series) -> pd.Series:
        runs, cuts = held.value
        bins = _binned(np.stack(x.to_numpy()), cuts) if len(x) else np.zeros((0, len(cuts)), np.uint8)
        flat, base = bins.ravel(), np.arange(len(x)) * len(cuts)
        out = np.zeros((many, len(x)))
        for feat, cut, share, readers in runs:
            for tree, (f, c, s) in enumerate(zip(feat, cut, share, strict=True)):
                at, f = np.zeros(len(x), np.intp), f.astype(np.intp)
                reading = [(d, i) for i, d, trees in readers if tree < trees]
                for level in range(max(d for d, _ in reading) + 1):
                    if level:
                        at = _below(flat, base, f, c, at)
                    here = [i for d, i in reading if d == level]
                    if here:
                        out[here] += s.take(at)
            for i, _, trees in readers:
                out[i] /= trees
        return pd.Series(list(out.T))

    return positive.asNondeterministic()


class Grove:
    """Forests of several leaf sizes on balanced classes, grown together over the same rows.

    Each tree draws rows by Poisson(1) and each node the square root of the features.  The rows
    stay in their partitions as bins of one byte; a level is one pass that counts (node, feature, bin,
    class) per partition, and the sums of a node meet in one reducer that picks its split.  The
    draws depend on the tree and the node alone, so a smaller depth is the upper part of a larger one, and a
    node that is reached by equal splits in two leaf sizes is counted once for both.  The driver
    holds the trees, whose size does not grow with the rows.
    """

    def __init__(self, rows: DataFrame, features: str, label: str, leaves: Sequence[int], seed: int = 42):
        spark = rows.sparkSession
        rows = rows.select(vector_to_array(features).alias("_a"), F.col(label).cast("double").alias("_y"))
        n, known, ones = rows.agg(F.count(F.lit(1)), F.count("_y"), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
        if not n or known < n:
            raise ValueError("a forest needs rows, each with a label")
        self.weights = n / (2.0 * max(n - ones, 1)), n / (2.0 * max(ones, 1))
        width = len(rows.select("_a").first()[0])
        cuts = bin_cuts(rows, width)

        def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"x": [_binned(np.stack(b["_a"].to_numpy()), cuts).tobytes()],
                                        "y": [(b["_y"].to_numpy() == 1).astype(np.uint8).tobytes()]})

        self.parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))
        self.blocks = durable(rows.mapInPandas(to_bins, "x binary, y binary").repartition(self.parts))
        self.cuts, self.leaves, self.seed = cuts, tuple(leaves), seed
        self._start(0)

    def _start(self, trees: int) -> None:
        """Trees that are one leaf each; per leaf size: feature, bin, class counts, gain, open nodes, nodes reached as in the first."""
        each = range(len(self.leaves))
        self.trees, self.level = trees, 0
        self.feat = [np.full((trees, 1), LEAF, np.uint8) for _ in each]
        self.cut = [np.zeros((trees, 1), np.uint8) for _ in each]
        self.counts = [np.zeros((trees, 1, 2), np.float32) for _ in each]
        self.gain = [np.zeros((trees, 1), np.float32) for _ in each]
        self.opened = [[np.zeros(1, np.int32)] * trees for _ in each]
        self.same = [np.ones((trees, 1), bool) for _ in each]

    def forest(self, trees: int, depth: int, min_leaf: int) -> Forest:
        if trees > self.trees:
            self._start(trees)
        while self.level < depth:
            self._deepen()
        v, size, last = self.leaves.index(min_leaf), 2 ** (depth + 1) - 1, 2 ** depth - 1
        feat, cut, gain = (a[v][:trees, :size].copy() for a in (self.feat, self.cut, self.gain))
        feat[:, last:], cut[:, last:], gain[:, last:] = LEAF, 0, 0
        return Forest(feat, cut, self.counts[v][:trees, :size].copy(), gain, self.cuts, self.weights)

    def _deepen(self) -> None:
        """Split the open nodes of the last level."""
        level, first, wide = self.level, 2 ** self.level - 1, 2 << self.level
        seed, weights, leaves, trees = self.seed, self.weights, self.leaves, self.trees
        width, take = len(self.cuts), math.ceil(math.sqrt(len(self.cuts)))
        each = range(len(leaves))
        # a leaf size after the first counts only nodes that the first has not reached by the same splits
        own = [[o[~s[o - first]] if v else o for o, s in zip(self.opened[v], self.same[v], strict=True)] for v in each]
        nodes = np.array([[len(own[v][t]) for v in each] for t in range(trees)]).reshape(trees, len(leaves))
        before = (nodes.cumsum() - nodes.ravel()).reshape(nodes.shape)
        spark = self.blocks.sparkSession
        found_bytes = 2 * take * BINS * 2 * self.parts
        bundle = max(1, min(math.ceil(nodes.sum() / (4 * spark.sparkContext.defaultParallelism)), GATHER // found_bytes))
        held = spark.sparkContext.broadcast((self.feat, self.cut, own, self.same, before))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            feat, cut, own, same, before = held.value
            blobs = [(x, y) for b in batches for x, y in zip(b["x"], b["y"], strict=True)]
            if not blobs:
                return
            flat, y = (np.frombuffer(b"".join(p), np.uint8) for p in zip(*blobs, strict=True))
            part, n, doubled = TaskContext.get().partitionId(), len(y), flat * np.uint8(2)
            gathered, size = [], 0
            for tree in range(trees):
                if not any(len(own[v][tree]) for v in each):
                    continue
                drawn = _counts(seed, tree, part, n)
                rows = np.flatnonzero(drawn)
                reached = _descend(flat, rows * width, feat[0][tree], cut[0][tree], level)
                for v in each:
                    nodes, row, at = own[v][tree], rows, reached
                    if not len(nodes):
                        continue
                    if v:
                        row = rows[~same[v][tree].take(reached - first)]
                        at = _descend(flat, row * width, feat[v][tree], cut[v][tree], level)
                    slot = np.full(1 << level, -1, np.intp)
                    slot[nodes - first] = np.arange(len(nodes))
                    place = slot.take(at - first)
                    if (place < 0).any():
                        row, place = row[place >= 0], place[place >= 0]
                    weight, base, key = drawn.take(row).astype(np.float64), row * width, place * (BINS * 2) + y.take(row)
                    subset = _subsets(seed, tree, level, width, take, nodes - first).T.astype(np.intp)
                    found = np.empty((take, len(nodes), BINS * 2), np.uint32)
                    for j in range(take):
                        bins = doubled.take(base + subset[j].take(place))
                        found[j] = np.bincount(key + bins, weight, len(nodes) * BINS * 2).reshape(len(nodes), -1)
                    if found.max(initial=0) < 1 << 16:
                        found = found.astype(np.uint16)
                    for s in range(0, len(nodes), NODE_CHUNK):
                        gathered.append(((before[tree, v] + s) // bundle, tree, v, s, found.dtype == np.uint32,
                                         np.ascontiguousarray(found[:, s:s + NODE_CHUNK]).tobytes()))
                    size += found.nbytes
                    if size > GATHER:
                        yield pd.DataFrame(gathered, columns=["bundle", "tree", "leaf", "chunk", "wide", "found"])
                        gathered, size = [], 0
            if gathered:
                yield pd.DataFrame(gathered, columns=["bundle", "tree", "leaf", "chunk", "wide", "found"])

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            _, _, own, same, _ = held.value
            out = []
            for (tree, v, start), rows in pdf.groupby(["tree", "leaf", "chunk"]).indices.items():
                tree, total = int(tree), 0
                for i in rows:
                    total = total + np.frombuffer(pdf["found"].iat[i], np.uint32 if pdf["wide"].iat[i] else np.uint16).astype(np.int64)
                total = total.reshape(take, -1, BINS, 2).swapaxes(0, 1)
                places = own[v][tree][start:start + NODE_CHUNK] - first
                subset = _subsets(seed, tree, level, width, take, places)
                for u in each if v == 0 else [v]:
                    if u != v and not same[u][tree][places].any():
                        continue
                    got = [_best(total[s:s + NODE_SLICE], weights, leaves[u]) for s in range(0, len(total), NODE_SLICE)]
                    gain, place, at_bin, low, high = (np.concatenate(g) for g in zip(*got, strict=True))
                    out.append((tree, v, start, u, gain.astype(np.float32).tobytes(), subset[np.arange(len(place)), place].tobytes(),
                                at_bin.astype(np.uint8).tobytes(), low.astype(np.float32).tobytes(), high.astype(np.float32).tobytes()))
            return pd.DataFrame(out, columns=["tree", "leaf", "chunk", "to", "gain", "feat", "cut", "low", "high"])

        best = []
        if nodes.any():
            sums = self.blocks.mapInPandas(count, "bundle long, tree int, leaf int, chunk int, wide boolean, found binary")
            best = sums.groupBy("bundle").applyInPandas(
                split, "tree int, leaf int, chunk int, to int, gain binary, feat binary, cut binary, low binary, high binary").collect()
        for v in each:
            for a, leaf in ((self.feat, LEAF), (self.cut, 0), (self.counts, 0), (self.gain, 0)):
                a[v] = np.concatenate([a[v], np.full((trees, wide, *a[v].shape[2:]), leaf, a[v].dtype)], axis=1)
        below: list[list[list[np.ndarray]]] = [[[] for _ in range(trees)] for _ in each]
        for b in best:
            t, u = b["tree"], b["to"]
            at = own[b["leaf"]][t][b["chunk"]:b["chunk"] + NODE_CHUNK]
            g, f, at_bin = (np.frombuffer(b[c], k) for c, k in (("gain", np.float32), ("feat", np.uint8), ("cut", np.uint8)))
            low, high = (np.frombuffer(b[c], np.float32).reshape(-1, 2) for c in ("low", "high"))
            if level == 0:
                self.counts[u][t, 0] = low[0] + high[0]
            good = g > 0
            if u != b["leaf"]:
                good &= self.same[u][t, at - first]
            at, low, high = at[good], low[good], high[good]
            self.feat[u][t, at], self.cut[u][t, at], self.gain[u][t, at] = f[good], at_bin[good], g[good]
            self.counts[u][t, 2 * at + 1], self.counts[u][t, 2 * at + 2] = low, high
            mixed = lambda c: (c > 0).all(axis=1)
            below[u][t] += [2 * at[mixed(low)] + 1, 2 * at[mixed(high)] + 2]
        self.opened = [[np.sort(np.concatenate(b)).astype(np.int32) if b else np.zeros(0, np.int32) for b in t] for t in below]
        here = slice(first, first + wide // 2)
        self.same = [np.repeat(s & (self.feat[v][:, here] == self.feat[0][:, here]) & (self.cut[v][:, here] == self.cut[0][:, here]), 2, axis=1)
                     for v, s in enumerate(self.same)]
        self.level += 1
        held.unpersist()

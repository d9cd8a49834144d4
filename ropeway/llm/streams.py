"""Helpers for passes over sorted groups inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups: a partition sorted by ``key``, cut only where the key changes."""
    held: pd.DataFrame | None = None
    for batch in batches:
        frame = batch.to_pandas()
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[key].to_numpy()
        # the last group may go on in the next batch
        whole = len(last) - int((last[::-1] != last[-1]).argmax()) if (last != last[-1]).any() else 0
        if whole:
            yield frame.iloc[:whole].reset_index(drop=True)
        held = frame.iloc[whole:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal neighbours."""
    if not len(values):
        return []
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return list(zip(edges[:-1], edges[1:], strict=True))


class Sets:
    """Disjoint sets of the numbers below n; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

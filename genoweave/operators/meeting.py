"""Pairs of sparse rows that share items, counted in blocks: no row for each common item of a pair is ever made.

Rows carry sorted arrays of whole numbers. Every pair of row blocks is one group; within it a row's counts against a whole block
are sums over the block's postings, so that a pair costs an addition for each common item and only pairs that pass leave the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; smaller inputs get up to LEAST blocks, so that there is work for several tasks.
BLOCK, LEAST = 32_768, 6
#: Result rows that a task holds before it hands them on.
HELD = 200_000


def blocks(rows: int, size: int = BLOCK) -> int:
    return max(-(-rows // size), min(LEAST, -(-rows // 4096)), 1)


def met(rows: DataFrame, block: Column, count: int) -> DataFrame:
    """Rows laid out over groups (bu, bv), bu >= bv: as the higher block a row meets itself and all lower ones, as the lower all higher ones."""
    last = F.lit(count - 1)
    own = rows.withColumn("b", block.cast("int"))
    at = F.concat(F.transform(F.sequence(F.lit(0), F.col("b")), lambda x: F.struct(F.col("b").alias("bu"), x.alias("bv"))), F.transform(F.slice(F.sequence(F.col("b"), last), F.lit(2), last + 1), lambda x: F.struct(x.alias("bu"), F.col("b").alias("bv"))))
    return own.select("*", F.inline(at))


def halves(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, bool]:
    """The two blocks of a group, each by key, and if they are one."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    t = t.take(pc.sort_indices(t["k"])).combine_chunks()
    bu, bv = t["bu"][0].as_py(), t["bv"][0].as_py()
    if bu == bv:
        return t, t, True
    b = t["b"].to_numpy()
    return t.filter(pa.array(b == bu)).combine_chunks(), t.filter(pa.array(b == bv)).combine_chunks(), False


def lists(t: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of arrays, and where each row's begin."""
    if not t.num_rows:
        return np.zeros(0, np.intp), np.zeros(1, np.intp)
    a = t[column].combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
    starts = a.offsets.to_numpy().astype(np.intp)
    return a.values.to_numpy(zero_copy_only=False).astype(np.intp)[starts[0] : starts[-1]], starts - starts[0]


class Postings:
    """For each item, the rows that have it."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, items: int):
        self.rows = len(starts) - 1
        order = np.argsort(values, kind="stable")
        self.owner = np.repeat(np.arange(self.rows), np.diff(starts))[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=items))]).astype(np.intp)

    def counts(self, items: np.ndarray) -> np.ndarray | None:
        """Of each row, how many of these items it has; None if none has any."""
        at = [self.owner[x:y] for x, y in zip(self.begin[items].tolist(), self.begin[items + 1].tolist(), strict=True) if y > x]
        return np.bincount(np.concatenate(at), minlength=self.rows) if at else None

    def window(self, items: np.ndarray) -> tuple[int, int]:
        """From the first to behind the last row that has any of these items; equal if there is none."""
        x, y = self.begin[items], self.begin[items + 1]
        x, y = x[y > x], y[y > x]
        return (int(self.owner[x].min()), int(self.owner[y - 1].max()) + 1) if len(x) else (0, 0)

    def counts_in(self, items: np.ndarray, low: int, high: int) -> np.ndarray:
        """As counts, of the rows from low to before high."""
        at = [self.owner[x:y] for x, y in zip(self.begin[items].tolist(), self.begin[items + 1].tolist(), strict=True) if y > x]
        if not at:
            return np.zeros(high - low, np.intp)
        rows = np.concatenate(at)
        if rows.min() < low or rows.max() >= high:
            rows = rows[(rows >= low) & (rows < high)]
        return np.bincount(rows - low, minlength=high - low)


def handed(parts: Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]], batch: Callable[[np.ndarray, np.ndarray, dict], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of HELD rows or so, from a row, its partners and their values at a time."""
    own, far, more, n = [], [], [], 0
    for a, hits, values in parts:
        for i in range(0, len(hits), HELD):
            cut = hits[i : i + HELD]
            own.append(np.full(len(cut), a))
            far.append(cut)
            more.append({k: v[i : i + HELD] for k, v in values.items()})
            n += len(cut)
            if n >= HELD:
                yield batch(np.concatenate(own), np.concatenate(far), {k: np.concatenate([m[k] for m in more]) for k in more[0]})
                own, far, more, n = [], [], [], 0
    if n:
        yield batch(np.concatenate(own), np.concatenate(far), {k: np.concatenate([m[k] for m in more]) for k in more[0]})

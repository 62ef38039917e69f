"""Statistics of all pairs of sets (A without B against B without A) from one pass over the edges.

Each edge carries the sets of its two variants, so a pair's counts are sums over edges of products of set marks: an edge is never
copied for each pair, and no pair's lists of variants are laid out. What a task holds and hands on is a number for each pair of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..store import written

#: Marks (variants x sets) that a task works through at once.
CELLS = 4_000_000
#: Edges of a range of scores: at least, while there are fewer ranges than shuffle partitions, and beyond that.
RANGE, WIDE = 20_000, 2_000_000


def variant_sets(wpm: DataFrame) -> DataFrame:
    """variant_idx, sets: the pathways of each variant that has any."""
    member = wpm.select("pathway_id", F.explode("ind").alias("variant_idx"))
    return written(member.groupBy("variant_idx").agg(F.sort_array(F.collect_set("pathway_id")).alias("sets")), "variant-sets")


def set_ids(sets: DataFrame) -> np.ndarray:
    """All pathway ids in ascending order: one number for each."""
    ids = sets.select(F.explode("sets").alias("p")).distinct().toArrow().column("p").to_numpy()
    return np.sort(ids.astype("int64"))


def edge_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """score, a, b: the sets of both variants of each edge (null: none), of edges that have any."""
    rows = edges.join(sets.select(F.col("variant_idx").alias("u"), F.col("sets").alias("a")), "u", "left")
    rows = rows.join(sets.select(F.col("variant_idx").alias("v"), F.col("sets").alias("b")), "v", "left")
    return rows.select("score", "a", "b").filter("a is not null or b is not null")


def _marks(column, ids: np.ndarray) -> np.ndarray:
    """Rows x sets: whether the row has the set."""
    sizes = column.value_lengths().fill_null(0).to_numpy()
    out = np.zeros((len(column), len(ids)), bool)
    out[np.repeat(np.arange(len(column)), sizes), np.searchsorted(ids, column.flatten().to_numpy())] = True
    return out


def _parts(batches, ids: np.ndarray):
    step = max(256, CELLS // max(1, len(ids)))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def _pair_sums(rows: DataFrame, ids: np.ndarray, names: list[str], work) -> DataFrame:
    """path1 < path2 and the sums over all rows of the matrices (sets x sets) that work(batch) gives; pairs with zeros only are left out."""

    def run(batches):
        total = [np.zeros((len(ids), len(ids)), "int64") for _ in names]
        for part in _parts(batches, ids):
            for t, x in zip(total, work(part), strict=True):
                t += x
        i, j = np.nonzero(np.triu(sum(x != 0 for x in total), 1))
        for lo in range(0, len(i), 10_000):
            a, b = i[lo : lo + 10_000], j[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[a], ids[b], *(t[a, b] for t in total))], ["path1", "path2", *names])

    found = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("path1", "path2", *names)))
    return found.groupBy("path1", "path2").agg(*[F.sum(c).alias(c) for c in names])


def _without(marks: np.ndarray) -> np.ndarray:
    """[A, B]: rows in A and not in B. Counts of a batch are exact as 32-bit floats."""
    x = marks.astype("float32")
    return (x.T @ (1 - x)).astype("int64")


def pair_sizes(sets: DataFrame, ids: np.ndarray, min_path: int = 5) -> DataFrame:
    """path1 < path2, ind1size, ind2size, size: of each side without the shared variants, where both have min_path or more. As bpm_sets, without the lists."""

    def work(batch):
        one = _without(_marks(batch.column("sets"), ids))
        return one, one.T

    rows = _pair_sums(sets.select("sets"), ids, ["ind1size", "ind2size"], work)
    return rows.withColumn("size", F.col("ind1size") * F.col("ind2size")).filter((F.col("ind1size") >= min_path) & (F.col("ind2size") >= min_path))


def pair_edges(marked: DataFrame, ids: np.ndarray) -> DataFrame:
    """path1 < path2, gi (edges between both sides, each orientation for itself), all1, all2 (ends of edges in each side)."""

    def work(batch):
        u, v = _marks(batch.column("a"), ids), _marks(batch.column("b"), ids)
        between = ((u & ~v).T.astype("float32") @ (v & ~u).astype("float32")).astype("int64")
        ends = _without(u) + _without(v)
        return between + between.T, ends, ends.T

    return _pair_sums(marked.select("a", "b"), ids, ["gi", "all1", "all2"], work)


class _Ranks:
    """Counts, rank sums and tie terms of all wanted pairs, over edges in ascending order of their scores. Memory: sets x sets."""

    def __init__(self, wanted: np.ndarray):
        n = len(wanted)
        self.cols = [np.flatnonzero(w) for w in wanted]
        # Of the level that is not known to be over: its values in each block, and those inside.
        self.open, self.open_in = np.zeros((n, n), "int64"), np.zeros((n, n), "int64")
        self.below, self.ranked2, self.stored, self.sums = (np.zeros((n, n), "int64") for _ in range(4))
        self.ties = np.zeros((n, n))
        self.first = self.last = None

    def _settle(self, a: int, c: np.ndarray, t: np.ndarray, inside: np.ndarray) -> None:
        """Levels in ascending order: t of a block's values have each, `inside` of them lie inside. Doubled midranks are whole."""
        before = self.below[a, c] + np.cumsum(t, axis=0) - t
        self.ranked2[a, c] += (inside * (2 * before + t + 1)).sum(axis=0)
        x = t.astype("float64")
        self.ties[a, c] += (x * x * x - x).sum(axis=0)
        self.below[a, c] += t.sum(axis=0)

    def close(self) -> None:
        for a, c in enumerate(self.cols):
            self._settle(a, c, self.open[a, c][None], self.open_in[a, c][None])
        self.open[:], self.open_in[:] = 0, 0

    def add(self, score: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        if self.first is None:
            self.first = int(score[0])
        elif score[0] != self.last:
            self.close()
        self.last = score[-1]
        score = np.repeat(score, 2)  # both orientations
        level = np.concatenate([[0], np.cumsum(score[1:] != score[:-1])])
        rows, cols = (np.stack(x, axis=1).reshape(len(score), -1) for x in ((u, v), (v, u)))
        for a, c in enumerate(self.cols):
            at = np.flatnonzero(rows[:, a])
            # The open level goes on as level 0 (without values, if it is over).
            levels, t, inside = np.zeros(1, "int64"), self.open[a, c][None], self.open_in[a, c][None]
            if len(at) and len(c):
                in_row = ~rows[np.ix_(at, c)]
                in_block = in_row & cols[np.ix_(at, c)] & ~cols[at, a][:, None]
                starts = np.flatnonzero(np.diff(level[at], prepend=-1))
                own, own_t, own_in = level[at][starts], *(np.add.reduceat(x, starts, axis=0, dtype="int64") for x in (in_row, in_block))
                self.stored[a, c] += own_in.sum(axis=0)
                self.sums[a, c] += (own_in * score[at][starts][:, None]).sum(axis=0)
                if own[0] == 0:
                    own_t[0] += t[0]
                    own_in[0] += inside[0]
                    levels, t, inside = own, own_t, own_in
                else:
                    levels, t, inside = np.append(levels, own), np.concatenate([t, own_t]), np.concatenate([inside, own_in])
            over = len(levels) - int(levels[-1] == level[-1])
            self._settle(a, c, t[:over], inside[:over])
            self.open[a, c], self.open_in[a, c] = (t[-1], inside[-1]) if over < len(levels) else (0, 0)


def pair_ranks(marked: DataFrame, ids: np.ndarray, sides: DataFrame) -> DataFrame:
    """rows, cols (pathways) of each of `sides`: block_sum, ranked, stored_in, ties and the number of stored values of the row side's block.

    marked: as edge_sets, scores whole. Midranks are among the block's stored values only (ranked: their sum over values between both sides);
    whoever adds the unstored zeros adds their number to each. Edges are dealt out by ranges of scores, so a level lies in one task and
    a task reads its edges as a stream; the values in lower ranges are added afterwards.
    """
    known = sides.select("rows", "cols").toArrow()
    wanted = np.zeros((len(ids), len(ids)), bool)
    wanted[np.searchsorted(ids, known.column("rows").to_numpy()), np.searchsorted(ids, known.column("cols").to_numpy())] = True

    def run(batches):
        ranks = _Ranks(wanted)
        for part in _parts(batches, ids):
            ranks.add(part.column("score").to_numpy(), _marks(part.column("a"), ids), _marks(part.column("b"), ids))
        if ranks.first is None:
            return
        ranks.close()
        i, j = np.nonzero(wanted & (ranks.below > 0))
        for lo in range(0, len(i), 10_000):
            a, b = i[lo : lo + 10_000], j[lo : lo + 10_000]
            found = [ids[a], ids[b], np.full(len(a), ranks.first), *(x[a, b] for x in (ranks.below, ranks.ranked2, ranks.stored, ranks.sums, ranks.ties))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["rows", "cols", "first", "n", "ranked2", "stored_in", "block_sum", "ties"])

    edges, most = marked.count(), int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(-(-edges // RANGE), most), -(-edges // WIDE))
    dealt = marked.select("score", "a", "b").repartitionByRange(ranges, "score").sortWithinPartitions("score")
    parts = dealt.mapInArrow(run, "rows long, cols long, first long, n long, ranked2 long, stored_in long, block_sum long, ties double")
    lower = F.sum("n").over(W.partitionBy("rows", "cols").orderBy("first").rowsBetween(W.unboundedPreceding, -1))  # a row for each range
    parts = written(parts, "score-ranges").withColumn("lower", F.coalesce(lower, F.lit(0)))
    ranked2 = F.sum(F.col("ranked2") + 2 * F.col("stored_in") * F.col("lower"))
    return parts.groupBy("rows", "cols").agg((ranked2 / 2.0).alias("ranked"), *[F.sum(c).alias(c) for c in ("n", "stored_in", "block_sum", "ties")])

"""Gene and pathway sets: filters, similarity, redundancy, interval joins, module index sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..store import drop, written
from . import meeting as M


def size_filter(sets: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """Sets by number of members, repeats counted."""
    n = sets.groupBy(key).agg(F.count("*").alias("n"))
    return n.filter(F.col("n").between(least, most))


#: Items of a group's two blocks that are kept as bits, the most frequent ones.
BITS = 128


def _sets(sets: DataFrame, key: str, item: str) -> DataFrame:
    """k, n (distinct items), items: numbers of those that occur in two sets or more, ascending. A stored table."""
    rows = written(sets.select(F.col(key).alias("k"), F.col(item).alias("i")), "set-rows")
    known = rows.groupBy("i").agg(F.count("*").alias("f")).filter("f > 1").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(64)))
    known = known.select("i", (F.row_number().over(W.partitionBy("part").orderBy("i")) * 64 + F.col("part")).cast("int").alias("number"))  # few numbers are left out
    own = rows.join(known, "i", "left").groupBy("k").agg(F.array_sort(F.collect_set("number")).alias("items"), F.count_if(F.col("number").isNull() & F.col("i").isNotNull()).alias("once"), F.max(F.col("i").isNull().cast("long")).alias("missing"))
    out = written(own.select("k", (F.size("items") + F.col("once") + F.col("missing")).alias("n"), "items"), "sets")  # an item without a number is one row
    drop(rows)
    return out


def _pairs_in_blocks(sets: DataFrame, jaccard: float | None, overlap: float | None) -> DataFrame:
    """a < b, na, nb, inter of sets that may reach a cut-off, and of all that do; without any, of all with a common item."""
    sets = sets.filter("k is not null")
    m = M.blocks(sets.count())
    kind = sets.schema["k"].dataType.simpleString()
    sent = M.met(sets, F.pmod(F.xxhash64("k"), F.lit(m)), m)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, same = M.halves(batches)
        (xv, xs), (yv, ys) = M.lists(x, "items"), M.lists(y, "items")
        nx, ny = x["n"].to_numpy(), y["n"].to_numpy()
        items = int(max(xv.max(initial=0), yv.max(initial=0))) + 1
        often = np.bincount(xv, minlength=items) * np.bincount(yv, minlength=items)
        top = np.argpartition(often, -BITS)[-BITS:] if items > BITS else np.arange(items)
        nth = np.full(items, -1)
        nth[top] = np.arange(len(top))

        def parted(values, starts):
            """The frequent items as words of bits, the other ones as they were."""
            row, bit = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), nth[values]
            words = np.zeros((BITS // 64, len(starts) - 1), "uint64")
            for t in range(len(top)):
                words[t // 64, row[bit == t]] |= np.uint64(1 << (t % 64))
            rest = bit < 0
            return words, values[rest], np.concatenate([[0], np.cumsum(np.bincount(row[rest], minlength=len(starts) - 1))]).astype(np.intp)

        xw, xv, xs = parted(xv, xs)
        yw, yv, ys = (xw, xv, xs) if same else parted(yv, ys)
        post, least = M.Postings(yv, ys, items), {}

        def need(n):
            """Common items that a set of n needs with each of the block, a little below the exact cut-offs, which are tested on the pairs."""
            bounds = [] if jaccard is None else [jaccard / (1 + jaccard) * (n + ny)]
            if overlap is not None:
                bounds.append(overlap * np.minimum(n, ny))
            return np.maximum(np.ceil(np.minimum.reduce(bounds) * (1 - 1e-9)) if bounds else 1, 1).astype(np.intp)

        def found():
            for a in range(len(nx)):
                inter = post.counts(xv[xs[a] : xs[a + 1]])
                inter = np.zeros(len(ny), np.intp) if inter is None else inter
                for own, other in zip(xw[:, a], yw, strict=True):
                    if own:
                        inter += np.bitwise_count(own & other)
                n = int(nx[a])
                if n not in least:
                    if len(least) >= 512:
                        least.clear()
                    least[n] = need(n)
                hits = np.flatnonzero(inter >= least[n])
                hits = hits[hits > a] if same else hits
                if len(hits):
                    yield a, hits, {"inter": inter[hits]}

        def batch(a, b, more):
            return pa.RecordBatch.from_arrays([x["k"].combine_chunks().take(pa.array(a)), y["k"].combine_chunks().take(pa.array(b)), pa.array(nx[a]), pa.array(ny[b]), pa.array(more["inter"])], names=["a", "b", "na", "nb", "inter"])

        yield from M.handed(found(), batch)

    got = sent.groupBy("bu", "bv").applyInArrow(near, f"a {kind}, b {kind}, na long, nb long, inter long")
    turned = F.col("a") > F.col("b")
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"), "inter")


def _measured(pairs: DataFrame) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("inter")
    return pairs.select("a", "b", "na", "nb", "inter", union.alias("union_size"), (F.col("inter") / union).alias("jaccard"), (F.col("inter") / F.least("na", "nb")).alias("overlap"))


def similar_pairs(sets: DataFrame, key: str, item: str, jaccard: float | None = None) -> DataFrame:
    """a < b, inter, union_size, jaccard, overlap of sets with a common item (others are 0), or of those that reach `jaccard`. Repeats count once."""
    rows = _measured(_pairs_in_blocks(_sets(sets, key, item), jaccard, None))
    return rows if jaccard is None else rows.filter(F.col("jaccard") >= jaccard)


def greedy_distinct(sets: DataFrame, key: str, item: str, mode: str = "jaccard", jaccard_cutoff: float = 0.5, overlap_cutoff: float = 0.5, overlap_uses_jaccard_cutoff: bool = True) -> DataFrame:
    """Keys kept when sets are taken in ascending size (then key) and dropped if similar to a kept one.

    Of equal sets only the first can be kept (for cut-offs up to 1), so pairs are made of one set of each. Rounds over the similar
    pairs only: a set without undecided earlier similar sets is kept unless an earlier similar one is kept. It ends when none is
    undecided; nothing but a count reaches the driver.
    """
    limit = jaccard_cutoff if overlap_uses_jaccard_cutoff else overlap_cutoff
    wanted = {"jaccard": (jaccard_cutoff, None), "overlap": (None, limit), "either": (jaccard_cutoff, overlap_cutoff)}[mode]
    own = _sets(sets, key, item)
    if max(c for c in wanted if c is not None) <= 1:  # a set with an item of its own has no equal
        shared = F.size("items") == F.col("n")
        own = own.filter(~shared).unionByName(own.filter(shared).groupBy("n", "items").agg(F.min("k").alias("k")).select("k", "n", "items"))
        own = written(own, "unequal-sets")
    pairs = _measured(_pairs_in_blocks(own, *wanted))
    j, o = wanted
    alike = F.lit(False) if j is None else F.col("jaccard") >= j
    alike = alike if o is None else alike | (F.col("overlap") >= o)
    # earlier, later: by size, then key
    first = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    pairs = written(pairs.filter(alike).select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("e"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("l")), "similar")
    state = written(pairs.select(F.col("e").alias("k")).union(pairs.select("l")).distinct().withColumn("state", F.lit(0)), "state")  # 1 kept, -1 dropped
    while state.filter("state = 0").take(1):
        facts = pairs.join(state.toDF("e", "s"), "e").groupBy("l").agg(F.max("s").alias("best"), F.min(F.abs("s")).alias("least"))
        decided = F.when(F.col("state") != 0, F.col("state")).when(F.col("best") == 1, -1).when(F.coalesce("least", F.lit(1)) == 1, 1).otherwise(0)
        step = written(state.join(facts, F.col("k") == F.col("l"), "left").select("k", decided.alias("state")), "state")
        drop(state)
        state = step
    drop(pairs)
    return own.join(state.filter("state = -1").select("k"), "k", "left_anti").select(F.col("k").alias(key))


def expand_windows(gene: DataFrame, reach: int, twice: bool = False) -> DataFrame:
    """Gene bounds widened by reach, not below 1. twice: the published -chr file widens twice."""
    by = 2 * reach if twice else reach
    return gene.withColumn("start", F.greatest(F.col("start") - by, F.lit(1))).withColumn("end", F.col("end") + by)


def variants_in_genes(variant: DataFrame, gene: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """variant_idx, gene with start <= pos <= end on the same chromosome.

    Genes are laid out over the position bins they touch, so the join is an equi-join on (chromosome, bin) and a crowded
    chromosome is spread over its bins; the bounds are checked on the matches.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size)))
    g = gene.select("gene", F.col("chrom").alias("gc"), "start", "end", bins.alias("gb"))
    v = variant.select("variant_idx", "chrom", "pos", F.floor(F.col("pos") / bin_size).alias("vb"))
    return v.join(g, (F.col("chrom") == F.col("gc")) & (F.col("vb") == F.col("gb")) & F.col("pos").between(F.col("start"), F.col("end"))).select("variant_idx", "gene")


def variants_in_sets(variant_gene: DataFrame, gene_set: DataFrame) -> DataFrame:
    return variant_gene.join(gene_set, "gene").select("pathway_id", "variant_idx").distinct()


def wpm_sets(member: DataFrame, min_path: int = 5) -> DataFrame:
    """pathway_id, ind (ascending), indsize, size: ordered pairs within the pathway."""
    rows = member.groupBy("pathway_id").agg(F.sort_array(F.collect_set("variant_idx")).alias("ind"))  # a pathway has at most max_path variants
    n = F.size("ind").cast("long")
    return rows.select("pathway_id", "ind", n.alias("indsize"), (n * n - n).alias("size")).filter(F.col("indsize") >= min_path)


def bpm_sets(wpm: DataFrame, min_path: int = 5, blocks: int = 8) -> DataFrame:
    """path1 < path2, each side without the shared variants, and sizes. Both sides need min_path variants.

    All pairs of pathways are this table's content. They are laid out in blocks x blocks hash cells by an equi-join, so
    that a task holds two blocks of pathways and no cross join is planned.
    """
    own = F.pmod(F.xxhash64("pathway_id"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a = wpm.select(F.col("pathway_id").alias("path1"), F.col("ind").alias("a"), own.alias("i"), every.alias("j"))
    b = wpm.select(F.col("pathway_id").alias("path2"), F.col("ind").alias("b"), every.alias("i"), own.alias("j"))
    rows = a.join(b, ["i", "j"]).filter(F.col("path1") < F.col("path2"))
    rows = rows.select("path1", "path2", F.array_except("a", "b").alias("ind1"), F.array_except("b", "a").alias("ind2"))
    n1, n2 = F.size("ind1").cast("long"), F.size("ind2").cast("long")
    return rows.withColumn("ind1size", n1).withColumn("ind2size", n2).withColumn("size", n1 * n2).filter((n1 >= min_path) & (n2 >= min_path))


def row_set_ids(rows: DataFrame, array: str) -> DataFrame:
    """Equal index lists share row_set_id, numbered in the lists' order."""
    ids = rows.select(array).distinct().withColumn("row_set_id", F.row_number().over(W.orderBy(array)) - 1)
    return rows.join(ids, array)

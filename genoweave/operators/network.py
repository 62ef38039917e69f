"""Interaction networks: codings, pair counts, scores, symmetry, combination, cut-offs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats as S
from ..store import drop, release, written
from . import meeting as M

CELLS = ("11", "10", "01", "00")


def carrier_table(genotype: DataFrame, sample: DataFrame) -> DataFrame:
    """sample_id, variant_idx, dosage, pheno of all stored dosages, written once: every coding and model reads from it."""
    rows = genotype.join(sample.select("sample_id", "pheno"), "sample_id").select("sample_id", "variant_idx", "dosage", "pheno")
    return written(rows, "carriers")


def coded(carrier: DataFrame, coding: str) -> DataFrame:
    """Carriers under a coding: dominant dosage >= 1, recessive 2. The filter reaches the scan."""
    return carrier.filter(F.col("dosage") >= 1 if coding == "D" else F.col("dosage") == 2).select("sample_id", "variant_idx", "pheno")


def carriers(genotype: DataFrame, sample: DataFrame, coding: str) -> DataFrame:
    """sample_id, variant_idx, pheno of the carriers, without a table between."""
    return coded(genotype.join(sample.select("sample_id", "pheno"), "sample_id"), coding)


def totals(sample: DataFrame) -> tuple[int, int]:
    """Samples and cases: one row."""
    r = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("pheno"), F.lit(0)).cast("long").alias("x")).first()
    return r["n"], r["x"]


def marginals(carrier: DataFrame) -> DataFrame:
    """variant_idx, n carriers, x carriers that are cases."""
    return carrier.groupBy("variant_idx").agg(F.count("*").alias("n"), F.sum("pheno").cast("long").alias("x"))


def pair_counts(left: DataFrame, right: DataFrame, symmetric: bool) -> DataFrame:
    """u, v, g11, x11: samples (cases) that carry both. Pairs without a common carrier aren't made: they can't score.

    An equi-join on the sample; partial sums shrink its rows before the shuffle on (u, v).
    """
    a, b = left.select("sample_id", F.col("variant_idx").alias("u"), "pheno"), right.select("sample_id", F.col("variant_idx").alias("v"))
    pairs = a.join(b, "sample_id").filter(F.col("u") > F.col("v") if symmetric else F.col("u") != F.col("v"))
    return pairs.groupBy("u", "v").agg(F.count("*").alias("g11"), F.sum("pheno").cast("long").alias("x11"))


#: A joined row costs about as much as so many products of a matrix (measured: 4 microseconds against a few nanoseconds, and the way to Python).
PRODUCTS_A_ROW = 1000


#: Rows from which on the join's result, whose partial sums hardly shrink it, is too large to shuffle, and carriers of a block of variants.
JOINED, CARRIERS = 50_000_000, 5_000_000


def pair_counts_of(carrier: DataFrame, model: str, samples: int, variants: int) -> DataFrame:
    """pair_counts for a model, symmetric ones by whichever of join, matrix and lists of carriers is less work for the measured carriers.

    The join makes about rows^2 / samples / 2 rows, the matrix samples * variants^2 / 2 products; lists go to each of their blocks.
    """
    if model[0] != model[1]:
        return pair_counts(coded(carrier, model[0]), coded(carrier, model[1]), False)
    own = coded(carrier, model[0])
    rows = float(own.count())
    joined = rows * rows / max(1, samples) / 2
    if 2 * joined * PRODUCTS_A_ROW > float(samples) * variants * variants:
        return pair_counts_blocked(own, variants)
    blocks = max(M.blocks(variants), math.ceil(rows / CARRIERS))
    return pair_counts_listed(own, blocks) if joined > JOINED and rows * blocks < joined else pair_counts(own, own, True)


def pair_counts_listed(carrier: DataFrame, blocks: int, cells: int = 2_000_000) -> DataFrame:
    """As pair_counts (symmetric), from each variant's list of carriers: for many samples that carry few of the variants.

    Every pair of variant blocks is one group, so a pair's counts are whole where they are made, and only they leave the group. A common
    carrier costs an addition. Variants near each other by id share a block.
    """
    case = F.col("pheno").eqNullSafe(F.lit(1))
    of = lambda which: F.collect_list(F.when(which, F.col("sample_id").cast("long")))
    kind = carrier.schema["variant_idx"].dataType
    lists = carrier.groupBy(F.col("variant_idx").cast("long").alias("k")).agg(of(case).alias("cases"), of(~case).alias("controls"))
    lists = written(lists, "carrier-lists")
    release(carrier.sparkSession)
    cuts = lists.approxQuantile("k", [i / blocks for i in range(1, blocks)], 0.01) if blocks > 1 else []
    block = reduce(lambda x, y: x + y, [(F.col("k") >= c).cast("int") for c in cuts], F.lit(0))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, same = M.halves(batches)
        sides = [[M.lists(t, c) for c in ("cases", "controls")] for t in (x, y)]
        spans = [v for side in sides for v, _ in side if len(v)]
        low, high = min(v.min() for v in spans), max(v.max() for v in spans)
        if high - low > 4 * sum(map(len, spans)):  # ids far apart: by their places among all
            ids = np.unique(np.concatenate([v for v, _ in sides[1]]))
            known = [[(np.minimum(np.searchsorted(ids, v), len(ids) - 1), v, at) for v, at in side] for side in sides]
            sides = [[(np.where(ids[i] == v, i, len(ids)), at) for i, v, at in side] for side in known]
            items = len(ids) + 1
        else:
            sides = [[(v - low, at) for v, at in side] for side in sides]
            items = int(high - low) + 1
        ku, kv, width = x["k"].to_numpy(), y["k"].to_numpy(), y.num_rows
        posts = [M.Postings(v, at, items) for v, at in sides[1]]
        begins = [(p.begin[:-1], np.diff(p.begin), p.owner) for p in posts]
        step = max(1, cells // width)

        def found(lo: int, hi: int, values: np.ndarray, at: np.ndarray, post: tuple) -> np.ndarray:
            begin, size, owner = post
            own, total = values[at[lo] : at[hi]], np.zeros((hi - lo) * width, "int64")
            row = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])) * width
            n = size[own]
            ends = np.cumsum(n)
            i = 0
            while i < len(own):  # as many carriers as have `cells` common ones
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + cells, side="right")))
                m = n[i:j]
                first = np.cumsum(m) - m
                place = np.arange(int(m.sum())) + np.repeat(begin[own[i:j]] - first, m)
                total += np.bincount(np.repeat(row[i:j], m) + owner[place], minlength=len(total))
                i = j
            return total

        for lo in range(0, len(ku), step):
            hi = min(lo + step, len(ku))
            case, control = (found(lo, hi, v, at, post) for (v, at), post in zip(sides[0], begins, strict=True))
            both = case + control
            hit = np.flatnonzero(both)
            u, v = ku[lo + hit // width], kv[hit % width]
            if same:
                hit, u, v = (z[u > v] for z in (hit, u, v))
            columns = [pa.array(z) for z in (np.maximum(u, v), np.minimum(u, v), both[hit], case[hit])]
            yield from pa.Table.from_arrays(columns, ["u", "v", "g11", "x11"]).to_batches(max_chunksize=M.HELD)

    rows = M.met(lists, block, blocks).groupBy("bu", "bv").applyInArrow(counts, "u long, v long, g11 long, x11 long")
    return rows.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), "g11", "x11")


def pair_counts_blocked(carrier: DataFrame, variants: int, block: int = 1024, sample_block: int = 4096) -> DataFrame:
    """As pair_counts (symmetric), by matrix products of variant blocks: for cohorts in which samples carry many of the variants.

    Each pair of variant blocks is one group for each block of samples; a group holds two matrices of block * sample_block cells at most.
    A row goes to all groups its block belongs to, so blocks should be as large as memory allows.
    """
    last = (variants - 1) // block
    rows = carrier.select("sample_id", "variant_idx", "pheno", F.floor(F.col("variant_idx") / block).cast("int").alias("b"), F.floor(F.col("sample_id") / sample_block).cast("int").alias("s"))
    # As the higher block it meets itself and all lower ones, as the lower block all higher ones.
    at = F.concat(F.transform(F.sequence(F.lit(0), F.col("b")), lambda x: F.struct(F.col("b").alias("bu"), x.alias("bv"))), F.transform(F.slice(F.sequence(F.col("b"), F.lit(last)), 2, last + 1), lambda x: F.struct(x.alias("bu"), F.col("b").alias("bv"))))
    sent = rows.select("s", "sample_id", "variant_idx", "pheno", F.inline(at))

    def products(pdf):
        import numpy as np
        import pandas as pd

        s0, bu, bv = pdf["s"].iloc[0] * sample_block, pdf["bu"].iloc[0] * block, pdf["bv"].iloc[0] * block
        sample, variant = (pdf["sample_id"] - s0).to_numpy("int64"), pdf["variant_idx"].to_numpy("int64")
        x, case = np.zeros((sample_block, block), "float32"), np.zeros(sample_block, "float32")
        case[sample] = pdf["pheno"].to_numpy("float32")
        upper = (variant >= bu) & (variant < bu + block)
        x[sample[upper], variant[upper] - bu] = 1
        y = x
        if bu != bv:
            y = np.zeros((sample_block, block), "float32")
            y[sample[~upper], variant[~upper] - bv] = 1
        both, cases = x.T @ y, (x * case[:, None]).T @ y
        if bu == bv:
            both = np.tril(both, -1)
        i, j = np.nonzero(both)
        return pd.DataFrame({"u": i + bu, "v": j + bv, "g": both[i, j].astype("int64"), "c": cases[i, j].astype("int64")})

    part = sent.groupBy("s", "bu", "bv").applyInPandas(products, "u long, v long, g long, c long")
    return part.groupBy("u", "v").agg(F.sum("g").alias("g11"), F.sum("c").alias("x11"))


def contingency(pairs: DataFrame, left: DataFrame, right: DataFrame, total: tuple[int, int]) -> DataFrame:
    """pairs with the four cells of carriers (g) and cases among them (x); six follow from two by the marginals."""
    rows = pairs.join(left.toDF("u", "nu", "xu"), "u").join(right.toDF("v", "nv", "xv"), "v")
    n, cases = (F.lit(x).cast("long") for x in total)
    return rows.select(
        *pairs.columns, (F.col("nu") - F.col("g11")).alias("g10"), (F.col("xu") - F.col("x11")).alias("x10"),
        (F.col("nv") - F.col("g11")).alias("g01"), (F.col("xv") - F.col("x11")).alias("x01"),
        (n - F.col("nu") - F.col("nv") + F.col("g11")).alias("g00"), (cases - F.col("xu") - F.col("xv") + F.col("x11")).alias("x00"),
    )


def _hits(c: str, effect: str) -> Column:
    """What counts as drawn in a cell: cases for risk, controls for protective."""
    return F.col(f"x{c}") if effect == "risk" else F.col(f"g{c}") - F.col(f"x{c}")


def tail_table(wanted: DataFrame, drawn: int, population: int) -> DataFrame:
    """g, x, p: P(X >= x) for each wanted (g carriers, x of them drawn), as a written table.

    The counts from the least wanted x of a g on are laid out once: the first one's probability is worked out, the
    others follow by the ratio of neighbouring terms, and sums run from the far end. So a g costs as many terms as it
    has counts, however many x are wanted of it.
    """
    least = wanted.groupBy("g", "x").agg(F.lit(1).alias("one"))
    first, g, x = F.greatest(F.col("x"), F.lit(0).cast("long"), F.col("g") - (population - drawn)), F.col("g"), F.col("at")
    spans = least.groupBy("g").agg(F.min(first).alias("lo")).withColumn("hi", F.least(g, F.lit(drawn).cast("long"))).filter("lo <= hi")
    spans = spans.withColumn("start", S.log_hypergeometric(F.col("lo"), g, drawn, population))
    terms = spans.select("g", "start", "lo", F.explode(F.sequence("lo", "hi")).alias("at"))
    ratio = (g - x + 1).cast("double") * (drawn - x + 1) / (x.cast("double") * (population - g - drawn + x))
    step = F.when(x == F.col("lo"), F.col("start")).otherwise(F.ln(ratio))
    up = W.partitionBy("g").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("g").orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0)
    sums = terms.withColumn("step", step).withColumn("p", F.exp(F.sum("step").over(up))).select("g", "at", F.sum("p").over(down).alias("p"))
    # An x below all possible counts has the whole sum, one above them none.
    found = least.select("g", "x", first.cast("long").alias("at")).join(sums, ["g", "at"], "left")
    return written(found.select("g", "x", F.coalesce("p", F.lit(0.0)).alias("p")), "tails")


def with_tails(cells: DataFrame, known: DataFrame, effect: str, which: tuple[str, ...]) -> DataFrame:
    """Adds p of each cell from the table of distinct (g, x), which is far shorter than the pairs."""
    for c in which:
        own = known.toDF(f"__g{c}", f"__x{c}", f"p{c}")
        cells = cells.join(own, (F.col(f"g{c}") == F.col(f"__g{c}")) & (_hits(c, effect) == F.col(f"__x{c}"))).drop(f"__g{c}", f"__x{c}")
    return cells


def leaning(pairs: DataFrame, effect: str, total: tuple[int, int], alpha1: float) -> DataFrame:
    """Pairs with more hits than expected. Others have a tail of 1/2 or more (a hypergeometric median is within 1 of the mean), so below alpha1 1/2 they can't pass."""
    if alpha1 >= 0.5:
        return pairs
    n, cases = total
    drawn = cases if effect == "risk" else n - cases
    return pairs.filter(_hits("11", effect) * n > F.col("g11") * drawn)


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame, total: tuple[int, int], effect: str, alpha1: float = 0.05, alpha2: float = 0.05) -> DataFrame:
    """u, v, score of the pairs that score above 0.

    p11 comes first, from the two counts alone; only pairs that pass alpha1 get marginals and the other three tails.
    """
    n, cases = total
    drawn = cases if effect == "risk" else n - cases
    found = written(leaning(pairs, effect, total, alpha1), "pairs")
    known = tail_table(found.select(F.col("g11").alias("g"), _hits("11", effect).alias("x")), drawn, n)
    passed = with_tails(found, known, effect, ("11",)).filter(F.col("p11") + S.EPS <= alpha1)
    cells = written(contingency(passed, left, right, total), "cells")
    seen = F.array(*[F.struct(F.col(f"g{c}").alias("g"), _hits(c, effect).alias("x")) for c in CELLS[1:]])
    known = tail_table(cells.select(F.inline(seen)), drawn, n)
    score = S.interaction_score(*(F.col(f"p{c}") for c in CELLS), alpha1, alpha2)
    out = written(with_tails(cells, known, effect, CELLS[1:]).select("u", "v", score.alias("score")).filter("score > 0"), "network")
    drop(found)
    drop(cells)
    return out


def network_of(carrier: DataFrame, total: tuple[int, int], variants: int, model: str, effect: str, alpha1: float = 0.05, alpha2: float = 0.05) -> DataFrame:
    """u > v, score, as a written table. DD and RR on unordered pairs; RD on ordered ones, of which the better counts."""
    left, right = marginals(coded(carrier, model[0])), marginals(coded(carrier, model[1]))
    edges = scored(pair_counts_of(carrier, model, total[0], variants), left, right, total, effect, alpha1, alpha2)
    return written(symmetrized(edges), "network") if model == "RD" else edges


def network(genotype: DataFrame, sample: DataFrame, model: str, effect: str, alpha1: float = 0.05, alpha2: float = 0.05) -> DataFrame:
    """One network from genotypes and samples. Several should share a carrier_table and call network_of, or interaction_networks."""
    carrier = carrier_table(genotype, sample)
    return network_of(carrier, totals(sample), variant_count(carrier), model, effect, alpha1, alpha2)


def variant_count(carrier: DataFrame) -> int:
    """Variants that anyone carries."""
    return carrier.select("variant_idx").distinct().count()


def interaction_networks(carrier: DataFrame, total: tuple[int, int], variants: int, model: str, alpha1: float = 0.05, alpha2: float = 0.05) -> dict[str, DataFrame]:
    """risk and protective network of a model: RR, DD, RD or combined, where max_id tells the winning model.

    Pairs are counted once for both effects.
    """
    if model not in ("RR", "DD", "RD", "combined"):
        raise ValueError(f"no such model: {model}")
    out: dict[str, dict[str, DataFrame]] = {"risk": {}, "protective": {}}
    for m in ("RR", "DD", "RD") if model == "combined" else (model,):
        pairs = written(pair_counts_of(carrier, m, total[0], variants), "counts")
        left, right = marginals(coded(carrier, m[0])), marginals(coded(carrier, m[1]))
        for effect, own in out.items():
            edges = scored(pairs, left, right, total, effect, alpha1, alpha2)
            own[m] = symmetrized(edges) if m == "RD" else edges
        drop(pairs)
    if model != "combined":
        return {e: own[model] for e, own in out.items()}
    return {e: written(combined(own["RR"], own["DD"], own["RD"]), "combined") for e, own in out.items()}


def symmetrized(edges: DataFrame) -> DataFrame:
    """Unordered pairs with the larger of both directions' scores; no loops."""
    rows = edges.filter("u <> v").groupBy(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    return rows.agg(F.max("score").alias("score")).select(F.col("a").alias("u"), F.col("b").alias("v"), "score")


def mirrored(edges: DataFrame) -> DataFrame:
    """Both orientations of each edge, from one scan."""
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(both), "score")


def combined(rr: DataFrame, dd: DataFrame, rd: DataFrame) -> DataFrame:
    """u, v, score, max_id of the best model: 1 RR, 2 DD, 3 RD. DD wins ties with RR, and either with RD."""
    rows = None
    for edges, max_id, rank in ((rr, 1, 1), (dd, 2, 2), (rd, 3, 0)):
        own = edges.select("u", "v", "score", F.lit(max_id).alias("max_id"), F.lit(rank).alias("rank"))
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy("u", "v").agg(F.max(F.struct("score", "rank", "max_id")).alias("b"))
    return best.select("u", "v", "b.score", "b.max_id")


def density(edges: DataFrame, variants: int | Column) -> DataFrame:
    """nnz (both orientations) and its share of all ordered pairs."""
    return edges.agg((F.count("*") * 2).alias("nnz")).withColumn("density", F.col("nnz") / (F.lit(variants).cast("double") * variants))


def density_cutoff(edges: DataFrame, variants: int, keep: float) -> DataFrame:
    """score_cutoff: the (1 - keep) quantile, linearly interpolated, of the dense matrix with its unstored zeros.

    Only the two stored scores at the wanted places are looked up: counts of scores at or above each distinct score.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must lie between 0 and 1")
    total = variants * variants
    at = (1 - keep) * (total - 1)
    lo, hi = int(at), int(at) + (at > int(at))
    steps = edges.groupBy("score").agg((F.count("*") * 2).alias("n"))
    above = steps.withColumn("above", F.sum("n").over(W.orderBy(F.desc("score"))))  # distinct scores, pre-aggregated
    # The value with k smaller ones has total - k values at or above its place.
    pick = [F.coalesce(F.max(F.when(F.col("above") >= total - k, F.col("score"))), F.lit(0.0)) for k in (lo, hi)]
    return above.agg((pick[0] + F.lit(at - lo) * (pick[1] - pick[0])).alias("score_cutoff"))


def binarized(edges: DataFrame, cutoff: float | Column) -> DataFrame:
    """Stored scores at or above the cut-off become 1, the rest go; what isn't stored stays 0."""
    return edges.filter(F.col("score") >= cutoff).withColumn("score", F.lit(1.0))


def degrees(edges: DataFrame) -> DataFrame:
    return mirrored(edges).groupBy("u").agg(F.sum("score").alias("degree"))


def import_scores(rows: DataFrame, kind: str, p: str = "p", effect: str = "effect", case: str = "case_value", control: str = "control_value") -> DataFrame:
    """Scores of an external network: -log10 p in the direction its kind's sign rule names; risk and protective columns."""
    score = F.when(F.col(p) > 0, S.minus_log10(F.col(p))).otherwise(F.lit(0.0))
    if kind == "lr":
        prot, risk = F.col(effect) < 0, F.col(effect) > 0  # 0 is in neither
    elif kind in ("lin", "wz"):
        prot, risk = F.col(effect) < 0, F.col(effect) >= 0
    else:
        prot, risk = F.col(control) > F.col(case), F.col(control) <= F.col(case)
    return rows.withColumn("protective", F.when(prot, score).otherwise(0.0)).withColumn("risk", F.when(risk, score).otherwise(0.0))


def import_last_wins(rows: DataFrame, order: str) -> DataFrame:
    """One score for each (u, v): that of the last line; then the larger of both orientations."""
    last = rows.groupBy("u", "v").agg(F.max_by("score", order).alias("score"))
    return symmetrized(last)

"""Module statistics: block sums, density enrichment, rank sums, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats as S
from ..store import written
from .network import mirrored
from .set_pairs import edge_sets, pair_edges, pair_ranks, pair_sizes, set_ids, variant_sets


def exact(edges: DataFrame) -> DataFrame:
    """Scores in whole millionths: sums are exact, whatever their order, so comparisons of permuted sums can't waver."""
    return edges.withColumn("score", F.round(F.col("score") * 1e6).cast("long"))


def path_row_sums(edges: DataFrame, member: DataFrame) -> DataFrame:
    """pathway_id, v, a: sum of the scores between a pathway's variants and v."""
    both = mirrored(edges)
    return both.join(member.select("pathway_id", F.col("variant_idx").alias("u")), "u").groupBy("pathway_id", "v").agg(F.sum("score").alias("a"))


def wpm_block_sum(edges: DataFrame, wpm: DataFrame) -> DataFrame:
    """Ordered-pair sums within each pathway; 0 where there is no edge."""
    member = wpm.select("pathway_id", F.explode("ind").alias("variant_idx"))
    sums = path_row_sums(edges, member).join(member.withColumnRenamed("variant_idx", "v"), ["pathway_id", "v"]).groupBy("pathway_id").agg(F.sum("a").alias("s"))
    return wpm.select("pathway_id").join(sums, "pathway_id", "left").select("pathway_id", F.coalesce("s", F.lit(0)).alias("block_sum"))


def bpm_block_sum(edges: DataFrame, bpm: DataFrame) -> DataFrame:
    """Sums over ind1 x ind2 of each pair of pathways."""
    one = bpm.select("path1", "path2", F.explode("ind1").alias("u"))
    two = bpm.select("path1", "path2", F.explode("ind2").alias("v"))
    sums = mirrored(edges).join(one, "u").join(two, ["path1", "path2", "v"]).groupBy("path1", "path2").agg(F.sum("score").alias("s"))
    return bpm.select("path1", "path2").join(sums, ["path1", "path2"], "left").select("path1", "path2", F.coalesce("s", F.lit(0)).alias("block_sum"))


def bpm_block_sum_ie(edges: DataFrame, member: DataFrame, bpm: DataFrame) -> DataFrame:
    """The same by inclusion and exclusion over the shared variants X: [A,B] - [X,B] - [A,X] + [X,X].

    Whole-pathway sums are made once for all pairs; only shared variants' rows are read again.
    """
    m = member.select("pathway_id", "variant_idx")
    rows = path_row_sums(edges, m)
    pair = rows.join(m.toDF("path2", "v"), "v").groupBy(F.col("pathway_id").alias("path1"), "path2").agg(F.sum("a").alias("ab"))
    shared = m.toDF("path1", "x").join(m.toDF("path2", "x"), "x").filter("path1 < path2").join(bpm.select("path1", "path2"), ["path1", "path2"])
    one = shared.join(rows.toDF("path2", "x", "a"), ["path2", "x"]).groupBy("path1", "path2").agg(F.sum("a").alias("xb"))
    two = shared.join(rows.toDF("path1", "x", "a"), ["path1", "x"]).groupBy("path1", "path2").agg(F.sum("a").alias("ax"))
    xx = mirrored(edges).join(shared.toDF("path1", "path2", "u"), "u").join(shared.toDF("path1", "path2", "v"), ["path1", "path2", "v"]).groupBy("path1", "path2").agg(F.sum("score").alias("xx"))
    out = bpm.select("path1", "path2")
    for part in (pair, one, two, xx):
        out = out.join(part, ["path1", "path2"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("path1", "path2", (z("ab") - z("xb") - z("ax") + z("xx")).alias("block_sum"))


def set_degree(edges: DataFrame, sets: DataFrame, keys: list[str], array: str, out: str) -> DataFrame:
    """Sum of the degrees of a set's variants."""
    degree = mirrored(edges).groupBy("u").agg(F.sum("score").alias("d"))
    sums = sets.select(*keys, F.explode(array).alias("u")).join(degree, "u").groupBy(*keys).agg(F.sum("d").alias("d"))
    return sets.select(*keys).join(sums, keys, "left").select(*keys, F.coalesce("d", F.lit(0)).alias(out))


def wpm_chi2(binary: DataFrame, wpm: DataFrame, variants: int) -> DataFrame:
    """Ordered-pair counts of each pathway against its background, and the statistic; under: less dense than the background."""
    rows = wpm.join(wpm_block_sum(binary, wpm), "pathway_id").join(set_degree(binary, wpm, ["pathway_id"], "ind", "total"), "pathway_id")
    gi = F.col("block_sum").cast("double")
    rows = rows.withColumn("gi", gi).withColumn("notgi", F.col("size") - gi).withColumn("bggi", F.col("total") - gi)
    rows = rows.withColumn("bgnotgi", F.col("indsize") * variants - F.col("bggi") - F.col("size"))
    under = F.try_divide(F.col("gi"), F.col("gi") + F.col("notgi")) < F.try_divide(F.col("bggi"), F.col("bggi") + F.col("bgnotgi"))
    return rows.select("pathway_id", "indsize", "size", "gi", "bggi", "notgi", "bgnotgi", S.chi2_stat(F.col("gi"), F.col("bggi"), F.col("notgi"), F.col("bgnotgi")).alias("stat"), F.coalesce(under, F.lit(False)).alias("under"))


def bpm_chi2(binary: DataFrame, wpm: DataFrame, variants: int, least: int = 5) -> DataFrame:
    """Both sides' tables and statistics, signs and local densities of each pair of pathways, from 0/1 edges. Sides below `least` variants count 0."""
    keys = ["path1", "path2"]
    sets = variant_sets(wpm)
    ids = set_ids(sets)
    rows = pair_sizes(sets, ids).join(pair_edges(edge_sets(binary, sets), ids), keys, "left")
    small = (F.col("ind1size") < least) | (F.col("ind2size") < least)
    cell = lambda c: F.when(small, 0.0).otherwise(F.coalesce(c, F.lit(0)).cast("double"))
    kind = wpm.schema["pathway_id"].dataType
    rows = rows.select(*[F.col(k).cast(kind).alias(k) for k in keys], "ind1size", "ind2size", "size", small.alias("small"), cell("gi").alias("gi"), cell("all1").alias("all1"), cell("all2").alias("all2"))
    # A module a row. The table between keeps the formulas below over plain columns, else the generated code is too long to compile.
    rows = written(rows, "bpm-cells")
    gi, size = F.col("gi"), F.col("size")
    out = {"notgi": F.greatest(size - gi, F.lit(0.0))}
    for i in ("1", "2"):
        bg = F.col(f"all{i}") - gi
        out |= {f"bg{i}": bg, f"bgnot{i}": F.col(f"ind{i}size") * variants - bg - size}
    rows = written(rows.withColumns(out).drop("all1", "all2"), "bpm-tables")
    for i in ("1", "2"):
        bg, bgnot, notgi = F.col(f"bg{i}"), F.col(f"bgnot{i}"), F.col("notgi")
        under = F.try_divide(gi, gi + notgi) < F.try_divide(bg, bg + bgnot)
        rows = rows.withColumns({f"stat{i}": F.when(~F.col("small"), S.chi2_stat(gi, bg, notgi, bgnot)), f"under{i}": F.coalesce(under, F.lit(False)), f"density{i}": F.try_divide(gi + bg, bgnot + bg + size)})
    return written(rows.drop("small"), "bpm-chi2")


def dense_side(rows: DataFrame) -> DataFrame:
    """dense_index: the side with the smaller signed -log10 p; on a tie the denser one; else 0.

    -log10 p of one degree of freedom rises with the statistic, so signed statistics compare as it does.
    """
    signed = [F.when(F.col(f"under{i}"), -F.coalesce(F.col(f"stat{i}"), F.lit(0.0))).otherwise(F.coalesce(F.col(f"stat{i}"), F.lit(0.0))) for i in ("1", "2")]
    d1, d2 = F.coalesce("density1", F.lit(0.0)), F.coalesce("density2", F.lit(0.0))
    side = F.when(signed[0] < signed[1], 1).when(signed[0] > signed[1], 2).when(d1 > d2, 1).when(d1 < d2, 2).otherwise(0)
    return rows.withColumn("dense_index", side).withColumn("signed_stat", F.when(side == 1, signed[0]).when(side == 2, signed[1]).otherwise(0.0))


def degree_ranks(edges: DataFrame, variant: DataFrame) -> DataFrame:
    """Midranks of the degrees of all variants, those without edges included.

    Equal degrees are pre-aggregated, so the window runs over distinct degrees.
    """
    degree = mirrored(edges).groupBy("u").agg(F.sum("score").alias("d"))
    all_ = variant.select("variant_idx").join(degree, F.col("variant_idx") == F.col("u"), "left").select("variant_idx", F.coalesce("d", F.lit(0)).alias("degree"))
    steps = all_.groupBy("degree").agg(F.count("*").alias("t"))
    before = F.sum("t").over(W.orderBy("degree").rowsBetween(W.unboundedPreceding, -1))
    steps = steps.withColumn("midrank", F.coalesce(before, F.lit(0)) + (F.col("t") + 1) / 2.0)
    return all_.join(steps, "degree").select("variant_idx", "degree", "t", "midrank")


def tie_term(n) -> object:
    """t^3 - t, as a double so that large groups fit."""
    t = n.cast("double")
    return t * t * t - t


def path_degree(edges: DataFrame, variant: DataFrame, wpm: DataFrame) -> DataFrame:
    """z of each pathway's degrees against all other variants'."""
    ranks = degree_ranks(edges, variant)
    ties = ranks.select("degree", "t").distinct().agg(F.sum(tie_term(F.col("t"))).alias("ties"), F.sum("t").alias("s"))
    member = wpm.select("pathway_id", "indsize", F.explode("ind").alias("variant_idx"))
    rank_in = member.join(ranks, "variant_idx").groupBy("pathway_id", "indsize").agg(F.sum("midrank").alias("rank_in"))
    rows = rank_in.join(F.broadcast(ties), F.lit(True))  # one row
    return rows.select("pathway_id", "rank_in", S.mann_whitney_z(F.col("rank_in"), F.col("indsize"), F.col("s") - F.col("indsize"), F.col("ties")).alias("z"))


def block_ranks(edges: DataFrame, sets: DataFrame, keys: list[str], array: str, variants: int) -> DataFrame:
    """Stored values of each row set's block with midranks among all its values; unstored ones are one tie group of zeros below."""
    member = sets.select(*keys, F.size(array).cast("long").alias("rows"), F.explode(array).alias("u"))
    block = mirrored(edges).join(member, "u")
    own = W.partitionBy(*keys)
    block = block.withColumn("zeros", F.col("rows") * variants - F.count("*").over(own))
    tied = F.count("*").over(W.partitionBy(*keys, "score"))
    return block.withColumn("t", tied).withColumn("midrank", S.midrank(F.rank().over(own.orderBy("score")), tied) + F.col("zeros"))


def rank_sums(edges: DataFrame, sets: DataFrame, keys: list[str], rows: str, cols: str, variants: int) -> DataFrame:
    """For each module: sum of the block rows x cols, midrank sum in it, ties, and z against the rest of the rows' values."""
    ranks = block_ranks(edges, sets, keys, rows, variants)
    inside = sets.select(*keys, F.explode(cols).alias("v")).withColumn("inside", F.lit(1))
    ranks = ranks.join(inside, [*keys, "v"], "left")
    in_ = F.col("inside").isNotNull()
    sums = ranks.groupBy(*keys, "zeros").agg(
        F.sum(F.when(in_, F.col("score")).otherwise(0)).alias("block_sum"), F.sum(F.when(in_, F.col("midrank")).otherwise(0.0)).alias("ranked"),
        F.sum(in_.cast("long")).alias("stored_in"), F.sum((F.col("t").cast("double") * F.col("t") - 1)).alias("ties"),
    )
    return _rank_z(sets.select(*keys, F.size(rows).cast("long").alias("nr"), F.size(cols).cast("long").alias("nc")).join(sums, keys, "left"), keys, variants)


def _rank_z(out: DataFrame, keys: list[str], variants: int) -> DataFrame:
    """From sizes (nr, nc) and the stored values' sums, if there are any."""
    n_in = F.col("nr") * F.col("nc")
    zeros = F.coalesce(F.col("zeros"), F.col("nr") * variants)
    rank_in = F.coalesce("ranked", F.lit(0.0)) + (n_in - F.coalesce("stored_in", F.lit(0))) * (zeros + 1) / 2.0
    ties = F.coalesce("ties", F.lit(0.0)) + F.when(zeros > 1, tie_term(zeros)).otherwise(0.0)
    z = S.mann_whitney_z(rank_in, n_in, F.col("nr") * variants - n_in, ties)
    return out.select(*keys, F.coalesce("block_sum", F.lit(0)).alias("block_sum"), rank_in.alias("rank_in"), ties.alias("ties"), z.alias("z"))


def bpm_rank_sums(edges: DataFrame, wpm: DataFrame, chosen: DataFrame, variants: int) -> DataFrame:
    """rank_sums of pairs of pathways, each side without the shared variants. chosen: dense_side's rows; the side it names is the row side."""
    two = F.col("dense_index") == 2
    pick = lambda c, d, out: F.when(two, F.col(d)).otherwise(F.col(c)).alias(out)
    sides = chosen.select("path1", "path2", pick("path1", "path2", "rows"), pick("path2", "path1", "cols"), pick("ind1size", "ind2size", "nr"), pick("ind2size", "ind1size", "nc"))
    sets = variant_sets(wpm)
    ids = set_ids(sets)
    sums = pair_ranks(written(edge_sets(edges, sets), "edge-sets"), ids, sides)
    zeros = F.col("nr") * variants - F.col("n")  # unstored values lie below all stored ones
    out = sides.join(sums, ["rows", "cols"], "left").withColumn("zeros", zeros).withColumn("ranked", F.col("ranked") + F.col("stored_in") * F.col("zeros"))
    return _rank_z(out, ["path1", "path2"], variants)


def expected_density(edges: DataFrame, wpm: DataFrame, variants: int) -> DataFrame:
    rows = wpm.join(set_degree(edges, wpm, ["pathway_id"], "ind", "total"), "pathway_id")
    return rows.select("pathway_id", F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("indsize").cast("double") * variants), F.lit(0.0)).alias("density_expected"))

"""Result tables: significance, interaction lists, drivers, redundancy groups, summaries, network map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import stats as S

SIMILAR = 0.25
FOLD, TAIL, DRIVERS = 1.2, 0.05, 20


def stacked(protective: DataFrame, risk: DataFrame, modules: int) -> DataFrame:
    """Module numbers 0..n-1 for protective rows and n..2n-1 for risk rows, with the effect's name."""
    a = protective.withColumn("effect", F.lit("protective"))
    b = risk.withColumn("module", F.col("module") + modules).withColumn("effect", F.lit("risk"))
    return a.unionByName(b)


def significant(column: Column, cutoff: float) -> Column:
    """<= cutoff; NaN and null never pass."""
    return ~F.isnan(column) & (column <= cutoff)


def sorted_table(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds place: FDR ascending, p ascending, score descending, missing last, then module. Significant modules only, so one short window."""
    clean = [F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("fdr", "pv", "s")]
    order = W.orderBy(clean[0].asc_nulls_last(), clean[1].asc_nulls_last(), clean[2].desc_nulls_last(), "module")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def discovery_summary(rows: DataFrame, steps: int = 5) -> DataFrame:
    """Least FDR, and how many modules pass each multiple of 0.05."""
    return rows.agg(F.min("fdr").alias("min_fdr"), *[F.count_if(significant(F.col("fdr"), round(0.05 * k, 2))).alias(f"n_{5 * k:02d}") for k in range(1, steps + 1)])


def snp_gene_label(member: DataFrame, variant_gene: DataFrame, gene_set: DataFrame) -> DataFrame:
    """pathway_id, variant_idx, genes of the pathway that hold the variant, sorted and joined by a slash; '/' if none."""
    hits = member.join(variant_gene, "variant_idx").join(gene_set, ["pathway_id", "gene"]).groupBy("pathway_id", "variant_idx").agg(F.array_join(F.sort_array(F.collect_set("gene")), "/").alias("genes"))
    return member.join(hits, ["pathway_id", "variant_idx"], "left").select("pathway_id", "variant_idx", F.coalesce("genes", F.lit("/")).alias("genes"))


def ld_text(r2: Column) -> Column:
    """Three decimals from 0.001 on, scientific below."""
    low = F.format_string("%.3e", r2)
    return F.when(r2 >= 0.001, F.format_string("%.3f", r2)).otherwise(low)


def pair_ld(pairs: DataFrame, variant: DataFrame, ld: DataFrame) -> DataFrame:
    """u, v, ld: r2 as text for pairs on one chromosome (0 if unknown), NA for others."""
    c = variant.select("variant_idx", "chrom")
    rows = pairs.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v").join(ld, ["u", "v"], "left")
    return rows.select("u", "v", F.when(F.col("cu") == F.col("cv"), ld_text(F.coalesce("r2", F.lit(0.0)))).otherwise("NA").alias("ld"))


def pair_frequencies(pairs: DataFrame, genotype: DataFrame, sample: DataFrame, effect: str) -> DataFrame:
    """pairs (u, v, model) with case and control frequency under the model, and the odds ratio.

    RD tries both orientations with a control frequency of 0 taken as 1; risk keeps the larger ratio, protective the smaller.
    Only samples that carry both variants are touched.
    """
    g = genotype.select("sample_id", "variant_idx", "dosage")
    both = pairs.join(g.toDF("sample_id", "u", "du"), "u").join(g.toDF("sample_id", "v", "dv"), ["sample_id", "v"]).join(sample.select("sample_id", "pheno"), "sample_id")
    hit = {"DD": F.lit(True), "RR": (F.col("du") == 2) & (F.col("dv") == 2), "R1": F.col("du") == 2, "R2": F.col("dv") == 2}
    case = F.col("pheno") == 1
    own = F.when(F.col("model") == "DD", hit["DD"]).when(F.col("model") == "RR", hit["RR"])
    n = both.groupBy("u", "v", "model").agg(*[F.count_if(h & c).alias(f"{k}_{e}") for k, h in (("own", own), ("r1", hit["R1"]), ("r2", hit["R2"])) for e, c in (("case", case), ("ctrl", ~case))])
    total = sample.agg(F.sum("pheno").cast("double").alias("cases"), F.sum(1 - F.col("pheno")).cast("double").alias("ctrls"))
    rows = pairs.join(n, ["u", "v", "model"], "left").join(F.broadcast(total), F.lit(True))  # one row
    f = {f"{k}_{e}": F.coalesce(f"{k}_{e}", F.lit(0)) / F.col("cases" if e == "case" else "ctrls") for k in ("own", "r1", "r2") for e in ("case", "ctrl")}
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    c1, c2 = one(f["r1_ctrl"]), one(f["r2_ctrl"])
    first = (f["r1_case"] / c1 > f["r2_case"] / c2) != F.lit(effect == "protective")
    rd = F.col("model") == "RD"
    rows = rows.withColumn("case_freq", F.when(rd, F.when(first, f["r1_case"]).otherwise(f["r2_case"])).otherwise(f["own_case"]))
    rows = rows.withColumn("control_freq", F.when(rd, F.when(first, c1).otherwise(c2)).otherwise(f["own_ctrl"]))
    odds = F.try_divide((1 - F.col("control_freq")) * F.col("case_freq"), (1 - F.col("case_freq")) * F.col("control_freq"))
    return rows.select("u", "v", "model", "case_freq", "control_freq", odds.alias("odds_ratio"))


def module_pairs(edges: DataFrame, sets: DataFrame, keys: list[str], rows: str, cols: str, within: bool, cutoff: float = 0.0) -> DataFrame:
    """Edges of each module; a within-pathway module lists each pair once."""
    from .network import mirrored

    e = (edges if within else mirrored(edges)).filter(F.col("score") >= cutoff)
    one, two = sets.select(*keys, F.explode(rows).alias("u")), sets.select(*keys, F.explode(cols).alias("v"))
    return e.join(one, "u").join(two, [*keys, "v"]).select(*keys, "u", "v", "score")


def drivers(edges: DataFrame, sets: DataFrame, keys: list[str], rows: str, cols: str, variants: int) -> DataFrame:
    """keys, u, fold, tail of the row variants whose edges crowd in the module: hypergeometric tail <= 0.05 and fold > 1.2, the best 20."""
    from .network import mirrored

    both = mirrored(edges)
    inside = both.join(sets.select(*keys, F.explode(rows).alias("u")), "u").join(sets.select(*keys, F.explode(cols).alias("v")), [*keys, "v"]).groupBy(*keys, "u").agg(F.count("*").alias("n_in"))
    all_ = both.groupBy("u").agg(F.count("*").alias("n_all"))
    got = inside.join(all_, "u").join(sets.select(*keys, F.size(cols).cast("long").alias("n_other")), keys)
    fold = (F.col("n_in") / F.col("n_other")) / (F.col("n_all") / F.lit(float(variants)))
    got = got.withColumn("fold", fold).withColumn("tail", S.hypergeometric_tail(F.col("n_in"), F.col("n_other"), F.col("n_all"), F.lit(variants)))
    got = got.filter((F.col("tail") <= TAIL) & (F.col("fold") > FOLD))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("fold"), "u"))
    return got.withColumn("place", place).filter(F.col("place") <= DRIVERS).select(*keys, "u", "n_in", "n_all", "fold", "tail", "place")


def bpm_similarity(bpm: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of modules a < b that share variants, with max(|11||22|, |12||21|) over the smaller size product.

    An equi-join on the variants counts the four overlaps; pairs without a common variant are never made.
    """
    key = F.struct(*keys)
    sides = [bpm.select(key.alias("k"), F.lit(i).alias("side"), F.explode(f"ind{i}").alias("v")) for i in (1, 2)]
    member = sides[0].unionByName(sides[1])
    a, b = member.toDF("a", "sa", "v"), member.toDF("b", "sb", "v")
    n = lambda x, y: F.count_if((F.col("sa") == x) & (F.col("sb") == y)).alias(f"n{x}{y}")
    rows = a.join(b, "v").filter("a < b").groupBy("a", "b").agg(n(1, 1), n(2, 2), n(1, 2), n(2, 1))
    top = F.greatest(F.col("n11") * F.col("n22"), F.col("n12") * F.col("n21"))
    size = bpm.select(key.alias("k"), (F.size("ind1").cast("long") * F.size("ind2")).alias("n"))
    rows = rows.filter(top > 0).join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return rows.select(*[F.col(f"{s}.{k}").alias(f"{k}_{s}") for s in ("a", "b") for k in keys], (top.cast("double") / F.least("na", "nb")).alias("similarity"))


def path_similarity(wpm: DataFrame) -> DataFrame:
    """a < b, overlap coefficient of pathways that share a variant."""
    m = wpm.select("pathway_id", "indsize", F.explode("ind").alias("v"))
    rows = m.toDF("a", "na", "v").join(m.toDF("b", "nb", "v"), "v").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    return rows.select("a", "b", (F.col("n") / F.least("na", "nb")).alias("similarity"))


def redundancy_groups(modules: DataFrame, similar: DataFrame) -> DataFrame:
    """module, grp: each module, best first, joins the group of the first better module it is similar to, or starts one.

    That is a forest: each module points to its first better similar one; pointers are followed by doubling,
    so chains of length n take log n joins. Groups are numbered in the order of their first modules.
    """
    rank = modules.withColumn("rank", F.row_number().over(W.orderBy("fdr", "module"))).select("module", "rank")
    r = rank.select(F.col("module").alias("m"), F.col("rank").alias("k"))
    pairs = similar.join(r.toDF("a", "ka"), "a").join(r.toDF("b", "kb"), "b").select(F.greatest("ka", "kb").alias("late"), F.least("ka", "kb").alias("early"))
    up = rank.join(pairs.groupBy("late").agg(F.min("early").alias("up")), F.col("rank") == F.col("late"), "left").select("rank", F.coalesce("up", "rank").alias("up")).persist()
    while True:
        nxt = up.join(up.toDF("up", "up2"), "up").select("rank", F.col("up2").alias("up")).persist()
        if not nxt.join(up.withColumnRenamed("up", "old"), "rank").filter("up <> old").take(1):
            break
        up = nxt
    root = nxt.withColumn("grp", (F.dense_rank().over(W.orderBy("up")) - 1).cast("long"))
    return rank.join(root, "rank").select("module", "grp")


def group_representatives(groups: DataFrame) -> DataFrame:
    """The best module of each group: least FDR, then module."""
    return groups.groupBy("grp").agg(F.min(F.struct("fdr", "module")).alias("x")).select("grp", "x.module", "x.fdr")


def map_edges(wpm_reps: DataFrame, bpm_rows: DataFrame, bpm_reps: DataFrame, limit: int = 20) -> DataFrame:
    """node1 < node2 (or equal), colour. wpm_reps: pathway, effect; bpm_rows: significant p1, p2, effect, module; bpm_reps: p1, p2, effect, fdr, grp.

    Within-pathway loops first, then modules that touch them, then the `limit` best groups; the last drawn decides.
    """
    colour = F.when(F.col("effect") == "protective", "orange").otherwise("blue")
    loops = wpm_reps.select(F.col("pathway").alias("p1"), F.col("pathway").alias("p2"), "effect", F.lit(0).alias("layer"), F.when(F.col("effect") == "protective", 0.0).otherwise(1.0).alias("n"))
    drawn = wpm_reps.select(F.col("pathway")).distinct()
    touch = bpm_rows.join(drawn, (F.col("p1") == F.col("pathway")) | (F.col("p2") == F.col("pathway")), "left_semi").select("p1", "p2", "effect", F.lit(1).alias("layer"), F.when(F.col("effect") == "protective", 0.0).otherwise(1.0).alias("n"))
    best = bpm_reps.orderBy("fdr", "grp").limit(limit).withColumn("n", F.row_number().over(W.orderBy("fdr", "grp")).cast("double")).select("p1", "p2", "effect", F.lit(2).alias("layer"), "n")
    rows = loops.unionByName(touch).unionByName(best).withColumn("colour", colour)
    return rows.groupBy(F.least("p1", "p2").alias("node1"), F.greatest("p1", "p2").alias("node2")).agg(F.max_by("colour", F.struct("layer", "n")).alias("colour"))

"""False discovery rates from one real and several random networks, by two-dimensional dominance counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dominance_counts(points: DataFrame, p_cutoff: float) -> DataFrame:
    """For each real module with pv <= p_cutoff: m1, m2 (real, random modules with pv no larger), n1, n2 (and s no smaller).

    Points are first counted by distinct (pv, s) below the cut-off; empirical p-values have few levels, so the join runs over levels, not modules.
    """
    grid = points.filter(F.col("pv") <= p_cutoff).groupBy("pv", "s").agg(F.count_if(F.col("r") == 0).alias("c1"), F.count_if(F.col("r") > 0).alias("c2"))
    query = grid.filter("c1 > 0").select(F.col("pv").alias("qpv"), F.col("s").alias("qs"))
    level = grid.groupBy("pv").agg(F.sum("c1").alias("a"), F.sum("c2").alias("b"))
    run = W.orderBy("pv").rangeBetween(W.unboundedPreceding, 0)  # distinct levels only
    level = level.select(F.col("pv").alias("qpv"), F.sum("a").over(run).alias("m1"), F.sum("b").over(run).alias("m2"))
    both = query.join(grid, (F.col("pv") <= F.col("qpv")) & (F.col("s") >= F.col("qs"))).groupBy("qpv", "qs").agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    real = points.filter((F.col("r") == 0) & (F.col("pv") <= p_cutoff))
    rows = real.join(both, (F.col("pv") == F.col("qpv")) & (F.col("s") == F.col("qs"))).drop("qpv", "qs")
    return rows.join(level, F.col("pv") == F.col("qpv")).select("module", "pv", "s", "m1", "n1", "m2", "n2")


def ratios(counts: DataFrame, networks: int) -> DataFrame:
    """raw1, raw2: random over real counts for each of `networks` random networks; 0 where undefined."""
    if networks < 1:
        raise ValueError("at least one random network is needed")
    f = lambda m, n: F.coalesce(F.try_divide(F.col(m).cast("double"), F.col(n).cast("double") * networks), F.lit(0.0))
    return counts.withColumn("raw1", f("m2", "m1")).withColumn("raw2", f("n2", "n1"))


def suffix_min(rows: DataFrame, value: str, out: str) -> DataFrame:
    """The least value among rows with pv no smaller, ties included: levels are pre-aggregated, then one window over them."""
    level = rows.groupBy("pv").agg(F.min(value).alias("x"))
    level = level.select("pv", F.min("x").over(W.orderBy(F.desc("pv")).rangeBetween(W.unboundedPreceding, 0)).alias(out))
    return rows.join(level, "pv")


def dominance_min(rows: DataFrame, value: str, out: str, rounded: bool = False) -> DataFrame:
    """The least value among rows with pv no smaller and s no larger (s rounded half to even for within-pathway modules)."""
    key = F.rint("s") if rounded else F.col("s")
    rows = rows.withColumn("key", key)
    grid = rows.groupBy("pv", "key").agg(F.min(value).alias("x"))
    best = grid.alias("a").join(grid.alias("b"), (F.col("b.pv") >= F.col("a.pv")) & (F.col("b.key") <= F.col("a.key"))).groupBy("a.pv", "a.key").agg(F.min("b.x").alias(out))
    return rows.join(best, ["pv", "key"]).drop("key")


def fdr(points: DataFrame, p_cutoff: float, networks: int, rounded: bool = False) -> DataFrame:
    """module, fdr1, fdr2 of all real modules; 1 for those above the cut-off."""
    raw = ratios(dominance_counts(points, p_cutoff), networks)
    done = dominance_min(suffix_min(raw, "raw1", "fdr1"), "raw2", "fdr2", rounded).select("module", "fdr1", "fdr2")
    real = points.filter("r = 0").select("module", "pv", "s")
    return real.join(done, "module", "left").select("module", "pv", "s", F.coalesce("fdr1", F.lit(1.0)).alias("fdr1"), F.coalesce("fdr2", F.lit(1.0)).alias("fdr2"))

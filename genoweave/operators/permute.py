"""Permutations of phenotypes and variants, addressed by their number: results don't depend on the split into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def permuted_variants(variant: DataFrame, perms: int, source: str = "hash", seed: int = 42) -> DataFrame:
    """k, v, q: permutation k takes place v to q. hash: the order of md5(k:v); numpy: a generator seeded with (seed, k)."""
    ks = variant.sparkSession.range(1, perms + 1).withColumnRenamed("id", "k")
    if source == "hash":
        own = W.partitionBy("k").orderBy(F.md5(F.concat(F.col("k").cast("string"), F.lit(":"), F.col("variant_idx").cast("string"))))
        return variant.select("variant_idx").join(ks, F.lit(True)).select("k", F.col("variant_idx").alias("v"), (F.row_number().over(own) - 1).cast("long").alias("q"))
    n = variant.count()

    def draw(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for k in batch["k"].tolist():
                q = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(k,))).permutation(n)
                yield pd.DataFrame({"k": k, "v": np.arange(n), "q": q})

    return ks.mapInPandas(draw, "k long, v long, q long")


def permuted_phenotypes(sample: DataFrame, k: int, by_cluster: bool = False) -> DataFrame:
    """sample_id, pheno: phenotypes dealt anew in the order of md5(k:sample); within clusters the case counts stay.

    One row a sample, and no genotype, goes through the windows.
    """
    part = ["cluster"] if by_cluster else []
    base = sample.withColumn("h", F.md5(F.concat(F.lit(f"{k}:"), F.col("sample_id").cast("string"))))
    by_id = base.withColumn("n", F.row_number().over(W.partitionBy(*part).orderBy("sample_id")))
    by_hash = base.withColumn("n", F.row_number().over(W.partitionBy(*part).orderBy("h"))).select(*part, "n", F.col("pheno").alias("new"))
    return by_id.join(by_hash, [*part, "n"]).select("sample_id", F.col("new").alias("pheno"), "cluster")


def exceedances(row_sums: DataFrame, keys: list[str], cols: DataFrame, perm: DataFrame) -> DataFrame:
    """For each module, in how many permutations the permuted block sum exceeds the observed one.

    row_sums: keys, v, a (scores in whole millionths, see modules.exact); cols: keys, v of each module's column set. A
    permutation only moves columns, so A is made once and gathered; counts, not permuted sums, come out.
    """
    moved = cols.join(perm, "v").join(row_sums.withColumnRenamed("v", "q"), [*keys, "q"]).groupBy(*keys, "k").agg(F.sum("a").alias("s"))
    seen = cols.join(row_sums, [*keys, "v"]).groupBy(*keys).agg(F.sum("a").alias("obs"))
    every = cols.select(*keys).distinct().join(seen, keys, "left").select(*keys, F.coalesce("obs", F.lit(0)).alias("obs"))
    over = moved.join(every, keys).filter("s > obs").groupBy(*keys).agg(F.count("*").alias("n"))
    return every.join(over, keys, "left").select(*keys, "obs", F.coalesce("n", F.lit(0)).alias("exceed"))


def path_exceedances(ranks: DataFrame, member: DataFrame, perm: DataFrame) -> DataFrame:
    """The same for pathway degrees: p falls with the rank sum, so rank sums (doubled, whole) are compared."""
    double = ranks.select("variant_idx", (F.col("midrank") * 2).cast("long").alias("a"))
    obs = member.join(double, "variant_idx").groupBy("pathway_id").agg(F.sum("a").alias("obs"))
    moved = member.withColumnRenamed("variant_idx", "v").join(perm, "v").join(double.withColumnRenamed("variant_idx", "q"), "q").groupBy("pathway_id", "k").agg(F.sum("a").alias("s"))
    over = moved.join(obs, "pathway_id").groupBy("pathway_id", "obs").agg(F.count_if(F.col("s") > F.col("obs")).alias("exceed"))
    return over


def empirical_p(exceed, perms: int):
    """(exceedances + 1) / permutations."""
    return (exceed + 1) / F.lit(float(perms))

"""Readers and writers of a cohort's files. Readers take a path that spark.read.text opens (compressed files and any store included).

A header line starts with '#'; its names choose the columns, so their order doesn't matter and a family id may be absent.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read_lines, recoded_pheno, whitespace_tokens, write_table


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the first line that starts with one '#'."""
    line = read_lines(spark, path).filter(F.col("value").startswith("#") & ~F.col("value").startswith("##")).limit(1).collect()
    if not line:
        raise ValueError(f"{path}: no header line")
    return line[0]["value"].lstrip("#").split()


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """Columns by the header's names, all text; comment lines go."""
    names = header_of(spark, path)
    parts = F.split("value", r"[ \t]+")
    rows = read_lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def _ids(rows: DataFrame):
    return [F.col(c).alias(c.lower()) for c in ("FID", "IID") if c in rows.columns]


def read_samples(spark: SparkSession, path: str, pheno: str = "PHENO1") -> DataFrame:
    """[fid,] iid, sex, pheno (case, control or missing)."""
    rows = header_table(spark, path)
    code = F.col(pheno) if pheno in rows.columns else F.lit("")
    sex = F.col("SEX").try_cast("int") if "SEX" in rows.columns else F.lit(None).cast("int")
    return rows.select(*_ids(rows), sex.alias("sex"), recoded_pheno(code).alias("pheno"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt of a .pvar (by its header) or a .bim (chromosome, id, centimorgans, position, alt, ref)."""
    if path.rstrip("/").removesuffix(".zst").removesuffix(".gz").endswith(".bim"):
        w = whitespace_tokens(F.col("value"), None)
        chrom, name, _, pos, alt, ref = (F.get(w, F.lit(i)) for i in range(6))
        return read_lines(spark, path).select(chrom.alias("chrom"), pos.try_cast("bigint").alias("pos"), name.alias("id"), ref.alias("ref"), alt.alias("alt"))
    rows = header_table(spark, path)
    return rows.select(F.col("CHROM").alias("chrom"), F.col("POS").try_cast("bigint").alias("pos"), F.col("ID").alias("id"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"))


def read_components(spark: SparkSession, path: str, most: int) -> DataFrame:
    """[fid,] iid, pc: the first `most` PC columns by number."""
    rows = header_table(spark, path)
    names = sorted((c for c in rows.columns if re.fullmatch(r"PC\d+", c)), key=lambda c: int(c[2:]))
    if len(names) < most:
        raise ValueError(f"{path}: {len(names)} components, {most} wanted")
    return rows.select(*_ids(rows), F.array(*[F.col(c).cast("double") for c in names[:most]]).alias("pc"))


def read_eigenvalues(spark: SparkSession, path: str, most: int) -> list[float]:
    """The first `most` of one number a line: a few."""
    rows = read_lines(spark, path).filter(F.trim("value") != "").select(F.trim("value").cast("double").alias("x")).limit(most).collect()
    if len(rows) < most:
        raise ValueError(f"{path}: fewer than {most} eigenvalues")
    return [r["x"] for r in rows]


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """[fid,] iid, pc of a projection's PC<i>_AVG columns in the order of their numbers."""
    rows = header_table(spark, path)
    names = sorted((c for c in rows.columns if re.fullmatch(r"PC\d+_AVG", c)), key=lambda c: int(c[2:-4]))
    if not names:
        raise ValueError(f"{path}: no PC<i>_AVG column")
    return rows.select(*_ids(rows), F.array(*[F.col(c).cast("double") for c in names]).alias("pc"))


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """[fid,] iid, x, y from PC1 and PC2, or C1 and C2."""
    rows = header_table(spark, path)
    x, y = ("PC1", "PC2") if "PC1" in rows.columns else ("C1", "C2")
    return rows.select(*_ids(rows), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def read_kinship(spark: SparkSession, path: str, least: float | None = None) -> DataFrame:
    """a, b, kinship of pairs at or above `least`; with family ids a and b are 'fid iid'."""
    rows = header_table(spark, path)
    if "KINSHIP" not in rows.columns:
        raise ValueError(f"{path}: no KINSHIP column")
    key = lambda i: F.concat_ws(" ", F.col(f"FID{i}"), F.col(f"IID{i}")) if "FID1" in rows.columns else F.col(f"IID{i}")
    out = rows.select(key(1).alias("a"), key(2).alias("b"), F.col("KINSHIP").cast("double").alias("kinship"))
    return out if least is None else out.filter(F.col("kinship") >= least)


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, pop."""
    w = whitespace_tokens(F.col("value"))
    return read_lines(spark, path).filter(F.size(w) >= 3).select(*(F.get(w, F.lit(i)).alias(c) for i, c in enumerate(("fid", "iid", "pop"))))


def of_populations(samples: DataFrame, population: DataFrame, wanted: list[str]) -> DataFrame:
    """Samples of the wanted populations; joined by iid alone where samples have no family id."""
    keys = [c for c in ("fid", "iid") if c in samples.columns]
    return samples.join(population.filter(F.col("pop").isin(*wanted)).select(*keys).distinct(), keys, "left_semi")


def population_counts(population: DataFrame) -> DataFrame:
    return population.groupBy("pop").agg(F.count("*").alias("n"))


def require_files(spark: SparkSession, *paths: str) -> None:
    """Fails before anything runs if one is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(conf).exists(at):
            raise FileNotFoundError(path)


def write_network(edges: DataFrame, path: str, codec: str = "zstd") -> None:
    """An edge list as parquet."""
    edges.write.mode("overwrite").parquet(path, compression=codec)


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """u, v, score, and max_id if the network is combined."""
    rows = spark.read.parquet(path)
    return rows.select("u", "v", "score", *(c for c in ("max_id",) if c in rows.columns))


def write_pairs(matched: DataFrame, path: str) -> None:
    """CASE, CONTROL, DIST (six decimals), by case and control."""
    rows = matched.select(F.col("case").alias("CASE"), F.col("control").alias("CONTROL"), F.format_string("%.6f", "dist").alias("DIST"))
    write_table(rows.orderBy("CASE", "CONTROL"), path)


def write_clusters(rows: DataFrame, path: str) -> None:
    write_table(rows.select(F.col("iid").alias("IID"), F.col("pheno").alias("PHENO"), F.col("cluster").alias("CLUSTER")), path)


def write_gene_windows(gene: DataFrame, path: str) -> None:
    """chrom start end gene, blank-separated, without a header."""
    gene.select(F.concat_ws(" ", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "gene").alias("value")).write.mode("overwrite").text(path)


def write_decisions(rows: DataFrame, path: str, by: str = "discordant") -> None:
    """A report with the most discordant first."""
    write_table(rows.orderBy(F.desc_nulls_last(by), *[c for c in rows.columns if c != by]), path)


def provisional_ref(variants: DataFrame, info: str = "info") -> bool:
    """Whether all variants carry PR among their INFO tokens; mixed files are refused."""
    has = F.array_contains(F.split(F.coalesce(F.col(info), F.lit("")), ";"), "PR")
    r = variants.agg(F.coalesce(F.bool_and(has), F.lit(False)).alias("all"), F.coalesce(F.bool_or(has), F.lit(False)).alias("any")).first()
    if r["any"] and not r["all"]:
        raise ValueError("some variants have a provisional reference allele, others don't")
    return r["all"]


def same_order(variants: DataFrame, others: DataFrame, index: str = "variant_idx", name: str = "id") -> DataFrame:
    """Places at which two variant lists differ, or that only one has; no row if they agree."""
    both = variants.select(index, F.col(name).alias("one")).join(others.select(index, F.col(name).alias("two")), index, "full")
    return both.filter(~F.col("one").eqNullSafe(F.col("two")))

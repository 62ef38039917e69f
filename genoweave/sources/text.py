"""Text sources and sinks of the pipeline's formats, as transformations of a column of lines.

Reading is spark.read.text (or csv), so compressed files and any Hadoop store work; here lines become typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value of each line; gzip and zstd files are opened by Hadoop's codecs."""
    return spark.read.text(path)


def tabbed_table(lines: DataFrame, columns: list[str], integers: tuple[str, ...] = (), skip: str = "##") -> DataFrame:
    """Tab-separated lines without comment lines: text columns, and whole numbers where named (null if they aren't)."""
    parts = F.split("value", "\t", -1)
    rows = lines.filter(~F.col("value").startswith(skip))
    return rows.select(*[cast_or_null(F.get(parts, F.lit(i))).alias(c) if c in integers else F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def cast_or_null(text: Column) -> Column:
    """A whole number, or null."""
    return text.try_cast("bigint")


def whitespace_tokens(text: Column, comment: str | None = "#") -> Column:
    """Fields between blanks, after an inline comment has gone; no empty ones."""
    body = F.regexp_replace(text, f"{comment}.*", "") if comment else text
    return F.filter(F.split(body, r"[ \t\n]+"), lambda x: x != "")


def gmt_fields(line: Column) -> tuple[Column, Column, Column]:
    """Name, url and members of a gene-set line."""
    parts = F.split(line, "\t", 3)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.split(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), "\t", -1)


def gmt_line(name: Column, url: Column, members: Column) -> Column:
    return F.concat_ws("\t", name, url, F.array_join(members, "\t"))


def recoded_pheno(code: Column) -> Column:
    """case for 2 or case, control for 1 or control, else missing."""
    code = F.lower(code.cast("string"))
    return F.when(code.isin("2", "case"), "case").when(code.isin("1", "control"), "control").otherwise("missing")


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, name for each column that holds 1."""
    return rows.unpivot([key], columns, "name", "hot").filter("hot = 1").select(key, "name")


def first_hot(columns: list[str], default: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in columns], F.lit(default))


def cell(value: Column) -> Column:
    """A workbook cell: nothing for null or NaN, inf and -inf as text, else the number."""
    return F.when(value.isNull() | F.isnan(value), "").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(F.format_string("%.6f", value))


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated files, one a partition."""
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_gmt(sets: DataFrame, path: str) -> None:
    """sets: name, url, members."""
    sets.select(gmt_line(F.col("name"), F.col("url"), F.col("members")).alias("value")).write.mode("overwrite").text(path)


def id_file(samples: DataFrame, path: str) -> None:
    """A keep list: #FID IID, or #IID where there is no family id."""
    cols = [F.col("fid").alias("#FID"), F.col("iid").alias("IID")] if "fid" in samples.columns else [F.col("iid").alias("#IID")]
    write_table(samples.select(*cols), path)

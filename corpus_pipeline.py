"""A corpus, from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.llm.common import held_out, labels, new_folder
from genoweave.llm.line_dedup import WHOLE, dedup_lines
from genoweave.llm.mixing import mixed_rows
from genoweave.llm.near_dup import near_duplicates
from genoweave.llm.packing import pack_documents
from genoweave.llm.queries import tokenizer_path
from genoweave.llm.toxicity import score_column, train

#: Documents with this toxicity score or more go.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the lexicon's weights from labelled documents that aren't held out; keeps the others' rows as they are."""
    lexicon = train(docs, labels(spark, sf_dir).filter(~held_out(4, 2)))
    return docs.filter(score_column(lexicon) < TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document that had lines and keeps none goes. n_chars follows the text."""
    rows = dedup_lines(docs, **WHOLE)
    rows = rows.filter((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " "))) > 0))
    return rows.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the weights 1, 2, 3, in turn; documents come up to three times, or not at all."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 token ids."""
    return pack_documents(docs, tokenizer_path(), end_id=0, length=1024)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned weights, min-hashes and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs

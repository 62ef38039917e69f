"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, labels, sample_ids


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    rows = kd_shards(documents(spark, sf_dir), n_leaves=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sketch as S

    rows = S.edited(S.fingerprints(documents(spark, sf_dir)))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), S.to_text(F.col("sketch")).alias("fingerprint"), S.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        S.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), S.resemblance(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )


def op3_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import read_shards, write_shards

    return read_shards(write_shards(documents(spark, sf_dir), tokenizer_path(), end_id=2))


def op4_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


#: Bound of the labelled rows that stand for the trusted target.
TRUSTED_ROWS = 20_000


def op5_log_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    trusted = sample_ids(labels(spark, sf_dir).filter("quality = 1"), TRUSTED_ROWS)
    rows = quality_rules(documents(spark, sf_dir), trusted)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_weighted_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as X

    docs, test = documents(spark, sf_dir), held_out(4, 2)
    rows = X.score(docs, X.train(docs, labels(spark, sf_dir).filter(~test)))
    return rows.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import text_crc32
    from .line_dedup import WHOLE, dedup_lines

    rows = dedup_lines(documents(spark, sf_dir), **WHOLE)
    return rows.select("doc_id", "n_lines", "n_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), text_crc32(F.col("text")).alias("kept_crc32"))


def op9_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    rows = pack_documents(documents(spark, sf_dir), tokenizer_path(), end_id=0, length=1024)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_crf as L

    docs, test = documents(spark, sf_dir), held_out(3, 1)
    rows = L.score(docs, L.train(docs, labels(spark, sf_dir).filter(~test)))
    return rows.select("doc_id", test.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_kd_tree_sharding": op1_kd_tree_sharding,
    "op2_bottom_k_sketch": op2_bottom_k_sketch,
    "op3_sorted_string_tables": op3_sorted_string_tables,
    "op4_multi_index_hamming": op4_multi_index_hamming,
    "op5_log_likelihood_ratio": op5_log_likelihood_ratio,
    "op6_weighted_lexicon": op6_weighted_lexicon,
    "op7_source_mixing": op7_source_mixing,
    "op8_deletion_neighbourhood": op8_deletion_neighbourhood,
    "op9_shortest_pack_first": op9_shortest_pack_first,
    "op10_line_crf": op10_line_crf,
}

SQL: dict[str, str] = {}

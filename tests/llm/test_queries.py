"""The queries on the smallest tables, and the pipeline against a brute-force version of its deterministic stages."""

import zlib

import pytest

import corpus_pipeline
from genoweave.llm.queries import QUERIES

COLUMNS = {
    "op1": "doc_id size text_crc32 law shard slot grown_shard", "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op3": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id n_shingles component_id kept", "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op6": "doc_id held_out score predicted",
    "op7": "doc_id size source_size target taken", "op8": "doc_id n_lines n_removed", "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert df.select("doc_id").distinct().count() == n


def test_held_out_rows(spark, sf):
    for name, m, rest in (("op6_weighted_lexicon", 4, 2), ("op10_line_crf", 3, 1)):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % m == rest) for r in QUERIES[name](spark, sf).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, label, least in (("op6_weighted_lexicon", "toxic", 0.9), ("op10_line_crf", "quality", 0.95)):
        rows = [r for r in QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in known]
        assert sum(r["predicted"] == known[r["doc_id"]][label] for r in rows) / len(rows) >= least


def test_pipeline(spark, sf):
    from tests.llm.test_operators import brute_lines, components_of

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").coalesce(1)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == docs.columns
    clean = clean.orderBy("doc_id").collect()
    assert len(clean) < docs.count()
    after = spark.createDataFrame(clean, docs.schema)
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in stages["line_dedup"](spark, after, sf).collect())
    texts = brute_lines([r["text"] for r in clean])
    want = [(r["doc_id"], t, len(t)) for r, t in zip(clean, texts, strict=True) if t == r["text"] or t.strip(" \t\n\x0b\x0c\r")]
    assert got == want
    rows = spark.createDataFrame([(i, t, "en", "a", n) for i, t, n in got], docs.schema)
    _, comp = components_of([t for _, t, _ in got])
    kept = [got[k][0] for k, c in enumerate(comp) if k == c]
    assert sorted(r["doc_id"] for r in stages["near_dedup"](spark, rows, sf).collect()) == kept
    mixed = stages["mixing"](spark, rows, sf)
    assert mixed.columns == docs.columns
    pieces = stages["packing"](spark, mixed, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed.select("doc_id").collect()}

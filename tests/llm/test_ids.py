"""Null and large ids: 2^53 + 1 has no double of its own."""

from genoweave.llm import line_crf, line_dedup, near_dup, packing, quality_rules, sstable, toxicity
from genoweave.llm.queries import tokenizer_path

BIG = (1 << 53) + 1


def test_ids_come_through(spark):
    rows = [(BIG, "one two three"), (None, "four five six"), (BIG + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(str(r[0]) for r in rows)
    none = spark.createDataFrame([], "doc_id long")
    found = {
        "op3": sstable.read_shards(sstable.write_shards(docs, tokenizer_path(), end_id=2)),
        "op4": near_dup.near_duplicates(docs),
        "op5": quality_rules.quality_rules(docs, none),
        "op6": toxicity.score(docs, toxicity.learn([], [])),
        "op8": line_dedup.dedup_lines(docs),
        "op9": packing.pack_documents(docs, tokenizer_path()),
        "op10": line_crf.score(docs, line_crf.learn([], [])),
    }
    for name, df in found.items():
        assert sorted(str(r["doc_id"]) for r in df.select("doc_id").collect()) == want, name


def test_long_words_and_phrases_take_linear_time():
    import time

    lexicon = toxicity.learn([], [])
    began = time.perf_counter()
    assert lexicon.score("a1" * 500_000) < 0.3
    assert lexicon.score("trash can " * 100_000) < 0.3
    assert lexicon.score("idiot " * 1000 + "trash can " * 1000) > 0.3
    assert time.perf_counter() - began < 10


def test_samples_are_bounded_by_rows(spark):
    from genoweave.llm.common import sample_texts

    docs = spark.createDataFrame([(i % 2, f"t{i}") for i in range(50)], "doc_id long, text string")
    known = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    rows = sample_texts(docs, known, "toxic", 10, "doc_id", "text").collect()
    assert len(rows) == 10 and sum(r["y"] for r in rows) == 5


def test_new_pretokens_are_asked_for_one_by_one():
    """Only unknown pre-tokens go through the model, once; long ones aren't remembered, and dropped ones come again."""
    from genoweave.llm.tokens import LONG, Encoder

    e = Encoder(tokenizer_path(), most=5)
    asked, own = [], e.cache.tokenize
    e.cache.tokenize = lambda s: asked.append(s) or own(s)
    long = "x" * (LONG + 1)
    texts = ["one two three", "one two four", f"one {long} two", "ça coûte 12, naïve été's  \n\t ~~ end", "one two three"]
    assert [e.whole(t) for t in texts] == list(e.encode(texts))
    assert asked[:4] == ["one", "Ġtwo", "Ġthree", "Ġfour"] and "Ġ" + long in asked
    assert max(map(len, e.cache)) <= LONG and asked.count("one") == 2

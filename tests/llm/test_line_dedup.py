"""Line de-duplication as the queries use it: all lines."""

import random

import corpus_pipeline
from genoweave.llm import line_dedup
from tests.llm.test_operators import brute_lines, distance, make, sentence


def test_lines_of_few_words(spark):
    rng = random.Random(21)
    texts = ["\n".join(sentence(rng, rng.randrange(0, 9), 4) for _ in range(6)) for _ in range(40)] + ["Les.\n\nLes.", "les.", None, ""]
    rows = line_dedup.dedup_lines(make(spark, [(i, t, "a") for i, t in enumerate(texts)]), **line_dedup.WHOLE).collect()
    assert {r["doc_id"]: r["text"] or "" for r in rows} == dict(enumerate(brute_lines(texts)))


def test_copies_with_a_short_line_leave_no_stub(spark):
    rng = random.Random(22)
    text = f"Les.\n{sentence(rng, 20, 900)}\n\nthe end\n{sentence(rng, 6, 900)}"
    docs = make(spark, [(i, text, "a") for i in range(3)])
    got = corpus_pipeline.line_dedup(spark, docs, "").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(0, text)]


def test_within_edits():
    rng = random.Random(23)
    for _ in range(2000):
        a, b = (sentence(rng, rng.randrange(12), 3).encode().split() for _ in range(2))
        for most in range(6):
            assert line_dedup.within_edits(a, b, most) == (distance(a, b) <= most)


def test_bound_grows_with_the_line(spark, monkeypatch):
    rng = random.Random(24)
    monkeypatch.setattr(line_dedup, "BLOCK", 7)  # several blocks an anchor
    passage = sentence(rng, 30, 10**6)  # in every line of a kind, so that anchors have many lines that aren't alike
    base = [f"{passage if i % 2 else ''} {sentence(rng, n, 10**6)}".split() for i, n in enumerate((32, 33, 40, 47, 64, 100, 200, 35))]
    texts = []
    for i in range(160):
        w = list(base[i % 8])
        for _ in range(rng.randrange(len(w) // 16 + 2)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind < 2)] = [f"z{rng.randrange(10**6)}"] * (kind > 0)
        texts.append(" ".join(w))
    want = brute_lines(texts)
    assert sum(map(bool, want)) < 100  # many differ by more than one word
    rows = line_dedup.dedup_lines(make(spark, [(i, t, "a") for i, t in enumerate(texts)]), **line_dedup.WHOLE).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(want))


def test_variants_of_many_lines_at_once():
    """Lines worked through together have the keys that they have alone, and those of the definition meet."""
    import numpy as np

    from genoweave.llm.line_dedup import variants

    lines = [b"a b c", b"a x c", b"a c", "é ü ç d e f g".encode(), b"one"]
    keys, roles, at = variants(lines, np.full(len(lines), 7, "int32"))
    together = sorted(zip(at.tolist(), roles.tolist(), keys.tolist(), strict=True))
    alone = [(i, r, k) for i, w in enumerate(lines) for k, r, _ in zip(*(x.tolist() for x in variants([w], np.array([7], "int32"))), strict=True)]
    assert together == sorted(alone)
    of = lambda i, role: {k for j, r, k in together if (j, r) == (i, role)}
    assert [len(of(i, 0)) for i in range(5)] == [3, 3, 2, 7, 1]
    assert len(of(0, 0) & of(1, 0)) == 1  # one word replaced
    assert of(2, 1) <= of(0, 2) and of(2, 1) <= of(1, 2) and not of(3, 1) & of(0, 2)  # one left out
    none = variants(lines, np.array([4, 0, 0, 0, 0], "int32"))
    assert none[1].tolist() == [0, 2, 1, 1, 1, 1, 1]


def lines_of_few_kinds(rng):
    """Lines with a common passage, some within the bound of each other, some with the same words in another order."""
    passage = sentence(rng, 30, 10**6).split()
    base = [[*passage, *sentence(rng, n, 10**6).split()] for n in (10, 12, 40, 70)]
    texts = []
    for i in range(120):
        w = list(base[i % 4])
        if i % 3 == 0:
            tail = w[30:]
            rng.shuffle(tail)
            w[30:] = tail
        for _ in range(rng.randrange(len(w) // 16 + 2)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at : at + (kind < 2)] = [f"z{rng.randrange(10**6)}"] * (kind > 0)
        texts.append(" ".join(w))
    return texts


def test_blocks_of_many_pairs(spark, monkeypatch):
    """Pairs of a block are written down or its lines are compared where they lie: the result is the same."""
    texts = lines_of_few_kinds(random.Random(25))
    want = dict(enumerate(brute_lines(texts)))
    for dense in (0, 10**6):
        monkeypatch.setattr(line_dedup, "DENSE", dense)
        rows = line_dedup.dedup_lines(make(spark, [(i, t, "a") for i, t in enumerate(texts)]), **line_dedup.WHOLE).collect()
        assert {r["doc_id"]: r["text"] for r in rows} == want


def test_lines_between_the_two_ways(spark):
    """Lines about 2 * edit_words words, of which the shorter ones have keys and the longer ones cells; one edit apart, or two."""
    rng = random.Random(26)
    texts = []
    for n in (30, 31, 32, 33, 34) * 4:
        w = sentence(rng, n, 10**6).split()
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(3)):
                at, kind = rng.randrange(len(v)), rng.randrange(3)
                v[at : at + (kind < 2)] = [f"z{rng.randrange(10**6)}"] * (kind > 0)
            texts.append(" ".join(v))
    rng.shuffle(texts)
    rows = line_dedup.dedup_lines(make(spark, [(i, t, "a") for i, t in enumerate(texts)]), **line_dedup.WHOLE).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(brute_lines(texts)))


def test_later_copies_that_pass_a_filter(spark, monkeypatch):
    """All lines pass the filters: a later copy of a line counts for nothing, so its first one isn't taken for near to a line between them."""
    import numpy as np

    monkeypatch.setattr(line_dedup, "bloom", lambda keys, column: (np.full(64, -1, "int64").view("uint64"), 4096))
    texts = ["one two three four", "one two six four", "one two three four", "one two six four"]
    rows = line_dedup.dedup_lines(make(spark, [(i, t, "a") for i, t in enumerate(texts)]), **line_dedup.WHOLE).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(brute_lines(texts)))


def test_one_line_in_many_documents_is_one_row_of_a_part(spark):
    """What a batch sends of a common line, or of a key with many lines, doesn't grow with their number."""
    import numpy as np

    from genoweave.llm import parts

    docs = make(spark, [(i, f"the same line here\nkeep this word w{i}", "a") for i in range(500)]).coalesce(1)
    lines = line_dedup.written(line_dedup.line_table(docs, "doc_id", "text", 1, 3, 16), "test-lines")
    assert lines.selectExpr("sum(n_lines)", "sum(n_keys)", "sum(n_cells)").first()[:] == (1000, 1000, 0)
    assert line_dedup.repeats(lines, 16).count() == 499
    mixed = np.arange(500, dtype="uint64") << np.uint64(53)
    assert parts.dealt(mixed, [mixed, mixed], 16).num_rows <= 16
    h = np.arange(500, dtype="uint64")
    key, least, most = parts.least_and_most(np.full(500, 7, "uint64"), h)
    assert (key.tolist(), least.tolist(), most.tolist()) == ([7], [0], [499])

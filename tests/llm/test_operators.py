"""Every dealt operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoweave.llm import line_crf, line_dedup, mixing, near_dup, packing, quality_rules, sharding, sketch, sstable, tokens, toxicity
from genoweave.llm.common import numbered
from genoweave.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, node long, key string"


def make(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 8, 9, "k") for i, t, s in rows], SCHEMA)


def sentence(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [sentence(rng, 60, 5000) for _ in range(12)]
    out = [base[i % 12] if i < 24 else " ".join(w if rng.random() > 0.02 else "zz" for w in base[i % 12].split()) for i in range(48)]
    texts = [*out, None, "", " \n\t ", "one", "one two", "ONE two", "a b c d e", "é ü ß", sentence(rng, 30_000, 900), "x" * 50_000, "same line of eight words is here now\nother text", "same line of eight words was here now\nmore"]
    return [(i, t, [None, "a", "b", "b"][i % 4]) for i, t in enumerate(texts)] + [(3, "repeated id", "a"), (3, "repeated id", "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [(1, "x", "a")]).limit(0)


def test_numbering_has_no_gaps(spark):
    df = spark.createDataFrame([(1 if i % 3 else 2, i) for i in range(300)], "g int, k long")
    got = numbered(df, ["g"], "k", "n", 8).collect()
    for g in (1, 2):
        assert sorted(r["n"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))


def test_sharding(docs, rows, empty):
    got = sharding.kd_shards(docs, n_leaves=4).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert sorted(r["text_crc32"] for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t, _ in rows)
    for s in {r["shard"] for r in got}:
        slots = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.kd_shards(empty, n_leaves=4).count() == 0


def test_shards_are_even_and_keep_copies_together(spark):
    rng = random.Random(2)
    texts = ["copy " * 20] * 300 + [sentence(rng, rng.randrange(3, 40)) for _ in range(900)]
    got = sharding.kd_shards(make(spark, [(i, t, f"s{i % 5}") for i, t in enumerate(texts)]), n_leaves=8).collect()
    size = np.zeros(8)
    for r in got:
        size[r["shard"]] += r["size"]
    assert size.max() / size.mean() < 1.05
    of_text = {}
    for r in got:
        of_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(v) > 1 for v in of_text.values()) <= 7


def brute_shingles(text):
    w = WORD((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketch(docs, rows, empty):
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0], r[1]))
    got = sketch.edited(sketch.fingerprints(docs)).orderBy("doc_id", "text").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == ordered
    for k, r in enumerate(got):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(r["text"])
        assert r["edited"] == r["text"][: n - n // 4] + after[: n // 4]
        assert len(r["sketch"]) == min(sketch.K, len(brute_shingles(r["text"])))
    assert sketch.fingerprints(empty).count() == 0


def test_sketch_estimates_and_merges(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    s = lambda c: sketch.sketch(F.col(c))
    df = spark.createDataFrame([(a, b, " ".join(words[:1004]), " ".join(words[1000:2000]))], "a string, b string, p string, q string")
    r = df.select(sketch.resemblance(s("a"), s("b")).alias("j"), sketch.containment(s("a"), s("b")).alias("c"), sketch.distinct_shingles(s("a")).alias("n"), (sketch.merge(s("p"), s("q")) == s("a")).alias("m"), (sketch.from_text(sketch.to_text(s("a"))) == s("a")).alias("t")).first()
    assert abs(r["j"] - 1 / 3) < 0.12 and abs(r["c"] - 0.5) < 0.17 and abs(r["n"] / 1996 - 1) < 0.3
    assert r["m"] and r["t"]


def test_encoder_agrees_with_the_library():
    e = tokens.encoder(tokenizer_path())
    for c in map(chr, range(1, 0x2100)):
        if not e.other(c):
            for s in (f"a{c}b", f" {c}", c + c, f"1{c}2", f". {c} .", f"{c} a", f" {c}a{c}1{c}'s"):
                assert next(iter(e.encode([s]))) == e.whole(s), (hex(ord(c)), s)
    assert list(e.encode(["<|endoftext|> x y", None, ""])) == [e.whole("<|endoftext|> x y"), b"", b""]


def ids_of(text):
    e = tokens.encoder(tokenizer_path())
    return np.frombuffer(e.whole(text or ""), f"<u{e.width}").tolist()


def test_sstable(docs, rows, empty):
    manifest = sstable.write_shards(docs, tokenizer_path(), 2, n_shards=3)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["start"]) for r in sstable.read_shards(manifest).collect())
    want = [(i, [*ids_of(t), 2]) for i, t, _ in rows]
    assert sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want) == sorted(g[:3] for g in got)
    at = 0
    for _, n, _, start in sorted(got, key=lambda g: g[3]):
        assert start == at
        at += n
    assert [g[0] for g in sorted(got, key=lambda g: g[3])] == sorted(i for i, _, _ in rows)
    assert sstable.look_up(manifest, 51) == [*ids_of("one"), 2] and sstable.look_up(manifest, 10**9) is None
    assert sstable.read_shards(sstable.write_shards(empty, tokenizer_path(), 2)).count() == 0


def test_sstable_blocks_and_damage():
    f = io.BytesIO()
    w = sstable.Writer(f, 2)
    keys = [sstable.key_bytes(None), *[sstable.key_bytes(i) for i in range(-5, 20_000)]]
    for k in keys:
        w.add(k, k[-2:] * 10)
    w.close()
    r = sstable.Reader(io.BytesIO(f.getvalue()))
    assert len(r.place) > 1 and [k for k, _ in r] == keys and keys == sorted(keys)
    assert r.get(sstable.key_bytes(77)) == sstable.key_bytes(77)[-2:] * 10 and r.get(sstable.key_bytes(10**7)) is None
    with pytest.raises(ValueError, match="ascend"):
        sstable.Writer(io.BytesIO(), 2).add(b"", b"") or w.add(keys[0], b"")
    bad = bytearray(f.getvalue())
    bad[-100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        sstable.Reader(io.BytesIO(bytes(bad)))


def components_of(texts):
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return sets, [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, rows, empty):
    rows = rows[:60]
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(make(spark, rows)).collect()}
    sets, comp = components_of([t for _, t, _ in rows])
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(comp))
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (i == comp[i]) for i, r in got.items())
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_hot_group(spark, monkeypatch):
    """A base, many copies that link to it or to few others: links inside one key's group, over several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(9)
    base = sentence(rng, 100, 10**6).split()
    texts = [" ".join(base)]
    for _ in range(40):
        w = list(base)
        for i in rng.sample(range(100), rng.choice([2, 3, 4])):
            w[i] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    _, comp = components_of(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(make(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(comp))


def test_keys_find_all_pairs_within_the_guaranteed_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (1, near_dup.SYMBOLS)).astype("u2")
    for _ in range(300):
        b = a.copy()
        b[0, rng.choice(near_dup.SYMBOLS, 2 * near_dup.CHUNKS - 1, replace=False)] ^= 1
        shared = np.flatnonzero(near_dup.keys_of(a)[0] == near_dup.keys_of(b)[0])
        assert len(shared) and near_dup.first_shared_slot(a, b)[0] == shared[0]


def brute_base(text):
    w = WORD(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORD(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, empty, spark):
    trusted = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = quality_rules.quality_rules(docs, trusted).collect()
    key = lambda r: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
    assert sorted(map(key, got)) == sorted(brute_base(t or "") for _, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(empty, trusted).count() == 0


@pytest.mark.parametrize("text", ["a b c d e f g h\na b c d e f g h", "x # * <y>\n\nx # * <y>\nz", "é é é é é é é é é é", "a\x0bb\x85c"])
def test_base_figures(text):
    words = quality_rules._word(text)
    assert quality_rules.base_figures(text, words, quality_rules.Features().hashes(words)[0]) == brute_base(text)


def test_quality_rules_reject_junk(spark):
    rng = random.Random(3)
    clean = [(i, sentence(rng, 80, 400).replace("w", "wordy"), "a") for i in range(60)]
    junk = [(100 + i, " ".join(f"{w}***" for w in sentence(rng, 80, 400).split()), "a") for i in range(6)]
    got = quality_rules.quality_rules(make(spark, clean + junk), spark.createDataFrame([(i,) for i in range(40)], "doc_id long"))
    assert {r["doc_id"] for r in got.filter("kept").collect()} == set(range(60))


def test_lexicon():
    lexicon = toxicity.Lexicon({"idiot*": 4.0, "trash": 3.0, "moron*": 4.0})
    weight = lambda t: lexicon.weight(t)[0]
    assert weight("You IDIOTS!") == 4 and weight("іdiоt") == 4 and weight("1d10t") == 4  # Cyrillic letters, digits
    assert weight("the trash can is full") == 0 and weight("trashy") == 0 and weight("oxymoronic") == 0
    assert weight("trash, trash can") == 3 and weight("") == 0
    assert lexicon.score("moron") > lexicon.score("fine") == lexicon.score("")


def test_lexicon_is_learned_and_scores_all_rows(spark, docs, rows, empty):
    rng = random.Random(6)
    texts = [sentence(rng, 50) for _ in range(120)]
    toxic = [i % 4 == 0 for i in range(120)]
    texts = [t + f" blargo{i % 7} idiot" * y for i, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    lexicon = toxicity.learn(texts, [int(y) for y in toxic])
    assert any(e.startswith("blarg") or e.startswith("idiot") for e in lexicon.weights)
    assert all((lexicon.score(t) >= 0.3) == y for t, y in zip(texts, toxic, strict=True))
    scores = [r["score"] for r in toxicity.score(docs, lexicon).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(empty, lexicon).count() == 0
    assert toxicity.learn([], []).score("x") < 0.3


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _, _ in rows)
    assert sum(r["size"] for r in got) == sum(len(WORD(t or "")) for _, t, _ in rows)
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_targets_and_thresholds(spark):
    rng = random.Random(8)
    texts = [(i, sentence(rng, rng.randrange(1, 30)), "a" if i % 50 == 0 else "b" if i % 3 == 0 else None) for i in range(3000)]
    got = mixing.mix(make(spark, texts)).collect()
    size = {s: sum(r["size"] for r in got if r["source"] == s) for s in ("a", "b", None)}
    total, weight, full = sum(size.values()), {"a": 1, "b": 2, None: 3}, set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in weight if x not in full) for s in size}
        over = {s for s in size if s not in full and share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in size:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(share[s]) and own[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in own) - share[s]) <= 30


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike_lines(a, b, near_words=3, edit_words=16):
    """Equal, or from three words on within one word edit, or one for each 16 words of the shorter line."""
    if a == b:
        return True
    n = min(len(a), len(b))
    most = max(1, n // edit_words)
    return n >= near_words and abs(len(a) - len(b)) <= most and len(set(a) ^ set(b)) <= 2 * most and distance(a, b) <= most


def brute_lines(texts):
    seen, out = [], []
    for t in texts:
        keep = []
        for line in (t or "").split("\n"):
            w = line.encode().lower().split()
            if not (w and any(alike_lines(w, o) for o in seen)):
                keep.append(line)
            if w and w not in seen:
                seen.append(w)
        out.append("\n".join(keep))
    return out


def test_line_dedup(spark, rows, empty):
    rows = rows[:60]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(make(spark, rows)).collect()}
    assert {i: r["text"] or "" for i, r in got.items()} == dict(enumerate(brute_lines([t for _, t, _ in rows])))
    assert got[48]["text"] is None and got[48]["n_lines"] == 0 and got[0]["key"] == "k"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_of_one_template(spark):
    rng = random.Random(5)
    line = sentence(rng, 12, 10**6).split()
    texts = []
    for i in range(80):
        w = list(line)
        k = rng.randrange(4)
        if k == 0:
            w[rng.randrange(12)] = f"z{i}"
        elif k == 1:
            w.insert(rng.randrange(13), f"z{i}")
        elif k == 2:
            del w[rng.randrange(12)]
        texts.append(" ".join(w) + "\n" + sentence(rng, rng.randrange(3, 12), 10**6))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(brute_lines(texts)))


def test_one_edit():
    e = lambda a, b: line_dedup.within_one_edit(a.encode().split(), b.encode().split())
    assert e("a b c", "a b c") and e("a b c", "a x c") and e("a b c", "a b") and e("b c", "a b c")
    assert not e("a b c", "c b a") and not e("a b c d", "b c d a") and not e("a", "a b c")


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, tokenizer_path(), 0, 64).collect()
    want = sorted([*ids_of(t), 0] for _, t, _ in rows)
    assert sum(r["length"] for r in got) == sum(map(len, want))
    per = {}
    for r in got:
        per.setdefault(r["sequence_id"], []).append(r)
    assert sorted(per) == list(range(len(per)))
    for pieces in per.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    of_doc = {i: [*ids_of(t), 0] for i, t, _ in rows if i != 3}
    for r in got:
        if r["doc_id"] != 3:
            own = of_doc[r["doc_id"]]
            assert r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack_documents(empty, tokenizer_path(), 0, 64).count() == 0


def test_histogram_packing():
    rng = random.Random(1)
    for draw in (lambda: rng.randint(1, 1023), lambda: rng.choice([600, 700, 20, 1000]), lambda: 513, lambda: rng.randint(500, 900)):
        counts = {}
        for _ in range(5000):
            n = draw()
            counts[n] = counts.get(n, 0) + 1
        _, patterns = packing.choose_cut(counts, 1024)
        total = sum(k * n for k, n in counts.items())
        assert sum(sum(p) * n for p, n in patterns) == total and max(sum(p) for p, _ in patterns) <= 1024
        assert 1 - total / (1024 * sum(n for _, n in patterns)) <= packing.PADDING


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        emit, trans = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {y: np.exp(sum(emit[i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product((0, 1), repeat=n)}
        want = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(n)]
        assert line_crf.marginals(emit, trans) == pytest.approx(want)
        p, pairs, log_z = line_crf._Chains([n]).run(emit, trans)
        assert p == pytest.approx(want) and log_z == pytest.approx(np.log(sum(weight.values()))) and pairs.sum() == pytest.approx(n - 1)


def test_line_crf(docs, rows, empty):
    rng = random.Random(2)
    good = ["\n".join(sentence(rng, 12) + "." for _ in range(4)) for _ in range(60)]
    bad = ["\n".join(" ".join(f"{w}$$$" for w in sentence(rng, 12).split()) for _ in range(4)) for _ in range(30)]
    model = line_crf.learn(good[:40] + bad[:20], [1] * 40 + [0] * 20)
    assert all(model.score(t) >= 0.5 for t in good[40:]) and all(model.score(t) < 0.5 for t in bad[20:])
    scores = [r["score"] for r in line_crf.score(docs, model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert line_crf.score(empty, model).count() == 0
    assert 0 <= line_crf.learn([], []).score("x") <= 1

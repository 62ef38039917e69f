import random

from genoweave.operators import meeting as M
from genoweave.operators import sets as G


def _sets():
    rng = random.Random(3)
    sets = {k: set(rng.sample(range(k % 5 * 50, k % 5 * 50 + 60), rng.randint(1, 30))) | {"common"} for k in range(150)}
    sets |= {k: sets[k - 200] for k in range(200, 230)}  # copies
    return sets | {300: {"own", 1, "common"}, 301: {"other", 1, "common"}}  # equal but for an item of each


def _rows(spark, sets):
    return spark.createDataFrame([(k, str(i)) for k, s in sets.items() for i in s] + [(0, "common")], "k long, i string")


def test_similar_pairs_in_blocks(spark, monkeypatch):
    """All pairs that reach the cut-off, over several blocks, by bits and by postings, without a row for each common item of a pair."""
    monkeypatch.setattr(M, "blocks", lambda rows: 3)
    sets = _sets()
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.2}
    got = G.similar_pairs(_rows(spark, sets), "k", "i", 0.2)
    assert {(r["a"], r["b"], r["inter"]) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    every = {(a, b) for a in sets for b in sets if a < b}  # all have the common item
    assert {(r["a"], r["b"]) for r in G.similar_pairs(_rows(spark, sets), "k", "i").collect()} == every


def test_greedy_distinct_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "blocks", lambda rows: 3)
    sets = _sets()
    test = {"jaccard": lambda a, b: len(a & b) / len(a | b) >= 0.5, "overlap": lambda a, b: len(a & b) / min(len(a), len(b)) >= 0.5}
    test["either"] = lambda a, b: test["jaccard"](a, b) or test["overlap"](a, b)
    for mode, alike in test.items():
        kept = []
        for k in sorted(sets, key=lambda k: (len(sets[k]), k)):
            if not any(alike(sets[k], sets[o]) for o in kept):
                kept.append(k)
        assert sorted(r["k"] for r in G.greedy_distinct(_rows(spark, sets), "k", "i", mode).collect()) == sorted(kept)

import itertools
import random

import pytest

from genoweave.operators import fdr as D
from genoweave.operators import modules as M
from genoweave.operators import network as N
from genoweave.operators import permute as P
from genoweave.operators import report as R
from genoweave.operators import sets as G


@pytest.fixture(scope="module")
def cohort(spark):
    rng = random.Random(7)
    dosage = {(s, v): rng.choice([0, 0, 1, 2]) for s in range(24) for v in range(8)}
    pheno = {s: int(s < 10) for s in range(24)}
    g = spark.createDataFrame([(s, v, d) for (s, v), d in dosage.items() if d], "sample_id long, variant_idx long, dosage int")
    s = spark.createDataFrame([(k, p, k % 3) for k, p in pheno.items()], "sample_id long, pheno int, cluster int")
    return dosage, pheno, g, s


def test_pair_counts_and_cells(cohort):
    dosage, pheno, g, s = cohort
    own = N.carriers(g, s, "D")
    m = N.marginals(own)
    cells = N.contingency(N.pair_counts(own, own, True), m, m, N.totals(s)).collect()
    for r in cells:
        both = [k for k in pheno if dosage[k, r["u"]] and dosage[k, r["v"]]]
        assert (r["g11"], r["x11"]) == (len(both), sum(pheno[k] for k in both))
        assert r["g11"] + r["g10"] + r["g01"] + r["g00"] == 24
        assert r["x11"] + r["x10"] + r["x01"] + r["x00"] == 10
    assert {tuple(r) for r in N.pair_counts_blocked(own, 8, block=3, sample_block=5).collect()} == {tuple(r) for r in N.pair_counts(own, own, True).collect()}


def test_combined_ties(spark):
    e = lambda *rows: spark.createDataFrame(rows, "u long, v long, score double")
    got = N.combined(e((1, 0, 2.0), (2, 0, 1.0), (3, 0, 3.0)), e((1, 0, 2.0), (2, 0, 0.5)), e((1, 0, 2.0), (2, 0, 1.0), (3, 0, 4.0)))
    assert {(r["u"], r["max_id"]) for r in got.collect()} == {(1, 2), (2, 1), (3, 3)}


def test_density_cutoff_counts_unstored_zeros(spark):
    import numpy as np

    e = spark.createDataFrame([(1, 0, 3.0), (2, 0, 1.0), (2, 1, 1.0)], "u long, v long, score double")
    dense = np.zeros((5, 5))
    for u, v, x in ((1, 0, 3.0), (2, 0, 1.0), (2, 1, 1.0)):
        dense[u, v] = dense[v, u] = x
    for keep in (0.05, 0.1, 0.2, 0.5):
        assert N.density_cutoff(e, 5, keep).first()[0] == pytest.approx(np.quantile(dense, 1 - keep))


def test_block_sums_agree(spark):
    rng = random.Random(3)
    e = spark.createDataFrame([(u, v, rng.randint(1, 9)) for u, v in itertools.combinations(range(14), 2) if rng.random() < 0.5], "v long, u long, score long")
    member = spark.createDataFrame([(p, v) for p in range(4) for v in range(14) if rng.random() < 0.7], "pathway_id int, variant_idx long")
    bpm = G.bpm_sets(G.wpm_sets(member, 1), 1)
    assert sorted(M.bpm_block_sum(e, bpm).collect()) == sorted(M.bpm_block_sum_ie(e, member, bpm).collect())


def test_permutations_do_not_depend_on_partitions(spark):
    v = spark.range(20).withColumnRenamed("id", "variant_idx")
    for source in ("hash", "numpy"):
        a = sorted(P.permuted_variants(v, 4, source).collect())
        assert a == sorted(P.permuted_variants(v.repartition(7), 4, source).collect())
        assert all(sorted(r["q"] for r in a if r["k"] == k) == list(range(20)) for k in range(1, 5))


def test_cluster_permutation_keeps_case_counts(cohort):
    _, _, _, s = cohort
    count = lambda d: {r["cluster"]: r[1] for r in d.groupBy("cluster").sum("pheno").collect()}
    assert count(s) == count(P.permuted_phenotypes(s, 3, True))


def test_fdr_against_brute_force(spark):
    rng = random.Random(5)
    pts = [(r, m, rng.randint(1, 20) / 100, float(rng.randint(0, 6))) for r in range(3) for m in range(25)]
    got = {r["module"]: (r["fdr1"], r["fdr2"]) for r in D.fdr(spark.createDataFrame(pts, "r int, module long, pv double, s double"), 0.1, 2).collect()}
    real = [p for p in pts if p[0] == 0]
    raw = {}
    for _, m, pv, s in real:
        if pv <= 0.1:
            n = lambda f: sum(f(p) for p in pts if p[2] <= pv)  # noqa: B023, E731
            m1, m2 = n(lambda p: p[0] == 0), n(lambda p: p[0] > 0)
            n1, n2 = n(lambda p: p[0] == 0 and p[3] >= s), n(lambda p: p[0] > 0 and p[3] >= s)  # noqa: B023
            raw[m] = (pv, s, m2 / (2 * m1), n2 / (2 * n1))
    for _, m, _, _ in real:
        if m not in raw:
            assert got[m] == (1.0, 1.0)
            continue
        pv, s, *_ = raw[m]
        assert got[m][0] == pytest.approx(min(f1 for p, _, f1, _ in raw.values() if p >= pv))
        assert got[m][1] == pytest.approx(min(f2 for p, q, _, f2 in raw.values() if p >= pv and q <= s))


def test_greedy_groups_are_not_components(spark):
    modules = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)], "module long, fdr double")
    similar = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r["module"]: r["grp"] for r in R.redundancy_groups(modules, similar).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_greedy_sets(spark):
    sets = {1: "abcd", 2: "abce", 3: "xyz", 4: "abcdef", 5: "xyzw"}
    rows = spark.createDataFrame([(k, c) for k, w in sets.items() for c in w], "k long, i string")
    assert sorted(r["k"] for r in G.greedy_distinct(rows, "k", "i").collect()) == [1, 3]


def test_missing_never_passes(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, float("nan")), (3, None)], "module long, fdr double")
    assert R.discovery_summary(rows).first()["n_05"] == 1


def test_pair_counts_from_lists_of_carriers(spark, cohort):
    _, _, g, s = cohort
    own = N.carriers(g, s, "D")
    wanted = {tuple(r) for r in N.pair_counts(own, own, True).collect()}
    far = own.withColumn("sample_id", own["sample_id"] * 1_000_003)
    for rows, blocks, cells in ((own, 1, 1000), (own, 3, 2), (far, 2, 5)):
        assert {tuple(r) for r in N.pair_counts_listed(rows, blocks, cells).collect()} == wanted


def test_large_sparse_cohorts_are_counted_without_a_join(cohort, monkeypatch):
    _, _, g, s = cohort
    monkeypatch.setattr(N, "JOINED", 0)
    monkeypatch.setattr(N, "PRODUCTS_A_ROW", 0)
    monkeypatch.setattr(N.M, "blocks", lambda n: 1)
    plan = N.pair_counts_of(N.carrier_table(g, s), "DD", 24, 8)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_rank_sums_of_pathway_pairs(spark, monkeypatch):
    """One pass over marked edges gives what each pair's own lists give, with ties within and across ranges and batches."""
    from genoweave.operators import set_pairs as T

    rng = random.Random(3)
    e = spark.createDataFrame([(u, v, rng.choice([1, 2, 2, 3, 5, 9, 12])) for u in range(40) for v in range(u) if rng.random() < 0.3], "u long, v long, score long").repartition(3)
    member = spark.createDataFrame([(p, v) for p in (2, 3, 7, 8, 11) for v in sorted(rng.sample(range(38), 12))], "pathway_id int, variant_idx long")
    wpm = G.wpm_sets(member)
    chosen = M.dense_side(M.bpm_chi2(e.withColumn("score", e["score"] * 0 + 1.0), wpm, 40))
    lists = G.bpm_sets(wpm).join(chosen.select("path1", "path2", "dense_index"), ["path1", "path2"])
    lists = lists.selectExpr("path1", "path2", "if(dense_index = 2, ind2, ind1) AS rows", "if(dense_index = 2, ind1, ind2) AS cols")
    wanted = sorted(M.rank_sums(e, lists, ["path1", "path2"], "rows", "cols", 40).collect())
    assert len(wanted) == 10
    for cells, size in ((T.CELLS, T.RANGE), (1, 10)):
        monkeypatch.setattr(T, "CELLS", cells)
        monkeypatch.setattr(T, "RANGE", size)
        assert sorted(M.bpm_rank_sums(e, wpm, chosen, 40).collect()) == wanted


def test_open_levels_of_ranks():
    """A level that goes on over several batches counts as one."""
    import numpy as np

    from genoweave.operators import set_pairs as T

    rng = np.random.default_rng(5)
    score = np.sort(rng.integers(0, 6, 300))
    u, v = rng.random((300, 4)) < 0.4, rng.random((300, 4)) < 0.4
    wanted = ~np.eye(4, dtype=bool)
    found = []
    for step in (300, 7, 1):
        ranks = T._Ranks(wanted)
        for lo in range(0, 300, step):
            ranks.add(score[lo : lo + step], u[lo : lo + step], v[lo : lo + step])
        ranks.close()
        found.append([x.tolist() for x in (ranks.below, ranks.ranked2, ranks.stored, ranks.sums, ranks.ties)])
    assert found[0] == found[1] == found[2]

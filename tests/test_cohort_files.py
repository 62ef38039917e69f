import pytest

from genoweave.sources import cohort_files as X


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_samples_and_populations(spark, tmp_path):
    s = X.read_samples(spark, put(tmp_path, "a.psam", "##x\n#FID\tIID\tSEX\tPHENO1\nf\ta\t1\t2\nf\tb\tNA\t1\nf\tc\t2\t-9\n"))
    assert rows(s) == [("f", "a", 1, "case"), ("f", "b", None, "control"), ("f", "c", 2, "missing")]
    pops = X.read_populations(spark, put(tmp_path, "pops", "FID IID POP # header\nf a X\nf b Y\n"))
    assert rows(X.of_populations(s, pops, ["X"])) == [("f", "a", 1, "case")]
    assert rows(X.of_populations(s.drop("fid"), pops, ["Y"])) == [("b", None, "control")]
    assert ("X", 1) in rows(X.population_counts(pops))
    with pytest.raises(ValueError):
        X.read_samples(spark, put(tmp_path, "b.psam", "f\ta\n"))


def test_variants_of_both_kinds(spark, tmp_path):
    a = X.read_variants(spark, put(tmp_path, "v.pvar", "##x\n#CHROM\tPOS\tID\tREF\tALT\n1\t10\trs1\tA\tG\n"))
    b = X.read_variants(spark, put(tmp_path, "v.bim", "1 rs1 0 10 G A\n"))
    assert rows(a) == rows(b) == [("1", 10, "rs1", "A", "G")]


def test_components_scores_and_kinship(spark, tmp_path):
    pc = put(tmp_path, "e.eigenvec", "#IID PC2 PC10 PC1\na 2 10 1\n")
    assert rows(X.read_components(spark, pc, 2)) == [("a", [1.0, 2.0])]
    with pytest.raises(ValueError):
        X.read_components(spark, pc, 4)
    assert X.read_eigenvalues(spark, put(tmp_path, "e.eigenval", "3\n2\n1\n"), 2) == [3.0, 2.0]
    assert rows(X.read_scores(spark, put(tmp_path, "s.sscore", "#IID PC1_AVG PC2_AVG\na .5 1\n"))) == [("a", [0.5, 1.0])]
    assert rows(X.read_coordinates(spark, put(tmp_path, "c.mds", "#FID IID C1 C2\nf a 1 2\n"))) == [("f", "a", 1.0, 2.0)]
    kin = put(tmp_path, "k.kin0", "#IID1 IID2 KINSHIP\na b 0.2\na c 0.01\n")
    assert rows(X.read_kinship(spark, kin, 0.1)) == [("a", "b", 0.2)]


def test_sinks(spark, tmp_path):
    net = spark.createDataFrame([(1, 0, 2.5)], "u long, v long, score double")
    X.write_network(net, str(tmp_path / "net"))
    assert rows(X.read_network(spark, str(tmp_path / "net"))) == [(1, 0, 2.5)]
    X.require_files(spark, str(tmp_path / "net"))
    with pytest.raises(FileNotFoundError):
        X.require_files(spark, str(tmp_path / "no"))
    X.write_pairs(spark.createDataFrame([(2, 1, 0.25)], "case long, control long, dist double"), str(tmp_path / "pairs"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "pairs")).collect()] == ["CASE\tCONTROL\tDIST", "2\t1\t0.250000"]
    X.write_gene_windows(spark.createDataFrame([("1", 5, 9, "G")], "chrom string, start long, end long, gene string"), str(tmp_path / "bed"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bed")).collect()] == ["1 5 9 G"]


def test_provisional_reference_and_order(spark):
    v = spark.createDataFrame([(0, "a", "PR;X"), (1, "b", "PR")], "variant_idx long, id string, info string")
    assert X.provisional_ref(v)
    with pytest.raises(ValueError):
        X.provisional_ref(v.union(spark.createDataFrame([(2, "c", "X")], v.schema)))
    assert X.same_order(v, v).count() == 0
    assert rows(X.same_order(v, v.filter("id = 'a'"))) == [(1, "b", None)]

"""Queries: false discovery rates, reports, cohort building."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import cohort as C
from ..operators import fdr as D
from ..operators import report as R
from ..operators import sets as G

from .q_network import _six, bpm, edges, wpm
from .registry import SQL, query, with_views
from .views import tail_sql


@query("fdr_dominance_counts", "dom", "SELECT * FROM dom")
def _(t):
    return D.dominance_counts(t.score_point, 0.05)


@query("fdr_suffix_min", "raw", "SELECT module, pv, round((SELECT min(raw1) FROM raw b WHERE b.pv >= a.pv), 6) AS fdr1 FROM raw a")
def _(t):
    return _six(D.suffix_min(D.ratios(D.dominance_counts(t.score_point, 0.05), 6), "raw1", "fdr1").select("module", "pv", "fdr1"), "fdr1")


@query("fdr_dominance_min", "raw", "SELECT module, pv, s, round((SELECT min(raw2) FROM raw b WHERE b.pv >= a.pv AND b.s <= a.s), 6) AS fdr2 FROM raw a")
def _(t):
    return _six(D.dominance_min(D.ratios(D.dominance_counts(t.score_point, 0.05), 6), "raw2", "fdr2").select("module", "pv", "s", "fdr2"), "fdr2")


_FDR = "SELECT module, r.pv, r.s, round(coalesce((SELECT min(raw1) FROM raw b WHERE b.pv >= a.pv), 1.0), 6) AS fdr1, round(coalesce((SELECT min(raw2) FROM raw b WHERE b.pv >= a.pv AND {k}), 1.0), 6) AS fdr2 FROM real r LEFT JOIN (SELECT module, pv, s FROM raw) a USING (module)"


def _fdr(name, rounded, key):
    @query(name, "raw real", _FDR.format(k=key))
    def _(t):
        return _six(D.fdr(t.score_point, 0.05, 6, rounded), "fdr1", "fdr2")


_fdr("fdr_case1", False, "b.s <= a.s")
_fdr("fdr_case2", True, "round_even(b.s, 0) <= round_even(a.s, 0)")

_TABLE = "SELECT module, pv, s, (CAST(s * 100 AS BIGINT) % 60) / 100.0::DOUBLE AS fdr FROM real"


def _table(t):
    fdr = ((F.round(F.col("s") * 100)).cast("long") % 60) / 100.0
    return t.score_point.filter("r = 0").select("module", "pv", "s", fdr.alias("fdr"))


@query("stack_effects", "point", "SELECT module, pv, 'protective' AS effect FROM point WHERE r = 0 UNION ALL SELECT module + (SELECT count(*) FROM supplier), pv, 'risk' FROM point WHERE r = 1")
def _(t):
    p = t.score_point
    return R.stacked(p.filter("r = 0").select("module", "pv"), p.filter("r = 1").select("module", "pv"), t.n_variants)


@query("result_table_sorted", "real", f"SELECT *, row_number() OVER (ORDER BY fdr, pv, s DESC, module) - 1 AS place FROM ({_TABLE})")
def _(t):
    return R.sorted_table(_table(t))


@query("discovery_summary", "real", f"SELECT min(fdr) AS min_fdr, {', '.join(f'count(*) FILTER (fdr <= {0.05 * k:.2f}) AS n_{5 * k:02d}' for k in range(1, 6))} FROM ({_TABLE})")
def _(t):
    return R.discovery_summary(_table(t))


@query("group_representatives", "real", f"SELECT module % 10 AS grp, arg_min(module, fdr * 1e6 + module) AS module, min(fdr) AS fdr FROM ({_TABLE}) GROUP BY 1")
def _(t):
    return R.group_representatives(_table(t).withColumn("grp", F.col("module") % 10))


_LABEL = "SELECT m.pathway_id, m.variant_idx, coalesce(g, '/') AS genes FROM member m LEFT JOIN (SELECT m.pathway_id, m.variant_idx, string_agg(DISTINCT gs.gene, '/' ORDER BY gs.gene) AS g FROM member m JOIN variant v USING (variant_idx) JOIN gene ON gene.chrom = v.chrom AND v.pos BETWEEN gene.s AND gene.e JOIN gene_set gs ON gs.gene = gene.gene AND gs.pathway_id = m.pathway_id GROUP BY 1, 2) x USING (pathway_id, variant_idx)"


@query("snp_gene_label", "member variant gene gene_set", _LABEL)
def _(t):
    return R.snp_gene_label(t.member, G.variants_in_genes(t.variant, t.gene), t.gene_set)


_LD = (
    "gc AS (SELECT sample_id, variant_idx, dosage, chrom FROM geno JOIN variant USING (variant_idx)), ms AS (SELECT variant_idx, sum(dosage) AS su, sum(dosage * dosage) AS q FROM geno GROUP BY 1), "
    "xy AS (SELECT a.variant_idx AS u, b.variant_idx AS v, sum(a.dosage * b.dosage) AS xy FROM gc a JOIN gc b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND a.variant_idx > b.variant_idx GROUP BY 1, 2), "
    "ld AS (SELECT u, v, coalesce(pow((nn * xy - a.su * b.su)::DOUBLE, 2) / nullif((nn * a.q - a.su * a.su)::DOUBLE * (nn * b.q - b.su * b.su), 0), 0.0) AS r2 FROM xy JOIN ms a ON u = a.variant_idx JOIN ms b ON v = b.variant_idx CROSS JOIN tot)"
)


def _merge(needs, body):
    return with_views(needs, "SELECT 1").removesuffix(" SELECT 1") + ", " + body


def _ld(t):
    return C.ld_pairs(t.genotype, t.variant, t.total[0])


@query("ld_pairwise_r2")
def _(t):
    return _six(_ld(t), "r2")


SQL["ld_pairwise_r2"] = _merge("geno variant tot", f"{_LD} SELECT u, v, round(r2, 6) AS r2 FROM ld")


@query("pair_ld_lookup")
def _(t):
    return R.pair_ld(edges(t).select("u", "v"), t.variant, _ld(t))


SQL["pair_ld_lookup"] = _merge("geno variant tot scores_dd_risk", f"{_LD} SELECT u, v, CASE WHEN a.chrom <> b.chrom THEN 'NA' WHEN coalesce(r2, 0.0) >= 0.001 THEN printf('%.3f', r2) ELSE printf('%.3e', coalesce(r2, 0.0)) END AS ld FROM scores_dd_risk JOIN variant a ON u = a.variant_idx JOIN variant b ON v = b.variant_idx LEFT JOIN ld USING (u, v)")


@query("ld_stitch_offsets", "variant", "SELECT chrom, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY chrom) - count(*) AS BIGINT) AS start FROM variant GROUP BY 1")
def _(t):
    n = t.variant.groupBy("chrom").agg(F.count("*").alias("n"))
    return n.withColumn("start", (F.sum("n").over(W.orderBy("chrom")) - F.col("n")).cast("long"))  # one row a chromosome


_CASES = "(SELECT nc::DOUBLE FROM tot)"
_CTRLS = "(SELECT (nn - nc)::DOUBLE FROM tot)"
_FREQ = (
    "pm AS (SELECT u, v, 'DD' AS model FROM scores_dd_risk UNION ALL SELECT u, v, 'RR' FROM scores_rr_risk UNION ALL SELECT u, v, 'RD' FROM net_rd_risk), "
    "c AS (SELECT p.u, p.v, p.model, a.dosage AS du, b.dosage AS dv, s.pheno FROM pm p JOIN geno a ON a.variant_idx = p.u JOIN geno b ON b.variant_idx = p.v AND a.sample_id = b.sample_id JOIN samp s ON s.sample_id = a.sample_id), "
    "f AS (SELECT u, v, model, "
    + ", ".join(f"count(*) FILTER ({w} AND pheno = {1 if e == 'case' else 0}) / {_CASES if e == 'case' else _CTRLS} AS {k}_{e}" for k, w in (("dd", "true"), ("rr", "du = 2 AND dv = 2"), ("r1", "du = 2"), ("r2", "dv = 2")) for e in ("case", "ctrl"))
    + " FROM c GROUP BY 1, 2, 3), o AS (SELECT *, CASE WHEN r1_ctrl = 0 THEN 1.0 ELSE r1_ctrl END AS c1, CASE WHEN r2_ctrl = 0 THEN 1.0 ELSE r2_ctrl END AS c2 FROM f), "
    "g AS (SELECT u, v, model, CASE model WHEN 'DD' THEN dd_case WHEN 'RR' THEN rr_case ELSE CASE WHEN r1_case / c1 > r2_case / c2 THEN r1_case ELSE r2_case END END AS fca, CASE model WHEN 'DD' THEN dd_ctrl WHEN 'RR' THEN rr_ctrl ELSE CASE WHEN r1_case / c1 > r2_case / c2 THEN c1 ELSE c2 END END AS fco FROM o) "
)
_OR = "((1 - fco) * fca) / nullif((1 - fca) * fco, 0)"


@query("pair_freq_or")
def _(t):
    pairs = edges(t, "DD").select("u", "v", F.lit("DD").alias("model"))
    for m in ("RR", "RD"):
        pairs = pairs.unionByName(edges(t, m).select("u", "v", F.lit(m).alias("model")))
    return _six(R.pair_frequencies(pairs, t.genotype, t.sample, "risk"), "case_freq", "control_freq", "odds_ratio")


SQL["pair_freq_or"] = _merge("geno samp tot scores_dd_risk scores_rr_risk net_rd_risk", f"{_FREQ} SELECT u, v, model, round(fca, 6) AS case_freq, round(fco, 6) AS control_freq, round({_OR}, 6) AS odds_ratio FROM g")


@query("interaction_list")
def _(t):
    pairs = R.module_pairs(edges(t), wpm(t), ["pathway_id"], "ind", "ind", True).persist()
    freq = R.pair_frequencies(pairs.select("u", "v").distinct().withColumn("model", F.lit("DD")), t.genotype, t.sample, "risk").drop("model")
    label = R.snp_gene_label(t.member, G.variants_in_genes(t.variant, t.gene), t.gene_set)
    v = t.variant.select("variant_idx", "varid", "chrom", "pos")
    rows = pairs.join(freq, ["u", "v"])
    for i, c in (("1", "u"), ("2", "v")):
        rows = rows.join(v.toDF(c, f"snp{i}", f"chr{i}", f"loc{i}"), c).join(label.toDF("pathway_id", c, f"gene{i}"), ["pathway_id", c])
    return _six(rows.withColumnRenamed("score", "gi"), "gi", "case_freq", "control_freq", "odds_ratio").select("pathway_id", "snp1", "chr1", "loc1", "gene1", "snp2", "chr2", "loc2", "gene2", "gi", "case_freq", "control_freq", "odds_ratio")


SQL["interaction_list"] = _merge(
    "geno samp tot scores_dd_risk scores_rr_risk net_rd_risk m member variant gene gene_set",
    f"{_FREQ}, lab AS ({_LABEL}) SELECT x.pathway_id, a.varid AS snp1, a.chrom AS chr1, a.pos AS loc1, la.genes AS gene1, b.varid AS snp2, b.chrom AS chr2, b.pos AS loc2, lb.genes AS gene2, round(e.score, 6) AS gi, round(fca, 6) AS case_freq, round(fco, 6) AS control_freq, round({_OR}, 6) AS odds_ratio "
    "FROM scores_dd_risk e JOIN m x ON e.u = x.variant_idx JOIN m y ON e.v = y.variant_idx AND x.pathway_id = y.pathway_id JOIN (SELECT * FROM g WHERE model = 'DD') g ON g.u = e.u AND g.v = e.v JOIN variant a ON a.variant_idx = e.u JOIN variant b ON b.variant_idx = e.v JOIN lab la ON la.pathway_id = x.pathway_id AND la.variant_idx = e.u JOIN lab lb ON lb.pathway_id = x.pathway_id AND lb.variant_idx = e.v",
)


@query("driver_topk")
def _(t):
    rows = R.drivers(edges(t), wpm(t), ["pathway_id"], "ind", "ind", t.n_variants)
    return _six(rows.select("pathway_id", "u", "n_in", "n_all", "fold", "tail", F.col("place").cast("long").alias("place")), "fold", "tail")


SQL["driver_topk"] = _merge(
    "sym m wpm nvar",
    "i AS (SELECT x.pathway_id, u, count(*) AS n_in FROM sym JOIN m x ON u = x.variant_idx JOIN m y ON v = y.variant_idx AND x.pathway_id = y.pathway_id GROUP BY 1, 2), al AS (SELECT u, count(*) AS n_all FROM sym GROUP BY 1), "
    f"d AS (SELECT pathway_id, u, n_in, n_all, (n_in / indsize::DOUBLE) / (n_all / s::DOUBLE) AS fold, {tail_sql('n_in', 'indsize', 'n_all', 's')} AS tail FROM i JOIN al USING (u) JOIN wpm USING (pathway_id) CROSS JOIN nvar) "
    "SELECT pathway_id, u, n_in, n_all, round(fold, 6) AS fold, round(tail, 6) AS tail, row_number() OVER (PARTITION BY pathway_id ORDER BY fold DESC, u) AS place FROM d WHERE tail <= 0.05 AND fold > 1.2 QUALIFY place <= 20",
)

_BSIM = (
    "bs AS (SELECT * FROM bpm), bq AS (SELECT a.path1 AS path1_a, a.path2 AS path2_a, b.path1 AS path1_b, b.path2 AS path2_b, greatest(len(list_intersect(a.ind1, b.ind1)) * len(list_intersect(a.ind2, b.ind2)), len(list_intersect(a.ind1, b.ind2)) * len(list_intersect(a.ind2, b.ind1))) / least(a.size, b.size)::DOUBLE AS sim FROM bs a JOIN bs b ON (a.path1, a.path2) < (b.path1, b.path2))"
)


@query("bpm_similarity")
def _(t):
    return _six(R.bpm_similarity(bpm(t), ["path1", "path2"]), "similarity")


SQL["bpm_similarity"] = _merge("bpm", f"{_BSIM} SELECT path1_a, path2_a, path1_b, path2_b, round(sim, 6) AS similarity FROM bq WHERE sim > 0")

_PSIM = "ps AS (SELECT a.pathway_id AS a, b.pathway_id AS b, count(*) / least(a.indsize, b.indsize)::DOUBLE AS sim FROM m a JOIN m b ON a.variant_idx = b.variant_idx AND a.pathway_id < b.pathway_id GROUP BY a.pathway_id, b.pathway_id, a.indsize, b.indsize)"


@query("path_similarity")
def _(t):
    return _six(R.path_similarity(wpm(t)), "similarity")


SQL["path_similarity"] = _merge("m", f"{_PSIM} SELECT a, b, round(sim, 6) AS similarity FROM ps")

_MODS = "mo AS (SELECT pathway_id AS module, (pathway_id * 37 % 50) / 100.0::DOUBLE AS fdr FROM wpm), rk AS (SELECT module, row_number() OVER (ORDER BY fdr, module) AS k FROM mo)"


def _modules(t):
    return wpm(t).select(F.col("pathway_id").alias("module"), ((F.col("pathway_id") * 37 % 50) / 100.0).alias("fdr"))


@query("redundancy_groups")
def _(t):
    return R.redundancy_groups(_modules(t), R.path_similarity(wpm(t)).filter(F.col("similarity") >= R.SIMILAR))


SQL["redundancy_groups"] = _merge(
    "m wpm",
    f"{_PSIM}, {_MODS}, e AS (SELECT greatest(x.k, y.k) AS hi, least(x.k, y.k) AS lo FROM ps JOIN rk x ON a = x.module JOIN rk y ON b = y.module WHERE sim >= 0.25), up AS (SELECT k, coalesce((SELECT min(lo) FROM e WHERE hi = k), k) AS up FROM rk), "
    "f(k, up2) AS (SELECT k, k FROM up UNION ALL SELECT f.k, up.up FROM f JOIN up ON f.up2 = up.k WHERE up.up <> f.up2), root AS (SELECT k, min(up2) AS r FROM f GROUP BY 1) "
    "SELECT module, dense_rank() OVER (ORDER BY r) - 1 AS grp FROM rk JOIN root USING (k)",
)


@query("network_map_edges")
def _(t):
    eff = lambda c: F.when(F.col(c) % 2 == 0, "protective").otherwise("risk")
    w = _modules(t).filter(R.significant(F.col("fdr"), 0.1)).select(F.col("module").alias("pathway"), eff("module").alias("effect"))
    b = bpm(t).select(F.col("path1").alias("p1"), F.col("path2").alias("p2"), ((F.col("path1") * 31 + F.col("path2") * 17) % 97).alias("h"))
    b = b.withColumn("fdr", F.col("h") / 100.0).filter(R.significant(F.col("fdr"), 0.25))
    rows = b.select("p1", "p2", eff("h").alias("effect"))
    reps = b.select("p1", "p2", eff("p2").alias("effect"), "fdr", (F.col("p1") * 100 + F.col("p2")).alias("grp"))
    return R.map_edges(w, rows, reps)


SQL["network_map_edges"] = _merge(
    "wpm bpm",
    "w AS (SELECT pathway_id AS p, CASE WHEN pathway_id % 2 = 0 THEN 'protective' ELSE 'risk' END AS effect FROM wpm WHERE (pathway_id * 37 % 50) / 100.0::DOUBLE <= 0.1), h AS (SELECT path1 AS p1, path2 AS p2, (path1 * 31 + path2 * 17) % 97 AS h FROM bpm), "
    "d AS (SELECT p AS p1, p AS p2, effect, 0 AS layer, 0 AS n FROM w UNION ALL SELECT p1, p2, CASE WHEN h % 2 = 0 THEN 'protective' ELSE 'risk' END, 1, h % 2 FROM h WHERE h <= 25 AND (p1 IN (SELECT p FROM w) OR p2 IN (SELECT p FROM w)) "
    "UNION ALL (SELECT p1, p2, CASE WHEN p2 % 2 = 0 THEN 'protective' ELSE 'risk' END, 2, row_number() OVER (ORDER BY h, p1 * 100 + p2) FROM h WHERE h <= 25 ORDER BY h, p1 * 100 + p2 LIMIT 20)) "
    "SELECT least(p1, p2) AS node1, greatest(p1, p2) AS node2, arg_max(CASE effect WHEN 'protective' THEN 'orange' ELSE 'blue' END, layer * 1000 + n) AS colour FROM d GROUP BY 1, 2",
)


@query("outlier_box", sql="SELECT vec_id AS iid FROM embeddings WHERE embedding[1] >= -0.1 AND embedding[1] <= 0.2 AND embedding[2] <= 0.15")
def _(t):
    rows = t.coordinate.select("iid", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))
    return C.inside_box(rows, {"pc1": (-0.1, 0.2), "pc2": (None, 0.15)}).select("iid")


_VAR = "SELECT CASE WHEN p_partkey % 50 = 0 THEN '.' ELSE concat('rs', p_partkey % {m}) END AS id, p_partkey % 25 AS chrom, p_partkey * {k} AS pos, substr('ACGT', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS ref, CASE WHEN p_partkey % 13 = 0 THEN 'A,T' ELSE substr('CGTA', CAST(p_partkey % 4 + 1 AS INTEGER), 1) END AS alt, p_partkey AS row_id FROM part"


def _variants(t, m, k, swap=False):
    key = F.col("p_partkey")
    base = lambda s: F.substring(F.lit(s), 1, 4)
    ref = F.element_at(F.split(base("ACGT"), ""), (key % 4 + 1).cast("int"))
    alt = F.when(key % 13 == 0, "A,T").otherwise(F.element_at(F.split(base("CGTA"), ""), (key % 4 + 1).cast("int")))
    a, b = (alt, ref) if swap else (ref, alt)
    return t.table("part").select(F.when(key % 50 == 0, ".").otherwise(F.concat(F.lit("rs"), (key % m).cast("string"))).alias("id"), (key % 25).alias("chrom"), (key * k).alias("pos"), a.alias("ref"), b.alias("alt"), key.alias("row_id"))


@query("unique_ids", sql=f"SELECT id, row_id FROM ({_VAR.format(m=1200, k=7)}) WHERE id <> '.' AND id IN (SELECT id FROM ({_VAR.format(m=1200, k=7)}) GROUP BY id HAVING count(*) = 1)")
def _(t):
    return C.unique_ids(_variants(t, 1200, 7), "id").select("id", "row_id")


@query(
    "shared_variants",
    sql=f"WITH a AS ({_VAR.format(m=1500, k=7)}), b0 AS ({_VAR.format(m=1700, k=9)}), b AS (SELECT id, chrom, pos, alt AS ref, ref AS alt FROM b0), ua AS (SELECT * FROM a WHERE id <> '.' AND id IN (SELECT id FROM a GROUP BY id HAVING count(*) = 1)), ub AS (SELECT * FROM b WHERE id <> '.' AND id IN (SELECT id FROM b GROUP BY id HAVING count(*) = 1)) "
    "SELECT ua.id, (ua.chrom <> ub.chrom OR ua.pos <> ub.pos) AS moved FROM ua JOIN ub USING (id) WHERE NOT contains(ua.ref || ua.alt, ',') AND NOT contains(ub.ref || ub.alt, ',') AND least(ua.ref, ua.alt) = least(ub.ref, ub.alt) AND greatest(ua.ref, ua.alt) = greatest(ub.ref, ub.alt)",
)
def _(t):
    return C.shared_variants(_variants(t, 1500, 7), _variants(t, 1700, 9, swap=True))


@query("qc_variant_filter", sql=f"SELECT row_id FROM ({_VAR.format(m=1500, k=7)}) WHERE chrom BETWEEN 1 AND 22 AND ref IN ('A','C','G','T') AND alt IN ('A','C','G','T') AND ref || alt NOT IN ('AT','TA','CG','GC')")
def _(t):
    return C.variant_filter(_variants(t, 1500, 7)).select("row_id")


@query("cohort_combine", sql="SELECT c_custkey, 'study' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'reference' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def _(t):
    c = t.table("customer").select("c_custkey")
    return C.combined_cohort(c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 2 = 0"), "c_custkey")


@query("cluster_align_check", "samp", "SELECT count(*) FILTER (c.sample_id IS NULL) AS absent, count(*) FILTER (c.pheno <> s.pheno) AS differ FROM samp s LEFT JOIN (SELECT sample_id, CASE WHEN sample_id % 100 = 1 THEN 1 - pheno ELSE pheno END AS pheno FROM samp WHERE sample_id % 50 <> 0) c USING (sample_id)")
def _(t):
    s = t.sample.select("sample_id", "pheno")
    c = s.filter("sample_id % 50 <> 0").select("sample_id", F.when(F.col("sample_id") % 100 == 1, 1 - F.col("pheno")).otherwise(F.col("pheno")).alias("other"))
    return s.join(c, "sample_id", "left").agg(F.count_if(F.col("other").isNull()).alias("absent"), F.count_if(F.col("other") != F.col("pheno")).alias("differ"))


@query("extract_bed_semi", "variant gene", "SELECT variant_idx FROM variant v WHERE EXISTS (SELECT 1 FROM gene g WHERE g.chrom = v.chrom AND pos BETWEEN s AND e)")
def _(t):
    return C.within_regions(t.variant, t.gene).select("variant_idx")


@query("score_projection", "geno tot variant", "SELECT sample_id, round(sum(dosage / sd * w) + any_value(base), 6) AS score FROM geno JOIN (SELECT *, sum(-2 * af / sd * w) OVER () AS base FROM (SELECT variant_idx, af, sqrt(2 * af * (1 - af)) AS sd, (variant_idx % 11 - 5) / 10.0::DOUBLE AS w FROM (SELECT variant_idx, sum(dosage) / (2.0::DOUBLE * any_value(nn)) AS af FROM geno CROSS JOIN tot GROUP BY 1)) WHERE sd > 0) USING (variant_idx) GROUP BY 1")
def _(t):
    w = t.variant.select("variant_idx", ((F.col("variant_idx") % 11 - 5) / 10.0).alias("weight"))
    return _six(C.projected_scores(t.genotype, w, t.total[0]), "score")


@query("pc_standardize", "pcdim", "SELECT iid, dim::INTEGER AS dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_samp(x) OVER (PARTITION BY dim), 5) AS z FROM pcdim")
def _(t):
    return C.standardized(t.coordinate).withColumn("z", F.round("z", 5))


@query("pc_weighted", "pcdim", "SELECT iid, dim::INTEGER AS dim, round((x - avg(x) OVER (PARTITION BY dim)) / stddev_samp(x) OVER (PARTITION BY dim) * sqrt(1.0::DOUBLE / (dim + 1)), 5) AS z FROM pcdim")
def _(t):
    return C.standardized(t.coordinate, [64.0 / (i + 1) for i in range(64)]).withColumn("z", F.round("z", 5))


_D2 = "list_sum(list_transform(range(1, 65), lambda i: pow(a.pc[i] - b.{c}[i], 2)))"


@query("knn_candidates", "pcs", f"SELECT a.iid AS \"case\", b.iid AS control, round(sqrt({_D2.format(c='pc')}), 5) AS dist, row_number() OVER (PARTITION BY a.iid ORDER BY {_D2.format(c='pc')}, b.iid) AS place FROM pcs a JOIN pcs b ON a.pheno = 1 AND b.pheno = 0 WHERE a.iid % 100 = 0 QUALIFY place <= 5")
def _(t):
    c = t.coordinate
    rows = C.nearest_controls(c.filter("pheno = 1 and iid % 100 = 0"), c.filter("pheno = 0"), 5)
    return rows.withColumn("dist", F.round("dist", 5)).withColumn("place", F.col("place").cast("long"))


@query("cluster_validity", "samp", "SELECT cluster, CAST(sum(pheno) AS BIGINT) AS cases, CAST(sum(1 - pheno) AS BIGINT) AS controls, sum(pheno) > 0 AND sum(1 - pheno) > 0 AS valid FROM samp GROUP BY 1")
def _(t):
    return C.cluster_validity(t.sample)


@query("cluster_centroids", "cent", "SELECT cluster, dim::INTEGER AS dim, round(mean, 6) AS mean FROM cent")
def _(t):
    return _six(C.centroids(t.coordinate), "mean")


_CV = "cv AS (SELECT cluster, list(mean ORDER BY dim) AS centre FROM cent GROUP BY 1)"


@query("nearest_centroid")
def _(t):
    return _six(C.nearest_centroid(t.coordinate, C.centroid_vectors(t.coordinate)), "dist2")


SQL["nearest_centroid"] = _merge("pcs cent", f"{_CV}, q AS (SELECT a.iid, b.cluster, {_D2.format(c='centre')} AS d FROM pcs a CROSS JOIN cv b) SELECT iid, arg_min(cluster, d) AS nearest, round(min(d), 6) AS dist2 FROM q GROUP BY 1")

_HALF = "SELECT iid, pc, cluster, CASE WHEN cluster IN (0, 3, 7) THEN 1 WHEN cluster = 5 THEN 0 ELSE iid % 2 END AS pheno FROM pcs"


@query("merge_invalid_clusters")
def _(t):
    p = F.when(F.col("cluster").isin(0, 3, 7), 1).when(F.col("cluster") == 5, 0).otherwise(F.col("iid") % 2)
    return C.merged_clusters(t.coordinate.withColumn("pheno", p.cast("int")))


SQL["merge_invalid_clusters"] = _merge(
    "pcs cent",
    f"h AS ({_HALF}), {_CV}, ok AS (SELECT cluster, sum(pheno) > 0 AND sum(1 - pheno) > 0 AS valid FROM h GROUP BY 1), b AS (SELECT cluster, centre AS pc FROM cv JOIN ok USING (cluster) WHERE NOT valid), g AS (SELECT cluster, centre FROM cv JOIN ok USING (cluster) WHERE valid), "
    f"q AS (SELECT a.cluster AS c, arg_min(b.cluster, {_D2.format(c='centre')}) AS n FROM b a CROSS JOIN g b GROUP BY 1) SELECT iid, CAST(coalesce(n, cluster) AS BIGINT) AS cluster FROM h LEFT JOIN q ON h.cluster = q.c",
)


def _match(name, **how):
    caliper, drop = how.get("caliper"), how.get("drop_partial", False)
    ratio = how.get("ratio", 1)
    near = "" if caliper is None else f" WHERE dist <= {caliper}"
    free = "SELECT list(k) FROM (SELECT k FROM d WHERE turn = g.t + 1 AND NOT list_contains(g.taken, k) ORDER BY dist, k LIMIT {r})"
    got = "(" + free.format(r=ratio) + ")"
    keep = f"CASE WHEN coalesce(len({got}), 0) = {ratio} THEN {got} ELSE [] END" if drop else f"coalesce({got}, [])"
    SQL[name] = _merge(
        "pcs",
        f"o AS MATERIALIZED (SELECT iid, row_number() OVER (ORDER BY md5(concat('0:', iid)), iid) AS turn FROM pcs WHERE pheno = 1), "
        f"d0 AS (SELECT o.turn, a.iid AS c, b.iid AS k, sqrt({_D2.format(c='pc')}) AS dist FROM o JOIN pcs a USING (iid) JOIN pcs b ON b.pheno = 0), d AS MATERIALIZED (SELECT * FROM d0{near}), "
        f"g(t, taken, own) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[] UNION ALL SELECT t + 1, list_concat(taken, {keep}), {keep} FROM g WHERE t < (SELECT count(*) FROM o)) "
        "SELECT d.c AS \"case\", d.k AS control, round(d.dist, 5) AS dist FROM (SELECT t, unnest(own) AS k FROM g) x JOIN d ON d.turn = x.t AND d.k = x.k",
    )

    @query(name)
    def _(t):
        c = t.coordinate
        return C.greedy_match(c.filter("pheno = 1"), c.filter("pheno = 0"), **how).withColumn("dist", F.round("dist", 5))


_match("greedy_match")
_match("greedy_match_caliper", ratio=2, caliper=1.2, drop_partial=True)


@query("kmeans_assign")
def _(t):
    return C.kmeans_clusters(t.coordinate, 5)


@query("ld_prune")
def _(t):
    return C.ld_prune(_ld(t), t.variant, C.allele_frequency(t.genotype, t.total[0]), 0.002)


@query("qc_hwe_filter")
def _(t):
    return _six(C.hwe_filter(C.genotype_counts(t.genotype, t.total[0]), 1e-6).select("variant_idx", "midp"), "midp")


@query("king_kinship")
def _(t):
    return _six(C.king_kinship(t.genotype, 0.0442), "kinship")


SQL["king_kinship"] = _merge(
    "geno",
    "k AS (SELECT * FROM geno), o AS (SELECT sample_id, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom FROM k GROUP BY 1), "
    "b AS (SELECT x.sample_id AS a, y.sample_id AS b, count(*) FILTER (x.dosage = 1 AND y.dosage = 1) AS hethet, count(*) FILTER (x.dosage = 2) AS ha, count(*) FILTER (y.dosage = 2) AS hb FROM k x JOIN k y ON x.variant_idx = y.variant_idx AND x.sample_id < y.sample_id GROUP BY 1, 2), "
    "f AS (SELECT b.a, b.b, hethet, p.hom - ha + q.hom - hb AS ibs0, p.het AS x, q.het AS y, nullif(least(p.het, q.het), 0) AS m FROM b JOIN o p ON p.sample_id = b.a JOIN o q ON q.sample_id = b.b), "
    "v AS (SELECT a, b, hethet, ibs0, 0.5::DOUBLE - (4.0::DOUBLE * ibs0 + (x - hethet) + (y - hethet)) / (4 * m) AS kin FROM f) SELECT a, b, hethet, ibs0, round(kin, 6) AS kinship FROM v WHERE kin >= 0.0442",
)

_REL = "SELECT DISTINCT c_custkey AS a, (c_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS b FROM customer WHERE c_custkey <> (c_custkey * 7 + 3) % (SELECT count(*) FROM customer)"


@query("relatedness_prune")
def _(t):
    n = t.total[0]
    pairs = t.sample.select(F.col("sample_id").alias("a"), ((F.col("sample_id") * 7 + 3) % n).alias("b"))
    return C.relatedness_prune(pairs, t.sample.select(F.col("sample_id").alias("id"), "pheno"))


SQL["relatedness_prune"] = _merge(
    "samp",
    f"e AS (SELECT DISTINCT greatest(a, b) AS u, least(a, b) AS v FROM ({_REL})), bo AS MATERIALIZED (SELECT u AS x, v AS y FROM e UNION ALL SELECT v, u FROM e), "
    "g(step, gone) AS (SELECT 0, []::BIGINT[] UNION ALL SELECT step + 1, list_append(gone, (SELECT x FROM bo JOIN samp ON x = sample_id WHERE NOT list_contains(g.gone, x) AND NOT list_contains(g.gone, y) GROUP BY x, pheno ORDER BY CASE pheno WHEN 0 THEN 1 ELSE 2 END, count(*) DESC, x LIMIT 1)) "
    "FROM g WHERE EXISTS (SELECT 1 FROM bo WHERE NOT list_contains(g.gone, x) AND NOT list_contains(g.gone, y))) SELECT unnest((SELECT gone FROM g ORDER BY step DESC LIMIT 1)) AS id",
)


@query("qc_missingness")
def _(t):
    gone = (F.col("sample_id") + F.col("variant_idx")) % 7 == 0
    calls = t.genotype.select("sample_id", "variant_idx", F.when(~gone, F.col("dosage")).alias("dosage"))
    return C.missingness(calls, 0.2, 0.15).groupBy("variant_idx").agg(F.count("*").alias("n"))


SQL["qc_missingness"] = _merge(
    "geno",
    "c AS (SELECT sample_id, variant_idx, CASE WHEN (sample_id + variant_idx) % 7 = 0 THEN NULL ELSE dosage END AS dosage FROM geno), s AS (SELECT sample_id FROM c GROUP BY 1 HAVING count(*) FILTER (dosage IS NULL) / count(*)::DOUBLE <= 0.2), k AS (SELECT * FROM c WHERE sample_id IN (SELECT sample_id FROM s)) SELECT variant_idx, count(*) AS n FROM k WHERE variant_idx IN (SELECT variant_idx FROM k GROUP BY 1 HAVING count(*) FILTER (dosage IS NULL) / count(*)::DOUBLE <= 0.15) GROUP BY 1",
)


@query("qc_maf", "geno tot", "SELECT variant_idx, CAST(sum(dosage) AS BIGINT) AS alt, round(sum(dosage) / (2.0::DOUBLE * any_value(nn)), 6) AS af FROM geno CROSS JOIN tot GROUP BY 1 HAVING least(sum(dosage) / (2.0::DOUBLE * any_value(nn)), 1 - sum(dosage) / (2.0::DOUBLE * any_value(nn))) >= 0.12")
def _(t):
    return _six(C.allele_frequency(t.genotype, t.total[0]).filter("maf >= 0.12").select("variant_idx", "alt", "af"), "af")


@query("qc_hwe_counts", "geno tot", "SELECT variant_idx, count(*) FILTER (dosage = 1) AS het, count(*) FILTER (dosage = 2) AS hom_alt, any_value(nn) - count(*) AS hom_ref FROM geno CROSS JOIN tot GROUP BY 1")
def _(t):
    return C.genotype_counts(t.genotype, t.total[0])


_CALL = "SELECT l_suppkey AS group_id, l_partkey % 50 AS sample_id, l_linenumber % 3 AS call FROM lineitem"


@query("dup_consensus", sql=f"WITH n AS (SELECT group_id, sample_id, call, count(*) AS n FROM ({_CALL}) GROUP BY ALL), tp AS (SELECT group_id, sample_id, max(n) AS most, sum(n) AS probes FROM n GROUP BY ALL) SELECT group_id, sample_id, CASE WHEN count(*) = 1 THEN min(call) END AS call, CAST(any_value(probes) AS BIGINT) AS probes, CAST(any_value(probes) - any_value(most) AS BIGINT) AS discordant FROM n JOIN tp USING (group_id, sample_id) WHERE n = most GROUP BY ALL")
def _(t):
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("group_id"), (F.col("l_partkey") % 50).alias("sample_id"), (F.col("l_linenumber") % 3).alias("call"))
    return C.consensus_calls(rows)


@query("contig_normalize", sql="SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'X' WHEN 1 THEN 'M' WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN p_partkey % 30 BETWEEN 1 AND 22 THEN (p_partkey % 30)::VARCHAR END WHEN 4 THEN 'Y' ELSE NULL END AS chrom FROM part")
def _(t):
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, "chrX").when(k % 6 == 1, "MT").when(k % 6 == 2, "chrUn_7").when(k % 6 == 3, F.concat(F.lit("chr"), (k % 30).cast("string"))).when(k % 6 == 4, "y").otherwise("23")
    return t.table("part").select("p_partkey", C.normalized_contig(raw).alias("chrom"))


@query("bed_roundtrip", "variant", "SELECT variant_idx, pos - 1 AS bed_start, pos AS bed_end, pos AS back FROM variant")
def _(t):
    rows = t.variant.select("variant_idx", (F.col("pos") - 1).alias("bed_start"), F.col("pos").alias("bed_end"))
    return rows.withColumn("back", F.col("bed_start") + 1)


@query("drop_all_duplicates", sql="SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) = 1")
def _(t):
    return C.drop_repeated(t.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("carry_forward_reason", sql="SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reason FROM events")
def _(t):
    rows = t.table("events").select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("mark"))
    return C.carried_forward(rows, ["user_id"], "event_id", "mark", "reason").drop("mark")


@query("grid_count_suppressed", "pcs", "SELECT CAST(floor(pc[1] / 0.1) AS BIGINT) AS gx, CAST(floor(pc[2] / 0.1) AS BIGINT) AS gy, count(*) AS n FROM pcs GROUP BY 1, 2 HAVING count(*) >= 20")
def _(t):
    rows = t.coordinate.select(F.get("pc", F.lit(0)).alias("x"), F.get("pc", F.lit(1)).alias("y"))
    return C.grid_counts(rows, "x", "y", 0.1, 20)

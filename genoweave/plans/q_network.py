"""Queries: interaction networks and module statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import modules as M
from ..operators import network as N
from ..operators import permute as P
from ..operators import sets as G
from .registry import query


def edges(t, model="DD", effect="risk"):
    return t.network(model, effect)


def wpm(t):
    return t.wpm


def bpm(t):
    return t.bpm


def _six(rows, *columns):
    return rows.withColumns({c: F.round(c, 6) for c in columns})


@query("variant_marginals", "marg_d", "SELECT * FROM marg_d")
def _(t):
    return N.marginals(N.coded(t.carrier, "D"))


def _pairs(key, model, symmetric):
    @query(f"pair_counts_{key}", f"pairs_{key}", f"SELECT * FROM pairs_{key}")
    def _(t):
        return N.pair_counts(N.coded(t.carrier, model[0]), N.coded(t.carrier, model[1]), symmetric)


_pairs("dd", "DD", True)
_pairs("rr", "RR", True)
_pairs("rd", "RD", False)


@query("pair_counts_blocked", "pairs_dd", "SELECT * FROM pairs_dd")
def _(t):
    return N.pair_counts_blocked(N.coded(t.carrier, "D"), t.n_variants)


def _scores(model, effect, twin, table=None):
    @query(f"edge_score_{twin}_{model.lower()}", table or f"scores_{model.lower()}_{twin}", f"SELECT u, v, round(score, 6) AS score FROM {table or f'scores_{model.lower()}_{twin}'}")
    def _(t):
        return _six(t.network(model, effect, again=True), "score")


for _m in ("DD", "RR"):
    for _e, _t in (("risk", "risk"), ("protective", "prot")):
        _scores(_m, _e, _t)
_scores("RD", "risk", "risk", "net_rd_risk")


@query("net_symmetrize_rd", "scores_rd_risk", "SELECT greatest(u, v) AS u, least(u, v) AS v, round(max(score), 6) AS score FROM scores_rd_risk GROUP BY 1, 2")
def _(t):
    rec, dom = N.coded(t.carrier, "R"), N.coded(t.carrier, "D")
    return _six(N.symmetrized(N.scored(N.pair_counts(rec, dom, False), N.marginals(rec), N.marginals(dom), t.total, "risk")), "score")


@query(
    "net_combine_models", "scores_dd_risk scores_rr_risk net_rd_risk",
    "SELECT u, v, round(greatest(coalesce(d.score, 0), coalesce(r.score, 0), coalesce(x.score, 0)), 6) AS score, CAST(CASE WHEN coalesce(x.score, 0) > greatest(coalesce(d.score, 0), coalesce(r.score, 0)) THEN 3 WHEN coalesce(r.score, 0) > coalesce(d.score, 0) THEN 1 ELSE 2 END AS INTEGER) AS max_id FROM scores_dd_risk d FULL JOIN scores_rr_risk r USING (u, v) FULL JOIN net_rd_risk x USING (u, v)",
)
def _(t):
    return _six(N.combined(edges(t, "RR"), edges(t, "DD"), edges(t, "RD")), "score")


@query("net_density", "scores_dd_risk nvar", "SELECT count(*) * 2 AS nnz, round(count(*) * 2 / (any_value(s)::DOUBLE * any_value(s)), 6) AS density FROM scores_dd_risk CROSS JOIN nvar")
def _(t):
    return _six(N.density(edges(t), t.n_variants), "density")


@query("net_density_cutoff", "sym nvar", "SELECT round(quantile_cont(x, 0.995), 6) AS score_cutoff FROM (SELECT score AS x FROM sym UNION ALL SELECT 0.0 FROM range((SELECT s * s FROM nvar) - (SELECT count(*) FROM sym)))")
def _(t):
    return _six(N.density_cutoff(edges(t), t.n_variants, 0.005), "score_cutoff")


@query("net_binarize", "scores_dd_risk", "SELECT u, v, 1.0::DOUBLE AS score FROM scores_dd_risk WHERE score >= 0.5")
def _(t):
    return N.binarized(edges(t), 0.5)


@query("variant_degree", "sym", "SELECT u, round(sum(score), 6) AS degree FROM sym GROUP BY 1")
def _(t):
    return _six(N.degrees(edges(t)), "degree")


_EXT = "SELECT l_suppkey AS u, l_partkey % (SELECT count(*) FROM supplier) AS v, l_orderkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) % 20 AS line, (CAST(l_quantity AS BIGINT) % 20 + 1) / 21.0::DOUBLE AS p, CAST(l_linenumber - 4 AS DOUBLE) AS effect FROM lineitem WHERE l_suppkey <> l_partkey % (SELECT count(*) FROM supplier)"


def _external(t):
    n = t.n_variants
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") % n).alias("v"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long") % 20).alias("line"), ((F.col("l_quantity").cast("long") % 20 + 1) / 21.0).alias("p"), (F.col("l_linenumber") - 4).cast("double").alias("effect"))
    return rows.filter("u <> v")


def _import(kind, prot, risk):
    @query(f"net_import_scores_{kind}", sql=f"SELECT u, v, line, round(CASE WHEN {prot} THEN -log10(p) ELSE 0.0 END, 6) AS protective, round(CASE WHEN {risk} THEN -log10(p) ELSE 0.0 END, 6) AS risk FROM ({_EXT})")
    def _(t):
        return _six(N.import_scores(_external(t), kind).select("u", "v", "line", "protective", "risk"), "protective", "risk")


_import("lr", "effect < 0", "effect > 0")
_import("lin", "effect < 0", "effect >= 0")


@query("net_import_last_wins", sql=f"SELECT greatest(u, v) AS u, least(u, v) AS v, round(max(s), 6) AS score FROM (SELECT u, v, arg_max(-log10(p), line) AS s FROM ({_EXT}) GROUP BY 1, 2) GROUP BY 1, 2")
def _(t):
    return _six(N.import_last_wins(_external(t).withColumn("score", S.minus_log10(F.col("p"))), "line").select("u", "v", "score"), "score")


@query("path_row_sums", "pathsum", "SELECT * FROM pathsum")
def _(t):
    return M.path_row_sums(M.exact(edges(t)), t.wpm_member)


@query("wpm_block_sum", "wpm symx m", "SELECT pathway_id, coalesce(b, 0) AS block_sum FROM wpm LEFT JOIN (SELECT x.pathway_id, CAST(sum(score) AS BIGINT) AS b FROM symx JOIN m x ON u = x.variant_idx JOIN m y ON v = y.variant_idx AND x.pathway_id = y.pathway_id GROUP BY 1) USING (pathway_id)")
def _(t):
    return M.wpm_block_sum(M.exact(edges(t)), wpm(t))


_BLOCK = "SELECT path1, path2, coalesce(b, 0) AS block_sum FROM bpm LEFT JOIN (SELECT path1, path2, CAST(sum(score) AS BIGINT) AS b FROM symx JOIN b1 USING (u) JOIN b2 USING (path1, path2, v) GROUP BY 1, 2) USING (path1, path2)"


@query("bpm_block_sum", "bpm b1 b2 symx", _BLOCK)
def _(t):
    return M.bpm_block_sum(M.exact(edges(t)), bpm(t))


@query("bpm_block_sum_ie", "bpm b1 b2 symx", _BLOCK)
def _(t):
    return M.bpm_block_sum_ie(M.exact(edges(t)), t.wpm_member, bpm(t))


def _binary(t):
    return N.binarized(edges(t), 0.0)


@query("chi2_2x2", "marg_d tot", "SELECT variant_idx, round(CASE WHEN x > 0 AND n > x AND nc > x AND nn - nc - n + x > 0 THEN nn::DOUBLE * pow(x::DOUBLE * (nn - nc - n + x) - (n - x)::DOUBLE * (nc - x), 2) / (n::DOUBLE * (nn - n) * nc * (nn - nc)) END, 6) AS stat FROM marg_d CROSS JOIN tot")
def _(t):
    m = N.marginals(N.coded(t.carrier, "D"))
    n = t.sample.agg(F.count("*").alias("nn"), F.sum("pheno").cast("long").alias("nc"))
    rows = m.join(F.broadcast(n), F.lit(True))  # one row
    x, c = F.col("x"), F.col("n")
    return rows.select("variant_idx", F.round(S.chi2_stat(x, c - x, F.col("nc") - x, F.col("nn") - F.col("nc") - c + x), 6).alias("stat"))


@query("wpm_chi2", "wchi", "SELECT pathway_id, indsize, size, gi, bggi, notgi, bgnotgi, round(stat, 6) AS stat, under FROM wchi")
def _(t):
    return _six(M.wpm_chi2(_binary(t), wpm(t), t.n_variants), "stat").withColumns({c: F.col(c).cast("double") for c in ("gi", "bggi", "notgi", "bgnotgi")})


@query("bpm_chi2", "bchi", "SELECT path1, path2, gi, round(stat1, 6) AS stat1, round(stat2, 6) AS stat2, under1, under2, round(density1, 6) AS density1, round(density2, 6) AS density2 FROM bchi")
def _(t):
    return _six(M.bpm_chi2(_binary(t), wpm(t), t.n_variants), "stat1", "stat2", "density1", "density2").select("path1", "path2", "gi", "stat1", "stat2", "under1", "under2", "density1", "density2")


@query("bpm_dense_index", "bside", "SELECT path1, path2, CAST(dense_index AS INTEGER) AS dense_index, round(CASE dense_index WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE 0.0 END, 6) AS signed_stat FROM bside")
def _(t):
    return _six(M.dense_side(M.bpm_chi2(_binary(t), wpm(t), t.n_variants)), "signed_stat").select("path1", "path2", "dense_index", "signed_stat")


@query("bpm_stats_binary", "bside", "SELECT path1, path2, round(gi / size, 6) AS density, round(CASE dense_index WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE 0.0 END, 6) AS local_stat FROM bside WHERE CASE dense_index WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE 0.0 END >= 2.705543")
def _(t):
    rows = M.dense_side(M.bpm_chi2(_binary(t), wpm(t), t.n_variants)).filter("signed_stat >= 2.705543")  # p 0.1
    return _six(rows.select("path1", "path2", (F.col("gi") / F.col("size")).alias("density"), F.col("signed_stat").alias("local_stat")), "density", "local_stat")


@query("block_midranks", "w_rank", "SELECT pathway_id, u, v, score, midrank::DOUBLE AS midrank FROM w_rank")
def _(t):
    return M.block_ranks(M.exact(edges(t)), wpm(t), ["pathway_id"], "ind", t.n_variants).select("pathway_id", "u", "v", "score", F.col("midrank").cast("double").alias("midrank"))


@query("degree_midranks", "degrank", "SELECT variant_idx, degree, midrank::DOUBLE AS midrank FROM degrank")
def _(t):
    return M.degree_ranks(M.exact(edges(t)), t.variant).select("variant_idx", "degree", F.col("midrank").cast("double").alias("midrank"))


@query("tie_correction", "degx", "SELECT sum(n::DOUBLE * n * n - n) AS ties FROM (SELECT count(*) AS n FROM degx GROUP BY degree)")
def _(t):
    return M.degree_ranks(M.exact(edges(t)), t.variant).select("degree", "t").distinct().agg(F.sum(M.tie_term(F.col("t"))).alias("ties"))


def _ranksum(name, prefix, keys, table):
    cols = ", ".join(keys)

    @query(name, f"{prefix}_mw", f"SELECT {cols}, block_sum, round(rank_in::DOUBLE, 4) AS rank_in, round(z, 6) AS z FROM {prefix}_mw")
    def _(t):
        rows = table(t)
        return rows.select(*keys, "block_sum", F.round("rank_in", 4).alias("rank_in"), F.round("z", 6).alias("z"))


def _w_ranks(t):
    return M.rank_sums(M.exact(edges(t)), wpm(t), ["pathway_id"], "ind", "ind", t.n_variants)


def _b_ranks(t):
    chosen = M.dense_side(M.bpm_chi2(_binary(t), wpm(t), t.n_variants))
    return M.bpm_rank_sums(M.exact(edges(t)), wpm(t), chosen, t.n_variants)


_ranksum("wpm_ranksum", "w", ["pathway_id"], _w_ranks)
_ranksum("mann_whitney_z", "w", ["pathway_id"], _w_ranks)
_ranksum("bpm_ranksum", "b", ["path1", "path2"], _b_ranks)

_PD = "degrank m wpm nvar"
from .views import mwz_sql  # noqa: E402

_PATHZ = f"SELECT pathway_id, rank_in, {mwz_sql('rank_in', 'indsize', '(s - indsize)', 'ties')} AS z FROM (SELECT pathway_id, indsize, sum(midrank)::DOUBLE AS rank_in FROM m JOIN degrank USING (variant_idx) GROUP BY 1, 2) CROSS JOIN nvar CROSS JOIN (SELECT sum(n::DOUBLE * n * n - n) AS ties FROM (SELECT count(*) AS n FROM degrank GROUP BY degree))"


@query("path_degree", _PD, f"SELECT pathway_id, round(rank_in, 4) AS rank_in, round(z, 6) AS z FROM ({_PATHZ})")
def _(t):
    return M.path_degree(M.exact(edges(t)), t.variant, wpm(t)).select("pathway_id", F.round(F.col("rank_in").cast("double"), 4).alias("rank_in"), F.round("z", 6).alias("z"))


# The upper tail by Taylor's series of erf; DuckDB has no erf. From |z| = 6 on it is 0 or 1 to six decimals.
_TAYLOR = "CASE WHEN z IS NULL THEN 1.0 WHEN z >= 6 THEN 0.0 WHEN z <= -6 THEN 1.0 ELSE 0.5 - list_sum(list_transform(range(0, 90), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(z, 2 * k + 1) / (pow(2.0, k) * exp(lgamma(k::DOUBLE + 1)) * (2 * k + 1)))) / sqrt(2 * pi()) END"


@query("pvalue_from_z", _PD, f"SELECT pathway_id, round({_TAYLOR}, 6) AS p FROM ({_PATHZ})")
def _(t):
    return M.path_degree(M.exact(edges(t)), t.variant, wpm(t)).select("pathway_id", F.round(S.normal_tail(F.col("z")), 6).alias("p"))


# Both tails of a statistic with one degree of freedom are those of its root.
@query("pvalue_from_chi2", "wchi", f"SELECT pathway_id, round(CASE WHEN z IS NULL THEN 1.0 ELSE 2 * ({_TAYLOR}) END, 6) AS p FROM (SELECT pathway_id, sqrt(stat) AS z FROM wchi)")
def _(t):
    return M.wpm_chi2(_binary(t), wpm(t), t.n_variants).select("pathway_id", F.round(S.chi2_tail(F.col("stat")), 6).alias("p"))


@query("density_expected", "wpm symx m nvar", "SELECT pathway_id, round(coalesce(t, 0) / (indsize * s) / 1e6, 6) AS density_expected FROM wpm LEFT JOIN (SELECT pathway_id, sum(score)::DOUBLE AS t FROM symx JOIN m ON u = variant_idx GROUP BY 1) USING (pathway_id) CROSS JOIN nvar")
def _(t):
    rows = M.expected_density(M.exact(edges(t)), wpm(t), t.n_variants)
    return rows.select("pathway_id", F.round(F.col("density_expected") / 1e6, 6).alias("density_expected"))


@query("module_stats_all", f"wchi w_mw {_PD}", f"SELECT pathway_id, round(stat, 6) AS chi2, under, block_sum, round(w_mw.z, 6) AS z_block, round(d.z, 6) AS z_degree FROM wchi JOIN w_mw USING (pathway_id) JOIN ({_PATHZ}) d USING (pathway_id)")
def _(t):
    e, w, n = M.exact(edges(t)), wpm(t), t.n_variants
    a = M.wpm_chi2(_binary(t), w, n).select("pathway_id", F.round("stat", 6).alias("chi2"), "under")
    b = M.rank_sums(e, w, ["pathway_id"], "ind", "ind", n).select("pathway_id", "block_sum", F.round("z", 6).alias("z_block"))
    return a.join(b, "pathway_id").join(M.path_degree(e, t.variant, w).select("pathway_id", F.round("z", 6).alias("z_degree")), "pathway_id")


def _deal(name, by_cluster):
    part = "PARTITION BY cluster " if by_cluster else ""
    on = "a.n = b.n AND a.cluster = b.cluster" if by_cluster else "a.n = b.n"
    sql = f"SELECT sample_id, b.pheno, a.cluster FROM (SELECT *, row_number() OVER ({part}ORDER BY sample_id) AS n FROM samp) a JOIN (SELECT pheno, cluster, row_number() OVER ({part}ORDER BY md5(concat('1:', sample_id))) AS n FROM samp) b ON {on}"

    @query(name, "samp", sql)
    def _(t):
        return P.permuted_phenotypes(t.sample, 1, by_cluster)


_deal("pheno_perm", False)
_deal("pheno_perm_cluster", True)


@query("pheno_perm_counts", "samp geno", "SELECT variant_idx, CAST(sum(p.pheno) AS BIGINT) AS x FROM geno JOIN (SELECT sample_id, b.pheno FROM (SELECT *, row_number() OVER (ORDER BY sample_id) AS n FROM samp) a JOIN (SELECT pheno, row_number() OVER (ORDER BY md5(concat('1:', sample_id))) AS n FROM samp) b ON a.n = b.n) p USING (sample_id) GROUP BY 1")
def _(t):
    return N.marginals(N.carriers(t.genotype, P.permuted_phenotypes(t.sample, 1), "D")).select("variant_idx", "x")


def _exceed(keys, cols, sums):
    k = ", ".join(keys)
    return (
        f"o AS (SELECT {k}, coalesce(obs, 0) AS obs FROM (SELECT DISTINCT {k} FROM {cols}) LEFT JOIN (SELECT {k}, CAST(sum(a) AS BIGINT) AS obs FROM {cols} JOIN {sums} USING ({k}, v) GROUP BY ALL) USING ({k})), "
        f"p AS (SELECT {', '.join('c.' + x for x in keys)}, k, sum(a) AS s FROM {cols} c JOIN perm ON c.v = perm.v JOIN {sums} r ON r.v = q AND {' AND '.join(f'r.{x} = c.{x}' for x in keys)} GROUP BY ALL) "
        f"SELECT {k}, obs, coalesce(e, 0) AS exceed FROM o LEFT JOIN (SELECT {k}, count(*) AS e FROM p JOIN o USING ({k}) WHERE s > obs GROUP BY ALL) USING ({k})"
    )


from .registry import SQL, with_views  # noqa: E402


def _merge(needs, body):
    """A body that starts with more views."""
    return with_views(needs, "SELECT 1").removesuffix(" SELECT 1") + ", " + body


@query("wpm_perm_exceed")
def _(t):
    e = M.exact(edges(t))
    member = t.wpm_member
    return P.exceedances(M.path_row_sums(e, member), ["pathway_id"], member.withColumnRenamed("variant_idx", "v"), P.permuted_variants(t.variant, 20))


SQL["wpm_perm_exceed"] = _merge("m pathsum perm", "mc AS (SELECT pathway_id, variant_idx AS v FROM m), " + _exceed(["pathway_id"], "mc", "pathsum"))


@query("bpm_perm_exceed")
def _(t):
    e, b = M.exact(edges(t)), bpm(t)
    sums = N.mirrored(e).join(b.select("path1", "path2", F.explode("ind1").alias("u")), "u").groupBy("path1", "path2", "v").agg(F.sum("score").alias("a"))
    return P.exceedances(sums, ["path1", "path2"], b.select("path1", "path2", F.explode("ind2").alias("v")), P.permuted_variants(t.variant, 20))


SQL["bpm_perm_exceed"] = _merge("b1 b2 symx perm", "rs AS (SELECT path1, path2, v, CAST(sum(score) AS BIGINT) AS a FROM symx JOIN b1 USING (u) GROUP BY ALL), " + _exceed(["path1", "path2"], "b2", "rs"))


@query("path_perm_exceed", "m degrank perm", "SELECT pathway_id, obs, count(*) FILTER (s > obs) AS exceed FROM (SELECT pathway_id, CAST(sum(2 * midrank) AS BIGINT) AS obs FROM m JOIN degrank USING (variant_idx) GROUP BY 1) JOIN (SELECT pathway_id, k, CAST(sum(2 * midrank) AS BIGINT) AS s FROM m JOIN perm ON m.variant_idx = perm.v JOIN degrank d ON d.variant_idx = q GROUP BY 1, 2) USING (pathway_id) GROUP BY 1, 2")
def _(t):
    ranks = M.degree_ranks(M.exact(edges(t)), t.variant)
    return P.path_exceedances(ranks, t.wpm_member, P.permuted_variants(t.variant, 20)).select("pathway_id", "obs", "exceed")


@query("empirical_pvalue")
def _(t):
    ranks = M.degree_ranks(M.exact(edges(t)), t.variant)
    rows = P.path_exceedances(ranks, t.wpm_member, P.permuted_variants(t.variant, 20))
    return rows.select("pathway_id", P.empirical_p(F.col("exceed"), 20).alias("pv"))


SQL["empirical_pvalue"] = SQL["path_perm_exceed"].replace("SELECT pathway_id, obs, count(*) FILTER (s > obs) AS exceed", "SELECT pathway_id, (count(*) FILTER (s > obs) + 1) / 20.0::DOUBLE AS pv").replace("GROUP BY 1, 2) USING (pathway_id) GROUP BY 1, 2", "GROUP BY 1, 2) USING (pathway_id) GROUP BY pathway_id, obs")

"""SQL views for the twins: the fixtures and the intermediate tables of the engine, written independently of the operators."""

from __future__ import annotations

from .registry import view

view("geno", "", "SELECT o_custkey AS sample_id, l_suppkey AS variant_idx, least(2, count(*)) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
view("samp", "", "SELECT c_custkey AS sample_id, CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 1 ELSE 0 END AS pheno, c_nationkey AS cluster FROM customer")
view("variant", "", "SELECT s_suppkey AS variant_idx, s_name AS varid, s_nationkey AS chrom, CAST(round((s_acctbal + 1000) * 100) AS BIGINT) AS pos FROM supplier")
view("gene", "", "SELECT 'G' || p_partkey AS gene, p_partkey % 25 AS chrom, (p_partkey * 4801) % 1000000 - 50000 AS s, (p_partkey * 4801) % 1000000 + 50000 AS e FROM part")
view("gene_set", "", "SELECT p_size AS pathway_id, 'G' || p_partkey AS gene FROM part")
view("path_n", "", "SELECT p_size AS pathway_id, l_suppkey AS variant_idx, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
view("member", "path_n", "SELECT pathway_id, variant_idx FROM path_n JOIN (SELECT pathway_id, avg(n) + stddev_samp(n) AS lim FROM path_n GROUP BY 1) USING (pathway_id) WHERE n > lim")
view("wpm_all", "member", "SELECT pathway_id, list(variant_idx ORDER BY variant_idx) AS ind, count(*) AS indsize, count(*) * count(*) - count(*) AS size FROM member GROUP BY 1")
view("wpm", "wpm_all", "SELECT * FROM wpm_all WHERE indsize >= 5")
view("bpm_all", "wpm", "SELECT a.pathway_id AS path1, b.pathway_id AS path2, list_filter(a.ind, lambda x: NOT list_contains(b.ind, x)) AS ind1, list_filter(b.ind, lambda x: NOT list_contains(a.ind, x)) AS ind2 FROM wpm a JOIN wpm b ON a.pathway_id < b.pathway_id")
view("bpm", "bpm_all", "SELECT path1, path2, ind1, ind2, CAST(len(ind1) AS BIGINT) AS ind1size, CAST(len(ind2) AS BIGINT) AS ind2size, CAST(len(ind1) * len(ind2) AS BIGINT) AS size FROM bpm_all WHERE len(ind1) >= 5 AND len(ind2) >= 5")
view("tot", "samp", "SELECT count(*) AS nn, CAST(sum(pheno) AS BIGINT) AS nc FROM samp")
view("nvar", "", "SELECT count(*) AS s FROM supplier")
for _c, _w in (("d", "dosage >= 1"), ("r", "dosage = 2")):
    view(f"car_{_c}", "geno samp", f"SELECT sample_id, variant_idx, pheno FROM geno JOIN samp USING (sample_id) WHERE {_w}")
    view(f"marg_{_c}", f"car_{_c}", f"SELECT variant_idx, count(*) AS n, CAST(sum(pheno) AS BIGINT) AS x FROM car_{_c} GROUP BY 1")
for _m, _a, _b, _w in (("dd", "d", "d", "a.variant_idx > b.variant_idx"), ("rr", "r", "r", "a.variant_idx > b.variant_idx"), ("rd", "r", "d", "a.variant_idx <> b.variant_idx")):
    view(f"pairs_{_m}", f"car_{_a} car_{_b}", f"SELECT a.variant_idx AS u, b.variant_idx AS v, count(*) AS g11, CAST(sum(a.pheno) AS BIGINT) AS x11 FROM car_{_a} a JOIN car_{_b} b ON a.sample_id = b.sample_id AND {_w} GROUP BY 1, 2")
    view(
        f"cells_{_m}", f"pairs_{_m} marg_{_a} marg_{_b} tot",
        f"SELECT u, v, nn, nc, g11, x11, a.n - g11 AS g10, a.x - x11 AS x10, b.n - g11 AS g01, b.x - x11 AS x01, nn - a.n - b.n + g11 AS g00, nc - a.x - b.x + x11 AS x00 "
        f"FROM pairs_{_m} JOIN marg_{_a} a ON u = a.variant_idx JOIN marg_{_b} b ON v = b.variant_idx CROSS JOIN tot",
    )


def tail_sql(x: str, g: str, d: str, n: str) -> str:
    """P(X >= x) by lgamma."""
    lf = lambda e: f"lgamma(({e})::DOUBLE + 1)"
    term = f"exp({lf(g)} - {lf('i')} - {lf(f'{g} - i')} + {lf(f'{n} - {g}')} - {lf(f'{d} - i')} - {lf(f'{n} - {g} - {d} + i')} - {lf(n)} + {lf(d)} + {lf(f'{n} - {d}')})"
    return f"coalesce(list_sum(list_transform(range(greatest({x}, 0, {d} - ({n} - {g})), least({g}, {d}) + 1), lambda i: {term})), 0.0)"


for _m in ("dd", "rr", "rd"):
    for _e, _d, _x in (("risk", "nc", "x{c}"), ("prot", "nn - nc", "g{c} - x{c}")):
        _p = ", ".join(f"{tail_sql('(' + _x.format(c=c) + ')', f'g{c}', f'({_d})', 'nn')} + 1e-10 AS p{c}" for c in ("11", "10", "01", "00"))
        view(f"tails_{_m}_{_e}", f"cells_{_m}", f"SELECT u, v, {_p} FROM cells_{_m}")
        view(
            f"scores_{_m}_{_e}", f"tails_{_m}_{_e}",
            f"SELECT u, v, greatest(-log10(p11 / least(p10, p01, p00)), 0.0) AS score FROM tails_{_m}_{_e} WHERE p11 <= 0.05 AND p10 > 0.05 AND p01 > 0.05 AND p00 > 0.05 AND p11 < least(p10, p01, p00)",
        )
view("net_rd_risk", "scores_rd_risk", "SELECT greatest(u, v) AS u, least(u, v) AS v, max(score) AS score FROM scores_rd_risk GROUP BY 1, 2")
view("sym", "scores_dd_risk", "SELECT u, v, score FROM scores_dd_risk UNION ALL SELECT v, u, score FROM scores_dd_risk")
view("bin", "scores_dd_risk", "SELECT u, v, 1.0::DOUBLE AS score FROM scores_dd_risk")
view("symb", "sym", "SELECT u, v, 1.0::DOUBLE AS score FROM sym")
view("symx", "sym", "SELECT u, v, CAST(round(score * 1e6) AS BIGINT) AS score FROM sym")
view("m", "wpm", "SELECT pathway_id, indsize, unnest(ind) AS variant_idx FROM wpm")
view("degb", "symb", "SELECT u, sum(score) AS d FROM symb GROUP BY 1")
view("pathsum", "symx m", "SELECT pathway_id, v, CAST(sum(score) AS BIGINT) AS a FROM symx JOIN m ON u = variant_idx GROUP BY 1, 2")
view("wblock", "wpm symb m", "SELECT pathway_id, coalesce(b, 0.0) AS gi FROM wpm LEFT JOIN (SELECT x.pathway_id, sum(score) AS b FROM symb JOIN m x ON u = x.variant_idx JOIN m y ON v = y.variant_idx AND x.pathway_id = y.pathway_id GROUP BY 1) USING (pathway_id)")
view("wtot", "wpm degb m", "SELECT pathway_id, coalesce(t, 0.0) AS t FROM wpm LEFT JOIN (SELECT pathway_id, sum(d) AS t FROM m JOIN degb ON u = variant_idx GROUP BY 1) USING (pathway_id)")
view("b1", "bpm", "SELECT path1, path2, unnest(ind1) AS u FROM bpm")
view("b2", "bpm", "SELECT path1, path2, unnest(ind2) AS v FROM bpm")
view("bblock", "bpm b1 b2 symb", "SELECT path1, path2, coalesce(b, 0.0) AS gi FROM bpm LEFT JOIN (SELECT path1, path2, sum(score) AS b FROM symb JOIN b1 USING (u) JOIN b2 USING (path1, path2, v) GROUP BY 1, 2) USING (path1, path2)")
view("btot", "bpm b1 b2 degb", "SELECT path1, path2, coalesce(x.t, 0.0) AS t1, coalesce(y.t, 0.0) AS t2 FROM bpm LEFT JOIN (SELECT path1, path2, sum(d) AS t FROM b1 JOIN degb USING (u) GROUP BY 1, 2) x USING (path1, path2) LEFT JOIN (SELECT path1, path2, sum(d) AS t FROM b2 JOIN degb ON b2.v = degb.u GROUP BY 1, 2) y USING (path1, path2)")


def chi2_sql(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} >= 0 AND {c} >= 0 AND {d} >= 0 AND ({a}+{b})*({c}+{d})*({a}+{c})*({b}+{d}) <> 0 THEN ({a}+{b}+{c}+{d}) * pow({a}*{d} - {b}*{c}, 2) / (({a}+{b})*({c}+{d})*({a}+{c})*({b}+{d})) END"


def share_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} <> 0 THEN {a} / ({a} + {b}) END"


view("wcell", "wpm wblock wtot nvar", "SELECT pathway_id, indsize, size, gi, t - gi AS bggi, size - gi AS notgi, indsize * s - (t - gi) - size AS bgnotgi FROM wpm JOIN wblock USING (pathway_id) JOIN wtot USING (pathway_id) CROSS JOIN nvar")
view("wchi", "wcell", f"SELECT *, {chi2_sql('gi', 'bggi', 'notgi', 'bgnotgi')} AS stat, coalesce({share_sql('gi', 'notgi')} < {share_sql('bggi', 'bgnotgi')}, false) AS under FROM wcell")
view("bcell", "bpm bblock btot nvar", "SELECT path1, path2, ind1, ind2, ind1size, ind2size, size, gi, greatest(size - gi, 0.0) AS notgi, t1 - gi AS bg1, t2 - gi AS bg2, ind1size * s - (t1 - gi) - size AS bgnot1, ind2size * s - (t2 - gi) - size AS bgnot2 FROM bpm JOIN bblock USING (path1, path2) JOIN btot USING (path1, path2) CROSS JOIN nvar")
view(
    "bchi", "bcell",
    "SELECT *, " + ", ".join(f"{chi2_sql('gi', f'bg{i}', 'notgi', f'bgnot{i}')} AS stat{i}, coalesce({share_sql('gi', 'notgi')} < {share_sql(f'bg{i}', f'bgnot{i}')}, false) AS under{i}, CASE WHEN bgnot{i} + bg{i} + size <> 0 THEN (gi + bg{i}) / (bgnot{i} + bg{i} + size) END AS density{i}" for i in (1, 2)) + " FROM bcell",
)
view("bsign", "bchi", "SELECT *, CASE WHEN under1 THEN -coalesce(stat1, 0.0) ELSE coalesce(stat1, 0.0) END AS g1, CASE WHEN under2 THEN -coalesce(stat2, 0.0) ELSE coalesce(stat2, 0.0) END AS g2 FROM bchi")
view("bside", "bsign", "SELECT *, CASE WHEN g1 < g2 THEN 1 WHEN g1 > g2 THEN 2 WHEN coalesce(density1, 0.0) > coalesce(density2, 0.0) THEN 1 WHEN coalesce(density1, 0.0) < coalesce(density2, 0.0) THEN 2 ELSE 0 END AS dense_index FROM bsign")
view("degx", "variant symx", "SELECT variant_idx, coalesce(d, 0) AS degree FROM variant LEFT JOIN (SELECT u, CAST(sum(score) AS BIGINT) AS d FROM symx GROUP BY 1) ON u = variant_idx")
view("degrank", "degx", "SELECT variant_idx, degree, count(*) OVER (PARTITION BY degree) AS t, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS midrank FROM degx")
view("perm", "variant", "SELECT k, variant_idx AS v, row_number() OVER (PARTITION BY k ORDER BY md5(concat(k, ':', variant_idx))) - 1 AS q FROM variant CROSS JOIN (SELECT unnest(range(1, 21)) AS k)")


def mwz_sql(rank_in: str, n1: str, n2: str, ties: str) -> str:
    n = f"(({n1})::DOUBLE + ({n2}))"
    var = f"(({n1})::DOUBLE * ({n2}) * ({n} + 1.0 - ({ties}) / ({n} * ({n} - 1.0))) / 12.0)"
    return f"CASE WHEN {var} > 0 THEN (({rank_in}) - ({n1})::DOUBLE * (({n1}) + 1.0) / 2.0 - ({n1})::DOUBLE * ({n2}) / 2.0 - 0.5) / sqrt({var}) END"


def rank_views(prefix: str, keys: str, sets: str, rows: str, cols: str) -> None:
    """Block midranks and rank sums of modules in `sets` with row and column lists."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    view(f"{prefix}_row", sets, f"SELECT {keys}, CAST(len({rows}) AS BIGINT) AS nr, unnest({rows}) AS u FROM {sets}")
    view(f"{prefix}_col", sets, f"SELECT {keys}, unnest({cols}) AS v FROM {sets}")
    view(
        f"{prefix}_rank", f"{prefix}_row symx nvar",
        f"SELECT {keys}, u, v, score, nr * s - count(*) OVER (PARTITION BY {keys}) AS zeros, count(*) OVER (PARTITION BY {keys}, score) AS t, "
        f"rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 + nr * s - count(*) OVER (PARTITION BY {keys}) AS midrank FROM symx JOIN {prefix}_row USING (u) CROSS JOIN nvar",
    )
    view(
        f"{prefix}_sums", f"{prefix}_rank {prefix}_col",
        f"SELECT {', '.join('x.' + k for k in keys.split(', '))}, zeros, CAST(sum(CASE WHEN y.v IS NOT NULL THEN score ELSE 0 END) AS BIGINT) AS bs, sum(CASE WHEN y.v IS NOT NULL THEN midrank ELSE 0.0 END) AS ranked, count(y.v) AS stored, sum(t::DOUBLE * t - 1) AS ties "
        f"FROM {prefix}_rank x LEFT JOIN {prefix}_col y ON {on} AND x.v = y.v GROUP BY ALL",
    )
    view(
        f"{prefix}_mw0", f"{prefix}_sums {sets} nvar",
        f"SELECT {keys}, CAST(len({rows}) AS BIGINT) AS nr, CAST(len({rows}) * len({cols}) AS BIGINT) AS n_in, coalesce(bs, 0) AS block_sum, coalesce(zeros, len({rows}) * s) AS z0, coalesce(ranked, 0.0) AS ranked, coalesce(stored, 0) AS stored, coalesce(ties, 0.0) AS ties0, s FROM {sets} LEFT JOIN {prefix}_sums USING ({keys}) CROSS JOIN nvar",
    )
    view(f"{prefix}_mw1", f"{prefix}_mw0", f"SELECT *, ranked + (n_in - stored) * (z0 + 1) / 2.0 AS rank_in, ties0 + CASE WHEN z0 > 1 THEN z0::DOUBLE * z0 * z0 - z0 ELSE 0.0 END AS ties FROM {prefix}_mw0")
    view(f"{prefix}_mw", f"{prefix}_mw1", f"SELECT *, {mwz_sql('rank_in', 'n_in', '(nr * s - n_in)', 'ties')} AS z FROM {prefix}_mw1")


rank_views("w", "pathway_id", "wpm", "ind", "ind")
view("bswap", "bside", "SELECT path1, path2, CASE WHEN dense_index = 2 THEN ind2 ELSE ind1 END AS r_ind, CASE WHEN dense_index = 2 THEN ind1 ELSE ind2 END AS c_ind FROM bside")
rank_views("b", "path1, path2", "bswap", "r_ind", "c_ind")
view("point", "", "SELECT l_linenumber - 1 AS r, l_suppkey AS module, (CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) % 40 + 1) / 400.0::DOUBLE AS pv, (CAST(sum(l_partkey) AS BIGINT) % 500) / 100.0::DOUBLE AS s FROM lineitem GROUP BY 1, 2")
view("real", "point", "SELECT module, pv, s FROM point WHERE r = 0")
view("dom", "point real", "SELECT q.module, q.pv, q.s, count(*) FILTER (p.r = 0) AS m1, count(*) FILTER (p.r = 0 AND p.s >= q.s) AS n1, count(*) FILTER (p.r > 0) AS m2, count(*) FILTER (p.r > 0 AND p.s >= q.s) AS n2 FROM real q JOIN point p ON p.pv <= q.pv WHERE q.pv <= 0.05 GROUP BY 1, 2, 3")
view("raw", "dom", "SELECT *, m2 / (6.0 * m1) AS raw1, n2 / (6.0 * n1) AS raw2 FROM dom")
view("pcs", "", "SELECT vec_id AS iid, CASE WHEN label < 5 THEN 1 ELSE 0 END AS pheno, label AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS pc FROM embeddings")
view("pcdim", "pcs", "SELECT iid, pheno, cluster, unnest(range(0, 64)) AS dim, unnest(pc) AS x FROM pcs")
view("cent", "pcdim", "SELECT cluster, dim, avg(x) AS mean FROM pcdim GROUP BY 1, 2")

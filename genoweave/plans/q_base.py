"""Queries: sources, sinks, genotypes, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import cohort as C
from ..operators import sets as G
from ..sources import text as X
from .registry import query


@query("src_try_cast", sql="SELECT c_custkey, try_cast(c_mktsegment AS BIGINT) AS bad, try_cast(substr(c_name, 10) AS BIGINT) AS good FROM customer")
def _(t):
    return t.table("customer").select("c_custkey", X.cast_or_null(F.col("c_mktsegment")).alias("bad"), X.cast_or_null(F.substring("c_name", 10, 99)).alias("good"))


_LINE = "replace(replace({c}, chr(10), ' '), ' ', chr(9))"


@query("src_gmt_split", sql=f"SELECT item_id, split_part({_LINE.format(c='text')}, chr(9), 1) AS name, split_part({_LINE.format(c='text')}, chr(9), 2) AS url, CAST(len(string_split({_LINE.format(c='text')}, chr(9))) - 2 AS BIGINT) AS members, string_split({_LINE.format(c='text')}, chr(9))[3] AS first FROM benchmark")
def _(t):
    line = F.translate("text", "\n ", "\t\t")
    name, url, members = X.gmt_fields(line)
    return t.table("benchmark").select("item_id", name.alias("name"), url.alias("url"), F.size(members).cast("long").alias("members"), F.get(members, F.lit(0)).alias("first"))


@query("src_whitespace_tokens", sql="SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, w[1] AS first, w[-1] AS last FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '#[^\\n]*', '', 'g'), '[ \\t\\n]+'), lambda x: x <> '') AS w FROM documents)")
def _(t):
    w = X.whitespace_tokens(F.col("text"))
    return t.table("documents").select("doc_id", F.size(w).cast("long").alias("tokens"), F.try_element_at(w, F.lit(1)).alias("first"), F.try_element_at(w, F.lit(-1)).alias("last"))


@query("recode_pheno", sql="SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN 'case' WHEN 1 THEN 'control' ELSE 'missing' END AS pheno FROM part")
def _(t):
    return t.table("part").select("p_partkey", X.recoded_pheno(F.col("p_size") % 4).alias("pheno"))


@query("unpivot_onehot", sql="SELECT n_nationkey, 'r' || n_regionkey AS name FROM nation WHERE n_regionkey < 4")
def _(t):
    cols = [f"r{i}" for i in range(4)]
    rows = t.table("nation").select("n_nationkey", *[(F.col("n_regionkey") == i).cast("int").alias(c) for i, c in enumerate(cols)])
    return X.unpivoted(rows, "n_nationkey", cols)


@query("first_onehot", sql="SELECT n_nationkey, CASE WHEN n_regionkey < 4 THEN 'r' || n_regionkey ELSE 'other' END AS name FROM nation")
def _(t):
    cols = [f"r{i}" for i in range(4)]
    rows = t.table("nation").select("n_nationkey", *[(F.col("n_regionkey") == i).cast("int").alias(c) for i, c in enumerate(cols)])
    return rows.select("n_nationkey", X.first_hot(cols, "other").alias("name"))


@query("sink_gmt_lines", "gene_set", "SELECT pathway_id, concat('P', pathway_id, chr(9), 'na', chr(9), string_agg(gene, chr(9) ORDER BY gene)) AS line FROM gene_set GROUP BY pathway_id")
def _(t):
    own = t.gene_set.groupBy("pathway_id").agg(F.sort_array(F.collect_list("gene")).alias("g"))
    return own.select("pathway_id", X.gmt_line(F.concat(F.lit("P"), "pathway_id"), F.lit("na"), F.col("g")).alias("line"))


@query("sink_cell_format", sql="SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' WHEN 3 THEN '' ELSE printf('%.6f', c_acctbal) END AS cell FROM customer")
def _(t):
    k, f = F.col("c_custkey") % 5, lambda x: F.lit(float(x))
    value = F.when(k == 0, f("nan")).when(k == 1, f("inf")).when(k == 2, f("-inf")).when(k == 3, F.lit(None)).otherwise(F.col("c_acctbal"))
    return t.table("customer").select("c_custkey", X.cell(value).alias("cell"))


_CALLS = "SELECT sample_id, variant_idx, CASE WHEN (sample_id + variant_idx) % 7 = 0 THEN NULL ELSE CAST(dosage AS INTEGER) END AS dosage FROM geno"


def _calls(t):
    gone = (F.col("sample_id") + F.col("variant_idx")) % 7 == 0
    return t.genotype.select("sample_id", "variant_idx", F.when(~gone, F.col("dosage")).alias("dosage"))


@query("impute_zero", "geno", f"SELECT sample_id, variant_idx, coalesce(dosage, 0) AS dosage FROM ({_CALLS})")
def _(t):
    return _calls(t).withColumn("dosage", F.coalesce("dosage", F.lit(0)))


@query("impute_mode", "geno", f"SELECT sample_id, variant_idx, coalesce(dosage, mode) AS dosage FROM ({_CALLS}) JOIN (SELECT variant_idx, arg_max(dosage, n * 10 - dosage) AS mode FROM (SELECT variant_idx, dosage, count(*) AS n FROM ({_CALLS}) WHERE dosage IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (variant_idx)")
def _(t):
    return C.mode_imputed(_calls(t))


@query("genotype_coding", "geno", "SELECT sample_id, variant_idx, CAST(dosage >= 1 AS INTEGER) AS dominant, CAST(dosage = 2 AS INTEGER) AS recessive FROM geno")
def _(t):
    d = F.col("dosage")
    return t.genotype.select("sample_id", "variant_idx", (d >= 1).cast("int").alias("dominant"), (d == 2).cast("int").alias("recessive"))


@query("genotype_composition", "geno samp", "SELECT pheno, CAST(dosage AS INTEGER) AS dosage, count(*) AS n FROM geno JOIN samp USING (sample_id) GROUP BY 1, 2")
def _(t):
    return t.genotype.join(t.sample, "sample_id").groupBy("pheno", "dosage").agg(F.count("*").alias("n"))


@query("maf_histogram", "geno samp", "SELECT least(CAST(floor(maf * 100) AS BIGINT), 49) AS bin, count(*) AS n FROM (SELECT variant_idx, least(sum(dosage) / (2.0::DOUBLE * (SELECT count(*) FROM samp)), 1 - sum(dosage) / (2.0::DOUBLE * (SELECT count(*) FROM samp))) AS maf FROM geno GROUP BY 1) GROUP BY 1")
def _(t):
    rows = C.allele_frequency(t.genotype, t.total[0])
    return rows.groupBy(F.least(F.floor(F.col("maf") * 100), F.lit(49)).alias("bin")).agg(F.count("*").alias("n"))


@query("geneset_size_filter", "gene_set", "SELECT pathway_id, count(*) AS n FROM gene_set GROUP BY 1 HAVING count(*) BETWEEN 10 AND 40")
def _(t):
    return G.size_filter(t.gene_set, "pathway_id", 10, 40)


_WORDS = "SELECT DISTINCT doc_id AS set_id, unnest(string_split(trim(lower(regexp_replace(text, '[ \\n]+', ' ', 'g'))), ' ')) AS item FROM documents"
_PAIRS = (
    f"w0 AS (SELECT * FROM ({_WORDS}) WHERE item <> ''), n AS (SELECT set_id, count(*) AS n FROM w0 GROUP BY 1 HAVING count(*) BETWEEN 10 AND 300), w AS (SELECT * FROM w0 WHERE set_id IN (SELECT set_id FROM n)), "
    "p AS (SELECT a.set_id AS a, b.set_id AS b, count(*) AS inter FROM w a JOIN w b ON a.item = b.item AND a.set_id < b.set_id GROUP BY 1, 2), "
    "sim AS (SELECT a, b, x.n AS na, y.n AS nb, inter, x.n + y.n - inter AS union_size, inter / (x.n + y.n - inter)::DOUBLE AS jaccard, inter / least(x.n, y.n)::DOUBLE AS overlap FROM p JOIN n x ON a = x.set_id JOIN n y ON b = y.set_id)"
)


@query("set_pair_similarity", sql=f"WITH {_PAIRS} SELECT a, b, inter, union_size, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM sim WHERE jaccard >= 0.2")
def _(t):
    rows = G.similar_pairs(t.word_set, "set_id", "item", 0.2)
    return rows.select("a", "b", "inter", "union_size", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


def _greedy(mode: str, test: str) -> None:
    # Rounds over the similar pairs: a later set goes if an earlier kept one is similar; it stays once all earlier similar ones are gone.
    gone = "SELECT hi FROM e WHERE list_contains(g.kept, lo)"
    sql = (
        f"WITH RECURSIVE {_PAIRS}, o AS (SELECT set_id, row_number() OVER (ORDER BY n, set_id) AS k FROM n), "
        f"e AS MATERIALIZED (SELECT least(x.k, y.k) AS lo, greatest(x.k, y.k) AS hi FROM sim JOIN o x ON a = x.set_id JOIN o y ON b = y.set_id WHERE {test}), c AS MATERIALIZED (SELECT lo AS k FROM e UNION SELECT hi FROM e), "
        f"g(step, kept, n) AS (SELECT 0, []::BIGINT[], -1::BIGINT UNION ALL SELECT step + 1, (SELECT list(k) FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE hi = k AND lo NOT IN ({gone}))), len(kept) FROM g WHERE len(kept) <> n) "
        "SELECT set_id FROM o WHERE k NOT IN (SELECT k FROM c) OR list_contains((SELECT kept FROM g ORDER BY step DESC LIMIT 1), k)"
    )

    @query(f"geneset_greedy_dedupe_{mode}", sql=sql)
    def _(t):
        return G.greedy_distinct(t.word_set, "set_id", "item", mode)


_greedy("jaccard", "jaccard >= 0.5")
_greedy("overlap", "overlap >= 0.5")
_greedy("either", "jaccard >= 0.5 OR overlap >= 0.5")


@query("gene_window_expand", "gene", "SELECT gene, CAST(chrom AS INTEGER) AS chrom, greatest(s - 20000, 1) AS start, e + 20000 AS \"end\" FROM gene")
def _(t):
    return G.expand_windows(t.gene, 20000)


@query("variant_gene_interval_join", "variant gene", "SELECT variant_idx, gene FROM variant v JOIN gene g ON v.chrom = g.chrom AND pos BETWEEN s AND e")
def _(t):
    return G.variants_in_genes(t.variant, t.gene)


@query("variant_pathway_map", "variant gene gene_set", "SELECT DISTINCT pathway_id, variant_idx FROM variant v JOIN gene g ON v.chrom = g.chrom AND pos BETWEEN s AND e JOIN gene_set USING (gene)")
def _(t):
    return G.variants_in_sets(G.variants_in_genes(t.variant, t.gene), t.gene_set)


_J = "array_to_string(list_transform({c}, lambda x: x::VARCHAR), ',')"


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("wpm_index_sets", "wpm", f"SELECT pathway_id, {_J.format(c='ind')} AS ind, indsize, size FROM wpm")
def _(t):
    return t.wpm.withColumn("ind", joined("ind"))


@query("bpm_index_sets", "bpm", f"SELECT path1, path2, {_J.format(c='ind1')} AS ind1, {_J.format(c='ind2')} AS ind2, ind1size, ind2size, size FROM bpm")
def _(t):
    return t.bpm.withColumn("ind1", joined("ind1")).withColumn("ind2", joined("ind2"))


@query("dedupe_row_sets", "wpm bpm", "SELECT path1, path2, dense_rank() OVER (ORDER BY ind1) - 1 AS row_set_id FROM bpm")
def _(t):
    return G.row_set_ids(t.bpm.select("path1", "path2", "ind1"), "ind1").select("path1", "path2", F.col("row_set_id").cast("long").alias("row_set_id"))


@query("hypergeom_tail", "marg_d tot", None)
def _(t):
    from ..operators import network as N

    m = N.marginals(N.coded(t.carrier, "D"))
    n = t.sample.agg(F.count("*").alias("nn"), F.sum("pheno").cast("long").alias("nc"))
    known = m.select("n", "x").distinct().join(F.broadcast(n), F.lit(True))  # one row
    return known.select("n", "x", F.round(S.hypergeometric_tail(F.col("x"), F.col("n"), F.col("nc"), F.col("nn")), 6).alias("p"))


def _tail_twin() -> None:
    from .registry import SQL, with_views
    from .views import tail_sql

    SQL["hypergeom_tail"] = with_views("marg_d tot", f"SELECT n, x, round({tail_sql('x', 'n', 'nc', 'nn')}, 6) AS p FROM (SELECT DISTINCT n, x FROM marg_d) CROSS JOIN tot")


_tail_twin()

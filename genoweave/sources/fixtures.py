"""The engine's data model as views of the test tables.

genotype(sample_id, variant_idx, dosage)  only dosages above 0 are stored; 0 is the fill value
sample(sample_id, pheno, cluster)         pheno 1: case
variant(variant_idx, varid, chrom, pos)   variant_idx is dense from 0
gene(gene, chrom, start, end)
member(pathway_id, variant_idx)           a pathway's variants
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import network as N
from ..operators.sets import bpm_sets, wpm_sets
from ..store import written


_shared: dict[tuple, dict] = {}


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def genotype(self) -> DataFrame:
        line, orders = self.table("lineitem").select("l_orderkey", "l_suppkey"), self.table("orders").select("o_orderkey", "o_custkey")
        pairs = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("sample_id"), F.col("l_suppkey").alias("variant_idx"))
        return pairs.agg(F.least(F.lit(2), F.count("*").cast("int")).alias("dosage"))

    @cached_property
    def sample(self) -> DataFrame:
        case = F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").cast("int")
        return self.table("customer").select(F.col("c_custkey").alias("sample_id"), case.alias("pheno"), F.col("c_nationkey").alias("cluster"))

    @cached_property
    def variant(self) -> DataFrame:
        pos = F.round((F.col("s_acctbal") + 1000) * 100).cast("long")
        return self.table("supplier").select(F.col("s_suppkey").alias("variant_idx"), F.col("s_name").alias("varid"), F.col("s_nationkey").alias("chrom"), pos.alias("pos"))

    @cached_property
    def gene(self) -> DataFrame:
        k = F.col("p_partkey")
        mid = (k * 4801) % 1000000
        return self.table("part").select(F.concat(F.lit("G"), k.cast("string")).alias("gene"), (k % 25).cast("int").alias("chrom"), (mid - 50000).alias("start"), (mid + 50000).alias("end"))

    @cached_property
    def member(self) -> DataFrame:
        line, part = self.table("lineitem").select("l_partkey", "l_suppkey"), self.table("part").select("p_partkey", "p_size")
        n = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_size").alias("pathway_id"), F.col("l_suppkey").alias("variant_idx")).agg(F.count("*").alias("n"))
        limit = n.groupBy("pathway_id").agg((F.avg("n") + F.stddev_samp("n")).alias("limit"))
        return n.join(limit, "pathway_id").filter("n > limit").select("pathway_id", "variant_idx")

    # Stored tables, as the engine's stages leave them for the next one. A session makes each once for a state of the input files.

    @cached_property
    def _stored(self) -> dict:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        state = []
        for name in ("lineitem", "orders", "customer", "supplier", "part"):
            at = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            status = at.getFileSystem(conf).getFileStatus(at)
            state.append((name, status.getLen(), status.getModificationTime()))
        return _shared.setdefault((self.spark.sparkContext.applicationId, self.sf_dir, *state), {})

    def _once(self, name, make):
        if name not in self._stored:
            self._stored[name] = make()
        return self._stored[name]

    @property
    def carrier(self) -> DataFrame:
        return self._once("carrier", lambda: N.carrier_table(self.genotype, self.sample))

    @property
    def total(self) -> tuple[int, int]:
        return self._once("total", lambda: N.totals(self.sample))

    @property
    def n_variants(self) -> int:
        return self._once("variants", self.variant.count)

    def network(self, model: str = "DD", effect: str = "risk", again: bool = False) -> DataFrame:
        """The stored network; again: computed anew."""
        if again:
            self._stored.pop((model, effect), None)
        return self._once((model, effect), lambda: N.network_of(self.carrier, self.total, self.n_variants, model, effect))

    @property
    def wpm(self) -> DataFrame:
        return self._once("wpm", lambda: written(wpm_sets(self.member), "wpm"))

    @property
    def wpm_member(self) -> DataFrame:
        return self.wpm.select("pathway_id", F.explode("ind").alias("variant_idx"))

    @property
    def bpm(self) -> DataFrame:
        return self._once("bpm", lambda: written(bpm_sets(self.wpm), "bpm"))

    @cached_property
    def gene_set(self) -> DataFrame:
        """pathway_id, gene: part sizes as pathways, their parts as genes."""
        return self.table("part").select(F.col("p_size").alias("pathway_id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"))

    @cached_property
    def word_set(self) -> DataFrame:
        """set_id, item: distinct lower-cased words of documents; sets of 10 to 300 words, as gene sets are filtered."""
        words = F.array_remove(F.array_distinct(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")), "")
        rows = self.table("documents").select(F.col("doc_id").alias("set_id"), words.alias("items"))  # a row a document, so sizes are known before words become rows
        return rows.filter(F.size("items").between(10, 300)).select("set_id", F.explode("items").alias("item"))

    @cached_property
    def coordinate(self) -> DataFrame:
        """iid, pheno, pc: embeddings as principal components."""
        return self.table("embeddings").select(F.col("vec_id").alias("iid"), (F.col("label") < 5).cast("int").alias("pheno"), F.col("label").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("pc"))

    @cached_property
    def score_point(self) -> DataFrame:
        """r, module, pv, s: p-values and scores of modules in the real network (r 0) and random ones."""
        g = self.table("lineitem").groupBy((F.col("l_linenumber") - 1).alias("r"), F.col("l_suppkey").alias("module"))
        q, k = F.sum(F.col("l_quantity").cast("long")), F.sum("l_partkey")
        return g.agg(((q % 40 + 1) / 400.0).alias("pv"), ((k % 500) / 100.0).alias("s"))

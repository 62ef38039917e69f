"""What the operators of this subpackage share: shared storage, word rules, hot-safe numbering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..store import drop, new_folder, release, written  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def sample_ids(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` ids, those with the least hashes, so that the sample is the same on every run; written, so small it can be broadcast."""
    ids = rows.select(F.col(id_col).alias("doc_id")).filter(F.col("doc_id").isNotNull()).distinct()
    return written(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")


def sample_texts(docs: DataFrame, labelled: DataFrame, label_col: str, most: int, id_col: str, text_col: str) -> DataFrame:
    """t, y: texts of at most `most` rows, half of each label if there are as many, however often an id or a label is repeated."""
    known = labelled.filter(F.col(label_col).isNotNull())
    halves = [sample_ids(known.filter(F.col(label_col) == y), most // 2, id_col).withColumn("y", F.lit(y)) for y in (0, 1)]
    ids = halves[0].unionByName(halves[1]).withColumnRenamed("doc_id", "__id")
    found = docs.select(id_col, F.col(text_col).alias("t")).join(F.broadcast(ids), F.col(id_col) == F.col("__id")).select("t", "y")
    order = (F.xxhash64("t"), "t")  # a limit in a fixed order, and of rows: repeated ids can't make more
    return found.filter("y = 0").orderBy(*order).limit(most // 2).unionByName(found.filter("y = 1").orderBy(*order).limit(most // 2))


def in_one_task(rows: DataFrame, fit, empty):
    """fit(texts, labels) of a bounded sample, run in an executor: neither its texts nor its work are the driver's."""
    import pickle

    def run(batches):
        import pyarrow as pa

        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, marks))], pa.binary())], ["model"])

    model = rows.select("t", "y").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(model["model"])) if model else empty()


def by_text(docs: DataFrame, one, columns: list[tuple[str, str]], id_col: str, text_col: str) -> DataFrame:
    """doc_id and one(text) (a tuple of `columns`) of every row. Ids stay Arrow integers, so null and large ones come through; null text is empty."""
    names = [c for c, _ in columns]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [one(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], KINDS[k]()) for i, (_, k) in enumerate(columns))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {k}" for c, k in columns)]))


class _Kinds(dict):
    def __missing__(self, kind):
        import pyarrow as pa

        return {"long": pa.int64, "double": pa.float64, "boolean": pa.bool_, "binary": pa.binary}[kind]


KINDS = _Kinds()


def held_out(modulus: int, rest: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words; null: 0. JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def numbered(df: DataFrame, groups: list[str], order: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds out, gapless from 0 within each group, in an order that the values of `order` alone fix.

    A group may hold any share of the rows: it is cut into `buckets` hash buckets of `order`, each
    numbered by itself, and a prefix sum over the bucket counts shifts them. No task sees a whole group.
    Rows tied in `order` take the bucket's numbers in the order of all their columns.
    """
    b, n, before = (f"__{x}_{out}" for x in ("b", "n", "before"))
    rows = df.withColumn(b, F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int"))
    own = W.partitionBy(*groups, b)
    counts = rows.groupBy(*groups, b).agg(F.count("*").alias(n))
    before_bucket = W.partitionBy(*groups).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(n).over(before_bucket), F.lit(0))).drop(n)
    ties = [c for c in df.columns if c != order]
    ranked = rows.withColumn(n, F.row_number().over(own.orderBy(F.col(order), *[F.col(c) for c in ties])))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in groups] + [F.col(f"l.{b}") == F.col(f"r.{b}")]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ranked.alias("l").join(counts.alias("r"), cond)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"r.{before}") + F.col(f"l.{n}") - 1).cast("long").alias(out))


def bucket_count(rows: int, per: int, least: int = 64, most: int = 1 << 20) -> int:
    """Hash buckets so that each holds about `per` rows."""
    return min(most, max(least, math.ceil(rows / per)))


def with_schema(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])

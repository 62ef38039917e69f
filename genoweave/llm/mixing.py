"""Mixing sources to target weights, JVM-side only.

Every document has a 64-bit hash. For each source, sizes are summed by hash bucket; the prefix sums say
which bucket holds the budget's threshold; only that bucket is summed again, in finer buckets, until it is
a single hash value. The mix is then a filter by hash: nothing is sorted, and a smaller budget takes a
subset of what a larger one takes (the thresholds are nested).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import n_words, written

BITS, ROUND = 60, 12


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """Narrow rows: doc_id, source, size (words; null text: 0) and a hash of id and size in [0, 2^60)."""
    size = n_words(F.col(text_col)) if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    return rows.withColumn("h", document_hash(F.col("doc_id"), F.col("size"), F.col("source")))


def document_hash(doc_id: Column, size: Column, source: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id, size, source), 64 - BITS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, none above `most` times its source's size.

    Sources by code point, null last, take the weights in turn. What a source can't take is shared
    again by weight among those below their limit, until none is above. One short row a source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")))
    own = written(own.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("full", F.lit(False)), "sources")
    while True:
        row = own.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).alias("given"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("weights")).first()
        each = ((row["all"] or 0) - row["given"]) / row["weights"] if row["weights"] else 0.0
        share = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.lit(float(each)))
        over = ~F.col("full") & (share > F.col("limit"))
        if not own.filter(over).take(1):
            return own.select("source", F.col("source_size").cast("long").alias("source_size"), share.alias("target"))
        own = own.withColumn("full", F.col("full") | over)


def thresholds(sizes: DataFrame, targets: DataFrame, most: float = 3) -> DataFrame:
    """targets with copies (whole ones of every document) and below (one more for each document with a smaller hash).

    A round reads the narrow rows once and sums those of each source's boundary bucket into 2^12 finer ones.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    whole = F.least(whole, F.lit(int(most)))
    state = targets.withColumn("copies", whole).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = written(state.withColumn("prefix", F.lit(0).cast("long")), "budgets")
    for shift in range(BITS - ROUND, -1, -ROUND):
        same = F.col("d.source").eqNullSafe(F.col("s.source"))
        inside = sizes.alias("d").join(state.alias("s"), same & (F.shiftright("d.h", shift + ROUND) == F.col("s.prefix")))
        sums = inside.groupBy("d.source", "s.need", F.shiftright("d.h", shift).alias("b")).agg(F.sum("d.size").alias("n"))
        # Prefix sums over at most 2^12 buckets a source; the bucket in which the need is met is refined next.
        run = sums.withColumn("run", F.sum("n").over(W.partitionBy("source").orderBy("b"))).filter("run > need")
        hit = run.groupBy("source").agg(F.min_by(F.struct("b", (F.col("run") - F.col("n")).alias("before"), "n"), "b").alias("hit"))
        found = F.col("d.hit").isNotNull()
        prefix = F.coalesce(F.col("d.hit.b"), F.shiftleft("s.prefix", ROUND))
        need = F.when(found, F.col("s.need") - F.col("d.hit.before")).otherwise(0.0)
        if shift == 0:  # a single hash value is left: take it where that comes nearer
            prefix = F.when(found & (need * 2 >= F.col("d.hit.n")) & (F.col("s.copies") < int(most)), prefix + 1).otherwise(prefix)
        state = state.alias("s").join(hit.alias("d"), same, "left")
        state = written(state.select("s.source", "s.source_size", "s.target", "s.copies", need.alias("need"), prefix.alias("prefix")), "budgets")
    return state.select("source", "source_size", "target", "copies", F.col("prefix").alias("below"))


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, **columns) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document: whole copies times its size.

    Null or empty texts have size 0 and are taken 0 words; a null source is one more source, the last; an empty
    table gives no rows. Documents with equal id, size and source share a hash and are taken alike.
    """
    sizes = written(sized(docs, **columns), "sizes")
    cut = thresholds(sizes, source_targets(sizes, weights, most), most)
    rows = sizes.alias("d").join(cut.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    copies = F.col("s.copies") + (F.col("d.h") < F.col("s.below")).cast("long")
    return rows.select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"))


def mixed_rows(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it. Texts aren't shuffled; the thresholds are one short row a source."""
    sizes = written(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col), "sizes")
    cut = thresholds(sizes, source_targets(sizes, weights, most), most).select(F.col("source").alias("__source"), "copies", "below")
    rows = docs.join(cut, F.col(source_col).eqNullSafe(F.col("__source")))
    h = document_hash(F.col(id_col), n_words(F.col(text_col)), F.col(source_col))
    times = F.col("copies") + (h < F.col("below")).cast("long")
    return rows.withColumn("__times", times).filter("__times > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[docs[c] for c in docs.columns])

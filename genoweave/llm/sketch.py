"""Bottom-k sketches of shingle hashes, JVM-side only.

A sketch is the k smallest distinct hashes of a text's shingles, in order. Sketches of parts merge by
keeping the k smallest of their union. From the k smallest of the union of two sketches follow resemblance and
containment, and from the k-th smallest hash the number of distinct shingles.

Hashes have 48 bits. Shingles are five consecutive lower-cased (A-Z) words; a text with fewer words is one
shingle; a text without words, or a null, has the empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHINGLE, K, HEX = 5, 128, 12
HASHES = float(1 << 48)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """array<long>: the k smallest distinct shingle hashes, ascending.

    Words are hashed once; a shingle's hash mixes its words' hashes, so no shingle string is made.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<long>")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]), 16))
        return F.when(n >= shingle, each).when(n > 0, F.transform(whole, lambda x: F.shiftrightunsigned(x, 16))).otherwise(none)

    # transform over a one-element array names a value; written out, it would be computed anew at each use.
    named = F.get(F.transform(F.array(hashed), shingles), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(named)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for a sketch with fewer than k hashes."""
    n = F.size(s)
    return F.when(n < k, n.cast("double")).otherwise(F.lit(float(k - 1)) / ((F.element_at(s, -1).cast("double") + 1) / F.lit(HASHES)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1. Two empty sketches: 1; an empty and another: 0."""
    least = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(least), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; of an empty sketch: 1."""
    j, n_a, n_both = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * n_both / F.greatest(n_a, F.lit(1.0))))


def to_text(s: Column) -> Column:
    """Fixed-width hexadecimal digits, one after another."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), HEX, "0")), "")


def from_text(s: Column) -> Column:
    n = (F.length(s) / HEX).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substr(s, (i - 1) * HEX + 1, F.lit(HEX)), 16, 10).cast("long"))
    return F.when(n > 0, each).otherwise(F.expr("array()").cast("array<long>"))


def with_next(rows: DataFrame, key: str, columns: list[str], add: dict[str, Column], per_bucket: int = 512, most_cells: int = 1 << 14) -> DataFrame:
    """Adds the columns `add` and, as struct `next`, `columns` and `add` of the row that follows in ascending key (after the last: the first).

    Null keys come first; equal keys follow one another in the order of `columns`. Rows are dealt by ranges of
    the key: a grid of equal steps, crowded cells cut into equal steps again. A bucket's first row is also dealt to
    the bucket before it, so rows are shuffled once and each bucket is worked on by itself. Only the grid's counts
    and bounds reach the driver: at most most_cells cells, and as many cuts of crowded ones.
    """
    spark, k = rows.sparkSession, F.col(key).cast("long")
    low, high, n = rows.agg(F.min(k), F.max(k), F.count("*")).first()
    low, high = low or 0, high or 0
    cells = max(1, min(most_cells, -(-n // per_bucket), high - low + 1))
    cell = F.coalesce(F.floor((k - F.lit(low)) / F.lit(-(-(high - low + 1) // cells))), F.lit(-1)).cast("long")
    keyed = rows.withColumn("__cell", cell)
    limit, grid, base = 4 * max(per_bucket, n // most_cells), [], 0
    for r in sorted(keyed.groupBy("__cell").agg(F.count("*").alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi")).collect()):
        lo, span = (0, 1) if r["lo"] is None else (r["lo"], r["hi"] - r["lo"] + 1)
        parts = min(-(-r["n"] // limit), span)
        grid.append((r["__cell"], lo, -(-span // parts), base))
        base += parts
    table = spark.createDataFrame(grid, "__cell long, __lo long, __step long, __base long")
    bucket = F.col("__base") + F.coalesce(F.floor((k - F.col("__lo")) / F.col("__step")), F.lit(0))
    dealt = keyed.join(F.broadcast(table), "__cell").withColumn("__b", bucket.cast("long")).drop("__cell", "__lo", "__step", "__base")
    firsts = sorted(dealt.groupBy("__b").agg(F.min(k).alias("lo")).collect())
    links = [(b, lo, firsts[i - 1]["__b"]) for i, (b, lo) in enumerate(firsts)]
    linked = dealt.join(F.broadcast(spark.createDataFrame(links, "__b long, __first long, __before long")), "__b")
    own, extra = (F.struct(F.col(b).alias("b"), F.lit(x).alias("extra")) for b, x in (("__b", False), ("__before", True)))
    both = linked.withColumn("__at", F.explode(F.when(k.eqNullSafe(F.col("__first")), F.array(own, extra)).otherwise(F.array(own))))
    both = both.select(*rows.columns, F.col("__at.b").alias("__b"), F.col("__at.extra").alias("__extra")).repartition("__b").withColumns(add)
    order = W.partitionBy("__b").orderBy("__extra", k.asc_nulls_first(), *columns)
    return both.withColumn("next", F.lead(F.struct(*columns, *add)).over(order)).filter(~F.col("__extra")).drop("__b", "__extra")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text, sketch, and the same of the next document as struct next (after the last: the first).

    Null text: empty. Rows with equal ids follow one another by text. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_next(rows, "doc_id", ["text"], {"sketch": sketch(F.col("text"), k)})


def edited(rows: DataFrame, k: int = K) -> DataFrame:
    """Adds n_chars, edited (the last quarter of the code points replaced by the first as many, or all, of the next text) and its sketch."""
    n = F.char_length("text").cast("long")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("next.text"), F.lit(1), quarter))
    return rows.withColumn("n_chars", n).withColumn("edited", text).withColumn("edited_sketch", sketch(F.col("edited"), k))

"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Every row has a 63-bit key in each dimension: 40 bits of the dimension's value in order, then 23 bits of tie
breaking (a hash of the text, then one of the id), so that a value that many rows share can be cut. Copies of a
text lie side by side at one point, so a cut parts the copies of at most one text. A node that should hold k leaves is cut where floor(k/2)/k of its bytes lie
left. The cut is found by summing bytes into 2^11 key buckets of all nodes at once and refining only each node's
boundary bucket. Only those sums reach the driver; rows never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_count, numbered, text_crc32, written

VALUE_BITS, TIE_BITS, BUCKETS = 40, 23, 1 << 11
#: A cut may be off by this share of a leaf's target bytes.
TOLERANCE = 0.002
#: The driver holds a few numbers for each node, so leaves are bounded; beyond that, shard in two steps.
MOST_LEAVES = 1 << 15


def _value(df: DataFrame, dim: str, bounds: dict) -> Column:
    """The value's order in 40 bits, null first."""
    kind = df.schema[dim].dataType
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(dim, "UTF-8"), 1, 5)), 10, "0")
        value = F.conv(head, 16, 10).cast("long")
    else:
        low, high = bounds[dim]
        width = float(high - low) if high is not None and high > low else 1.0
        value = ((F.col(dim).cast("double") - F.lit(float(low or 0))) / F.lit(width) * F.lit(float((1 << VALUE_BITS) - 2)) + 1).cast("long")
    return F.coalesce(value, F.lit(0).cast("long"))


def kd_shards(docs: DataFrame, *, leaf_bytes: int | None = None, n_leaves: int | None = None, dims: tuple[str, ...] = ("source", "lang", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    size: UTF-8 bytes plus 1, null text: 1. A null in a dimension comes before all values. Rows with equal id
    and text stay together, each with a slot of its own. An empty table gives no rows.
    Give leaf_bytes (the number of leaves follows from all bytes) or n_leaves.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        text_crc32(F.col(text_col)).alias("text_crc32"), F.xxhash64(text_col).alias("__t"), *[F.col(d).alias(f"__d{i}") for i, d in enumerate(dims)],
    )
    names = [f"__d{i}" for i in range(len(dims))]
    narrow = _together(written(narrow, "kd"), names)
    bounded = [d for d in names if not isinstance(narrow.schema[d].dataType, T.StringType)]
    row = narrow.agg(F.sum("size").alias("s"), F.count("*").alias("n"), *[F.min(d).alias(f"lo{d}") for d in bounded], *[F.max(d).alias(f"hi{d}") for d in bounded]).first()
    total, n = row["s"] or 0, row["n"]
    bounds = {d: (row[f"lo{d}"], row[f"hi{d}"]) for d in bounded}
    k = n_leaves or max(1, round(total / leaf_bytes))
    if k > MOST_LEAVES:
        raise ValueError(f"{k} leaves; at most {MOST_LEAVES}")
    tie = F.shiftleft(F.col("__t").bitwiseAND(0xFFF), 11).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(0x7FF))
    keys = [F.shiftleft(_value(narrow, d, bounds), TIE_BITS).bitwiseOR(tie).alias(d) for d in names]
    rows = written(narrow.select("doc_id", "size", "text_crc32", *keys, F.lit(0).alias("shard")), "kd")
    leaves = {0: k}
    spans: dict[str, int] = {}
    while max(leaves.values()) > 1:
        rows, leaves = _split(rows, leaves, names, total / k * TOLERANCE, spans)
    return numbered(rows.select("doc_id", "size", "text_crc32", "shard"), ["shard"], "doc_id", "slot", bucket_count(n // k + 1, 4000))


def _together(narrow: DataFrame, names: list[str]) -> DataFrame:
    """Copies of a text take the dimensions of the copy with the least id, so that they lie at one point of the tree.

    Only texts with several copies are joined; a text with any number of copies is pre-aggregated to one row.
    """
    first = narrow.groupBy("__t", "size").agg(F.count("*").alias("n"), F.min_by(F.struct(*names), F.struct("doc_id", *names)).alias("x"))
    several = written(first.filter("n > 1").drop("n"), "kd")
    joined = narrow.join(several, ["__t", "size"], "left")
    own = [F.when(F.col("x").isNotNull(), F.col("x")[d]).otherwise(F.col(d)).alias(d) for d in names]
    return written(joined.select("doc_id", "size", "text_crc32", "__t", *own), "kd")


def _split(rows: DataFrame, leaves: dict[int, int], names: list[str], tolerance: float, spans: dict[str, int]) -> tuple[DataFrame, dict[int, int]]:
    """One level. A node's number is its first leaf's, so leaves end up numbered from left to right."""
    spark = rows.sparkSession
    stats = rows.groupBy("shard").agg(F.sum("size").alias("s"), *[f(d).alias(f"{x}{d}") for d in names for x, f in (("lo", F.min), ("hi", F.max))]).collect()
    nodes = {}
    for r in stats:
        if leaves.get(r["shard"], 1) < 2:
            continue
        width = {d: r[f"hi{d}"] - r[f"lo{d}"] for d in names}
        for d in names:
            spans.setdefault(d, max(1, width[d]))  # of the root: all dimensions count alike
        d = max(names, key=lambda d: width[d] / spans[d])
        k = leaves[r["shard"]]
        nodes[r["shard"]] = {"dim": names.index(d), "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "need": r["s"] * (k // 2) / k}
    key = F.element_at(F.array(*names), F.col("dim") + 1)
    cuts: dict[int, tuple[int, int]] = {}
    while open_ := {s: x for s, x in nodes.items() if s not in cuts}:
        table = [(s, x["dim"], x["lo"], x["hi"], (x["hi"] - x["lo"]) // BUCKETS + 1) for s, x in open_.items()]
        inside = rows.join(F.broadcast(spark.createDataFrame(table, "shard int, dim int, lo long, hi long, step long")), "shard")
        kept = inside.filter(key.between(F.col("lo"), F.col("hi"))).withColumn("b", key - F.col("lo") - F.pmod(key - F.col("lo"), F.col("step")))
        sums: dict[int, list] = {}
        for r in kept.groupBy("shard", "b").agg(F.sum("size").alias("s")).collect():
            sums.setdefault(r["shard"], []).append((r["b"], r["s"]))
        for s, x in open_.items():
            step, run, hit = (x["hi"] - x["lo"]) // BUCKETS + 1, 0, None
            for b, w in sorted(sums.get(s, [])):
                if run + w > x["need"]:
                    hit = (b, w)
                    break
                run += w
            if hit is None:  # all of it is needed
                cuts[s] = (x["dim"], x["hi"])
                continue
            low = x["lo"] + hit[0]
            if hit[1] <= tolerance or step == 1:  # cut at the nearer side of this bucket
                cuts[s] = (x["dim"], low - 1 if x["need"] - run <= hit[1] / 2 else low + step - 1)
            else:
                x["lo"], x["hi"], x["need"] = low, low + step - 1, x["need"] - run
    table = [(s, d, cut, leaves[s] // 2) for s, (d, cut) in cuts.items()]
    placed = rows.join(F.broadcast(spark.createDataFrame(table, "shard int, dim int, cut long, half int")), "shard", "left")
    moved = F.when(key > F.col("cut"), F.col("shard") + F.col("half")).otherwise(F.col("shard"))
    out = written(placed.select("doc_id", "size", "text_crc32", *names, moved.alias("shard")), "kd")
    after = {s: 1 for s in leaves if s not in cuts}  # leaves, and nodes without rows
    for s in cuts:
        after |= {s: leaves[s] // 2, s + leaves[s] // 2: leaves[s] - leaves[s] // 2}
    return out, after

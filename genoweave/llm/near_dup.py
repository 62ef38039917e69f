"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's shingle set gives SYMBOLS min-hashes of 16 bits each, its signature. Signatures are split into CHUNKS of
SYMBOLS / CHUNKS symbols. By the pigeonhole principle, two signatures that differ in at most 2 * CHUNKS - 1 = 23
symbols have a chunk in which they differ in at most one; so each chunk emits, for each of its symbols, the
others as a key (all ways to allow one error), and equal keys find every such pair. Pairs at a likeness of 0.75 differ in 15
symbols on average; also beyond 23 differences a pair is missed only if all 12 chunks have two errors or more, about once in 160,000
pairs at exactly 0.75 and less above. Candidates within DISTANCE are confirmed on full shingle sets.

Equal sets are one node, whatever their number. Within a key's nodes no all-pairs list is made: first each is compared
with one pivot, picked by hash for each key anew; then, only where a key's nodes still lie in different components, those
outside its largest component are compared with the rest, in blocks that confirm links at once and give no more of
them than join the block's components. Links within a component can't change it, so no component is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, drop, written
from .hashing import as_long, bloom, id_hash, in_bloom, mix, shingle_set

SYMBOLS, CHUNKS = 60, 12
#: Signatures with more differing symbols than this aren't looked at further: at a likeness of 0.75, once in 10^5.
DISTANCE = 30
BLOCK = 500
_rng = np.random.default_rng(20_240_501)
_A = _rng.integers(1, 1 << 63, (SYMBOLS, 1), "uint64") * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, (SYMBOLS, 1), "uint64")


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS 16-bit min-hashes of a shingle set that isn't empty."""
    least = np.full(SYMBOLS, np.iinfo("uint64").max, "uint64")
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, at : at + 4096] * _A + _B).min(1))
    return (mix(least) >> np.uint64(48)).astype("<u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """rows x SYMBOLS keys: one for each chunk and masked symbol."""
    width = SYMBOLS // CHUNKS
    s = signatures.astype("uint64").reshape(-1, CHUNKS, width)
    out = np.empty((len(s), CHUNKS, width), "uint64")
    salt = mix(np.arange(1, CHUNKS + 1, dtype="uint64"))
    for masked in range(width):
        key = np.zeros((len(s), CHUNKS), "uint64")
        for i in range(width):
            if i != masked:
                key = (key << np.uint64(16)) | s[:, :, i]
        out[:, :, masked] = mix(key + salt * np.uint64(2 * masked + 1))
    return out.reshape(len(s), -1)


def sets_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set; null if empty), sig of every row."""

    import xxhash

    def one(text: str) -> tuple:
        s = shingle_set(text, shingle)
        return (len(s), xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), signature(s).tobytes()) if len(s) else (0, None, None)

    return by_text(docs, one, [("n_shingles", "long"), ("node", "long"), ("sig", "binary")], id_col, text_col)


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        for batch in batches:
            node, sig = batch["node"].to_numpy("int64"), batch["sig"].tolist()
            for at in range(0, len(node), 2000):
                k = keys_of(np.frombuffer(b"".join(sig[at : at + 2000]), "<u2").reshape(-1, SYMBOLS))
                yield pd.DataFrame({"key": as_long(k.ravel()), "node": np.repeat(node[at : at + 2000], SYMBOLS)})

    return nodes.select("node", "sig").mapInPandas(run, "key long, node long")


def components(edges: DataFrame) -> DataFrame:
    """u, root: connected components by alternating large and small stars, each a few joins; nothing is collected."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = written(small.filter("u <> v").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select("u", F.col("v").alias("root"))
        before = state


class _Pairs:
    """Confirms candidate pairs of nodes."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, percent: int):
        self.docs, self.nodes, self.id_col, self.text_col, self.shingle, self.percent = docs, nodes, id_col, text_col, shingle, percent

    def close(self, pairs: DataFrame) -> DataFrame:
        """Those whose sizes allow a link and whose signatures are within DISTANCE."""
        n = self.nodes.select("node", "n", "sig")
        both = pairs.join(n.toDF("u", "n_u", "sig_u"), "u").join(n.toDF("v", "n_v", "sig_v"), "v")
        both = both.filter(100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v"))
        limit = DISTANCE

        def run(batches):
            for batch in batches:
                if len(batch):
                    u, v = (np.frombuffer(b"".join(batch[c].tolist()), "<u2").reshape(-1, SYMBOLS) for c in ("sig_u", "sig_v"))
                    yield batch.loc[(u != v).sum(1) <= limit, ["u", "v"]]

        return written(both.select("u", "v", "sig_u", "sig_v").mapInPandas(run, "u long, v long").distinct(), "close")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node, hashes: full shingle sets of the wanted nodes. Only their documents (and a Bloom filter's few others) are shingled again."""
        firsts = written(self.nodes.join(wanted, "node").select("node", "first"), "wanted")
        words, bits = bloom(firsts.select(id_hash("first").alias("h")), "h")
        shared = self.docs.sparkSession.sparkContext.broadcast(words)
        shingle = self.shingle

        def run(batches):
            import pyarrow as pa
            import xxhash

            for batch in batches:
                h = batch.column(1).to_numpy().view("uint64")
                own = batch.filter(pa.array(in_bloom(shared.value, bits, h)))
                found = [shingle_set(t, shingle) for t in own.column(0).to_pylist()]
                found = [s for s in found if len(s)]
                nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "hashes"])

        rows = self.docs.select(F.col(self.text_col).alias("t"), id_hash(self.id_col).alias("h"))
        full = rows.mapInArrow(run, "node long, hashes binary").join(firsts.select("node"), "node", "left_semi")
        return written(full, "sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links: pairs whose full shingle sets are alike enough."""
        full = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        both = pairs.join(full.toDF("u", "h_u"), "u").join(full.toDF("v", "h_v"), "v")
        percent = self.percent

        def run(batches):
            for batch in batches:
                keep = [alike(np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64"), percent) for a, b in zip(batch["h_u"].tolist(), batch["h_v"].tolist(), strict=True)]
                yield batch.loc[keep, ["u", "v"]]

        return written(both.select("u", "v", "h_u", "h_v").mapInPandas(run, "u long, v long").distinct(), "links")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets share `percent` of their union."""
    n = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * n >= percent * (len(a) + len(b) - n)


def first_shared_slot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For rows of signatures, the least key position at which keys_of agrees (-1: none)."""
    width = SYMBOLS // CHUNKS
    differ = (u != v).reshape(-1, CHUNKS, width)
    errors = differ.sum(2)
    chunk = (errors <= 1).argmax(1)
    own = np.arange(len(differ))
    found = errors[own, chunk] <= 1
    return np.where(found, chunk * width + differ[own, chunk].argmax(1), -1)


def _across(members: DataFrame, nodes: DataFrame, labels: DataFrame, pairs: _Pairs) -> DataFrame:
    """Links between different components, found key by key and block by block.

    A pair is looked at under the first key it shares only, and no more once its components have been joined within the
    block; so each block gives fewer links than it has components, whatever the size of a key's group.
    """
    own = members.join(labels.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_key = own.groupBy("key", "root").agg(F.count("*").alias("n"))
    # A key with one component needs nothing more; one with two nodes has been compared already.
    ranks = of_key.groupBy("key").agg(F.count("*").alias("roots"), F.sum("n").alias("all"), F.max_by("root", F.struct("n", "root")).alias("main"))
    ranks = ranks.filter("roots > 1 and all > 2")
    rows = own.join(ranks, "key").withColumn("minor", F.col("root") != F.col("main"))
    n_minor = rows.groupBy("key").agg(F.sum(F.col("minor").cast("long")).alias("n_minor"))
    rows = written(rows.join(n_minor, "key").select("key", "node", "root", "minor", "all", "n_minor"), "across")
    full = pairs.sets(rows.select("node").distinct())
    rows = rows.join(nodes.select("node", "sig"), "node").join(full, "node")
    left, right = F.ceil(F.col("n_minor") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    i, j = F.pmod(F.xxhash64("node"), left), F.pmod(F.xxhash64("node", "key"), right)
    # Every minor row goes to its block row, every row to its block column, once for each block on the other side.
    at_left = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), right - 1), lambda x: F.struct(i.alias("i"), x.cast("long").alias("j"), F.lit(0).alias("side"))))
    at_right = F.transform(F.sequence(F.lit(0), left - 1), lambda x: F.struct(x.cast("long").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    both = rows.withColumn("at", F.explode(F.concat(F.coalesce(at_left, F.slice(at_right, 1, 0)), at_right)))
    both = both.select("key", "at.i", "at.j", "at.side", "node", "root", "sig", "hashes")
    percent = pairs.percent

    def run(pdf):
        import pandas as pd

        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            sig_a, sig_b = (np.frombuffer(b"".join(x["sig"].tolist()), "<u2").reshape(-1, SYMBOLS) for x in (a, b))
            sets_a, sets_b = ([np.frombuffer(h, "uint64") for h in x["hashes"].tolist()] for x in (a, b))
            root_a, root_b, node_a, node_b = (x.to_numpy("int64") for x in (a["root"], b["root"], a["node"], b["node"]))
            n_b = np.array([len(h) for h in sets_b])
            slot = int((as_long(keys_of(sig_a[:1])[0]) == int(pdf["key"].iloc[0])).argmax())
            group: dict[int, int] = {}

            def top(x: int) -> int:
                while x in group:
                    x = group[x]
                return x

            for x in range(len(a)):
                n = len(sets_a[x])
                fit = np.flatnonzero((root_b != root_a[x]) & (100 * np.minimum(n_b, n) >= percent * np.maximum(n_b, n)))
                fit = fit[(sig_b[fit] != sig_a[x]).sum(1) <= DISTANCE]
                fit = fit[first_shared_slot(sig_b[fit], sig_a[x]) == slot] if len(fit) else fit
                for y in fit.tolist():
                    p, q = top(int(root_a[x])), top(int(root_b[y]))
                    if p != q and alike(sets_a[x], sets_b[y], percent):
                        group[max(p, q)] = min(p, q)
                        out.append((int(max(node_a[x], node_b[y])), int(min(node_a[x], node_b[y]))))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return written(both.groupBy("key", "i", "j").applyInPandas(run, "u long, v long").distinct(), "across")


def near_duplicates(docs: DataFrame, *, percent: int = 75, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    A row without words (or null) has no shingles and is linked with nothing. Rows with equal ids share nothing
    but their id; a component carries its least id. An empty table gives no rows.
    """
    rows = written(sets_of(docs, id_col, text_col, shingle), "signatures")
    least = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = rows.join(least, "node").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "first", F.col("n_shingles").alias("n"), "sig")
    nodes = written(nodes.dropDuplicates(["node"]), "nodes")
    keys = _keys(nodes)
    several = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key")
    members = written(keys.join(several, "key"), "members")
    pivot = members.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("p"))
    first = members.join(pivot, "key").filter("node <> p").select(F.greatest("node", "p").alias("u"), F.least("node", "p").alias("v")).distinct()
    pairs = _Pairs(docs, nodes, id_col, text_col, shingle, percent)
    links = pairs.confirmed(pairs.close(first))
    labels = components(links)
    more = _across(members, nodes, labels, pairs)
    if more.take(1):
        labels = components(links.unionByName(more))
    joined = nodes.select("node", "first").join(labels.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of_node = joined.join(ids, "root").select("node", "component_id")
    out = rows.join(of_node, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

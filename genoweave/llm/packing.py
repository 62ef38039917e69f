"""Shortest-pack-first packing of documents into fixed-length token sequences.

Documents are cut into whole sequences and one rest. Only the histogram of the rests (at most `length` - 1
lengths) reaches the driver; from it the coarsest cut of the rests is chosen that pads little. Lengths are placed longest first; a length goes into the pattern that is filled
least among those it fits, and pattern counts are updated, not single sequences. A pattern with its count is
then joined back to the pieces by their rank among the pieces of their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, numbered, written
from .tokens import encoder, widened

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Rests may be cut again at multiples of 1/2, 1/4 or 1/8 of a sequence, if whole rests would pad more than PADDING.
PARTS = (1, 2, 4, 8)
PADDING = 0.01


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole sequences and rests of every whole text and its end_id; crcs: those of a rest's pieces, for each of PARTS.

    Null text: empty, so only end_id.
    """
    parts = [p for p in PARTS if length % p == 0]

    def cut(batches):
        import zlib

        import pyarrow as pa

        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            at, rows = [], []
            for nth, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids = widened(ids, enc.width) + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    own = ids[4 * start : 4 * (start + length)]
                    units = parts if len(own) < 4 * length else parts[:1]
                    at.append(nth)
                    rows.append((start, len(own) // 4, [[zlib.crc32(own[i : i + u]) for i in range(0, len(own), u)] for u in (4 * length // p for p in units)], total))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.int64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["doc_id", "start", "length", "crcs", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, crcs array<array<long>>, doc_tokens long")


def choose_cut(counts: dict[int, int], length: int) -> tuple[int, list[tuple[list[int], int]]]:
    """The first of PARTS whose patterns pad at most PADDING, or else the one that pads least; and its patterns."""
    best, total = None, sum(k * n for k, n in counts.items())
    for i, part in enumerate(p for p in PARTS if length % p == 0):
        unit, cut = length // part, {}
        for size, n in counts.items():
            if size == length:
                cut[size] = cut.get(size, 0) + n
                continue
            if size >= unit:
                cut[unit] = cut.get(unit, 0) + n * (size // unit)
            if size % unit:
                cut[size % unit] = cut.get(size % unit, 0) + n
        patterns = pack_histogram(cut, length)
        waste = 1 - total / max(1, length * sum(n for _, n in patterns))
        if best is None or waste < best[0]:
            best = waste, i, patterns
        if waste <= PADDING:
            break
    return best[1:]


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and how many sequences have each.

    Work grows with the number of lengths and patterns, never with the number of pieces.
    """
    by_fill: dict[int, list[tuple[list[int], int]]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for fill in sorted(f for f in by_fill if f + size <= length):
            if not left:
                break
            own = by_fill.pop(fill)
            while own and left:
                pattern, n = own.pop()
                fit = (length - fill) // size
                use = min(n, left // fit) if left >= fit else 0
                if use == 0:  # fewer are left than fit into one
                    use, fit = 1, left
                by_fill.setdefault(fill + fit * size, []).append(([*pattern, *[size] * fit], use))
                left -= use * fit
                if n > use:
                    own.append((pattern, n - use))
            if own:
                by_fill.setdefault(fill, []).extend(own)
        if left:
            fit = length // size
            if whole := left // fit:
                by_fill.setdefault(fit * size, []).append(([size] * fit, whole))
            if rest := left % fit:
                by_fill.setdefault(rest * size, []).append(([size] * rest, 1))
    merged: dict[tuple[int, ...], int] = {}
    for fill in sorted(by_fill, reverse=True):
        for pattern, n in by_fill[fill]:
            merged[tuple(pattern)] = merged.get(tuple(pattern), 0) + n
    return [(list(p), n) for p, n in sorted(merged.items(), key=lambda x: (-sum(x[0]), x[0]))]


def slots(patterns: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int, list[int]]]]:
    """For each length, in rank order: first rank, pieces a sequence, first sequence, sequences, offsets in the sequence."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, n in patterns:
        places: dict[int, list[int]] = {}
        at = 0
        for size in pattern:
            places.setdefault(size, []).append(at)
            at += size
        for size, offsets in places.items():
            out.setdefault(size, []).append((taken.get(size, 0), len(offsets), first, n, offsets))
            taken[size] = taken.get(size, 0) + n * len(offsets)
        first += n
    return out


def pack(cuts: DataFrame, length: int) -> DataFrame:
    """PIECES with sequence_id and offset, from what cut_pieces returns. An empty table stays empty.

    Which of equally long pieces goes where follows from doc_id and start alone, so reruns agree.
    A length that a third of all pieces share is numbered in hash buckets, never in one task.
    """
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    i, patterns = choose_cut(counts, length)
    unit = length // [p for p in PARTS if length % p == 0][i]
    placed, total = slots(patterns), sum(n * len(p) for p, n in patterns)
    whole = F.col("length") == length
    step = F.when(whole, F.lit(length)).otherwise(F.lit(unit))
    pieces = cuts.select("doc_id", "start", "length", "doc_tokens", F.posexplode(F.when(whole, F.col("crcs")[0]).otherwise(F.col("crcs")[i])).alias("nth", "ids_crc32"))
    pieces = pieces.select("doc_id", (F.col("start") + F.col("nth") * step).alias("start"), F.least(step.cast("long"), F.col("length") - F.col("nth") * step).alias("length"), "ids_crc32", "doc_tokens")
    keyed = pieces.withColumn("__key", F.xxhash64("doc_id", "start"))
    ranked = numbered(keyed, ["length"], "__key", "__rank", bucket_count(total, 4000)).drop("__key")

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        table = {}
        for size, rows in placed.items():
            most = max(r[1] for r in rows)
            table[size] = (*(np.array([r[i] for r in rows], "int64") for i in range(3)), np.array([r[4] + [0] * (most - r[1]) for r in rows], "int64"))
        for batch in batches:
            n = batch.num_rows
            sequence, offset = np.zeros(n, "int64"), np.zeros(n, "int64")
            sizes, ranks = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            order = np.argsort(sizes, kind="stable")
            cuts = np.flatnonzero(np.diff(sizes[order])) + 1
            for at in np.split(order, cuts) if n else []:
                first_rank, each, first_seq, offsets = table[int(sizes[at[0]])]
                row = np.searchsorted(first_rank, ranks[at], side="right") - 1
                nth, slot = np.divmod(ranks[at] - first_rank[row], each[row])
                sequence[at], offset[at] = first_seq[row] + nth, offsets[row, slot]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "__rank")
    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, **columns: str) -> DataFrame:
    """Packs every whole text. The pieces are written once, so each text is tokenized once."""
    return pack(written(cut_pieces(docs, tokenizer, end_id, length, **columns), "pieces"), length)

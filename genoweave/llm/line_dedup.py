"""Line de-duplication by deletion neighbourhoods.

Two lines are alike if their words (A-Z lower-cased) are within one word edit: a word replaced, put in or left out. Lines of
2 * edit_words words or more may differ by one word edit for each edit_words words of the shorter line. A line is removed if
an earlier line, by (doc_id, line number), is equal or alike; the earliest stays. Exact repeats of every line with a word
are removed; alike lines from near_words words on (at two words, any two lines with a common word would be alike).

One pass over the texts makes a table of lines, in blocks of numbers (`parts`); a second one fetches the texts of those lines only that
may have a partner. Lines, keys, cells and variants go through shuffles in blocks, too, and numpy finds what meets there.

1. Each line becomes a hash and, from near_words to 2 * edit_words words, keys of all its words but one third: an edit lies in one third of the
   longer line's m words, and lines within one edit agree outside it. So each line has three keys as the longer line (m its own number
   of words) and three as the shorter one. Lines whose keys no other line has can't have a partner within one edit. A longer line's
   partners have 2 * edit_words words at least, so they are found by 4.
2. The others emit their deletion variants: the line without its i-th word, for every i in a third that a shared key leaves open.
   Equal variants with equal i are a replaced word; a variant equal to a whole line is a word put in.
3. Of each variant's lines only the earliest matters, so variants are aggregated to their earliest line, never
   paired off; a template line with a million fillings is one group. A line and that earliest one are verified on their words.
4. For more edits: e edits in n >= e * edit_words words leave a run of RUN words that both lines have. Of each RUN words the least
   hash of GRAM words is an anchor, so alike lines share one, at places that differ by e at most, and their sizes differ by e at
   most. Lines meet in cells of (anchor, size, place), where sizes and places are binned so that alike lines share a cell;
   lines that merely contain the same passage mostly don't. Cells with the same lines count once. In a cell
   each line is compared with the earliest, and those not removed by that with all others, in blocks: first by counts of
   words in BUCKETS buckets, which differ by two at most for each edit, then on their words. Words are fetched only for lines
   that pass the first comparison, or that are in cells of more than two.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, release, written
from .hashing import as_long, bloom, in_bloom, mix, windows, words_and_lines
from .parts import Filter, blobs, dealt, in_runs, joined, least_and_most, of_parts, part_of, parts_for, schema, shared_keys

MIN_WORDS, NEAR_WORDS, EDIT_WORDS = 1, 3, 16
WHOLE = {"min_words": MIN_WORDS, "near_words": NEAR_WORDS, "edit_words": EDIT_WORDS}
#: e edits in n >= e * edit_words words (e >= 2) leave a run of (n - e) / (e + 1) words or more: 10 at 16 words an edit.
RUN, GRAM, BUCKETS, BLOCK, SPAN = 10, 6, 64, 500, 8
#: Candidate pairs of a block for each line that has any, beyond which the lines are written down instead.
DENSE = 1
#: Bits of a filter at most; beyond that it lets more through.
MOST_BITS = 1 << 29
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)
_U = np.uint64


class _Powers:
    """Powers of _M and of its inverse, as many as the longest line has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, "uint64")

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.where(np.arange(2 * n) == 0, _U(1), _U(b))) for b in (_M, _INVERSE))


_powers = _Powers()


def _hash(*values: np.ndarray) -> np.ndarray:
    return mix(sum(v * _U(2 * i + 1) for i, v in enumerate(values)))


class Lines:
    """Of a text, all at once: number, words n, hash h and keys (lines x 6) of the lines with min_words words or more.

    With line-relative powers summed up over the text, any run of a line's words is a difference of two sums.
    keys[:, 0:3]: the words outside the last, middle and first third, for m = n; keys[:, 3:6]: for m = n + 1.
    """

    def __init__(self, text: str, min_words: int, near_words: int):
        words, ends = words_and_lines(text)
        n = np.diff(ends, prepend=0)
        _powers.reach(int(n.max()) + 2)
        first = ends - n
        place = np.arange(len(words)) - np.repeat(first, n)
        sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(words * _powers.up[place], dtype="uint64")])
        self.number = np.flatnonzero(n >= min_words)
        self.n, s, e = n[self.number], first[self.number], ends[self.number]
        self.h = _hash(sums[e] - sums[s], self.n.astype("uint64"))
        self.near = self.n >= near_words
        self.words, self.first, self.place, self.size = words, s, place, np.repeat(n, n)
        self.keys = np.zeros((len(s), 6), "uint64")
        head, tail = sums[s], sums[e]
        for i, m in ((0, self.n), (3, self.n + 1)):
            a, b, size = m // 3, 2 * m // 3, m.astype("uint64")
            after_b, after_a = ((tail - sums[e - k]) * _powers.down[self.n - k] for k in (m - b, m - a))
            self.keys[:, i] = _hash(sums[s + b] - head, size, np.full(len(m), 1, "uint64"))
            self.keys[:, i + 1] = _hash(sums[s + a] - head, size, after_b)
            self.keys[:, i + 2] = _hash(after_a, size, np.full(len(m), 3, "uint64"))

    def anchors(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of number, anchor, its place in the line) of the lines of `least` words or more, each line's in order."""
        grams = windows(self.words, GRAM)
        width = RUN - GRAM + 1
        n = max(0, len(grams) - width + 1)
        within = (self.size[:n] >= least) & (self.place[:n] + RUN <= self.size[:n])
        low = grams[:n].copy()
        for i in range(1, width):
            np.minimum(low, grams[i : i + n], out=low)
        best = np.zeros(len(grams), bool)
        for i in range(width if n else 0):
            best[i : i + n] |= within & (grams[i : i + n] == low)
        at = np.flatnonzero(best)
        return np.searchsorted(self.first, at, side="right") - 1, mix(grams[at]), self.place[at]

    def counts(self, least: int) -> np.ndarray:
        """Words in each of BUCKETS buckets (up to 255), of the lines of `least` words or more."""
        n = self.n[self.n >= least]
        bucket = (self.words[self.size >= least] & _U(BUCKETS - 1)).astype("int64") + np.repeat(np.arange(len(n)) * BUCKETS, n)
        return np.minimum(np.bincount(bucket, minlength=len(n) * BUCKETS), 255).astype("u1").reshape(-1, BUCKETS)


#: Texts are worked through together, up to so many characters, to spare calls.
TOGETHER = 200_000


def _together(texts: list[str | None], min_words: int, near_words: int):
    """(texts joined, Lines of it, each line's text, its number there): for one run of texts after another.

    Joined by a line break, texts keep their lines.
    """
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < TOGETHER):
            size += len(texts[hi] or "")
            hi += 1
        part = [t or "" for t in texts[lo:hi]]
        joined = "\n".join(part)
        own = Lines(joined, min_words, near_words)
        starts = np.cumsum([0] + [t.count("\n") + 1 for t in part])
        at = np.searchsorted(starts, own.number, side="right") - 1
        yield joined, own, lo + at, own.number - starts[at]
        lo = hi


#: A block's columns: of each line its hash, number of words, document and number (-1 - number where the id is null); of the lines
#: that are compared by one edit their keys; of long ones counts, cells, one line's after the other's, and how many cells each has.
KINDS = {"h": ("uint64", 0), "n": ("int32", 0), "doc": ("int64", 0), "line": ("int32", 0), "keys": ("uint64", 6), "counts": ("u1", BUCKETS), "cells": ("uint64", 0), "sizes": ("int32", 0)}
BLOCK_BYTES = 1 << 22


def _of(blocks: DataFrame, *names: str):
    return blocks.select(*names), [KINDS[c] for c in names]


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int, near_words: int, edit_words: int) -> DataFrame:
    """Blocks of all lines with min_words words or more; n_lines, n_keys, n_cells: their sizes.

    From 2 * edit_words + 1 words on a line needs no keys: what is one edit away is a long line too, and shares a cell.
    """
    least = 2 * edit_words

    def run(batches):
        found, size = [], 0
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for _, own, at, line in _together(batch.column(1).to_pylist(), min_words, near_words):
                row, key = cells(own, least, edit_words)
                near = (own.n >= near_words) & (own.n <= least)
                sizes = np.bincount(row, minlength=len(own.n))[own.n >= least]
                line = np.where(known[at], line, -1 - line).astype("int32")
                found.append([own.h, own.n.astype("int32"), ids[at], line, own.keys[near], own.counts(least), key, sizes.astype("int32")])
                size += sum(x.nbytes for x in found[-1])
                if size >= BLOCK_BYTES:
                    yield block(found)
                    found, size = [], 0
        if found:
            yield block(found)

    def block(found):
        import pyarrow as pa

        columns = joined(found)
        sizes = [pa.array([len(columns[i])], pa.int64()) for i in (0, 4, 6)]
        return pa.RecordBatch.from_arrays([*sizes, *(blobs([c], np.array([0, len(c)]))[0] for c in columns)], ["n_lines", "n_keys", "n_cells", *KINDS])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "n_lines long, n_keys long, n_cells long, " + ", ".join(f"{c} binary" for c in KINDS))


def cells(own: Lines, least: int, edit_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, in order, and keys of the cells that alike lines share.

    Alike lines have sizes within (edit_words + 1) / edit_words of each other, and their anchor's places differ by the number
    of edits at most. Sizes are binned by powers of two and places by SPAN times the most edits of the size bin; what lies so
    near its bin's upper border that an alike line may be in the next one goes to both.
    """
    row, anchor, place = own.anchors(least)
    n = own.n[row]
    band = np.frexp(n.astype("float64"))[1].astype("int64") - 1
    next_ = np.flatnonzero(n * (edit_words + 1) >= edit_words << (band + 1))
    which, band = np.concatenate([np.arange(len(n)), next_]), np.concatenate([band, band[next_] + 1])
    most = np.maximum(1, ((2 << band) - 1) // edit_words)  # edits of the lines in this bin
    at, rest = np.divmod(place[which], most * SPAN)
    next_ = np.flatnonzero(rest + most >= most * SPAN)
    which, band, at = np.concatenate([which, which[next_]]), np.concatenate([band, band[next_]]), np.concatenate([at, at[next_] + 1])
    key = mix(anchor[which] + mix((band.astype("uint64") << _U(48)) + at.astype("uint64")))
    order = np.argsort(row[which], kind="stable")
    return row[which][order], key[order]


def _doc_ids(doc: np.ndarray, line: np.ndarray):
    """Arrow columns of what a block holds as doc and line."""
    import pyarrow as pa

    return pa.array(doc, mask=line < 0), pa.array(np.where(line < 0, -1 - line, line).astype("int32"))


def _order(doc: np.ndarray, line: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """By what comes before (the last counts most), then as (doc_id, line), null ids first."""
    return np.lexsort((np.where(line < 0, -1 - line, line), doc, line >= 0, *before))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def repeats(lines: DataFrame, parts: int) -> DataFrame:
    """doc_id, line of every line that an earlier one equals. A batch settles its own repeats, so that a common line is sent once."""
    blocks, kinds = _of(lines, "h", "doc", "line")

    def of(h, doc, line):
        """Order, firsts there, and which others aren't at the first one's place (rows may share an id)."""
        order = _order(doc, line, h)
        h, doc, line = h[order], doc[order], line[order]
        first = _changes(h)
        at = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else np.zeros(0, "int64")
        return order, first, (doc != doc[at]) | (line != line[at])

    def send(batches):
        for h, doc, line in in_runs(batches, kinds):
            order, first, gone = of(h, doc, line)
            order, gone = order[first | gone], gone[first | gone]
            h, doc, line = h[order], doc[order], line[order]
            yield dealt(np.where(gone, _place_hash(doc, line), h), [h, doc, line, gone.astype("u1")], parts)

    def find(part, columns):
        import pyarrow as pa

        h, doc, line, settled = columns
        done = settled == 1
        order, _, gone = of(h[~done], doc[~done], line[~done])
        at = np.concatenate([np.flatnonzero(done), np.flatnonzero(~done)[order[gone]]])
        return pa.RecordBatch.from_arrays([*_doc_ids(doc[at], line[at])], ["doc_id", "line"])

    return of_parts(blocks.mapInArrow(send, schema(4)), [*kinds, ("u1", 0)], find, "doc_id long, line int")


def _ragged(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of some rows, one row's after the other's."""
    own = sizes[rows].astype("int64")
    first = np.cumsum(sizes, dtype="int64") - sizes
    return flat[np.repeat(first[rows] - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def with_shared(lines: DataFrame, keys: Filter, shared: Filter, near_words: int, least: int, parts: int) -> DataFrame:
    """h, doc_id, line, n, open (which of the six keys are shared), counts and cells (the shared ones) of first occurrences of lines that have any.

    The filters let a few others pass too. Copies of a line have the same keys, so the first of those that pass is the line's first.
    """
    blocks, kinds = _of(lines, *KINDS)
    sent = lines.sparkSession.sparkContext.broadcast((keys, shared))
    kinds_sent = [("uint64", 0), ("int64", 0), ("int32", 0), ("int32", 0), ("u1", 0), ("u1", BUCKETS), ("int32", 0)]

    def firsts(h, doc, line):
        order = _order(doc, line, h)
        return order[_changes(h[order])]

    def send(batches):
        for h, n, doc, line, own_keys, counts, own_cells, sizes in in_runs(batches, kinds):
            open_, size, count = np.zeros(len(h), "u1"), np.zeros(len(h), "int32"), np.zeros((len(h), BUCKETS), "u1")
            ok = sent.value[0].has(own_keys.ravel()).reshape(-1, 6)
            open_[(n >= near_words) & (n <= least)] = (ok.astype("u1") << np.arange(6, dtype="u1")).sum(1)
            long = np.flatnonzero(n >= least)
            ok = sent.value[1].has(own_cells)
            size[long] = np.bincount(np.repeat(np.arange(len(long)), sizes)[ok], minlength=len(long))
            count[long] = counts
            hit = np.flatnonzero((open_ > 0) | (size > 0))
            hit = hit[firsts(h[hit], doc[hit], line[hit])]
            hit = hit[np.argsort(part_of(h[hit], parts), kind="stable")]
            if not len(hit):
                continue
            batch = dealt(h[hit], [x[hit] for x in (h, doc, line, n, open_, count, size)], parts)
            sent_sizes = np.append(0, np.cumsum(size[hit], dtype="int64"))
            ends = np.append(0, np.searchsorted(part_of(h[hit], parts), batch.column(0).to_numpy(), side="right"))
            yield batch.append_column("c7", blobs([_ragged(own_cells[ok], size, hit)], sent_sizes[ends])[0])

    def find(part, columns):
        import pyarrow as pa

        h, doc, line, n, open_, count, size, flat = columns
        at = firsts(h, doc, line)
        ends = np.append(0, np.cumsum(size[at], dtype="int64"))
        numbers = np.arange(len(at) + 1)
        own = [pa.array(as_long(h[at])), *_doc_ids(doc[at], line[at]), pa.array(n[at]), pa.array(open_[at].astype("int32"))]
        return pa.RecordBatch.from_arrays([*own, *blobs([count[at]], numbers), *blobs([_ragged(flat, size, at)], ends)], ["h", "doc_id", "line", "n", "open", "counts", "cells"])

    return of_parts(blocks.mapInArrow(send, schema(8)), [*kinds_sent, ("uint64", 0)], find, "h long, doc_id long, line int, n int, open int, counts binary, cells binary")


def anchored(wanted: DataFrame, parts: int) -> DataFrame:
    """key, h, doc_id, line, n, all (lines of the cell), other (the earliest one) of lines in cells of two lines or more. Cells with the same lines count once."""
    kinds = [("uint64", 0), ("uint64", 0), ("int64", 0), ("int32", 0), ("int32", 0)]

    def send(batches):
        import pyarrow.compute as pc

        for batch in batches:
            size = pc.binary_length(batch.column("cells")).to_numpy().astype("int64") // 8
            cell = np.frombuffer(b"".join(batch.column("cells").to_pylist()), "uint64")
            if len(cell):
                at = np.repeat(np.arange(len(size)), size)
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                h, doc, line, n = (batch.column(c).fill_null(0).to_numpy() for c in ("h", "doc_id", "line", "n"))
                line = np.where(known, line, -1 - line).astype("int32")
                yield dealt(cell, [cell, h.view("uint64")[at], doc[at], line[at], n[at]], parts)

    def sets(part, columns):
        cell, h = columns[:2]
        order = np.lexsort((h, cell))
        order = order[_changes(cell[order], h[order])]  # a line may have a cell twice
        cell, h = cell[order], h[order]
        starts = np.flatnonzero(_changes(cell))
        size = np.diff(np.append(starts, len(cell)))
        own = mix(np.add.reduceat(mix(h + _U(_M)), starts) + mix(h[starts] ^ size.astype("uint64")))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return None
        own, size, order = np.repeat(own, size)[keep], np.repeat(size, size)[keep], order[keep]
        return dealt(own, [own, size, *(c[order] for c in columns)], parts)

    def find(part, columns):
        import pyarrow as pa

        own, size, cell, h, doc, line, n = columns
        order = np.lexsort((cell, own))
        at = np.flatnonzero(_changes(own[order]))
        first = np.repeat(cell[order][at], np.diff(np.append(at, len(order))))
        order = order[cell[order] == first]
        order = order[_order(doc[order], line[order], own[order])]
        at = np.flatnonzero(_changes(own[order]))
        other = np.repeat(h[order][at], np.diff(np.append(at, len(order))))
        arrays = [pa.array(as_long(own[order])), pa.array(as_long(h[order])), *_doc_ids(doc[order], line[order]), pa.array(n[order]), pa.array(size[order]), pa.array(as_long(other))]
        return pa.RecordBatch.from_arrays(arrays, ["key", "h", "doc_id", "line", "n", "all", "other"])

    rows = wanted.select("h", "doc_id", "line", "n", "cells").filter(F.length("cells") > 0).mapInArrow(send, schema(5))
    rows = of_parts(rows, kinds, sets, schema(7))
    return of_parts(rows, [("uint64", 0), ("int64", 0), *kinds], find, "key long, h long, doc_id long, line int, n int, all long, other long")


def _place_hash(doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.view("uint64") + _U(_M)) + line.astype("uint64") * _U(_M))


def _passing(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose hash in `column` is among keys, and a few others."""
    words, bits = bloom(keys, "key")
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(in_bloom(sent.value, bits, batch.column(column).to_numpy().view("uint64"))))

    return rows.mapInArrow(run, rows.schema)


def _texts(docs: DataFrame, wanted: DataFrame, keys: Filter, near_words: int, least: int, id_col: str, text_col: str) -> DataFrame:
    """h, doc_id, line, open and words of the wanted lines (doc_id, line) and a few others, from a second pass that splits texts but hashes only what is wanted."""

    def places(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(as_long(_place_hash(batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy())))], ["key"])

    words, bits = bloom(wanted.select("doc_id", "line").mapInArrow(places, "key long"), "key")
    sent = docs.sparkSession.sparkContext.broadcast((words, keys))

    def run(batches):
        import pyarrow as pa

        words, keys = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                texts = [t or "" for t in batch.column(1).slice(lo, 200).to_pylist()]
                ids = batch.column(0).slice(lo, 200)
                size = np.array([t.count("\n") + 1 for t in texts])
                line = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(np.arange(len(texts)), size)
                hit = np.flatnonzero(in_bloom(words, bits, _place_hash(ids.fill_null(0).to_numpy()[at], line)))
                if not len(hit):
                    continue
                at, line, last, found = at[hit], line[hit], -1, []
                for a, i in zip(at.tolist(), line.tolist(), strict=True):
                    if a != last:
                        last, split = a, texts[a].split("\n")
                    found.append(split[i])
                own = Lines("\n".join(found), 1, 1)  # a line without words has no number there
                body = [b" ".join(found[i].encode("utf-8", "surrogatepass").lower().split()) for i in own.number.tolist()]
                at, line = at[own.number], line[own.number]
                open_ = (keys.has(own.keys.ravel()).reshape(-1, 6).astype("int32") << np.arange(6, dtype="int32")).sum(1)
                open_[(own.n < near_words) | (own.n > least)] = 0
                columns = [pa.array(as_long(own.h)), ids.take(pa.array(at)), pa.array(line.astype("int32")), pa.array(open_.astype("int32")), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "line", "open", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "h long, doc_id long, line int, open int, words binary")


def variants(words: list[bytes], open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, roles and lines (their places in `words`) of lines' deletion variants. Roles: 0 a word replaced at i, 1 the line itself, 2 the line without a word.

    open_ says which keys other lines share. A word is left out only in the thirds that shared keys for m = n leave open;
    for a longer partner the line itself is enough. All lines at once, by differences of running sums as in Lines.
    """
    h, ends = words_and_lines(b"\n".join(words).decode("utf-8", "surrogatepass"))
    n = np.diff(ends, prepend=0)
    _powers.reach(int(n.max()) + 2)
    first, line = ends - n, np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[line]
    run = np.concatenate([np.zeros(1, "uint64"), np.cumsum(h * _powers.up[place], dtype="uint64")])
    third = np.where(place < (n // 3)[line], 4, np.where(place < (2 * n // 3)[line], 2, 1))
    at = np.flatnonzero(open_[line] & third)
    own = line[at]
    without = run[at] - run[first][own] + (run[ends][own] - run[at + 1]) * _U(_INVERSE)  # words after i move one place down
    v = _hash(without, (n[own] - 1).astype("uint64"))
    same = mix(v + (place[at].astype("uint64") + _U(1)) * _U(_M))
    whole = _hash(run[ends] - run[first], n.astype("uint64"))
    return as_long(np.concatenate([same, v, whole])), np.repeat(np.array([0, 2, 1], "int32"), [len(at), len(at), len(n)]), np.concatenate([own, own, np.arange(len(n))])


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two word sequences differ by at most one word replaced, put in or left out."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def within_edits(a: list[bytes], b: list[bytes], most: int) -> bool:
    """Whether `most` words replaced, put in or left out make b of a: the furthest place on each diagonal, edit by edit."""
    goal, n, m = len(b) - len(a), len(a), len(b)
    if abs(goal) > most:
        return False
    front: dict[int, int] = {}
    for e in range(most + 1):
        new = {}
        for k in range(max(-e, -n), min(e, m) + 1):
            i = max(front.get(k, -2) + 1, front.get(k - 1, -1), front.get(k + 1, -2) + 1) if e else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            new[k] = i
        if new.get(goal) == n:
            return True
        front = new
    return False


def _blocks(rows: DataFrame, compare, fields: list[tuple[str, str]]) -> DataFrame:
    """compare(block, probes, targets) of each key's rows, side by side in blocks of BLOCK; no task has to take a whole key.

    Blocks lie one after another in sorted partitions and are read as a stream, for most keys have a few rows only and a call each
    would cost more than their work. block: numpy columns of many blocks; probes and targets: row numbers.
    """
    sizes = rows.groupBy("key").agg(F.sum(F.col("probe").cast("long")).alias("p"), F.sum((~F.col("probe")).cast("long")).alias("q")).filter("p > 0 and q > 0")
    rows = rows.join(sizes, "key")
    left, right = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("p", "q"))
    own = F.when(F.col("probe"), F.pmod(F.xxhash64("h"), left)).otherwise(F.pmod(F.xxhash64("h"), right)).cast("int")
    rows = rows.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), right).otherwise(left) - 1)))
    rows = rows.withColumn("i", F.when(F.col("probe"), F.col("own")).otherwise(F.col("to"))).withColumn("j", F.when(F.col("probe"), F.col("to")).otherwise(F.col("own")))
    place = ["key", "i", "j"]
    rows = rows.drop("p", "q", "own", "to").repartition(*place).sortWithinPartitions(*place)

    def work(batch, cuts):
        import pyarrow as pa

        block = {c: batch.column(c).to_pylist() if batch.schema.field(c).type == pa.binary() else batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if "counts" in block:
            block["counts"] = np.frombuffer(b"".join(block["counts"]), "u1").reshape(-1, BUCKETS).astype("int16")
        probe, out = block["probe"], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = probe[lo:hi]
            if own.any() and not own.all():
                out += compare(block, lo + np.flatnonzero(own), lo + np.flatnonzero(~own))
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(fields)], [c for c, _ in fields])

    def run(batches):
        import pyarrow as pa

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            at = [batch.column(c).to_numpy() for c in place]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
            if len(cuts):  # the last block may go on in the next batch
                yield work(batch.slice(0, int(cuts[-1])), [0, *cuts.tolist()])
                rest = batch.slice(int(cuts[-1]))
            else:
                rest = batch
        if rest is not None:
            yield work(rest, [0, rest.num_rows])

    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in fields))


def one_edit_pairs(texts: DataFrame, parts: int) -> DataFrame:
    """h, other: lines that share a deletion variant with an earlier line, the earliest of them. texts: h, doc_id, line, open, words."""
    kinds = [("uint64", 0), ("u1", 0), ("uint64", 0), ("int64", 0), ("int32", 0)]

    def send(batches):
        import pyarrow.compute as pc

        for batch in batches:  # as many lines at once as have TOGETHER bytes or so
            size = np.cumsum(pc.binary_length(batch.column("words")).to_numpy().astype("int64")) // TOGETHER
            cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                key, role, at = variants(part.column("words").to_pylist(), part.column("open").to_numpy())
                h, doc, line = (part.column(c).fill_null(0).to_numpy() for c in ("h", "doc_id", "line"))
                line = np.where(part.column("doc_id").is_valid().to_numpy(zero_copy_only=False), line, -1 - line).astype("int32")
                key = key.view("uint64")
                yield dealt(key, [key, role.astype("u1"), h.view("uint64")[at], doc[at], line[at]], parts)

    def find(part, columns):
        import pyarrow as pa

        key, _, h = columns[:3]
        shared, least, most = least_and_most(key, h)
        several = shared[least < most]
        if not len(several):
            return None
        at = np.minimum(np.searchsorted(several, key), len(several) - 1)
        key, role, h, doc, line = (c[several[at] == key] for c in columns)
        order = _order(doc, line, h, role, key)  # texts has a few later copies of lines, too: the first one counts
        order = order[_changes(key[order], role[order], h[order])]
        key, role, h, doc, line = (c[order] for c in (key, role, h, doc, line))
        out = []
        # A replaced word meets its like; a whole line meets lines that are it plus a word, and the other way round.
        for own, met in ((0, 0), (1, 2), (2, 1)):
            at = np.flatnonzero((role == own) | (role == met))
            at = at[_order(doc[at], line[at], key[at])]
            # The earliest line of the role that is met: the first row of that role in the key's run.
            starts = np.cumsum(_changes(key[at])) - 1
            first = np.full(starts[-1] + 1 if len(at) else 0, -1)
            met_at = np.flatnonzero(role[at] == met)[::-1]
            first[starts[met_at]] = met_at
            here = np.flatnonzero((role[at] == own) & (first[starts] >= 0) & (first[starts] < np.arange(len(at))))
            out.append(np.stack([h[at[here]], h[at[first[starts[here]]]]], 1))
        pairs = np.concatenate(out)
        pairs = as_long(np.ascontiguousarray(pairs[pairs[:, 0] != pairs[:, 1]].T))
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["h", "other"])

    return of_parts(texts.mapInArrow(send, schema(5)), kinds, find, "h long, other long").distinct()


def _close(counts, n, others, ns, edit_words: int):
    """Which of others (rows of counts) may be near: sizes and counts are within the bound."""
    most = np.minimum(n, ns) // edit_words
    return (abs(ns - n) <= most) & (abs(others - counts).sum(1) <= 2 * most)


def _rows_of(counts) -> np.ndarray:
    return np.frombuffer(b"".join(counts.to_pylist()), "u1").reshape(-1, BUCKETS).astype("int16")


def close_pairs(members: DataFrame, wanted: DataFrame, edit_words: int) -> DataFrame:
    """h, other, most: lines and the earliest line of one of their cells, where sizes and counts are within the bound of `most` edits."""
    own = wanted.filter(F.length("cells") > 0).select("h", "n", "counts")
    pairs = members.filter("h <> other").select("h", "other").distinct()
    pairs = pairs.join(own, "h").join(own.toDF("other", "n2", "counts2"), "other")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                n, m = batch.column("n").to_numpy().astype("int64"), batch.column("n2").to_numpy().astype("int64")
                ok = pa.array(_close(_rows_of(batch.column("counts")), n, _rows_of(batch.column("counts2")), m, edit_words))
                batch = pa.RecordBatch.from_arrays([batch.column("h"), batch.column("other"), pa.array((np.minimum(n, m) // edit_words).astype("int32"))], ["h", "other", "most"])
                yield batch.filter(ok)

    return pairs.select("h", "other", "n", "counts", "n2", "counts2").mapInArrow(run, "h long, other long, most int")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """h of the pairs (h, other, most) whose words are within `most` edits."""
    needed = pairs.select(F.explode(F.array("h", "other")).alias("key")).distinct()
    words = written(_passing(texts.select("h", "words"), "h", needed), "words")  # so that no task has two Python workers
    both = pairs.join(words, "h").join(words.toDF("other", "words2"), "other")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            rows = zip(batch.column("words").to_pylist(), batch.column("words2").to_pylist(), batch.column("most").to_pylist(), strict=True)
            ok = [within_one_edit(a.split(), b.split()) if most == 1 else within_edits(a.split(), b.split(), most) for a, b, most in rows]
            yield pa.RecordBatch.from_arrays([batch.column("h").filter(pa.array(ok, pa.bool_()))], ["h"])

    return both.select("h", "words", "words2", "most").mapInArrow(verify, "h long").distinct()


def near_others(members: DataFrame, wanted: DataFrame, texts: DataFrame, near: DataFrame, edit_words: int) -> DataFrame:
    """h of the long lines that aren't near and have an earlier line, not the earliest of a cell, within one edit for each edit_words words.

    Blocks with few pairs within the bounds of sizes and counts yield them; in the others that would be a table as large as the
    square of a cell, so their lines are compared where they lie.
    """
    # Where there are but two lines, they have been compared.
    order = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")
    members = members.filter("all > 2").select("key", "h", order, "line")
    both = members.join(near, "h", "left_anti").withColumn("probe", F.lit(True)).unionByName(members.withColumn("probe", F.lit(False)))
    own = wanted.filter(F.length("cells") > 0)
    both = both.join(own.select("h", "n", "counts"), "h")

    def near_pairs(block, p, t):
        """Which targets of each probe are earlier lines with sizes and counts within the bound."""
        doc, line, n, counts = (block[c] for c in ("doc_id", "line", "n", "counts"))
        most = np.minimum(n[p][:, None], n[t][None]) // edit_words
        ok = (doc[t][None] < doc[p][:, None]) | ((doc[t][None] == doc[p][:, None]) & (line[t][None] < line[p][:, None]))
        ok &= abs(n[p][:, None] - n[t][None]) <= most
        x, y = np.nonzero(ok)
        for lo in range(0, len(x), 20_000):
            i, j = x[lo : lo + 20_000], y[lo : lo + 20_000]
            ok[i, j] = abs(counts[p[i]] - counts[t[j]]).sum(1) <= 2 * most[i, j]
        return ok

    def candidates(block, p, t):
        ok, n, key, h = near_pairs(block, p, t), block["n"], block["key"], block["h"]
        probes, targets = p[ok.any(1)], t[ok.any(0)]
        if ok.sum() > DENSE * (len(probes) + len(targets)):
            return [(key[x], True, h[x], None, None) for x in probes.tolist()] + [(key[x], False, h[x], None, None) for x in targets.tolist()]
        x, y = np.nonzero(ok)
        most = np.minimum(n[p[x]], n[t[y]]) // edit_words
        return [(None, None, *r) for r in zip(h[p[x]].tolist(), h[t[y]].tolist(), most.tolist(), strict=True)]

    fields = [("key", "long"), ("probe", "boolean"), ("h", "long"), ("other", "long"), ("most", "int")]
    found = written(_blocks(both, candidates, fields).distinct(), "candidates")
    some = _verified(found.filter("other is not null").select("h", "other", "most"), texts)
    dense = found.filter("other is null").select("key", "probe", "h")
    if dense.isEmpty():
        return some
    words = texts.select("h", "words").join(dense.select("h").distinct(), "h").dropDuplicates(["h"])
    both = dense.join(own.select("h", order, "line", "n", "counts").join(words, "h"), "h")

    def confirmed(block, p, t):
        ok, n, words, out = near_pairs(block, p, t), block["n"], block["words"], []
        for x in np.flatnonzero(ok.any(1)).tolist():
            one = words[p[x]].split()
            if any(within_edits(one, words[t[y]].split(), int(min(n[p[x]], n[t[y]])) // edit_words) for y in np.flatnonzero(ok[x]).tolist()):
                out.append((block["h"][p[x]],))
        return out

    return some.unionByName(_blocks(both, confirmed, [("h", "long")])).distinct()


def removable(docs: DataFrame, *, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, edit_words: int = EDIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line of every line to remove."""
    spark, least = docs.sparkSession, 2 * edit_words
    lines = written(line_table(docs, id_col, text_col, min_words, near_words, edit_words), "lines")
    total = lines.select(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_lines", "n_keys", "n_cells")]).first()
    again = written(repeats(lines, parts_for(total["n_lines"])), "repeats")

    blocks, kinds = _of(lines, "h", "n", "keys")
    keys = shared_keys(blocks, kinds, lambda h, n, k: (k.ravel(), np.repeat(h[(n >= near_words) & (n <= least)], 6)), parts_for(6 * total["n_keys"]), MOST_BITS)
    release(spark)
    blocks, kinds = _of(lines, "h", "n", "cells", "sizes")
    shared = shared_keys(blocks, kinds, lambda h, n, k, sizes: (k, np.repeat(h[n >= least], sizes)), parts_for(total["n_cells"]), MOST_BITS)
    release(spark)
    wanted = written(with_shared(lines, keys, shared, near_words, least, parts_for(total["n_lines"])), "wanted")
    drop(lines)
    members = written(anchored(wanted, parts_for(total["n_cells"] // 4)), "anchored")
    release(spark)
    pairs = written(close_pairs(members, wanted, edit_words), "close-pairs")
    hs = pairs.select(F.explode(F.array("h", "other")).alias("h")).unionByName(members.filter("all > 2").select("h")).distinct()
    places = wanted.select("h", "doc_id", "line", "open").join(hs.withColumn("long", F.lit(True)), "h", "left").filter("open <> 0 or long").select("doc_id", "line")
    texts = written(_texts(docs, written(places, "places"), keys, near_words, least, id_col, text_col), "texts")
    release(spark)
    one = one_edit_pairs(texts.filter("open <> 0"), parts_for(total["n_keys"]))
    near = written(_verified(written(pairs.unionByName(one.withColumn("most", F.lit(1))), "pairs"), texts), "near-first")
    near = near.unionByName(near_others(members, wanted, texts, near, edit_words))
    return again.unionByName(wanted.select("h", "doc_id", "line").join(near, "h", "left_semi").select("doc_id", "line"))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, edit_words: int = EDIT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removable lines taken out of the text, and n_lines and n_removed.

    Null text stays null (no lines). A text that loses all its lines becomes empty. Rows that share an id count as one
    document, so a line they share at the same place stays in both. Other columns stay as they are.
    """
    gone = removable(docs, min_words=min_words, near_words=near_words, edit_words=edit_words, id_col=id_col, text_col=text_col)

    def masks(batches):  # a byte for each line, so that asking for one takes no search
        import pyarrow as pa

        for batch in batches:
            out = []
            for lines in batch.column(1).to_pylist():
                mask = np.zeros(max(lines) + 1, "u1")
                mask[lines] = 1
                out.append(mask.tobytes())
            sizes = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), sizes], ["__id", "__gone", "__n"])

    # At most as many numbers as the longest document has lines.
    gone = gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines")).mapInArrow(masks, "__id long, __gone binary, __n long")
    gone = written(gone, "gone-lines")
    release(docs.sparkSession)
    # Always a shuffled join: the list of lines grows with the input, and small inputs shall take the same way.
    joined = docs.join(gone.hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: F.substr("__gone", i + 1, F.lit(1)) != F.lit(b"\x01")), "\n")
    return joined.select(
        *[F.when(F.col("__gone").isNull(), docs[c]).otherwise(left).alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0).cast("long")).alias("n_removed"),
    )

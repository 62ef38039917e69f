"""Numbers through a shuffle in blocks: a row holds all values that a batch sends to one part, so Spark moves few rows and numpy does the rest.

A block is a binary column of a numpy type, or of rows of that many values: types are (type, width), width 0 for single values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Values of a part, about; parts; bytes of blocks dealt out together.
PER_PART, MOST_PARTS, TOGETHER = 1 << 18, 1 << 15, 1 << 22


def parts_for(values: int) -> int:
    return min(MOST_PARTS, max(16, -(-values // PER_PART)))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """From the highest bits, so what is sorted by hash is sorted by part."""
    return (((h >> np.uint64(48)) * np.uint64(parts)) >> np.uint64(16)).astype("uint16")


def blobs(columns: list[np.ndarray], ends: np.ndarray):
    """Arrow binary arrays of columns cut at ends (the first is 0)."""
    import pyarrow as pa

    out = []
    for c in columns:
        c = np.ascontiguousarray(c)
        size = c.itemsize * (c.shape[1] if c.ndim > 1 else 1)
        out.append(pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype("int32")), pa.py_buffer(c)]))
    return out


def values(batch, i: int, kinds: list[tuple[str, int]], first: int) -> list[np.ndarray]:
    """Columns from `first` on of a batch's row."""
    out = []
    for c, (kind, width) in enumerate(kinds, first):
        x = np.frombuffer(batch.column(c)[i].as_buffer(), kind)
        out.append(x.reshape(-1, width) if width else x)
    return out


def joined(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def in_runs(batches, kinds: list[tuple[str, int]]):
    """Columns of blocks, as many together as have TOGETHER bytes or so."""
    found, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            found.append(values(batch, i, kinds, 0))
            size += sum(x.nbytes for x in found[-1])
            if size >= TOGETHER:
                yield joined(found)
                found, size = [], 0
    if found:
        yield joined(found)


def dealt(h: np.ndarray, columns: list[np.ndarray], parts: int):
    """A batch of rows (part, a block of each column), by the hash h."""
    import pyarrow as pa

    part = part_of(h, parts)
    if (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in columns]
    starts = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1)[: len(part)]
    names = ["part", *(f"c{i}" for i in range(len(columns)))]
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype("int32")), *blobs(columns, np.append(starts, len(part)))], names)


def schema(columns: int) -> str:
    return ", ".join(["part int", *(f"c{i} binary" for i in range(columns))])


def of_parts(rows: DataFrame, kinds: list[tuple[str, int]], work, out: str) -> DataFrame:
    """work(part, columns) -> a batch or None, once for each part; parts are read one after another from sorted partitions."""

    def run(batches):
        own, found = None, []
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != own and found:
                    done = work(own, joined(found))
                    found = []
                    if done is not None:
                        yield done
                own = part
                found.append(values(batch, i, kinds, 1))
        if found and (done := work(own, joined(found))) is not None:
            yield done

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, out)


def least_and_most(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, with the least and the greatest h beside it."""
    order = np.argsort(key)
    key, h = key[order], h[order]
    starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)[: len(key)]
    if not len(key):
        return key, h, h
    return key[starts], np.minimum.reduceat(h, starts), np.maximum.reduceat(h, starts)


class Filter:
    """Bloom filter (four probes) in parts, each of its own size, as the parts' tasks have made them."""

    def __init__(self, found, parts: int):
        self.parts, words, self.start, self.mask = parts, [], np.zeros(parts, "uint64"), np.zeros(parts, "uint64")
        at = 1  # a part without keys has the word of no bits at the beginning
        words.append(np.zeros(1, "uint64"))
        for part, block in zip(found.column(0).to_pylist(), found.column(1), strict=True):
            own = np.frombuffer(block.as_buffer(), "uint64")
            self.start[part], self.mask[part] = at, len(own) * 64 - 1
            words.append(own)
            at += len(own)
        self.words = np.concatenate(words)

    @staticmethod
    def probes(key: np.ndarray):
        """Places before masking; the highest 16 bits say the part, so they aren't used."""
        yield key
        yield key >> np.uint64(20)
        other = key * np.uint64(0xD6E8FEB86659FD93)
        yield other >> np.uint64(32)
        yield other >> np.uint64(12)

    @classmethod
    def block(cls, keys: np.ndarray, most_bits: int) -> bytes:
        bits = min(most_bits, 1 << max(6, (len(keys) * 16 - 1).bit_length()))
        set_ = np.zeros(bits, "u1")
        for p in cls.probes(keys):
            set_[(p & np.uint64(bits - 1)).astype("int64")] = 1
        return np.packbits(set_, bitorder="little").tobytes()

    def has(self, key: np.ndarray) -> np.ndarray:
        part = part_of(key, self.parts)
        left, start, mask = np.arange(len(key)), self.start[part], self.mask[part]
        for p in self.probes(key):
            at = p[left] & mask[left]
            ok = (self.words[(start[left] + (at >> np.uint64(6))).astype("int64")] >> (at & np.uint64(63))) & np.uint64(1) == 1
            left = left[ok]
        out = np.zeros(len(key), bool)
        out[left] = True
        return out


def shared_keys(blocks: DataFrame, kinds: list[tuple[str, int]], pairs, parts: int, most_bits: int) -> Filter:
    """Filter of the keys that two or more h have; pairs(columns) gives keys and h of blocks. Of a key's h each batch sends two at most."""

    def send(batches):
        for columns in in_runs(batches, kinds):
            key, least, most = least_and_most(*pairs(*columns))
            both = np.repeat(np.arange(len(key)), 1 + (least < most))
            second = np.append(False, both[1:] == both[:-1])[: len(both)]
            if len(both):
                yield dealt(key[both], [key[both], np.where(second, most[both], least[both])], parts)

    # Each part's share of the bits is a power of two.
    share = 1 << max(6, (most_bits // parts).bit_length() - 1)

    def find(part, columns):
        import pyarrow as pa

        key, least, most = least_and_most(*columns)
        key = key[least < most]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([Filter.block(key, share)], pa.binary())], ["part", "words"]) if len(key) else None

    rows = blocks.mapInArrow(send, schema(2))
    return Filter(of_parts(rows, [("uint64", 0)] * 2, find, "part int, words binary").toArrow(), parts)

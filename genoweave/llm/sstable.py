"""Token-ID output as sorted-string-table shards: write, look up, read back.

A shard holds documents in ascending key order:

    data blocks | block index | Bloom filter | footer

* A data block is a zstd frame of entries (shared key bytes, own key bytes, value bytes as varints, then the
  key's own bytes and the value). The first entry of a block shares nothing.
* The block index is sparse: for each block its first key, offset and length.
* The Bloom filter has ten bits and seven probes a key.
* The footer has a fixed size: offsets, lengths and counts of those parts, a crc32 of index and filter, magic bytes.

A look-up reads the footer, asks the Bloom filter, searches the index by bisection and reads one block.
Keys are order-preserving bytes of (doc_id, number among its equals), so null ids come first and repeated ids stay apart.
Values are token ids, two bytes each where the vocabulary allows it and else four.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written
from .tokens import encoder, widened

MAGIC = b"GWSST001"
FOOTER = struct.Struct("<QQQQQQQBI8s")
BLOCK_BYTES = 1 << 16
BITS, PROBES = 10, 7


def key_bytes(doc_id: int | None, copy: int = 0) -> bytes:
    """Bytes that sort as (doc_id, copy) does, null first."""
    head = b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))
    return head + (struct.pack(">I", copy) if copy else b"")


def key_id(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Entries must come in ascending key order. Memory: one block, the sparse index and the key hashes' filter."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.pack = out, width, zstandard.ZstdCompressor(level=3).compress
        self.at = self.n_keys = self.n_ids = 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, value: bytes) -> None:
        if self.n_keys and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_keys += 1
        self.n_ids += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block.clear()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BITS * self.n_keys)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bloom)
        crc = zlib.crc32(index + bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), bits, self.n_keys, self.n_ids, self.width, crc, MAGIC))


class Reader:
    """Of one shard; f is a seekable binary file."""

    def __init__(self, f):
        import zstandard

        self.f, self.unpack = f, zstandard.ZstdDecompressor().decompress
        f.seek(0, 2)
        f.seek(f.tell() - FOOTER.size)
        at, n, at_bloom, n_bloom, self.bits, self.n_keys, self.n_ids, self.width, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        f.seek(at)
        both = f.read(n + n_bloom)
        if zlib.crc32(both) != crc:
            raise ValueError("index or filter is damaged")
        index, self.bloom = both[:n], both[at_bloom - at :]
        self.first: list[bytes] = []
        self.place: list[tuple[int, int]] = []
        pos = 0
        while pos < n:
            k, pos = _read_varint(index, pos)
            self.first.append(index[pos : pos + k])
            start, pos = _read_varint(index, pos + k)
            size, pos = _read_varint(index, pos)
            self.place.append((start, size))

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        start, size = self.place[i]
        self.f.seek(start)
        data, at, key = self.unpack(self.f.read(size)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.place)):
            yield from self._block(i)

    def get(self, key: bytes) -> bytes | None:
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return None
        i = bisect.bisect_right(self.first, key) - 1
        return next((v for k, v in self._block(i) if k == key), None) if i >= 0 else None


def open_store(uri: str):
    """pyarrow's file system for a URI (file, hdfs, s3, gs, ...), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, n_shards: int | None = None) -> DataFrame:
    """Tokenizes every whole text and writes the shards; returns a row for each: shard, path, n_docs, n_ids.

    Null text: empty, so only end_id. Null ids come first. Repeated ids are numbered in the order of their
    texts. An empty table gives no shard. A shard is written under a name of the attempt's own and then
    renamed, so a lost or repeated task leaves one whole file. Further columns are ignored.
    """
    spark = docs.sparkSession
    base = folder or new_folder(spark, "sst")
    n = n_shards or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        store, root = open_store(base)
        store.create_dir(root, recursive=True)
        enc = encoder(tokenizer)
        width = enc.width if end_id < 1 << 16 else 4
        part, path = f"{root}/.part-{shard:06d}-{task.taskAttemptId()}", f"{root}/shard-{shard:06d}.sst"
        out = writer = None
        last, copy = object(), 0
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    out = store.open_output_stream(part)
                    writer = Writer(out, width)
                copy = copy + 1 if k == last else 0
                last = k
                writer.add(key_bytes(k, copy), (ids if width == enc.width else widened(ids, enc.width)) + end)
        if writer is not None:
            writer.close()
            out.close()
            store.move(part, path)
            import pyarrow as pa

            columns = [pa.array([shard], pa.int32()), pa.array([f"shard-{shard:06d}.sst"]), pa.array([writer.n_keys], pa.int64()), pa.array([writer.n_ids], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "n_docs", "n_ids"])

    done = rows.mapInArrow(write, "shard int, path string, n_docs long, n_ids long")
    return written(done.withColumn("folder", F.lit(base)), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Offsets are a prefix sum over the manifest, which has one short row a shard.
    """
    from pyspark.sql.window import Window as W

    before = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    n = max(1, manifest.count())
    placed = placed.repartition(n, "shard")

    def read(batches):
        import numpy as np

        for batch in batches:
            for folder, path, start in zip(*(batch.column(c).to_pylist() for c in ("folder", "path", "before")), strict=True):
                store, root = open_store(folder)
                with store.open_input_file(f"{root}/{path}") as f:
                    shard, rows, at = Reader(f), [], int(start)
                    for key, value in shard:
                        ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                        rows.append((key_id(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == 20_000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def look_up(manifest: DataFrame, doc_id: int) -> list[int] | None:
    """Token ids of one document by binary search in the shards whose Bloom filter admits it."""
    import numpy as np

    for row in manifest.orderBy("shard").toLocalIterator():
        store, root = open_store(row["folder"])
        with store.open_input_file(f"{root}/{row['path']}") as f:
            shard = Reader(f)
            if (value := shard.get(key_bytes(doc_id))) is not None:
                return np.frombuffer(value, f"<u{shard.width}").tolist()
    return None

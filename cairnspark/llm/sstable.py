"""Token shards as sorted string tables: write documents by id, look single ones up, read everything back.

A shard holds documents in key order. Layout, little-endian:

    magic
    blocks   zstd frames; an entry is varint(shared key bytes), varint(other key bytes), varint(ids), width (2 or 4), other key
             bytes, ids
    index    zstd frame; per block: varint(key length), first key, u64 offset, u32 stored bytes, u32 entries, u64 ids before it
    bloom    bit array over all keys
    footer   u64 index offset, u64 index bytes, u64 bloom offset, u64 bloom bytes, u64 entries, u64 ids, u32 hashes, magic
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.taskcontext import TaskContext

from .common import shared_path, table, text_slices
from .tokens import encoder as open_encoder

MAGIC = b"CSST0001"
FOOTER = struct.Struct("<6QI8s")
BLOCK_BYTES, BITS_PER_KEY, END_ID = 128 << 10, 10, 2
#: Least bytes of text for each shard, and most shards; beyond their product shards grow with the input.
SHARD_BYTES, MOST_SHARDS = 16 << 20, 1 << 15


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop URI; Arrow knows S3 by one name only."""
    return fs.FileSystem.from_uri(f"s3{uri[3:]}" if uri.startswith(("s3a:", "s3n:")) else uri)


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do, nulls first."""
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


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
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _bits(key: bytes, hashes: int, size: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % size for i in range(hashes)]


class Writer:
    """Writes one shard; keys must come in order."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES, bits_per_key: int = BITS_PER_KEY) -> None:
        self._stream, self._limit, self._per_key = stream, block_bytes, bits_per_key
        self._pack = zstandard.ZstdCompressor(level=1).compress
        self._at, self.entries, self.tokens = len(MAGIC), 0, 0
        self._block, self._index, self._keys = bytearray(), bytearray(), []
        self._in_block, self._before, self._first, self._last = 0, 0, b"", b""
        stream.write(MAGIC)

    def add(self, key: bytes, ids: bytes) -> None:
        if not self._in_block:
            self._first, self._last, self._before = key, b"", self.tokens
        shared = 0
        while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
            shared += 1
        values = np.frombuffer(ids, dtype="<u4")
        width = 2 if not len(values) or values.max() < 1 << 16 else 4
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(values)) + bytes([width]) + key[shared:]
        self._block += values.astype("<u2").tobytes() if width == 2 else ids
        self._last = key
        self._in_block += 1
        self.entries += 1
        self.tokens += len(values)
        self._keys.append(zlib.crc32(key) | (zlib.crc32(key, 0x9E3779B9) | 1) << 32)
        if len(self._block) >= self._limit:
            self._flush()

    def _flush(self) -> None:
        if self._in_block:
            data = self._pack(bytes(self._block))
            self._stream.write(data)
            self._index += _varint(len(self._first)) + self._first
            self._index += struct.pack("<QIIQ", self._at, len(data), self._in_block, self._before)
            self._at += len(data)
            self._block, self._in_block = bytearray(), 0

    def close(self) -> int:
        self._flush()
        index = self._pack(bytes(self._index))
        size, hashes = max(64, self.entries * self._per_key), max(1, round(self._per_key * 0.69))
        filled = np.zeros(size, dtype=bool)
        hashed = np.array(self._keys, dtype=np.uint64)
        a, b = hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32)
        for i in range(hashes):
            filled[((a + np.uint64(i) * b) % np.uint64(size)).astype(np.int64)] = True
        bloom = struct.pack("<Q", size) + np.packbits(filled, bitorder="little").tobytes()
        self._stream.write(index + bloom)
        at = self._at
        self._stream.write(FOOTER.pack(at, len(index), at + len(index), len(bloom), self.entries, self.tokens, hashes, MAGIC))
        return at + len(index) + len(bloom) + FOOTER.size


class Reader:
    """Opens one shard by its footer; get() reads one block, scan() all of them in order."""

    def __init__(self, uri: str) -> None:
        store, path = _store(uri)
        self._file = store.open_input_file(path)
        self._unpack = zstandard.ZstdDecompressor().decompress
        end = self._file.size()
        fields = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if fields[7] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        index_at, index_n, bloom_at, bloom_n, self.entries, self.tokens, self._hashes, _ = fields
        index, self._firsts, self._blocks, at = self._unpack(self._at(index_at, index_n)), [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self._firsts.append(index[at : at + n])
            self._blocks.append(struct.unpack_from("<QIIQ", index, at + n))
            at += n + 24
        bloom = self._at(bloom_at, bloom_n)
        self._bloom, self._bloom_size = bloom[8:], struct.unpack_from("<Q", bloom)[0]

    def _at(self, offset: int, n: int) -> bytes:
        return self._file.read_at(n, offset)

    def may_hold(self, key: bytes) -> bool:
        return all(self._bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self._hashes, self._bloom_size))

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, bytes]]:
        offset, n, entries, before = self._blocks[block]
        data, at, key = self._unpack(self._at(offset, n)), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            count, at = _read_varint(data, at)
            width = data[at]
            key = key[:shared] + data[at + 1 : at + 1 + other]
            at += 1 + other
            ids = data[at : at + count * width]
            at += count * width
            yield key, before, np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if width == 2 else ids
            before += count

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with this key: Bloom filter, then binary search in the index, then one block or a few."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        found, block = [], max(0, bisect.bisect_left(self._firsts, key) - 1)
        while block < len(self._blocks) and self._firsts[block] <= key:
            found += [ids for k, _, ids in self._entries(block) if k == key]
            block += 1
        return found

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this shard, its ids as little-endian u32)."""
        for block in range(len(self._blocks)):
            for key, before, ids in self._entries(block):
                yield id_of(key), before, ids


_SHARD = "shard int, uri string, n_docs long, n_tokens long, n_bytes long, first_id long, last_id long"


def _write(tokenizer: str, folder: str, end_id: int):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = open_encoder(tokenizer), TaskContext.get().partitionId()
        writer = stream = first = last = None
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        for batch in text_slices(batches, limit=8 << 20, rows=4000, hold=True):
            if writer is None:
                store, path = _store(uri)
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = store.open_output_stream(path)
                writer, first = Writer(stream), batch.column("doc_id")[0].as_py()
            texts = encoder.encode(batch.column("text"))
            for last, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                writer.add(key_of(last), ids + end)
        if writer is not None:
            size = writer.close()
            stream.close()
            row = (shard, uri, writer.entries, writer.tokens, size, first, last)
            names = [x.split()[0] for x in _SHARD.split(", ")]
            kinds = [pa.int32(), pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds, strict=True)], names=names)

    return run


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Tokenize docs (doc_id, text) into shards of ascending id; returns the manifest, a row per shard.

    A null or empty text is its end id alone, a null id sorts first, repeated ids stay apart (ordered by a hash of the text),
    other columns are not looked at; an empty table gives no shard; a long text is one entry, whole. A shard holds about
    SHARD_BYTES of text, or an even part of all of it where that would make more than MOST_SHARDS. A task writes a file of its own name and only files of
    finished tasks are in the manifest, so a task that runs twice does no harm.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "shards")
    if shards is None:
        shards = min(MOST_SHARDS, -(-(docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // SHARD_BYTES) or 1)
    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return table(ordered.mapInArrow(_write(tokenizer, folder, end_id), _SHARD), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All documents of the shards in a manifest: doc_id, start (ids of all documents before it), ids (u32 bytes).

    Where a shard begins is a running sum over the manifest's rows, of which there are MOST_SHARDS at most; the shards are then
    dealt out to as many tasks.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("before")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("before").to_pylist(), strict=True):
                out, size = [], 0
                for doc_id, start, ids in Reader(uri).scan():
                    out.append((doc_id, base + start, ids))
                    size += len(ids)
                    if size > 8 << 20:
                        yield _batch(out, kinds)
                        out, size = [], 0
                if out:
                    yield _batch(out, kinds)

    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    columns = [pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids"])

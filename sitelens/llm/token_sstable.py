"""Token ids as sorted-string-table shards.

A shard holds one run of the key order. Its entries (key, ids) lie in blocks; inside a block a key is stored as the
length it shares with the key before it and the rest. After the blocks come a sparse index (first key, offset, length
and first token of each block), a Bloom filter over the keys and a fixed-length footer. A look-up reads the footer,
asks the filter, finds the block by binary search in the index and scans that block alone.

Keys: one byte 0 for null, or 1 and the identifier as an order-preserving 8-byte integer; repeated keys are kept, in
order of their texts' hashes. Values are little-endian ids, two bytes each where the vocabulary allows it, else four. Blocks
carry a CRC. Shards are written under a task's own name and then renamed, so a repeated task replaces equal bytes.

Scale: one range exchange by key; a task streams its sorted rows and holds one block, the index and 8 bytes a key for the
filter. Repeated identifiers (null among them) may fill several shards: rows are dealt by (key, hash of the text).
Defined results: null and empty texts have only the end id; an empty table makes no shard and returns no rows.
"""

from __future__ import annotations

import bisect
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parts import Parts

BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7
MAGIC = b"SSTTOK01"
#: Bytes of encoded parts that a worker keeps in each of two generations; bytes of text that are split at once.
KEPT_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
#: index offset, bloom offset, footer offset, entries, tokens, id width, magic
FOOTER = struct.Struct("<QQQQQI8s")


def key_of(value: int | None) -> bytes:
    """Order-preserving bytes of an identifier."""
    return b"\x00" if value is None else b"\x01" + struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1))


def value_of(key: bytes) -> int | None:
    """The identifier of a key."""
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 0x7F) << shift
        if c < 0x80:
            return n, at
        shift += 7


def bloom(hashes: array) -> bytes:
    """A filter of about BLOOM_BITS bits a key, from the keys' 64-bit hashes."""
    m = max(64, len(hashes) * BLOOM_BITS + 7 & ~7)
    bits = np.zeros(m >> 3, dtype=np.uint8)
    h = np.frombuffer(hashes, dtype=np.uint64)
    for lo in range(0, len(h), 1 << 16):
        a, b = h[lo : lo + (1 << 16)] & np.uint64(0xFFFFFFFF), (h[lo : lo + (1 << 16)] >> np.uint64(32)) | np.uint64(1)
        for i in range(BLOOM_HASHES):
            p = (a + np.uint64(i) * b) % np.uint64(m)
            np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(0x80) >> (p & np.uint64(7)).astype(np.uint8))
    return bits.tobytes()


def in_bloom(bits: bytes, key: bytes) -> bool:
    """False only for keys that were not added."""
    h, m = xxhash.xxh3_64_intdigest(key), len(bits) * 8
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return all(bits[(p := (a + i * b) % m) >> 3] & 0x80 >> (p & 7) for i in range(BLOOM_HASHES))


class ShardWriter:
    """Writes entries that come in key order to a binary stream."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.offset = out, width, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[bytes] = []
        self.hashes = array("Q")
        self.previous: bytes | None = None
        self.entries = self.tokens = self.block_token = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """Appends one entry; ids is the encoded value."""
        if not self.block:
            self.first, self.last, self.block_token = key, b"", self.tokens
        shared = 0
        for x, y in zip(key, self.last):  # noqa: B905  keys may differ in length
            if x != y:
                break
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        if self.previous != key:
            self.hashes.append(xxhash.xxh3_64_intdigest(key))
            self.previous = key
        self.last = key
        self.entries += 1
        self.tokens += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QQQ", self.offset, len(data), self.block_token))
            self.offset += len(data)
            self.block.clear()

    def close(self) -> None:
        """Writes index, filter and footer."""
        self._flush()
        index = struct.pack("<I", len(self.index)) + b"".join(self.index)
        bits = bloom(self.hashes)
        self.out.write(index + bits + FOOTER.pack(self.offset, self.offset + len(index), self.offset + len(index) + len(bits), self.entries, self.tokens, self.width, MAGIC))
        self.out.close()


@dataclass
class Shard:
    """An open shard: footer, index and filter are read, blocks on demand."""

    file: object
    entries: int
    tokens: int
    width: int
    keys: list[bytes]
    places: list[tuple[int, int, int]]
    bits: bytes

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        """Entries of the k-th block; a damaged block is an error."""
        offset, length, _ = self.places[k]
        self.file.seek(offset)
        raw = self.file.read(length)
        data = raw[:-4]
        if zlib.crc32(data) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        """The ids of an entry."""
        return np.frombuffer(value, dtype="<u2" if self.width == 2 else "<u4")

    def find(self, key: bytes) -> list[np.ndarray]:
        """All entries of a key by filter and binary search."""
        if not in_bloom(self.bits, key):
            return []
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        out = []
        while k < len(self.keys) and self.keys[k] <= key:
            out += [self.ids(v) for x, v in self.block(k) if x == key]
            k += 1
        return out


def open_shard(path: str) -> Shard:
    """Reads footer, index and filter of a shard."""
    fs, name = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(name)
    size = f.size()
    f.seek(size - FOOTER.size)
    index_at, bloom_at, footer_at, entries, tokens, width, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError(f"no token shard: {path}")
    f.seek(index_at)
    tail = f.read(footer_at - index_at)
    index, bits = tail[: bloom_at - index_at], tail[bloom_at - index_at :]
    (n,), at = struct.unpack_from("<I", index), 4
    keys, places = [], []
    for _ in range(n):
        length, at = _read_varint(index, at)
        keys.append(index[at : at + length])
        places.append(struct.unpack_from("<QQQ", index, at + length))
        at += length + 24
    return Shard(f, entries, tokens, width, keys, places, bits)


class LibraryEncoder:
    """Encodes with the tokenizers library; a part's value is its packed ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        sizes = {i: len(s) for s, i in self.lib.get_vocab(with_added_tokens=False).items()}
        self.sizes = np.array([sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)], dtype=np.int64)
        self.joins = not any(" " in s for s in special)
        self.parts = Parts(self._make, [s.encode() for s in special], KEPT_BYTES, CHUNK_BYTES)

    def pack(self, ids: list[int]) -> bytes:
        """Little-endian bytes of ids."""
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _make(self, parts: list[bytes]) -> list[bytes]:
        """Ids of new parts. Those that start with a space and a printable character, where every split has a boundary, go
        to the library as one text, whose ids are cut where the bytes of the parts end. The others go to it one by one."""
        out = [b""] * len(parts)
        inner = [i for i, p in enumerate(parts) if p[0] == 0x20 and p[1:2].isalnum()] if self.joins else []
        rest = range(len(parts))
        if inner:
            (whole,) = self.lib.encode_batch_fast([b"".join([parts[i] for i in inner]).decode()], add_special_tokens=False)
            ids = np.array(whole.ids, dtype=np.int64)
            ends = np.cumsum(self.sizes[ids])
            want = np.cumsum([len(parts[i]) for i in inner])
            cuts = np.searchsorted(ends, want)
            if ends[-1] == want[-1] and np.array_equal(ends[cuts], want):
                packed, at = ids.astype(f"<u{self.width}").tobytes(), 0
                for i, cut in zip(inner, ((cuts + 1) * self.width).tolist(), strict=True):
                    out[i] = packed[at:cut]
                    at = cut
                rest = [i for i in rest if not out[i]]
        if rest:
            for i, e in zip(rest, self.lib.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False), strict=True):
                out[i] = self.pack(e.ids)
        return out

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, memoryview]]:
        """Yields (first row, byte offsets of the rows, packed ids of the rows) for runs of whole texts."""
        return self.parts.rows(texts)


_encoders: dict[str, LibraryEncoder] = {}


def write(docs: DataFrame, folder: str, tokenizer: str, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> list[tuple[str, int, int]]:
    """Writes the shards in key order; returns (path, entries, tokens) of each, in key order: one small row a shard."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).repartitionByRange(n, "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, number = None, context.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/part-{number:06d}.sst"
        own = f"{base}/.part-{number:06d}-{context.taskAttemptId()}"
        e = _encoders.setdefault(tokenizer, None) or LibraryEncoder(tokenizer)
        _encoders[tokenizer] = e
        end = e.pack([end_id])
        first: bytes | None = None
        for b in batches:
            keys = list(map(key_of, b.column("k").to_pylist()))
            for lo, at, raw in e.encode(b.column("t")):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer, first = ShardWriter(fs.open_output_stream(own), e.width), keys[lo]
                edges = at.tolist()
                for key, x, y in zip(keys[lo : lo + len(edges) - 1], edges[:-1], edges[1:], strict=True):
                    writer.add(key, bytes(raw[x:y]) + end)
        if writer is not None:
            writer.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary()), pa.array([number], pa.int64()), pa.array([f"{folder}/part-{number:06d}.sst"]), pa.array([writer.entries], pa.int64()), pa.array([writer.tokens], pa.int64())], ["first", "number", "path", "entries", "tokens"])

    found = rows.mapInArrow(run, "first binary, number bigint, path string, entries bigint, tokens bigint").collect()
    return [(r.path, r.entries, r.tokens) for r in sorted(found, key=lambda r: (bytes(r.first), r.number))]


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """Entries of all shards, read back from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    return _read(spark, shards, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_digests(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """As read, with ids_crc32 in place of the ids."""
    return _read(spark, shards, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, shards: list[tuple[str, int, int]], column: str, make, kind: pa.DataType) -> DataFrame:
    starts, total = [], 0
    for path, _, tokens in shards:
        starts.append((path, total))
        total += tokens
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                shard, at = open_shard(path), start
                for k in range(len(shard.keys)):
                    keys, firsts, sizes, made = [], [], [], []
                    for key, value in shard.block(k):
                        ids = shard.ids(value)
                        keys.append(value_of(key)), firsts.append(at), sizes.append(len(ids)), made.append(make(ids))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(made, kind)], ["doc_id", "start", "n_tokens", name])

    return spark.createDataFrame(starts, "path string, start bigint").mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {column}")

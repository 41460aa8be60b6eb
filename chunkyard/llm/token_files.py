"""Token-id shards with a minimal perfect hash index for keyed access.

Shard file: 8-byte magic, the raw ids of all documents in key order, the document keys in the same order, the index, and a
little-endian trailer (version, bytes per id, documents, those without a doc_id, ids, number of hash levels). The index is a cascade of bit arrays: a key
belongs to the first level where its hash meets no other key, and the number of set bits before it, over all levels, is
its slot; slots hold a 32-bit fingerprint, the first id's position and the count. A lookup reads one slot. Keys are
(doc_id, occurrence), so repeated doc_ids keep all their rows.

Shards are ranges of doc_id in ascending order, written by one task each under a name of the attempt and then renamed, so a
repeated or speculative attempt replaces equal content. The manifest has one row a shard with its number, and the shards' first
ids are sums in the order of these numbers. Files go through pyarrow: the shared folder may be of the schemes file, hdfs, viewfs, s3, gs
or abfs, as far as pyarrow was built with them; another scheme fails at once.

Nulls: null text is empty (its end id only); null doc_ids come first, and read back as null; every doc_id is a key, the smallest too.
Rows that repeat a doc_id follow each other by a hash of their texts. A very long text is one document of its shard, which is then as
much longer. An empty table makes no shards and reads back as no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import bounded_batches, work_dir, written
from chunkyard.llm.tokens import encoder

MAGIC = b"CYTOKEN1"
HEAD = struct.Struct("<IIQQQI")
VERSION = 2
#: Set in the occurrences of documents without a doc_id.
NO_ID = np.uint64(1 << 63)
#: Text bytes a shard should hold; decides their number.
SHARD_BYTES = 64 << 20
MANIFEST = "shard int, file string, low bigint, high bigint, docs bigint, ids bigint"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit finalizer, seeded."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64), 1) ^ occurrence.astype(np.uint64), 2)


class PerfectHash:
    """Slot of each of n different hashes, 0 to n-1, in about three bits a key."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.ranks = []  # set bits before each byte
        at = 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(at + np.concatenate([[0], np.cumsum(ones)[:-1]]))
            at += int(ones.sum())

    @classmethod
    def build(cls, hashes: np.ndarray, room: float = 2.0) -> PerfectHash:
        levels, rest, level = [], hashes, 0
        while len(rest):
            size = max(64, int(len(rest) * room))
            at = (mix(rest, 10 + level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest, level = rest[~alone[at]], level + 1
            if level > 200:
                raise ValueError("two documents have one key hash")
        return cls(levels)

    def slots(self, hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, (bits, ranks, size) in enumerate(zip(self.levels, self.ranks, sizes)):
            at = (mix(hashes[todo], 10 + level) % np.uint64(size)).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[todo[hit]] = (ranks[at >> 3] + below)[hit]
            todo = todo[~hit]
        return out


SLOT = np.dtype([("print", "<u4"), ("at", "<u8"), ("n", "<u4")])


def _write_shard(fs: pafs.FileSystem, path: str, rows: Iterator[tuple[int | None, bytes]], width: int, attempt: int) -> tuple[int | None, int | None, int, int]:
    """One shard from (doc_id, little-endian uint32 ids) in order, nulls first; low, high, documents, ids."""
    keys: list[int] = []
    counts: list[int] = []
    nulls = 0
    temp = f"{path}.{attempt}.tmp"
    with fs.open_output_stream(temp, buffer_size=1 << 20) as out:
        out.write(MAGIC)
        for key, ids in rows:
            out.write(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
            nulls += key is None
            keys.append(key or 0)
            counts.append(len(ids) // 4)
        doc, n = np.asarray(keys, np.int64), np.asarray(counts, np.int64)
        start = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
        hashes = key_hash(doc, occurrences(doc, nulls))
        index = PerfectHash.build(hashes)
        sizes, todo = [], len(hashes)
        for bits in index.levels:
            sizes.append(max(64, int(todo * 2.0)))
            todo -= int(np.bitwise_count(bits).sum())
        slots = np.zeros(len(doc), SLOT)
        at = index.slots(hashes, sizes)
        slots["print"][at], slots["at"][at], slots["n"][at] = (mix(hashes, 3) >> np.uint64(32)).astype(np.uint32), start, n
        out.write(doc.astype("<i8").tobytes())
        out.write(slots.tobytes())
        for size, bits in zip(sizes, index.levels):
            out.write(struct.pack("<QQ", size, len(bits)) + bits.tobytes())
        out.write(HEAD.pack(VERSION, width, len(doc), nulls, int(n.sum()), len(sizes)))
    if fs.get_file_info(path).type != pafs.FileType.NotFound:  # an earlier attempt's, with the same content
        fs.delete_file(path)
    fs.move(temp, path)
    ids = doc[nulls:].tolist() or [None]
    return ids[0], ids[-1], len(doc), int(n.sum())


def occurrences(sorted_keys: np.ndarray, nulls: int = 0) -> np.ndarray:
    """0, 1, ... within runs of equal keys; the first `nulls` keys stand for no doc_id and count on their own."""
    n = len(sorted_keys)
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    if 0 < nulls < n:
        first[nulls] = True
    out = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) if n else at.astype(np.uint64)
    out[:nulls] |= NO_ID
    return out


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        version, self.width, self.docs, self.nulls, self.ids, levels = HEAD.unpack(self._at(end - HEAD.size, HEAD.size))
        if self._at(0, 8) != MAGIC or version != VERSION:
            raise ValueError(f"{uri}: not a token shard")
        at = 8 + self.ids * self.width
        self.keys = np.frombuffer(self._at(at, 8 * self.docs), "<i8")
        at += 8 * self.docs
        self.slots = np.frombuffer(self._at(at, SLOT.itemsize * self.docs), SLOT)
        at += SLOT.itemsize * self.docs
        bits, self.sizes = [], []
        for _ in range(levels):
            size, n = struct.unpack("<QQ", self._at(at, 16))
            bits.append(np.frombuffer(self._at(at + 16, n), np.uint8))
            self.sizes.append(size)
            at += 16 + n
        self.index = PerfectHash(bits)

    def _at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset) if n else b""

    def find(self, doc_id: np.ndarray, occurrence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is here (false hits: one in 2**32), the position of its first id, its number of ids."""
        h = key_hash(doc_id, occurrence)
        slot = self.index.slots(h, self.sizes)
        known = slot >= 0
        s = self.slots[np.where(known, slot, 0)] if self.docs else np.zeros(len(h), SLOT)
        known &= s["print"] == (mix(h, 3) >> np.uint64(32)).astype(np.uint32)
        return known, s["at"].astype(np.int64), s["n"].astype(np.int64)

    def read(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self._at(8 + int(at) * self.width, int(n) * self.width), "<u4" if self.width == 4 else "<u2").astype("<u4")

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        no_id = NO_ID if doc_id is None else np.uint64(0)
        known, at, n = self.find(np.asarray([doc_id or 0]), np.asarray([occurrence], np.uint64) | no_id)
        return self.read(at[0], n[0]) if known[0] else None

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, file: str, end_id: int = 2, vocab_size: int = 65_536, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all texts (doc_id, text) as shards in ascending doc_id; returns the manifest: shard, file, low, high (of its doc_ids), docs, ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_dir(spark, "token-files")
    width = 2 if vocab_size <= 65_536 else 4
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes), spark.sparkContext.defaultParallelism if total > 4 << 20 else 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        uri = f"{folder}/shard-{ctx.partitionId():09d}.cyt"
        rows = _encoded(batches, encoder(file), np.asarray([end_id], "<u4").tobytes())
        first = next(rows, None)
        if first is None:
            return
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        low, high, n, ids = _write_shard(fs, path, _chain(first, rows), width, ctx.taskAttemptId())
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        row = [ctx.partitionId(), uri, low, high, n, ids]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["shard", "file", "low", "high", "docs", "ids"])

    keyed = docs.select(F.col("doc_id").alias("_cy_key"), F.coalesce("text", F.lit("")).alias("_cy_text"))  # nulls sort first
    dealt = keyed.repartitionByRange(shards, "_cy_key", F.xxhash64("_cy_text")).sortWithinPartitions("_cy_key", F.xxhash64("_cy_text"))
    return written(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def _chain(first, rest):
    yield first
    yield from rest


def _encoded(batches, enc, end) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1))):
            yield key, ids + end


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files by keyed access, one task a shard: doc_id, start, n_tokens, ids (little-endian uint32)."""
    from pyspark.sql import Window

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("_cy_first", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("file", "_cy_first")
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(uri)
                occ = occurrences(shard.keys, shard.nulls)
                for a in range(0, shard.docs, 2048):
                    keys = shard.keys[a : a + 2048]
                    known, at, count = shard.find(keys, occ[a : a + 2048])
                    if not known.all():
                        raise ValueError(f"{uri}: a key is missing from the index")
                    for b in _steps(count, 2 << 20):
                        ids = [shard.read(x, y).tobytes() for x, y in zip(at[b], count[b])]
                        doc = pa.array(keys[b], mask=np.arange(a, a + len(keys))[b] < shard.nulls)
                        yield pa.RecordBatch.from_arrays([doc, pa.array(at[b] + first), pa.array(count[b]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                shard.close()

    return placed.repartition(n, F.col("file")).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _steps(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows whose counts add up to about `most`."""
    a, total = 0, 0
    for i, n in enumerate(counts.tolist()):
        if total and total + n > most:
            yield slice(a, i)
            a, total = i, 0
        total += n
    if a < len(counts):
        yield slice(a, len(counts))

"""Content-defined chunking with a gear rolling hash.

The hash shifts left by a bit a byte, so its low k bits depend on the last k bytes only; with a minimum length of at
least k a cut candidate is a property of its position, found with numpy over a whole content. Only the choice among the
sparse candidates is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN, AVG, MAX = 4 << 10, 64 << 10, 256 << 10
CHUNKS = "file_key string, seq int, offset bigint, length int, data binary"


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    """256 words of a splitmix64 generator whose state starts one step in."""
    step = 0x9E3779B97F4A7C15
    state, out = step, []
    for _ in range(256):
        state = (state + step) % 2**64
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def mask_bits(avg: int) -> int:
    return max(avg, 1).bit_length() - 1


def candidates(data: np.ndarray, bits: int, gear: np.ndarray) -> np.ndarray:
    """Positions i where the hash of the bytes up to i has `bits` low zero bits; positions before the first full window never count."""
    n = len(data)
    if n < bits or not bits:
        return np.arange(n) if not bits else np.zeros(0, np.int64)
    kind = np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
    # sums[w][i] is the hash of the w bytes from i on; a longer window is two shorter ones, the first shifted past the second.
    width, part = 1, gear.astype(kind)[data]
    window, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if bits & width:
                window = part if window is None else (part[: n - done - width + 1] << kind(done)) + window[width:] if done else part
                done += width
            if width * 2 > bits:
                break
            part = (part[:-width] << kind(width)) + part[width:]
            width *= 2
    return np.flatnonzero(window & kind(2**bits - 1) == 0) + bits - 1


def cut_points(content: bytes, low: int = MIN, avg: int = AVG, high: int = MAX) -> list[int]:
    """Ends of the chunks of a content."""
    bits = mask_bits(avg)
    if not 0 < low <= high:
        raise ValueError("lengths must be 0 < min <= max")
    gear, n = gear_table(), len(content)
    if low < bits:
        return _scalar_cuts(content, low, bits, high, gear)
    found = candidates(np.frombuffer(content, np.uint8), bits, gear) + 1
    ends, start = [], 0
    while start < n:
        k = int(np.searchsorted(found, start + low))
        end = min(int(found[k]) if k < len(found) else n, start + high, n)
        ends.append(end)
        start = end
    return ends


def _scalar_cuts(content: bytes, low: int, bits: int, high: int, gear: np.ndarray) -> list[int]:
    """Byte by byte, where the minimum is shorter than the window."""
    table, mask, h, size, ends = gear.tolist(), 2**bits - 1, 0, 0, []
    for i, b in enumerate(content):
        h = (h * 2 + table[b]) % 2**64
        size += 1
        if (size >= low and h & mask == 0) or size >= high:
            ends.append(i + 1)
            h = size = 0
    if size:
        ends.append(len(content))
    return ends


def chunk_files(files: DataFrame, low: int = MIN, avg: int = AVG, high: int = MAX) -> DataFrame:
    """file_key, seq, offset, length, data of every chunk of (file_key, content). An empty or null content has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                for seq, end in enumerate(cut_points(content or b"", low, avg, high)):
                    out.append((key, seq, start, end - start, content[start:end]))
                    start = end
                held += start
                if held > 16 << 20:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    return files.select("file_key", "content").mapInArrow(rows, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file_key", "seq", "offset", "length", "data"])


def hashed(chunks: DataFrame) -> DataFrame:
    """Chunks with their SHA-256 in place of their data."""
    return chunks.withColumn("hash", F.sha2("data", 256)).drop("data")


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """Slices of `size` bytes, by built-in functions."""
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    at = files.select("file_key", "content", F.posexplode(starts).alias("seq", "at"))
    data = F.substring(F.col("content"), F.col("at") + 1, F.lit(size))
    return at.select("file_key", "seq", F.col("at").cast("bigint").alias("offset"), F.octet_length(data).alias("length"), data.alias("data"))


def with_offsets(chunks: DataFrame, key: str = "file_key", order: str = "seq", length: str = "length") -> DataFrame:
    """Offsets as sums of the lengths before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def shared_chunks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different chunk hashes that both sides hold."""
    return a.select("hash").distinct().join(b.select("hash"), "hash", "left_semi")


def to_bytes(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")

"""Chunk-stream objects: headers and payloads in a row, with or without a footer."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.functions.codecs import CodecError, decode_payload, encode_payload
from chunkyard.functions.hashes import leaf_hashes, merkle_roots

# Fixed values of the format.
IDENT, HASH_IDENT, BOUNDARY_IDENT = b"XETBLOB", b"XBLBHSH", b"XBLBBND"
FOOTER_VERSION, HASH_VERSION, BOUNDARY_VERSION, NONCE = 1, 0, 1, 16
HEADER = 8
MOST = (1 << 24) - 1
SCHEMES = (0, 1, 2)
MOST_OBJECT_BYTES = 128 << 20
#: Bytes of objects that are hashed or built together.
TOGETHER = 8 << 20


class FormatError(ValueError):
    pass


def read_u24(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 3], "little")


def chunk_header(compressed: int, scheme: int, uncompressed: int) -> bytes:
    if max(compressed, uncompressed) > MOST:
        raise FormatError("a length passes 24 bits")
    return bytes([0]) + compressed.to_bytes(3, "little") + bytes([scheme]) + uncompressed.to_bytes(3, "little")


def parse_chunk_header(data: bytes, at: int = 0) -> tuple[int, int, int, int]:
    """version, compressed length, scheme, uncompressed length."""
    if at + HEADER > len(data):
        raise FormatError("a chunk header is cut off")
    version, compressed, scheme, size = data[at], read_u24(data, at + 1), data[at + 4], read_u24(data, at + 5)
    if version != 0:
        raise FormatError(f"an unknown chunk version {version}")
    if scheme not in SCHEMES:
        raise FormatError(f"an unknown scheme {scheme}")
    return version, compressed, scheme, size


def scan(data: bytes) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(index, compressed length, scheme, uncompressed length, header offset, data offset) up to the footer or the end.
    A payload that passes the end is found when it is read, not here."""
    at, i = 0, 0
    while at < len(data):
        if data.startswith(IDENT, at):
            return
        if len(data) - at < len(IDENT):
            raise FormatError("bytes are left after the last chunk")
        _, compressed, scheme, size = parse_chunk_header(data, at)
        yield i, compressed, scheme, size, at, at + HEADER
        at, i = at + HEADER + compressed, i + 1


@dataclass
class Footer:
    object_hash: bytes
    chunk_hashes: list[bytes] = field(default_factory=list)
    boundaries: list[int] = field(default_factory=list)
    unpacked: list[int] = field(default_factory=list)


def _decoded(data: bytes) -> tuple[list[bytes], list[int]]:
    """Contents of the chunks and their physical ends."""
    contents, ends = [], []
    for _, compressed, scheme, size, _, at in scan(data):
        if at + compressed > len(data):
            raise FormatError("a payload is cut off")
        try:
            contents.append(decode_payload(data[at : at + compressed], scheme, size))
        except CodecError as e:
            raise FormatError(str(e)) from e
        ends.append(at + compressed)
    if not contents:
        raise FormatError("no chunks")
    return contents, ends


def _footers(many: list[tuple[list[bytes], list[int]]]) -> list[Footer]:
    """Footers of objects by their contents and physical ends, hashed all together."""
    hashes = iter(leaf_hashes([c for contents, _ in many for c in contents]))
    own = [[next(hashes) for _ in contents] for contents, _ in many]
    roots = merkle_roots([[(h, len(c)) for h, c in zip(hs, contents)] for hs, (contents, _) in zip(own, many)])
    return [Footer(root, hs, ends, list(accumulate(map(len, contents)))) for root, hs, (contents, ends) in zip(roots, own, many)]


def derive_footers(many: list[bytes]) -> list[Footer | FormatError]:
    """Decodes and hashes every chunk of every object; boundaries are physical ends, unpacked are running content lengths."""
    out: list = []
    for data in many:
        try:
            out.append(_decoded(data))
        except FormatError as e:
            out.append(e)
    made = iter(_footers([x for x in out if not isinstance(x, FormatError)]))
    return [x if isinstance(x, FormatError) else next(made) for x in out]


def derive_footer(data: bytes) -> Footer:
    """The same for one object; a malformed one fails."""
    (out,) = derive_footers([data])
    if isinstance(out, FormatError):
        raise out
    return out


def footer_bytes(f: Footer) -> bytes:
    n = len(f.chunk_hashes)
    if len(f.boundaries) != n or len(f.unpacked) != n:
        raise FormatError("section lengths differ")
    hashes = HASH_IDENT + bytes([HASH_VERSION]) + struct.pack("<I", n) + b"".join(f.chunk_hashes)
    bounds = BOUNDARY_IDENT + bytes([BOUNDARY_VERSION]) + struct.pack(f"<I{2 * n}I", n, *f.boundaries, *f.unpacked)
    tail = 4 + 4 + 4 + NONCE
    return IDENT + bytes([FOOTER_VERSION]) + f.object_hash + hashes + bounds + struct.pack("<III", n, len(hashes) + len(bounds) + tail, len(bounds) + tail) + bytes(NONCE)


def parse_footer(data: bytes, at: int = 0) -> Footer:
    """The footer that starts at `at`; the three counts must agree and the bytes must be there before they are read."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise FormatError("the footer is cut off")
        at += n
        return data[at - n : at]

    def section(ident: bytes, version: int) -> int:
        if take(7) != ident:
            raise FormatError(f"expected {ident!r}")
        if take(1)[0] != version:
            raise FormatError(f"an unknown version of {ident!r}")
        return struct.unpack("<I", take(4))[0]

    if take(7) != IDENT or take(1)[0] != FOOTER_VERSION:
        raise FormatError("not a footer")
    own = take(32)
    n = section(HASH_IDENT, HASH_VERSION)
    raw = take(32 * n)
    m = section(BOUNDARY_IDENT, BOUNDARY_VERSION)
    if m != n:
        raise FormatError("chunk counts differ")
    numbers = struct.unpack(f"<{2 * n}I", take(8 * n))
    if struct.unpack("<I", take(4))[0] != n:
        raise FormatError("chunk counts differ")
    take(8 + NONCE)
    return Footer(own, [raw[32 * i : 32 * i + 32] for i in range(n)], list(numbers[:n]), list(numbers[n:]))


def build_many(many: list[list[bytes]], scheme: int = 0, with_footer: bool = False) -> list[bytes]:
    """A chunk stream of each list of contents."""
    bodies, ends = [], []
    for contents in many:
        out, at = bytearray(), []
        for c in contents:
            payload = encode_payload(c, scheme)
            out += chunk_header(len(payload), scheme, len(c)) + payload
            at.append(len(out))
        bodies.append(bytes(out))
        ends.append(at)
    if not with_footer:
        return bodies
    made = iter(_footers([(contents, at) for contents, at in zip(many, ends) if contents]))
    return [body + footer_bytes(next(made)) if contents else body for body, contents in zip(bodies, many)]


def build(contents: list[bytes], scheme: int = 0, with_footer: bool = False) -> bytes:
    """A chunk stream of the contents."""
    return build_many([contents], scheme, with_footer)[0]


SCANNED = "object_key string, chunk_index int, scheme int, compressed_length int, uncompressed_length int, header_offset bigint, data_offset bigint, error string"
FOOTERS = "object_key string, object_hash binary, chunk_hashes array<binary>, boundaries array<bigint>, unpacked array<bigint>, error string"


def scan_objects(objects: DataFrame) -> DataFrame:
    """One row a chunk of (object_key, body); a malformed object gives the rows before the fault and one with the error."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, body in zip(frame["object_key"], frame["body"]):
                try:
                    for i, compressed, scheme, size, head, at in scan(bytes(body or b"")):
                        out.append((key, i, scheme, compressed, size, head, at, None))
                except FormatError as e:
                    out.append((key, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCANNED.split(", ")]).astype(object)

    return objects.select("object_key", "body").mapInPandas(rows, SCANNED)


def _together(keys: list, bodies: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Slices of a batch of about TOGETHER bytes."""
    start, held, out = 0, 0, []
    for k, body in enumerate(bodies):
        out.append(body.as_py() or b"")
        held += len(out[-1])
        if held > TOGETHER or k == len(keys) - 1:
            yield keys[start : k + 1], out
            start, held, out = k + 1, 0, []


def object_footers(objects: DataFrame, with_body: bool = False) -> DataFrame:
    """Derived footers of (object_key, body), with an error instead where an object is malformed; the bodies too if asked for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, bodies in _together(batch.column(0).to_pylist(), batch.column(1)):
                found = derive_footers(bodies)
                each = [(None, None, None, None, str(f)) if isinstance(f, FormatError) else (f.object_hash, f.chunk_hashes, f.boundaries, f.unpacked, None) for f in found]
                cols = [keys, *map(list, zip(*each)), *([bodies] if with_body else [])]
                kinds = [pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[: len(cols)])

    schema = FOOTERS + (", body binary" if with_body else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return objects.select("object_key", "body").mapInArrow(rows, schema)


def stored_footers(objects: DataFrame) -> DataFrame:
    """Footers that objects (object_key, body) end with, as they say; none is an error of its row, as is a malformed one."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, body in zip(frame["object_key"], frame["body"]):
                try:
                    data, end = bytes(body or b""), 0
                    for _, compressed, _, _, _, at in scan(data):
                        end = at + compressed
                    f = parse_footer(data, end)
                    out.append((key, f.object_hash, f.chunk_hashes, f.boundaries, f.unpacked, None))
                except FormatError as e:
                    out.append((key, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["object_key", "object_hash", "chunk_hashes", "boundaries", "unpacked", "error"])

    return objects.select("object_key", "body").mapInPandas(rows, FOOTERS)


def build_objects(chunks: DataFrame, scheme: int = 0, with_footer: bool = False) -> DataFrame:
    """(object_key, body) of chunks (object_key, seq, data), one object a key; an object is bounded by its format."""

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, list[bytes]]]:
        key, contents = None, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if contents and k != key:
                    yield key, contents
                    contents = []
                key = k
                contents.append(data.as_py() or b"")
        if contents:
            yield key, contents

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, many, held = [], [], 0
        for key, contents in objects(batches):
            keys.append(key)
            many.append(contents)
            held += sum(map(len, contents))
            if held > TOGETHER:
                yield made(keys, many)
                keys, many, held = [], [], 0
        if keys:
            yield made(keys, many)

    def made(keys: list, many: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(build_many(many, scheme, with_footer), pa.binary())], ["object_key", "body"])

    ordered = chunks.select("object_key", "seq", "data").repartition("object_key").sortWithinPartitions("object_key", "seq")
    return ordered.select("object_key", "data").mapInArrow(rows, "object_key string, body binary")


def cumulative_offsets(chunks: DataFrame) -> DataFrame:
    """Running physical ends and content lengths of scanned chunks."""
    w = Window.partitionBy("object_key").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumns({"boundary": F.sum(F.col("compressed_length") + HEADER).over(w), "unpacked": F.sum("uncompressed_length").over(w)})

"""Hash text forms, truncated keys, file ids, leaf hashes and Merkle roots."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkyard.functions.blake import keyed_many

# The keys of leaf hashes and of interior nodes, and the mean fan-out of the tree.
DATA_KEY = bytes(
    (102, 151, 245, 119, 91, 149, 80, 222, 49, 53, 203, 172, 165, 151, 24, 28, 157, 228, 33, 16, 155, 235, 43, 88, 180, 208, 176, 75, 147, 173, 242, 41)
)
NODE_KEY = bytes((1, 126, 197, 199, 165, 71, 41, 150, 253, 148, 102, 102, 180, 138, 2, 230, 93, 221, 83, 111, 55, 199, 109, 210, 248, 99, 82, 230, 74, 83, 113, 63))
FAN_OUT = 4
ZERO = bytes(32)


def swap_words(h: bytes) -> bytes:
    """Each 8-byte group reversed: between raw order and text order."""
    return b"".join(h[i : i + 8][::-1] for i in range(0, 32, 8))


def to_hex(h: bytes) -> str:
    return swap_words(h).hex()


def from_hex(text: str) -> bytes:
    if len(text) != 64:
        raise ValueError(f"a hash has 64 hex digits, not {len(text)}")
    return swap_words(bytes.fromhex(text))


def _swapped_hex(hex_text: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(hex_text, 2 * (8 * F.floor(i / 8).cast("int") + 7 - i % 8) + 1, F.lit(2))), "")


def hash_hex(h: Column) -> Column:
    """64 hex digits of a 32-byte hash column; null otherwise."""
    return F.when(F.octet_length(h) == 32, F.lower(_swapped_hex(F.hex(h))))


def hash_from_hex(text: Column) -> Column:
    """The 32 bytes of 64 hex digits; null where the text isn't that."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(_swapped_hex(text)))


def truncated_key(h: Column) -> Column:
    """The first word as 8 big-endian bytes: binary order is unsigned order."""
    return F.when(F.octet_length(h) == 32, F.unhex(F.substring(_swapped_hex(F.hex(h)), 1, 16)))


def mod64(h: Column, m: int) -> Column:
    """The last word modulo m."""
    return F.conv(F.substring(_swapped_hex(F.hex(h)), 49, 16), 16, 10).cast("decimal(20,0)") % F.lit(m).cast("decimal(20,0)")


def is_zero(h: Column) -> Column:
    return h == F.lit(ZERO)


def null_if_zero(h: Column) -> Column:
    return F.when(~is_zero(h), h)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(sha_hex: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the hex text of a content's SHA-256."""
    return F.substring(F.sha2(sha_hex.cast("binary"), 256), 1, 32)


def leaf_hashes(contents: list[bytes]) -> list[bytes]:
    return keyed_many(contents, DATA_KEY)


def salted(h: bytes, salt: bytes) -> bytes:
    return keyed_many([h], salt)[0]


@F.pandas_udf(T.BinaryType())
def leaf_hash(content: pd.Series) -> pd.Series:
    """Leaf hash of each content, a batch at a time; null stays null."""
    known = content.notna()
    out = pd.Series([None] * len(content), index=content.index, dtype=object)
    out[known] = leaf_hashes([bytes(x) for x in content[known]])
    return out


def group_ends(last_words: np.ndarray) -> list[int]:
    """Where the groups of a level end: past an entry whose last word the fan-out divides, at the earliest with the third, at the latest with the ninth entry of a group."""
    n = len(last_words)
    natural = np.flatnonzero(last_words % np.uint64(FAN_OUT) == 0) + 1
    ends = [0]
    while ends[-1] < n:
        k = int(np.searchsorted(natural, ends[-1] + 3))
        ends.append(min(int(natural[k]) if k < len(natural) else n, ends[-1] + 2 * FAN_OUT + 1, n))
    return ends[1:]


def merkle_roots(many: list[list[tuple[bytes, int]]]) -> list[bytes]:
    """The root over each list of ordered (hash, size) entries, level by level for all: none is all zeros, one is itself."""
    levels = [list(x) for x in many]
    while open_ := [i for i, level in enumerate(levels) if len(level) > 1]:
        texts, sizes, counts = [], [], []
        for i in open_:
            level = levels[i]
            ends = group_ends(np.frombuffer(b"".join([h[24:32] for h, _ in level]), "<u8"))
            for a, b in zip([0, *ends], ends):
                texts.append("".join([f"{to_hex(h)} : {n}\n" for h, n in level[a:b]]).encode())
                sizes.append(sum(n for _, n in level[a:b]))
            counts.append(len(ends))
        made = iter(zip(keyed_many(texts, NODE_KEY), sizes))
        for i, n in zip(open_, counts):
            levels[i] = [next(made) for _ in range(n)]
    return [level[0][0] if level else ZERO for level in levels]


def merkle_root(entries: list[tuple[bytes, int]]) -> bytes:
    """The root over ordered (hash, size) entries."""
    return merkle_roots([entries])[0]


def file_hash(entries: list[tuple[bytes, int]], salt: bytes = ZERO) -> bytes:
    """The salted root; zeros for an empty file."""
    return salted(merkle_root(entries), salt) if entries else ZERO


def _entries(value) -> list[tuple[bytes, int]]:
    return [(bytes(x["hash"]), int(x["size"])) for x in (value if value is not None else [])]


@F.pandas_udf(T.BinaryType())
def merkle_root_of(entries: pd.Series) -> pd.Series:
    """Root of an array of (hash binary, size bigint) in order."""
    return pd.Series([merkle_root(_entries(x)) for x in entries])


@F.pandas_udf(T.BinaryType())
def file_hash_of(entries: pd.Series) -> pd.Series:
    return pd.Series([file_hash(_entries(x)) for x in entries])

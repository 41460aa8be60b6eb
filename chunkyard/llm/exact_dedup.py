"""Exact dedup with Patricia tries.

Texts go to partitions by byte length and content hash. Before that, each task collapses its own copies in small tries, so
a text that a third of all rows share reaches its partition once a batch and task, not once a row. In a partition, the
byte strings of each (length, hash prefix) cell enter a compressed radix trie; the node where a string ends holds its
smallest and largest identifiers and its number of rows. A trie beyond its memory bound writes whole subtrees to files in the
shared folder and reads them back one at a time, each under the same bound; the files are deleted after use, and those of a lost
executor stay behind without effect, as every attempt writes below a name of its own. Every row then finds its owner by length and SHA-256; should
different texts ever share both, their tries show it and the job fails.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Null identifiers count in group sizes and
never own a group unless all are null. Rows that repeat an identifier within a group are tied: all are `kept` if it owns, and
drop_copies leaves one of them. Whole texts are compared, however long. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import pickle
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import bounded_batches, in_batches, keep_rows, lower_ascii, record_batch, runs, work_dir

#: Bytes of keys that one trie holds before it spills subtrees.
TRIE_BYTES = 64 << 20
LOCAL = "_cy_len bigint, _cy_cell string, _cy_sha string, _cy_text string, low bigint, high bigint, n bigint"
OWNERS = "_cy_len bigint, _cy_sha string, low bigint, high bigint, n bigint"
Leaf = tuple  # (smallest id, largest id, rows, hash)


def join_leaves(a: Leaf | None, b: Leaf) -> Leaf:
    if a is None:
        return b
    low = [x for x in (a[0], b[0]) if x is not None]
    high = [x for x in (a[1], b[1]) if x is not None]
    return (min(low, default=None), max(high, default=None), a[2] + b[2], a[3])


class PatriciaTrie:
    """Byte strings to leaves. A node is [edge label, children by first byte, leaf].

    Beyond `most` bytes the trie empties itself into files below the folder `spill_to` (any that pyarrow can write), a file for each
    subtree that leaves the prefix which its strings share at the first spill. Reading back, each subtree is a trie of the same
    bound, which spills in turn: no more than `most` bytes and the string at hand are ever held.
    """

    def __init__(self, most: int = TRIE_BYTES, spill_to: str | None = None):
        self.root: list = [b"", {}, None]
        self.most, self.held, self.peak = most, 0, 0
        self.spill_to, self.folder = spill_to, None
        self.prefix, self.files = b"", {}  # what all strings shared at the first spill; files of each subtree

    def insert(self, key: bytes, leaf: Leaf) -> None:
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                node[2] = join_leaves(node[2], leaf)
                break
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, leaf]
                self.held += n - at + 200
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = self._shared(label, key, at)
            split = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            node[1][key[at]] = split
            self.held += 200
            node, at = split, at + k
        self.peak = max(self.peak, self.held)
        if self.held > self.most and self.spill_to:
            self.spill()

    @staticmethod
    def _shared(label: bytes, key: bytes, at: int) -> int:
        """Length of the common prefix of label and key[at:]."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(label[:mid], at):
                low = mid
            else:
                high = mid - 1
        return low

    @staticmethod
    def walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, Leaf]]:
        stack = [(node, prefix)]
        while stack:
            at, before = stack.pop()
            key = before + at[0]
            if at[2] is not None:
                yield key, at[2]
            stack.extend((c, key) for c in at[1].values())

    def spill(self) -> None:
        """All strings go to files: one for each place where they leave the prefix, and byte with which they do."""
        if self.folder is None:
            self.fs, path = pafs.FileSystem.from_uri(self.spill_to)
            self.folder = f"{path}/{uuid.uuid4().hex}"
            self.fs.create_dir(self.folder, recursive=True)
            node = self.root
            while node[2] is None and len(node[1]) == 1:
                (node,) = node[1].values()
                self.prefix += node[0]
        out: dict[tuple[int, int], BinaryIO] = {}
        for key, leaf in self.walk(self.root, b""):
            k = self._shared(self.prefix, key, 0)
            part = (k, key[k] if k < len(key) else -1)
            if part not in out:
                name = f"{self.folder}/{part[0]}-{part[1]}-{len(self.files.setdefault(part, []))}"
                self.files[part].append(name)
                out[part] = self.fs.open_output_stream(name)
            data = pickle.dumps((key[k + 1 :], leaf))
            out[part].write(struct.pack("<I", len(data)) + data)
        for f in out.values():
            f.close()
        self.root, self.held = [b"", {}, None], 0

    def _read(self, name: str) -> Iterator[tuple[bytes, Leaf]]:
        with self.fs.open_input_stream(name) as f:
            while head := f.read(4):
                yield pickle.loads(f.read(struct.unpack("<I", head)[0]))

    def items(self) -> Iterator[tuple[bytes, Leaf]]:
        """All strings once. Spilled subtrees are read back one after another."""
        if self.folder is None:
            yield from self.walk(self.root, b"")
            return
        self.spill()
        for (k, first), names in sorted(self.files.items()):
            start = self.prefix[:k] + (bytes([first]) if first >= 0 else b"")
            part = PatriciaTrie(self.most, self.spill_to)
            for name in names:
                for key, leaf in self._read(name):
                    part.insert(key, leaf)
                self.fs.delete_file(name)
            for key, leaf in part.items():
                yield start + key, leaf
            self.peak = max(self.peak, part.peak)
        self.fs.delete_dir(self.folder)
        self.folder, self.prefix, self.files = None, b"", {}


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct texts of a few thousand rows at a time, in a trie each."""
    for batch in batches:
        trie = PatriciaTrie()
        for size, sha, text, doc in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3)))):
            trie.insert(text, (doc, doc, 1, sha))
        yield record_batch(LOCAL, [(len(t), sha[:4], sha, t.decode(), low, high, n) for t, (low, high, n, sha) in trie.items()])


def _owners(batches: Iterator[pa.RecordBatch], spill_to: str, most: int) -> Iterator[tuple]:
    """One row for each distinct text of the partition, a trie for each (length, hash prefix) cell."""

    def ends(trie: PatriciaTrie, size: int) -> Iterator[tuple]:
        seen = set()
        for _, (low, high, n, sha) in trie.items():
            if sha in seen:
                raise ValueError(f"different texts have the SHA-256 {sha}")
            seen.add(sha)
            yield int(size), sha, low, high, n

    trie, last = PatriciaTrie(most, spill_to), None
    for cell, part in runs(batches, 2):
        if cell != last and last is not None:
            yield from ends(trie, last[0])
            trie = PatriciaTrie(most, spill_to)
        last = cell
        for sha, text, low, high, n in zip(part.column(2).to_pylist(), part.column(3).cast(pa.binary()).to_pylist(), *(part.column(i).to_pylist() for i in (4, 5, 6))):
            trie.insert(text, (low, high, n, sha))
    if last is not None:
        yield from ends(trie, last[0])


def exact_groups(docs: DataFrame, keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row a document: doc_id, keep_id (smallest or largest of its group), group_size, kept, text_sha256."""
    bounded_batches(docs.sparkSession)
    text = lower_ascii(F.col("text"))
    keyed = docs.select(F.octet_length(text).cast("bigint").alias("_cy_len"), F.sha2(text, 256).alias("_cy_sha"), text.alias("_cy_text"), F.col("doc_id"))
    cells = keyed.mapInArrow(_collapse, LOCAL).repartition("_cy_len", "_cy_cell").sortWithinPartitions("_cy_len", "_cy_cell")
    spill_to = work_dir(docs.sparkSession, "trie")
    owners = cells.mapInArrow(lambda batches: in_batches(OWNERS, _owners(batches, spill_to, trie_bytes)), OWNERS)
    own = owners.select("_cy_len", "_cy_sha", F.col("low" if keep == "smallest" else "high").alias("keep_id"), F.col("n").alias("group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return keyed.select("_cy_len", "_cy_sha", "doc_id").join(own, ["_cy_len", "_cy_sha"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("_cy_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row of each group, with all its columns: that of its owner, and of several such rows the smallest."""
    groups = exact_groups(docs, keep).groupBy("doc_id", F.col("text_sha256").alias("key"))
    return keep_rows(docs, groups.agg(F.max("kept").alias("kept"), F.count("*").alias("n")), F.sha2(lower_ascii(F.col("text")), 256))

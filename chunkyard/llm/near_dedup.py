"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

Two permutations of [0, 2**20) make all signature coordinates: a shingle is placed by the first, and coordinate k is the
smallest value of the second, shifted circularly by k, over a document's places. Documents with equal shingle sets are one
node from then on. Every pair of nodes that shares a band is a candidate, at every size of bucket and table, and counts as a
link only by the exact Jaccard similarity of the full sets:

* Stars first. In every bucket the smallest node is compared with all others; members stream past its set, in groups of
  at most STAR rows. What these links connect is one cluster from then on, so a group of near copies costs a
  comparison or two for each of its members.
* Then the pairs that are left: those in a bucket, without its star's centre, that lie in different clusters. Buckets are
  compared by the connected groups that they form, or one by one where such a group is very large; this changes the plan
  only, as a pair counts only if it shares a band. A task holds two blocks of sets and returns a spanning forest of the
  links that it confirmed, never pairs; blocks of the same cluster never meet.

A pair at the threshold 0.75 misses all 32 bands of 4 with probability (1 - 0.75**4)**32, below 6e-6.

Words are what ASCII white space separates, after lower-casing A-Z. A set holds the distinct runs of five words, each as
64 bits; texts with fewer words have their whole sequence as one element; empty and null texts have none and link with
nothing. Rows with a null doc_id take the component of their set, which is null if all its ids are, and count as `kept`. Rows that repeat a
doc_id are told apart by their texts. Whole texts count, however long. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chunkyard.llm.common import BROADCAST_ROWS, bounded_batches, byte_values, giving_back, in_batches, keep_rows, runs, sorted_groups, written
from chunkyard.llm.components import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
UNIVERSE = 1 << 20
#: Sets, and shingles, that a block should hold at most; two blocks meet in a comparing task. Smaller groups are cut into up to PARTS blocks of PART sets.
BLOCK, BLOCK_SHINGLES = 1000, 1_000_000
PART, PARTS = 128, 16
#: Members that stream past a copy of their centre's set.
STAR = 128
#: Blocks of a group of buckets beyond which its buckets are compared one by one; the pairs are the same.
MOST_BLOCKS = 20
SETS = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, text_key string"
LINKS = "u binary, v binary"


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of one text as unsigned 64-bit values."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    span = min(words, len(h))
    with np.errstate(over="ignore"):
        s = np.full(len(h) - span + 1, span * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
        for j in range(span):
            s = (s ^ h[j : len(h) - span + 1 + j]) * np.uint64(0xBF58476D1CE4E5B9)
            s ^= s >> np.uint64(29)
    return np.unique(s)


@lru_cache(maxsize=2)
def permutations(seed: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and the shifted one as a table whose row p holds its values at p, p + 1, ... around the circle."""
    rng = np.random.Generator(np.random.PCG64(seed))
    place = rng.permutation(UNIVERSE).astype(np.uint32)
    circle = rng.permutation(UNIVERSE).astype(np.uint32)
    around = np.concatenate([circle, circle[:coordinates]])
    return place, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(s: np.ndarray, coordinates: int = BANDS * ROWS, seed: int = 7) -> np.ndarray:
    place, table = permutations(seed, coordinates)
    at = place[(s & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(coordinates, UNIVERSE, np.uint32)
    for a in range(0, len(at), 8192):
        np.minimum(out, table[at[a : a + 8192]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    with np.errstate(over="ignore"):
        rows = sig.reshape(bands, -1).astype(np.uint64)
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows.shape[1]):
            key = (key ^ rows[:, j]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def set_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in giving_back(batches):
        n, keys, bands, texts = [], [], [], []
        for text in byte_values(batch.column(1)):
            s = shingles(text)
            n.append(len(s))
            keys.append(set_key(s))
            bands.append(band_keys(signature(s)) if len(s) else None)
            texts.append(hashlib.md5(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(texts)], ["doc_id", "n_shingles", "set_key", "bands", "text_key"]
        )


def node_of(doc_id: Column, key: Column) -> Column:
    """A node: nulls last, then the smallest doc_id of its rows as unsigned big-endian bytes, then its set where ids need it. The smallest node of a component holds its smallest doc_id."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    return F.concat(F.when(doc_id.isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), number, key)


def doc_id_of(node: Column) -> Column:
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.substring(node, 1, 1) == F.lit(b"\x00"), number)


def forest(clusters: list, sets: list[np.ndarray], bands: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) that connect what links of percent/100 or more connect among these sets, beyond their clusters; only between rows of `bands` that meet, where given."""
    n = len(sets)
    sizes = np.asarray([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    names: dict = {}
    root = np.asarray([names.setdefault(c, len(names)) for c in clusters])  # cluster of each set, relabelled on union
    links, parts = [], len(names)
    for i in np.argsort(-sizes, kind="stable").tolist():
        if parts == 1:
            break
        mine = code[at[i] : at[i + 1]]
        a, b = begin[mine], begin[mine + 1]
        length = b - a
        common = length > 1
        a, length = a[common], length[common]
        if not len(a):
            continue
        flat = np.repeat(a - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        both = np.bincount(posting[flat], minlength=n)
        near = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[i] + sizes - both)) & (root != root[i]))
        for j in near.tolist():
            if root[j] != root[i] and (bands is None or (bands[i] == bands[j]).any()):
                links.append((i, j))
                root[root == root[j]] = root[i]
                parts -= 1
    return links


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """Rows (group, low, high, node, cluster, bands or null, shingles), sorted: the links of each pair of blocks."""
    for _, parts in sorted_groups(giving_back(batches), 3):
        nodes, clusters, bands, sets = ([x for p in parts for x in p.column(i).to_pylist()] for i in (3, 4, 5, 6))
        once = list({x: i for i, x in enumerate(nodes)}.values())
        shared = np.asarray([bands[i] for i in once]) if bands[once[0]] is not None else None
        for i, j in forest([clusters[i] for i in once], [np.frombuffer(sets[i], np.uint64) for i in once], shared):
            yield nodes[once[i]], nodes[once[j]]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """Rows (center, salt, is_member, node, shingles), sorted: links of members with their centre."""
    of, center = None, np.zeros(0, np.uint64)
    for key, part in runs(giving_back(batches), 3):
        if not key[2]:
            of, center = key[:2], np.frombuffer(part.column(4)[0].as_py(), np.uint64)
        elif key[:2] == of:
            for node, raw in zip(part.column(3).to_pylist(), part.column(4).to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                both = int((center[np.minimum(np.searchsorted(center, s), len(center) - 1)] == s).sum())
                if 100 * both >= PERCENT * (len(s) + len(center) - both):
                    yield node, key[0]


def _signed_rows(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(_signed, SETS), "signatures")


def _with_nodes(docs: DataFrame, signed: DataFrame, block: int, most_blocks: int) -> DataFrame:
    """signed with `component`, the smallest node that links reach; null without words."""
    grouped = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("low"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    sets = written(grouped, "sets")
    twice = written(sets.groupBy("low").count().filter("count > 1").select(F.col("low").alias("_cy_low"), F.lit(True).alias("_cy_twice")), "repeated-ids")
    told = sets.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, F.col("low").eqNullSafe(F.col("_cy_low")), "left")
    reps = told.select("set_key", node_of(F.col("low"), F.when(F.col("_cy_twice"), F.col("set_key")).otherwise(F.lit(b""))).alias("node"), "low", "bands", "n")
    clusters, links = _links(docs, reps, block, most_blocks)
    own = reps.select("set_key", "node").join(clusters.select("node", F.col("component").alias("cluster")), "node", "left").select(F.col("set_key").alias("_cy_key"), F.coalesce("cluster", "node").alias("cluster"))
    if links is None:
        of_set = own.withColumnRenamed("cluster", "component")
    else:
        ends = links.join(clusters.select(F.col("node").alias("u"), F.col("component").alias("a")), "u", "left").join(clusters.select(F.col("node").alias("v"), F.col("component").alias("b")), "v", "left")
        found = components(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
        of_set = own.join(found, F.col("cluster") == F.col("node"), "left").select("_cy_key", F.coalesce("component", "cluster").alias("component"))
    worded = signed.filter("set_key is not null").join(of_set, F.col("set_key") == F.col("_cy_key")).drop("_cy_key", "bands")
    return worded.unionByName(signed.filter("set_key is null").drop("bands").withColumn("component", F.lit(None).cast("binary")))


def near_groups(docs: DataFrame, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    rows = _with_nodes(docs, _signed_rows(docs), block, most_blocks)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(doc_id_of(F.col("component")))
    out = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """set_key, shingles of nodes (low, set_key): made again from the texts of the rows with those ids, a set once or a few times."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in giving_back(batches):
            texts = byte_values(batch.column(0))
            for a in range(0, len(texts), 256):
                some = {set_key(s): s.tobytes() for s in map(shingles, texts[a : a + 256]) if len(s)}
                new = {k: s for k, s in some.items() if k not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["set_key", "shingles"])

    ids = nodes.select(F.col("low").alias("_cy_id")).distinct()
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = docs.select("doc_id", "text").join(few, F.col("doc_id").eqNullSafe(F.col("_cy_id")), "left_semi").select("text")
    return texts.mapInArrow(made, "set_key binary, shingles binary")


def _links(docs: DataFrame, reps: DataFrame, block: int, most_blocks: int) -> tuple[DataFrame, DataFrame | None]:
    """Clusters (node, component) of the stars, and confirmed links between nodes of different clusters: together they connect all that links of pairs with a common band connect."""
    every = reps.select("node", "n", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("center")).filter("members > 1")
    banded = written(every.join(shared, "bucket").select("bucket", "node", "n", "center"), "buckets")
    keys = reps.select("node", "low", "set_key")
    pairs = banded.filter("node <> center").select("node", "center").distinct()
    salts = pairs.groupBy("center").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"))
    salted = written(pairs.join(salts, "center").select("center", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node"), "stars")
    centers = salted.select("center", "salt").distinct().select("center", "salt", F.lit(0).alias("is_member"), F.col("center").alias("node"))
    asked = written(centers.unionByName(salted.withColumn("is_member", F.lit(1))).join(keys, "node"), "star-rows")
    held = _sets(docs, asked.select("low", "set_key"))
    rows = asked.drop("low").join(held, "set_key").select("center", "salt", "is_member", "node", "shingles")
    dealt = rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "is_member")
    stars = written(dealt.mapInArrow(lambda batches: in_batches(LINKS, _starred(batches)), LINKS), "star-links")

    # Pairs with the centre are settled; what is left of a bucket matters where it lies in different clusters.
    clusters = written(components(stars), "clusters")
    rest = banded.filter("node <> center").join(clusters, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("cluster"))
    left = rest.groupBy("bucket").agg(
        F.min("cluster").alias("one"), F.max("cluster").alias("two"), F.min("node").alias("first"), F.struct(F.count("*"), *(F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2))).alias("all")
    )
    once = left.filter("one <> two").groupBy("all").agg(F.min("bucket").alias("bucket"), F.min("first").alias("first"))  # buckets of the same nodes count once
    open_ = written(rest.join(once.select("bucket", "first"), "bucket"), "open-buckets")
    if not open_.limit(1).count():
        return clusters, None
    return clusters, written(_between(docs, reps, open_, block, most_blocks), "cross-links")


def _between(docs: DataFrame, reps: DataFrame, members: DataFrame, block: int, most_blocks: int) -> DataFrame:
    """Confirmed links between clusters among members (bucket, node, n, cluster, first: the bucket's smallest node)."""
    groups = components(members.select(F.col("node").alias("u"), F.col("first").alias("v")))
    grouped = members.select("node", "n", "cluster").distinct().join(groups, "node").withColumnRenamed("component", "group")
    members_, shingles_ = F.count("*"), F.sum("n")
    parts = F.least(F.lit(PARTS), F.ceil(members_ / min(PART, block)))
    blocks = F.greatest(F.ceil(members_ / block), parts, F.ceil(shingles_ / BLOCK_SHINGLES)).cast("int")
    sizes = written(grouped.groupBy("group").agg(blocks.alias("blocks")), "groups")
    whole = grouped.join(sizes.filter(F.col("blocks") <= most_blocks).select("group"), "group").select("group", "node", "n", "cluster", F.lit(False).alias("single"))
    vast = sizes.filter(F.col("blocks") > most_blocks).select("group")
    if vast.limit(1).count():
        own = groups.join(vast.withColumnRenamed("group", "component"), "component", "left_semi").select("node")
        by_bucket = members.join(own, "node", "left_semi").select(F.unhex(F.lpad(F.hex("bucket"), 16, "0")).alias("group"), "node", "n", "cluster", F.lit(True).alias("single"))
        whole = whole.unionByName(by_bucket)
    whole = written(whole, "compared")
    # Clusters of half a block or more have blocks of their own, which don't meet each other; the others share blocks, a cluster in one of them.
    of_cluster = whole.groupBy("group", "cluster").agg(members_.alias("members"), shingles_.alias("shingles"))
    units = whole.groupBy("group").agg((members_ / blocks).alias("unit"), (shingles_ / blocks).alias("unit_shingles"))
    part = F.greatest(F.col("members") / F.col("unit"), F.col("shingles") / F.col("unit_shingles"))
    weighed = written(of_cluster.join(units, "group").select("group", "cluster", part.alias("part")), "cluster-sizes")
    is_large = F.col("part") > 0.5
    totals = weighed.groupBy("group").agg(
        F.ceil(F.coalesce(F.sum(F.when(~is_large, F.col("part"))), F.lit(0.0))).cast("int").alias("mixed"), F.coalesce(F.sum(F.when(is_large, F.ceil("part"))), F.lit(0)).cast("int").alias("owned")
    )
    before = Window.partitionBy("group").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    large = weighed.filter(is_large).select("group", "cluster", F.ceil("part").cast("int").alias("blocks"), F.coalesce(F.sum(F.ceil("part")).over(before), F.lit(0)).cast("int").alias("before"))
    base = F.col("mixed") + F.col("before")
    mine = F.when(F.col("before").isNotNull(), base + F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("cluster"), F.col("mixed"))).cast("int")
    others = F.sequence(F.lit(0), F.col("mixed") + F.col("owned") - 1)
    met = F.when(F.col("before").isNotNull(), F.filter(others, lambda b: (b < base) | (b >= base + F.col("blocks")))).otherwise(others)
    spread = whole.join(totals, "group").join(large, ["group", "cluster"], "left").select("group", "node", "cluster", "single", mine.alias("own"), met.alias("met"))
    named = written(spread.join(reps.select("node", "low", "set_key", "bands"), "node"), "block-rows")
    held = _sets(docs, named.select("low", "set_key"))
    dealt = named.join(held, "set_key").withColumn("other", F.explode("met"))
    rows = dealt.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "cluster", F.when(~F.col("single"), F.col("bands")).alias("bands"), "shingles")
    ordered = rows.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high")
    return ordered.mapInArrow(lambda batches: in_batches(LINKS, _confirmed(batches)), LINKS)


def drop_near_copies(docs: DataFrame, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, then of the smallest MD5 of its text, then the
    smallest row. Rows decide, not ids: a row is dropped only for a near copy that stays. Rows without words all stay."""
    rows = written(_with_nodes(docs, _signed_rows(docs), block, most_blocks).select("doc_id", "text_key", "component"), "near-rows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rows.filter("component is not null").groupBy("component").agg(F.min(place).alias("w"))
    winners = first.select(F.col("w.doc_id").alias("_w_id"), F.col("w.text_key").alias("_w_key"), F.lit(True).alias("_w"))
    worded = rows.filter("component is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    decided = worded.join(winners, F.col("doc_id").eqNullSafe(F.col("_w_id")) & (F.col("text_key") == F.col("_w_key")), "left").select("doc_id", F.col("text_key").alias("key"), F.coalesce("_w", F.lit(False)).alias("kept"), "n")
    return keep_rows(docs, decided, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))

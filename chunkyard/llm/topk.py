"""Exact inner-product top-k with one KD-tree a shard.

Vectors are dealt into shards by a coarse KD split, whose medians come from a bounded sample by hash of the ids; a cell with more than a
shard's bytes is cut into several at random, so equal vectors or ids never meet in one task for it. A task builds its shard's
tree by median splits on the widest side of the tight bounding box, then streams the queries past it: for each query nodes are
taken from a heap in the order of the largest inner product that their box allows, until that bound falls below the
query's kth best score. A first round asks each query's own shard only; the kth score found there goes with the query, as its
starting bound, to the shards whose boxes can reach it. The short lists of the shards are merged by a window. A bound
equal to the kth score is still opened, for ties go to the smaller id. The shards' boxes are broadcast while they take
at most MOST_BOX_BYTES; beyond that queries travel to every shard of their dimension. The sample and the boxes change the work, never the result.

Vectors that are null or hold null or non-finite components take no part; vectors are compared within their dimension.
Rows that share a vec_id count as the same vector and are never their own answer; of such rows the one with the highest
score is returned once. Null ids take no part. Scores must fit 64 bits. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.llm.common import bounded_batches, runs, written

#: Bytes of a shard's vectors, as 64-bit numbers; rows of a leaf of its tree.
SHARD_BYTES, LEAF = 16 << 20, 256
#: Rows and bytes of the sample that the coarse split is made from, its cells, and bytes of boxes that are broadcast.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS, MOST_BOX_BYTES = 16_384, 32 << 20, 1024, 64 << 20
#: Queries that a task holds at a time.
QUERY_BLOCK = 512
SHARD = ["dim", "cell", "part"]
FOUND = "query_id bigint, vec_id bigint, score bigint, dim int, cell int, part int, low array<bigint>, high array<bigint>"
LOWEST = -(2**63)


@dataclass
class CoarseSplit:
    """Median splits for each dimension: (side, value, left, right) nodes; a negative child -1 - c is cell c."""

    trees: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, sample: dict[int, np.ndarray], cells: dict[int, int]) -> CoarseSplit:
        out = cls()
        for dim, x in sample.items():
            nodes: list[tuple[int, int, int, int]] = []
            made = [0]

            def grow(rows: np.ndarray, want: int) -> int:
                spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) and rows.shape[1] else np.zeros(1, np.int64)
                if want < 2 or len(rows) < 2 or not spread.max():
                    made[0] += 1
                    return -made[0]
                side = int(spread.argmax())
                value = int(np.partition(rows[:, side], len(rows) // 2)[len(rows) // 2])
                below = rows[:, side] < value
                if not below.any():
                    value += 1
                    below = rows[:, side] < value
                nodes.append(())
                i = len(nodes) - 1
                nodes[i] = (side, value, grow(rows[below], want // 2), grow(rows[~below], want - want // 2))
                return i

            grow(x, cells.get(dim, 1))
            out.trees[dim] = nodes
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        nodes = self.trees.get(x.shape[1], [])
        at = np.full(len(x), 0 if nodes else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for i in np.unique(at[inner]):
                side, value, left, right = nodes[i]
                mine = np.flatnonzero(at == i)
                at[mine] = np.where(x[mine, side] < value, left, right)
        return -1 - at


class KDTree:
    """Median splits over int64 vectors; boxes are tight. Node i has children left[i], left[i] + 1 or, as a leaf, rows begin[i]:end[i]."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.begin, self.end, self.left = [0], [len(x)], [-1]
        low, high, i = [], [], 0
        while i < len(self.begin):
            a, b = self.begin[i], self.end[i]
            rows = x[order[a:b]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            spread = high[-1] - low[-1] if x.shape[1] else np.zeros(1, np.int64)
            if b - a > leaf and spread.max() > 0:
                side, mid = int(spread.argmax()), (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, side], mid)]
                self.left[i] = len(self.begin)
                self.begin += [a, a + mid]
                self.end += [a + mid, b]
                self.left += [-1, -1]
            i += 1
        self.ids = ids[order]
        # Doubles hold every product sum exactly where it stays below 2**53; one copy of the vectors is kept.
        self.most = float(np.abs(x).max(initial=0))
        self.x, self.low, self.high = x[order], np.stack(low), np.stack(high)
        if self.most * self.most * max(1, x.shape[1]) < 2**53:
            self.x, self.low, self.high = (a.astype(float) for a in (self.x, self.low, self.high))

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query_id, vec_id, score) of each query's k best ids here that reach `least`, each id once."""
        use = (self.x, self.low, self.high)
        if self.x.dtype == float and self.most * float(np.abs(q).max(initial=0)) * max(1, q.shape[1]) >= 2**53:
            use = tuple(a.astype(np.int64) for a in use)
        q = q.astype(use[0].dtype)
        bounds = np.maximum(q, 0) @ use[2].T + np.minimum(q, 0) @ use[1].T
        for i, own in enumerate(query_ids.tolist()):
            best: list[tuple[int, int]] = []  # (score, -id), the worst first
            held: dict[int, int] = {}  # score of each id in best
            floor, bound = int(least[i]), bounds[i]
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if -top < floor:
                    break
                child = self.left[node]
                if child >= 0:
                    for c in (child, child + 1):
                        if bound[c] >= floor:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                a, b = self.begin[node], self.end[node]
                scores = use[0][a:b] @ q[i]
                for j in np.flatnonzero(scores >= floor).tolist():
                    if self.ids[a + j] == own:
                        continue
                    score, vec = int(scores[j]), int(self.ids[a + j])
                    item = (score, -vec)
                    if vec in held:  # another row of the same id: the better one stays
                        if score > held[vec]:
                            best[best.index((held[vec], -vec))] = item
                            heapq.heapify(best)
                            held[vec] = score
                    elif len(best) < k:
                        heapq.heappush(best, item)
                        held[vec] = score
                    elif item > best[0]:
                        del held[-heapq.heapreplace(best, item)[1]]
                        held[vec] = score
                if len(best) == k:
                    floor = max(floor, best[0][0])
            yield from ((own, -v, s) for s, v in best)


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long integer lists as rows."""
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.list_(pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], [x.split()[0] for x in FOUND.split(", ")])


def _searched(batches: Iterator[pa.RecordBatch], k: int, with_boxes: bool) -> Iterator[pa.RecordBatch]:
    """Rows (dim, cell, part, is_query, id, vector, least), sorted: a shard's vectors, then its queries. With boxes, also a row for each shard's box."""
    shard, tree, ids, rows, box = None, None, [], [], None
    for key, part in runs(batches, 4):
        if key[:3] != shard:
            if box is not None:
                yield _found([(None, None, None, *map(int, shard), *box)])
            shard, tree, ids, rows, box = key[:3], None, [], [], None
        if not key[3]:
            ids.append(part.column(4).to_numpy())
            rows.append(_matrix(part.column(5)))
            if with_boxes:
                low, high = rows[-1].min(axis=0), rows[-1].max(axis=0)
                box = (low, high) if box is None else (np.minimum(box[0], low), np.maximum(box[1], high))
            continue
        if tree is None and rows:
            tree = KDTree(np.concatenate(ids), np.concatenate(rows))
            ids, rows = [], []
        if tree is not None:
            for a in range(0, part.num_rows, QUERY_BLOCK):
                some = part.slice(a, QUERY_BLOCK)
                hits = tree.search(some.column(4).to_numpy(), _matrix(some.column(5)), k, some.column(6).to_numpy())
                yield _found([(*h, None, None, None, None, None) for h in hits])
    if box is not None:
        yield _found([(None, None, None, *map(int, shard), *box)])


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * component), dim, is_query (column _cy_query) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return own.select("vec_id", F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"), F.size("embedding").alias("dim"), F.col("_cy_query").alias("is_query"))


def _dealt(x: DataFrame, split: CoarseSplit) -> DataFrame:
    """x with its cell."""
    own = x.sparkSession.sparkContext.broadcast(split)  # at most MOST_CELLS nodes

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, dim = batch.column(1), batch.column(2).to_numpy()
            cell = np.zeros(len(dim), np.int32)
            for d in np.unique(dim):
                of = np.flatnonzero(dim == d)
                cell[of] = own.value.cells(_matrix(v.take(pa.array(of))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "v", "dim", "is_query", "cell"])

    return x.mapInArrow(cells, "vec_id bigint, v array<bigint>, dim int, is_query boolean, cell int")


def _sharded(vectors: DataFrame, is_query: Column, scale: float, shard_bytes: int) -> tuple[DataFrame, int]:
    """vec_id, v, dim, is_query, cell, part of all vectors that take part, written, and the number of shards."""
    x = whole_vectors(vectors.withColumn("_cy_query", F.coalesce(is_query, F.lit(False))), scale)
    size = 8 * F.greatest(F.col("dim"), F.lit(1)).cast("bigint")
    sizes = {r["dim"]: r["bytes"] for r in x.groupBy("dim").agg(F.sum(size).alias("bytes")).orderBy(F.desc("bytes")).limit(MOST_CELLS).collect()}
    want = {d: min(MOST_CELLS, -(-b // shard_bytes)) for d, b in sizes.items()}
    split = CoarseSplit()
    if any(n > 1 for n in want.values()):
        rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, *sizes))))
        some = x.filter(F.col("dim").isin(list(sizes))).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(rows).select("dim", "v").collect()
        split = CoarseSplit.of({d: np.array([r["v"] for r in some if r["dim"] == d], np.int64).reshape(-1, d) for d in sizes}, want)
    dealt = written(_dealt(x, split).withColumn("seed", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    parts = dealt.groupBy("dim", "cell").agg(F.ceil(F.sum(size) / shard_bytes).cast("int").alias("parts"))
    parts = written(parts.select(F.col("dim").alias("_p_dim"), F.col("cell").alias("_p_cell"), "parts"), "cells")
    placed = dealt.join(parts, (F.col("dim") == F.col("_p_dim")) & (F.col("cell") == F.col("_p_cell")))
    return placed.select("vec_id", "v", "dim", "is_query", "cell", F.pmod("seed", F.col("parts")).cast("int").alias("part")), int(parts.agg(F.sum("parts")).first()[0] or 0)


def _asked(queries: DataFrame, boxes: DataFrame) -> DataFrame:
    """queries (with least) once for each other shard whose box can reach least."""
    names = ["dim", "cell", "part", "vec_id", "v", "least"]
    total = boxes.agg(F.sum(F.size("low") * 16 + 64)).first()[0] or 0
    if total > MOST_BOX_BYTES:
        other = boxes.select("dim", F.col("cell").alias("_o_cell"), F.col("part").alias("_o_part"))
        sent = queries.join(other, "dim").filter((F.col("cell") != F.col("_o_cell")) | (F.col("part") != F.col("_o_part")))
        return sent.select("dim", F.col("_o_cell").alias("cell"), F.col("_o_part").alias("part"), "vec_id", "v", "least")
    held: dict[int, list] = {}
    for r in boxes.collect():  # at most MOST_BOX_BYTES
        held.setdefault(r["dim"], []).append((r["cell"], r["part"], r["low"], r["high"]))
    table = queries.sparkSession.sparkContext.broadcast({d: tuple(np.array([b[i] for b in rows]) for i in range(4)) for d, rows in held.items()})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell, part, least = (batch.column(i).to_numpy() for i in (0, 1, 2, 5))
            for d in np.unique(dim):
                of = np.flatnonzero(dim == d)
                cells, parts, low, high = table.value[int(d)]
                for a in range(0, len(of), QUERY_BLOCK):
                    some = of[a : a + QUERY_BLOCK]
                    q = _matrix(batch.column(4).take(pa.array(some))).astype(float)
                    # Rounded bounds get a margin; the trees decide exactly.
                    bound = np.maximum(q, 0) @ high.reshape(len(cells), -1).T.astype(float) + np.minimum(q, 0) @ low.reshape(len(cells), -1).T.astype(float)
                    reach = bound * (1 + np.sign(bound) * 1e-9) + 1 >= least[some][:, None].astype(float)
                    reach &= (cells[None, :] != cell[some][:, None]) | (parts[None, :] != part[some][:, None])
                    i, j = np.nonzero(reach)
                    at = pa.array(some[i])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), pa.array(cells[j].astype(np.int32)), pa.array(parts[j].astype(np.int32)), *(batch.column(c).take(at) for c in (3, 4, 5))], names
                    )

    return queries.select(*names).mapInArrow(send, "dim int, cell int, part int, vec_id bigint, v array<bigint>, least bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each query's k best other vectors by integer inner product: query_id, rank, vec_id, score."""
    bounded_batches(vectors.sparkSession)
    lowest = F.lit(LOWEST).cast("bigint")
    x, shards = _sharded(vectors, is_query, scale, shard_bytes)
    rows = x.select(*SHARD, F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", lowest.alias("least"))
    queries = x.filter("is_query").select(*SHARD, "vec_id", "v")

    def ask(asked: DataFrame, with_boxes: bool) -> DataFrame:
        both = rows.unionByName(asked.select(*SHARD, F.lit(1).alias("asks"), F.col("vec_id").alias("id"), "v", "least"))
        ordered = both.repartition(max(shards, 1), *SHARD).sortWithinPartitions(*SHARD, "asks")
        return ordered.mapInArrow(lambda batches: _searched(batches, k, with_boxes), FOUND)

    def best(hits: DataFrame) -> DataFrame:
        once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    home = written(ask(queries.withColumn("least", lowest), shards > 1), "home-hits")
    hits = home.filter("query_id is not null").select("query_id", "vec_id", "score")
    if shards > 1:
        boxes = home.filter("query_id is null").select(*SHARD, "low", "high")
        kth = best(hits).filter(F.col("rank") == k).select(F.col("query_id").alias("_cy_q"), F.col("score").alias("_cy_kth"))
        bound = queries.join(kth, F.col("vec_id") == F.col("_cy_q"), "left").withColumn("least", F.coalesce("_cy_kth", lowest))
        more = ask(_asked(bound.select(*SHARD, "vec_id", "v", "least"), boxes), False)
        hits = hits.unionByName(more.select("query_id", "vec_id", "score"))
    return best(hits).select("query_id", "rank", "vec_id", "score")

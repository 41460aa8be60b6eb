"""Best-fit packing of token sequences by bin completion.

Texts are tokenized once, cut only where longer than the capacity, and written as `pieces`. The plan is made from the
histogram of piece lengths, which has at most `capacity` rows whatever the corpus: the undominated fillings around the
longest remaining length are enumerated, the least waste first, and branched over with backtracking, each as often as the
counts allow and then less often. The best-fit-decreasing plan of the same histogram is the first incumbent: a branch that
cannot need fewer bins, by its waste or by the lower bound L2 of what is left, is cut off. The search ends when the incumbent
meets the lower bound or nothing is left to try, and the plan then has the fewest bins; or after `nodes` fillings (NODES by
default, a parameter, since the problem is NP-hard), with the best plan found and a warning that says how far it may be from the
fewest; nodes=None searches to the end, whatever it takes. Pieces then find their places by their rank among the pieces of the same
length, from counts by (task, length), so no task ever holds the pieces of a length together.

Nulls: a null text is empty (its end id only); null ids pass through. Repeated rows are packed each. Very long texts are cut into
pieces of the capacity, never shortened. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkyard.llm.common import bounded_batches, giving_back, written
from chunkyard.llm.tokens import encoder

#: Fillings that the whole search may meet before it takes the best plan found; a default, None is no limit.
NODES = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, task int, rank bigint"


def plan_best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram, as (copies, [(length, times), ...]) patterns."""
    by_room: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                per = min(capacity // length, left)
                copies = left // per
                by_room.setdefault(capacity - per * length, []).append((copies, ((length, per),)))
                left -= copies * per
                continue
            copies, pattern = by_room[room].pop()
            per = min(room // length, left)
            used = min(copies, left // per)
            if copies > used:
                by_room[room].append((copies - used, pattern))
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - per * length, []).append((used, (*pattern, (length, per))))
            left -= used * per
    return [(c, list(p)) for bins in by_room.values() for c, p in bins]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any plan needs, by Martello and Toth's L2: for every k, items over capacity - k share a bin with nothing of k or more."""
    lengths = np.arange(len(counts))
    number, size = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))  # of what is shorter than the index
    k = np.arange(capacity // 2 + 1)
    half, high = capacity // 2 + 1, capacity - k + 1
    over = number[-1] - number[half]
    room = capacity * (number[high] - number[half]) - (size[high] - size[half])
    return int((over + np.maximum(0, -(-(size[half] - size[k] - room) // capacity))).max())


def _is_dominated(pattern: list[tuple[int, int]], spare: int, excluded: int) -> bool:
    """Whether an item left out (a bit of `excluded` by length) fits in place of some of the pattern's (or of none), using more room or fewer items."""
    one, two = 0, 0  # sums of one item, and of two or more
    for x, k in pattern:
        for _ in range(k):
            two |= (two | one) << x
            one |= 1 << x
    if two & excluded:
        return True
    sums, width = 1 | one | two, 1
    more = sums << 1  # by 1 to `spare` more than the sums
    while width < spare:
        step = min(width, spare - width)
        more |= more << step
        width += step
    return bool(spare and more & excluded)


def fillings(counts: np.ndarray, first: int, capacity: int, most_waste: int, tried: list[float], after: tuple | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(waste, pattern) of all undominated fillings of one bin around `first`: the least waste first, then the longest items first.

    Fillings up to `after`, a pair like those yielded, are left out. Sums that the shorter items can reach steer the search,
    so that it meets no dead ends. tried[0] counts the fillings met, dominated ones included; at tried[1] the search ends.
    """
    room = capacity - first
    order = np.flatnonzero(counts[: min(first, room) + 1])
    free = counts[order].tolist()
    order = order.tolist()
    if order and order[-1] == first:
        free[-1] -= 1
    mask = (1 << (room + 1)) - 1
    reach = [1]  # by number of lengths taken in, a bit for each sum
    for x, n in zip(order, free):
        sums, n, part = reach[-1], min(n, room // x), 1
        while n > 0:
            part = min(part, n)
            sums |= sums << (x * part)
            n, part = n - part, part * 2
        reach.append(sums & mask)
    left = sum(1 << x for x, n in zip(order, free) if n)

    def exact(target: int, below: int, chosen: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        if not target:
            yield chosen
            return
        for i in range(below - 1, -1, -1):
            if not reach[i + 1] >> target & 1:
                return
            x = order[i]
            for k in range(min(target // x, free[i]), 0, -1):
                if reach[i] >> (target - k * x) & 1:
                    yield from exact(target - k * x, i, [*chosen, (x, k)])

    position = {x: i for i, x in enumerate(order)}
    for waste in range(after[0] if after else 0, min(room, most_waste) + 1):
        if not reach[-1] >> (room - waste) & 1:
            continue
        for rest in exact(room - waste, len(order), []):
            tried[0] += 1
            whole = rest[:]
            if whole and whole[0][0] == first:
                whole[0] = (first, whole[0][1] + 1)
            else:
                whole.insert(0, (first, 1))
            excluded = left
            for x, k in rest:
                if free[position[x]] == k:
                    excluded ^= 1 << x
            passed = after and waste == after[0] and whole >= after[1]
            if not passed and not _is_dominated(rest, waste, excluded):
                yield waste, whole
            if tried[0] >= tried[1]:
                return


class _Step:
    """A choice of the search: the fillings around the longest item left, each as often as the counts allow and then less often."""

    __slots__ = ("first", "after", "ready", "done", "ended", "applied")

    def __init__(self, first: int, after: tuple | None):
        self.first, self.after = first, after
        self.ready: list[tuple[int, int, list[tuple[int, int]]]] = []
        self.done, self.ended = 0, False
        self.applied: tuple[int, int, list[tuple[int, int]]] | None = None

    def next(self, left: np.ndarray, capacity: int, spare: int, tried: list[float]) -> tuple[int, int, list[tuple[int, int]]] | None:
        """(copies, waste, pattern); fillings are made anew, twice as many each time, rather than kept half-way."""
        if self.applied and self.applied[0] > 1:
            copies, waste, pattern = self.applied
            return copies - 1, waste, pattern
        if not self.ready and not self.ended:
            some = list(islice(fillings(left, self.first, capacity, spare, tried, self.after), self.done, 2 * self.done + 1))
            self.ended = len(some) <= self.done
            self.done += len(some)
            self.ready = [(min(int(left[x]) // k for x, k in p), w, p) for w, p in reversed(some)]
        return self.ready.pop() if self.ready else None


def plan_completion(counts: np.ndarray, capacity: int, nodes: int | None = NODES) -> list[tuple[int, list[tuple[int, int]]]]:
    """The fewest bins, by branch and bound over the undominated fillings; best-fit decreasing is the first incumbent.

    A branch ends where its waste, or its bins with the lower bound of what is left, allow no better plan. Bins around the
    same longest item come in the order of their fillings, so that no set of bins is met twice. After `nodes` fillings the
    best plan so far is taken, which then may not be the best of all; a warning says so. Without a limit (None) it always is.
    """
    best = plan_best_fit(counts, capacity)
    most = sum(c for c, _ in best)
    total = int((counts * np.arange(len(counts))).sum())
    least = lower_bound(counts, capacity)
    if most <= least:
        return best
    left, bins, wasted = counts.copy(), 0, 0
    tried = [0, float("inf") if nodes is None else nodes]
    steps = [_Step(int(np.flatnonzero(left)[-1]), None)]
    while steps and tried[0] < tried[1]:
        step = steps[-1]
        undone = step.applied
        if undone:
            copies, waste, pattern = undone
            for x, k in pattern:
                left[x] += k * copies
            bins, wasted = bins - copies, wasted - copies * waste
        spare = (most - 1) * capacity - total - wasted  # waste that a better plan may still have
        step.applied = step.next(left, capacity, spare, tried)
        if step.applied is None:
            steps.pop()
            continue
        copies, waste, pattern = step.applied
        tried[0] += 1
        for x, k in pattern:
            left[x] -= k * copies
        bins, wasted = bins + copies, wasted + copies * waste
        if copies * waste > spare or bins + lower_bound(left, capacity) >= most:
            continue
        rest = np.flatnonzero(left)
        if len(rest):
            same = int(rest[-1]) == step.first
            steps.append(_Step(int(rest[-1]), (waste, pattern) if same else None))
            continue
        best, most = [(s.applied[0], s.applied[2]) for s in steps], bins
        if most <= least:
            break
    if steps and most > least:
        logging.getLogger(__name__).warning("the search for the fewest sequences ended after %s fillings with %s; the lower bound is %s", tried[0], most, least)
    return best


def token_pieces(docs: DataFrame, file: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of all texts, written: doc_id, piece, start, length, ids (little-endian uint32), task, rank (among the task's pieces of that length)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(file), np.asarray([end_id], "<u4").tobytes()
        task, ranks, size = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), 4 * capacity
        for batch in giving_back(batches):
            out: list[tuple] = []
            held = 0
            for doc, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    n = len(part) // 4
                    out.append((doc, piece, at // 4, n, part, task, int(ranks[n])))
                    ranks[n] += 1
                held += len(ids)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    return written(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 7
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids", "task", "rank"])


@dataclass
class Packing:
    """pieces: the written token pieces. place(): adds sequence_id and offset to any projection of pieces that holds task, length and rank."""

    spark: SparkSession
    pieces: DataFrame
    capacity: int
    nodes: int | None = NODES

    def place(self, rows: DataFrame) -> DataFrame:
        by_task = self.pieces.groupBy("task", "length").agg(F.count("*").alias("_cy_n"))
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        bases = by_task.withColumn("_cy_base", F.coalesce(F.sum("_cy_n").over(before), F.lit(0))).drop("_cy_n")
        counts = np.zeros(self.capacity + 1, np.int64)
        for r in self.pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
            counts[r["length"]] = r["n"]
        plan = plan_completion(counts, self.capacity, self.nodes)
        spots: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for copies, pattern in plan:
            at = 0
            for length, times in pattern:
                rank = ranks.get(length, 0)
                spots.setdefault(length, []).append((rank, sequence, times, at))
                ranks[length] = rank + times * copies
                at += times * length
            sequence += copies
        table = self.spark.sparkContext.broadcast({k: np.asarray(v, np.int64) for k, v in spots.items()})  # at most capacity patterns

        @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
        def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
            n, r = length.to_numpy(), rank.to_numpy()
            out = np.zeros((len(n), 2), np.int64)
            for x in np.unique(n):
                of = np.flatnonzero(n == x)
                t = table.value[int(x)]
                row = t[np.searchsorted(t[:, 0], r[of], side="right") - 1]
                k = r[of] - row[:, 0]
                out[of, 0] = row[:, 1] + k // row[:, 2]
                out[of, 1] = row[:, 3] + (k % row[:, 2]) * x
            return pd.DataFrame(out, columns=["sequence_id", "offset"])

        placed = rows.join(bases, ["task", "length"]).withColumn("_cy_at", spot("length", F.col("rank") + F.col("_cy_base")))
        return placed.withColumns({"sequence_id": F.col("_cy_at.sequence_id"), "offset": F.col("_cy_at.offset")}).drop("_cy_at", "_cy_base")


def pack(docs: DataFrame, file: str, end_id: int = 1, capacity: int = 4096, nodes: int | None = NODES) -> Packing:
    """Packs every text of docs (doc_id, text) into sequences of at most `capacity` ids."""
    bounded_batches(docs.sparkSession)
    return Packing(docs.sparkSession, token_pieces(docs, file, end_id, capacity), capacity, nodes)

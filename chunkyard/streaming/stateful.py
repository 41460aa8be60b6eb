"""Structured Streaming: token buckets, access tracking, eviction sweeps, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkyard.operators.catalog import first_writer, last_writer
from chunkyard.operators.lifecycle import access_summary, eviction_plan, save_snapshot, token_bucket
from chunkyard.operators.store import insert_if_absent


def rate_limit_stream(events: DataFrame, burst: float, refill: float, prune: bool = False) -> DataFrame:
    """Decisions for a stream of (key, event_id, ts); a key's bucket is its state.

    With `prune` an idle bucket is dropped once it must be full again, which changes no decision; timeouts keep a query
    running, so a query that should end with its input goes without.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, at = state.get if state.exists else (None, None)
        for frame in frames:
            ordered = frame.sort_values(["ts", "event_id"])
            seconds = ordered["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            allowed, level, at = token_bucket(np.asarray(seconds), burst, refill, level, at)
            yield pd.DataFrame({"key": key[0], "event_id": ordered["event_id"], "ts": ordered["ts"], "allowed": allowed})
        if level is not None:
            state.update((float(level), float(at)))
            if prune and refill > 0:
                state.setTimeoutDuration(int(1000 * (burst / refill + 1)))

    return events.groupBy("key").applyInPandasWithState(
        step, "key bigint, event_id bigint, ts timestamp, allowed boolean", "tokens double, last_seen double", "append", GroupStateTimeout.ProcessingTimeTimeout if prune else GroupStateTimeout.NoTimeout
    )


def access_stream(log: DataFrame) -> DataFrame:
    """Last access and requests in flight, kept up to date."""
    return access_summary(log)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs apply on each micro-batch: all that is there now, or periodically."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_stream(incoming: DataFrame, blobs_path: str, checkpoint: str) -> StreamingQuery:
    """Appends new blobs of a stream of (key, size, content); a batch is retried as a whole and inserts nothing twice."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(blobs_path).filter(F.col("batch_id") != batch_id)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            known = spark.createDataFrame([], batch.schema)
        new, _ = insert_if_absent(batch, known)
        new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(blobs_path)

    return each_batch(incoming, apply, checkpoint)


def sweep(objects: DataFrame, budget: int, remove: Callable[[DataFrame], None]) -> DataFrame:
    """One eviction sweep; meant for foreachBatch of a periodic trigger."""
    plan = eviction_plan(objects, budget)
    remove(plan)
    return plan


def sweep_stream(log: DataFrame, objects: Callable[[], DataFrame], budget: int, remove: Callable[[DataFrame], None], checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """A sweep over the objects as they are whenever the access log has grown by a trigger."""
    return each_batch(log, lambda batch, _: sweep(objects(), budget, remove) and None, checkpoint, every)


def snapshot_stream(changes: DataFrame, tables: Callable[[], dict[str, DataFrame]], root: str, version: int, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """Saves the tables each time that changes arrive within a trigger's interval; without an interval, once for all that is there, as at a shutdown."""
    return each_batch(changes, lambda batch, _: None if batch.isEmpty() else save_snapshot(tables(), root, version), checkpoint, every)


def ingest_rows_stream(incoming: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, last: bool = True, every: str | None = None) -> StreamingQuery:
    """Keeps one row a key of a stream of index rows (shard records, file references, commits): the last by `order`, or the first.

    Every batch writes its own winners below its number, so a batch that runs again writes the same once; current_rows picks among batches.
    """
    pick = last_writer if last else first_writer

    def apply(batch: DataFrame, batch_id: int) -> None:
        pick(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each_batch(incoming, apply, checkpoint, every)


def current_rows(spark: SparkSession, path: str, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """What ingest_rows_stream has kept so far."""
    return (last_writer if last else first_writer)(spark.read.parquet(path).drop("batch_id"), keys, order)

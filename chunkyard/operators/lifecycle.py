"""Eviction to a byte budget, storage statistics, cache freshness, access tracking, snapshots."""

from __future__ import annotations

import uuid
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkyard.operators.work import written

EPOCH = datetime(1970, 1, 1)


def candidates(sizes: DataFrame, access: DataFrame, in_flight: DataFrame) -> DataFrame:
    """key, last_access, size of objects that no request holds; an object never read is the oldest."""
    joined = sizes.join(access, "key", "left").join(in_flight, "key", "left")
    return joined.filter(F.coalesce("in_flight", F.lit(0)) <= 0).select("key", F.coalesce("last_access", F.lit(EPOCH)).alias("last_access"), "size")


def access_summary(log: DataFrame) -> DataFrame:
    """key, last_access, in_flight of (key, ts, delta)."""
    return log.groupBy("key").agg(F.max("ts").alias("last_access"), F.coalesce(F.sum("delta"), F.lit(0)).alias("in_flight"))


def eviction_plan(objects: DataFrame, budget: int, total: int | None = None) -> DataFrame:
    """The objects to evict, oldest first (ties by key): while what is left after the earlier ones passes the budget.

    Objects are dealt into ranges of (last_access, key) and written, so that however many share an access time they are spread. Sums of whole
    ranges are windowed first, then each range's objects within it.
    """
    if budget <= 0:
        return objects.withColumn("freed_before", F.lit(0).cast("bigint")).limit(0)
    ranged = written(objects.repartitionByRange("last_access", "key").withColumn("_range", F.spark_partition_id()), "by-access")
    ranges = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranges.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"), F.sum("_bytes").over(Window.partitionBy()).alias("_all"))
    within = Window.partitionBy("_range").orderBy("last_access", "key").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(bases, "_range").withColumn("freed_before", F.col("_base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    stored = F.lit(total) if total is not None else F.col("_all")
    return summed.filter(stored - F.col("freed_before") > budget).drop("_range", "_base", "_all")


def storage_stats(objects: DataFrame, evicted: DataFrame) -> DataFrame:
    left = objects.join(evicted.select("key"), "key", "left_anti").agg(F.count("*").alias("objects_left"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_left"))
    gone = evicted.agg(F.count("*").alias("objects_evicted"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_evicted"))
    return left.crossJoin(gone)  # one row each


def forget(keys: DataFrame, *indices: DataFrame) -> list[DataFrame]:
    """Each index without the keys; file terms and the chunk index keep what refers to them."""
    return [x.join(keys.select("key"), "key", "left_anti") for x in indices]


def fresh(stored_at: Column, now: Column, ttl_seconds: int) -> Column:
    return F.lit(ttl_seconds >= 0) & (F.unix_timestamp(now) - F.unix_timestamp(stored_at) <= ttl_seconds)


def usable_stale_token(expiry: Column, now: Column, margin: int = 60) -> Column:
    return expiry > F.unix_timestamp(now) + margin


def served(keys: DataFrame, cache: DataFrame, live: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """key, value, origin: a fresh cached value, else the live one, else a stale cached one."""
    joined = keys.join(cache.select("key", F.col("value").alias("_c"), "stored_at"), "key", "left").join(live.select("key", F.col("value").alias("_l")), "key", "left")
    hit = F.col("stored_at").isNotNull() & fresh(F.col("stored_at"), now, ttl_seconds)
    origin = F.when(hit, "cache").when(F.col("_l").isNotNull(), "live").when(F.col("_c").isNotNull(), "stale").otherwise("missing")
    return joined.select("key", F.when(hit, F.col("_c")).otherwise(F.coalesce("_l", "_c")).alias("value"), origin.alias("origin"))


def token_bucket(seconds: np.ndarray, burst: float, refill: float, tokens: float | None = None, last: float | None = None) -> tuple[list[bool], float, float]:
    """Decisions in time order, and the state after them. A new bucket is full; refill is capped at the burst."""
    level, at, out = (burst, float(seconds[0]), []) if tokens is None else (tokens, last, [])
    for t in seconds.tolist():
        level = min(burst, level + max(0.0, t - at) * refill)
        at = max(at, t)
        allowed = level >= 1
        level -= allowed
        out.append(allowed)
    return out, level, at


def rate_limit(events: DataFrame, burst: float, refill: float) -> DataFrame:
    """key, event_id, ts, allowed: each key's events in time order through its bucket. Refill caps make it no plain sum, so a key is one sequential group."""

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = frame.sort_values(["ts", "event_id"])
        seconds = ordered["ts"].astype("int64").to_numpy() / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[np.datetime_data(ordered["ts"].dtype)[0]]
        allowed, _, _ = token_bucket(seconds, burst, refill)
        return ordered.assign(allowed=allowed)[["key", "event_id", "ts", "allowed"]]

    return events.select("key", "event_id", "ts").groupBy("key").applyInPandas(rows, "key bigint, event_id bigint, ts timestamp, allowed boolean")


def save_snapshot(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Writes each index below a new folder, then the manifest row that publishes it; returns the folder."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(version, folder, sorted(tables), datetime.now())], "version int, folder string, tables array<string>, saved timestamp").write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return folder


def load_snapshot(spark: SparkSession, root: str, version: int, strict: bool = False) -> dict[str, DataFrame]:
    """The last published snapshot of the version; none yet gives no tables, another version fails if strict and gives none otherwise."""
    try:
        manifest = spark.read.parquet(f"{root.rstrip('/')}/manifest")
    except AnalysisException:
        return {}
    last = manifest.orderBy(F.desc("saved")).first()
    if last is None:
        return {}
    if last["version"] != version:
        if strict:
            raise ValueError(f"snapshot version {last['version']}, not {version}")
        return {}
    return {name: spark.read.parquet(f"{last['folder']}/{name}") for name in last["tables"]}

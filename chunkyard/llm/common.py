"""Shared helpers of the training-data operators: the shared work folder, written tables, choices of rows, group streaming."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which an id list may be broadcast (8-byte ids: 32 MB); larger lists go through a shuffled join.
BROADCAST_ROWS = 4_000_000


#: Rows and bytes that go to Python at once; texts can be long, and several workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches within these bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        n = int(now) if now and now.lstrip("-").isdigit() else 0
        if n <= 0 or n > most:
            spark.conf.set(key, str(most))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset (local tests) a temporary folder takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chunkyard-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z only become a-z; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary array, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, made longer while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, decided: DataFrame, key: Column) -> DataFrame:
    """Rows of docs, with all their columns, as decided (doc_id, key, kept, n: rows) says; rows that it doesn't name all stay.

    Rows are told apart by (doc_id, key), or by doc_id alone where none is named twice. Of kept rows that share both, the one whose
    text, then its other columns in order, is smallest stays. Lists are broadcast only where counted and few.
    """
    rows = written(decided, "decided")
    said, of, own = (free_name(docs, x) for x in ("_cy_id", "_cy_of", "_cy_key"))
    same_id = F.col("doc_id").eqNullSafe(F.col(said))
    if not rows.groupBy("doc_id").agg(F.sum("n").alias("n")).filter("n > 1").limit(1).count():
        out = rows.filter("not kept").select(F.col("doc_id").alias(said))
        return docs.join(F.broadcast(out) if out.count() <= BROADCAST_ROWS else out, same_id, "left_anti")
    keyed = docs.withColumn(own, key)
    same = same_id & (F.col(own) == F.col(of))
    named = lambda x: x.select(F.col("doc_id").alias(said), F.col("key").alias(of))
    out, several = named(rows.filter("not kept or n > 1")), named(rows.filter("kept and n > 1"))
    few = F.broadcast if rows.count() <= BROADCAST_ROWS else lambda x: x
    once = keyed.join(few(several), same, "left_semi")
    order = F.struct("text", *(c for c, kind in docs.dtypes if c != "text" and "map<" not in kind and "variant" not in kind))
    picked = once.groupBy("doc_id", own).agg(F.min_by(F.struct(*docs.columns), order).alias(of))
    return keyed.join(few(out), same, "left_anti").select(*docs.columns).unionByName(picked.select(f"{of}.*"))


def give_back() -> None:
    """What Arrow and the C library have freed goes back to the system; elsewhere than with glibc, Arrow's only."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what has been freed meanwhile goes back to the system at the end, as workers live on."""
    yield from batches
    give_back()


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of rows with equal first `keys` columns, from batches sorted by them; a run over several batches comes in several slices."""
    for batch in batches:
        n = batch.num_rows
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            if a < b:
                yield tuple(c[a] for c in cols), batch.slice(a, b - a)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The slices of each run together; for groups of bounded size."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for key, part in runs(batches, keys):
        if held and key != last:
            yield last, held
            held = []
        last = key
        held.append(part)
    if held:
        yield last, held


def record_batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows under a DDL schema of bigint, int, string and binary columns."""
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def in_batches(schema: str, rows: Iterator[tuple], most: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield record_batch(schema, held)
            held = []
    if held:
        yield record_batch(schema, held)

"""Immutable blobs by key: insert if absent, verified insert, ranges, dedup uploads, restore, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.functions.hashes import file_id

#: Bytes of a comparing round of the verified insert.
ROUND = 256 << 10
TEMP_MARK = ".tmp-"


def read_blobs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """key (the file's name), size, modified, content of the files below a folder; what a query doesn't ask for isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def existing(keys: DataFrame, blobs: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(blobs.select(key), key, "left_semi")


def missing(keys: DataFrame, blobs: DataFrame, key: str = "key") -> DataFrame:
    return keys.join(blobs.select(key), key, "left_anti")


def get_range(blobs: DataFrame, start: Column, length: Column) -> DataFrame:
    """Bytes [start, start + length) of each blob."""
    return blobs.withColumn("content", F.substring(F.col("content"), start + 1, length))


def insert_if_absent(incoming: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows) of (key, size, content): one row a new key; contents of another length than said are rejected."""
    short = F.octet_length("content") != F.col("size")
    sound = incoming.filter(~F.coalesce(short, F.lit(True)))
    return missing(sound.dropDuplicates(["key"]), blobs), incoming.filter(F.coalesce(short, F.lit(True)))


def verify_insert(incoming: DataFrame, blobs: DataFrame, round_bytes: int = ROUND) -> DataFrame:
    """key, status (new, equal, mismatch), first differing offset rounded down to its round. Nothing is overwritten."""
    held = blobs.select("key", F.col("content").alias("_held"))
    both = incoming.join(held, "key", "left")
    n = F.greatest(F.octet_length("content"), F.octet_length("_held"))
    rounds = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(round_bytes))).otherwise(F.array().cast("array<int>"))
    piece = lambda c, a: F.substring(F.col(c), a + 1, F.lit(round_bytes))
    differ = F.col("_held").isNotNull() & (F.col("content") != F.col("_held"))
    first = F.get(F.filter(rounds, lambda a: piece("content", a) != piece("_held", a)), F.lit(0))
    status = F.when(F.col("_held").isNull(), "new").when(F.col("content") == F.col("_held"), "equal").otherwise("mismatch")
    return both.select("key", status.alias("status"), F.when(differ, first).alias("mismatch_round_offset"))


def delete_keys(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """Blobs without the keys; unknown keys don't matter."""
    return blobs.join(keys.select("key"), "key", "left_anti")


def total_bytes(listing: DataFrame) -> DataFrame:
    """Bytes of (name, size), without temporary files."""
    return listing.filter(~F.col("name").contains(TEMP_MARK)).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count("*").alias("blobs"))


def stale_temps(listing: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Temporary files older than half an hour."""
    return listing.filter(F.col("name").contains(TEMP_MARK) & (F.unix_timestamp(now) - F.unix_timestamp("modified") > minutes * 60))


def first_occurrence(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """chunks (ingest_seq, seq, hash) with is_new: the first of its hash in arrival order, unless it is known already.

    The first arrival of a hash is a minimum, which is pre-aggregated; the join back can be split where a hash is hot.
    """
    place = F.struct("ingest_seq", "seq")
    first = chunks.groupBy("hash").agg(F.min(place).alias("_first"))
    if known is not None:
        first = first.join(known.select("hash"), "hash", "left_anti")
    marked = chunks.join(first, "hash", "left")
    return marked.withColumn("is_new", F.coalesce(F.col("_first") == place, F.lit(False))).drop("_first")


def upload_stats(files: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row an upload: ids, chunk counts, stored bytes and dedup percent.

    files (file_key, ingest_seq, content), chunks (file_key, seq, length, hash). A repeated chunk inside an upload is new once.
    """
    order = files.select("file_key", "ingest_seq")
    marked = first_occurrence(chunks.join(order, "file_key"), known)
    new = F.when(F.col("is_new"), 1).otherwise(0)
    per_file = marked.groupBy("file_key").agg(
        F.count("*").alias("chunks_total"), F.sum(new).alias("chunks_new"), F.sum(F.when(F.col("is_new"), F.col("length")).otherwise(0)).alias("bytes_stored")
    )
    sha = F.sha2("content", 256)
    base = files.select("file_key", F.octet_length("content").cast("bigint").alias("size"), sha.alias("sha256"))
    joined = base.join(per_file, "file_key", "left")
    stored = F.coalesce("bytes_stored", F.lit(0)).cast("bigint")
    return joined.select(
        "file_key",
        file_id(F.col("sha256")).alias("file_id"),
        "sha256",
        "size",
        F.coalesce("chunks_total", F.lit(0)).cast("bigint").alias("chunks_total"),
        F.coalesce("chunks_new", F.lit(0)).cast("bigint").alias("chunks_new"),
        stored.alias("bytes_stored"),
        F.when(F.col("size") > 0, 100 * (1 - stored / F.col("size"))).otherwise(0.0).alias("dedup_percent"),
    )


def store_stats(chunks: DataFrame, uploads: DataFrame) -> DataFrame:
    """Unique chunks and bytes; every upload counts, identical ones too."""
    unique = chunks.groupBy("hash").agg(F.max("length").alias("length"))
    return unique.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("unique_bytes")).crossJoin(uploads.agg(F.count("*").alias("files_stored")))


def manifests(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, size, sha256, chunks in order. Manifests hold references only, no content."""
    refs = chunks.groupBy("file_key").agg(F.sort_array(F.collect_list(F.struct("seq", "hash", "offset", "length"))).alias("refs"))
    sha = F.sha2("content", 256)
    base = files.select("file_key", file_id(sha).alias("file_id"), F.octet_length("content").cast("bigint").alias("size"), sha.alias("sha256"))
    empty = F.expr("cast(array() as array<struct<hash:string,offset:bigint,length:int>>)")
    plain = F.transform("refs", lambda r: F.struct(r["hash"].alias("hash"), r["offset"].cast("bigint").alias("offset"), r["length"].cast("int").alias("length")))
    return base.join(refs, "file_key", "left").select("file_key", "file_id", "size", "sha256", F.coalesce(plain, empty).alias("chunks"))


def restore_parts(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """file_key, seq, offset, content of every chunk of the manifests, for files of any size; the content of a missing chunk is null."""
    refs = manifest.select("file_key", F.posexplode("chunks").alias("seq", "ref")).select("file_key", "seq", F.col("ref.offset").alias("offset"), F.col("ref.hash").alias("hash"))
    return refs.join(blobs.select(F.col("key").alias("hash"), "content"), "hash", "left").select("file_key", "seq", "offset", "content")


def restore(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """file_key, content, complete, for files that fit a row: chunks put together in order; a missing chunk leaves null content."""
    whole = restore_parts(manifest, blobs).groupBy("file_key").agg(F.expr("listagg(content) within group (order by seq)").alias("content"), F.count_if(F.col("content").isNull()).alias("gone"))
    every = manifest.select("file_key").join(whole, "file_key", "left")
    complete = F.coalesce("gone", F.lit(0)) == 0
    return every.select("file_key", F.when(complete, F.coalesce("content", F.lit(b""))).alias("content"), complete.alias("complete"))

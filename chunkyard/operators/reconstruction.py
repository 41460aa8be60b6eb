"""Reconstruction: the stored chunk ranges that make up a byte range of a file, for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkyard.functions.paths import parse_byte_range

UNKNOWN_FILE, BAD_RANGE, MISSING_FOOTER, BAD_CHUNKS, OK = "unknown_file", "bad_range", "missing_footer", "bad_chunk_range", "ok"


def term_spans(terms: DataFrame) -> DataFrame:
    """terms (file, ord, object, unpacked, chunk_start, chunk_end) with [term_start, term_end) in the file."""
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("unpacked").over(w), F.lit(0))
    return terms.withColumn("term_start", start).withColumn("term_end", F.col("term_start") + F.col("unpacked"))


def file_sizes(terms: DataFrame) -> DataFrame:
    return terms.groupBy("file").agg(F.sum("unpacked").alias("size"))


def overlaps(start: Column, stop: Column) -> Column:
    """Terms are kept whole where they meet the inclusive window."""
    return (F.col("term_end") > start) & (F.col("term_start") <= stop)


def physical_range(boundaries: Column, start: Column, end: Column) -> Column:
    """(start, stop inclusive) of chunks [start, end) in an object."""
    first = F.when(start > 0, F.get(boundaries, start - 1)).otherwise(F.lit(0))
    return F.struct(first.cast("bigint").alias("start"), (F.get(boundaries, end - 1) - 1).cast("bigint").alias("stop"))


def bad_chunk_range(start: Column, end: Column, n: Column) -> Column:
    return (start > end) | (end == 0) | (end > n)


def request_windows(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    """requests (request, file, header) with status and inclusive window. An unknown file comes before a bad range."""
    joined = requests.join(sizes, "file", "left")
    ranged = joined.withColumn("_r", parse_byte_range(F.col("header"), F.col("size")))
    status = F.when(F.col("size").isNull(), UNKNOWN_FILE).when(F.col("_r.status") == "unsatisfiable", BAD_RANGE).otherwise(OK)
    return ranged.select("request", "file", "size", status.alias("status"), F.col("_r.start").alias("start"), F.col("_r.stop").alias("stop"))


def _asked_terms(windows: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms in each request's window; running offsets are summed for asked files only."""
    asked = windows.filter(F.col("status") == OK).select("request", "file", "start", "stop")
    spans = term_spans(terms.join(asked.select("file"), "file", "left_semi"))
    return asked.join(spans, "file").filter(overlaps(F.col("start"), F.col("stop")))


def clipped_terms(windows: DataFrame, terms: DataFrame, footers: DataFrame) -> DataFrame:
    """The terms of each request with their physical ranges; the window is applied before footers are joined."""
    joined = _asked_terms(windows, terms).join(footers.select("object", "boundaries"), "object", "left")
    fault = F.when(F.col("boundaries").isNull(), MISSING_FOOTER).when(bad_chunk_range(F.col("chunk_start"), F.col("chunk_end"), F.size("boundaries")), BAD_CHUNKS)
    physical = F.when(fault.isNull(), physical_range(F.col("boundaries"), F.col("chunk_start"), F.col("chunk_end")))
    return joined.select(
        "request", "file", "ord", "object", "unpacked", "chunk_start", "chunk_end", "term_start", "start", fault.alias("fault"), physical.alias("url_range")
    )


def request_status(windows: DataFrame, terms: DataFrame, footers: DataFrame) -> DataFrame:
    """request, status, without building any response."""
    sizes = footers.select("object", F.size("boundaries").alias("n"))
    joined = _asked_terms(windows, terms).select("request", "object", "chunk_start", "chunk_end").join(sizes, "object", "left")
    fault = F.when(F.col("n").isNull(), MISSING_FOOTER).when(bad_chunk_range(F.col("chunk_start"), F.col("chunk_end"), F.col("n")), BAD_CHUNKS)
    faults = joined.groupBy("request").agg(F.min(fault).alias("fault"))
    return windows.join(faults, "request", "left").select("request", F.coalesce("fault", "status").alias("status"))


def _by_object(clipped: DataFrame, *more: Column) -> DataFrame:
    """Lists by (request, object). Rows are dealt by request once, which also serves the steps after it."""
    fetch = F.struct("ord", F.struct("chunk_start", "chunk_end").alias("range"), "url_range")
    return clipped.repartition("request").groupBy("request", "object").agg(F.sort_array(F.collect_list(fetch)).alias("fetch"), F.min("fault").alias("fault"), *more)


def build_v1(windows: DataFrame, clipped: DataFrame) -> DataFrame:
    """request, status, offset_into_first_range, terms in order, fetch_info by object."""
    term = F.collect_list(F.struct("ord", "object", "unpacked", "chunk_start", "chunk_end")).alias("terms")
    into = F.min(F.struct("ord", (F.col("start") - F.col("term_start")).alias("into"))).alias("first")
    heads = _by_object(clipped, term, into).groupBy("request").agg(
        F.sort_array(F.flatten(F.collect_list("terms"))).alias("terms"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("object", "fetch")))).alias("fetch_info"),
        F.min("first").alias("first"),
        F.min("fault").alias("fault"),
    )
    joined = windows.join(heads, "request", "left")
    return joined.select("request", F.coalesce("fault", "status").alias("status"), F.coalesce("first.into", F.lit(0)).alias("offset_into_first_range"), "terms", "fetch_info")


def build_v2(windows: DataFrame, clipped: DataFrame) -> DataFrame:
    """One fetch an object with all its ranges in term order."""
    ranges = F.transform("fetch", lambda f: F.struct(f["ord"].alias("ord"), f["range"].alias("chunks"), f["url_range"].alias("url_range"))).alias("ranges")
    by_object = _by_object(clipped).select("request", "object", ranges, "fault")
    grouped = by_object.groupBy("request").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("object", "ranges")))).alias("objects"), F.min("fault").alias("fault"))
    return windows.join(grouped, "request", "left").select("request", F.coalesce("fault", "status").alias("status"), "objects")


def ranges_by_start(ranges: Column) -> Column:
    """Fetch ranges in the order of their first bytes, as a presigned request lists them."""
    return F.transform(F.array_sort(F.transform(ranges, lambda r: F.struct(r["url_range"]["start"].alias("start"), r.alias("r")))), lambda x: x["r"])


def term_fetches(responses: DataFrame) -> DataFrame:
    """Each term of responses (request, terms, fetch_info) with the fetches of its object; null where the response has none."""
    terms = responses.select("request", "fetch_info", F.inline("terms"))
    return terms.select("request", "ord", "object", "chunk_start", "chunk_end", F.try_element_at("fetch_info", F.col("object")).alias("fetches"))


def cited_from_start(fetch: Column) -> Column:
    """Whether any fetch range starts at byte 0."""
    return F.exists(fetch, lambda f: f["url_range"]["start"] == 0)


def first_record(records: DataFrame, key: str, order: str) -> DataFrame:
    """The first record of each key by a linear order."""
    names = [c for c in records.columns if c != key]
    picked = records.groupBy(key).agg(F.min_by(F.struct(*names), order).alias("_first"))
    return picked.select(key, *(F.col(f"_first.{c}").alias(c) for c in names))


def by_truncated_key(lookups: DataFrame, table: DataFrame) -> DataFrame:
    """lookups (hash, key) against table (key, full_hash, ...): equal keys first, then the full hash."""
    return lookups.join(table, "key").filter(F.col("hash") == F.col("full_hash"))


def cacheable_files(terms: DataFrame, footers: DataFrame, bodies: DataFrame) -> DataFrame:
    """file, cacheable: only where every object has its footer and its bytes."""
    whole = footers.select("object").join(bodies.select("object"), "object", "left_semi").withColumn("_there", F.lit(True))
    return terms.join(whole.distinct(), "object", "left").groupBy("file").agg(F.every(F.coalesce("_there", F.lit(False))).alias("cacheable"))

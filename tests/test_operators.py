"""Store, reconstruction, catalog, lifecycle, request strings and streaming on small fixtures."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkyard.functions import hashes, paths
from chunkyard.operators import catalog, chunking, lifecycle, reconstruction, store
from chunkyard.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def test_upload_stats(spark):
    rng = random.Random(3)
    data = rng.randbytes(300_000)
    df = spark.createDataFrame([("a", 1, bytearray(data)), ("b", 2, bytearray(data + rng.randbytes(50_000))), ("c", 3, bytearray(data)), ("e", 4, bytearray()), ("n", 5, None)], "file_key string, ingest_seq bigint, content binary")
    chunks = chunking.hashed(chunking.chunk_files(df, 1024, 4096, 16384))
    got = {r["file_key"]: r for r in store.upload_stats(df, chunks).collect()}
    assert got["a"]["chunks_new"] == got["a"]["chunks_total"] > 10 and got["a"]["dedup_percent"] == 0
    assert 0 < got["b"]["chunks_new"] < got["b"]["chunks_total"] and got["b"]["dedup_percent"] > 50
    assert got["c"]["chunks_new"] == 0 and got["c"]["dedup_percent"] == 100 and got["c"]["file_id"] == got["a"]["file_id"]
    assert (got["e"]["size"], got["e"]["chunks_total"], got["e"]["dedup_percent"]) == (0, 0, 0.0)
    known = chunks.filter("file_key = 'a'").select("hash").distinct()
    assert {r["file_key"]: r["chunks_new"] for r in store.upload_stats(df, chunks, known).collect()}["a"] == 0


def test_insert_and_verify(spark):
    blobs = spark.createDataFrame([("k1", 2, bytearray(b"aa")), ("k2", 300_000, bytearray(300_000))], "key string, size bigint, content binary")
    late = bytearray(300_000)
    late[280_000] = 1
    new = spark.createDataFrame([("k1", 2, bytearray(b"aa")), ("k3", 3, bytearray(b"ccc")), ("k3", 3, bytearray(b"ccc")), ("k4", 9, bytearray(b"short")), ("k2", 300_000, late)], blobs.schema)
    added, rejected = store.insert_if_absent(new, blobs)
    assert [r["key"] for r in added.collect()] == ["k3"] and [r["key"] for r in rejected.collect()] == ["k4"]
    got = {(r["key"], r["status"], r["mismatch_round_offset"]) for r in store.verify_insert(new, blobs).collect()}
    assert got == {("k1", "equal", None), ("k3", "new", None), ("k4", "new", None), ("k2", "mismatch", 262_144)}
    assert store.delete_keys(blobs, blobs.limit(0)).count() == 2
    listing = spark.createDataFrame([("a", 5, T0), (".tmp-x", 7, T0)], "name string, size bigint, modified timestamp")
    assert tuple(store.total_bytes(listing).first()) == (5, 1)
    assert store.stale_temps(listing, F.lit(T0 + dt.timedelta(hours=1))).count() == 1


def test_restore_reports_missing_chunks(spark):
    df = spark.createDataFrame([("a", bytearray(b"hello world" * 100)), ("b", bytearray(b"other" * 300)), ("e", bytearray())], "file_key string, content binary")
    pieces = chunking.fixed_chunks(df, 256)
    blobs = pieces.select(F.sha2("data", 256).alias("key"), F.col("data").alias("content"), "file_key").dropDuplicates(["key"])
    m = store.manifests(df, chunking.hashed(pieces))
    got = {r["file_key"]: r for r in store.restore(m, blobs.filter("file_key <> 'b'")).collect()}
    assert bytes(got["a"]["content"]) == b"hello world" * 100 and got["a"]["complete"]
    assert got["b"]["content"] is None and not got["b"]["complete"]
    assert bytes(got["e"]["content"]) == b"" and got["e"]["complete"]


TERMS = "file string, ord int, object string, unpacked bigint, chunk_start int, chunk_end int"


def recon(spark, terms, feet, header):
    t = spark.createDataFrame(terms, TERMS)
    f = spark.createDataFrame(feet, "object string, boundaries array<bigint>")
    r = spark.createDataFrame([(1, "f", header)], "request int, file string, header string")
    w = reconstruction.request_windows(r, reconstruction.file_sizes(t))
    clipped = reconstruction.clipped_terms(w, t, f)
    return reconstruction.build_v1(w, clipped).first(), reconstruction.build_v2(w, clipped).first()


def test_reconstruction(spark):
    v1, _ = recon(spark, [("f", 0, "11", 100, 0, 2)], [("11", [50, 110])], "bytes=0-99")
    assert v1["status"] == "ok" and len(v1["terms"]) == 1 and tuple(v1["fetch_info"]["11"][0]["url_range"]) == (0, 109)
    v1, _ = recon(spark, [("f", 0, "11", 100, 0, 1), ("f", 1, "22", 100, 0, 1)], [("11", [100]), ("22", [100])], "bytes=150-199")
    assert [t["object"] for t in v1["terms"]] == ["22"] and v1["offset_into_first_range"] == 50
    _, v2 = recon(spark, [("f", 0, "11", 50, 0, 1), ("f", 1, "11", 50, 1, 2)], [("11", [50, 110])], "")
    assert [tuple(r["url_range"]) for r in v2["objects"]["11"]] == [(0, 49), (50, 109)]
    assert recon(spark, [("f", 0, "11", 100, 0, 1)], [], "bytes=0-99")[0]["status"] == "missing_footer"
    assert recon(spark, [("f", 0, "11", 100, 0, 5)], [("11", [10])], "bytes=0-99")[1]["status"] == "bad_chunk_range"
    assert recon(spark, [("g", 0, "11", 100, 0, 1)], [("11", [10])], "bytes=9-5")[0]["status"] == "unknown_file"
    assert recon(spark, [("f", 0, "11", 100, 0, 1)], [("11", [10])], "bytes=100-200")[0]["status"] == "bad_range"


@pytest.mark.parametrize(
    "header, want",
    [
        ("bytes=0-99", ("ok", 0, 99)), ("", ("none", 0, 999)), (None, ("none", 0, 999)), ("bytes=", "u"), ("bytes=-", "u"), ("bytes=0-", "u"), ("bytes=-100", "u"), ("bytes=100-0", "u"),
        ("bytes=-1--1", "u"), ("BYTES=0-99", "u"), ("bytes=0-99, 100-199", ("ok", 0, 99)), ("bytes=0-99999999999999999999", "u"), ("bytes=900-5000", ("ok", 900, 999)), ("bytes=1000-1001", "u"),
    ],
)
def test_byte_ranges(spark, header, want):
    r = spark.createDataFrame([(header,)], "h string").select(paths.parse_byte_range(F.col("h"), F.lit(1000)).alias("r")).first()["r"]
    assert tuple(r) == (("unsatisfiable", None, None) if want == "u" else want)


def test_paths(spark):
    cases = {
        "datasets/o/n/resolve/main/data/x.parquet": ("dataset", "o/n", "main", "data/x.parquet"),
        "buckets/o/n/resolve/main/a": ("model", "o/n", "main", "a"),
        "alice/model/resolve/refs/pr/1/file.bin": ("model", "alice/model", "refs", "pr/1/file.bin"),
    }
    bad = ["", "a/b", "/resolve/main/x", "o/n/resolve/main/", "//resolve//0", "n/resolve/main/x"]
    df = spark.createDataFrame([(p,) for p in [*cases, *bad]], "p string")
    got = {r["p"]: r["r"] for r in df.select("p", paths.parse_resolve_path(F.col("p")).alias("r")).collect()}
    assert all(tuple(got[p]) == want for p, want in cases.items()) and all(got[p] is None for p in bad)
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(paths.next_link(F.lit('<http://a/1>; rel="prev", <http://a/2>; rel="next"'))) == "http://a/2"
    assert pick(paths.bearer_token(F.lit("bEARER abc"))) == "abc"
    assert pick(paths.source_ip(F.lit("10.0.0.1:80"))) == "10.0.0.1" and pick(paths.source_ip(F.lit("[::1]:80"))) == "::1"
    assert pick(paths.trim_quotes(F.lit('"x"'))) == "x" and pick(paths.file_name(F.lit("a/b\\c.txt"))) == "c.txt"
    assert pick(paths.percent_encoded(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9"
    assert pick(paths.retry_after(F.lit(0.5), 0.1)) == 6 and pick(paths.retry_after(F.lit(2.0), 1.0)) == 0
    assert tuple(pick(paths.split_repo_path(F.lit("/models/o/n/tree/main")))) == ("model", "o", "n", "tree/main")
    assert pick(paths.is_under(F.lit("weights/a"), F.lit("weights"))) and not pick(paths.is_under(F.lit("weights2/a"), F.lit("weights")))
    assert paths.signing_key("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "20120215", "us-east-1", "iam").hex() == "f4780e2d9f65fa895f9c67b32ce1baf0b0d8a43505a000a1a9e090d414db404d"


def test_catalog(spark):
    lines = ['{"key":"header","value":{}}', "", '{"key":"lfsFile","value":{"path":"w/a.bin","algo":"sha256","oid":"aaa111","size":100}}', '{"key":"lfsFile","value":{"path":"README.md","algo":"sha256","oid":"bbb222","size":50}}', '{"key":"lfsFile","value":{"path":"w/a.bin","algo":"sha256","oid":"ccc","size":7}}']
    files = catalog.last_writer(catalog.commit_files(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")), ["path"], "line_no")
    named = files.select(F.lit("model").alias("repo_type"), F.lit("o/n").alias("repo_id"), F.lit("main").alias("revision"), "path", "sha256_hex", "size", F.lit("0" * 64).alias("content_hash"))
    asked = spark.createDataFrame([(1, "model", "o/n", "", "w"), (2, "model", "o/n", "main", ""), (3, "model", "o/n", "dev", "")], "request int, repo_type string, repo_id string, revision string, prefix string")
    got = [(r["request"], r["path"], r["oid"], r["content_hash"]) for r in catalog.tree(named, asked).collect()]
    assert got == [(1, "w/a.bin", "ccc", None), (2, "README.md", "bbb222", None), (2, "w/a.bin", "ccc", None)]
    with pytest.raises(Exception):
        catalog.commit_files(spark.createDataFrame([(0, "{bad")], "line_no int, line string")).collect()
    a = spark.createDataFrame([("h1", "s1")], "hash string, shard string")
    b = spark.createDataFrame([("h1", "s2", 1), ("h2", "s3", 3), ("h2", "s4", 2)], "hash string, shard string, seq int")
    assert {tuple(r) for r in catalog.existing_first(a, b, ["hash"], "seq").collect()} == {("h1", "s1"), ("h2", "s4")}
    assert {tuple(r) for r in catalog.upsert(a, b, ["hash"], "seq").collect()} == {("h1", "s2"), ("h2", "s3")}
    assert catalog.create_repos(spark.createDataFrame([("model", "o/n")], "repo_type string, repo_id string"), spark.createDataFrame([("", "o", "n"), ("dataset", "", "x")], "repo_type string, organization string, name string")).count() == 2


@pytest.mark.parametrize("budget, want", [(100, ["old"]), (30, ["mid", "new", "old"]), (0, []), (120, [])])
def test_eviction(spark, budget, want):
    df = spark.createDataFrame([("old", T0, 40), ("mid", T0 + dt.timedelta(hours=1), 40), ("new", T0 + dt.timedelta(days=3), 40)], "key string, last_access timestamp, size bigint")
    assert sorted(r["key"] for r in lifecycle.eviction_plan(df, budget).collect()) == want
    busy = spark.createDataFrame([("old", 1)], "key string, in_flight int")
    assert {r["key"] for r in lifecycle.candidates(df.select("key", "size"), df.select("key", "last_access"), busy).collect()} == {"mid", "new"}


def test_token_bucket():
    run = lambda s, b, r: lifecycle.token_bucket(np.asarray(s, float), b, r)[0]
    assert run([0, 0, 0, 0], 3, 1) == [True, True, True, False]
    assert run([0, 0, 1.1], 1, 1) == [True, False, True]
    assert sum(run([0, *[3600] * 10], 2, 100)[1:]) == 2


def test_snapshots_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    root = f"file://{tmp_path}/snap"
    assert lifecycle.load_snapshot(spark, root, 2) == {}
    lifecycle.save_snapshot({"index": df}, root, 2)
    lifecycle.save_snapshot({"index": df.union(df)}, root, 2)
    assert lifecycle.load_snapshot(spark, root, 2)["index"].count() == 2 and lifecycle.load_snapshot(spark, root, 3) == {}
    with pytest.raises(ValueError):
        lifecycle.load_snapshot(spark, root, 3, strict=True)
    keys = spark.createDataFrame([("fresh",), ("stale",), ("live",), ("none",)], "key string")
    cache = spark.createDataFrame([("fresh", "c", T0), ("stale", "c", T0 - dt.timedelta(days=1)), ("live", "c", T0 - dt.timedelta(days=1))], "key string, value string, stored_at timestamp")
    live = spark.createDataFrame([("live", "l"), ("fresh", "l")], "key string, value string")
    got = {r["key"]: (r["value"], r["origin"]) for r in lifecycle.served(keys, cache, live, F.lit(T0), 60).collect()}
    assert got == {"fresh": ("c", "cache"), "stale": ("c", "stale"), "live": ("l", "live"), "none": (None, "missing")}


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, i, T0 + dt.timedelta(seconds=i * 0.7 + rng.random())) for i in range(60) for k in (1, 2)]
    df = spark.createDataFrame(rows, "key bigint, event_id bigint, ts timestamp")
    want = {(r["key"], r["event_id"]): r["allowed"] for r in lifecycle.rate_limit(df, 2, 0.5).collect()}
    src = f"{tmp_path}/in"
    df.filter("event_id < 30").coalesce(1).write.parquet(src)
    out = {}
    stream = spark.readStream.schema(df.schema).parquet(src)
    for _ in range(2):
        q = stateful.rate_limit_stream(stream, 2, 0.5).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        df.filter("event_id >= 30").coalesce(1).write.mode("append").parquet(src) if not out else None
        out = {(r["key"], r["event_id"]): r["allowed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == want and not all(want.values())


def test_incremental_ingest(spark, tmp_path):
    src, blobs = f"{tmp_path}/in", f"{tmp_path}/blobs"
    schema = "key string, size bigint, content binary"
    for rows in ([("a", 1, bytearray(b"a")), ("b", 1, bytearray(b"b"))], [("b", 1, bytearray(b"b")), ("c", 1, bytearray(b"c")), ("bad", 5, bytearray(b"x"))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        stateful.ingest_stream(stream, blobs, f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.parquet(blobs).collect()) == ["a", "b", "c"]


def test_store_ingest_and_restore(spark, tmp_path):
    from chunkyard.operators import ingest

    rng = np.random.default_rng(3)
    a, b = rng.bytes(40_000), rng.bytes(9_000)
    first = spark.createDataFrame([("a", 1, a), ("b", 2, b), ("empty", 3, b""), ("again", 4, a)], "file_key string, ingest_seq bigint, content binary")
    box = ingest.Store(spark, str(tmp_path / "store"), 256, 1024, 4096)
    one = {r["file_key"]: r for r in box.ingest(first).collect()}
    assert one["again"]["chunks_new"] == 0 and one["a"]["chunks_new"] == one["a"]["chunks_total"] > 20
    edited = a[:20_000] + b"inserted" + a[20_000:]
    two = box.ingest(spark.createDataFrame([("a2", 5, edited), ("b", 6, b)], first.schema)).collect()
    assert {r["file_key"]: r["chunks_new"] for r in two}["b"] == 0 and 0 < max(r["chunks_new"] for r in two) <= 4
    assert box.blobs.count() == box.blobs.select("key").distinct().count() and box.manifests.count() == 4
    assert box.stats().first()["files_stored"] == 6
    ids = {r["file_key"]: r["file_id"] for r in [*one.values(), *two]}
    parts = box.restore(spark.createDataFrame([(ids["a2"],), (ids["b"],), ("../x",), ("unknown",)], "file_id string")).collect()
    whole: dict = {}
    for r in sorted(parts, key=lambda r: r["seq"]):
        whole[r["file_id"]] = whole.get(r["file_id"], b"") + bytes(r["content"])
    assert whole == {ids["a2"]: edited, ids["b"]: b}


@pytest.mark.parametrize("segment", [1000, 50_000])
def test_chunks_of_blobs_beyond_a_row(spark, tmp_path, segment):
    from chunkyard.operators import chunking, ingest

    rng = np.random.default_rng(4)
    contents = {"x": rng.bytes(123_457), "y": bytes(30_000), "z": b"", "one": b"a"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    blobs = spark.createDataFrame([(k, f"file://{tmp_path}/{k}", len(v)) for k, v in contents.items()], "file_key string, uri string, size bigint")
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "file_key string, content binary")
    want = chunking.hashed(chunking.chunk_files(files, 256, 1024, 4096)).select("file_key", "seq", "offset", "length", "hash")
    assert sorted(map(tuple, ingest.chunk_blobs(blobs, 256, 1024, 4096, segment).collect())) == sorted(map(tuple, want.collect()))


def test_ingest_rejects(spark):
    from chunkyard.operators import ingest
    from chunkyard.sources import objects, shards

    body = objects.build([b"one", b"two"])
    own = hashes.to_hex(objects.derive_footer(body).object_hash)
    rows = [(1, "default", own, body), (2, "default", own, body), (3, "default", own, body + b"?"), (4, "default", "f" * 64, body), (5, "default", "short", body), (6, None, own, body), (7, "default", own.upper(), body + bytes(200)), (8, "default", own, None)]
    status, new = ingest.ingest_objects(spark.createDataFrame(rows, "upload bigint, prefix string, claimed string, body binary"), spark.createDataFrame([], "object_key string"), most=100)
    assert {r["upload"]: r["status"] for r in status.collect()} == {1: "inserted", 2: "present", 3: "malformed", 4: "hash_mismatch", 5: "bad_hash", 6: "bad_prefix", 7: "too_large", 8: "malformed"}
    (got,) = new.collect()
    assert got["object_key"] == own and len(got["chunk_hashes"]) == 2
    f = [shards.FileRecord(bytes([i]) * 32, [(b"o" * 32, 0, 10 * i, 0, 1)], sha256=bytes([9]) * 32) for i in (1, 2)]
    x = [shards.ObjectRecord(b"o" * 32, [(b"c" * 32, 0, 10, 0)])]
    later = [shards.FileRecord(bytes([1]) * 32, [(b"o" * 32, 0, 77, 0, 1)])]
    sent = [(1, shards.write_shard(f, x)), (2, b"junk"), (3, shards.write_shard(later, x)), (4, shards.write_shard(f, x)[:-1]), (5, bytes(5000)), (6, shards.write_shard(f, x))]
    out = ingest.ingest_shards(spark.createDataFrame([(i, bytearray(b)) for i, b in sent[:3] + sent[4:5]], "upload bigint, body binary"), most=4000)
    assert {r["upload"]: r["status"] for r in out.status.collect()} == {1: "ok", 2: "malformed", 3: "ok", 5: "too_large"}
    assert {(bytes(r["file"])[0], r["unpacked"]) for r in out.terms.collect()} == {(1, 77), (2, 20)}
    assert [bytes(r["file_hash"])[0] for r in out.bridge.collect()] in ([1], [2]) and out.bodies.count() == 2
    (c,) = out.chunk_index.collect()
    assert bytes(c["shard_hash"]) == hashes.leaf_hashes([sent[0][1]])[0]
    twice = ingest.ingest_shards(spark.createDataFrame([(i, bytearray(b)) for i, b in (sent[0], sent[5])], "upload bigint, body binary"))
    assert twice.bodies.count() == 1 and twice.status.filter("status = 'ok'").count() == 2


def test_request_bodies(spark):
    from chunkyard.operators import requests as hub

    bodies = ['{"operation":"upload","objects":[]}', ' {"operation":null} \n', '{"operation":"a"}{}', '{"operation":"a"},{"operation":"b"}', "", None, "null", "[]", "{", '{"operation":"a"} x', '{"operation":"' + "x" * 400 + '"}']
    got = hub.decode_requests(spark.createDataFrame(list(enumerate(bodies)), "request int, body string"), hub.BATCH, most=300).collect()
    assert {r["request"]: r["status"] for r in got} == {0: "ok", 1: "ok", **dict.fromkeys(range(2, 10), "malformed"), 10: "too_large"}
    issued = hub.issued_tokens(spark.createDataFrame([(1,), (2,)], "request int"), F.lit("2024-01-01 00:00:00").cast("timestamp"), "https://x").collect()
    assert len({r["access_token"] for r in issued}) == 2 and all(len(r["access_token"]) == 32 and r["expires"] == 1704067200 + 3600 and r["cas_url"] == "https://x" for r in issued)
    assert len(spark.range(1).select(hub.commit_oid(F.col("id"), "s").alias("o")).first()["o"]) == 40


def test_tree_by_ancestors(spark):
    from chunkyard.operators import catalog

    files = spark.createDataFrame([("model", "o/n", "main", p, "s", 1, None) for p in ("a/b/c", "a/b", "a/bc", "/x/y", "d")], "repo_type string, repo_id string, revision string, path string, sha256_hex string, size bigint, content_hash string")
    asked = [("all", ""), ("none", None), ("folder", "a"), ("file", "a/b"), ("slash", "a/"), ("deep", "a/b/c"), ("root", "/x"), ("gone", "z")]
    got: dict = {}
    for r in catalog.tree(files, spark.createDataFrame([(n, "model", "o/n", "", p) for n, p in asked], "request string, repo_type string, repo_id string, revision string, prefix string")).collect():
        got.setdefault(r["request"], []).append(r["path"])
    every = ["/x/y", "a/b", "a/b/c", "a/bc", "d"]
    assert got == {"all": every, "none": every, "folder": ["a/b", "a/b/c", "a/bc"], "file": ["a/b", "a/b/c"], "deep": ["a/b/c"], "root": ["/x/y"]}


def test_eviction_of_objects_never_read(spark):
    objects = spark.range(3000).select("id", F.lit("1970-01-01").cast("timestamp").alias("last_access"), F.lit(10).cast("bigint").alias("size")).withColumnRenamed("id", "key")
    plan = lifecycle.eviction_plan(objects, 10_000).collect()
    assert sorted((r["key"], r["freed_before"]) for r in plan) == [(i, 10 * i) for i in range(2000)]


def test_index_streams(spark, tmp_path):
    from chunkyard.streaming import stateful

    schema = "path string, seq bigint, size bigint"
    spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("a", 3, 30)], schema).write.parquet(f"{tmp_path}/in")
    kept = lambda last: {r["path"]: r["size"] for r in stateful.current_rows(spark, f"{tmp_path}/{last}", ["path"], "seq", last).collect()}
    for last in (True, False):
        for _ in range(2):
            stateful.ingest_rows_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/{last}", ["path"], "seq", f"{tmp_path}/c{last}", last).awaitTermination()
    assert kept(True) == {"a": 30, "b": 20} and kept(False) == {"a": 10, "b": 20}
    spark.createDataFrame([("b", 9, 90)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stateful.ingest_rows_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/True", ["path"], "seq", f"{tmp_path}/cTrue").awaitTermination()
    assert kept(True) == {"a": 30, "b": 90}
    stateful.snapshot_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda: {"files": stateful.current_rows(spark, f"{tmp_path}/True", ["path"], "seq")}, f"{tmp_path}/snap", 2, f"{tmp_path}/cs", None).awaitTermination()
    assert lifecycle.load_snapshot(spark, f"{tmp_path}/snap", 2)["files"].count() == 2


def test_blobs_of_a_folder(spark, tmp_path):
    (tmp_path / "aa").mkdir()
    (tmp_path / "aa" / "one").write_bytes(b"abc")
    (tmp_path / "two.tmp-1").write_bytes(b"later")
    got = store.read_blobs(spark, str(tmp_path))
    assert {(r["key"], r["size"], bytes(r["content"])) for r in got.collect()} == {("one", 3, b"abc"), ("two.tmp-1", 5, b"later")}
    assert store.read_blobs(spark, str(tmp_path), "one").count() == 1
    listing = got.select(F.col("key").alias("name"), "size", "modified")
    assert tuple(store.total_bytes(listing).first()) == (3, 1)
    assert store.stale_temps(listing, F.current_timestamp() + F.expr("interval 1 hour")).count() == 1
    assert store.delete_keys(got, spark.createDataFrame([("one",), ("none",)], "key string")).select("key").first()[0] == "two.tmp-1"


def test_tokens_and_addresses(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first()["x"]
    assert pick(paths.canonical_uri(F.lit(""))) == "/" and pick(paths.canonical_uri(F.lit("/a/b c"))) == "/a/b%20c"
    assert [pick(paths.first_token(F.lit(g), F.lit(e))) for g, e in (("t", "e"), ("None", "e"), ("", "e"), ("None", ""))] == ["t", "e", "e", "None"]
    assert pick(paths.base_url(F.lit("HTTPS"), F.lit("h:1"))) == "https://h:1" and pick(paths.base_url(F.lit(None).cast("string"), F.lit("h"))) == "http://h"
    assert pick(paths.repo_path(F.lit("dataset"), F.lit("o/n"))) == "datasets/o/n" and pick(paths.object_url("http://x/", "default", F.lit("ab"))).endswith("/default/ab")
    assert [pick(paths.resolve_prefix(F.lit(t))) for t in ("dataset", "space", "model")] == ["datasets/", "spaces/", ""]
    assert pick(paths.repo_id_before(F.lit("o/n/info/lfs"), "/info/lfs")) == "o/n" and pick(paths.repo_id_before(F.lit("n/info/lfs"), "/info/lfs")) is None
    assert pick(paths.cache_key(F.lit("a"), F.lit("b"))) == "a\0b"
    key = paths.signing_key("wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "20150830", "us-east-1", "iam")
    said = "AWS4-HMAC-SHA256\n20150830T123600Z\n20150830/us-east-1/iam/aws4_request\nf536975d06c0309214f805bb90ccff089219ecd68b2577efef23edd43b7e1a59"
    assert paths.signature(key, said) == "5d672d79c15b13162d9279b0855cfba6789a8edb4c82c400e06b5924a6f2b5d7"
    now = F.lit("2024-01-01").cast("timestamp")
    assert [pick(lifecycle.usable_stale_token(F.unix_timestamp(now) + n, now)) for n in (60, 61)] == [False, True]


def test_repositories_and_branches(spark):
    revisions = spark.createDataFrame([("model", "o/n", "main", "c0")], "repo_type string, repo_id string, revision string, commit_oid string")
    asked = spark.createDataFrame([("model", "o/n", "v1"), ("model", "o/n", "v1"), ("model", "o/n", "main")], "repo_type string, repo_id string, revision string")
    got = sorted((r["revision"], r["commit_oid"]) for r in catalog.create_branches(revisions, asked).collect())
    assert [g[0] for g in got] == ["main", "v1"] and got[0][1] == "c0"
    rows = spark.createDataFrame([("file", "a"), ("directory", "b")], "type string, path string")
    assert [r["path"] for r in catalog.only_files(rows).collect()] == ["a"]


def test_sweeps_and_access_on_streams(spark, tmp_path):
    schema = "key bigint, ts timestamp, delta int"
    spark.createDataFrame([(i, T0 + dt.timedelta(days=i), 1) for i in range(5)] + [(0, T0 + dt.timedelta(days=9), -1)], schema).write.parquet(f"{tmp_path}/log")
    log = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
    objects = lambda: spark.read.parquet(f"{tmp_path}/log").groupBy("key").agg(F.max("ts").alias("last_access"), F.lit(10).cast("bigint").alias("size"))
    swept = []
    stateful.sweep_stream(log(), objects, 20, lambda plan: swept.extend(r["key"] for r in plan.collect()), f"{tmp_path}/c", None).awaitTermination()
    assert sorted(swept) == [1, 2, 3]
    query = stateful.access_stream(log()).writeStream.outputMode("complete").format("memory").queryName("accessed").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["key"]: r["in_flight"] for r in spark.table("accessed").collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}

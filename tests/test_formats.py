"""Hashes, codecs, chunking and binary formats: published vectors, round trips, malformed input."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkyard.functions import codecs, hashes
from chunkyard.functions.blake import keyed_many
from chunkyard.operators import chunking
from chunkyard.sources import objects, shards

A = "cfc5d07f6f03c29bbf424132963fe08d19a37d5757aaf520bf08119f05cd56d6"
B = "c3e67584b5c4fc2a89837ec39e40f2c8a6bb0b2987ac94cd4b31e5fbdd210a72"
C = "0d2beb91b9196929a5ddec9f6e306924ddf4a24268e3e59fd8464738d525af37"
D = "adf8773496a9b7319b2e50dc98093f344053b17d8ad37100b9c07d9805988784"
SIZE = {A: 100, B: 200, C: 300, D: 400}


def entries(names):
    return [(hashes.from_hex(x), SIZE[x]) for x in names]


@pytest.mark.parametrize(
    "names, want",
    [
        ([], "0" * 64),
        ([A], A),
        ([A, B, C], "71ec1275fca074724e2dd666921b3277c7cee603e4d025bcab2d4050015be2bc"),
        ([A, A, A, A], "89f2ada89ff8c96763c6b25010e6dd76a4c05b1466207633ea559acf2093211b"),
        ([A, B, A, B, C, D], "52c826f99507aa05d0b45e9837fa1709e0485425cfbcb1e80db3905cf98b3ee9"),
    ],
)
def test_merkle_vectors(names, want):
    assert hashes.to_hex(hashes.merkle_root(entries(names))) == want


@pytest.mark.parametrize(
    "salt, want",
    [
        ("0" * 64, "54e55dccc6653c612bdb5576c5d3cb34bb31bc4e100248abccf4c908b3ef7715"),
        ("b286606709ef32a1cfede1e603a39f83fef56772d8234c0e35d8920071d80b69", "337f1f046e4cfc1057f0f3edbd87cf977fdfaf3c2b0c0031ca2d1d2a34aa2270"),
        ("20f7357cdb2f6d3727375656e4eaf464fa195094ff501edc08aaccfb1419a07b", "82c5359ad947e91e4da6a00034f94a9159bd3bf24d005ef167648b9d3ba77f8c"),
    ],
)
def test_file_hash_vectors(salt, want):
    assert hashes.to_hex(hashes.file_hash(entries([A, B, C]), hashes.from_hex(salt))) == want
    assert hashes.file_hash([]) == hashes.ZERO


def test_zero_entry_is_its_own_root():
    assert hashes.merkle_root([(bytes(32), 0)]) == bytes(32)


def test_hash_text(spark):
    raw = bytes((22, 175, 58, 132, 4, 75, 131, 214, 190, 153, 138, 66, 226, 3, 153, 242, 204, 86, 80, 234, 249, 153, 80, 99, 159, 80, 65, 138, 236, 231, 149, 78))
    text = "d6834b04843aaf16f29903e2428a99be635099f9ea5056cc4e95e7ec8a41509f"
    assert hashes.to_hex(raw) == text and hashes.from_hex(text) == raw
    df = spark.createDataFrame([(bytearray(raw), text), (bytearray(b"short"), "xyz"), (None, None)], "h binary, t string")
    got = df.select(hashes.hash_hex(F.col("h")), hashes.hash_from_hex(F.col("t")), hashes.truncated_key(F.col("h")), hashes.mod64(F.col("h"), 4).cast("int"), hashes.is_zero(F.col("h"))).collect()
    assert got[0][0] == text and bytes(got[0][1]) == raw and bytes(got[0][2]) == bytes.fromhex(text[:16]) and got[0][3] == int(text[48:], 16) % 4 and got[0][4] is False
    assert got[1][0] is None and got[1][1] is None and got[2][0] is None
    with pytest.raises(ValueError):
        hashes.from_hex("00")


def test_leaf_hash_vectors():
    got = [hashes.to_hex(x) for x in hashes.leaf_hashes([b"hello world", b""])]
    assert got == ["4e39378b9d359f118190557a1f44130219a54e5fcfa07bd96cf50b466fe651b1", "e0f2cf784e7e5f10c34f84af150e9a5ff9664216debad915364d741049870f67"]


def test_keyed_hash_against_the_jvm(spark):
    rng = random.Random(1)
    inputs = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 8192, 9217, 31744, 100_000)]
    key = rng.randbytes(32)
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    assert keyed_many(inputs, key) == [bytes(x % 256 for x in jvm.keyedHash(key, d)) for d in inputs]


def test_merkle_of_a_table_against_the_jvm(spark):
    """Every document of the smallest table: leaves and nodes by the JVM's hash, groups cut entry by entry."""
    from chunkyard.operators import chunking
    from chunkyard.plans import queries

    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    slow = lambda data, key: bytes(x % 256 for x in jvm.keyedHash(key, data))

    def root(entries):
        while len(entries) > 1:
            groups, group = [], []
            for h, n in entries:
                group.append((h, n))
                if len(group) >= 3 and h[24] % 4 == 0 or len(group) == 9:
                    groups.append(group)
                    group = []
            groups += [group] if group else []
            entries = [(slow("".join(f"{hashes.to_hex(h)} : {n}\n" for h, n in g).encode(), hashes.NODE_KEY), sum(n for _, n in g)) for g in groups]
        return entries[0][0]

    sf = "/root/testdata/sf0.001"
    got = {r["file_key"]: r["file_hash"] for r in queries.merkle_file_hash(spark, sf).collect()}
    docs = queries.document_files(spark, sf).collect()
    for r in docs:
        data, at, entries = bytes(r["content"]), 0, []
        for end in chunking.cut_points(data, queries.LOW, queries.AVG, queries.HIGH):
            entries.append((slow(data[at:end], hashes.DATA_KEY), end - at))
            at = end
        if entries:
            assert got[r["file_key"]] == hashes.to_hex(slow(root(entries), bytes(32)))
    assert len(docs) == 200


def test_leaf_hash_column(spark):
    got = spark.createDataFrame([(bytearray(b"hello world"),), (None,)], "c binary").select(hashes.leaf_hash("c").alias("h")).select(hashes.hash_hex(F.col("h"))).collect()
    assert [r[0] for r in got] == ["4e39378b9d359f118190557a1f44130219a54e5fcfa07bd96cf50b466fe651b1", None]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 8, 100, 131_072])
def test_byte_grouping(n):
    data = bytes(i % 256 for i in range(n))
    assert codecs.ungroup_bytes(codecs.group_bytes(data)) == data
    if n == 8:
        assert codecs.group_bytes(bytes(range(1, 9))) == bytes((1, 5, 2, 6, 3, 7, 4, 8))


def test_lz4_block():
    assert codecs.lz4_block(bytes([0x50]) + b"hello", 100) == b"hello"
    assert codecs.lz4_block(bytes([0x34]) + b"abc" + bytes([3, 0]) + bytes([0x10]) + b"z", 100) == b"abcabcabcabz"
    assert codecs.lz4_block(bytes([0xF0, 5]) + b"x" * 20, 100) == b"x" * 20
    for bad in (bytes([0x14]) + b"a" + bytes([0, 0]), bytes([0x14]) + b"a" + bytes([9, 0]), bytes([0x50]) + b"he", bytes([0xF0]), bytes([0x1F]) + b"a" + bytes([1, 0, 255])):
        with pytest.raises(codecs.CodecError):
            codecs.lz4_block(bad, 100)
    with pytest.raises(codecs.CodecError):
        codecs.lz4_block(bytes([0x1F]) + b"a" + bytes([1, 0]) + b"\xff" * 50_000 + b"\0", 1000)


@pytest.mark.parametrize("n", [0, 1, 1000, 200_000])
def test_lz4_frame(n):
    data = (b"some repeated text, " * (n // 20 + 1))[:n]
    frame = codecs.lz4_compress(data)
    assert codecs.lz4_frame(frame, n) == data
    for size in (n + 1, max(0, n - 1)):
        if size != n:
            with pytest.raises(codecs.CodecError):
                codecs.lz4_frame(frame, size)
    with pytest.raises(codecs.CodecError):
        codecs.lz4_frame(b"\0" + frame[1:], n)
    stored = struct.pack("<IBBB", codecs.FRAME_MAGIC, 0x60, 0x40, 0) + struct.pack("<I", 0x80000000 | 5) + b"hello" + bytes(4)
    assert codecs.lz4_frame(stored, 5) == b"hello"


def test_payload_errors(spark):
    good = codecs.encode_payload(b"abcdefgh", codecs.GROUPED_LZ4)
    df = spark.createDataFrame([(bytearray(good), 2, 8), (bytearray(b"abc"), 0, 4), (bytearray(b"abc"), 9, 3), (bytearray(b"abc"), 1, 3), (None, 0, 0)], "p binary, s int, n int")
    got = [r.d for r in df.select(codecs.decoded("p", "s", "n").alias("d")).collect()]
    assert bytes(got[0].content) == b"abcdefgh" and got[0].error is None
    assert all(x.content is None and x.error for x in got[1:])


# --- chunking ------------------------------------------------------------------------------------------------------


def test_gear_table():
    g = chunking.gear_table()
    assert (hex(g[0]), hex(g[1]), hex(g[255])) == ("0x6e789e6aa1b965f4", "0x6c45d188009454f", "0xcbdc6d34b7c7534d")


@pytest.mark.parametrize("low, avg, high", [(4096, 65536, 262144), (256, 1024, 4096), (16, 64, 100), (5, 1024, 3000), (64, 64, 64)])
def test_cuts_equal_scalar_loop(low, avg, high):
    rng = random.Random(low)
    for data in (b"", b"x", rng.randbytes(50), rng.randbytes(5000), rng.randbytes(300_000), bytes(20_000), b"abcd" * 5000):
        want = chunking._scalar_cuts(data, low, chunking.mask_bits(avg), high, chunking.gear_table())
        assert chunking.cut_points(data, low, avg, high) == want


def test_edit_isolation_and_contiguity(spark):
    rng = random.Random(8)
    data = bytearray(rng.randbytes(2_000_000))
    changed = bytes(data[:1_000_000]) + rng.randbytes(256) + bytes(data[1_000_256:])
    df = spark.createDataFrame([("a", data), ("b", bytearray(changed)), ("none", None), ("empty", bytearray())], "file_key string, content binary")
    chunks = chunking.chunk_files(df).collect()
    of = {k: sorted((r["seq"], r["offset"], r["length"], bytes(r["data"])) for r in chunks if r["file_key"] == k) for k in ("a", "b", "none", "empty")}
    assert b"".join(x[3] for x in of["a"]) == bytes(data) and not of["none"] and not of["empty"]
    at = 0
    for _, offset, length, _ in of["b"]:
        assert offset == at and length <= chunking.MAX
        at += length
    shared = {x[3] for x in of["a"]} & {x[3] for x in of["b"]}
    assert shared and len(of["b"]) - len(shared) <= 4


# --- objects -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scheme", [0, 1, 2])
def test_object_round_trip(scheme):
    parts = [b"first chunk " * 50, b"second", bytes(5000)]
    body = objects.build(parts, scheme, with_footer=True)
    footer = objects.derive_footer(body)
    at = body.index(objects.IDENT)
    assert objects.parse_footer(body, at) == footer
    assert footer.boundaries[-1] == at and footer.unpacked == [600, 606, 5606]
    assert footer.object_hash == hashes.merkle_root([(h, len(p)) for h, p in zip(hashes.leaf_hashes(parts), parts)])


def test_malformed_objects(spark):
    body = objects.build([b"abc", b"defg"])
    bad = {"empty": b"", "cut": body[:-1], "tail": body + b"xy", "version": b"\1" + body[1:], "scheme": body[:4] + b"\x63" + body[5:]}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in {"good": body, **bad}.items()], "object_key string, body binary")
    got = {r["object_key"]: r for r in objects.object_footers(df).collect()}
    assert got["good"]["error"] is None and list(got["good"]["boundaries"]) == [11, 23]
    assert all(got[k]["error"] for k in bad)
    scanned = objects.scan_objects(df).collect()
    assert {(r["chunk_index"], r["uncompressed_length"]) for r in scanned if r["object_key"] == "good"} == {(0, 3), (1, 4)}
    whole = objects.footer_bytes(objects.derive_footer(body))
    for fault in (b"?" + whole[1:], whole[:-1], whole[:48] + struct.pack("<I", 2**32 - 1) + whole[52:]):
        with pytest.raises(objects.FormatError):
            objects.parse_footer(fault)


# --- shards --------------------------------------------------------------------------------------------------------


def sample_shard():
    h = lambda b: bytes([b]) * 32
    files = [shards.FileRecord(h(0xF1), [(h(0x11), 0, 200, 0, 2)], [h(0x77)], h(0x55)), shards.FileRecord(h(0xF2), [(h(0x11), 0, 100, 0, 1), (h(0x22), 0, 50, 0, 1)])]
    stored = [shards.ObjectRecord(h(0x11), [(h(0xA1), 0, 100, 0), (h(0xA2), 100, 100, 0)], 0, 200, 180), shards.ObjectRecord(h(0x22), [(h(0xA3), 0, 50, 0)], 0, 50, 50)]
    return files, stored


def test_shard_round_trip():
    files, stored = sample_shard()
    data = shards.write_shard(files, stored)
    s = shards.read_shard(data)
    assert [(f.file_hash, f.terms, f.verification, f.sha256) for f in s.files] == [(f.file_hash, f.terms, f.verification, f.sha256) for f in files]
    assert s.objects == stored and s.find_file(b"\xf2" * 32).terms == files[1].terms and s.find_object(b"\x00" * 32) is None
    assert s.footer["footer_offset"] == len(data) - 200 and s.footer["key_expiry"] == 2**64 - 1
    hit = shards.by_key(s.lookups["chunk"], b"\xa2" * 32)
    assert [(r["object_index"], r["chunk_index"]) for r in hit] == [(0, 1)] and not len(shards.by_key(s.lookups["chunk"], b"\x01" * 32))
    assert [int(x) for x in s.lookups["file"]["index"]] == [0, 4]
    plain = data[:40] + bytes(8) + data[48 : s.footer["file_lookup_offset"]]
    assert shards.read_shard(plain).objects == stored
    assert shards.read_shard(shards.write_shard([], [])).files == []


def test_shard_faults_and_frames(spark):
    files, stored = sample_shard()
    data = shards.write_shard(files, stored)
    hostile = data[:48] + data[48:84] + struct.pack("<I", 2**32 - 1) + data[88:]
    for bad in (b"", b"x" * 300, data[:100], hostile):
        with pytest.raises(shards.ShardError):
            shards.read_shard(bad)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(hostile)), ("c", None)], "shard_key string, body binary")
    rows = shards.shard_records(df)
    got = rows.groupBy("shard_key", "section").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("a", "term"): 3, ("a", "verification"): 1, ("a", "sha256"): 1, ("a", "object"): 2, ("a", "chunk"): 3, ("b", "error"): 1, ("c", "error"): 1}
    again = shards.read_shard(bytes(shards.write_shards(rows).collect()[0]["body"]))
    assert again.objects == stored and [f.terms for f in again.files] == [f.terms for f in files]


def test_digest_of_parts():
    from chunkyard.functions import blake

    rng = random.Random(7)
    for n in (0, 1, 1023, 1024, 1025, 2048, 5000, 70_000):
        data, state, at = rng.randbytes(n), blake.Keyed(hashes.DATA_KEY), 0
        while at < n:
            step = rng.randint(1, 3000)
            state.update(data[at : at + step])
            at += step
        assert state.digest() == blake.keyed_many([data], hashes.DATA_KEY)[0]


def test_objects_are_hashed_together(monkeypatch):
    rng, calls = random.Random(8), []
    many = [objects.build([rng.randbytes(rng.randint(1, 900)) for _ in range(rng.randint(1, 12))], rng.choice((0, 1, 2))) for _ in range(80)] + [b"", b"junk"]
    own = [objects.derive_footer(x) for x in many[:-2]]
    true = hashes.keyed_many
    monkeypatch.setattr(hashes, "keyed_many", lambda *a: calls.append(1) or true(*a))
    got = objects.derive_footers(many)
    assert got[:-2] == own and all(isinstance(x, objects.FormatError) for x in got[-2:])
    assert len(calls) <= 4  # the leaves and each level of the trees once, not once an object


def test_footers_with_bodies(spark):
    sent = [("a", bytearray(objects.build([b"one", b"two"], 1))), ("bad", bytearray(b"junk")), ("none", None)]
    df = spark.createDataFrame(sent, "object_key string, body binary")
    got = {r["object_key"]: r for r in objects.object_footers(df, with_body=True).collect()}
    assert {k: bytes(r["body"]) for k, r in got.items()} == {k: bytes(b or b"") for k, b in sent}
    assert bytes(got["a"]["object_hash"]) == objects.derive_footer(bytes(sent[0][1])).object_hash and got["bad"]["error"] and got["none"]["error"]


@pytest.mark.parametrize("footer", [False, True])
def test_objects_are_built_in_a_stream(spark, footer):
    rng = random.Random(9)
    rows = [(str(k) if k else None, i, bytearray(rng.randbytes(rng.randint(0, 50)))) for k in range(40) for i in range(k % 5 + 1)]
    rng.shuffle(rows)
    built = objects.build_objects(spark.createDataFrame(rows, "object_key string, seq int, data binary"), 1, footer)
    want: dict = {}
    for k, _, data in sorted(rows, key=lambda r: r[1]):
        want.setdefault(k, []).append(bytes(data))
    assert {r["object_key"]: bytes(r["body"]) for r in built.collect()} == {k: objects.build(v, 1, footer) for k, v in want.items()}
    assert "Pandas" not in built._jdf.queryExecution().executedPlan().toString()  # no call for each object


def shard_in_parts(key, body, step):
    cuts = range(0, len(body), step)
    return [(key, i, a == cuts[-1], bytearray(body[a : a + step])) for i, a in enumerate(cuts)]


def test_shards_written_in_parts():
    rng, w, out = random.Random(10), shards.PartWriter(), []
    rows = lambda n: np.frombuffer(rng.randbytes(32 * n), np.uint8).reshape(-1, 32)
    for n in (3, 1, 40):
        counts = np.array([rng.randint(0, 4) for _ in range(n)])
        out.append(w.files(rows(n), counts, rows(counts.sum()), np.arange(4 * counts.sum()).reshape(-1, 4), rows(n) if n > 1 else None))
    out.append(w.end_files())
    for n in (2, 9):
        counts = np.array([rng.randint(0, 3) for _ in range(n)])
        out.append(w.objects(rows(n), np.arange(3 * n).reshape(-1, 3), counts, rows(counts.sum()), np.arange(3 * counts.sum()).reshape(-1, 3)))
    data = b"".join([*out, w.end()])
    s = shards.read_shard(data)
    again = [shards.FileRecord(f.file_hash, f.terms, sha256=f.sha256) for f in s.files]
    assert len(s.files) == 44 and len(s.objects) == 11 and shards.write_shard(again, s.objects) == data


@pytest.mark.parametrize("step", [1, 47, 48, 1000, 10**6])
def test_shards_read_in_parts(spark, step):
    from chunkyard.operators import ingest

    rng = random.Random(11)
    h = lambda: rng.randbytes(32)
    files = [shards.FileRecord(h(), [(h(), 0, i, 0, i + 1) for i in range(k)], [h() for _ in range(k)] if k == 3 else [], h() if k % 2 else None) for k in (2, 1, 3, 0)]
    stored = [shards.ObjectRecord(h(), [(h(), i, 10, 0) for i in range(k)], 0, 5, 6) for k in (1, 3)]
    later = [shards.FileRecord(files[0].file_hash, [(h(), 0, 77, 0, 1)])]
    sound = shards.write_shard(files, stored)
    moved = bytearray(sound)
    moved[-200 + 16 : -200 + 24] = struct.pack("<Q", 48)  # says that its objects begin where its files do
    sent = [sound, shards.write_shard(later, stored), sound[:-300], b"junk", sound[:100], shards.write_shard([], []), bytes(moved)]
    parts = spark.createDataFrame([r for i, b in enumerate(sent) for r in shard_in_parts(str(i), b, step)], shards.PARTS).coalesce(1)
    got = ingest.ingest_shard_parts(parts)
    assert {r["upload"]: r["status"] for r in got.status.collect()} == {0: "ok", 1: "ok", 2: "malformed", 3: "malformed", 4: "malformed", 5: "ok", 6: "malformed"}
    want = ingest.ingest_shards(spark.createDataFrame([(i, bytearray(sent[i])) for i in (0, 1, 5)], "upload bigint, body binary"))
    both = lambda name: [sorted(map(repr, getattr(x, name).collect())) for x in (got, want)]
    for name in ("terms", "bridge", "chunk_index", "hashes"):
        ours, theirs = both(name)
        assert ours == theirs and ours
    assert b"".join(bytes(r["body"]) for r in sorted(got.bodies.collect(), key=lambda r: r["part"]) if bytes(r["shard_hash"]) == hashes.leaf_hashes([sound])[0]) == sound

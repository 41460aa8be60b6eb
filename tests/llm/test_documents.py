"""Operators over documents: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns; brute force."""

import hashlib
import os
import platform
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkyard.llm import exact_dedup, licenses, mixing, near_dedup, packing, queries, token_files, tokens, toxicity
from chunkyard.llm.components import components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = words(rng, 60)
    out = [(0, None, "en", "a"), (1, "", "en", "a"), (2, "", None, None), (3, "Only three words", "en", "b"), (4, "only THREE words", "en", "b"), (5, base, "en", "a"), (6, base.upper(), "en", "a")]
    for i in range(7, 40):  # near copies of one base and of each other
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append((i, " ".join(w), "en", "a"))
    out += [(i, words(rng, rng.randrange(1, 90)), "de", f"s{i % 3}") for i in range(40, 90)]
    out.append((90, words(rng, 30_000, 5000), "en", "long"))
    out.append((91, "é́ ÀB <|endoftext|> I'll 12.5 x y Σ. ΟΔΟΣ!!", "el", "a"))
    out += [out[5], out[5]]  # repeated rows
    return [(a, b, c, d, len(b) if b else None) for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Extra columns with names that operators use."""
    names = ["rep", "node", "component", "group", "bands", "kept", "keep_id", "length", "rank", "task", "copy", "score", "hits", "words", "n", "_cy_id", "key"]
    return docs.select("*", *(F.lit("x").alias(n) for n in names))


# --- packing -------------------------------------------------------------------------------------------------------


def check_packing(out, rows, capacity):
    t = Tokenizer.from_file(WORD_BPE)
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[a : a + capacity], "<u4")
            want[doc].append((k, a, len(part), zlib.crc32(part.tobytes())))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [x[2] for v in want.values() for x in v]
    plain = sum(c for c, _ in packing.plan_best_fit(np.bincount(lengths, minlength=capacity + 1), capacity))
    assert -(-sum(lengths) // capacity) <= len(bins) <= plain
    return len(bins) - -(-sum(lengths) // capacity)


def test_packing(docs, rows):
    assert check_packing(queries.packed(clashing(docs)).collect(), rows, 4096) == 0
    check_packing(queries.packed(docs, capacity=64).collect(), rows, 64)


def test_packing_empty(empty):
    assert queries.packed(empty).count() == 0


def optimum(lengths, capacity):
    """Fewest bins by exhaustive search."""
    best = [len(lengths)]
    order = sorted(lengths, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(order):
            best[0] = len(bins)
            return
        for room in {*bins}:
            if room >= order[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - order[i]])
        place(i + 1, [*bins, capacity - order[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_against_brute_force(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 21) for _ in range(10)]
    counts = np.bincount(lengths, minlength=21)
    plan = packing.plan_completion(counts, 20)
    used = np.zeros(21, int)
    for copies, pattern in plan:
        assert sum(x * k for x, k in pattern) <= 20
        for x, k in pattern:
            used[x] += copies * k
    assert (used == counts).all()
    assert sum(c for c, _ in plan) == optimum(lengths, 20)


def test_bin_completion_branches():
    # Best-fit decreasing takes 4 bins here, and so does a single filling per longest item.
    counts = np.bincount([1843, 1843, 1638, 1638, 1433, 1228, 1228, 1024], minlength=4097)
    assert sum(c for c, _ in packing.plan_best_fit(counts, 4096)) == 4
    assert sum(c for c, _ in packing.plan_completion(counts, 4096)) == 3
    assert sum(c for c, _ in packing.plan_completion(np.bincount([3, 4, 4, 6, 6, 8, 8, 8, 9, 10, 13], minlength=21), 20)) == 4


def test_bin_completion_says_where_it_stopped(caplog):
    counts = np.bincount([1843, 1843, 1638, 1638, 1433, 1228, 1228, 1024], minlength=4097)
    assert sum(c for c, _ in packing.plan_completion(counts, 4096, nodes=1)) == 4 and "lower bound is 3" in caplog.text
    caplog.clear()
    assert sum(c for c, _ in packing.plan_completion(counts, 4096, nodes=None)) == 3 and not caplog.text


@pytest.mark.parametrize("seed", range(60))
def test_bin_completion_is_optimal(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50, 100])
    lengths = [rng.randrange(capacity // 5, capacity // 2 + 2) for _ in range(10)]
    counts = np.bincount(lengths, minlength=capacity + 1)
    assert packing.lower_bound(counts, capacity) <= optimum(lengths, capacity)
    assert sum(c for c, _ in packing.plan_completion(counts, capacity)) == optimum(lengths, capacity)


def test_filling_of_many_tiny_items():
    counts = np.zeros(4097, int)
    counts[1], counts[4000] = 50_000, 3
    assert sum(c for c, _ in packing.plan_completion(counts, 4096)) == -(-(50_000 + 12_000) // 4096)


# --- tokens --------------------------------------------------------------------------------------------------------


def test_encoder_equals_library(rows):
    t, enc = Tokenizer.from_file(WORD_BPE), tokens.encoder(WORD_BPE)
    assert enc.by_piece
    extra = ["x<|startoftext|>y <|ENDOFTEXT|>", "İstanbul ǅ ß \x1c a\x85b ﻿ z", "가나 ᄀ ᅡ", "' s 'S 'LL don't", "Naïve, ÉTÉ. ÿ ý; œuvre"]
    for text in [r[1] or "" for r in rows] + extra:
        assert np.frombuffer(enc.ids(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_survives_full_tables(monkeypatch, rows):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    enc, t = tokens.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for r in rows:
        assert np.frombuffer(enc.ids((r[1] or "").encode()), "<u4").tolist() == t.encode(r[1] or "", add_special_tokens=False).ids


@pytest.mark.parametrize("most", [20, 600_000])
def test_encoder_of_batches(monkeypatch, rows, most):
    """A batch's new words take one call of the model, and the ids are the library's, beside marks, signs and added tokens too."""
    monkeypatch.setattr(tokens, "CACHE_PIECES", most)
    enc, t = tokens.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    odd = ["H\u0331 T\u0308a W\u0344 J\u030c \u212a\u0331", "ab.&&& Ab*** ab,\u00bf ab's ab<| \u00c9T\u00c9!!", "x<|EndOfText|>y <|endoftext|>Z", "  \tTwo \x0b\x0c\r\n spaces\u00a0x\u2003Y\x1c ", "\u0130 \u03a3\u03a3 \u1e9e\u00df A\u00d7b", "W" * 3000]
    texts = ["not in the slice", None, "", " ", *odd, *(r[1] for r in rows), *odd]
    calls, encode = [], enc.model.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(texts)
            return encode(texts, **options)

    enc.model = Counted()
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc.batch(pa.array(texts, pa.string()).slice(1))]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts[1:]]
    assert len(calls) == (1 if most > 20 else 2)
    assert enc.batch(pa.array(["not in the slice", "a B", "c"]).slice(1)) == [enc.ids(b"a B"), enc.ids(b"c")]
    assert enc.batch(pa.array([None], pa.string())) == [b""] and enc.batch(pa.array([], pa.string())) == []


def test_encoder_in_parts(monkeypatch, rows):
    """However few words and bytes go at once, and whenever memory is given back, the ids are the library's; no call of a model takes more words."""
    monkeypatch.setattr(tokens, "LEARN_PIECES", 7)
    monkeypatch.setattr(tokens, "PART_BYTES", 100)
    monkeypatch.setattr(tokens, "GIVE_BACK_BYTES", 500)
    enc, t = tokens.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    most, part = [], enc._part

    class Counted:
        def __init__(self, of):
            self.of = of

        def encode_batch_fast(self, texts, **options):
            most.append(max(len(texts), len(texts[0].split())))
            return self.of.encode_batch_fast(texts, **options)

    enc.model, enc.tokenizer = Counted(enc.model), Counted(enc.tokenizer)
    sizes = []
    enc._part = lambda texts: sizes.append(len("".join(texts.to_pylist()[:-1]).encode())) or part(texts)
    rng = random.Random(2)
    texts = [None, *(r[1] for r in rows), "", *(" ".join("".join(rng.choices("abcdé", k=6)) for _ in range(40)) + "." for _ in range(30)), ""]
    got = [np.frombuffer(x, "<u4").tolist() for x in enc.batch(pa.array(texts, pa.string()))]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert max(most) <= 2 * 7 and max(sizes) < 100  # a word may have signs after it


HELD = """
import random, re, sys
import pyarrow as pa
from chunkyard.llm import common, tokens

held = lambda: int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
enc = tokens.encoder(sys.argv[1])
enc.batch(pa.array(["some words"]))
rng, before = random.Random(1), held()
texts = (" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(20)) for _ in range(6000))
for batch in common.giving_back(iter([pa.array(texts, pa.string())])):
    enc.batch(batch)
del batch
print(held() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux") or platform.libc_ver()[0] != "glibc", reason="freed memory goes back with glibc only")
def test_encoder_holds_little_between_tasks():
    """Of what 120,000 new words took, a Python worker keeps only their ids when the task is over."""
    out = subprocess.run([sys.executable, "-c", HELD, WORD_BPE], capture_output=True, text=True, check=True, timeout=300, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(out.stdout) < 40


def test_other_tokenizers_run_on_whole_texts():
    file = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokens.Encoder(file)
    assert not enc.by_piece
    assert np.frombuffer(enc.ids(b"two  words"), "<u4").tolist() == Tokenizer.from_file(file).encode("two  words", add_special_tokens=False).ids


# --- token files ---------------------------------------------------------------------------------------------------


def test_token_files(docs, rows, spark):
    manifest = token_files.write_token_files(clashing(docs), WORD_BPE, vocab_size=49_408, shard_bytes=20_000)
    assert manifest.count() > 1
    out = sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_files.read_token_files(manifest).collect())
    t = Tokenizer.from_file(WORD_BPE)
    at = 0
    for (doc, text, *_), got in zip(sorted(rows, key=lambda r: r[0]), out):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got == (doc, at, len(ids), np.asarray(ids, "<u4").tobytes())
        at += len(ids)
    assert len(out) == len(rows)
    row = next(r for r in manifest.collect() if r["low"] <= 45 <= r["high"])
    shard = token_files.Shard(row["file"])
    assert shard.get(45).tolist() == [*t.encode(dict((r[0], r[1]) for r in rows)[45], add_special_tokens=False).ids, 2]
    assert shard.get(10**12) is None


def test_token_files_encode_batches():
    class Batches:
        def batch(self, texts):
            return [b"" if x is None else x.encode() * 4 for x in texts.to_pylist()]

    batch = pa.RecordBatch.from_arrays([pa.array([None, 1, 1], pa.int64()), pa.array(["a", None, "bc"])], ["doc_id", "text"])
    assert list(token_files._encoded(iter([batch]), Batches(), b"end.")) == [(None, b"aaaaend."), (1, b"end."), (1, b"bcbcbcbcend.")]


def test_token_files_nulls_and_empty(spark, empty):
    assert token_files.read_token_files(token_files.write_token_files(empty, WORD_BPE)).count() == 0
    d = spark.createDataFrame([(None, "a b", None, None, None), (1, None, None, None, None)], SCHEMA)
    assert sorted((r["doc_id"] or -1, r["start"], r["n_tokens"]) for r in token_files.read_token_files(token_files.write_token_files(d, WORD_BPE)).collect()) == [(-1, 0, 3), (1, 3, 1)]


def test_token_files_order_and_extreme_ids(spark):
    rng = random.Random(8)
    data = [(None, "a b"), (None, None), (None, "a b"), (-(2**63), "least"), (2**63 - 1, "most"), (0, "zero"), (0, "zero"), (0, "other")] + [(i, words(rng, 40)) for i in range(5, 60)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in data], SCHEMA).repartition(4)
    manifest = token_files.write_token_files(d, WORD_BPE, shard_bytes=500).withColumn("shard", F.col("shard") + 999_996)  # as many digits as a very large corpus has
    out = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None] * 3 + sorted(i for i, _ in data if i is not None)
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    first = min(manifest.collect(), key=lambda r: r["shard"])
    shard = token_files.Shard(first["file"])
    assert shard.get(None, 0) is not None and shard.get(None, 0).tolist()[-1] == 2
    assert token_files.Shard(next(r["file"] for r in manifest.collect() if r["low"] == -(2**63))).get(-(2**63)).tolist() == [*Tokenizer.from_file(WORD_BPE).encode("least", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash(n):
    h = token_files.key_hash(np.arange(n) * 7 - 3, np.zeros(n, np.int64))
    index = token_files.PerfectHash.build(h)
    sizes, todo = [], n
    for bits in index.levels:
        sizes.append(max(64, int(todo * 2.0)))
        todo -= int(np.bitwise_count(bits).sum())
    assert sorted(index.slots(h, sizes).tolist()) == list(range(n))


# --- exact dedup ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(docs, rows, keep):
    groups = defaultdict(list)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for doc, text, *_ in rows:
        groups[low(text)].append(doc)
    pick = min if keep == "smallest" else max
    want = sorted((doc, pick(groups[low(t)]), len(groups[low(t)]), doc == pick(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for doc, t, *_ in rows)
    assert sorted(map(tuple, exact_dedup.exact_groups(clashing(docs), keep).collect())) == want


def test_exact_groups_edges(spark, empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    d = spark.createDataFrame([(None, "A", None, None, None), (None, "a", None, None, None), (3, "b", None, None, None), (None, "B", None, None, None)], SCHEMA)
    got = {(r["doc_id"], r["text_sha256"][:2], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(d).collect()}
    a, b = hashlib.sha256(b"a").hexdigest()[:2], hashlib.sha256(b"b").hexdigest()[:2]
    assert got == {(None, a, None, 2, True), (3, b, 3, 2, True), (None, b, 3, 2, False)}


def test_drop_copies_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert 6 not in {r["doc_id"] for r in kept.collect()} and {0, 3, 5} <= {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_drop_copies_decides_by_row(spark, keep):
    data = [(1, "b"), (5, "B"), (5, "a"), (9, "c"), (9, "c"), (9, "c"), (9, "C"), (None, "d"), (None, "D"), (None, "b"), (7, None), (7, "")]
    d = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(data)], SCHEMA).repartition(3)
    got = sorted((r["doc_id"] or -1, r["text"], r["source"]) for r in exact_dedup.drop_copies(d, keep).collect())
    b = (1, "b", "s0") if keep == "smallest" else (5, "B", "s1")
    assert got == sorted([b, (5, "a", "s2"), (9, "C", "s6"), (-1, "D", "s8"), (7, None, "s10")], key=lambda r: (r[0], r[1] or ""))


@pytest.mark.parametrize("most", [1 << 30, 2000])
def test_trie_against_dict(most, tmp_path):
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(3000)] + [b"", b"x" * 3000]
    trie, want = exact_dedup.PatriciaTrie(most, f"file://{tmp_path}"), {}
    for i, k in enumerate(keys):
        trie.insert(k, (i, i, 1, k.hex()))
        low, high, n, h = want.get(k, (i, i, 0, k.hex()))
        want[k] = (min(low, i), max(high, i), n + 1, h)
    assert dict(trie.items()) == want
    assert not list(tmp_path.rglob("*-*-*"))


def test_trie_keeps_its_bound(tmp_path):
    # Strings with a long common prefix, then others that leave it early.
    keys = [b"shared prefix" + i.to_bytes(4, "big") + bytes(80) for i in range(6000)] + [i.to_bytes(4, "big") * 25 for i in range(500)]
    trie = exact_dedup.PatriciaTrie(50_000, f"file://{tmp_path}")
    for i, k in enumerate(keys):
        trie.insert(k, (i, i, 1, ""))
    assert dict(trie.items()) == {k: (i, i, 1, "") for i, k in enumerate(keys)}
    assert trie.peak <= 51_000


def test_exact_groups_with_spills(docs, rows):
    whole = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, trie_bytes=50).collect())) == whole


# --- near dedup ----------------------------------------------------------------------------------------------------


def brute_near(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


@pytest.mark.parametrize("block, most", [(1000, 20), (4, 20), (3, 1)])
def test_near_groups_against_brute_force(docs, rows, block, most):
    want = brute_near(rows)
    got = near_dedup.near_groups(clashing(docs), block, most).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_near_groups_edges(spark, empty):
    assert near_dedup.near_groups(empty).count() == 0
    text = "one two three four five six seven"
    d = spark.createDataFrame([(None, text, None, None, None), (7, text, None, None, None), (8, None, None, None, None), (None, "", None, None, None)], SCHEMA)
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in near_dedup.near_groups(d).collect()) == [(-1, 0, -1, True), (-1, 3, 7, True), (7, 3, 7, True), (8, 0, 8, True)]


@pytest.mark.parametrize("block, most", [(1000, 20), (4, 20), (3, 1)])
def test_near_groups_split_clusters(spark, block, most):
    """Groups whose members are near each other but not all near one centre, chained by common passages, with outliers."""
    rng = random.Random(9)
    out = []
    for g in range(4):
        text = words(rng, 90, 3000).split()
        for _ in range(24):
            text = text[:]
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"y{rng.randrange(9999)}"
            out.append(" ".join(text))
        out += [" ".join(text[:55] + words(rng, 35, 3000).split()) for _ in range(12)]  # share a passage, but are no near copies
    rows = [(7 * i + 3, t, None, None, None) for i, t in enumerate(out)]
    rng.shuffle(rows)
    want = brute_near(rows)
    got = near_dedup.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), block, most).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert 4 < len({c for _, c, _ in want.values()}) < len(rows)


def test_drop_near_copies_decides_by_row(spark):
    rng = random.Random(3)
    b, a, c = (words(rng, 60, 4000) for _ in range(3))
    near_a = a + " tail"
    data = [(1, b), (5, b), (5, a), (9, c), (9, c), (9, c.upper()), (None, a), (None, "only null ids"), (None, "only null ids"), (5, near_a), (7, None), (7, ""), (7, ""), (-3, c + " x"), (-(2**63), "least id of all")]
    d = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(data)], SCHEMA).repartition(3)
    kept = near_dedup.drop_near_copies(clashing(d))
    assert kept.columns == clashing(d).columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    first = min((a, near_a), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert got == sorted([(False, 1, b), (False, 5, first), (False, -3, c + " x"), (True, 0, "only null ids"), (False, 7, ""), (False, 7, ""), (False, 7, ""), (False, -(2**63), "least id of all")])


def test_drop_near_copies_of_plain_ids(docs, rows, empty):
    want = brute_near(rows)
    unique = docs.dropDuplicates(["doc_id"])
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_copies(unique).collect()) == sorted(d for d, (n, c, k) in want.items() if k)
    assert near_dedup.drop_near_copies(empty).count() == exact_dedup.drop_copies(empty).count() == 0


def test_nodes_keep_the_order_of_ids(spark):
    ids = [None, -(2**63), -5, 0, 7, 2**63 - 1]
    d = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", near_dedup.node_of(F.col("i"), F.lit(b"k")).alias("node"))
    assert [r["i"] for r in d.orderBy("node").collect()] == ids[1:] + [None]
    assert all(r["i"] == r["back"] for r in d.select("i", near_dedup.doc_id_of(F.col("node")).alias("back")).collect())


def test_components_of_hot_nodes(spark, monkeypatch):
    from chunkyard.llm import components as module

    monkeypatch.setattr(module, "HOT_LINKS", 3)
    links = [(0, i) for i in range(1, 60)] + [(1000, i) for i in range(300, 360)] + [(59, 2000), (2000, 300)] + [(5000, 5001)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in [*range(60), *range(300, 360), 1000, 2000]} | {5000: 5000, 5001: 5000}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1200).astype(np.uint64)
    b = np.concatenate([a[:1000], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (near_dedup.signature(np.unique(a), 1024) == near_dedup.signature(np.unique(b), 1024)).mean()
    assert abs(same - 1000 / 1400) < 0.06


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 900: 5, 7: 5}


# --- licences ------------------------------------------------------------------------------------------------------


def test_licenses(spark, empty):
    full = licenses.TEMPLATES["MIT-text"]
    changed = full.replace("obtaining", "getting").replace("persons", "people")
    texts = [None, "", "too short", "aaa " * 50 + "Released under the MIT License. bbb", "x\n" + changed + "\ny", full[: len(full) // 2], "Licensed under CC\tBY-NC 4.0!", full + " " + licenses.TEMPLATES["Apache-2.0-notice"], licenses.TEMPLATES["BSD-2-Clause-text"], "z " * 40_000 + licenses.TEMPLATES["BSD-3-Clause-text"]]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    want = set()
    for i, t in enumerate(texts):
        own = set(licenses.template_shingles(t or ""))
        for name, body in licenses.TEMPLATES.items():
            s = set(licenses.template_shingles(body))
            if 100 * len(own & s) >= 75 * len(s) and name != ("BSD-2-Clause-text" if "endorse" in (t or "") else "BSD-3-Clause-text"):
                want.add((i, name, len(own & s), len(s)))
    got = licenses.scan_licenses(clashing(d)).collect()
    assert {(r["doc_id"], r["license"], r["n_matched"], r["n_template"]) for r in got} == want and len(want) >= 5
    assert next(r["first_word"] for r in got if r["doc_id"] == 3) == 50
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_of_repeated_rows_and_long_texts(spark):
    body = licenses.TEMPLATES["GPL-3.0-notice"]
    rows = [(None, body, None, None, None), (1, body, None, None, None), (1, body, None, None, None), (2, "w " * 100_000 + body + " w" * 100_000, None, None, None), (3, "w " * 200_000, None, None, None)]
    got = sorted((r["doc_id"] or -1, r["license"], r["first_word"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, "GPL-3.0-notice", 0), (1, "GPL-3.0-notice", 0), (1, "GPL-3.0-notice", 0), (2, "GPL-3.0-notice", 100_000)]


def test_license_recall_under_edits(spark):
    """Long notices with words changed, dropped and added at every rate up to a quarter: of those that still hold 75 % of the shingles, at least 0.9 are found."""
    rng = random.Random(12)
    rows, want = [], set()
    for name, body in licenses.TEMPLATES.items():
        s = set(licenses.template_shingles(body))
        if len(s) < licenses.WINDOW or name == "BSD-3-Clause-text":
            continue
        for k in range(60):
            rate, out = 0.25 * k / 60, words(rng, rng.randrange(60)).split()
            for w in body.split():
                kind = rng.random() / max(rate, 1e-9)
                out += [w] if kind >= 1 else [f"q{rng.randrange(99)}"] if kind < 0.5 else [] if kind < 0.75 else [w, "extra"]
            text = " ".join(out + words(rng, rng.randrange(60)).split())
            rows.append((len(rows), text, None, None, None))
            if 100 * len(set(licenses.template_shingles(text)) & s) >= 75 * len(s):
                want.add((rows[-1][0], name))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(want) >= 30 and len(got & want) >= 0.9 * len(want)
    assert {x for x in got - want if len(licenses.template_shingles(licenses.TEMPLATES[x[1]])) >= licenses.WINDOW} == set()


# --- mixing --------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, empty):
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r["doc_id"], r["copy"], r["mix_key"]) for r in out) == sorted((r["doc_id"], r["copy"], r["mix_key"]) for r in again)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_weights(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, F.lit(None)).otherwise("big").alias("source"))
    out = {r["source"]: r["n"] for r in mixing.mix(d, {"rare": 3.0, "big": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(out) == {"rare", "big"} and abs(out["rare"] - 4500) < 300 and abs(out["big"] - 1500) < 150
    means = mixing.mix(d, {"rare": 1.0}).groupBy("doc_id").count().select("count").collect()
    counts = np.array([r["count"] for r in means])
    assert abs(counts.mean() - 10) < 0.5 and abs(counts.var() - 10) < 2.5
    many = mixing.mix(d.filter("doc_id < 1000"), {"rare": 1.0}).count()
    assert abs(many - 1000) < 150


# --- toxicity ------------------------------------------------------------------------------------------------------


def toxic_corpus(n=1500):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 120), 3000).translate(str.maketrans("0123456789", "abcdefghij")).split()
        toxic = i % 9 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vileness", "Grubby!", "rotter"]))
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None, None, None, None), (5001, "", None, None, None), (None, "vileness rotter", None, None, None)]
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(clashing(d), lab)
    scored = toxicity.score_toxicity(clashing(d), model, "tox").collect()
    truth = dict(labels)
    held = [r for r in scored if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all((r["tox"] >= 0.7) == truth[r["doc_id"]] for r in held) and len(held) > 300
    assert all(0 <= r["tox"] <= 1 for r in scored) and len(scored) == len(rows)
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and 1 in {r["doc_id"] for r in kept.collect()}


def test_toxicity_ignores_held_out_labels(spark):
    rows, labels = toxic_corpus(600)
    d = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    fit = lambda x: toxicity.fit_toxicity(d, spark.createDataFrame(x, "doc_id bigint, toxic int"))
    a, b = fit(labels), fit(flipped)
    assert a.weights == b.weights and a.offset == b.offset


def test_toxicity_fit_equals_one_process(spark):
    """The fit over executors against the same by plain loops: equal weights, with repeated rows, nulls and a very long text."""
    rows, labels = toxic_corpus(500)
    rng = random.Random(4)
    rows += [(600, words(rng, 60_000, 9000) + " vileness grubby", None, None, None), (601, None, None, None, None), rows[9], rows[9]]
    labels += [(600, 1), (601, 0), labels[9], labels[9]]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    texts = defaultdict(list)
    for i, t, *_ in rows:
        texts[i].append(t)
    positive = {t for i, y in train if y for t in texts[i]}
    ordered = sorted(positive, key=lambda t: toxicity.sketch(toxicity.words_of(t)))
    plain = toxicity.ToxicityModel.of_texts(ordered, [t for i in {i for i, _ in train} for t in texts[i]], toxicity.smoothed(sum(y for _, y in train), len(train)))
    assert model.weights.keys() == plain.weights.keys() and len(plain.weights) > 3
    assert all(abs(w - plain.weights[f]) < 1e-3 for f, w in model.weights.items()) and abs(model.offset - plain.offset) < 1e-3


def test_risk_and_gradient_against_brute_force():
    rng = np.random.default_rng(5)
    pos, unl = rng.integers(0, 2, (7, 3)).astype(float), rng.integers(0, 2, (11, 3)).astype(float)
    pos_n, unl_n, prior = rng.integers(1, 4, 7), rng.integers(1, 4, 11), 0.3
    rows = lambda x, n: [r for r, k in zip(x.tolist(), n.tolist()) for _ in range(k)]

    def slow(w):
        f = lambda r: sum(a * b for a, b in zip(r, w)) + w[-1]
        loss = lambda z: float(np.log(1 + np.exp(-z)))
        p, u = rows(pos, pos_n), rows(unl, unl_n)
        mean = lambda xs: sum(xs) / len(xs)
        return prior * mean([loss(f(r)) for r in p]), mean([loss(-f(r)) for r in u]) - prior * mean([loss(-f(r)) for r in p])

    for _ in range(5):
        w = rng.normal(size=4)
        positive, bracket, g_pos, g_bracket = toxicity.risk(w, pos, unl, pos_n, unl_n, prior)
        assert np.allclose((positive, bracket), slow(w))
        for j in range(4):
            step = np.eye(4)[j] * 1e-5
            up, down = slow(w + step), slow(w - step)
            assert np.allclose((g_pos[j], g_bracket[j]), ((up[0] - down[0]) / 2e-5, (up[1] - down[1]) / 2e-5), atol=1e-6)


def test_non_negative_fit_takes_equal_rows_together():
    rng = np.random.default_rng(6)
    pos, unl = rng.integers(0, 2, (40, 3)).astype(float), (rng.random((200, 3)) < 0.2).astype(float)
    w = np.zeros(4)
    w[-1], m, v = np.log(0.2 / 0.8), 0.0, 0.0
    for t in range(1, 301):  # row by row
        _, bracket, g_pos, g_bracket = toxicity.risk(w, pos, unl, np.ones(40), np.ones(200), 0.2)
        g = (g_pos + g_bracket if bracket >= 0 else -g_bracket) + toxicity.DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got, offset = toxicity.non_negative_fit(pos, unl, 0.2, steps=300)
    assert np.allclose([*got, offset], w, atol=1e-6)


def test_toxicity_edges(spark, empty):
    rows, labels = toxic_corpus(300)
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    d = spark.createDataFrame([*rows, (9, "vileness " * 3, None, None, None), (700, words(random.Random(1), 40_000, 900), None, None, None)], SCHEMA)
    model = toxicity.fit_toxicity(clashing(d), lab)
    assert toxicity.score_toxicity(clashing(empty), model, "tox").count() == 0 and toxicity.drop_toxic(empty, lab).count() == 0
    out = toxicity.score_toxicity(clashing(d), model, "tox")
    assert out.columns == [*clashing(d).columns, "tox"] and out.filter("doc_id = 9").count() == 2 and out.filter("tox is null").count() == 0
    kept = toxicity.drop_toxic(clashing(d), lab)
    assert kept.columns == clashing(d).columns
    all_toxic = toxicity.fit_toxicity(d, spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id bigint, toxic int"))
    assert 0 <= all_toxic.score("x") <= 1


def test_toxicity_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(empty, none)
    assert toxicity.score_toxicity(empty, model).count() == 0 and 0 <= model.score("x") < 0.7

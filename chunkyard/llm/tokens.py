"""Whole-text token ids of a `tokenizers` vocabulary, as little-endian unsigned 32-bit bytes.

A vocabulary whose pre-tokenizer never matches white space encodes a text as the concatenation of its
white-space-separated pieces, so pieces are encoded once and looked up afterwards, a batch of texts at a time in Arrow.
`piecewise` checks that the tokenizer is of that kind; others are run on whole texts. New pieces of plain Latin letters go
to the tokenizer's model all together, without the normalizer, which gives the same ids. Null and empty texts have no ids.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chunkyard.llm.common import give_back

#: Pieces kept per Python worker; beyond that the half used least is dropped. This changes speed only.
CACHE_PIECES = 600_000
#: New pieces that go to the tokenizer at once, bytes of text looked up at once (a longer text alone), and bytes after which freed memory
#: goes back to the system: an executor's workers share its memory, and the tokenizer takes many times what it is given. No ids depend on these.
LEARN_PIECES, PART_BYTES, GIVE_BACK_BYTES = 4096, 3 << 20, 4 << 20


def piecewise(spec: dict) -> bool:
    """Whether no token can span white space: kept matches of a split that excludes it, and a normalizer that works within pieces."""
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    first = parts[0] if parts else {}
    drops_space = (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first.get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    )
    norm = spec.get("normalizer") or {"normalizers": []}
    plain = all(
        x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ")
        for x in norm.get("normalizers", [norm])
    )
    added = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    return drops_space and plain and added and not spec.get("post_processor")


def byte_signs() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary, as a table for str.translate of Latin-1 text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Precomposed Latin letters, and ASCII signs but for the apostrophe. Normalizing a word of these letters is lower-casing; signs after it have tokens of their own.
LETTERS, SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
#: Marks beside which letters may be composed in one case only.
MARKS = "[\u0300-\u037f]"


def unsliced(texts: pa.Array) -> pa.Array:
    """A slice of large strings on its own: ascii_lower misreads slices."""
    return pa.concat_arrays([texts, pa.array([], pa.large_string())])


def plain_model(spec: dict) -> dict | None:
    """The tokenizer without its normalizer, for lower-cased words and runs of signs in byte signs with spaces between; None where that could give
    other ids, or where a word's last token couldn't be told from others."""
    model, norm, pre = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    end, level = model.get("end_of_word_suffix"), pre.get("pretokenizers", [])[1:]
    lowers = any(x["type"] == "Lowercase" for x in norm.get("normalizers", [norm] if norm else []))
    as_bytes = len(level) == 1 and level[0]["type"] == "ByteLevel" and not level[0]["add_prefix_space"] and not level[0].get("use_regex", True)
    bpe = model.get("type") == "BPE" and bool(end) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    signs_free = all(any(c.isalpha() for c in t["content"]) for t in spec.get("added_tokens", []))  # none can be among the signs after a word
    if not (lowers and as_bytes and bpe and signs_free and all(c + x in model["vocab"] for c in byte_signs().values() for x in ("", end))):
        return None
    return {**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}


class Encoder:
    """ids(text bytes) -> bytes of little-endian uint32 ids; batch(texts) -> those of each text."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = piecewise(spec)
        self.keys, self.values, self.used = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)
        plain = plain_model(spec) if self.by_piece else None
        self.model = Tokenizer.from_str(json.dumps(plain)) if plain else None
        if plain:
            vocab = spec["model"]["vocab"]
            self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
            self.last[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
            self.signs = {k: v for k, v in byte_signs().items() if k != 32}
            self.as_written = "|".join([MARKS, *(re.escape(t["content"].lower()) for t in spec.get("added_tokens", []))])
        self.encoded = 0  # bytes of text since memory was given back
        del spec, plain
        give_back()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces of LETTERS, maybe with SIGNS after them."""
        tailed = pc.match_substring_regex(pieces, f"[{SIGNS}]$")
        apart = pc.replace_substring_regex(pieces, f"([{SIGNS}]+)$", r" \1")
        spaced = pc.binary_join_element_wise(apart, *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
        text = spaced.buffers()[2].to_pybytes()[: np.frombuffer(spaced.buffers()[1], np.int64)[len(spaced)]].decode()
        signs = text.lower().encode().decode("latin-1").translate(self.signs)
        ids = np.asarray(self.model.encode_batch_fast([signs], add_special_tokens=False)[0].ids, "<u4")
        ends, upto = np.flatnonzero(self.last[ids]) + 1, np.cumsum(1 + tailed.to_numpy(zero_copy_only=False))
        if len(ends) != upto[-1]:
            raise ValueError(f"{upto[-1]} words have {len(ends)} last tokens")
        cuts = np.concatenate([[0], 4 * ends[upto - 1]]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Adds new pieces, each of them once; returns their rows."""
        simple = pc.match_substring_regex(pieces, f"^[{LETTERS}]+[{SIGNS}]*$") if self.model else pa.array(np.zeros(len(pieces), bool))
        words, others = pieces.filter(simple), pieces.filter(pc.invert(simple))
        keys, values = [self.keys, words, others], [self.values]
        for at in range(0, len(words), LEARN_PIECES):
            values.append(self._words(unsliced(words.slice(at, LEARN_PIECES))))
        for at in range(0, len(others), LEARN_PIECES):
            values.append(pa.array(self._encode(others.slice(at, LEARN_PIECES).to_pylist()), pa.large_binary()))
        first = simple.to_numpy(zero_copy_only=False)
        rows = len(self.keys) + np.where(first, np.cumsum(first) - 1, len(words) + np.cumsum(~first) - 1)
        self.keys, self.values = pa.concat_arrays(keys), pa.concat_arrays(values)
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])
        return rows

    def _drop(self) -> None:
        """Keeps the half used most lately and often."""
        kept = np.sort(np.argsort(self.used, kind="stable")[len(self.used) - CACHE_PIECES // 2 :])
        self.keys, self.values, self.used = self.keys.take(pa.array(kept)), self.values.take(pa.array(kept)), self.used[kept] // 2

    def batch(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(unsliced(texts.cast(pa.large_string())), "")
        sizes = pc.binary_length(texts).to_numpy()
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES)) + 1
        out: list[bytes] = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
            part = unsliced(texts.slice(a, b - a)) if len(cuts) else texts
            out += self._part(part) if self.by_piece else self._encode(part.to_pylist())
            self.encoded += int(sizes[a:b].sum())
            if self.encoded >= GIVE_BACK_BYTES:
                self.encoded = 0
                give_back()
        return out

    def _part(self, texts: pa.Array) -> list[bytes]:
        if self.model:  # ahead of the tokenizer, where that changes no ids
            low = pc.ascii_lower(texts)
            texts = pc.if_else(pc.match_substring_regex(low, self.as_written), texts, low)
        lists = pc.ascii_split_whitespace(texts)
        pieces, starts = lists.flatten(), lists.offsets.to_numpy()
        coded = pieces.dictionary_encode()  # the pieces kept are looked up among the batch's, which are fewer
        at = pc.index_in(self.keys, value_set=coded.dictionary)
        known, row_of = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)), np.full(len(coded.dictionary), -1)
        row_of[at.drop_null().to_numpy()] = known
        lacking = row_of < 0
        if lacking.any():
            row_of[lacking] = self._learn(coded.dictionary.filter(pa.array(lacking)))
        rows = row_of[coded.indices.to_numpy()]
        self.used += np.bincount(rows, minlength=len(self.keys))
        found = self.values.take(pa.array(rows))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[starts].tolist() if len(found) else [0] * len(starts)
        data = memoryview(found.buffers()[2] or b"")
        if len(self.keys) > CACHE_PIECES:
            self._drop()
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]

    def ids(self, text: bytes) -> bytes:
        return self.batch(pa.array([text.decode()], pa.large_string()))[0]


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """One encoder for each file and Python worker."""
    return Encoder(file)

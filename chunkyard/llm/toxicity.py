"""Toxicity by non-negative positive-unlabelled learning.

Documents are sets of lower-cased letter runs and of stems with the number of different words that lengthen them, up to
three: one such word may be chance where several inflections are not. Positives are texts confirmed as toxic; the unlabelled
texts are drawn from the labelled training rows without regard to what the label says, so the share of toxic texts among
those rows is their class prior. Features that tell the two apart go into a linear model, trained with numpy on the non-negative risk

    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])

where l is the logistic loss, and a step that would make the bracket negative descends on its opposite instead. Features
are words and stems whose rate among different positives beats that among unlabelled texts beyond what the number of
features tried explains, as many as there are; near copies among the positives count once. All of these settings were chosen by cross-validation on training rows only
(tests/llm/cross_validate_toxicity.py).

The fit reads at most MOST_POSITIVE and MOST_UNLABELLED labelled rows, chosen by hash, as documented parameters; scores cover
all rows and whole texts. Features are counted by executors; the driver gets counts of what positives have in common, and
for each sampled text which of the chosen features it has. Nulls: null text is empty, and gets the score of a text without words;
null labels are no labels; null doc_id is scored and never learned from. A doc_id with several texts teaches by each, and with several
labels by each of them. A very long text is one set of features. Without any confirmed toxic row all scores are the prior, smoothed by
half a row; an empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import bounded_batches, written

#: Labelled rows that the fit reads: confirmed toxic ones, and ones taken without regard to their label.
MOST_POSITIVE, MOST_UNLABELLED = 2000, 6000
#: How far a feature must stand out, times the logarithm of the number of features tried; the weight decay.
STRICT, DECAY = 1.5, 1e-5
#: Letters of a stem; different words that lengthen one, counted up to this many.
STEMS, MOST_WORDS = (5, 6, 7, 8), 3
#: Different positives that must have a feature; places of the sketches by which near copies are told.
LEAST_POSITIVE, PLACES = 3, 4096
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    """A word, and the stems that it lengthens."""
    return ["=" + word, *("^" + word[:k] for k in STEMS if len(word) > k)]


def leveled(found: Counter[str]) -> list[str]:
    """Features of a text from how many of its different words have each of theirs: stems count once for each number up to MOST_WORDS."""
    return [f"{level}{f}" for f, n in found.items() for level in range(1, min(n, MOST_WORDS) + 1)]


def features_of(words: Iterable[str]) -> list[str]:
    return leveled(Counter(f for w in words for f in word_features(w)))


def sketch(words: Iterable[str]) -> bytes:
    bits = np.zeros(PLACES, np.uint8)
    bits[[zlib.crc32(w.encode()) % PLACES for w in words]] = 1
    return np.packbits(bits).tobytes()


def different(sketches: list[bytes]) -> list[int]:
    """Which texts share less than half of their words with every earlier one: copies of a text would count as evidence again and again."""
    if not sketches:
        return []
    x = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1), axis=1).astype(np.float32)
    size, kept = x.sum(axis=1), []
    for i in range(len(x)):
        both = x[kept] @ x[i] if kept else np.zeros(0)
        if not len(both) or not (both >= 0.5 * (size[kept] + size[i] - both)).any():
            kept.append(i)
    return kept


def risk(w: np.ndarray, pos: np.ndarray, unl: np.ndarray, pos_n: np.ndarray, unl_n: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive part of the risk, its bracket, and the gradients of both at the weights w, of which the last is the offset; rows count pos_n and unl_n times."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    mean = lambda values, n: float(values @ n) / max(1, n.sum())
    grad = lambda x, d, n: np.append(x.T @ (d * n), (d * n).sum()) / max(1, n.sum())
    fp, fu = pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1]
    positive = prior * mean(np.logaddexp(0, -fp), pos_n)
    bracket = mean(np.logaddexp(0, fu), unl_n) - prior * mean(np.logaddexp(0, fp), pos_n)
    return positive, bracket, prior * grad(pos, sig(fp) - 1, pos_n), grad(unl, sig(fu), unl_n) - prior * grad(pos, sig(fp), pos_n)


def non_negative_fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and offset by Adam on the non-negative risk over all rows; equal rows are taken together."""
    (pos, pos_n), (unl, unl_n) = (np.unique(x, axis=0, return_counts=True) for x in (pos, unl))
    w, m, v = np.zeros(pos.shape[1] + 1), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, bracket, g_pos, g_bracket = risk(w, pos, unl, pos_n, unl_n, prior)
        g = g_pos + g_bracket if bracket >= 0 else -g_bracket
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def told_apart(a: int, n: int, b: int, m: int) -> float:
    """Likelihood-ratio statistic of a in n against b in m."""
    both = (a + b) / (n + m)
    part = lambda k, of: k * np.log(k / of / both) if k else 0.0
    rest = lambda k, of: (of - k) * np.log((1 - k / of) / (1 - both)) if k < of else 0.0
    return 2 * (part(a, n) + rest(a, n) + part(b, m) + rest(b, m))


def smoothed(toxic: int, rows: int) -> float:
    """The class prior."""
    return (toxic + 0.5) / (rows + 1)


def telling(counts: dict[str, tuple[int, int]], positives: int, unlabelled: int, strict: float = STRICT) -> list[str]:
    """The features that go into the model, of those (in so many positives, in so many unlabelled texts) that LEAST_POSITIVE positives have."""
    least = strict * np.log(max(1, len(counts))) + 2
    return sorted(f for f, (a, b) in counts.items() if a * unlabelled > b * positives and told_apart(a, positives, b, unlabelled) > least)


@dataclass
class ToxicityModel:
    """A linear model over the features that occur in a text; the score is the logistic of their weights and the offset."""

    weights: dict[str, float] = field(default_factory=dict)
    offset: float = -30.0
    known: dict[str, tuple] = field(default_factory=dict, repr=False)  # features of words met before
    kinds: frozenset[str] = field(init=False, repr=False)  # features without their level

    def __post_init__(self) -> None:
        self.kinds = frozenset(f[1:] for f in self.weights)

    def score(self, text: str | None) -> float:
        known, found = self.known, Counter()
        if len(known) > 60_000:
            known.clear()
        for word in words_of(text):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(f for f in word_features(word) if f in self.kinds)
            if own:
                found.update(own)
        z = self.offset + sum(self.weights.get(f, 0.0) for f in sorted(leveled(found)))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))

    @classmethod
    def fit(cls, positive: list[list[str]], unlabelled: list[list[str]], names: list[str], prior: float, decay: float = DECAY) -> ToxicityModel:
        """From which of the features `names` each text has."""
        column = {f: i for i, f in enumerate(names)}

        def matrix(rows: list[list[str]]) -> np.ndarray:
            out = np.zeros((len(rows), len(names)), np.float32)
            for i, r in enumerate(rows):
                out[i, [column[f] for f in r]] = 1
            return out

        if not positive or not unlabelled:
            return cls(offset=float(np.log(prior / (1 - prior))))
        w, offset = non_negative_fit(matrix(positive), matrix(unlabelled), prior, decay=decay)
        return cls({f: float(w[i]) for f, i in column.items()}, offset)

    @classmethod
    def of_texts(cls, positive: list[str], unlabelled: list[str], prior: float, strict: float = STRICT, decay: float = DECAY) -> ToxicityModel:
        """The same fit in one process, for small samples."""
        sets = [words_of(t) for t in positive]
        pos = [features_of(sets[i]) for i in different([sketch(s) for s in sets])]
        unl = [features_of(words_of(t)) for t in unlabelled]
        in_pos, in_unl = (Counter(f for x in rows for f in x) for rows in (pos, unl))
        names = telling({f: (n, in_unl[f]) for f, n in in_pos.items() if n >= LEAST_POSITIVE}, len(pos), len(unl), strict)
        own = set(names)
        return cls.fit([[f for f in x if f in own] for x in pos], [[f for f in x if f in own] for x in unl], names, prior, decay)


def _sampled(docs: DataFrame, labels: DataFrame, train: Column, positive: int, unlabelled: int) -> tuple[DataFrame, float]:
    """kind (1 positive, 0 unlabelled), sketch, features of the sampled texts, written; and the prior."""
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic").filter(train)
    n = known.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("toxic").cast("bigint")), F.lit(0)).alias("toxic")).first()
    order = F.xxhash64("doc_id", F.lit(3))
    some = lambda rows, most, kind: rows.select("doc_id").distinct().orderBy(order, "doc_id").limit(most).select(F.col("doc_id").alias("_cy_id"), F.lit(kind).alias("_cy_kind"))
    picked = F.broadcast(some(known.filter("toxic = 1"), positive, 1).unionByName(some(known, unlabelled, 0)))  # at most positive + unlabelled rows
    texts = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_cy_id")).select("_cy_kind", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, text in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([kind.as_py()], pa.int32()), pa.array([sketch(words)]), pa.array([features_of(words)], pa.list_(pa.string()))], ["kind", "sketch", "features"])

    rows = texts.mapInArrow(made, "kind int, sketch binary, features array<string>")
    return written(rows, "toxicity-sample"), smoothed(n["toxic"], n["rows"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, positive: int = MOST_POSITIVE, unlabelled: int = MOST_UNLABELLED) -> ToxicityModel:
    """A model from the labels (doc_id, toxic) of rows that pass `train` (all but the held-out ones by default)."""
    bounded_batches(docs.sparkSession)
    sample, prior = _sampled(docs, labels, ~held_out(F.col("doc_id")) if train is None else train, positive, unlabelled)
    own = sample.filter("kind = 1").select("sketch").distinct()
    sketches = sorted(bytes(r["sketch"]) for r in own.collect())  # at most `positive` sketches of 512 bytes
    kept = [sketches[i] for i in different(sketches)]
    if not kept:
        return ToxicityModel.fit([], [], [], prior)
    told = F.broadcast(docs.sparkSession.createDataFrame([(bytearray(k),) for k in kept], "sketch binary"))
    pos = sample.filter("kind = 1").join(told, "sketch", "left_semi").dropDuplicates(["sketch"])
    unl = sample.filter("kind = 0")
    counted = lambda rows: rows.select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    common = written(counted(pos).filter(F.col("n") >= LEAST_POSITIVE), "toxicity-features")
    among = counted(unl).select("f", F.col("n").alias("u"))
    counts = {r["f"]: (r["n"], r["u"] or 0) for r in common.join(among, "f", "left").collect()}  # features that several sampled positives share
    names = telling(counts, len(kept), unl.count())
    has = F.array_intersect("features", F.array(*map(F.lit, names)) if names else F.expr("cast(array() as array<string>)")).alias("has")
    rows_of = lambda rows: [sorted(r["has"]) for r in rows.select(has).collect()]
    return ToxicityModel.fit(sorted(rows_of(pos)), sorted(rows_of(unl)), names, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity_score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text."""
    bounded_batches(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model)  # the weights of the chosen features

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([own.value.score(t) for t in text])

    return docs.withColumn(column, score("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), "_cy_score")
    return scored.filter(F.col("_cy_score") < threshold).drop("_cy_score")

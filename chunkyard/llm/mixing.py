"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with the share m of all characters and the target weight w is repeated at the mean rate w / m. Each document draws its
number of copies from the Poisson distribution of its source's mean by inverting it at a uniform number that an MD5 hash of
(seed, doc_id, part) gives, so a draw is the same on every run and executor. Means above STEP are drawn as the sum of parts with
means of at most STEP, which keeps the table of the distribution short and exact. Copies are exploded and shuffled globally
by a hash of (seed, doc_id, copy): dealt by it, then ordered by it in each partition.

The table of sources is broadcast only while it has at most BROADCAST_SOURCES rows, and joined by a shuffle beyond that.
Null sources are one source; null texts have no characters; a source without characters keeps the rate 1; null doc_ids draw as one id;
repeated rows draw the same number each. Weights of sources that are not named are 0. An empty table gives an
empty result. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 16.0
#: Entries of the inverted distribution; beyond it, for a mean of STEP, lies less than 1e-16.
TERMS = 80
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """_m_source, parts, cdf: how each source is drawn. Without weights a source's weight is its characters to `power`."""
    mass = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        weight = F.pow("mass", F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source") == name, float(value)).otherwise(weight)
    all_rows = Window.partitionBy()  # one row a source
    weighed = mass.withColumn("weight", weight)
    rate = weighed.withColumn("rate", F.col("weight") / F.sum("weight").over(all_rows) * F.sum("mass").over(all_rows) / F.when(F.col("mass") > 0, F.col("mass")))
    rated = rate.select("source", F.when(F.col("mass") == 0, 1.0).otherwise(F.coalesce("rate", F.lit(0.0))).alias("rate"))
    parts = rated.select("source", "rate", F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int").alias("parts"))
    mean = parts.withColumn("mean", F.col("rate") / F.col("parts"))
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        first,
        lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("mean") / k)).alias("cdf")),
        lambda a: a["cdf"],
    )
    return mean.select(F.col("source").alias("_m_source"), F.col("rate").alias("_m_rate"), F.col("parts").alias("_m_parts"), grown.alias("_m_cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 11, power: float = 0.5) -> DataFrame:
    """docs with `copy` (from 1) and `mix_key`, each row as often as drawn, in global random order within partitions of that order's hash."""
    rates = source_rates(docs, weights, power)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("_m_source")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    uniform = lambda j: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), j.cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)
    uniforms = F.transform(F.sequence(F.lit(1), F.col("_m_parts")), uniform)
    drawn = F.aggregate(uniforms, F.lit(0), lambda n, u: n + F.size(F.filter("_m_cdf", lambda c: c <= u)))
    counted = joined.withColumn("_m_n", drawn)
    copies = counted.withColumn("copy", F.explode(F.when(F.col("_m_n") > 0, F.sequence(F.lit(1), F.col("_m_n"))).otherwise(F.array().cast("array<int>"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat(F.lit(f"{seed}#"), name, F.lit("#"), F.col("copy").cast("string"))))
    return keyed.drop("_m_source", "_m_rate", "_m_parts", "_m_cdf", "_m_n").repartition("mix_key").sortWithinPartitions("mix_key")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture with the columns of docs only."""
    names = docs.columns
    return mix(docs, **how).select(*names)

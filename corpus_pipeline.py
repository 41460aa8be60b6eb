"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder
and hands the table read back to the next. All but the last keep the columns of documents. Decisions take effect at once: a
later stage never sees what an earlier one dropped. Packing returns one row a piece, as op1 does.

Every stage decides by rows: where doc_ids repeat, a row goes only for its own text. Null texts count as empty: they are never
toxic by their words, equal each other in exact dedup, and have nothing near; null doc_ids and null labels pass through
unless their text is toxic or a copy. Very long texts are read whole by every stage. Of repeated rows one stays after exact dedup. An empty
table gives an empty result. The columns of documents, and extra ones whatever their names, are kept up to packing, which ignores the extra ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkyard.llm import exact_dedup, mixing, near_dedup, queries, toxicity
from chunkyard.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores below 0.7; labels teach by doc_id, learned from all but the held-out rows."""
    return toxicity.drop_toxic(docs, queries.table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: that of the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the smallest doc_id."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their weights; copies are rows of their own."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all copies into sequences of 4096 tokens."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

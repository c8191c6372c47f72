"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and sharding over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns
of ``docs``; the last adds shard and slot. Extra columns pass through, whatever their names. Null texts are
rejected by language ID; later stages treat what is null as their operators say. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, langid, mixing, neardup, sharding
from foliant.llm.common import scratch, table

SHARDS = 40


def _held(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, beside the columns that stages read, so that no column name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text", "source")


def _rows(held: DataFrame, names: list[str]) -> DataFrame:
    return held.select([F.col(f"_doc.`{c}`").alias(c) for c in names])


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects; it learns from a bounded sample of the labelled ones."""
    named = langid.identify(_held(docs), langid.fit(docs))
    return _rows(named.where(~F.col("language.rejected")), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies: similarities of 0.8 or more over five-word shingles."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a passage of the benchmark."""
    found = decontaminate.contaminated(_held(docs), table(spark, sf_dir, "benchmark"))
    return _rows(found.where(~F.col("overlap.contaminated")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that all sources are expected to give equally many rows, as many as there are in all."""
    return _rows(mixing.replicate(_held(docs)), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard (0 to 39) and slot; shards differ by one row at most."""
    return sharding.shard_rows(docs, SHARDS, order=("text",))


STAGES = [
    ("language_id", keep_identified),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints, a trained classifier and ring runs aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

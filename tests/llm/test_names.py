"""Columns of the caller with the names that operators use on their way pass through unharmed."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, langid, maintext, mixing, quality, sharding, whitening

TAKEN = ["rate", "pieces", "rows", "n", "h", "x", "v", "_id", "_n", "_source", "_piece", "_spot", "_low", "_high", "_rank", "_arc", "_cell", "_slot", "_m", "_l", "_found0", "_hit", "_spans", "_row", "_h", "_c", "_i", "_k", "_text", "_html", "_doc", "c0", "c1", "c40"]
WORDS = "the quick brown fox jumps over the lazy dog and runs away from it all before long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i % 40, f"{WORDS} {i}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame([(None, None, None, None), *rows], "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in TAKEN])


def operators(spark, docs):
    bench = spark.createDataFrame([(1, WORDS)], "item_id long, text string")
    vectors = docs.withColumn("embedding", F.array(F.col("doc_id").cast("float"), F.length("text").cast("float")))
    return {
        "sharding": lambda: sharding.shard_rows(docs, 4, order=("text",)), "mixing": lambda: mixing.replicate(docs), "quality": lambda: quality.repetition(docs), "langid": lambda: langid.identify(docs, langid.fit(docs)),
        "decontaminate": lambda: decontaminate.contaminated(docs, bench), "maintext": lambda: maintext.extract(docs, html="text"), "whitening": lambda: whitening.whiten(vectors, whitening.fit(vectors)),
    }


@pytest.mark.parametrize("name", ["sharding", "mixing", "quality", "langid", "decontaminate", "maintext", "whitening"])
def test_names(spark, docs, name):
    out = operators(spark, docs)[name]()
    assert out.columns[: len(docs.columns)] == docs.columns
    found = out.collect()
    assert found
    for r in found:
        assert all(r[c] == f"{c}:{-1 if r.doc_id is None else r.doc_id}" for c in TAKEN)
    if name != "mixing" and name != "whitening":
        assert len(found) == 61

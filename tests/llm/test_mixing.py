import hashlib
import math
from collections import Counter

import numpy as np

from foliant.llm import mixing


def brute_count(doc, rate, pieces):
    total = 0
    for p in range(1, pieces + 1):
        name = str(doc) + (f":{p}" if pieces > 1 else "") + "|" + mixing.SEED
        u = int(hashlib.md5(name.encode()).hexdigest()[:12], 16) / 2**48
        mean, k = rate / pieces, 0
        term = cdf = math.exp(-mean)
        while u >= cdf and k < 400:
            k += 1
            term *= mean / k
            cdf += term
        total += k
    return total


def test_counts_equal_inverting_one_by_one(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 5}", f"t{i}", "c") for i in range(900)] + [(5000, "one", "rare", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copy string")
    got = mixing.replicate(docs).collect()
    sizes = Counter(r[1] for r in rows)
    want = Counter()
    for doc, source, _, _ in rows:
        rate = len(rows) / len(sizes) / sizes[source]
        n = brute_count(doc, rate, max(1, math.ceil(rate / mixing.PIECE)))
        want.update((doc, k) for k in range(1, n + 1))
    assert Counter((r.doc_id, r["copy"]) for r in got) == want
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)


def test_null_and_repeated_rows_draw_one_by_one(spark):
    hot = spark.range(40_000).selectExpr("cast(null as long) as doc_id", "'a' as source", "'same' as text")
    rest = spark.range(20_000).selectExpr("id % 500 as doc_id", "'b' as source", "cast(id % 2000 as string) as text")
    more = spark.range(2_000).selectExpr("id + 1000 as doc_id", "cast(null as string) as source", "'one' as text")
    docs = hot.unionByName(rest).unionByName(more)
    assert mixing.identified(docs, "doc_id").select("_id").distinct().count() == 62_000
    out = mixing.replicate(docs)
    shares = Counter(r.source for r in out.select("source").collect())
    assert all(abs(shares[s] - 62_000 / 3) < 0.02 * 62_000 / 3 + 300 for s in ("a", "b", None))
    sizes = [r["count"] for r in out.repartitionByRange(8, "shuffle_key").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    assert mixing.replicate(docs, weights={"a": 30.0}, size=0.5).count() > 0


def test_means_and_weights(spark):
    u = (np.arange(200_000) + 0.5) / 200_000
    for mean in (0.0, 0.1, 1.5, 15.9):
        k = mixing.poisson_inverse(u, np.full(len(u), mean))
        assert abs(k.mean() - mean) < 0.01 and abs(k.var() - mean) < 0.02
    docs = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(6000)], "doc_id long, source string")
    shares = Counter(r.source for r in mixing.replicate(docs, weights={"a": 1, "b": 3}).collect())
    assert abs(shares["b"] / sum(shares.values()) - 0.75) < 0.03
    assert mixing.replicate(docs, weights={}).count() == 0


def test_empty_table(spark):
    assert mixing.replicate(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0

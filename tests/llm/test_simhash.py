import random
import re

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import queries, simhash
from foliant.llm.components import connected_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß"]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 40, 300]))] for _ in range(60)]
    texts = []
    for words in base:
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            if changed:
                changed[rnd.randrange(len(changed))] = rnd.choice(vocabulary)
            texts.append("\t".join(changed).upper() if rnd.random() < 0.5 else "\n".join(changed))
    texts += [None, None, "", " \n"]
    rows = [(i if i % 17 else None, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "clash")] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_simhash(spark, str(tmp_path)).collect()
    prints = [(d, brute_print(t)) for d, t, _ in rows]
    want = [(d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_crowded_buckets_lose_no_link(spark):
    rnd = random.Random(2)
    codes = {0x1234567800000000 | rnd.getrandbits(9) for _ in range(300)} | {rnd.getrandbits(63) for _ in range(50)}
    codes |= {c ^ (1 << 63) for c in list(codes)[:20]}
    signed = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    links = simhash.near_links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    rows = [(c, c & (2**64 - 1)) for c in signed]
    assert [roots.get(c, c) for c in signed] == brute_components(rows)


def test_no_exploded_row_or_document_is_broadcast(spark):
    """Spark sizes exploded rows as what they were exploded from, far below its limit for broadcasts here as at 0.6 GB."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    links = simhash.near_links(spark.range(300).select((F.col("id") * 7919).alias("fp")).distinct())
    links.collect()
    plans = [links._jdf.queryExecution().executedPlan().toString()]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans += [p for p in (store.executionsList().apply(i).physicalPlanDescription() for i in range(before, store.executionsCount())) if "Generate" in p]
    out = simhash.near_duplicates(spark.createDataFrame([(i, f"a b c {i % 9}", "") for i in range(40)], SCHEMA))
    assert len(out.collect()) == 40
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 1
    assert not [p for p in plans if re.search(r"BroadcastHashJoin[^\n]*Inner", p)]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert roots == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0

from collections import Counter

import corpus_pipeline
from foliant.llm import decontaminate, neardup
from foliant.llm.common import scratch

from test_decontaminate import brute as brute_overlap
from test_langid import texts
from test_neardup import brute_first

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, language string"


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = [(i, t + f" number{i} and{i * 7}", lang, f"src{i % 4}", len(t), "s", "l") for i, t, lang in texts(240, 5)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "src0", 1, None, None) for i in range(20)]
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows += [(2000, item, "en", "src1", 1, "s", "l"), (2001, "12 34", "en", "src1", 1, "s", "l"), (2002, None, "en", None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        docs = scratch(out, name)
        steps[name] = sorted((tuple(r) for r in docs.select("doc_id", "text", "source").collect()), key=str)
    named = steps["language_id"]
    assert {2001, 2002}.isdisjoint(r[0] for r in named) and len(named) >= len(rows) - 8
    assert sorted(r[0] for r in steps["near_duplicates"]) == brute_first([(d, t) for d, t, _ in named])
    clean = [r for r in steps["near_duplicates"] if not brute_overlap(r[1], [(1, item)])[3]]
    assert steps["decontamination"] == clean and 2000 not in {r[0] for r in clean}
    mixed = Counter(r[0] for r in steps["mixing"])
    assert set(mixed) <= {r[0] for r in clean} and 0.6 * len(clean) < sum(mixed.values()) < 1.5 * len(clean)
    assert steps["sharding"] == steps["mixing"]
    sizes = Counter(r["shard"] for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 or sum(sizes.values()) < 40


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert (neardup.WORDS, neardup.SIMILARITY) == (5, 0.8) and decontaminate.PERCENT == 5

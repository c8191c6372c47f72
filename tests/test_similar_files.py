import os

import numpy as np
import pytest

from foliant.operators import retrieval
from foliant.plans import registry
from foliant.sources.fixtures import Views

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables aren't here")
def test_every_document_is_a_query(spark):
    found = registry.QUERIES["q12_similar_documents"](spark, SF_DIR)
    files = {r.file_id for r in Views(spark, SF_DIR).chunk_vectors.select("file_id").distinct().collect()}
    assert {r.query_id for r in found.select("query_id").distinct().collect()} == files


@pytest.mark.parametrize(("group", "scores"), [(16 << 20, 1 << 21), (16 << 20, 100), (3000, 1 << 21), (3000, 100)])
def test_similar_files_equal_brute_force(spark, monkeypatch, group, scores):
    """Files of one to 90 chunks, copies, ties, repeated rows, and vectors that can't be compared; one cell or many, one block or many."""
    monkeypatch.setattr(retrieval, "GROUP_BYTES", group)
    monkeypatch.setattr(retrieval, "SCORES", scores)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (400, 5)).astype(float)
    vectors[100:160] = vectors[100]
    vectors[7] = 0.0
    rows = [(i // 2 if i < 310 else -3, i % 2 if i < 310 else i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(500, 0, None), (501, 0, [1.0, None, 2.0, 0.0, 0.0]), (None, 0, rows[3][2]), rows[4], (502, None, rows[9][2])]
    out = retrieval.similar_files(spark.createDataFrame([*rows, *odd], "file_id long, ordinal int, embedding array<double>").repartition(3), 4)
    held = [(f, np.array(v)) for f, _, v in [*rows, odd[-1]] if any(v)]
    best = {}
    for q, a in held:
        for f, b in held:
            if f != q:
                best[q, f] = max(best.get((q, f), -2.0), round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6))
    want = []
    for q in {q for q, _ in held}:
        want += [(q, f, s, k + 1) for k, (s, f) in enumerate(sorted(((s, f) for (a, f), s in best.items() if a == q), key=lambda x: (-x[0], x[1]))[:4])]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_similar_files_of_none_and_of_two_lengths(spark):
    schema = "file_id long, ordinal int, embedding array<double>"
    assert retrieval.similar_files(spark.createDataFrame([], schema), 4).count() == 0
    assert retrieval.similar_files(spark.createDataFrame([(1, 0, [1.0])], schema), 4).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        retrieval.similar_files(spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0, 2.0])], schema), 4)

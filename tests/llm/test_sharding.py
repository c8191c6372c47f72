import zlib
from collections import Counter

from foliant.llm import queries, sharding


def test_query_balances_rows_and_fills_slots(spark, tmp_path):
    rows = [(i, f"text {i} é", "x") for i in range(1003)] + [(5, "text 5 é", "x")] * 30 + [(None, None, None)] * 40 + [(7, "", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_bounded_ring(spark, str(tmp_path)).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def brute(points, spots, shards):
    """Keys one by one in ring order: home shard first, the overflow clockwise afterwards."""
    room = [len(spots) // shards + (s < len(spots) % shards) for s in range(shards)]
    arc_of = lambda spot: next((i for i, (p, _) in enumerate(points) if p >= spot), 0)
    home = sorted((arc_of(s), s) for s in spots)
    out, over = Counter(), []
    for arc, _ in home:
        shard = points[arc][1]
        if room[shard]:
            room[shard] -= 1
            out[shard, arc] += 1
        else:
            over.append(arc)
    for arc in over:
        at = arc
        while True:
            at = (at + 1) % len(points)
            if room[points[at][1]]:
                room[points[at][1]] -= 1
                out[points[at][1], arc] += 1
                break
    return out


def test_runs_equal_placing_keys_one_by_one():
    points = sharding.ring_points(7, 5)
    spots = [hash(("k", i)) % (1 << 32) for i in range(500)]
    counts = Counter(next((i for i, (p, _) in enumerate(points) if p >= s), 0) for s in spots)
    runs = sharding.assign_arcs(points, counts, 7)
    got = Counter()
    for k, (arc, rank, shard, slot) in enumerate(runs):
        ends = [r for a, r, _, _ in runs if a == arc and r > rank]
        got[shard, arc] += (min(ends) if ends else counts[arc]) - rank
    assert got == brute(points, spots, 7)


def test_movement_is_limited_when_a_shard_is_added(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in sharding.shard_rows(docs, 10).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_rows(docs, 11).collect()}
    moved = sum(before[d] != after[d] for d in before) / len(before)
    assert 1 / 11 - 0.03 < moved < 0.3


def test_empty_table(spark):
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0

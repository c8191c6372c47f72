import random
from collections import defaultdict

import numpy as np
import pytest

from foliant.llm import neardup

RND = random.Random(4)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(3000)]


def shingles(text, width=5):
    words = "".join(c.lower() if c < "\x7f" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_links(rows):
    sets, at = [shingles(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or ["none"]:
            at[x].append(i)
    pairs = {(a, b) for held in at.values() for a in held for b in held if a < b}
    return [(a, b) for a, b in pairs if sets[a] == sets[b] or len(sets[a] & sets[b]) >= neardup.SIMILARITY * len(sets[a] | sets[b])]


def brute_first(rows):
    """Keys that stay: the least of each group (keys are unique)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_links(rows):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted(least.values())


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[RND.randrange(len(words))] = RND.choice(VOCABULARY)
    return words


def corpus():
    rows = []
    for _ in range(60):
        base = [RND.choice(VOCABULARY) for _ in range(RND.randint(60, 400))]
        rows += [" ".join(edited(base, RND.randint(0, max(1, len(base) // 40)))) for _ in range(RND.randint(1, 6))]
    base = [RND.choice(VOCABULARY) for _ in range(200)]
    rows += [" ".join(edited(base, RND.randint(1, 5))) for _ in range(300)]
    rows += ["", None, "a b", "A  b", "a c", " ".join(base * 40)]
    return list(enumerate(rows))


def test_groups_equal_brute_force(spark):
    rows = corpus()
    got = sorted(r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_first(rows)


def test_candidates_find_nine_links_of_ten(spark):
    rows = [(k, t) for k, t in corpus() if t]
    h, bounds = neardup.shingle_sets([t.encode() for _, t in rows])
    assert np.array_equal(np.diff(bounds), [len(shingles(t)) for _, t in rows])
    entries = spark.createDataFrame([(k, t) for k, t in rows], "row long, text string").select("row", neardup._prints(5)(neardup.text_bytes("text")).alias("p")).selectExpr("row", "p.word", "p.segments")
    small = [r for r in rows if r[0] < 250]
    found = {(r.a, r.b) for r in neardup.candidates(entries.where("row < 250"))[0].collect()}
    want = {(small[a][0], small[b][0]) for a, b in brute_links(small) if small[a][1] != small[b][1]}
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want)


def test_nulls_repeats_and_clashing_names(spark):
    text = " ".join(VOCABULARY[:40])
    rows = [(None, text, "x", 1), (7, text, "y", 2), (7, text, "y", 2), (3, text + " tail", "z", 3), (None, "other words entirely here now", "x", 4), (None, None, None, None)]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string, fp long"))
    assert out.columns == ["doc_id", "text", "row", "fp"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[3], rows[4], rows[5]], key=str)
    assert neardup.keep_one(out.limit(0)).count() == 0


def test_fingerprints_bit_by_bit():
    h = np.array([RND.getrandbits(64) for _ in range(1000)], np.uint64)
    bounds = np.array([0, 0, 1, 300, 1000])
    got = np.unpackbits(neardup.fingerprints(h, bounds), axis=1, bitorder="little")
    wide = np.stack([neardup.mix64(h ^ s) for s in neardup._SALTS], axis=1)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        for k in (0, 1, 63, 64, 200, 255):
            ones = sum((int(x[k // 64]) >> (k % 64)) & 1 for x in wide[a:b])
            assert got[i, k] == (2 * ones > b - a)


def template(n, edits, words=400):
    """n / 2 pairs of near copies, all made from one template of which each pair replaced ``edits`` words."""
    base = [RND.choice(VOCABULARY) for _ in range(words)]
    rows = []
    for k in range(n // 2):
        own = edited(base, edits)
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(edited(own, 1)))]
    return rows


@pytest.mark.parametrize(("bucket", "edits"), [(32, 5), (2, 5), (2, 9), (32, 14)])
def test_templates_lose_nothing_at_crowded_codes(spark, monkeypatch, bucket, edits):
    """Texts that all have about as much in common as the limit, or less: 5 words of 400 on either side leave a similarity of 0.78."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    rows = template(160, edits)
    got = sorted(r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute_first(rows)
    if bucket == 2 or edits == 5:
        assert got == want
    # Codes that aren't crowded find a pair of 0.97 almost surely.
    assert len(set(want) - set(got)) == 0 and len(got) - len(want) <= 0.02 * len(want)


@pytest.mark.parametrize("sent", [0, 1000])
def test_texts_are_shuffled_only_beyond_the_limit_of_sent_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(neardup, "SENT", sent)
    rows = corpus()[:24]
    out = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == brute_first(rows)
    assert ("BroadcastHashJoin" in plan) == (sent > 0) and ("SortMergeJoin" in plan) == (sent == 0)


def test_a_group_is_listed_by_its_different_codes(spark, monkeypatch):
    """Of a large group, crowded codes and their centres are found with 8 rows of a text at most, not 200."""
    n = 400
    segments = [[17 + s if i % 4 else 17 + s + (1 << (i % 24)) for s in range(neardup.SEGMENTS)] for i in range(n)]
    entries = spark.createDataFrame([(i, i % 7, segments[i]) for i in range(n)], "row long, word long, segments array<int>")
    balls = {(s << neardup.SEGMENT_BITS) | c: 0 for row in segments for s, c in enumerate(row)}
    count = defaultdict(int)
    ball = lambda own: [own, *(own ^ (1 << i) for i in range(neardup.SEGMENT_BITS))]
    for row in segments:
        for s, c in enumerate(row):
            for code in ball((s << neardup.SEGMENT_BITS) | c):
                count[code] += 1
    want = {c: k for c, k in count.items() if k > neardup.BUCKET}
    kept, scratch = {}, neardup.scratch
    monkeypatch.setattr(neardup, "scratch", lambda df, name: kept.setdefault(name, scratch(df, name)))
    monkeypatch.setattr(neardup, "drop_scratch", lambda table: None)
    pairs, rows = neardup.candidates(entries, among_crowded=False)
    assert {r.code: r.n for r in kept["crowded_codes"].collect()} == want
    most = {own: max((k for k in ball(own) if k in want), key=lambda k: (want[k], k), default=None) for own in balls}
    assert {r.own: r.code for r in kept["main_codes"].collect()} == {own: code for own, code in most.items() if code is not None}
    assert rows.count() == n and kept["crowded"].count() <= neardup.SEGMENTS * n
    # Every row hangs on a centre.
    assert {x for r in pairs.collect() for x in (r.a, r.b)} == set(range(n))

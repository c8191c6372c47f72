import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliant.llm import queries, suffix_tree
from foliant.llm.common import keyed, text_bytes


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


ROWS = [(i, t) for i, t in enumerate(["The cat sat on the mat.", "the dog sat on the log", None, "", "Été à la plage", "a\tb\nc  d", "word " * 300, "the cat and the dog"] * 6)] + [(None, "null id"), (3, "again"), (3, "again")]


def test_query_equals_brute_force_base(spark, tmp_path):
    spark.createDataFrame([(d, t, "x") for d, t in ROWS], "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_suffix_tree(spark, str(tmp_path)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(t for d, text in ROWS if not held(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, text in ROWS:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        want.append((str(d), held(d), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def scored(rows, train):
    return suffix_tree.score_texts(rows.selectExpr("rid", "body", f"{train} as train"))[0]


def fitted(rows, train="true"):
    return suffix_tree.fit(suffix_tree.count(rows.selectExpr("body", f"{train} as train")))


def test_rare_words_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "FREQUENT", 3)
    rows = keyed(spark.createDataFrame(ROWS, "doc_id long, text string")).select("rid", text_bytes("text").alias("body"))
    few = scored(rows, "true").collect()
    monkeypatch.undo()
    many = scored(rows, "true").collect()
    key = lambda r: (r.rid, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    assert sorted(map(key, few)) == sorted(map(key, many))


def symbols(text):
    """(context of DEPTH bytes, next byte) of every symbol of a text, as the module's docstring says."""
    words = [t.encode() if isinstance(t, str) else None for t in tokens(text)]
    before = b"\n\n"
    for w in words:
        own = b"\n" if w is None else w + b" "
        for j, byte in enumerate(own):
            held = before[-suffix_tree.BACK :] + b" " if j == 0 else b" " + own[:j]
            yield (b"\0" * suffix_tree.DEPTH + held)[-suffix_tree.DEPTH :], byte
        before = before + b" " + (w or b"")


def brute_tree(texts):
    counts = {}
    for text in texts:
        for context, byte in symbols(text):
            for d in range(suffix_tree.DEPTH + 1):
                counts.setdefault(context[len(context) - d :], Counter())[byte] += 1
    kept = {b""} & counts.keys()
    for context, n in counts.items():
        total = sum(n.values())
        if context and total > 1:
            parent = counts[context[1:]]
            of = sum(parent.values())
            if sum(k * math.log((k / total) / (parent[b] / of)) for b, k in n.items()) >= suffix_tree.GAIN:
                kept |= {context[i:] for i in range(len(context) + 1)}
    return {c: counts[c] for c in kept}


def brute_p(kept, context, byte):
    p = 1 / 256
    for d in range(len(context) + 1):
        suffix = context[len(context) - d :]
        if suffix not in kept:
            break
        n = kept[suffix]
        p = (n[byte] + suffix_tree.PRIOR * p) / (sum(n.values()) + suffix_tree.PRIOR)
    return p


@pytest.mark.parametrize("states", [1, 40, 1 << 15])
def test_kept_contexts_and_scores_equal_a_brute_force_tree(spark, monkeypatch, states):
    monkeypatch.setattr(suffix_tree, "STATES", states)
    monkeypatch.setattr(suffix_tree, "FREQUENT", 5)
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdeé\0") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    texts = [t for _, t in ROWS] + [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    train, more = texts[:-20], [*texts[-20:], "unseenword", "x" * 5000, "日本語のとても長い単語"]
    body = lambda rows: spark.createDataFrame([(i, bytearray((t or "").encode())) for i, t in enumerate(rows)], "rid long, body binary")
    found, model = suffix_tree.score_texts(body(train + more).selectExpr("rid", "body", f"rid < {len(train)} as train"))
    want = brute_tree(train)
    got = {(r.context % (1 << 64)).to_bytes(8, "big")[8 - r.depth :]: r for r in model.kept.collect()}
    assert got.keys() == want.keys() and len(want) > 40
    assert all(got[c].total == sum(n.values()) and dict(got[c].next) == dict(n) for c, n in want.items())
    scores = {r.rid: r.score for r in found.collect()}
    for i, text in enumerate(train + more):
        assert scores[i] == pytest.approx(sum(math.log10(brute_p(want, c, b)) for c, b in symbols(text)), rel=1e-5), text


def test_probabilities_of_a_state_sum_to_one(spark):
    model = fitted(spark.createDataFrame([(bytearray(b"xq yr " * 40),)] * 5, "body binary"))
    assert np.allclose((10.0 ** model.tree.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert np.allclose((10.0 ** model.first[1].astype(float)).sum(axis=1), 1, atol=1e-4)
    assert model.words == 3 and model.tokens == 5 * 81


def test_no_training_text_and_no_text(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a b"))], "rid long, body binary")
    found = scored(rows, "false").collect()
    assert found[0].n_tokens == 3 and found[0].n_known == 0 and found[0].score == pytest.approx(5 * -math.log10(256), abs=1e-4)
    assert scored(rows.limit(0), "true").collect() == []
    assert suffix_tree.score(rows, fitted(rows.limit(0))).first().score is None  # its words weren't counted


def corpus(n):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n)]
    return [(i, bytearray(" ".join(rnd.choice(vocabulary) for _ in range(60)).encode())) for i in range(n)]


def test_kept_contexts_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "STATES", 64)
    sizes = []
    for n in (20, 80, 320):
        model = fitted(spark.createDataFrame(corpus(n), "rid long, body binary"))
        sizes.append(model.kept.count())
    assert 64 < sizes[0] and 2 * sizes[0] < sizes[1] and 2 * sizes[1] < sizes[2]

import hashlib
import random

import numpy as np

from foliant.llm import queries, substrings


def brute(texts, length=100):
    """texts in order -> (kept, spans) of each."""
    seen, out = set(), []
    for body in texts:
        gone = np.zeros(len(body) + 1, bool)
        for s in range(len(body) - length + 1):
            window = body[s : s + length]
            if window in seen:
                gone[s : s + length] = True
            else:
                seen.add(window)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[:-1], [False])).astype(int)))
        out.append((bytes(b for b, g in zip(body, gone, strict=False) if not g), list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß ") for _ in range(rnd.randint(1, 7)))
    passages = ["".join(word() + " " for _ in range(rnd.randint(20, 60))) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = ["".join(word() for _ in range(rnd.randint(0, 40)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            i = rnd.randint(0, 40)
            parts += [p[i:] if rnd.random() < 0.5 else p, word()]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "=" * 700, "x" + "=" * 350 + "y", "ab" * 300, "", None, "short", "short", passages[0] * 4]
    return texts


def test_query_equals_brute_force(spark, tmp_path):
    texts = corpus()
    rows = [(i * 3 - 20, t, "z") for i, t in enumerate(texts)]
    rnd = random.Random(1)
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_two_stage(spark, str(tmp_path)).collect()}
    ordered = sorted(rows)
    want = brute([(t or "").encode() for _, t, _ in ordered])
    assert len(got) == len(rows)
    for (doc, text, _), (kept, spans) in zip(ordered, want, strict=True):
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((text or "").encode()), len((text or "").encode()) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), doc


def test_crowded_anchors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", 3)
    texts = [t for t in corpus(5) if t is not None]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = sorted((str(d), k) for (d, _), (k, _) in zip(ordered, brute([t.encode() for _, t in ordered]), strict=True))
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in found.collect()) == want


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_stage_order_is_suffix_order():
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(100, 300))) + b"c" * rnd.choice([0, 5, 150]) for _ in range(12)]
    raw, offsets = substrings.pack(texts, gap=b"\xff")
    data = raw + np.uint8(1)
    wanted = np.zeros(len(data), bool)
    for o, t in zip(offsets, texts, strict=False):
        wanted[o : o + max(0, len(t) - 99)] = True
    order = substrings.two_stage_order(data, wanted)
    strings = [data[p : p + 100].tobytes() for p in order]
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    assert strings == sorted(strings)
    common = substrings.adjacent_prefixes(data, order)
    for k in range(1, len(order)):
        a, b = strings[k - 1], strings[k]
        assert common[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def test_documents_longer_than_a_piece(spark):
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh \n") for _ in range(substrings.PIECE + 5_000))
    texts = [base, "y" + base[70_000:] + base[:150], "z" * 90_000, base[substrings.PIECE - 60 : substrings.PIECE + 60]]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kept, spans) in enumerate(brute([t.encode() for t in texts])):
        assert bytes(found[i].kept) == kept, i
        assert list(zip(found[i].starts, found[i].ends, strict=True)) == spans, i

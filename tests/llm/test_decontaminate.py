import random
import re

from foliant.llm import decontaminate

DOCS = "doc_id long, text string, overlap string"
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        m = min(13, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(own) - m + 1) if m else ():
            if tuple(own[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n, k=40: " ".join(rnd.choice([f"w{i}" for i in range(k)] + ["É", "Zoë"]) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 5, 12, 13, 14, 40]), 2000 if i % 2 else 40)) for i in range(14)] + [(3, text(20)), (None, text(15)), (50, ""), (51, None), (52, "!?"), (60, text(30)), (60, text(30))]
    docs = [(0, None), (1, ""), (2, "?!"), (None, text(30))]
    for i in range(3, 60):
        parts = [text(rnd.randint(0, 60), 500)]
        for _ in range(rnd.randint(0, 3)):
            w = words(rnd.choice(items)[1])
            parts += ["-".join(w[rnd.randint(0, 2) :]).upper(), text(rnd.randint(0, 40), 500)]
        docs.append((i, ", ".join(parts)))
    docs += [docs[20], (99, text(20000, 3000))]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], DOCS)
    want = sorted((str(d), *brute(t, items)) for d, t in docs)
    for limit in (1 << 20, 500):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.contaminated(frame, spark.createDataFrame(items, ITEMS)).collect()
        assert sorted((str(r.doc_id), r.overlap.n_words, r.overlap.n_hit, r.overlap["items"], r.overlap.contaminated) for r in got) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", None)], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.contaminated(docs, none).collect()[0].overlap.n_hit == 0
    assert decontaminate.contaminated(docs.limit(0), none).count() == 0

import random
import zlib

import numpy as np

from foliant.llm import langid, queries

WORDS = {"en": ["the", "and", "with", "this", "shall", "running"], "de": ["der", "und", "nicht", "straße", "können", "schön"], "fr": ["le", "être", "avec", "où", "français", "nous"]}


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(3, 80))), lang) for i, lang in ((i, rnd.choice(list(WORDS))) for i in range(n))]


def test_held_out_accuracy_and_contract(spark, tmp_path):
    rows = [(i, t, lang, "x") for i, t, lang in texts(600)] + [(9001, None, "en", "x"), (9002, "", "de", "x"), (9003, "123 ... 456", "fr", "x"), (9004, "der und nicht", None, "x"), (None, "the and with", "en", "x"), (4, "übergrößen nicht und der " * 9000, "de", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, language string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_subwords(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == {9001: "und", 9002: "und", 9003: "und"}
    assert all(r.rejected for r in got if r.lang_pred == "und")
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert (found[0].language.lang, found[0].language.score, found[0].language.rejected) == ("und", 0.0, True)
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_letters():
    assert langid.has_letter("é".encode()) and langid.has_letter(b"1a") and not langid.has_letter("12 ‚ … €".encode()) and not langid.has_letter(b"")


def test_copies_count_once_in_the_sample(spark):
    many = spark.range(10000).crossJoin(spark.createDataFrame([(" ".join(w), lang) for lang, w in WORDS.items()], "text string, lang string"))
    few = spark.createDataFrame([(i, t, lang) for i, t, lang in texts(120, 3)], "id long, text string, lang string")
    for rows in (many, many.unionByName(few)):
        model = langid.fit(rows)
        assert model.langs == sorted(WORDS)
        assert model.predict([" ".join(w).encode() for w in WORDS.values()])[0] == list(WORDS)
    named = model.predict([t.encode() for _, t, _ in texts(60, 4)])[0]
    assert sum(a == lang for a, (_, _, lang) in zip(named, texts(60, 4), strict=True)) >= 58


def brute_logits(model, text):
    """Language scores of a text from the model's weights, n-gram by n-gram."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text) + b"    "
    total, n = np.zeros(len(model.langs)), 0
    for size in langid.SIZES:
        for i in range(len(data) - size + 1):
            gram = data[i : i + size]
            # The last places belong to the gap between texts; a gap by itself is no n-gram.
            if i >= len(data) - 4 or gram == b" " * size:
                continue
            code = int.from_bytes(gram, "little")
            bucket = ((code * 2654435761 + size * 40503) & 0xFFFFFFFF) >> 20
            total, n = total + model.logits[bucket], n + 1
    return (total / max(1, n) + model.bias) / model.temperature


def test_predictions_equal_the_weights_summed_one_by_one(spark):
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i, t, lang in texts(300, 6)], "id long, text string, lang string"))
    cases = [t.encode() for _, t, _ in texts(40, 7)] + [b"", b"a", "ß".encode(), b"the" * 50_000, b"1 2 3", "être où".encode()]
    langs, scores = model.predict(cases)
    for text, lang, score in zip(cases, langs, scores, strict=True):
        if not langid.has_letter(text):
            assert (lang, score) == ("und", 0.0)
            continue
        logit = brute_logits(model, text)
        p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        assert lang == model.langs[int(p.argmax())] and abs(score - p.max()) < 1e-5


def test_one_repeated_and_one_varied_language(spark):
    german = spark.range(60_000).selectExpr("'der und nicht straße können schön' as text", "'de' as lang")
    english = spark.createDataFrame([(" ".join(random.Random(i).choices(WORDS["en"], k=30)) + f" word{i}", "en") for i in range(300)], "text string, lang string")
    for rows in (german, german.unionByName(english)):
        assert "de" in langid.fit(rows).langs
    model = langid.fit(german.unionByName(english))
    assert model.predict(["der und nicht straße".encode(), b"this running and the"])[0] == ["de", "en"]


def test_more_labels_than_the_sample_holds(spark):
    rows = [(f"text {i} {k}", f"l{i:04}") for i in range(70) for k in range(1 + (i == 69))]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample=50)
    assert len(model.langs) == 50 and "l0069" in model.langs

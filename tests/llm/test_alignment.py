"""The aligner against ends compared one by one and pairs counted one by one."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from foliant.llm import alignment, queries

TEXTS = [
    "Hello world, it's 2024!", "", None, " ", "a  b", "  lead and trail  ", "a\tb\nc \n d", "Élan vital — naïve", "<|endoftext|> x <s> </s>", "😀 emoji 😀", "a▁b", "日本語のテキスト 東京",
    "word " * 3000, "nospaces" * 4000, "x\x00y", "the cat sat  wide", "can't won't I'll", "   ", "\n\n\n", "Ein schöner Satz. Noch einer.", "Ein schöner Satz. Noch einer.",
]


def brute(rows):
    path_a, path_b = alignment.default_tokenizers()
    a, b, chars = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), alignment.byte_level()
    a.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc, text in rows:
        ids_a, ids_b, groups, links = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            in_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
            in_b = [bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode() for i in ids_b]
            if not b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
                ids_a, ids_b = [], []
        if ids_a:
            of_a, of_b = ([k for k, x in enumerate(xs) for _ in x] for xs in (in_a, in_b))
            overlaps = sorted(set(zip(of_a, of_b, strict=True)))
            links = [(ids_a[i], ids_b[j]) for i, j in overlaps]
            group = None
            for byte in range(len(of_a)):
                if byte == 0 or of_a[byte] != of_a[byte - 1] and of_b[byte] != of_b[byte - 1]:
                    group = ({}, {})
                    groups.append(group)
                group[0][of_a[byte]] = str(ids_a[of_a[byte]])
                group[1][of_b[byte]] = str(ids_b[of_b[byte]])
            groups = ["|".join(",".join(side.values()) for side in g) for g in groups]
        docs.append((doc, ids_a, ids_b, groups, links))
        counts.update(links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return sorted(
        (str(d), len(x), len(y), len(g), len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, x, y, g, k in docs
    )


def shape(rows):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [*enumerate(TEXTS), (None, "the null id"), (3, "the  same"), (3, "the  same")]
    frame = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, groups string, n_a int, pairs int")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert shape(queries.op13_aligned(spark, str(tmp_path)).collect()) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = queries.op13_aligned(spark, "/root/testdata/sf0.001").collect()
    assert shape(found) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_join_gives_what_the_broadcast_gives(spark):
    rows = [*enumerate(TEXTS), (None, "the null id"), (None, "the null id")]
    aligned = alignment.scratch(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")), "test")
    sent, joined = (alignment.with_counts(aligned, n) for n in (10**6, 0))
    assert sent.columns == joined.columns
    assert sorted(map(repr, sent.collect())) == sorted(map(repr, joined.collect()))


def test_empty_table(spark):
    aligned = alignment.scratch(alignment.align(spark.createDataFrame([], "doc_id long, text string")), "none")
    assert alignment.with_counts(aligned).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_cuts_are_all_shared_ends(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    shared = sorted(set(a) & set(b))
    assert alignment.shared_cuts(np.array(a), np.array(b)).tolist() == shared
    assert alignment.shared_cuts(np.array(a), np.array(b), np.array(shared[::3])).tolist() == shared


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t '.9é▁s"), max_size=30))
def test_segments_give_the_tokens_of_the_whole_text(text):
    segments = alignment.Segments.at(*alignment.default_tokenizers())
    cut = segments.cut(text)
    assert " ".join(cut) == text
    whole = segments.a.encode(" " + text, add_special_tokens=False).ids
    assert [i for s in cut for i in segments.a.encode(" " + s, add_special_tokens=False).ids] == whole
    if text and "▁" not in text:
        assert [i for s in cut for i in segments.b.encode(s)] == segments.b.encode(text)


@pytest.mark.parametrize("kept", [0, 3])
def test_a_full_store_starts_anew(kept, monkeypatch):
    segments = alignment.Segments(*alignment.default_tokenizers())
    want = list(segments.documents(TEXTS))
    monkeypatch.setattr(alignment, "KEPT_SEGMENTS", kept)
    assert [x for t in TEXTS for x in segments.documents([t])] == want

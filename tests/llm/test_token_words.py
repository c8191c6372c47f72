import random

import numpy as np
from tokenizers import Tokenizer

from foliant.llm import rangecoder, tokenfiles

ODD = [*"aZzÀÖ×öøİıɏɐßſΣσ0٣½'sStTdDml.,!#=-_`~<|>^\"\\[]{}/:@ \t\n\r\x0b\x0c\x1c\x85\u00a0\u2003\u0301\u0331\u0338é€Å漢가ᄀ😀\u200d\x00\x7f’ǅŉ", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a\u0301", "H\u0331", "=\u0338"]


def test_cut_words_have_the_ids_of_whole_texts():
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(0, 30))) for _ in range(4000)]
    want = [e.ids for e in Tokenizer.from_file(tokenfiles.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    encoder = tokenfiles.PieceEncoder(tokenfiles.default_tokenizer())
    assert encoder.last is not None
    got = [ids.tolist() for i in range(0, len(texts), 500) for ids in encoder.encode([t.encode() for t in texts[i : i + 500]])]
    assert got == want
    encoder.last = None  # a tokenizer of another make: pieces are encoded whole
    encoder.clear()
    assert [ids.tolist() for ids in encoder.encode([t.encode() for t in texts])] == want


def test_words_of_different_pieces_are_encoded_once(monkeypatch):
    encoder = tokenfiles.PieceEncoder(tokenfiles.default_tokenizer())
    sent, encode = [], encoder._one_by_one
    monkeypatch.setattr(encoder, "_one_by_one", lambda texts, words=False: [sent.extend(t.split()) for t in texts] and encode(texts, words))
    monkeypatch.setattr(tokenfiles, "KEPT_PIECES", 3)
    monkeypatch.setattr(tokenfiles, "KEPT_WORDS", 3)
    encoder.encode([b"Word*** word### (word) WORD, word12", "Größe größe***".encode()])
    assert sorted(sent) == ["###", "(", ")", "***", ",", "1", "2", "größe", "word"]
    again = [ids.tolist() for ids in encoder.encode([b"Word*** other", b""])]
    encoder.clear()
    assert again == [ids.tolist() for ids in encoder.encode([b"Word*** other", b""])] and again[1] == []


def test_blocks_are_coded_alike_alone_and_side_by_side():
    rnd = np.random.default_rng(3)
    blocks = [(rnd.zipf(1.2, n) % 65536).astype(np.uint32) for n in (1, 31, 32, 33, 129, 1025, 2048, 2048, 5000)]
    blocks += [np.full(1500, 65535, np.uint32), np.zeros(700, np.uint32), np.tile(rnd.integers(0, 65536, 3), 700).astype(np.uint32), np.repeat(rnd.integers(0, 65536, 300), 7).astype(np.uint32)]
    payloads = rangecoder.encode_blocks(blocks)
    assert payloads == [rangecoder.encode_blocks([b])[0] for b in blocks]
    for block, got in zip(blocks, rangecoder.decode_blocks(payloads, [len(b) for b in blocks]), strict=True):
        assert (block == got).all()
    assert len(payloads[9]) < 40 and len(payloads[11]) < 100


def test_damaged_blocks_end_with_ids_or_an_error():
    ids = (np.random.default_rng(4).zipf(1.2, 3000) % 65536).astype(np.uint32)
    payload = rangecoder.encode_blocks([ids])[0]
    for damaged in (payload[:-400], payload[: len(payload) // 2 - 1], b"", b"\xff" * len(payload)):
        assert len(rangecoder.decode_blocks([damaged], [3000])[0]) == 3000

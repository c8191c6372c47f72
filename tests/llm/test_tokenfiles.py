import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliant.llm import queries, rangecoder, tokenfiles
from foliant.llm.common import shared_dir

TEXTS = ["Hello world, it's 2024!", "", None, "a\tb\nc", "Élan vital — naïve", "<|endoftext|> x", "word " * 9000, "tabs\x0b\x0c end ", "😀 emoji 😀"]


def brute(rows):
    t = Tokenizer.from_file(tokenfiles.default_tokenizer())
    start, out = 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((str(doc), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_encoding_one_by_one(spark, tmp_path):
    rows = [(i * 7, t) for i, t in enumerate(TEXTS * 12)]
    spark.createDataFrame([(d, t, "x") for d, t in reversed(rows)], "doc_id long, text string, start string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_range_coder(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(brute(rows))


def test_repeated_and_null_ids_and_empty(spark):
    rows = [(None, "n"), (3, "b"), (3, "a"), (3, "a"), (1, None)]
    folder = f"{shared_dir(spark)}/tokens-test"
    tokenfiles.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    got = tokenfiles.read_token_files(spark, folder).collect()
    want = brute([(None, "n"), (1, None), (3, "a"), (3, "a"), (3, "b")])
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in got)
    tokenfiles.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder + "-none")
    assert tokenfiles.read_token_files(spark, folder + "-none").count() == 0


def test_range_coder_round_trip_and_size():
    rnd = np.random.default_rng(1)
    blocks = [rnd.integers(0, 65536, n).astype(np.uint32) for n in (1, 2, 63, 64, 65, 4096)]
    blocks += [np.zeros(4096, np.uint32), np.tile(np.arange(40, dtype=np.uint32) * 977, 100), (rnd.zipf(1.3, 4096) % 49408).astype(np.uint32), np.full(3, 65535, np.uint32)]
    payloads = rangecoder.encode_blocks(blocks)
    for a, b in zip(blocks, rangecoder.decode_blocks(payloads, [len(b) for b in blocks]), strict=True):
        assert (a == b).all()
    assert len(payloads[6]) < 200 and len(payloads[7]) < 1500 and len(payloads[8]) < 2 * 4096
    assert (rangecoder.decode_blocks([payloads[8]], [4096])[0] == blocks[8]).all()


def test_damage_is_noticed(spark):
    ids = [np.arange(500, dtype=np.uint32)]
    run = bytearray(rangecoder.pack_blocks(rangecoder.encode_blocks(ids), ids))
    run[-40] ^= 1
    row = {"run": bytes(run), "n_ids": 500}

    class Batch:
        def to_pylist(self):
            return [row]

    with pytest.raises(ValueError, match="checksum"):
        list(tokenfiles._decoded(iter([Batch()])))
    with pytest.raises(ValueError, match="cut short"):
        rangecoder.unpack_blocks(bytes(run[:-1]))


def test_ids_beyond_two_bytes_are_refused():
    with pytest.raises(ValueError, match="65,536"):
        rangecoder.encode_blocks([np.array([1, 65_536], np.uint32)])

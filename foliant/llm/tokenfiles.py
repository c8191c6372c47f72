"""Token-id files: documents as ids of a public tokenizer, range-coded in runs of independent blocks.

A table of token files has one row per run of whole documents: its part (files are in order of part, runs
in order within a part), its place in the part, the coded blocks, and ids and lengths of its documents.
Any run decodes by itself, and each of its blocks too.

Texts are cut at white space, which the tokenizer drops, and each distinct piece is encoded once in a
worker; so ids are those of the whole text (special strings in texts included). Where the tokenizer itself goes on to
cut into letters, digits and marks, pieces of nothing else are cut likewise and each distinct word is encoded once.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keyed, text_bytes
from foliant.llm.rangecoder import BLOCK, decode_blocks, encode_blocks, pack_blocks, unpack_blocks
from foliant.llm.substrings import _columns

END_ID = 2
#: Ids of a run, at least; its last document may go beyond.
RUN_IDS = 64 * BLOCK
#: Ids that a task codes side by side.
SIDE_BY_SIDE = 4096 * BLOCK
#: Pieces, and words in them, whose ids a worker keeps before it begins anew.
KEPT_PIECES, KEPT_WORDS = 700_000, 800_000
#: Words that are encoded as one text.
JOINED = 64
#: How a tokenizer whose words are known from the text alone takes it apart, and the words of letters that no normalization joins, single digits
#: and marks of ASCII. An apostrophe may begin a word of letters, and U+0130 becomes a letter and a mark; pieces with those are encoded as they are.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
SCHEMA = "part int, place int, first_id long, n_ids long, run binary, doc_ids array<long>, lengths array<long>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Numbers(dict):
    """Numbers of keys from 0, in order of their first use; ``new`` has those that came since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class _Ids:
    """Ids of numbered keys, laid end to end."""

    def __init__(self):
        self.of, self.ids = _Numbers(), np.empty(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(size) - size))
        self.size, self.ids = np.concatenate((self.size, size)), np.concatenate((self.ids, ids))
        self.of.new.clear()

    def take(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the keys with these numbers, and how many ids each group of ``counts`` keys has."""
        size = self.size[at]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(n) + np.repeat(self.first[at] - ends + size, size)]
        return ids, np.diff(np.append(0, ends)[np.cumsum(counts)], prepend=0)


def _flat(lists: list[list]) -> tuple[Iterator, np.ndarray]:
    return itertools.chain.from_iterable(lists), np.fromiter(map(len, lists), np.int64, len(lists))


class PieceEncoder:
    """Ids of texts, by way of bounded stores of the ids of their pieces and of the words of those."""

    _of: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are lowered and cut already.
        self.of_words = Tokenizer(self.tokenizer.model)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        with open(path, encoding="utf-8") as f:
            self.last = self._last_of_words(json.load(f))
        self.clear()

    @staticmethod
    def _last_of_words(made: dict) -> np.ndarray | None:
        """For each id whether it ends a word, if words are those of ``WORDS`` and the ids of joined words can be told apart; else None."""
        if [n.get("type") for n in (made.get("normalizer") or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or made["normalizer"]["normalizers"][1]["pattern"] != {"Regex": "\\s+"}:
            return None
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [p.get("type") for p in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": CUT} or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True):
            return None
        if steps[1]["add_prefix_space"] or steps[1]["use_regex"] or made["model"].get("end_of_word_suffix") != "</w>" or made["model"].get("dropout"):
            return None
        vocab = made["model"]["vocab"]
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # A word whose last byte had no id would lose its end.
        return last if all(token + "</w>" in vocab for token in vocab if len(token) == 1) and all(t["content"].startswith("<|") for t in made["added_tokens"]) else None

    @classmethod
    def at(cls, path: str) -> PieceEncoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def clear(self) -> None:
        self.pieces, self.words = _Ids(), _Ids()

    def _one_by_one(self, texts: list[str], words: bool = False) -> list[list[int]]:
        return [e.ids for e in (self.of_words if words else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _add_words(self) -> None:
        """Ids of the new words; those of each end with the first that ends a word."""
        new = self.words.of.new
        joined = [" ".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED)]
        ids = np.fromiter(itertools.chain.from_iterable(self._one_by_one(joined, words=True)), np.uint32)
        size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(size) != len(new) or size.sum() != len(ids):
            raise ValueError("the tokenizer doesn't end each word")
        self.words.add(ids, size)

    def _add_pieces(self) -> None:
        new = [p.decode("utf-8", "replace") for p in self.pieces.of.new]
        if len(self.words.of) > KEPT_WORDS:
            self.words = _Ids()
        at, counts, whole, number = [], [], [], self.words.of.__getitem__
        for i, piece in enumerate(new):
            # The tokenizer lowers letters as well, after it has joined marks to them; pieces with marks aren't cut.
            lower = piece.lower()
            if self.last is not None and lower.isalpha() and lower.isascii():
                at.append(number(lower))
                counts.append(1)
                continue
            words = WORDS.findall(lower) if self.last is not None and "<|" not in piece else []
            if "".join(words) != lower:
                whole.append(i)
                words = []
            at.extend(map(number, words))
            counts.append(len(words))
        at, counts = np.array(at, np.int64), np.array(counts, np.int64)
        if self.words.of.new:
            self._add_words()
        ids, size = self.words.take(at, counts)
        if whole:
            others, n = _flat(self._one_by_one([new[i] for i in whole]))
            ids = np.insert(ids, np.repeat(np.cumsum(size)[whole], n), np.fromiter(others, np.uint32, int(n.sum())))
            size[whole] = n
        self.pieces.add(ids, size)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.pieces.of) > KEPT_PIECES:
            self.pieces = _Ids()
        # The tokenizer lowers letters; in texts of ASCII without special strings there is nothing that this could join otherwise.
        pieces, counts = _flat([(t.lower() if self.last is not None and t.isascii() and b"<|" not in t else t).split() for t in texts])
        at = np.fromiter(map(self.pieces.of.__getitem__, pieces), np.int64, int(counts.sum()))
        if self.pieces.of.new:
            self._add_pieces()
        ids, size = self.pieces.take(at, counts)
        return np.split(ids, np.cumsum(size)[:-1]) if len(texts) else []


def _encoded_runs(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of their key -> runs of whole documents, numbered within the task's part."""
    part = TaskContext.get().partitionId()
    encoder = PieceEncoder.at(path)
    place = first_id = held = 0
    docs: list[tuple[int | None, np.ndarray]] = []

    def runs() -> pa.RecordBatch:
        nonlocal place, first_id
        groups, size = [[]], 0
        for doc in docs:
            if size >= RUN_IDS:
                groups.append([])
                size = 0
            groups[-1].append(doc)
            size += len(doc[1])
        docs.clear()
        ids = [np.concatenate([d[1] for d in g]) for g in groups]
        groups = [[(doc_id, len(own)) for doc_id, own in g] for g in groups]
        blocks = [[x[i : i + BLOCK] for i in range(0, len(x), BLOCK)] for x in ids]
        payloads = iter(encode_blocks([b for run in blocks for b in run]))
        coded = [pack_blocks([next(payloads) for _ in run], run) for run in blocks]
        starts = first_id + np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]
        found = pa.RecordBatch.from_arrays(
            [
                pa.array([part] * len(groups), pa.int32()),
                pa.array(range(place, place + len(groups)), pa.int32()),
                pa.array(starts, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array(coded, pa.binary()),
                pa.array([[d[0] for d in g] for g in groups], pa.list_(pa.int64())),
                pa.array([[d[1] for d in g] for g in groups], pa.list_(pa.int64())),
            ],
            names=["part", "place", "first_id", "n_ids", "run", "doc_ids", "lengths"],
        )
        place, first_id = place + len(groups), first_id + sum(len(x) for x in ids)
        return found

    for batch in rows:
        key, body = _columns(batch, "doc_id", "body")
        for i in range(0, len(key), 256):
            for doc_id, ids in zip(key[i : i + 256].to_pylist(), encoder.encode(body[i : i + 256].to_pylist()), strict=True):
                docs.append((doc_id, np.append(ids, np.uint32(END_ID))))
                held += len(ids) + 1
            if held >= SIDE_BY_SIDE:
                yield runs()
                held = 0
    if docs:
        yield runs()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, parts: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Writes the documents' ids as token files, in order of key, then text, nulls first.

    Null and empty texts have the end id alone; repeated rows are written as often as they come. An empty table
    writes files without runs. Other columns are left out.
    """
    path = tokenizer or default_tokenizer()
    rows = keyed(docs, key, text)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("rid", "doc_id", text_bytes("text").alias("body")).repartitionByRange(parts, "rid").sortWithinPartitions("rid")
    placed.mapInArrow(lambda batches: _encoded_runs(batches, path), SCHEMA).write.parquet(folder)


def _decoded(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """Groups of runs with the ids of each; a block whose ids don't match its checksum raises."""

    def decode(held: list[dict]) -> list[np.ndarray]:
        runs = [unpack_blocks(r["run"]) for r in held]
        blocks = iter(decode_blocks([p for r in runs for p in r[0]], [n for r in runs for n in r[1]]))
        found = []
        for _, lengths, sums in runs:
            own = [next(blocks) for _ in lengths]
            for ids, want in zip(own, sums, strict=True):
                if zlib.crc32(ids.astype("<u4").tobytes()) != want:
                    raise ValueError("a block of token ids doesn't match its checksum")
            found.append(np.concatenate(own) if own else np.empty(0, np.uint32))
        return found

    held, size = [], 0
    for batch in rows:
        for row in batch.to_pylist():
            held.append(row)
            size += row["n_ids"]
            if size >= SIDE_BY_SIDE:
                yield held, decode(held)
                held, size = [], 0
    if held:
        yield held, decode(held)


def read_token_files(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids array<int> if wanted) of each document in the files.

    start: ids of all documents before it, from the parts' totals (one row for each part).
    """
    runs = spark.read.schema(SCHEMA).parquet(folder)

    def documents(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, decoded in _decoded(rows):
            out: dict[str, list] = {"part": [], "doc_id": [], "at": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for run, ids in zip(held, decoded, strict=True):
                at = 0
                for doc_id, n in zip(run["doc_ids"], run["lengths"], strict=True):
                    own = ids[at : at + n]
                    out["part"].append(run["part"])
                    out["doc_id"].append(doc_id)
                    out["at"].append(run["first_id"] + at)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
                    out["ids"].append(own.astype(np.int32) if with_ids else None)
                    at += n
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    found = runs.mapInArrow(documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<int>")
    totals = sorted((r["part"], r["n"]) for r in runs.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    starts = spark.createDataFrame(rows, "part int, before long")
    # Bounded by the number of parts.
    joined = found.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return joined if with_ids else joined.drop("ids")

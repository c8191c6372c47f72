"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Two tokenizers read the same bytes. Offsets where a token of both ends are shared cuts; they cut the tokens into
groups. Cuts are found by divide and conquer: from the middle end of one side outward, an end is looked up on the other
side by bisect; both halves are cut on their own, and an interval without a shared end is a group.

A single space between two characters that aren't white space always is a shared cut, because neither tokenizer has a
token that goes on over it. So texts divide there first, and each distinct segment is encoded and cut once in a worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import scratch, text_bytes

#: Segments that a worker keeps, their characters, and those of the longest that outlives others.
KEPT_SEGMENTS, KEPT_CHARACTERS, LONGEST_KEPT = 400_000, 8_000_000, 200
#: Characters of texts that are cut into segments at once.
AT_ONCE = 400_000
#: Different id pairs of the corpus that are broadcast (17 bytes each); beyond, documents meet their pairs by a join.
BROADCAST_PAIRS = 3_000_000
#: Where a text divides: before a single space between two characters that aren't white space.
DIVIDE = re.compile(r" (?<=\S )(?=\S)")
#: Texts without it have no other spaces than those.
SPACES = re.compile(r"\s\s")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Ends that two sorted arrays of token ends share, in order; the last end of both is one. Divide and conquer.

    An interval is cut at the shared end that is nearest to the middle of its shorter side, counted in tokens; all intervals
    are searched side by side. ``first``: shared ends that are known already, in order.
    """
    known = np.empty(0, np.int64) if not len(a) else a[-1:] if first is None or not len(first) else first if first[-1] == a[-1] else np.append(first, a[-1])
    # Tokens from x0 to x1 of one side and y0 to y1 of the other, both with the interval's shared last end.
    a1, b1 = np.searchsorted(a, known), np.searchsorted(b, known)
    a0, b0 = (np.concatenate(([0], x[:-1] + 1)) for x in (a1, b1))
    cuts = [known]
    while len(a0):
        inner = (a0 < a1) & (b0 < b1)
        a0, a1, b0, b1 = a0[inner], a1[inner], b0[inner], b1[inner]
        swap = a1 - a0 > b1 - b0
        open_, step = np.arange(len(a0)), 0
        at_a, at_b = np.full(len(a0), -1), np.full(len(a0), -1)
        size = np.where(swap, b1 - b0, a1 - a0)
        middle = np.where(swap, b0 + b1 - 1, a0 + a1 - 1) // 2
        while len(open_):
            i = middle[open_] + (step + 1) // 2 * (1 if step % 2 else -1)
            swapped = swap[open_]
            low, high = np.where(swapped, b0[open_], a0[open_]), np.where(swapped, b1[open_], a1[open_])
            ok = (i >= low) & (i < high)
            i = np.where(ok, i, low)
            end = np.where(swapped, b[np.minimum(i, len(b) - 1)], a[np.minimum(i, len(a) - 1)])
            j = np.where(swapped, np.searchsorted(a, end), np.searchsorted(b, end))
            other = np.where(swapped, a[np.minimum(j, len(a) - 1)], b[np.minimum(j, len(b) - 1)])
            hit = ok & (other == end)
            at_a[open_[hit]] = np.where(swapped, j, i)[hit]
            at_b[open_[hit]] = np.where(swapped, i, j)[hit]
            step += 1
            open_ = open_[~hit & (step <= size[open_])]
        found = at_a >= 0
        a0, a1, b0, b1, at_a, at_b = (x[found] for x in (a0, a1, b0, b1, at_a, at_b))
        cuts.append(a[at_a])
        a0, a1 = np.concatenate((a0, at_a + 1)), np.concatenate((at_a, a1))
        b0, b1 = np.concatenate((b0, at_b + 1)), np.concatenate((at_b, b1))
    return np.sort(np.concatenate(cuts))


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type, *width: int):
        self.data, self.size = np.empty((1024, *width), kind), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            self.data = np.concatenate((self.data[: self.size], np.empty((need, *self.data.shape[1:]), self.data.dtype)))
        self.data[self.size : need] = more
        self.size = need


class Segments:
    """Tokens, groups and linked pairs of segments, from a bounded store of those seen before. A segment follows a space."""

    _of: dict[tuple[str, str], Segments] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        of_char = byte_level()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(of_char[c] for c in entry) if all(c in of_char for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        # A splits texts by the byte-level pattern, where a space begins a token; no piece of B goes on over one. Else texts are one segment each.
        before = json.loads(self.a.to_str()).get("pre_tokenizer") or {}
        self.divides = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any(re.search(rb"[^ ] ", x) for x in self.bytes_b)
        self.len_a, self.len_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.clear()

    @classmethod
    def at(cls, path_a: str, path_b: str) -> Segments:
        if (path_a, path_b) not in cls._of:
            cls._of[path_a, path_b] = cls(path_a, path_b)
        return cls._of[path_a, path_b]

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.held = 0
        self.counts, self.first, self.links, self.seen = Growing(np.int64, 4), Growing(np.int64), Growing(np.uint64), Growing(np.int64)

    def make_room(self) -> None:
        """Forgets all segments but the most frequent ones of those that came more than once."""
        seen = self.seen.data[: self.seen.size]
        often = max(2, int(np.partition(seen, -(KEPT_SEGMENTS // 3))[-(KEPT_SEGMENTS // 3)]) + 1 if len(seen) > KEPT_SEGMENTS // 3 else 2)
        kept = [(s, self.groups[i], i) for s, i in self.number.items() if seen[i] >= often and len(s) <= LONGEST_KEPT]
        counts, first, links = self.counts.data, self.first.data, self.links.data
        self.clear()
        at = np.array([i for _, _, i in kept], np.int64)
        self.number.update((s, k) for k, (s, _, _) in enumerate(kept))
        self.groups = [g for _, g, _ in kept]
        self.held = sum(map(len, self.number))
        n = counts[at, 3]
        self.counts.extend(counts[at])
        self.first.extend(np.cumsum(n) - n)
        self.links.extend(links[spread(first[at], n)])
        self.seen.extend(np.ones(len(at), np.int64))

    def cut(self, text: str) -> list[str]:
        """Segments of a text, each without the space before it; the text follows a space itself."""
        if not self.divides:
            return [text]
        if not SPACES.search(f" {text} "):
            return text.split(" ")
        first, *rest = DIVIDE.split(f" {text}")
        return [first[1:], *rest]

    def learn(self, segments: Iterable[str]) -> None:
        """Encodes segments that the store hasn't got, and cuts them at the ends that both sides share."""
        new = [s for s in segments if s not in self.number]
        if not new:
            return
        bodies = [b" " + s.encode() for s in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {s}" for s in new], add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        flat = [list(chain.from_iterable(ids)) for ids in (ids_a, ids_b)]
        whole = b"".join(bodies)
        if all(b"".join([of[i] for i in ids]) == whole for of, ids in zip((self.bytes_a, self.bytes_b), flat, strict=True)) and self._sizes_agree(bodies, (ids_a, ids_b), flat):
            same = [True] * len(new)
        else:
            same = [b"".join([self.bytes_a[i] for i in a]) == body == b"".join([self.bytes_b[i] for i in b]) for body, a, b in zip(bodies, ids_a, ids_b, strict=True)]
            flat = [[i for ids, ok in zip(side, same, strict=True) if ok for i in ids] for side in (ids_a, ids_b)]
        # All that can be aligned side by side: ends of segments are shared ones.
        size = np.cumsum([len(body) for body, ok in zip(bodies, same, strict=True) if ok])
        a, b = (np.array(ids, np.int64) for ids in flat)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts = shared_cuts(ends_a, ends_b, size)
        groups = grouped(a, b, np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1)
        last = np.concatenate(([0], np.searchsorted(cuts, size) + 1)) if len(size) else np.zeros(1, np.int64)
        n_groups = np.diff(last)
        counts = np.zeros((len(new), 4), np.int64)
        n_a, n_b = (np.array([len(ids) for ids, ok in zip(side, same, strict=True) if ok], np.int64) for side in (ids_a, ids_b))
        counts[np.array(same)] = np.column_stack((n_a, n_b, n_groups, n_a + n_b - n_groups))
        base = len(self.number)
        self.number.update((s, base + k) for k, s in enumerate(new))
        spans = iter(zip(last[:-1].tolist(), last[1:].tolist(), strict=True))
        self.groups += [";".join(groups[slice(*next(spans))]) if ok else None for ok in same]
        self.held += sum(map(len, new))
        self.counts.extend(counts)
        self.first.extend(self.links.size + np.cumsum(counts[:, 3]) - counts[:, 3])
        self.seen.extend(np.zeros(len(new), np.int64))
        self.links.extend(self.linked(a, b))

    def _sizes_agree(self, bodies: list[bytes], sides: tuple, flat: list[list[int]]) -> bool:
        """Whether each segment's tokens have as many bytes as the segment, on either side."""
        want = np.cumsum(list(map(len, bodies)))
        for lengths, side, ids in zip((self.len_a, self.len_b), sides, flat, strict=True):
            ends = np.cumsum(lengths[np.array(ids, np.int64)])
            n = np.array(list(map(len, side)))
            if not n.all() or (ends[np.cumsum(n) - 1] != want).any():
                return False
        return True

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of tokens of the same bytes that have a byte in common, as a * 2^32 + b: one for each stretch between ends of either side."""
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
        return a[np.searchsorted(ends_a, ends)].astype(np.uint64) << np.uint64(32) | b[np.searchsorted(ends_b, ends)].astype(np.uint64)

    def documents(self, texts: list[str | None]) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, distinct pairs, their times) of each text, in order; None and what can't be aligned has none."""
        none = (0, 0, 0, 0, "", b"", b"")
        cut = [self.cut(t) if t else [] for t in texts]
        distinct = set().union(*cut) if cut else set()
        if len(self.number) + len(distinct) > KEPT_SEGMENTS or self.held > KEPT_CHARACTERS:
            self.make_room()
        self.learn(distinct)
        get, places = self.number.__getitem__, []
        for segments in cut:
            if not segments:
                yield none
                continue
            at = np.fromiter(map(get, segments), np.int64, len(segments))
            counts = self.counts.data[at]
            if not counts[:, 0].all():
                yield none
                continue
            links = np.sort(self.links.data[spread(self.first.data[at], counts[:, 3])])
            first = np.flatnonzero(np.concatenate(([True], links[1:] != links[:-1])))
            times = np.diff(np.append(first, len(links)))
            places.append(at)
            yield (*map(int, counts.sum(axis=0)), ";".join([self.groups[i] for i in at.tolist()]), links[first].tobytes(), times.astype("<u4").tobytes())
        if places:
            self.seen.data[: self.seen.size] += np.bincount(np.concatenate(places), minlength=self.seen.size)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, … of each of the runs, n long, one run after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def grouped(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> list[str]:
    """Groups as a1,a2|b1: the ids of either side up to each of the given places."""
    a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    out, i, j = [], 0, 0
    for i2, j2 in zip(to_a.tolist(), to_b.tolist(), strict=True):
        left = a[i] if i2 == i + 1 else ",".join(a[i:i2])
        out.append(f"{left}|{b[j] if j2 == j + 1 else ','.join(b[j:j2])}")
        i, j = i2, j2
    return out


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _decoded(body: bytes) -> str | None:
    try:
        return body.decode()
    except UnicodeDecodeError:
        return None


def _aligned(rows: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    segments = Segments.at(*paths)
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

    def out(ids: list, texts: list) -> pa.RecordBatch:
        columns = zip(*[(i, *found) for i, found in zip(ids, segments.documents(texts), strict=True)], strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    for batch in rows:
        ids, texts, size = [], [], 0
        for i, body in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(_decoded(body.as_py()))
            size += len(texts[-1] or "")
            if size >= AT_ONCE or len(ids) == 2000:
                yield out(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield out(ids, texts)


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups and links of each text under two tokenizers: (doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times).

    tokenizers: a byte-level tokenizer's file, which reads a space and the text, and a piece model's, which adds the space itself.
    groups: ids as a1,a2|b1;a3|b2,b3. pairs, times: the distinct linked ids (a * 2^32 + b, packed as u64) and how many links
    join them (packed as u32). Null and empty texts, and those whose tokens spell other bytes on either side, have no tokens: zeros and
    empty values. Null ids stay, repeated rows each give one row, other columns are left out.
    """
    paths = tokenizers or default_tokenizers()
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_bytes(f"`{text}`").alias("body"))
    return rows.mapInArrow(lambda batches: _aligned(batches, paths), SCHEMA)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a batch, their times, and the offset of each row's first."""
    pairs = batch.column("pairs").to_pylist()
    first = np.cumsum([0, *[len(p) // 8 for p in pairs]])
    return np.frombuffer(b"".join(pairs), np.uint64), np.frombuffer(b"".join(batch.column("times").to_pylist()), "<u4").astype(np.int64), first


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links by pair, added up in the task: one row for each pair of the about two million entries before."""

    def out(held: list) -> pa.RecordBatch:
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, np.concatenate([t for _, t in held]))
        return pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(32)).astype(np.int32)), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    held, size = [], 0
    for batch in rows:
        pairs, times, _ = _unpacked(batch)
        held.append((pairs, times))
        size += len(pairs)
        if size > 2_000_000:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best) of each pair of ids: its links in all documents, and whether no other pair of b has more."""
    summed = aligned.select("pairs", "times").mapInArrow(_summed, "a int, b int, n long")
    counted = scratch(summed.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Adds n_best (links whose pair is the most frequent of its b, ties included) and count_sum (the corpus-wide counts of all links, added up).

    ``aligned``: a stored table with the columns of ``align``; all but pairs and times come back. Pairs are bounded by the vocabularies; while
    they are few they are broadcast, beyond that each document's pairs meet the counts by a shuffle, which gives the same.
    """
    spark = aligned.sparkSession
    counts = scratch(pair_counts(aligned), "counts")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() > broadcast_pairs:
        return _joined(aligned, counts, kept)
    found = counts.toArrow()
    keys = found["a"].to_numpy().astype(np.uint64) << np.uint64(32) | found["b"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], found["n"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order]))

    def looked_up(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in rows:
            pairs, times, first = _unpacked(batch)
            at = np.searchsorted(keys, pairs)
            sums = [np.concatenate(([0], np.cumsum(x))) for x in ((times * best[at], times * n[at]) if len(pairs) else (times, times))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(s[first[1:]] - s[first[:-1]], pa.int64()) for s in sums]], names=[*kept, "n_best", "count_sum"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)
    return aligned.mapInArrow(looked_up, f"{schema}, n_best long, count_sum long")


def _joined(aligned: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    """The same by a join of every document's pairs with the counts."""

    def exploded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            pairs, times, first = _unpacked(batch)
            rid = np.repeat(batch.column("rid").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array((pairs >> np.uint64(32)).astype(np.int32)), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(times)], names=["rid", "a", "b", "times"])

    rows = scratch(aligned.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    links = rows.select("rid", "pairs", "times").mapInArrow(exploded, "rid long, a int, b int, times long").join(counts, ["a", "b"])
    sums = links.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.join(sums, "rid", "left").select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")])

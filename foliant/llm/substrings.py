"""Removal of repeated substrings by a suffix array built with two-stage sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts earlier in the corpus.

1. Every window picks an anchor: the run of ``GRAM`` bytes in it whose hash is least, the leftmost of
   such. Equal windows pick equal anchors at equal places. A run of windows with one anchor is a *context*,
   so each window belongs to one context, and can only equal windows of contexts with the same anchor.
   Contexts of anchors that occur once in the corpus are done with.
2. Contexts that are equal as a whole are folded: the earliest stays, all windows of the others are repeats.
   This is the aggregation before the shuffle that keeps groups of copies, however large, small.
3. Differing contexts of one anchor meet in one task, their suffixes are sorted in two stages, and adjacent
   common prefixes of ``LENGTH`` bytes or more tell equal windows; all but the earliest are repeats.
   Anchors with more than ``CROWD`` differing contexts aren't brought together: their windows meet one by
   one under a 128-bit hash instead, which spreads over all tasks.
4. Repeats are gathered by document, and documents are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import BYTE_CODE, ODD, U64, batches, byte_ngram_hash, keyed, mix64, pack, release, scratch, text_bytes

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Differing contexts of one anchor that are sorted together.
CROWD = 4096
#: Bytes that are hashed, or contexts that are sorted, at once.
HASH_BYTES = 1 << 19
SORT_BYTES = 1 << 20
#: Starts of windows in a piece of a document; longer documents are cut into pieces that overlap by a window less a byte.
PIECE = 1 << 18
#: Rows of a batch that become Python objects at once.
ROWS = 256


# ---------------------------------------------------------------- anchors


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of every run of ``width`` values."""
    value, place, n = x, np.arange(len(x), dtype=np.int32), 1
    shift = []
    while n * 2 <= width:
        shift.append(n)
        n *= 2
    if width > n:
        shift.append(width - n)
    for k in shift:
        right = value[k:] < value[:-k]
        place = np.where(right, place[k:], place[:-k])
        value = np.where(right, value[k:], value[:-k])
    return place


class RunHash:
    """Hashes of any runs of a buffer, by differences of a polynomial's prefix sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, codes: np.ndarray = BYTE_CODE, base: int = int(ODD)):
        size = len(data) + 1
        have = self._powers.get(base)
        if have is None or len(have[0]) < size:
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = self._powers[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        self.down = have[1]
        self.prefix = np.zeros(size, np.uint64)
        np.cumsum(codes[data] * have[0][: size - 1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]


def anchors(texts: list[bytes], contexts: bool) -> tuple[np.ndarray, ...]:
    """Of every context of the texts: document, anchor hash and, if wanted, context hash, first window, anchor's place in it and last window's.

    Windows are numbered from a text's start; texts shorter than a window have none.
    """
    data, offsets = pack(texts)
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    grams = byte_ngram_hash(data, GRAM)
    place = _sliding_argmin(grams, SPAN)
    whole = np.zeros(len(place) + 1, np.int32)
    first, last = offsets[:-1], offsets[1:] - LENGTH + 1
    long = last > first
    np.add.at(whole, first[long], 1)
    np.add.at(whole, last[long], -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(starts):
        return none, none, none, none, none, none
    at = place[starts]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(starts)) - 1
    h = grams[at[low]].view(np.int64)
    if not contexts:
        return doc[low], h, none, none, none, none
    begin, end = starts[low], starts[high]
    whole_hash = RunHash(data)(begin, end + LENGTH)
    inside = at[low] - begin
    ch = mix64(whole_hash + (inside * 128 + (end - begin)).astype(np.uint64) * U64(0xD6E8FEB86659FD93)).view(np.int64)
    return doc[low], h, ch, begin - offsets[doc[low]], inside, end - begin


def _columns(batch: pa.RecordBatch, *names: str) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _pieces(body: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(row, first byte, bytes) of pieces that hold every window of the texts once."""
    for i, text in enumerate(body):
        view = text.as_buffer() if text.is_valid else b""
        for at in range(0, max(1, len(view) - LENGTH + 1), PIECE):
            yield i, at, bytes(view[at : at + PIECE + LENGTH - 1])


def _anchor_rows(rows: Iterator[pa.RecordBatch], contexts: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        rid, body = _columns(batch, "rid", "body")
        rid = rid.to_numpy()
        for group in batches(_pieces(body), HASH_BYTES):
            doc, h, ch, start, inside, more = anchors([b for _, _, b in group], contexts)
            ids = rid[np.array([i for i, _, _ in group])]
            if contexts:
                start = start + np.array([at for _, at, _ in group], np.int64)[doc]
                # Window, place of the anchor and further windows in one number: start, then 7 bits each.
                packed = (start << 14) | (inside << 7) | more
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ch), pa.array(ids[doc]), pa.array(packed)], names=["h", "ch", "rid", "at"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(h)], names=["h"])


# ---------------------------------------------------------------- two-stage suffix sorting


def _words(padded: np.ndarray) -> np.ndarray:
    """A view of the 8 bytes at every place as one big-endian number."""
    return np.ndarray(len(padded) - 8, ">u8", padded, strides=(1,))


def sort_type_b(places: np.ndarray, words: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sorts suffixes by their first ``LENGTH`` bytes, eight at a time, only going on where they tie.

    whole: a hash of each suffix's first ``LENGTH`` bytes; ties that agree in it are equal strings and done.
    """
    order = np.argsort(words[places].astype(np.uint64), kind="stable")
    places, whole = places[order], whole[order]
    key = words[places].astype(np.uint64)
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    for step in range(1, -(-LENGTH // 8)):
        if not len(places):
            break
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        differ = np.minimum.reduceat(whole, first) != np.maximum.reduceat(whole, first)
        size = np.diff(np.append(first, len(places)))
        at = np.flatnonzero(np.repeat(differ, size))
        if not len(at):
            break
        key = words[places[at] + 8 * step].astype(np.uint64)
        sub = np.lexsort((key, group[at]))
        places[at], whole[at], key = places[at][sub], whole[at][sub], key[sub]
        # Groups are split where the word changes; numbers stay in order, as groups are renumbered below.
        cut = np.zeros(len(places), bool)
        cut[at[1:]] = key[1:] != key[:-1]
        group = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])) | cut)
    return places


def two_stage_order(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` suffixes of a buffer of 0-terminated strings, in the order of their first ``LENGTH`` bytes.

    Suffixes smaller than their successors (type B) are sorted directly. The others (type A) are induced: scanning
    the buckets of first bytes in order, each suffix found puts its predecessor, if that is of type A, next in
    the bucket of its own first byte. Only suffixes that wanted ones are induced from take part.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(LENGTH + 16, np.uint8)))
    change = np.append(np.flatnonzero(data[:-1] != data[1:]), n - 1)
    follow = change[np.searchsorted(change, np.arange(n))]
    is_a = data[follow] > padded[follow + 1]
    base = np.flatnonzero(~is_a | (data == 0))
    source = base[np.searchsorted(base, np.arange(n))]
    taking = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(taking, at, 1)
    np.add.at(taking, source[at] + 1, -1)
    part = np.cumsum(taking[:-1]) > 0
    is_a &= data != 0
    b_places = np.flatnonzero(part & ~is_a & (data != 0))
    hashed = RunHash(padded)
    b_places = sort_type_b(b_places, _words(padded), mix64(hashed(b_places, b_places + LENGTH)))
    b_first = data[b_places]
    edge = np.searchsorted(b_first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced = part & is_a

    def push(found: np.ndarray, byte: int) -> None:
        before = found[found > 0] - 1
        before = before[induced[before]]
        first = data[before]
        before, first = before[first > byte], first[first > byte]
        by_byte = np.argsort(first, kind="stable")
        before, first = before[by_byte], first[by_byte]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for piece in np.split(before, cut) if len(before) else ():
            waiting[data[piece[0]]].append(piece)

    push(np.flatnonzero(part & (data == 0)), 0)
    out = []
    for byte in range(1, 256):
        found = []
        level = np.concatenate(waiting[byte]) if waiting[byte] else None
        while level is not None and len(level):
            found.append(level)
            before = level[level > 0] - 1
            level = before[induced[before] & (data[before] == byte)]
        if edge[byte + 1] > edge[byte]:
            found.append(b_places[edge[byte] : edge[byte + 1]])
        if found:
            bucket = np.concatenate(found)
            push(bucket, byte)
            out.append(bucket)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def adjacent_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, in bytes up to ``LENGTH``; 0 for the first."""
    padded = np.concatenate((data, np.zeros(LENGTH + 16, np.uint8)))
    words = _words(padded)
    common = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for step in range(-(-LENGTH // 8)):
        if not len(alive):
            break
        x = words[order[alive] + 8 * step].astype(np.uint64) ^ words[order[alive - 1] + 8 * step].astype(np.uint64)
        same = x == 0
        common[alive[same]] += 8
        rest, x = alive[~same], x[~same]
        bytes_same = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            bytes_same += x < (U64(1) << U64(64 - 8 * k))
        common[rest] += bytes_same
        alive = alive[same]
    return np.minimum(common, LENGTH)


def repeats(contexts: list[bytes], rid: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, last window) runs of windows that equal an earlier one among these contexts.

    Earlier: smaller rid, or same rid and smaller start. A context holds ``windows`` windows from ``start`` on.
    """
    raw, offsets = pack(contexts, gap=b"\xff")
    # UTF-8 has no byte 0xFF: it ends a context, and all bytes move up by one to make room for the end mark 0.
    data = raw + np.uint8(1)
    wanted = np.zeros(len(data) + 1, np.int32)
    np.add.at(wanted, offsets[:-1], 1)
    np.add.at(wanted, offsets[:-1] + windows, -1)
    order = two_stage_order(data, np.cumsum(wanted[:-1]) > 0)
    if not len(order):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(adjacent_prefixes(data, order) < LENGTH)
    of = np.searchsorted(offsets, order, side="right") - 1
    at = start[of] + order - offsets[of]
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((at, rid[of]))] = np.arange(len(order))
    least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(order))))
    again = rank != least
    places = np.sort(order[again])
    if not len(places):
        return (np.empty(0, np.int64),) * 3
    of = np.searchsorted(offsets, places, side="right") - 1
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (of[1:] != of[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(places)) - 1
    return of[low], start[of[low]] + places[low] - offsets[of[low]], start[of[low]] + places[high] - offsets[of[low]]


# ---------------------------------------------------------------- Spark


def _sliced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _context_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the listed contexts out of each document."""
    for batch in _sliced(rows):
        for rid, body, listed in zip(*[c.to_pylist() for c in _columns(batch, "rid", "body", "listed")], strict=True):
            start = [x["at"] >> 14 for x in listed]
            windows = [(x["at"] & 127) + 1 for x in listed]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x["h"] for x in listed], pa.int64()),
                    pa.array([x["crowded"] for x in listed], pa.bool_()),
                    pa.array([rid] * len(listed), pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(windows, pa.int64()),
                    pa.array([body[s : s + w + LENGTH - 1] for s, w in zip(start, windows, strict=True)], pa.binary()),
                ],
                names=["h", "crowded", "rid", "start", "windows", "context"],
            )


def _sorted_marks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h -> marks; contexts of one h are always sorted together."""

    def marks(held: list) -> pa.RecordBatch:
        rid = np.array([r[1] for r in held], np.int64)
        of, low, high = repeats([r[4] for r in held], rid, np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64))
        return pa.RecordBatch.from_arrays([pa.array(rid[of]), pa.array(low), pa.array(high)], names=["rid", "low", "high"])

    held, size = [], 0
    for batch in rows:
        for row in zip(*[c.to_pylist() for c in _columns(batch, "h", "rid", "start", "windows", "context")], strict=True):
            if size >= SORT_BYTES and row[0] != held[-1][0]:
                yield marks(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield marks(held)


def _window_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts under two 64-bit hashes."""
    for batch in rows:
        columns = [c.to_pylist() for c in _columns(batch, "rid", "start", "windows", "context")]
        for group in batches(zip(*columns, strict=True), HASH_BYTES):
            data, offsets = pack([g[3] for g in group])
            windows = np.array([g[2] for g in group], np.int64)
            of = np.repeat(np.arange(len(group)), windows)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = offsets[of] + inside
            one = mix64(RunHash(data)(begin, begin + LENGTH)).view(np.int64)
            two = mix64(RunHash(data, mix64(BYTE_CODE), 0xC2B2AE3D27D4EB4F)(begin, begin + LENGTH)).view(np.int64)
            rid, start = np.array([g[0] for g in group], np.int64)[of], np.array([g[1] for g in group], np.int64)[of] + inside
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(rid), pa.array(start)], names=["w1", "w2", "rid", "start"])


def _cut_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the marked windows out of each document: what is kept, and the spans removed."""
    for batch in _sliced(rows):
        kept, starts, ends = [], [], []
        for body, marks in zip(*[c.to_pylist() for c in _columns(batch, "body", "marks")], strict=True):
            spans: list[list[int]] = []
            for low, high in sorted((m["low"], m["high"] + LENGTH) for m in marks or ()):
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
            pieces, at = [], 0
            for low, high in spans:
                pieces.append(body[at:low])
                at = high
            kept.append(b"".join([*pieces, body[at:]]))
            starts.append([s for s, _ in spans])
            ends.append([e for _, e in spans])
        listed = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*_columns(batch, "rid", "doc_id", "n_bytes"), pa.array(kept, pa.binary()), pa.array(starts, listed), pa.array(ends, listed)], names=["rid", "doc_id", "n_bytes", "kept", "starts", "ends"])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(rid, body) with unique rids -> (rid, low, high): runs of windows that also start earlier."""
    spark = docs.sparkSession
    counted = docs.mapInArrow(lambda rows: _anchor_rows(rows, False), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written first, so that the join below reads two plain shuffles and Spark can split a frequent anchor between tasks.
    counted = scratch(counted.select("h"), "repeated")
    listed = docs.mapInArrow(lambda rows: _anchor_rows(rows, True), "h long, ch long, rid long, at long")
    listed = scratch(listed.join(counted, "h", "left_semi"), "anchors")
    release(spark)
    folded = scratch(listed.groupBy("h", "ch").agg(F.min(F.struct("rid", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "folded")
    copies = listed.join(folded.where("n > 1").select("h", "ch", "first"), ["h", "ch"]).where("not (rid = first.rid and at = first.at)")
    copies = copies.select("rid", F.shiftright("at", 14).alias("low"), (F.shiftright("at", 14) + F.col("at").bitwiseAND(127)).alias("high"))
    differ = folded.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    firsts = folded.join(differ, "h").select(F.col("first.rid").alias("rid"), F.struct("h", F.col("first.at").alias("at"), (F.col("contexts") > CROWD).alias("crowded")).alias("one"))
    by_doc = firsts.groupBy("rid").agg(F.collect_list("one").alias("listed"))
    contexts = docs.join(by_doc, "rid").mapInArrow(_context_rows, "h long, crowded boolean, rid long, start long, windows long, context binary")
    contexts = scratch(contexts, "contexts")
    release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = contexts.where("not crowded").repartition(parts, "h").sortWithinPartitions("h")
    marks = met.mapInArrow(_sorted_marks, "rid long, low long, high long").unionByName(copies)
    windows = contexts.where("crowded").repartition(parts, "rid", "start").mapInArrow(_window_rows, "w1 long, w2 long, rid long, start long")
    windows = scratch(windows, "windows")
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("rid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = windows.join(least, ["w1", "w2"]).where("not (rid = first.rid and start = first.start)")
    return marks.unionByName(_runs(again.select("rid", "start")))


def _runs(starts: DataFrame) -> DataFrame:
    """Distinct (rid, start) -> (rid, low, high): neighbouring starts as one run, cut at multiples of 65,536."""
    block = F.shiftright("start", 16).alias("block")
    ranked = starts.select("rid", "start", block).withColumn("island", F.col("start") - F.row_number().over(Window.partitionBy("rid", "block").orderBy("start")))
    return ranked.groupBy("rid", "block", "island").agg(F.min("start").alias("low"), F.max("start").alias("high")).select("rid", "low", "high")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept binary, starts, ends): each document without the bytes of repeated windows.

    starts and ends: the maximal removed runs in bytes. Documents are taken in order of key, then text, nulls first,
    each row by itself: of repeated rows the first is the earlier one. Null and empty texts, and texts shorter than a
    window, lose nothing. An empty table gives an empty table; other columns are left out.
    """
    rows = keyed(docs, key, text).select("rid", "doc_id", text_bytes("text").alias("body"))
    marks = repeated_windows(rows.select("rid", "body"))
    by_doc = scratch(marks.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("marks")), "marks")
    release(docs.sparkSession)
    joined = rows.join(by_doc, "rid", "left").select("rid", "doc_id", F.length("body").cast("long").alias("n_bytes"), "body", "marks")
    return joined.mapInArrow(_cut_rows, "rid long, doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>").drop("rid")

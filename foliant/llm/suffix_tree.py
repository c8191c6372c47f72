"""Language-model scoring with a probabilistic suffix tree.

A text is a row of tokens: its words (A-Z lower-cased), then an end. Symbols are bytes: a word is its bytes and a
closing space, the end is one mark. A context is what stands before a symbol: inside a word the bytes since
the word's start and the space before it; at the start of a token that space and the last ``BACK`` bytes before it. At most
``DEPTH`` bytes of it count, places before its beginning are byte 0.

A context that occurs twice or more stays in the tree if its next-symbol distribution diverges from its parent's (the context without
its oldest byte) by ``GAIN`` nats or more over all its occurrences; parents of kept contexts stay too, however
many there are. Distributions are smoothed towards the parent's with the weight ``PRIOR``, the root's towards the
uniform one, so every text has a probability. Each symbol is scored by its longest kept suffix.

All kept contexts are a Spark table. What follows a word's first byte depends on the word alone, so it is scored once
for each distinct word: the ``STATES`` most frequent contexts reach the tasks as a broadcast, symbols whose longest
kept suffix may lie outside meet the rest by a shuffle. First bytes have 65,793 contexts at most; they are broadcast.

Words are counted over all texts that are scored, training ones and others alike. The ``FREQUENT`` most frequent reach the texts as a broadcast with their counts and scores; the words of a
document beyond them are joined to theirs by a shuffle. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, U64, batches, drop_scratch, mix64, pack, release, scratch
from foliant.llm.substrings import RunHash, _columns

DEPTH = 7
#: Bytes of the token before that the first symbol of a token sees.
BACK = 2
GAIN = 12.0
#: Contexts inside words that reach the tasks as a broadcast.
STATES = 1 << 15
PRIOR = 4.0
FREQUENT = 1 << 16
GROUP_BYTES = 1 << 19
#: Distinct words or grams that a task holds before it hands them on.
HELD = 1 << 20
END = 10
SPACE = 32
#: The end counts as a word with this hash.
END_HASH = np.int64(1)


def normal_form(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split())


def mask(depth: int) -> int:
    """The newest ``depth`` bytes of a long."""
    return -1 if depth == 8 else (1 << (8 * depth)) - 1


@dataclass
class Stream:
    """Packed texts. Each is two end marks and a space, its words, each with a closing space, and an end mark."""

    data: np.ndarray
    start: np.ndarray  # of every token, text by text; the last of a text is its end mark
    stop: np.ndarray  # after the token's bytes, before a word's closing space
    doc: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Stream:
        formed = [normal_form(t) for t in texts]
        data, offsets = pack([b"\n\n " + f + b" \n" if f else b"\n\n \n" for f in formed])
        start = np.flatnonzero(data[:-1] == SPACE) + 1
        # A word's closing space is what the next token starts after.
        stop = np.empty(len(start), np.int64)
        stop[:-1] = start[1:] - 1
        ends = np.cumsum([f.count(b" ") + 2 if f else 1 for f in formed]) - 1
        stop[ends] = offsets[1:]
        return Stream(data, start, stop, np.repeat(np.arange(len(texts)), np.diff(np.append(-1, ends))))

    def tokens(self) -> np.ndarray:
        """Hash of every token."""
        h = mix64(RunHash(self.data)(self.start, self.stop) + (self.stop - self.start).astype(np.uint64) * U64(0xD6E8FEB86659FD93)).view(np.int64)
        h[self.data[self.start] == END] = END_HASH
        return h

    def firsts(self) -> np.ndarray:
        """Of every token, the two bytes before its space and its first byte as one number."""
        at, data = self.start, self.data.astype(np.int32)
        return (data[at - 3] << 16) | (data[at - 2] << 8) | data[at]


def taken(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The runs of a buffer as an Arrow array."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], stop - start)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def runs_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array without nulls."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    held = words.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and where one of each stands."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return (key[first], np.add.reduceat(n, first), order[first]) if len(first) else (key, n, order)


class Sums:
    """Counts by key within a task, handed on in parts where they don't shrink; with the words of the keys if wanted."""

    def __init__(self, kind: int, words: bool):
        self.kind, self.words = kind, words
        self.key, self.n, self.text, self.size = [], [], [], 0

    def add(self, key: np.ndarray, n: np.ndarray, text: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        self.key.append(key)
        self.n.append(n)
        self.text.append(text)
        self.size += len(key)
        if self.size > HELD:
            self.shrink()
            if self.size > HELD // 2:
                yield from self.rows()

    def shrink(self) -> None:
        key, n, at = summed(np.concatenate(self.key), np.concatenate(self.n))
        self.key, self.n, self.size = [key], [n], len(key)
        self.text = [pa.concat_arrays(self.text).take(pa.array(at))] if self.words else [None]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.shrink()
            text = self.text[0] if self.words else pa.nulls(self.size, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(self.size, self.kind, np.int32)), pa.array(self.key[0]), text, pa.array(self.n[0])], names=["kind", "key", "word", "n"])
            self.key, self.n, self.text, self.size = [], [], [], 0


def _count_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, word, n): kind 0 counts tokens, kind 1 first bytes with the bytes before; summed within the task."""
    words, firsts = Sums(0, True), Sums(1, False)
    for batch in rows:
        body, train = _columns(batch, "body", "train")
        train = np.array(train.to_pylist(), bool)
        for group in batches(((i, b.as_py()) for i, b in enumerate(body)), GROUP_BYTES):
            stream = Stream.of([b for _, b in group])
            learnt = train[np.array([i for i, _ in group])][stream.doc]
            key, n, at = summed(stream.tokens(), learnt.astype(np.int64))
            yield from words.add(key, n, taken(stream.data, stream.start[at], stream.stop[at]))
            key, n = np.unique(stream.firsts()[learnt], return_counts=True)
            yield from firsts.add(key.astype(np.int64), n.astype(np.int64))
    yield from words.rows()
    yield from firsts.rows()


# ---------------------------------------------------------------- contexts inside words


def inside(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer with every word between spaces and room for contexts; place and word of each symbol after the first byte."""
    data, offsets = runs_of(words)
    pad = DEPTH - 1
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(size)) * (pad + 1) + pad
    held = np.zeros(len(data) + len(size) * (pad + 1) + 1, np.uint8)
    of = np.repeat(np.arange(len(size)), size)
    held[np.arange(len(data)) + (begin - offsets[:-1])[of]] = data
    held[begin - 1] = SPACE
    at = np.arange(len(data)) + (begin - offsets[:-1])[of] + 1
    held[begin + size] = SPACE
    return held, at, of


def context_keys(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The bytes before each place as one number, the newest lowest; those before the word's space are 0."""
    key = np.zeros(len(at), np.uint64)
    alive = np.ones(len(at), bool)
    for k in range(1, DEPTH + 1):
        byte = data[at - k]
        key |= np.where(alive, byte, 0).astype(np.uint64) << U64(8 * (k - 1))
        alive &= byte != SPACE
    return key


def _gram_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) -> (kind, key, word, n): contexts of ``DEPTH`` bytes with their next byte, summed within the task."""
    sums = Sums(2, False)
    for batch in rows:
        word, n = _columns(batch, "word", "n")
        n = n.to_numpy()
        for low in range(0, len(word), 1 << 15):
            data, at, of = inside(word[low : low + (1 << 15)])
            key, times, _ = summed((context_keys(data, at, of) << U64(8) | data[at]).view(np.int64), n[low:][of])
            yield from sums.add(key, times)
    yield from sums.rows()


@dataclass
class Tree:
    """Broadcast contexts by depth (sorted keys and state numbers) and log10 probabilities of all bytes in each state.

    ``outside`` says by which older byte a state grows into a kept context that isn't broadcast.
    """

    keys: list[np.ndarray] = field(default_factory=list)
    states: list[np.ndarray] = field(default_factory=list)
    logs: np.ndarray = field(default_factory=lambda: np.full((1, 256), -np.log10(256.0)))
    depths: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    outside: np.ndarray | None = None
    _slots: list = field(default_factory=list)

    @staticmethod
    def build(nodes: dict[tuple[int, int], dict[int, int]], longer: list[tuple[int, int]] = ()) -> Tree:
        """nodes: (depth, context) -> counts of next bytes, closed under dropping the oldest byte; longer: contexts
        that are kept outside and whose parents are nodes."""
        number = {(0, 0): 0}
        logs = np.empty((len(nodes.keys() | {(0, 0)}), 256))
        logs[0] = _smoothed(nodes.get((0, 0), {}), np.full(256, 1 / 256))
        keys, states, depths = [], [], [0]
        for depth in range(1, DEPTH + 1):
            here = sorted(c for d, c in nodes if d == depth)
            for context in here:
                parent = number[depth - 1, context & mask(depth - 1)]
                number[depth, context] = len(depths)
                logs[len(depths)] = _smoothed(nodes[depth, context], logs[parent])
                depths.append(depth)
            keys.append(np.array(here, np.uint64))
            states.append(np.array([number[depth, c] for c in here], np.int32))
        outside = np.zeros((len(logs), 256), bool) if len(longer) else None
        for depth, context in longer:
            outside[number[depth - 1, context & mask(depth - 1)], context >> (8 * (depth - 1))] = True
        return Tree(keys, states, np.log10(logs).astype(np.float32), np.array(depths), outside)

    def _find(self, depth: int, key: np.ndarray) -> np.ndarray:
        """State of each context of one depth, or -1: an open hash table with linear probing."""
        if not self._slots:
            for keys, states in zip(self.keys, self.states, strict=True):
                bits = max(4, int(2 * len(keys)).bit_length() + 1)
                table, held = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
                longest = 1
                for k, s, slot in zip(keys, states, (mix64(keys) & U64((1 << bits) - 1)).tolist(), strict=True):
                    tries = 1
                    while held[slot] >= 0:
                        slot = (slot + 1) & ((1 << bits) - 1)
                        tries += 1
                    table[slot], held[slot] = k, s
                    longest = max(longest, tries)
                self._slots.append((table, held, longest))
        table, held, longest = self._slots[depth - 1]
        slot_mask = np.int64(len(table) - 1)
        slot = (mix64(key) & U64(slot_mask)).astype(np.int64)
        found = np.full(len(key), -1, np.int32)
        open_ = np.arange(len(key))
        for _ in range(longest):
            here = held[slot]
            hit = (here >= 0) & (table[slot] == key[open_])
            found[open_[hit]] = here[hit]
            going = ~hit & (here >= 0)
            if not going.any():
                break
            open_, slot = open_[going], (slot[going] + 1) & slot_mask
        return found

    def states_of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of full contexts, the state of the longest broadcast suffix, and whether a longer one is kept outside."""
        state = np.zeros(len(context), np.int32)
        alive, key = np.arange(len(context)), context
        for depth in range(1, len(self.keys) + 1):
            if not len(self.keys[depth - 1]) or not len(alive):
                break
            found = self._find(depth, key & U64(mask(depth)))
            hit = found >= 0
            alive, key = alive[hit], key[hit]
            state[alive] = found[hit]
        if self.outside is None:
            return state, np.zeros(len(context), bool)
        depth = self.depths[state]
        older = np.where(depth < DEPTH, (context >> (U64(8) * np.minimum(depth, DEPTH - 1).astype(np.uint64))) & U64(255), U64(0)).astype(np.int64)
        return state, self.outside[state, older] & (depth < DEPTH)


def _smoothed(counts: dict[int, int], parent: np.ndarray) -> np.ndarray:
    p = PRIOR * parent
    for byte, n in counts.items():
        p[byte] += n
    return p / p.sum()


def states(grams: DataFrame) -> DataFrame:
    """(key, n), a context of ``DEPTH`` bytes and the next byte, newest lowest, with its count -> all kept contexts.

    (depth, context, total, next), ``next`` the counts of next bytes, 256 at most.
    """
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col("key").bitwiseAND(F.lit(mask(d + 1))).alias("pair")) for d in range(DEPTH + 1)]))
    pairs = grams.select("n", depths.alias("x")).groupBy("x.depth", "x.pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select("depth", F.shiftrightunsigned("pair", 8).alias("context"), F.col("pair").bitwiseAND(255).alias("byte"), "n")
    totals = pairs.groupBy("depth", "context").agg(F.sum("n").alias("total"))
    pairs = scratch(pairs.join(totals, ["depth", "context"]), "pairs")
    shorter = F.when(F.col("depth") > 0, F.col("context").bitwiseAND(F.expr("shiftleft(1L, 8 * (depth - 1)) - 1")))
    above = pairs.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("parent"), "byte", F.col("n").alias("of"), F.col("total").alias("of_total"))
    # A context with one occurrence says no more than its parent, smoothed as it would be.
    tested = pairs.where("depth > 0 and total > 1").withColumn("parent", shorter).join(above, ["depth", "parent", "byte"])
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("of") / F.col("of_total"))))
    kept = tested.groupBy("depth", "context").agg(gain.alias("gain")).where(F.col("gain") >= GAIN)
    lines = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col("context").bitwiseAND(F.lit(mask(d))).alias("context")) for d in range(DEPTH + 1)]))
    closed = kept.select(F.col("depth").alias("from"), lines.alias("x")).where("x.depth <= from").select("x.depth", "x.context").distinct()
    closed = closed.unionByName(pairs.select("depth", "context").where("depth = 0").limit(1)).distinct()
    found = pairs.join(closed, ["depth", "context"], "left_semi")
    found = found.groupBy("depth", "context").agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct(F.col("byte").cast("int").alias("byte"), "n"))).alias("next"))
    found = scratch(found, "states")
    drop_scratch(pairs)
    release(grams.sparkSession)
    return found


def broadcast_part(kept: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of the ``STATES`` most frequent contexts, and all other rows of ``kept``.

    No context is more frequent than its parent, so the parents of what is in the tree are in it too.
    """
    top = kept.orderBy(F.desc("total"), "depth", "context").limit(STATES).collect()
    nodes = {(r.depth, r.context): r.next for r in top}
    if len(top) < STATES:
        return Tree.build(nodes), kept.limit(0)
    last = top[-1]
    later = (F.col("depth") > last.depth) | ((F.col("depth") == last.depth) & (F.col("context") > last.context))
    rest = kept.where((F.col("total") < last.total) | ((F.col("total") == last.total) & later))
    parents = kept.sparkSession.createDataFrame([(d + 1, c) for d, c in nodes], "depth int, parent long")
    parent = F.col("context").bitwiseAND(F.expr("shiftleft(1L, 8 * (depth - 1)) - 1"))
    # Bounded: 256 older bytes for each context of the tree.
    longer = rest.select("depth", "context", parent.alias("parent")).join(F.broadcast(parents), ["depth", "parent"]).select("depth", "context").toArrow()
    return Tree.build(nodes, list(zip(*[longer.column(c).to_pylist() for c in ("depth", "context")], strict=True))), rest


def first_table(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """State for each two bytes before a token's space, and log10 probabilities of first bytes in each state.

    ``kept``: contexts whose newest byte is the space, and the root; 65,794 rows at most.
    """
    tree = Tree.build({(r.depth, r.context): r.next for r in kept.collect()})
    table = np.zeros((256, 256), np.int32)
    for depth in range(1, min(len(tree.keys), BACK + 1) + 1):
        for key, state in zip(tree.keys[depth - 1].tolist(), tree.states[depth - 1].tolist(), strict=True):
            where = [slice(None), (key >> 8) & 255 if depth > 1 else slice(None)]
            if depth > 2:
                where[0] = key >> 16
            table[tuple(where)] = state
    return table.reshape(-1), tree.logs


# ---------------------------------------------------------------- words


@dataclass
class Model:
    tokens: int
    words: int  # distinct training tokens
    ends: int  # training texts
    known: DataFrame  # (key, n, logs) of all counted words: training count, and log10 probability after the first byte
    kept: DataFrame  # (depth, context, total, next) of all kept contexts
    tree: Tree
    rest: DataFrame  # those of them that are inside words and not in the tree
    first: tuple[np.ndarray, np.ndarray]
    frequent: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted keys with n and logs


def count(texts: DataFrame) -> DataFrame:
    """(body binary, train boolean) -> (kind, key, word, n): tokens and first bytes with their counts in training texts, which
    are 0 for words that only others have."""
    counted = texts.mapInArrow(_count_rows, "kind int, key long, word binary, n long").groupBy("kind", "key", "word").agg(F.sum("n").alias("n"))
    counted = scratch(counted, "counts")
    release(texts.sparkSession)
    return counted


def fit(counted: DataFrame) -> Model:
    """Model of the rows of ``count``; without training texts all symbols are equally likely and no word is known."""
    spark = counted.sparkSession
    tokens, end = counted.where("kind = 0"), F.col("key") == int(END_HASH)
    total = tokens.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("words"), F.sum(F.when(end, F.col("n"))).alias("ends")).first()
    words = tokens.where(~end).select("key", "word", "n")
    grams = words.where("n > 0").select("word", "n").mapInArrow(_gram_rows, "kind int, key long, word binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    firsts = counted.where("kind = 1").select(F.shiftright("key", 8).alias("before"), F.col("key").bitwiseAND(255).alias("next"), "n")
    firsts = firsts.select((F.shiftleft(F.shiftleft("before", 8).bitwiseOR(F.lit(SPACE)), 8).bitwiseOR(F.col("next"))).alias("key"), "n")
    kept = states(grams.unionByName(firsts))
    after_space = F.col("context").bitwiseAND(255) == SPACE
    tree, rest = broadcast_part(kept.where((F.col("depth") == 0) | ~after_space))
    known = spelled(words, tree, rest)
    top = known.where("n > 0").orderBy(F.desc("n"), "key").limit(FREQUENT).toPandas().sort_values("key")
    frequent = (top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["logs"].to_numpy(np.float64))
    release(spark)
    return Model(total.tokens or 0, total.words, total.ends or 0, known, kept, tree, rest, first_table(kept.where((F.col("depth") == 0) | after_space)), frequent)


def looked_up(grams: DataFrame, rest: DataFrame) -> DataFrame:
    """(gram, depth, p) -> (gram, p): from the probability in the longest broadcast suffix to that in the longest kept one."""
    lines = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(mask(d))).alias("context")) for d in range(1, DEPTH + 1)]))
    lines = grams.select("gram", "p", F.col("depth").alias("from"), lines.alias("x")).where("x.depth > from").select("gram", "p", "x.depth", "x.context")
    n = F.coalesce(F.element_at("next", F.col("gram").bitwiseAND(255).cast("int")), F.lit(0))
    met = lines.join(rest, ["depth", "context"]).select("gram", "p", F.struct("depth", "total", n.alias("n")).alias("step"))
    steps = met.groupBy("gram").agg(F.max("p").alias("p"), F.sort_array(F.collect_list("step")).alias("steps"))
    return steps.select("gram", F.aggregate("steps", F.col("p"), lambda p, x: (x["n"] + F.lit(PRIOR) * p) / (x["total"] + F.lit(PRIOR))).alias("p"))


def spelled(words: DataFrame, tree: Tree, rest: DataFrame) -> DataFrame:
    """(key, word binary, n), distinct -> (key, n, logs): log10 probability of each word after its first byte, its closing space included."""
    held = words.sparkSession.sparkContext.broadcast(tree)

    def rows(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = held.value, ["key", "n", "logs", "gram", "depth", "p"]
        for batch in batches_in:
            keys, texts, counts = _columns(batch, "key", "word", "n")
            for low in range(0, len(texts), 1 << 15):
                key, text = keys[low : low + (1 << 15)], texts[low : low + (1 << 15)]
                data, at, of = inside(text)
                context = context_keys(data, at, of)
                state, out = tree.states_of(context)
                logs = tree.logs[state, data[at]].astype(np.float64)
                whole = np.bincount(of[~out], weights=logs[~out], minlength=len(key)).astype(np.float64)
                none = lambda t, k: pa.nulls(k, t)
                n = len(key)
                yield pa.RecordBatch.from_arrays([key, counts[low : low + (1 << 15)], pa.array(whole, pa.float64()), none(pa.int64(), n), none(pa.int32(), n), none(pa.float64(), n)], names=names)
                if out.any():
                    gram = (context[out] << U64(8) | data[at[out]]).view(np.int64)
                    n = len(gram)
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(of[out])), none(pa.int64(), n), none(pa.float64(), n), pa.array(gram), pa.array(tree.depths[state[out]].astype(np.int32)), pa.array(np.power(10.0, logs[out]))],
                        names=names,
                    )

    found = scratch(words.mapInArrow(rows, "key long, n long, logs double, gram long, depth int, p double"), "spelled")
    grams = found.where("gram is not null")
    deep = looked_up(grams.groupBy("gram").agg(F.max("depth").alias("depth"), F.max("p").alias("p")), rest)
    outside = grams.select("key", "gram").join(deep, "gram").select("key", F.lit(None).cast("long").alias("n"), F.log10("p").alias("logs"))
    whole = found.where("gram is null").select("key", "n", "logs").unionByName(outside).groupBy("key").agg(F.max("n").alias("n"), F.sum("logs").alias("logs"))
    whole = scratch(whole, "words")
    drop_scratch(found)
    release(words.sparkSession)
    return whole


#: Rows of ``score`` in its tasks: one per text, and one per text and word beyond the broadcast.
ROW = "rid long, key long, times long, known long, base double, logs double"


def _per_text(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, key), and how often each occurs."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))) if len(key) else np.empty(0, np.int64)
    return doc[first], key[first], np.diff(np.append(first, len(key))).astype(np.int64)


def score(texts: DataFrame, model: Model) -> DataFrame:
    """(rid, body binary) of counted texts -> (rid, n_tokens, n_known, base_score, score), one row per rid.

    base_score: the unigram log10 probability with one added to each count; score: the tree's.
    Empty texts have the end alone. Texts with a word that wasn't counted have no score (null).
    """
    held = texts.sparkSession.sparkContext.broadcast((*model.frequent, model.first))
    ends = model.ends

    def rows(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, word_logs, (first_state, first_logs) = held.value
        base_logs = np.log10(counts + 1.0)
        names = [c.split()[0] for c in ROW.split(", ")]
        none = lambda t, k: pa.nulls(k, t)
        for batch in batches_in:
            rid, body = _columns(batch, "rid", "body")
            rid = rid.to_numpy()
            for group in batches(((i, b.as_py()) for i, b in enumerate(body)), GROUP_BYTES):
                stream = Stream.of([b for _, b in group])
                ids = rid[np.array([i for i, _ in group])]
                n = len(group)
                h, doc, firsts = stream.tokens(), stream.doc, stream.firsts()
                first = first_logs[first_state[firsts >> 8], firsts & 255]
                word = h != END_HASH
                at = np.searchsorted(frequent, h)
                at[at == len(frequent)] = 0
                known = (frequent[at] == h) & word if len(frequent) else np.zeros(len(h), bool)
                at, at_doc = at[known], doc[known]
                n_known = np.bincount(at_doc, minlength=n) + (ends > 0)
                base = np.bincount(at_doc, weights=base_logs[at], minlength=n).astype(np.float64) + np.log10(ends + 1.0)
                logs = np.bincount(at_doc, weights=word_logs[at], minlength=n).astype(np.float64) + np.bincount(doc, weights=first, minlength=n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), none(pa.int64(), n), pa.array(np.bincount(doc, minlength=n)), pa.array(n_known), pa.array(base), pa.array(logs)], names=names)
                rare = ~known & word
                if rare.any():
                    rare_doc, key, times = _per_text(doc[rare], h[rare])
                    k = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rare_doc]), pa.array(key), pa.array(times), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k)], names=names)

    found = scratch(texts.mapInArrow(rows, ROW), "scored")
    met = found.where("key is not null").select("rid", "key", "times").join(model.known, "key", "left")
    more = met.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("more_base"),
        F.sum(F.col("times") * F.coalesce("logs", F.lit(float("nan")))).alias("more_logs"),
    )
    whole = found.where("key is null").join(more, "rid", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("times") * F.log10(F.lit(float(model.tokens + model.words + 1)))
    logs = F.nullif(F.col("logs") + F.coalesce("more_logs", F.lit(0.0)), F.lit(float("nan")))
    return whole.select("rid", F.col("times").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), base.alias("base_score"), logs.alias("score"))


def score_texts(texts: DataFrame) -> tuple[DataFrame, Model]:
    """(rid, body binary, train boolean) -> ``score`` of all texts by the model of the training ones, and that model."""
    model = fit(count(texts.select("body", "train")))
    return score(texts.select("rid", "body"), model), model

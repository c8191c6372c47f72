"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 13 words of every benchmark item (an item of fewer words is one
window). Patterns of one length form a class with three tables: the least shift of every block of two
words, the patterns by their last block (shift 0), and within those by their first block. A document is
scanned from the end of its first window on; a block that no pattern holds skips a whole window less
one block, and only patterns that share last and first block are compared word by word.

Items reach the tasks as a broadcast whose size is checked: benchmarks above ``BLOCK_BYTES`` are cut
into blocks of that size, and documents are scanned once for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import text_bytes, unnamed

WINDOW = 13
BLOCK = 2
#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 16 << 20
#: Of 100 words, those that must be hit in a contaminated document.
PERCENT = 5
#: Bytes 0-9, a-z and above 0x7F make words, A-Z become a-z, the rest are gaps.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Search tables of patterns that all have ``length`` words."""

    def __init__(self, length: int, patterns: dict[tuple, set]):
        self.length = length
        self.block = min(BLOCK, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.last: dict[tuple, dict[tuple, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.skip), length - end)
            by_first = self.last.setdefault(words[-self.block :], {})
            by_first.setdefault(words[: self.block], []).append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of every occurrence of a pattern."""
        shift, skip, last, length, block = self.shift, self.skip, self.last, self.length, self.block
        end, n = length, len(words)
        while end <= n:
            key = tuple(words[end - block : end])
            jump = shift.get(key, skip)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, items in last[key].get(tuple(words[start : start + block]), ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


def build(items: list[tuple[str, bytes]]) -> list[WuManber]:
    """One table for each pattern length; equal windows of several items are one pattern."""
    classes: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        width = min(WINDOW, len(words))
        for i in range(len(words) - width + 1) if width else ():
            classes.setdefault(width, {}).setdefault(tuple(words[i : i + width]), set()).add(item)
    return [WuManber(width, patterns) for width, patterns in sorted(classes.items())]


def find(text: bytes, tables: list[WuManber]) -> tuple[int, list[tuple[int, int]], set]:
    """Words of a text, the disjoint word spans that occurrences cover, and the items they are from."""
    words = words_of(text)
    spans, items = [], set()
    for table in tables:
        for start, of in table.search(words):
            spans.append((start, start + table.length))
            items |= of
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return len(words), [(a, b) for a, b in merged], items


_BUILT: dict[int, list[WuManber]] = {}


def _searcher(items) -> Column:
    """UDF over a binary text column; tables are built once in each Python worker."""

    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if items.id not in _BUILT:
            _BUILT.clear()
            _BUILT[items.id] = build(items.value)
        tables = _BUILT[items.id]
        for batch in texts:
            rows = [find(bytes(t), tables) for t in batch]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "starts": [[s for s, _ in r[1]] for r in rows], "ends": [[e for _, e in r[1]] for r in rows], "items": [sorted(r[2]) for r in rows]})

    return F.pandas_udf(search, FOUND)


class _Items:
    """A broadcast of item texts with a key that its worker-side tables are kept by."""

    def __init__(self, spark, rows: list[tuple[str, bytes]]):
        self.id = int.from_bytes(hashlib.md5(repr(rows).encode()).digest()[:8], "big")
        self.held = spark.sparkContext.broadcast(rows)

    @property
    def value(self):
        return self.held.value


def _blocks(benchmark: DataFrame, item: str, text: str) -> list[list[tuple[str, bytes]]]:
    """Item texts in blocks of about ``BLOCK_BYTES``, one collected at a time."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), text_bytes(text).alias("body")).where(F.length("body") > 0)
    total = rows.agg(F.sum(F.length("body").cast("long") + 64)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    if n <= 1:
        return [[(r.item, bytes(r.body)) for r in rows.collect()]] if n else []
    at = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    return ([(r.item, bytes(r.body)) for r in rows.where(at == i).toLocalIterator()] for i in range(n))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``overlap``: n_words, starts and ends of the covered word spans, items, n_hit and contaminated.

    contaminated: a word is hit and 100 * n_hit >= percent * n_words. Null texts and texts without words
    have none of all. Items without words match nothing; items that share an id count once, a null id is ''.
    Repeated rows are judged alike. An empty table gives an empty table; a column ``overlap`` is replaced.
    """
    spark = docs.sparkSession
    found, at, back = unnamed(docs, ("overlap",))
    text = at[text]
    n = 0
    for rows in _blocks(benchmark, item, item_text):
        found = found.withColumn(f"_found{n}", _searcher(_Items(spark, rows))(text_bytes(text)))
        n += 1
    if not n:
        found = found.withColumn("_found0", _searcher(_Items(spark, []))(text_bytes(text)))
    parts = [F.col(f"_found{i}") for i in range(max(1, n))]
    if len(parts) == 1:
        merged = F.struct(parts[0]["n_words"].alias("n_words"), parts[0]["starts"].alias("starts"), parts[0]["ends"].alias("ends"), parts[0]["items"].alias("items"))
    else:
        spans = F.array_sort(F.concat(*[F.arrays_zip(p["starts"], p["ends"]) for p in parts]))
        folded = F.aggregate(
            spans,
            F.struct(F.array().cast("array<bigint>").alias("starts"), F.array().cast("array<bigint>").alias("ends")),
            lambda acc, s: F.when((F.size(acc["ends"]) > 0) & (F.coalesce(F.try_element_at(acc["ends"], F.lit(-1)), F.lit(-1)) >= s["starts"]), F.struct(acc["starts"].alias("starts"), F.concat(F.slice(acc["ends"], F.lit(1), F.size(acc["ends"]) - 1), F.array(F.greatest(F.try_element_at(acc["ends"], F.lit(-1)), s["ends"]))).alias("ends"))).otherwise(
                F.struct(F.concat(acc["starts"], F.array(s["starts"])).alias("starts"), F.concat(acc["ends"], F.array(s["ends"])).alias("ends"))
            ),
        )
        found = found.withColumn("_spans", folded)
        merged = F.struct(parts[0]["n_words"].alias("n_words"), F.col("_spans.starts").alias("starts"), F.col("_spans.ends").alias("ends"), F.array_sort(F.array_distinct(F.concat(*[p["items"] for p in parts]))).alias("items"))
    total = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumn("_m", merged).withColumn("_hit", total(F.col("_m.ends")) - total(F.col("_m.starts")))
    overlap = F.struct(*[F.col(f"_m.{c}").alias(c) for c in ("n_words", "starts", "ends", "items")], F.col("_hit").alias("n_hit"), ((F.col("_hit") > 0) & (100 * F.col("_hit") >= percent * F.col("_m.n_words"))).alias("contaminated"))
    return found.select(*back, overlap.alias("overlap"))

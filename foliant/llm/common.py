"""Helpers of the training-data operators: shared scratch tables, row keys, and numpy over packed text."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.scratch import drop_scratch, scratch, shared_dir  # noqa: F401

U64 = np.uint64
ODD = U64(0x9E3779B97F4A7C15)
#: ASCII A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


# ---------------------------------------------------------------- scratch


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished phases, which it does for plans that were garbage-collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def unnamed(rows: DataFrame, added: tuple[str, ...]) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """``rows`` under names of our own, the place of each name, and the columns that give the caller's names back.

    Whatever a caller's columns are called, none can clash with what an operator adds on its way. ``added``: names that the operator's
    results replace.
    """
    names = [c for c in rows.columns if c not in added]
    at = {c: f"c{i}" for i, c in enumerate(names)}
    return rows.select([F.col(f"`{c}`").alias(at[c]) for c in names]), at, [F.col(at[c]).alias(c) for c in names]


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n; a null value counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, text): rid is unique, never null, and orders rows as (doc_id, text) does.

    Where doc_id is unique and never null, rid is doc_id. Else rows are sorted and numbered once into
    a scratch table, null ids first, so that repeated ids and null ids stay apart as rows.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if not ids.limit(1).count():
        return docs.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    ranked = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return scratch(ranked.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), "keyed")


# ---------------------------------------------------------------- numpy over packed text


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random 64-bit value for every byte.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * ODD)


def power(base: int, n: int) -> np.uint64:
    return U64(pow(int(base), n, 1 << 64))


def byte_ngram_hash(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit rolling hash of every run of n bytes (polynomial in an odd base, doubled up and mixed)."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    have, width, out, out_width = BYTE_CODE[data], 1, None, 0
    k = n
    while k:
        if k & 1:
            if out is None:
                out, out_width = have, width
            else:
                size = len(data) - out_width - width + 1
                out = out[:size] * power(ODD, width) + have[out_width : out_width + size]
                out_width += width
        k >>= 1
        if k:
            size = len(have) - width
            have = have[:size] * power(ODD, width) + have[width : width + size]
            width *= 2
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values."""
    if len(x) < width:
        return x[:0]
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def pack(texts: Iterable[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by ``gap``, and the offset of each; the last offset is the end."""
    texts = list(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=offsets[1:])
    data = gap.join([*texts, b""]) if gap else b"".join(texts)
    return np.frombuffer(data, np.uint8), offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word of a packed buffer whose texts are separated by white space."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def batches(rows: Iterable[tuple[int, bytes]], limit: int) -> Iterator[list]:
    """Groups rows (…, bytes last) so that each group holds at least one row and about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held

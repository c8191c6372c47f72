"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most two
bits, one of the segments differs in at most one bit. So every fingerprint is listed in a table under
each of its segments, looks up the Hamming ball of radius one around each segment (33 codes), and the
full distance of what it finds is verified.

Tables hold distinct fingerprints, so exact copies cost one entry. A bucket of the table can still be
large (many near copies share one half). Buckets above ``BUCKET`` entries aren't paired; instead all
fingerprints in or next to them enumerate the ball of radius one around the whole code (65 codes) and
meet there: two fingerprints are within two bits exactly if they share such a code, and at most 65
fingerprints can share one. No link is lost either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import LOWER, scratch, text_bytes
from foliant.llm.components import connected_components

WORDS = 3
SEED = 42
RADIUS = 2
SEGMENT_BITS = 32
#: Entries of a table bucket that are compared one by one.
BUCKET = 64


def shingle_hashes(text: bytes, width: int = WORDS) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included; of all words if there are fewer; none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - width]).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes; zero of none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(shingle_hashes(bytes(t))) for t in batch], dtype="int64")


def fingerprint(column: str = "text") -> Column:
    """Fingerprint of a text column; null and wordless texts have zero."""
    return F.pandas_udf(_fingerprints, T.LongType())(text_bytes(column))


def _segments(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, SEGMENT_BITS), fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))]


def _ball(code: Column, bits: int) -> list[Column]:
    """All codes within one bit of ``code``."""
    return [code] + [code.bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63))) for b in range(bits)]


def _found(fps: DataFrame) -> DataFrame:
    """(fp) distinct fingerprints -> (fp, other) that share a bucket, ``other`` null for a crowded one.

    Spark takes exploded rows for as few bytes as what they were made from and would broadcast 66 probes of each fingerprint, so
    the join asks for a merge.
    """
    fp = F.col("fp")
    listed = fps.select("fp", F.posexplode(F.array(*_segments(fp))).alias("seg", "code"))
    counts = listed.groupBy("seg", "code").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.where(F.col("n") > BUCKET).select("seg", "code")
    table = listed.join(crowded, ["seg", "code"], "left_anti").select("seg", "code", F.col("fp").alias("other"))
    table = table.unionByName(crowded.withColumn("other", F.lit(None).cast("long")))
    probes = [F.struct(F.lit(s).alias("seg"), c.alias("code")) for s, seg in enumerate(_segments(fp)) for c in _ball(seg, SEGMENT_BITS)]
    # The 66 probes of a fingerprint are made in all tasks, however few hold the fingerprints.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    probed = fps.select("fp", F.explode(F.array(*probes)).alias("p")).select("fp", "p.seg", "p.code")
    return probed.join(table.hint("merge"), ["seg", "code"]).select("fp", "other")


def _starred(fps: DataFrame) -> DataFrame:
    """(fp) distinct fingerprints -> links (a, b) to the least one of each code of the balls around whole codes; joined as in ``_found``."""
    met = fps.select("fp", F.explode(F.array(*_ball(F.col("fp"), 64))).alias("code"))
    least = met.groupBy("code").agg(F.min("fp").alias("least"))
    return met.join(least.hint("merge"), "code").where("fp > least and bit_count(fp ^ least) <= 2").select(F.col("least").alias("a"), F.col("fp").alias("b"))


def near_links(fps: DataFrame) -> DataFrame:
    """(fp) distinct fingerprints -> links (a, b) that connect whatever differs in 1 or 2 bits, directly or in a star."""
    found = scratch(_found(fps).where("other is null or (fp < other and bit_count(fp ^ other) <= 2)").distinct(), "found")
    starred = _starred(found.where("other is null").select("fp").distinct())
    return found.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")).unionByName(starred).distinct()


def near_classes(prints: DataFrame) -> DataFrame:
    """(fp, ...) rows -> the same rows with ``fp_root``, one value for each group of linked fingerprints.

    Empty input gives an empty table. Rows of equal fingerprints are one node, however many they are.
    """
    roots = connected_components(near_links(prints.select("fp").distinct()))
    roots = roots.select(F.col("node").alias("fp"), F.col("root").alias("fp_root"))
    return prints.join(roots, "fp", "left").withColumn("fp_root", F.coalesce("fp_root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (key, fp, component_id), component_id the least key that links reach.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are returned
    as often as they came. Null keys belong to a component but are never its least key, unless all are null.
    """
    prints = scratch(docs.select(F.col(key).cast("long").alias(key), fingerprint(text).alias("fp")), "prints")
    classed = near_classes(prints)
    least = classed.groupBy("fp_root").agg(F.min(key).alias("component_id"))
    # Rows of copies are a few bytes in files and many in a broadcast: the table never goes through the driver.
    return classed.join(least.hint("merge"), "fp_root").select(key, "fp", "component_id")

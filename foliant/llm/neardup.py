"""Near copies of texts by shingle similarity: SimHash, multi-index hashing, then an exact check.

Texts are sets of word shingles. A fingerprint has ``SEGMENTS`` segments of ``SEGMENT_BITS`` bits and a word of 64 bits. Each
text is listed in a table under every code within one bit of each of its segments (a Hamming ball of 25 codes) and
looks up the same codes, so texts meet that differ in two bits of a segment at most. Two texts with a similarity of 0.8
differ in about 15 % of all bits; they meet in one of eight segments with a probability of 0.93, those with 0.9 almost always.
What meets is held against the distance of the 64-bit words, and what passes against the exact similarity of
the shingle sets (hashed to 32 bits each).

Equal sets are one entry of the tables. A code with more than ``BUCKET`` entries doesn't pair them all: each entry first meets the
most central one (nearest to the majority of each bit) of those whose most crowded code of a segment is the same. So a large group costs a few pairs for
each of its members. Then all rows of crowded codes that lie in different groups still are joined by their rarest shingles: with these first,
two sets of enough similarity share one among so many at the front that either may lack. That is exact, whatever the texts have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import BYTE_CODE, LOWER, ODD, U64, batches, drop_scratch, mix64, pack, power, release, scratch, text_bytes, word_bounds
from foliant.llm.components import connected_components
from foliant.llm.substrings import RunHash

WORDS = 5
SIMILARITY = 0.8
SEGMENTS = 8
SEGMENT_BITS = 24
#: Bits of the 64-bit words in which candidates may differ; texts with a similarity of 0.8 differ in 10, with a deviation of 3.
RADIUS = 20
#: Entries of a table bucket that are compared one by one.
BUCKET = 32
#: Links of a text that meet in one task.
HUB = 1024
GROUP_BYTES = 1 << 19
#: Row numbers that are sent to all tasks, so that texts needn't be shuffled to meet them; more are sorted and merged.
SENT = 3_000_000
_SALTS = [mix64(np.array([i + 1], np.uint64) * ODD)[0] for i in range(4)]


def shingle_sets(texts: list[bytes], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text, and where each text's begin; texts of fewer words are one shingle."""
    data, offsets = pack([t.translate(LOWER) for t in texts], gap=b"\n")
    start, end, doc = word_bounds(data, offsets)
    word = mix64(RunHash(data)(start, end) + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    # Prefix sums of a polynomial give the hash of any run of words.
    up, down = _powers(len(word) + 1)
    prefix = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=prefix[1:])
    size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    length = np.repeat(np.minimum(n, width), size)
    h = mix64((prefix[at + length] - prefix[at]) * down[at] + length.astype(np.uint64))
    owner = np.repeat(np.arange(len(texts)), size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


_UP_DOWN: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _UP_DOWN or len(_UP_DOWN[0]) < n:
        base = int(BYTE_CODE[7]) | 1
        up, down = np.full(n, power(base, 1), np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _UP_DOWN[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _UP_DOWN[0], _UP_DOWN[1]


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """256 bits of each set, as 32 bytes: a bit is 1 if it is set in over half of the set's hashes; all 0 for an empty set."""
    sizes = np.diff(bounds)
    ones = np.zeros((len(sizes), 256), np.int64)
    # Bytes of 0 and 1 are added eight at a time as one number: 255 rows at most, so that no byte overflows.
    rows = [np.arange(a, b, 255) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    parts = np.concatenate(rows) if rows else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), [len(r) for r in rows])
    for low in range(0, len(parts), 64):
        cut, own = parts[low : low + 64], owner[low : low + 64]
        stop = parts[low + 64] if low + 64 < len(parts) else len(h)
        held = h[cut[0] : stop]
        wide = np.stack([mix64(held ^ s) for s in _SALTS], axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(held), 32), axis=1, bitorder="little")
        sums = np.add.reduceat(bits.view(np.uint64), cut - cut[0], axis=0).view(np.uint8)
        np.add.at(ones, own, sums)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little")


PRINT = T.StructType([T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("segments", T.ArrayType(T.IntegerType()))])


def _grouped(texts: pd.Series) -> Iterator[list[bytes]]:
    for group in batches(((bytes(t),) for t in texts), GROUP_BYTES):
        yield [t for (t,) in group]


def _prints(width: int):
    def printed(batches_in: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches_in:
            out: dict[str, list] = {f.name: [] for f in PRINT}
            for texts in _grouped(batch):
                h, bounds = shingle_sets(texts, width)
                fp = fingerprints(h, bounds)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(mix64(h), out=sums[0, 1:])
                np.cumsum(mix64(h ^ _SALTS[3]), out=sums[1, 1:])
                a, b = (sums[:, bounds[1:]] - sums[:, bounds[:-1]]).view(np.int64)
                segments = np.zeros((len(texts), SEGMENTS, 4), np.uint8)
                segments[:, :, :3] = fp[:, 8:].reshape(len(texts), SEGMENTS, 3)
                for name, values in zip(out, (a, b, np.diff(bounds), fp[:, :8].copy().view(np.int64)[:, 0], list(segments.reshape(len(texts), -1).view(np.int32))), strict=True):
                    out[name].extend(values)
            yield pd.DataFrame(out)

    return F.pandas_udf(printed, PRINT)


def _sets(width: int):
    def hashed(batches_in: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches_in:
            found: list[np.ndarray] = []
            for texts in _grouped(batch):
                h, bounds = shingle_sets(texts, width)
                short = (h >> U64(32)).astype(np.uint32).view(np.int32)
                found += [short[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pd.Series(found)

    return F.pandas_udf(hashed, T.ArrayType(T.IntegerType()))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: A segment's code as one number for all segments, and that with those one bit from it.
OWN = f"(segment << {SEGMENT_BITS}) | code"
BALL = f"transform(sequence(-1, {SEGMENT_BITS - 1}), i -> own ^ if(i < 0, 0, 1 << i))"


def _listed(entries: DataFrame, *more: str) -> DataFrame:
    """(code, row, word, and more columns): every entry under all codes of its balls, made in all tasks."""
    spread = entries.repartition(_parts(entries), "row").select("row", "word", *more, F.posexplode("segments").alias("segment", "code"))
    return spread.selectExpr("row", "word", *more, f"{OWN} as own").select(F.explode(F.expr(BALL)).alias("code"), "row", "word", *more)


def _sent(rows: DataFrame) -> DataFrame:
    """A stored table of row numbers alone, as the right side of a join with texts."""
    return rows.hint("broadcast" if rows.count() <= SENT else "merge")


def _far(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def crowded_codes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Codes with more than ``BUCKET`` entries (code, n), and the most crowded one (own, code) in each ball that has any.

    own: the code that a ball is around. Entries of equal codes are counted first, so a ball is listed once for each different
    code, however many entries have it.
    """
    own = entries.select(F.posexplode("segments").alias("segment", "code")).groupBy(F.expr(OWN).alias("own")).agg(F.count(F.lit(1)).alias("e"))
    own = scratch(own, "own_codes")
    # In all tasks, so that none counts a large share of all codes.
    balls = own.repartition(_parts(entries), "own").select("own", "e", F.explode(F.expr(BALL)).alias("code"))
    counts = scratch(balls.groupBy("code").agg(F.sum("e").alias("n")).where(F.col("n") > BUCKET), "crowded_codes")
    release(entries.sparkSession)
    main = scratch(balls.join(counts, "code").groupBy("own").agg(F.max_by("code", F.struct("n", "code")).alias("code")), "main_codes")
    drop_scratch(own)
    return counts, main


def candidates(entries: DataFrame, among_crowded: bool = True) -> tuple[DataFrame, DataFrame]:
    """(row, word, segments) of distinct sets -> (a, b, far) pairs, and the rows (row) of crowded codes.

    Pairs share a code and differ in ``RADIUS`` bits of the word at most. A row of crowded codes meets the centre of the most crowded of its
    codes of each segment; ``prefix_pairs`` has what else there is among such rows, so that they needn't be paired with each other
    under their other codes (``among_crowded``).
    """
    spark = entries.sparkSession
    counts, main = crowded_codes(entries)
    # Eight rows of an entry at most; the other codes of its balls aren't needed to find its centres.
    spread = entries.select("row", "word", F.posexplode("segments").alias("segment", "code")).selectExpr("row", "word", f"{OWN} as own")
    crowded = scratch(spread.join(main, "own").select("row", "word", "code"), "crowded")
    rows = scratch(crowded.select("row").distinct(), "crowded_rows")
    flagged = entries.join(rows.withColumn("many", F.lit(True)).hint("merge"), "row", "left").withColumn("many", F.col("many").isNotNull())
    few = _listed(flagged, "many").select("code", "row", "word", "many").join(counts, "code", "left_anti")
    near = (F.col("x.code") == F.col("y.code")) & (F.col("x.row") < F.col("y.row")) & (F.lit(among_crowded) | ~(F.col("x.many") & F.col("y.many"))) & (_far("x.word", "y.word") <= RADIUS)
    pairs = few.alias("x").join(few.alias("y"), near).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"), _far("x.word", "y.word").alias("far")).distinct()
    pairs = scratch(pairs, "pairs")
    release(spark)
    bits = [F.sum(F.shiftrightunsigned("word", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)]
    major = crowded.groupBy("code").agg(F.count(F.lit(1)).alias("of"), *bits)
    middle = F.lit(0).cast("long")
    for i in range(64):
        middle = middle.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("of"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    nearest = F.min_by(F.struct("row", "word"), F.struct(_far("word", "middle"), "row")).alias("c")
    centres = crowded.join(major.select("code", middle.alias("middle")), "code").groupBy("code").agg(nearest)
    centres = scratch(centres.select("code", F.col("c.row").alias("centre"), F.col("c.word").alias("centre_word")), "centres")
    both = pairs.unionByName(starred(crowded, centres)).groupBy("a", "b").agg(F.min("far").alias("far"))
    both = scratch(both, "candidates")
    for table in (main, crowded, centres):
        drop_scratch(table)
    return both, rows


def starred(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b, far): rows (code, row, word) with the centres of their codes, as far as those are near."""
    met = rows.join(centres, "code").where((F.col("row") != F.col("centre")) & (_far("word", "centre_word") <= RADIUS))
    return met.select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b"), _far("word", "centre_word").alias("far")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs whose shingle sets are similar enough; sets: (row, set). A row with many pairs is copied to several tasks."""
    hubs = pairs.groupBy(F.col("a").alias("row")).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("copies"))
    salted = pairs.join(hubs.withColumnRenamed("row", "a"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
    left = sets.join(hubs.hint("merge"), "row").select(F.col("row").alias("a"), F.col("set").alias("of_a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    right = salted.select("a", "b", "salt").join(sets.select(F.col("row").alias("b"), F.col("set").alias("of_b")).hint("merge"), "b")
    joined = right.join(left.hint("merge"), ["a", "salt"])
    both = F.size(F.array_intersect("of_a", "of_b"))
    return joined.where(both >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def near_links(entries: DataFrame, texts: DataFrame, width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) of rows whose texts are similar enough, as far as they are needed to connect their groups.

    entries: (row, word, segments) of distinct sets; texts: (row, body). Each candidate is first checked against the one
    of its partners that has most candidates; then all pairs that lie in different groups still.
    """
    spark = entries.sparkSession
    pairs, crowded = candidates(entries, among_crowded=False)
    release(spark)
    ends = pairs.select(F.col("a").alias("row"), F.col("b").alias("other"), "far").unionByName(pairs.select(F.col("b").alias("row"), F.col("a").alias("other"), "far"))
    degree = ends.groupBy("row").agg(F.count(F.lit(1)).alias("degree"))
    wanted = scratch(degree.select("row").unionByName(crowded).distinct(), "wanted")
    sets = scratch(texts.join(_sent(wanted), "row").select("row", _sets(width)("body").alias("set")), "sets")
    release(spark)
    best = F.max_by("other", F.struct("degree", -F.col("far"), -F.col("other")))
    hung = ends.join(degree.withColumnRenamed("row", "other"), "other").groupBy("row").agg(best.alias("other"))
    # The partner with most candidates is the first end, so that its set is what is copied.
    links = scratch(verified(hung.select(F.col("other").alias("a"), F.col("row").alias("b")), sets, similarity), "links")
    release(spark)
    links = links.unionByName(scratch(verified(between(pairs, links), sets, similarity), "more_links"))
    if not crowded.isEmpty():
        last = scratch(verified(prefix_pairs(sets.join(crowded.hint("merge"), "row"), links, similarity), sets, similarity), "last_links")
        links = links.unionByName(last)
    for table in (sets, pairs, crowded, wanted):
        drop_scratch(table)
    release(spark)
    return links


def prefix_pairs(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """All (a, b) of sets (row, set) that may be similar enough and that links don't connect yet. Exact.

    Shingles are ordered by how many sets have them, the rarest first. The first shingle that two sets share bounds how many they share; sets meet
    there if that is enough for their sizes. Of the rows that meet at a shingle the largest group isn't compared within itself.
    """
    listed = sets.select("row", F.size("set").alias("n"), F.explode("set").alias("s"))
    # Counted beside the rows, which a join with the counts would shuffle twice.
    counted = listed.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("df > 1")
    ordered = counted.groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("c"))
    # Shingles that no other set has come before these.
    before = F.col("n") - F.size("c")
    front = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9)) + 1
    first = ordered.select("row", "n", before.alias("u"), F.slice("c", F.lit(1), F.greatest(F.lit(0), front - before).cast("int")).alias("c"))
    roots = connected_components(links)
    rooted = first.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    entries = scratch(rooted.select("row", "root", "n", "u", F.posexplode("c").alias("at", "c")).select("row", "root", "n", (F.col("u") + F.col("at")).alias("at"), "c.s"), "prefixes")
    release(sets.sparkSession)
    groups = entries.groupBy("s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("s").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("s", "largest")
    met = scratch(entries.join(groups, "s"), "met")
    x, y = met.where("root <> largest").alias("x"), met.alias("y")
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-9))
    enough = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need
    once = (F.col("y.root") == F.col("y.largest")) | (F.col("x.row") < F.col("y.row"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & once & enough)
    found = scratch(pairs.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct(), "prefix_pairs")
    drop_scratch(entries)
    drop_scratch(met)
    return found


def between(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The (a, b) pairs whose ends aren't connected by links."""
    roots = scratch(connected_components(links), "roots")
    name = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"of_{end}"))
    named = pairs.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return named.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``_row``, a long that no two rows share: the key where it is unique and not null, else a number in a stored copy."""
    value = F.col(f"`{key}`").cast("long")
    unclear = docs.groupBy(value.alias("_k")).agg(F.count(F.lit(1)).alias("n")).where("_k is null or n > 1")
    if unclear.isEmpty():
        return docs.withColumn("_row", value)
    return scratch(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are the first of their group of near copies.

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or more (A-Z
    lower-cased; a text of fewer words is one shingle); texts without words are copies of each other. First is the
    least key (null last), then the row written first; of repeated rows one stays. An empty table gives an empty table.
    """
    names = docs.columns
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{key}`").cast("long").alias("key")), "key")
    body = text_bytes(f"doc.`{text}`")
    prints = scratch(rows.select("key", F.col("_row").alias("row"), _prints(width)(body).alias("print")), "prints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "word", "segments")).alias("first")
    sets = prints.select("print.*", "row", "key").groupBy("set_a", "set_b", "n").agg(first)
    sets = scratch(sets.select("n", "first.*"), "entries")
    links = near_links(sets.where("n > 0").select("row", "word", "segments"), rows.select(F.col("_row").alias("row"), body.alias("body")), width, similarity)
    roots = connected_components(links)
    rooted = sets.select("none", "key", "row").join(roots.withColumnRenamed("node", "row"), "row", "left")
    kept = rooted.groupBy(F.coalesce("root", "row").alias("root")).agg(F.min(F.struct("none", "key", "row")).alias("first"))
    # Mostly fewer than the rows to keep.
    left_out = scratch(prints.select(F.col("row").alias("_row")).join(kept.select(F.col("first.row").alias("_row")), "_row", "left_anti"), "left_out")
    drop_scratch(prints)
    drop_scratch(sets)
    release(docs.sparkSession)
    return rows.join(_sent(left_out), "_row", "left_anti").select([F.col(f"doc.`{c}`").alias(c) for c in names])

"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring; a row belongs to the arc that its key's hash falls into,
and an arc to the shard whose point ends it. Shards hold a bounded number of rows: of N rows over S
shards, the first N mod S shards (by number) take one more than the others, so counts differ by one at
most. Rows of a full shard continue clockwise to the next point of a shard with room; rows whose own
shard has room stay, so only the overflow and the share of an added shard move.

Spark counts rows by arc (a table of S x vnodes x ``cells`` rows at most, whatever the input is), the
plan of runs (arc, first rank, shard, slot) is drawn up from those counts, and rows find their run by
their rank within the arc.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm.common import text_bytes, unnamed

VNODES = 64
#: Slices of an arc in which rows are ranked, so that a rank window holds a small share of the rows.
CELLS = 8


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; a shard's points don't depend on the other shards."""
    points = [(int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:4], "big"), s) for s in range(shards) for v in range(vnodes)]
    return sorted(points)


def assign_arcs(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs (arc, first rank, shard, first slot) for row counts by arc.

    Arcs first fill their own shard in ring order; what overflows continues clockwise to the next shard with room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    runs, over = [], []

    def put(arc: int, rank: int, shard: int, n: int) -> None:
        runs.append((arc, rank, shard, used[shard]))
        used[shard] += n

    for arc, (_, shard) in enumerate(points):
        n = counts.get(arc, 0)
        fits = min(n, room[shard] - used[shard])
        if fits:
            put(arc, 0, shard, fits)
        if n > fits:
            over.append((arc, fits, n))
    for arc, rank, n in over:
        at = arc
        while rank < n:
            at = (at + 1) % len(points)
            shard = points[at][1]
            fits = min(n - rank, room[shard] - used[shard])
            if fits:
                put(arc, rank, shard, fits)
                rank += fits
    return runs


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id", order: tuple[str, ...] = (), vnodes: int = VNODES) -> DataFrame:
    """``rows`` with ``shard`` int and ``slot`` long (gapless from 0 in each shard); counts differ by one at most.

    key: the column whose hash places a row; ``order``: columns that rank rows of one place, after the key.
    A null key is placed by the ``order`` columns instead. Repeated rows can't be told apart, so their ranks
    among themselves are arbitrary. An empty table gives an empty table. Columns named like the results are replaced.
    """
    spark = rows.sparkSession
    points = ring_points(shards, vnodes)
    edges = np.array([p for p, _ in points], np.int64)
    rows, at, back = unnamed(rows, ("shard", "slot"))
    key, order = at[key], tuple(at[c] for c in order)
    spare = F.concat(F.lit("null:"), F.xxhash64(*[F.col(f"`{c}`") for c in order]).cast("string")) if order else F.lit("null:")
    spot = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), spare)), 1, 8), 16, 10).cast("long")

    def arcs(spots: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(edges, spots.to_numpy(), side="left") % len(edges)).astype("int32"))

    placed = rows.withColumn("_spot", spot)
    placed = placed.withColumn("_arc", F.pandas_udf(arcs, T.IntegerType())("_spot"))
    # Rows of one key share an arc, but not a cell unless they are equal in the ``order`` columns too.
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("_spot", *[F.col(f"`{c}`") for c in order]), F.lit(CELLS)).cast("int"))
    sizes = sorted((r["_arc"], r["_cell"], r["n"]) for r in placed.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = {}
    first_of_cell = []
    for a, c, n in sizes:
        first_of_cell.append((a, c, counts.get(a, 0)))
        counts[a] = counts.get(a, 0) + n
    runs = assign_arcs(points, counts, shards)
    cell_base = {(a, c): r for a, c, r in first_of_cell}
    # Runs cut at cell borders, so that a row finds its run by (arc, cell) and its rank in the cell.
    plan = []
    by_arc: dict[int, list] = {}
    for a, rank, shard, slot in runs:
        by_arc.setdefault(a, []).append((rank, shard, slot))
    for a, c, n in sizes:
        here = sorted(by_arc[a])
        ranks = [r for r, _, _ in here]
        low, end = cell_base[a, c], cell_base[a, c] + n
        at = bisect.bisect_right(ranks, low) - 1
        while low < end:
            rank, shard, slot = here[at]
            stop = min(end, ranks[at + 1] if at + 1 < len(ranks) else end)
            plan.append((a, c, low - cell_base[a, c], stop - cell_base[a, c], shard, slot + low - rank))
            low, at = stop, at + 1
    schema = T.StructType([T.StructField(n, t) for n, t in (("_arc", T.IntegerType()), ("_cell", T.IntegerType()), ("_low", T.LongType()), ("_high", T.LongType()), ("shard", T.IntegerType()), ("_slot", T.LongType()))])
    runs_df = spark.createDataFrame(plan, schema)
    in_cell = Window.partitionBy("_arc", "_cell").orderBy("_spot", F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in order])
    ranked = placed.withColumn("_rank", F.row_number().over(in_cell).cast("long") - 1)
    # Bounded by the ring: one run for each cell, and one more wherever a shard fills up.
    joined = ranked.join(F.broadcast(runs_df), ["_arc", "_cell"]).where("_low <= _rank and _rank < _high")
    return joined.select(*back, "shard", (F.col("_slot") + F.col("_rank") - F.col("_low")).alias("slot"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text, null none, plus 16) and ``text_crc32`` (unsigned; null as empty)."""
    names = [c for c in docs.columns if c not in ("size", "text_crc32")]
    body = text_bytes(text)
    return docs.select(*[f"`{c}`" for c in names], (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))

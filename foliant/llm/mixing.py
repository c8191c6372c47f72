"""Mixing sources to target weights by Poisson replication.

A source of n rows that shall give the share w of an output of N rows has the mean repetition rate
w * N / n. Every document gets its own Poisson count with that mean, by inverting the distribution at a
uniform number that is hashed from the document's id and a seed; so a count needs no other document,
and is the same in every run. Rows are then repeated by their counts and shuffled globally by a hash of
id and copy.

Rates above ``PIECE`` are split into equal pieces with a uniform number each; their counts add up, as a
sum of Poisson numbers is Poisson distributed, and exp(-rate) keeps its precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import scratch, unnamed

SEED = "mix-1"
#: Largest mean that is inverted in one go.
PIECE = 16.0
#: Sources up to which the table of rates is broadcast; beyond that it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
UNIT = float(1 << 48)


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 12 hex digits of md5(key|seed)."""
    hashed = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / F.lit(UNIT)


def poisson_inverse(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Least k with u < P(X <= k), elementwise, for means up to ``PIECE``."""
    term = np.exp(-mean)
    total = term.copy()
    k = np.zeros(len(u), np.int64)
    rest = np.flatnonzero((u >= total) & (mean > 0))
    step = 0
    while len(rest):
        step += 1
        k[rest] = step
        term[rest] *= mean[rest] / step
        grown = total[rest] + term[rest]
        # Beyond the last bit of the distribution nothing is added any more: the tail is cut there.
        stuck = (grown == total[rest]) & (step > mean[rest])
        total[rest] = grown
        rest = rest[(u[rest] >= grown) & ~stuck]
    return k


def _counts(u: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(poisson_inverse(u.to_numpy(np.float64), mean.to_numpy(np.float64)))


def rates(docs: DataFrame, weights: dict | None = None, source: str = "source", size: float = 1.0) -> DataFrame:
    """(_source, rows, rate, pieces): the mean repetition rate of each source for its target weight.

    weights: source -> weight, sources that are absent get none; without it all sources weigh the same.
    size: rows of the output over rows of the input. A null source is a source of its own, named ''.
    """
    found = docs.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("_source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        found = found.withColumn("_weight", F.lit(1.0))
    elif weights:
        pairs = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (str(k), float(v))])
        found = found.withColumn("_weight", F.coalesce(pairs[F.col("_source")], F.lit(0.0)))
    else:
        found = found.withColumn("_weight", F.lit(0.0))
    totals = found.agg(F.sum("rows").alias("_all"), F.sum("_weight").alias("_weights"))
    rate = F.when(F.col("_weights") > 0, F.lit(float(size)) * F.col("_weight") * F.col("_all") / F.col("_weights") / F.col("rows")).otherwise(F.lit(0.0))
    found = found.join(F.broadcast(totals)).withColumn("rate", rate)  # one row
    return found.select("_source", "rows", "rate", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int").alias("pieces"))


#: Rows of one identity that are numbered in one task.
CHUNK = 1024


def identified(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``_id``, a text that no two rows share: the key where it is unique and not null.

    Of null and repeated keys, the id is the key, a hash of the whole row and a number among equal rows. Equal rows are counted, so
    that one of them travels, and spread over the tasks again in chunks.
    """
    name = F.col(f"`{key}`").cast("string")
    unclear = docs.groupBy(name.alias("_k")).agg(F.count(F.lit(1)).alias("n")).where("_k is null or n > 1").select("_k")
    if unclear.isEmpty():
        return docs.withColumn("_id", name)
    unclear = scratch(unclear, "unclear")
    meets = name.eqNullSafe(F.col("_k"))
    clear = docs.join(unclear, meets, "left_anti").withColumn("_id", name)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    equal = docs.join(unclear, meets, "left_semi").select(row.alias("_row")).withColumn("_h", F.sha2(F.to_json("_row"), 256))
    equal = equal.groupBy("_h").agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_n")).select("_row.*", "_h", "_n")
    equal = scratch(equal, "equal")
    chunks = equal.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK)))).repartition("_h", "_c")
    rows = chunks.withColumn("_i", F.explode(F.sequence(F.col("_c") * CHUNK, F.least(F.col("_n"), (F.col("_c") + 1) * CHUNK) - 1)))
    ident = F.concat_ws("#", F.coalesce(name, F.lit("")), "_h", F.col("_i").cast("string"))
    return clear.unionByName(rows.withColumn("_id", ident).drop("_h", "_n", "_c", "_i"))


def replicate(docs: DataFrame, weights: dict | None = None, key: str = "doc_id", source: str = "source", seed: str = SEED, size: float = 1.0) -> DataFrame:
    """``docs`` with ``copy`` int (1 to the row's count) and ``shuffle_key`` long, one row per copy, in shuffled order.

    Rows whose count is 0 don't appear. The expected rows of a source are its weight's share. Null keys and repeated
    rows draw a count and a place for each row (see ``identified``). An empty table gives an empty table. Columns named like the results
    are replaced.
    """
    docs, at, back = unnamed(docs, ("copy", "shuffle_key"))
    key, source = at[key], at[source]
    rated = scratch(rates(docs, weights, source, size), "rates")
    few = rated.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rated = rated.select("_source", "rate", "pieces")
    keyed = identified(docs, key).withColumn("_source", F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")))
    joined = keyed.join(F.broadcast(rated) if few else rated, "_source")
    count = F.pandas_udf(_counts, T.LongType())
    single = joined.where("pieces = 1").withColumn("_n", count(uniform(F.col("_id"), seed), F.col("rate")))
    names_n = [*docs.columns, "_id", "_n"]
    # The draw of each piece is made on the row's id alone; texts don't travel with the pieces.
    many = joined.where("pieces > 1").select("_id", "rate", "pieces")
    pieces = many.select("_id", "rate", "pieces", F.explode(F.sequence(F.lit(1), F.col("pieces"))).alias("_piece"))
    drawn = pieces.withColumn("_n", count(uniform(F.concat_ws(":", "_id", F.col("_piece").cast("string")), seed), F.col("rate") / F.col("pieces")))
    summed = drawn.groupBy("_id").agg(F.sum("_n").alias("_n"))
    several = joined.where("pieces > 1").join(summed, "_id").select(*names_n)
    counted = single.select(*names_n).unionByName(several)
    copies = counted.where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    order = F.conv(F.substring(F.md5(F.concat_ws("|", "_id", F.col("copy").cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long")
    shuffled = copies.withColumn("shuffle_key", order).drop("_id")
    return shuffled.repartitionByRange("shuffle_key", "copy").sortWithinPartitions("shuffle_key", "copy").select(*back, "copy", "shuffle_key")

"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(*rules: tuple[Column, str | Column], default=None) -> Column:
    """The value of the first rule that holds."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return reduce(lambda rest, rule: F.when(rule[0], value(rule[1])).otherwise(rest), reversed(rules), value(default))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_per(rows: DataFrame, keys: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def round_robin(rows: DataFrame, bucket: list, order: list, n: int) -> DataFrame:
    """``n`` rows, taken from the buckets in turn."""
    ranked = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)))
    return ranked.orderBy("_turn", *bucket).limit(n).drop("_turn")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name, as Python's uuid.uuid5 gives it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def squeezed(text: Column) -> Column:
    """Text with runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def the_one(rows: DataFrame, *columns: str) -> DataFrame:
    """The single row of a table; a query over none or several raises when it runs."""
    kept = F.max(F.struct(*columns)) if columns else F.max(F.struct(*rows.columns))
    one = rows.agg(kept.alias("_r"), F.count(F.lit(1)).alias("_n"))
    sound = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("one row was expected, not "), F.col("_n").cast("string"))))
    return one.select(sound.alias("_r")).select("_r.*")


def contains_any(text: Column, words) -> Column:
    """Whether a text holds one of the words, anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out

"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

Every speaker of a dialogue but the system gets a rendering in which that speaker is the assistant, all
others are named users, and the mask covers what the assistant says (with its end mark).

A dialogue is rendered in parts of ``PART`` turn numbers, and a part in pieces of ``PART`` rows, as turn numbers
may be null or recur; so no row or group grows with the dialogue. The pieces of one perspective, joined in order,
are the whole rendering, and masks count from a piece's start. ``whole_parts`` joins the pieces of each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PART = 128
SYSTEM = "system"
UNNAMED = "unknown"
END = "<|end|>\n"


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, perspective, part, piece, rendered, mask_starts, mask_ends, n_turns, n_chars, n_masked), masks in characters.

    Turns are ordered by (turn, role, text), nulls first. A null role speaks as 'unknown', a null text is empty, a
    null conversation id is one dialogue, a null turn stands in part 0. Repeated rows are said as often as they
    come. Dialogues in which only the system speaks have no perspective. An empty table gives an empty table;
    other columns are left out.
    """
    said = turns.select(
        F.col(f"`{conv}`").alias("conv"),
        F.coalesce(F.floor(F.col(f"`{turn}`") / PART), F.lit(0)).cast("long").alias("part"),
        F.struct(F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit(UNNAMED)).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("said"),
    )
    speakers = said.where(F.col("said.role") != SYSTEM).select(F.col("conv").alias("of"), F.col("said.role").alias("perspective")).distinct()
    placed = F.row_number().over(Window.partitionBy("conv", "part").orderBy("said")) - 1
    parts = said.withColumn("piece", F.floor(placed / PART)).groupBy("conv", "part", "piece").agg(F.sort_array(F.collect_list("said")).alias("said"))
    seen = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of")))
    own = lambda m: m["role"] == F.col("perspective")
    head = lambda m: F.when(m["role"] == SYSTEM, F.lit("<|system|>\n")).when(own(m), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user:"), m["role"], F.lit("|>\n")))
    piece = F.transform("said", lambda m: F.struct(own(m).alias("own"), head(m).alias("head"), F.concat(m["text"], F.lit(END)).alias("body")))
    seen = seen.withColumn("pieces", piece)
    seen = seen.withColumn("sizes", F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"])))
    before = lambda i: F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, n: a + n)
    spans = F.transform("pieces", lambda p, i: F.struct(p["own"].alias("own"), (before(i) + F.length(p["head"])).alias("start"), (before(i) + F.length(p["head"]) + F.length(p["body"])).alias("end")))
    seen = seen.withColumn("spans", F.filter(spans, lambda s: s["own"]))
    return seen.select(
        F.col("conv").alias(conv),
        "perspective",
        "part",
        "piece",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.transform("spans", lambda s: s["start"]).alias("mask_starts"),
        F.transform("spans", lambda s: s["end"]).alias("mask_ends"),
        F.size("said").cast("long").alias("n_turns"),
        F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_chars"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_masked"),
    )


def whole_parts(pieces: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The rows of ``perspectives`` with one row for each part: its pieces joined in order, masks from the part's start.

    ``first_char`` is where the part begins in the whole rendering, which is the parts joined in order, for dialogues of any
    length. Such a row holds all that was said under its turn numbers, however much that is.
    """
    key = [f"`{conv}`", "perspective", "part"]
    before = F.sum("n_chars").over(Window.partitionBy(*key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    moved = pieces.withColumn("before", F.coalesce(before, F.lit(0)))
    moved = moved.withColumns({c: F.transform(c, lambda x: x + F.col("before")) for c in ("mask_starts", "mask_ends")})
    held = F.sort_array(F.collect_list(F.struct("piece", "rendered", "mask_starts", "mask_ends"))).alias("held")
    joined = moved.groupBy(*key).agg(held, *[F.sum(c).alias(c) for c in ("n_turns", "n_chars", "n_masked")])
    earlier = F.sum("n_chars").over(Window.partitionBy(*key[:2]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return joined.select(
        *key,
        F.coalesce(earlier, F.lit(0)).alias("first_char"),
        F.array_join("held.rendered", "").alias("rendered"),
        F.flatten("held.mask_starts").alias("mask_starts"),
        F.flatten("held.mask_ends").alias("mask_ends"),
        "n_turns",
        "n_chars",
        "n_masked",
    )

"""Event-exact history: what each event of a batch did to the inventory, and what the batch comes to.

Events count in order of (ts, event_id), each on its path; a MOVE touches its old path (the row leaves) and its new path (it arrives). What a
touch meets depends on its path alone, but for one case: a row that left may have gone (the new path was free) or stayed as a
deleted one (it wasn't), which the move's arrival tells. So a touch's state is known from a window over its path, or it is that of
one earlier move. These references are chains of any length; they are followed by pointer doubling over stored tables, in as many rounds as
the logarithm of the longest chain. Rows that move on and on are followed back to where they came from in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import drop_scratch, scratch

#: Rounds of pointer doubling: 2^64 moves in a row.
ROUNDS = 64
LEAST = -(1 << 63)


def move_class(old: str = "old_path", new: str = "path") -> Column:
    folder = lambda c: F.regexp_replace(F.col(c), "/[^/]*$", "")
    return F.when(folder(old) == folder(new), "RENAMED").otherwise("MOVED")


def doubled(table: DataFrame, unresolved: Column, name: str) -> DataFrame:
    """Follows ``next`` from row to row (each has its key in ``at``) until no row is ``unresolved``; other columns fill up from the row that is met.

    ``table`` is stored. Each round doubles the steps that a row's pointer spans, and is stored and counted: a plan never grows with a chain.
    """
    values = [c for c in table.columns if c not in ("at", "next")]
    for k in range(ROUNDS):
        if table.where(unresolved).isEmpty():
            return table
        met = table.select(F.col("at").alias("_at"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in values])
        waiting = table.where(unresolved).join(met, F.col("next") == F.col("_at"), "left")
        step = waiting.select("at", F.col("_next").alias("next"), *[F.coalesce(c, f"_{c}").alias(c) for c in values])
        before, table = table, scratch(table.where(~unresolved).unionByName(step), f"{name}-{k}")
        drop_scratch(before)
    raise ValueError("moves refer to each other in more than 2^64 steps")


def _touches(files: DataFrame, events: DataFrame) -> DataFrame:
    """Touches of all paths that events name, after the rows that these have (kind S): one row for each (ts, event_id) and path.

    kind: U (created or updated), D (deleted), O (a row leaves for ``other``), I (one arrives from ``other``).
    """
    if "old_path" not in events.columns:
        events = events.withColumn("old_path", F.lit(None).cast("string"))
    when = F.coalesce(F.col("ts").cast("long"), F.lit(LEAST)).alias("ts"), F.coalesce(F.col("event_id").cast("long"), F.lit(LEAST)).alias("event_id")
    named = events.where("path is not null").select(*when, "path", "event", "old_path", F.col("size_bytes").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"))
    once = named.groupBy("ts", "event_id").agg(F.min(F.struct("path", "event", "old_path", "size", "mtime")).alias("e")).select("ts", "event_id", "e.*")
    none = F.lit(None)
    touch = lambda path, kind, other, *v: F.struct(path.alias("path"), kind.alias("kind"), other.cast("string").alias("other"), *[x.cast("long").alias(n) for x, n in zip(v, ("size", "mtime"), strict=True)])
    moves = F.coalesce((F.col("event") == "MOVE") & (F.col("old_path") != F.col("path")), F.lit(False))
    gone = F.coalesce(F.col("event") == "DELETE", F.lit(False))
    arrives = touch(F.col("path"), F.when(moves, F.lit("I")).when(gone, F.lit("D")).otherwise(F.lit("U")), F.when(moves, F.col("old_path")), F.when(~gone, F.col("size")), F.when(~gone, F.col("mtime")))
    leaves = touch(F.col("old_path"), F.lit("O"), F.col("path"), none, none)
    spread = once.select("ts", "event_id", F.explode(F.when(moves, F.array(leaves, arrives)).otherwise(F.array(arrives))).alias("t")).select("ts", "event_id", "t.*")
    known = files.select("path", "file_id", F.col("size_bytes").cast("long").alias("size"), F.col("modified_at_fs").cast("long").alias("mtime"), F.col("deleted_epoch").cast("long").alias("deleted_epoch"))
    start = known.join(spread.select("path").distinct(), "path", "left_semi")
    return spread.unionByName(start.withColumn("kind", F.lit("S")), allowMissingColumns=True)


def _with_states(touches: DataFrame) -> DataFrame:
    """Adds before (none, active, deleted, or left: as the move at ``left_at`` tells) and at, the event's own key.

    A row is in the state that the last touch before it left which brought the row to life or took it from there.
    """
    by_path = Window.partitionBy("path").orderBy("ts", "event_id")
    alive = F.col("kind").isin("U", "I") | ((F.col("kind") == "S") & F.col("deleted_epoch").isNull())
    flagged = touches.withColumn("_alive", alive)
    counts = flagged.withColumn("_tells", F.col("_alive") | (F.col("kind") == "S") | F.coalesce(F.lag("_alive").over(by_path), F.lit(False)))
    told = F.last(F.when(F.col("_tells"), F.struct("_alive", "kind", "ts", "event_id")), ignorenulls=True).over(by_path.rowsBetween(Window.unboundedPreceding, -1))
    before = F.when(F.col("_p").isNull(), "none").when(F.col("_p._alive"), "active").when(F.col("_p.kind") == "O", "left").otherwise("deleted")
    found = counts.withColumn("_p", told).withColumn("before", before)
    at = F.when(F.col("kind") != "S", F.struct("ts", "event_id"))
    return found.withColumns({"left_at": F.when(F.col("before") == "left", F.struct("_p.ts", "_p.event_id")), "at": at}).drop("_alive", "_tells", "_p")


def _moved(states: DataFrame) -> DataFrame:
    """(at, met): for each move of an active row, whether its new path had a row."""
    sides = states.where(F.col("kind").isin("O", "I")).groupBy("at").agg(
        F.bool_or((F.col("kind") == "O") & (F.col("before") == "active")).alias("leaves"),
        F.max(F.when(F.col("kind") == "I", F.col("before"))).alias("target"),
        F.max(F.when(F.col("kind") == "I", F.col("left_at"))).alias("next"),
    )
    met = F.when(F.col("target") == "none", F.lit(False)).when(F.col("target") != "left", F.lit(True))
    stored = scratch(sides.where("leaves").select("at", "next", met.alias("met")), "moves")
    return doubled(stored, F.col("met").isNull(), "moves").select("at", "met")


@dataclass
class Fold:
    """touches: every touch with its state before, the origin of its row, and what it did. origins: where rows that moved came from."""

    touches: DataFrame
    origins: DataFrame | None


def fold(files: DataFrame, events: DataFrame) -> Fold:
    """Folds a batch into the rows of the paths that it names, event by event.

    Rows of events with one (ts, event_id) count once (the least of them); a null path is no event, a null time comes before all others. A path's
    touches are ordered in one task and streamed; all else is spread by event.
    """
    states = scratch(_with_states(_touches(files, events)), "states")
    nowhere = F.lit(None).cast("boolean")
    if states.where("kind = 'O' and before = 'active'").isEmpty():  # nothing leaves: nothing depends on another path
        return Fold(scratch(_with_origins(states.withColumn("met", nowhere).drop("left_at")), "touches"), None)
    moved = _moved(states)
    plain = states.where(~F.col("kind").isin("O", "I") & (F.col("before") != "left")).withColumn("met", nowhere)
    rest = states.where(F.col("kind").isin("O", "I") | (F.col("before") == "left")).withColumn("_k", F.when(F.col("before") == "left", F.col("left_at")).otherwise(F.col("at")))
    earlier = moved.select(F.col("at").alias("_k"), F.col("met").alias("_met"))
    settled = rest.join(earlier, "_k", "left").withColumn("before", F.when(F.col("before") != "left", F.col("before")).when(F.col("_met"), "deleted").otherwise("none")).drop("_k", "_met")
    settled = settled.join(moved, "at", "left")
    touches = scratch(_with_origins(plain.unionByName(settled).drop("left_at")), "touches")
    drop_scratch(states)
    return Fold(touches, _origins(touches))


def _with_origins(states: DataFrame) -> DataFrame:
    """Adds the row that a touch leaves at its path: where it began (``origin``), and the last values and deletion that events gave it there.

    met: of a move of an active row, whether its new path had one. Such a move takes the row along if not.
    """
    by_path = Window.partitionBy("path").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda what: F.last(what, ignorenulls=True).over(by_path)
    comes = (F.col("kind") == "I") & F.coalesce(~F.col("met"), F.lit(False))
    begins = (F.col("kind") == "S") | (F.col("kind").isin("U", "I") & (F.col("before") == "none"))
    marked = states.withColumns({"_comes": comes, "_begins": begins})
    start = F.struct(F.when(F.col("kind") == "S", F.lit("known")).when(F.col("_comes"), F.lit("moved")).otherwise(F.lit("created")).alias("how"), "at", "file_id", "path", F.col("size").alias("size"), F.col("mtime").alias("mtime"), "deleted_epoch")
    value = lambda c: last(F.when(F.col("_begins") | F.col(c).isNotNull(), F.struct(c)))
    takes = (F.col("kind") == "O") & (F.col("before") == "active")
    ended = F.when((F.col("kind") == "D") & (F.col("before") != "none") | takes & F.coalesce("met", F.lit(False)), F.col("ts"))
    after = (
        F.when(F.col("kind").isin("U", "I"), "active").when(F.col("kind") == "S", F.when(F.col("deleted_epoch").isNull(), "active").otherwise("deleted"))
        .when(takes, F.when(F.col("met"), "deleted").otherwise("none")).when((F.col("kind") == "D") & (F.col("before") == "active"), "deleted").otherwise(F.col("before"))
    )
    found = marked.withColumns({"origin": last(F.when(F.col("_begins"), start)), "row_size": value("size")["size"], "row_mtime": value("mtime")["mtime"], "ended": last(ended), "after": after})
    return found.withColumn("comes", F.col("_comes")).drop("_comes", "_begins", "size", "mtime", "deleted_epoch", "file_id")


def _origins(touches: DataFrame) -> DataFrame:
    """(at, ...) for each move that took a row along: the first origin of that row, its values as it arrived."""
    known = lambda c: F.when(F.col("origin.how") == "known", F.col(f"origin.{c}"))
    left = touches.where("kind = 'O' and before = 'active' and not met").select(
        "at", F.when(F.col("origin.how") == "moved", F.col("origin.at")).alias("next"), (F.col("origin.how") == "created").alias("_new"), known("file_id").alias("file_id"), known("path").alias("from_path"), known("size").alias("known_size"),
        known("mtime").alias("known_mtime"), known("deleted_epoch").alias("known_deleted"), F.col("row_size").alias("_size"), F.col("row_mtime").alias("_mtime"),
    )
    arrived = touches.where("comes").select("at", F.col("row_size").alias("_own_size"), F.col("row_mtime").alias("_own_mtime"), F.col("origin.size").alias("_first_size"), F.col("origin.mtime").alias("_first_mtime"))
    both = left.join(arrived, "at")
    stored = both.select("at", "next", F.when(F.col("next").isNull(), F.col("_new")).alias("created"), "file_id", "from_path", "known_size", "known_mtime", "known_deleted", F.coalesce("_first_size", "_size").alias("size"), F.coalesce("_first_mtime", "_mtime").alias("mtime"))
    return doubled(scratch(stored, "origins"), F.col("created").isNull(), "origins").drop("next")


def _traced(rows: DataFrame, origins: DataFrame | None) -> DataFrame:
    """Adds to touches the row they leave: created, file_id, from_path, size and mtime; known_size, known_mtime, known_deleted before the batch."""
    own = {c: F.col(f"origin.{k}") for c, k in (("file_id", "file_id"), ("from_path", "path"), ("known_size", "size"), ("known_mtime", "mtime"), ("known_deleted", "deleted_epoch"))}
    of_known = {c: F.when(F.col("origin.how") == "known", x) for c, x in own.items()}
    if origins is None:
        return rows.withColumns({"created": F.col("origin.how") == "created", **of_known, "size": F.col("row_size"), "mtime": F.col("row_mtime")})
    here = rows.where("origin is null or origin.how <> 'moved'").withColumns({"created": F.col("origin.how") == "created", **of_known, "size": F.col("row_size"), "mtime": F.col("row_mtime")})
    came = rows.where("origin.how = 'moved'").withColumn("_k", F.col("origin.at"))
    joined = came.join(origins.withColumnRenamed("at", "_k").withColumnsRenamed({"size": "_size", "mtime": "_mtime"}), "_k")
    moved = joined.withColumns({"size": F.coalesce("row_size", "_size"), "mtime": F.coalesce("row_mtime", "_mtime")}).drop("_k", "_size", "_mtime")
    return here.unionByName(moved)


def net_rows(folded: Fold, gone: bool = False) -> DataFrame:
    """The rows that the batch leaves at the paths it names: (path, file_id, size_bytes, modified_at_fs, deleted_epoch, mutation, old_path).

    With ``gone`` paths that had a row and have none any more come too, with alive false (true for all others).

    mutation compares with the inventory before the batch: CREATED, RESTORED, MODIFIED, DELETED, RENAMED, MOVED, or null where nothing
    happened. A row that ends as deleted keeps its values and its first mark from before; one that the batch created and deleted leaves none.
    """
    columns = [c for c in folded.touches.columns if c not in ("path", "ts", "event_id")]
    acted = F.bool_or(F.col("kind").isin("U", "I") | ((F.col("kind") == "D") & (F.col("before") != "none")) | ((F.col("kind") == "O") & (F.col("before") == "active")))
    order = F.struct(F.col("kind") != "S", "ts", "event_id")
    last = folded.touches.groupBy("path").agg(F.max_by(F.struct(*columns), order).alias("t"), acted.alias("acted"), F.bool_or(F.col("kind") == "S").alias("had")).select("path", "acted", "had", "t.*")
    rows = _traced(last, folded.origins).withColumn("alive", (F.col("after") == "active") | ((F.col("after") == "deleted") & ~F.col("created")))
    rows = rows.where(F.col("alive") | (F.col("had") if gone else F.lit(False)))
    marked, moved = F.col("after") == "deleted", ~F.coalesce(F.col("from_path") == F.col("path"), F.lit(True))
    mutation = F.when(~F.col("acted") | ~F.col("alive"), F.lit(None)).when(marked, F.lit("DELETED")).when(F.col("created"), F.lit("CREATED")).when(moved, move_class("from_path", "path")).when(F.col("known_deleted").isNotNull(), F.lit("RESTORED")).otherwise(F.lit("MODIFIED"))
    return rows.select(
        "path",
        "file_id",
        F.when(marked, F.col("known_size")).otherwise(F.col("size")).alias("size_bytes"),
        F.when(marked, F.col("known_mtime")).otherwise(F.col("mtime")).alias("modified_at_fs"),
        F.when(marked, F.coalesce("known_deleted", "ended")).alias("deleted_epoch"),
        mutation.alias("mutation"),
        F.when(moved, F.col("from_path")).alias("old_path"),
        *(["alive"] if gone else []),
    )


def mutations(folded: Fold) -> DataFrame:
    """(event_key, event_id, ts, path, old_path, file_id, mutation): a row for each change that an event made, in the order of events.

    CREATED, MODIFIED, RESTORED, DELETED as the state before each event says; RENAMED or MOVED where a row came along; DELETED for a row
    whose file moved onto another. event_key is that of the event and path, so rows of a replayed batch are equal. file_id is null for rows
    that the batch created.
    """
    left = (F.col("kind") == "O") & (F.col("before") == "active") & F.coalesce("met", F.lit(False))
    kind = (
        F.when(F.col("kind").isin("U", "I"), F.when(F.col("comes"), move_class("other", "path")).when(F.col("before") == "none", "CREATED").when(F.col("before") == "deleted", "RESTORED").otherwise("MODIFIED"))
        .when((F.col("kind") == "D") & (F.col("before") != "none") | left, "DELETED")
    )
    told = _traced(folded.touches.withColumn("mutation", kind).where("mutation is not null"), folded.origins)
    key = F.sha2(F.concat_ws("|", "path", "mutation", "ts", "event_id"), 256)
    return told.select(key.alias("event_key"), "event_id", "ts", "path", F.when(F.col("comes"), F.col("other")).alias("old_path"), "file_id", "mutation")


def audit_log(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """One log of both kinds: what events did (``mutations``) and how arrivals were told from known files (``identity_match``).

    event_key is that of the change, or of the arrival and its decision, so a replay adds nothing that add_if_absent would keep.
    """
    linked = F.col("event") == "IDENTITY_MATCHED"
    reason = F.when(F.col("event") == "HARDLINK_DETECTED", "a path of the same inode is still there").when(F.col("event") == "IDENTITY_AMBIGUOUS", "several missing candidates").when(linked, "one candidate, high score").otherwise("one candidate, score too low")
    told = decisions.select(
        F.sha2(F.concat_ws("|", "path", "event", "candidate_id"), 256).alias("event_key"), "path", F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("long").alias("file_id"), F.col("event").alias("event_type"),
        F.col("candidate_id").alias("candidate_file_id"), F.col("score").cast("int").alias("score"), "level", F.when(linked, "auto_linked").otherwise("created_separate").alias("decision"), reason.alias("reason"),
    )
    along = F.col("mutation").isin("RENAMED", "MOVED")
    done = changes.select(
        "event_key", "path", "old_path", "file_id", F.col("mutation").alias("event_type"), F.when(along, F.col("file_id")).alias("candidate_file_id"), F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("level"),
        F.when(along, "auto_linked").otherwise("state_updated").alias("decision"), F.lit(None).cast("string").alias("reason"),
    )
    return done.unionByName(told)

"""Change ingestion: snapshots and event batches against an inventory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import history
from foliant.operators.history import move_class  # noqa: F401


def signature(mtime: str = "mtime", size: str = "size_bytes", inode: str = "inode") -> Column:
    return F.concat_ws(":", F.col(mtime).cast("long"), F.col(size), F.col(inode))


def detect_changes(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Readable paths that are new or whose signature changed."""
    now = snapshot.where("readable").withColumn("new_signature", signature())
    joined = now.join(state.select("path", F.col("signature").alias("old_signature")), "path", "left")
    return joined.where(~F.col("old_signature").eqNullSafe(F.col("new_signature"))).select("path", "old_signature", "new_signature")


def reconcile_missing(state: DataFrame, snapshot: DataFrame, scope: str, threshold: int, full: bool = True) -> DataFrame:
    """Next state of every known or seen path: seen ones start over, unseen ones in scope count up.

    A path that was missed ``threshold`` times gets action DELETE and leaves the state. Sweeps that aren't full never count.
    Unreadable files are seen: they keep their old signature.
    """
    seen = snapshot.select("path", F.when(F.col("readable"), signature()).alias("seen_signature"), F.lit(True).alias("seen"))
    both = state.join(seen, "path", "full_outer")
    inside = (F.col("path") == scope) | F.col("path").startswith(scope + "/")
    counts = F.when(F.col("seen"), F.lit(0)).when(F.lit(full) & inside, F.col("missing_count") + 1).otherwise(F.col("missing_count"))
    out = both.select("path", F.coalesce("seen_signature", "signature").alias("signature"), counts.alias("missing_count"))
    return out.withColumn("action", F.when((F.col("missing_count") >= threshold) & F.lit(full), F.lit("DELETE")).otherwise(F.lit("KEEP")))


def next_root(roots: DataFrame, dirty: DataFrame, turn: int) -> DataFrame:
    """The root to scan next: the dirty one that was marked first, else the one whose turn it is."""
    first = dirty.agg(F.min_by("root", F.struct("marked_at", "root")).alias("dirty_root"))
    listed = roots.agg(F.array_sort(F.collect_set("root")).alias("_r"))  # configured roots
    return listed.crossJoin(F.broadcast(first)).select(F.coalesce("dirty_root", F.element_at("_r", (F.lit(turn) % F.size("_r") + 1).cast("int"))).alias("root"), F.col("dirty_root").isNotNull().alias("dirty"))


def debounce(events: DataFrame, seconds: int, keys: tuple[str, ...] = ("event", "path"), ts: str = "ts") -> DataFrame:
    """Accepted times of each key: one at least ``seconds`` after the accepted one before it.

    An event that follows the one before it by ``seconds`` or more is accepted whatever came earlier, so a key's events are
    cut there into runs; runs spread over the tasks and are streamed in order of time, none is held as a whole.
    """
    held = events.select(*keys, F.col(ts).cast("long").alias("_ts"))
    by_key = Window.partitionBy(*keys).orderBy("_ts")
    gap = F.col("_ts") - F.lag("_ts").over(by_key)
    runs = held.withColumn("_cut", F.when(gap.isNull() | (gap >= seconds), 1).otherwise(0)).withColumn("_run", F.sum("_cut").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    placed = runs.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", "_ts")
    schema = T.StructType([f for f in held.schema if f.name != "_ts"] + [T.StructField(ts, T.LongType())])

    def accepted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0
        for batch in batches:
            times, cut = batch["_ts"].to_numpy(), np.append(np.flatnonzero(batch["_cut"].to_numpy()), len(batch))
            kept = []
            at = 0
            for end in cut:
                # Within a run the next accepted event is the first that is late enough.
                while at < end:
                    at += int(np.searchsorted(times[at:end], last + seconds))
                    if at < end:
                        kept.append(at)
                        last = times[at]
                        at += 1
                if end < len(batch):
                    kept.append(end)
                    last, at = times[end], end + 1
            yield batch.iloc[kept][list(keys)].assign(**{ts: times[kept]})

    return placed.mapInPandas(accepted, schema)


def dirty_roots(events: DataFrame) -> DataFrame:
    """Last mark of each first-level root that an event's path or old path lies in."""
    root = F.explode(F.array_distinct(F.array_compact(F.transform(F.array("path", "old_path"), lambda p: F.nullif(F.substring_index(p, "/", 3), F.lit(""))))))
    return events.select(root.alias("root"), "ts").groupBy("root").agg(F.max("ts").alias("marked_at"), F.count("*").alias("events"))


def prioritised(events: DataFrame, realtime: int = 50, polling: int = 10) -> DataFrame:
    """The next batch: up to ``realtime`` realtime events, then up to ``polling`` polled ones, each in order of time."""
    first = lambda name, n, priority: events.where(F.col("stream") == name).orderBy("ts", "event_id").limit(n).withColumn("priority", F.lit(priority))
    return first("realtime", realtime, 0).unionByName(first("polling", polling, 1))


def latest_per_path(events: DataFrame) -> DataFrame:
    """The last event of each path, by time, then id."""
    columns = [c for c in events.columns if c != "path"]
    return events.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("_e")).select("path", "_e.*")


#: Columns of an inventory.
ROW = ["path", "file_id", "size_bytes", "modified_at_fs", "deleted_epoch"]


def untouched(files: DataFrame, events: DataFrame) -> DataFrame:
    """Rows whose path no event names."""
    named = events.select("path")
    if "old_path" in events.columns:
        named = named.union(events.where("event = 'MOVE'").select("old_path"))
    kept = files.join(named.where("path is not null").distinct(), "path", "left_anti")
    return kept.select("path", "file_id", *[F.col(c).cast("long").alias(c) for c in ROW[2:]])


def apply_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """Inventory after a batch: upserts by path, deletions are marks, a later upsert takes the mark away.

    A MOVE takes the row of an active old path to a path that had no row; if that had one, the old path is marked as
    deleted and the other updated. Events count one by one in order of time, so moves in a row, forks and returns end where
    the last one leads. Adds mutation, the batch's net effect on a row: CREATED, RESTORED, MODIFIED, DELETED, RENAMED, MOVED, or null where
    nothing happened, and old_path of moved rows. A deletion of an unknown path adds nothing. Rows need no file_id: those that a batch creates
    have none yet.
    """
    changed = history.net_rows(history.fold(files, events))
    nothing = {"mutation": F.lit(None).cast("string"), "old_path": F.lit(None).cast("string")}
    return untouched(files, events).withColumns(nothing).unionByName(changed)


def identity_match(arrivals: DataFrame, files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Decision on each arrival by active files that share its device and inode at another path.

    Any of them still present: a hard link. None: no event. Several missing: ambiguous. One missing: scored, and
    linked from 90 points on.
    """
    here = snapshot.select("path", F.lit(True).alias("present"))
    known = files.where("deleted_epoch is null").select(F.col("file_id").alias("old_id"), F.col("path").alias("_old"), "filesystem_device", "inode", F.col("size_bytes").alias("_size"), F.col("modified_at_fs").alias("_mtime"), F.col("hash_content").alias("_hash"))
    known = known.join(here.withColumnRenamed("path", "_old"), "_old", "left")
    new = arrivals.select("path", "filesystem_device", "inode", "size_bytes", "modified_at_fs", "hash_content")
    pairs = new.join(known, ["filesystem_device", "inode"]).where("path <> _old")
    missing = F.col("present").isNull()
    points = 20 + 20 + F.when(F.col("size_bytes") == F.col("_size"), 10).otherwise(0) + F.when(F.col("modified_at_fs") == F.col("_mtime"), 10).otherwise(0) + F.when(F.col("hash_content") == F.col("_hash"), 30).otherwise(0) + 10
    pairs = pairs.withColumn("_points", F.when(missing, points))
    found = pairs.groupBy("path").agg(F.count("*").alias("candidates"), F.count_if(~missing).alias("present"), F.count_if(missing).alias("missing"), F.max("_points").alias("_points"), F.min(F.when(~missing, F.col("old_id"))).alias("_link"), F.min(F.when(missing, F.col("old_id"))).alias("_gone"))
    single = (F.col("present") == 0) & (F.col("missing") == 1)
    score = F.when(single, F.col("_points"))
    event = F.when(F.col("present") > 0, "HARDLINK_DETECTED").when(F.col("missing") > 1, "IDENTITY_AMBIGUOUS").when(score >= 90, "IDENTITY_MATCHED").otherwise("IDENTITY_REJECTED")
    level = F.when(~single, "ambiguous").when(score >= 90, "high").when(score >= 65, "medium").otherwise("low")
    return found.select("path", "candidates", event.alias("event"), level.alias("level"), score.alias("score"), F.coalesce("_link", "_gone").alias("candidate_id"))


def folder_closure(paths: DataFrame, path: str = "folder_path") -> DataFrame:
    """Every folder above and including the given ones, with its parent."""
    parts = F.filter(F.split(F.col(path), "/"), lambda s: s != "")
    up = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("_p", F.lit(1), i), "/")))
    folders = paths.select(parts.alias("_p")).where(F.size("_p") > 0).distinct().select(F.explode(up).alias("path")).distinct()
    return folders.withColumn("parent", F.nullif(F.regexp_replace("path", "/[^/]+$", ""), F.lit("")))


def audit_rows(applied: DataFrame) -> DataFrame:
    """One log row for each mutation, with a key that makes replays harmless."""
    rows = applied.where("mutation is not null")
    return rows.select("path", "file_id", "mutation", F.sha2(F.concat_ws("|", "path", "mutation", F.coalesce("modified_at_fs", F.lit(0))), 256).alias("event_key"))


def session_accounts(stream: DataFrame) -> DataFrame:
    """Counts of each session, and whether all queued jobs are done."""
    counts = stream.groupBy("session_id").agg(F.count("*").alias("discovered"), F.count_if(F.col("size_bytes").isNotNull()).alias("enqueued"), F.count_if(F.col("size_bytes").isNotNull() & (F.col("event") != "DELETE")).alias("processed"))
    return counts.withColumn("status", F.when(F.col("processed") >= F.col("enqueued"), "finished").otherwise("running"))


def add_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table lacks; of rows with one key the least stays."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()
    return first.join(table, keys, "left_anti")


def violations(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, code) for each broken rule of each row; a rule that can't be judged is broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return rows.select(key, F.explode(codes).alias("code"))

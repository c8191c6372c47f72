"""An inventory as a log: a base in hash buckets, a segment of changes for each batch, and a commit file that says what counts.

A batch writes the rows that it changed and nothing else, so its cost grows with the batch. Readers merge: of a path's rows in base and
segments the one of the newest batch counts. Buckets that gathered many changes are written anew from time to time, only those.

Nothing counts before its commit: a batch that breaks off leaves files that the next try overwrites. A batch that is committed is not applied
again. One writer at a time; any number of readers, which see the last commit.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import history
from foliant.sources.scratch import drop_folder

ROW = "path string, file_id long, size_bytes long, modified_at_fs long, deleted_epoch long"
STORED = f"{ROW}, alive boolean, batch long, bucket int"


@dataclass
class Commit:
    """What counts after a batch. base: version of each bucket that has one. upto: batch that a bucket's base includes. pending and rows: changes since then, and rows of the base."""

    batch: int
    buckets: int
    segments: list[int] = field(default_factory=list)
    base: dict[int, int] = field(default_factory=dict)
    upto: dict[int, int] = field(default_factory=dict)
    pending: dict[int, int] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Commit:
        held = json.loads(text)
        return cls(**{k: {int(b): n for b, n in v.items()} if isinstance(v, dict) else v for k, v in held.items()})


class InventoryLog:
    """``folder`` is in any file system that Spark knows and in which renaming a file is atomic.

    A bucket is written anew when its changes are more than ``share`` of its rows, or of ``least`` if it has fewer.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, share: float = 0.5, least: int = 10_000):
        self.spark, self.folder, self.buckets, self.share, self.least = spark, folder.rstrip("/"), buckets, share, least

    # ------------------------------------------------------------ commits

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> Commit | None:
        """The newest commit; None for a log that has none."""
        folder, store = self._path("commits")
        if not store.exists(folder):
            return None
        names = sorted(n for f in store.listStatus(folder) if (n := f.getPath().getName()).endswith(".json"))
        if not names:
            return None
        return Commit.parse(self.spark.read.option("wholetext", True).text(f"{self.folder}/commits/{names[-1]}").first()[0])

    def _commit(self, commit: Commit) -> None:
        """Written under another name first: a reader never sees half a commit."""
        half, store = self._path(f"commits/{commit.batch:012d}.half")
        whole, _ = self._path(f"commits/{commit.batch:012d}.json")
        out = store.create(half, True)
        out.write(bytearray(json.dumps(asdict(commit)).encode()))
        out.close()
        if not store.rename(half, whole):
            raise ValueError(f"commit {commit.batch} of {self.folder} is there already: another writer is at work")

    # ------------------------------------------------------------ reading

    def _bucket(self):
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def _stored(self, commit: Commit, only: list[int] | None = None) -> DataFrame:
        """Rows of base and segments, of the given buckets."""
        wanted = range(commit.buckets) if only is None else only
        parts = [self.spark.createDataFrame([], STORED)]
        versions: dict[int, list[int]] = {}
        for b in wanted:
            if b in commit.base:
                versions.setdefault(commit.base[b], []).append(b)
        for version, own in versions.items():
            stored = self.spark.read.schema(STORED).parquet(f"{self.folder}/base/v={version}")
            parts.append(stored if len(own) == commit.buckets else stored.where(F.col("bucket").isin(own)))
        if commit.segments:
            changes = self.spark.read.schema(STORED).parquet(*[f"{self.folder}/changes/batch={k}" for k in commit.segments])
            parts.append(changes if only is None else changes.where(F.col("bucket").isin(only)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _merged(self, commit: Commit, only: list[int] | None = None, paths: DataFrame | None = None) -> DataFrame:
        stored = self._stored(commit, only)
        if paths is not None:
            stored = stored.join(paths, "path", "left_semi")
        newest = stored.groupBy("path").agg(F.max_by(F.struct("file_id", "size_bytes", "modified_at_fs", "deleted_epoch", "alive"), "batch").alias("r"))
        return newest.select("path", "r.*").where("alive").drop("alive")

    def read(self) -> DataFrame:
        """The inventory as of the last commit: (path, file_id, size_bytes, modified_at_fs, deleted_epoch)."""
        commit = self.last()
        return self._merged(commit) if commit else self.spark.createDataFrame([], ROW)

    def rows_of(self, paths: DataFrame) -> DataFrame:
        """Rows of the given paths (one column, path), from their buckets alone."""
        commit = self.last()
        if not commit:
            return self.spark.createDataFrame([], ROW)
        named = paths.where("path is not null").distinct()
        only = [r[0] for r in named.select(self._bucket().alias("b")).distinct().collect()]  # at most all buckets
        return self._merged(commit, only, named)

    # ------------------------------------------------------------ writing

    def create(self, files: DataFrame) -> None:
        """A new log with the given rows as its base. Rows with a null path are left out; of several of one path the largest stays."""
        if self.last():
            raise ValueError(f"{self.folder} has an inventory already")
        drop_folder(self.spark, self.folder)
        rows = files.where("path is not null").groupBy("path").agg(F.max(F.struct("file_id", "size_bytes", "modified_at_fs", "deleted_epoch")).alias("r")).select("path", "r.*")
        commit = Commit(-1, self.buckets)
        self._write_base(rows, commit)
        self._commit(commit)

    def _write_base(self, rows: DataFrame, commit: Commit) -> None:
        """Rows as the base of their buckets, as of the commit's batch."""
        version = commit.batch + 1
        placed = rows.select("path", "file_id", *[F.col(c).cast("long").alias(c) for c in ("size_bytes", "modified_at_fs", "deleted_epoch")], F.lit(True).alias("alive"), F.lit(commit.batch).cast("long").alias("batch"), self._bucket().alias("bucket"))
        folder = f"{self.folder}/base/v={version}"
        placed.repartition("bucket").sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        counts = {r["bucket"]: r["count"] for r in self.spark.read.schema(STORED).parquet(folder).groupBy("bucket").count().collect()}
        for b, n in counts.items():
            commit.base[b], commit.rows[b] = version, n

    def apply(self, changes: DataFrame, batch: int) -> Commit | None:
        """Adds a batch's changes (rows with alive, as ``history.net_rows(..., gone=True)`` gives); None if it is committed already.

        Writes them as the batch's segment, then buckets that are due, then the commit.
        """
        last = self.last()
        if last is None:
            raise ValueError(f"{self.folder} has no inventory yet")
        if batch <= last.batch:
            return None
        segment = f"{self.folder}/changes/batch={batch}"
        placed = changes.select("path", "file_id", "size_bytes", "modified_at_fs", "deleted_epoch", "alive", F.lit(batch).cast("long").alias("batch"), self._bucket().alias("bucket"))
        placed.write.mode("overwrite").parquet(segment)
        counts = self.spark.read.schema(STORED).parquet(segment).groupBy("bucket").count().collect()  # at most all buckets
        commit = Commit.parse(json.dumps(asdict(last)))
        commit.batch = batch
        commit.segments.append(batch)
        for r in counts:
            commit.pending[r["bucket"]] = commit.pending.get(r["bucket"], 0) + r["count"]
        due = [b for b, n in commit.pending.items() if n > self.share * max(self.least, commit.rows.get(b, 0))]
        if due:
            self._compact(commit, due)
        self._commit(commit)
        return commit

    def _compact(self, commit: Commit, due: list[int]) -> None:
        merged = self._merged(commit, due)
        for b in due:
            commit.base.pop(b, None)
            commit.rows.pop(b, None)
            commit.pending.pop(b, None)
            commit.upto[b] = commit.batch
        self._write_base(merged, commit)
        # A segment goes when every bucket with changes has a base that includes it.
        waiting = min([commit.upto.get(b, -1) for b in commit.pending], default=commit.batch)
        commit.segments = [k for k in commit.segments if k > waiting]

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what the last ``keep`` commits don't need. Readers of older ones must have ended."""
        folder, store = self._path("commits")
        names = sorted(f.getPath().getName() for f in store.listStatus(folder) if f.getPath().getName().endswith(".json"))
        kept = [Commit.parse(self.spark.read.option("wholetext", True).text(f"{self.folder}/commits/{n}").first()[0]) for n in names[-keep:]]
        needed = {f"changes/batch={k}" for c in kept for k in c.segments} | {f"base/v={v}" for c in kept for v in c.base.values()}
        for top in ("base", "changes"):
            path, store = self._path(top)
            for f in store.listStatus(path) if store.exists(path) else []:
                if f"{top}/{f.getPath().getName()}" not in needed:
                    store.delete(f.getPath(), True)
        for n in names[:-keep]:
            drop_folder(self.spark, f"{self.folder}/commits/{n}")


def touched_paths(events: DataFrame) -> DataFrame:
    return events.select("path").union(events.where("event = 'MOVE'").select("old_path")).where("path is not null").distinct()


def apply_batch(log: InventoryLog, events: DataFrame, batch: int) -> DataFrame | None:
    """Folds a batch of events into the log; the mutations, or None if the batch is committed already. Events have old_path."""
    last = log.last()
    if last and batch <= last.batch:
        return None
    folded = history.fold(log.rows_of(touched_paths(events)), events)
    log.apply(history.net_rows(folded, gone=True), batch)
    return history.mutations(folded)


def ingest_into_log(log: InventoryLog, dead: str, audit: str, split_valid: Callable) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: bad records aside, changes into the log, mutations into the audit table, each under the batch's number.

    The audit row of a mutation is written before the commit that makes it count, so none is ever missing; a batch that is tried again writes the
    same rows again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = log.last()
        if last and batch_id <= last.batch:
            return
        valid, bad = split_valid(batch)
        bad.write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        folded = history.fold(log.rows_of(touched_paths(valid)), valid)
        history.mutations(folded).write.mode("overwrite").parquet(f"{audit}/batch={batch_id}")
        log.apply(history.net_rows(folded, gone=True), batch_id)

    return apply

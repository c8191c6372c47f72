"""Structured Streaming forms of change ingestion: exact debounce, missing-file counters, and the event pipeline.

State is keyed by path and bounded by what is watched; replayed batches are harmless because every sink
is written under keys that an earlier run of the same batch wrote too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators import history, ingest
from foliant.sources.scratch import drop_folder

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("old_path", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("session_id", T.LongType()),
    ]
)


def event_source(spark: SparkSession, folder: str, per_trigger: int = 50) -> DataFrame:
    """Event records from a growing folder of Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


class Debouncer(StatefulProcessor):
    """Passes an event if none of its key was passed in the ``seconds`` before it.

    Once the watermark is ``seconds`` beyond the last passed event, any event that may still come passes: the state is cleared.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for frame in rows for t in frame["ts"])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t in times:
            if last is None or t - last >= self.seconds:
                kept.append(t)
                last = t
        if kept:
            self.last.update((last,))
            self.handle.registerTimer((last + self.seconds) * 1000)
            yield pd.DataFrame({"event": key[0], "path": key[1], "ts": kept})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and (self.last.get()[0] + self.seconds) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """(event, path, ts) of the accepted events of a stream; in each batch events are taken in order of time.

    Events that come more than ``late`` behind the newest may be dropped, which is what lets old state go.
    """
    stamped = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return stamped.groupBy("event", "path").transformWithStateInPandas(Debouncer(seconds), "event string, path string, ts long", "Append", "EventTime")


class MissingCounter(StatefulProcessor):
    """Counts full sweeps that missed a path; at ``threshold`` the path is deleted and forgotten.

    Input: one row for each known or seen path and sweep: (path, sweep, seen, full).
    """

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.missed = handle.getValueState("missed", T.StructType([T.StructField("n", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sweeps = pd.concat(list(rows)).sort_values("sweep")
        missed = self.missed.get()[0] if self.missed.exists() else 0
        gone = []
        for sweep, seen, full in zip(sweeps["sweep"], sweeps["seen"], sweeps["full"], strict=True):
            missed = 0 if seen else missed + bool(full)
            if missed >= self.threshold:
                gone.append(int(sweep))
                missed = 0
        if missed:
            self.missed.update((int(missed),))
        else:
            self.missed.clear()
        if gone:
            yield pd.DataFrame({"path": key[0], "sweep": gone, "event": "DELETE"})

    def close(self) -> None:
        pass


def missing_deletes(sweeps: DataFrame, threshold: int) -> DataFrame:
    return sweeps.groupBy("path").transformWithStateInPandas(MissingCounter(threshold), "path string, sweep long, event string", "Append", "None")


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead letters): records that break the contract go to the dead letters with all their errors."""
    errors = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("event").isin("CREATE", "UPSERT", "MOVE", "DELETE"), F.lit(False)), F.lit("event")),
            F.when(~F.coalesce(F.col("path").startswith("/"), F.lit(False)), F.lit("path")),
            F.when(F.col("ts").isNull(), F.lit("ts")),
            F.when((F.col("event") == "MOVE") & F.col("old_path").isNull(), F.lit("old_path")),
        )
    )
    judged = batch.withColumn("errors", errors)
    dead = judged.where(F.size("errors") > 0).select("event_id", "stream", F.to_json(F.struct(*batch.columns)).alias("payload"), F.array_join("errors", ",").alias("error"), "ts")
    return judged.where(F.size("errors") == 0).drop("errors"), dead


def newest_dead_letters(dead: DataFrame, n: int = 20) -> DataFrame:
    return dead.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def ingest_batches(inventory: str, dead: str, audit: str, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: applies a batch to the inventory, logs mutations, sets bad records aside.

    Version n + 1 of the inventory is written from version n under the batch's number, so a replayed batch writes the
    same files again. A version is a snapshot folder ``inventory/v=<n>``, and the last ``keep`` stay: for inventories that
    are small against their batches. ``inventory_log.ingest_into_log`` writes what a batch changed only.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        valid, bad = split_valid(batch)
        bad.write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        before = spark.read.parquet(f"{inventory}/v={batch_id}")
        folded = history.fold(before, valid)
        history.mutations(folded).write.mode("overwrite").parquet(f"{audit}/batch={batch_id}")
        after = ingest.untouched(before, valid).unionByName(history.net_rows(folded).select(*ingest.ROW))
        after.write.mode("overwrite").parquet(f"{inventory}/v={batch_id + 1}")
        if batch_id + 1 >= keep:
            drop_folder(spark, f"{inventory}/v={batch_id + 1 - keep}")

    return apply


def session_counts(events: DataFrame) -> DataFrame:
    """Running counts of each scan session; for update mode."""
    return events.groupBy("session_id").agg(F.count("*").alias("discovered"), F.count("size_bytes").alias("enqueued"))


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by hour of their time; hours close once the watermark has passed them."""
    stamped = events.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 hour").alias("hour"), "event").agg(F.count("*").alias("events"))

"""The log-structured inventory against dicts of rows."""

import os
import random

import pytest

from foliant.operators import history
from foliant.streaming import jobs
from foliant.streaming.inventory_log import InventoryLog, apply_batch, ingest_into_log
from tests.test_history import EVENTS, FILES, one_by_one


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def rows(log):
    found = log.read().collect()
    assert len({r.path for r in found}) == len(found)
    return {r.path: tuple(r)[1:] for r in found}


def batches(seed, n):
    rnd = random.Random(seed)
    names = [f"/w{k}/{c}" for k in range(20) for c in "abc"]
    files = [(p, k, 5, 5, rnd.choice([None, None, 3])) for k, p in enumerate(names) if rnd.random() < 0.5]
    out = []
    for b in range(n):
        events = []
        for k in range(15):
            event = rnd.choice(["MOVE", "UPSERT", "DELETE"])
            events.append((b * 100 + k, b * 100 + k, rnd.choice(names), rnd.choice(names) if event == "MOVE" else None, event, rnd.choice([None, k]), k))
        out.append(events)
    return files, out


def test_batches_replays_and_compaction(spark, tmp_path):
    files, events = batches(1, 4)
    log = InventoryLog(spark, f"{tmp_path}/log", buckets=4, share=1.0, least=8)
    log.create(spark.createDataFrame(files, FILES))
    assert rows(log) == {p: (i, s, m, d) for p, i, s, m, d in files}
    held, compacted = files, False
    for k, batch in enumerate(events):
        frame = spark.createDataFrame(batch, EVENTS)
        assert apply_batch(log, frame, k) is not None
        net, _ = one_by_one(held, batch)
        held = [(p, *r[:4]) for p, r in net.items()]
        assert rows(log) == {p: (i, s, m, d) for p, i, s, m, d in held}
        compacted |= any(log.last().upto.values())
    assert compacted and apply_batch(log, frame, k) is None
    log.vacuum(1)
    assert rows(log) == {p: (i, s, m, d) for p, i, s, m, d in held}
    assert len(os.listdir(f"{tmp_path}/log/commits")) - sum(n.endswith(".crc") for n in os.listdir(f"{tmp_path}/log/commits")) == 1


def test_a_batch_that_breaks_off_counts_for_nothing_and_is_tried_again(spark, tmp_path, monkeypatch):
    files, (batch, _) = batches(2, 2)
    log = InventoryLog(spark, f"{tmp_path}/log", buckets=4, share=0.1, least=1)
    log.create(spark.createDataFrame(files, FILES))
    before = rows(log)
    frame = spark.createDataFrame(batch, EVENTS)
    with monkeypatch.context() as m:
        m.setattr(InventoryLog, "_commit", lambda self, commit: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            apply_batch(log, frame, 0)
    assert rows(log) == before
    apply_batch(log, frame, 0)
    assert rows(log) == {p: r[:4] for p, r in one_by_one(files, batch)[0].items()}


def test_bytes_written_follow_the_batch_not_the_inventory(spark, tmp_path):
    written = []
    for n in (100, 20_000):
        log = InventoryLog(spark, f"{tmp_path}/{n}", buckets=8)
        log.create(spark.range(n).selectExpr("concat('/d/', id) as path", "id as file_id", "id as size_bytes", "id as modified_at_fs", "cast(null as long) as deleted_epoch"))
        before = size(f"{tmp_path}/{n}")
        apply_batch(log, spark.createDataFrame([(1, 1, "/d/1", None, "UPSERT", 9, 9), (2, 2, "/x", "/d/2", "MOVE", 9, 9)], EVENTS), 0)
        written.append(size(f"{tmp_path}/{n}") - before)
    assert written[1] < 1.3 * written[0] < 40_000


def test_stream_into_the_log(spark, tmp_path):
    columns = "event_id long, event string, path string, old_path string, stream string, size_bytes long, mtime long, ts long, session_id long"
    log = InventoryLog(spark, f"{tmp_path}/log", buckets=4)
    log.create(spark.createDataFrame([("/a", 1, 5, 5, None)], FILES))
    for k, part in enumerate(([(1, "UPSERT", "/a", None, "s", 9, 9, 1, 1), (2, "CREATE", "/n", None, "s", 3, 3, 2, 1), (4, "NOPE", "m", None, "s", 3, 3, None, 1)], [(5, "MOVE", "/b", "/a", "s", 9, 9, 5, 1), (6, "DELETE", "/n", None, "s", None, None, 6, 1), (7, "CREATE", "/n", None, "s", 4, 4, 7, 1)])):
        spark.createDataFrame(part, columns).coalesce(1).write.parquet(f"{tmp_path}/src/b{k}")
        stream = spark.readStream.schema(jobs.EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/src")
        sink = ingest_into_log(log, f"{tmp_path}/dead", f"{tmp_path}/audit", jobs.split_valid)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert rows(log) == {"/b": (1, 9, 9, None), "/n": (None, 4, 4, None)}
    told = spark.read.parquet(f"{tmp_path}/audit").orderBy("ts").collect()
    assert [(r.path, r.mutation) for r in told] == [("/a", "MODIFIED"), ("/n", "CREATED"), ("/b", "RENAMED"), ("/n", "DELETED"), ("/n", "RESTORED")]
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 1


def test_empty_log_and_odd_rows(spark, tmp_path):
    log = InventoryLog(spark, f"{tmp_path}/log")
    assert log.read().count() == 0 and log.last() is None
    with pytest.raises(ValueError, match="no inventory"):
        log.apply(history.net_rows(history.fold(spark.createDataFrame([], FILES), spark.createDataFrame([], EVENTS)), gone=True), 0)
    log.create(spark.createDataFrame([(None, 1, 1, 1, None)], FILES))
    assert log.read().count() == 0
    apply_batch(log, spark.createDataFrame([(1, 1, None, "/a", "MOVE", 1, 1)], EVENTS), 0)
    assert log.read().count() == 0 and log.last().batch == 0
    with pytest.raises(ValueError, match="already"):
        log.create(spark.createDataFrame([], FILES))

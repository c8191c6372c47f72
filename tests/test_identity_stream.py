"""Identity of arrivals as a stream against the batch form, and against sightings taken one by one."""

import random

from foliant.operators import ingest
from foliant.streaming import identity

WAIT = 20


def stream(spark, folder, known, parts):
    known = spark.createDataFrame(known, identity.SIGHTINGS).drop("event")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, identity.SIGHTINGS).coalesce(1).write.parquet(f"{folder}/src/b{k}")
        source = spark.readStream.schema(identity.SIGHTINGS).option("recursiveFileLookup", "true").parquet(f"{folder}/src")
        decided = identity.identity_stream(source, WAIT, "200 seconds", known)
        decided.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(f"{folder}/out")


#: An event far ahead moves the watermark over all others; timers fire in the batch after it.
END = [[("KNOWN", "/end", 0, 9, 9, 1, 1, "x", ts)] for ts in (10_000, 20_000)]


def scenario(seed, inodes):
    rnd = random.Random(seed)
    known, arrivals, vanished = [], [], []
    for inode in range(inodes):
        for k in range(rnd.randint(0, 3)):
            path = f"/old/{inode}/{k}"
            known.append(("KNOWN", path, inode * 10 + k, 1, inode, 5, 7, "h", 0))
            if rnd.random() < 0.6:
                vanished.append(("VANISHED", path, None, 1, inode, None, None, None, rnd.randint(90, 115)))
        if rnd.random() < 0.9:
            arrivals.append(("ARRIVED", f"/new/{inode}", None, 1, inode, rnd.choice([5, 6]), rnd.choice([7, 8]), rnd.choice(["h", "g", None]), 100))
    return known, arrivals, vanished


def test_equals_the_batch_form_in_any_order(spark, tmp_path):
    known, arrivals, vanished = scenario(4, 60)
    events = arrivals + vanished
    random.Random(1).shuffle(events)
    got = stream(spark, tmp_path, known, [events[::3], events[1::3], events[2::3], *END]).drop("ts")
    gone = {r[1] for r in vanished}
    names = "event string, path string, file_id long, filesystem_device long, inode long, size_bytes long, modified_at_fs long, hash_content string, ts long, deleted_epoch long"
    files = spark.createDataFrame([(*r, None) for r in known], names)
    here = spark.createDataFrame([(r[1],) for r in known if r[1] not in gone], "path string")
    want = ingest.identity_match(spark.createDataFrame(arrivals, identity.SIGHTINGS), files, here)
    columns = ["path", "candidates", "event", "level", "score", "candidate_id"]
    got = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert got == sorted(map(tuple, want.select(columns).collect()), key=str)
    assert {r[2] for r in got} == {"HARDLINK_DETECTED", "IDENTITY_AMBIGUOUS", "IDENTITY_MATCHED", "IDENTITY_REJECTED"}


def test_a_file_that_moves_on_keeps_its_id_and_old_state_goes(spark, tmp_path):
    def arrive(path, ts):
        return ("ARRIVED", path, None, 1, 1, 5, 7, "h", ts)

    def vanish(path, ts):
        return ("VANISHED", path, None, 1, 1, None, None, None, ts)

    known = [("KNOWN", "/a", 1, 1, 1, 5, 7, "h", 0)]
    first = [vanish("/a", 100), arrive("/b", 101)]
    second = [arrive("/c", 201), vanish("/b", 205), arrive("/d", 400), vanish("/c", 430)]
    got = stream(spark, tmp_path, known, [first, second, [vanish("/c", 500), vanish("/d", 501)], *END]).orderBy("ts").collect()
    # /c is still there when /d is decided; what vanished by 205 is in time for the arrival at 201.
    assert [(r.path, r.event, r.candidate_id) for r in got] == [("/b", "IDENTITY_MATCHED", 1), ("/c", "IDENTITY_MATCHED", 1), ("/d", "HARDLINK_DETECTED", 1)]
    left = spark.read.format("statestore").option("stateVarName", "known").load(f"{tmp_path}/cp").count()
    assert left == 1  # /end: the inode without paths has none
    for name in ("gone", "waiting"):
        assert spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/cp").count() == 0

from foliant.streaming import jobs

COLUMNS = "event_id long, event string, path string, old_path string, stream string, size_bytes long, mtime long, ts long, session_id long"


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, df, sink, checkpoint, mode="append"):
    query = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_debounce_over_batches(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for k, times in enumerate(((1000, 1001, 1002), (1003, 1005))):
        write(spark, src, f"b{k}", [(t, "UPSERT", "/a", None, "s", 1, 1, t, 1) for t in times])
        stream = spark.readStream.schema(jobs.EVENTS).option("recursiveFileLookup", "true").parquet(src)
        run(spark, jobs.debounced(stream, 2), out, cp)
    assert sorted(r.ts for r in spark.read.parquet(out).collect()) == [1000, 1002, 1005]


def test_missing_counter(spark, tmp_path):
    rows = [("/a", 1, True, True), ("/a", 2, False, True), ("/a", 3, False, False), ("/a", 4, False, True), ("/b", 1, False, True), ("/b", 2, True, True)]
    spark.createDataFrame(rows, "path string, sweep long, seen boolean, full boolean").write.parquet(f"{tmp_path}/src")
    stream = spark.readStream.schema("path string, sweep long, seen boolean, full boolean").parquet(f"{tmp_path}/src")
    run(spark, jobs.missing_deletes(stream, 2), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("/a", 4, "DELETE")]


def test_ingest_replays_harmlessly_and_sets_bad_records_aside(spark, tmp_path):
    inventory, dead, audit = (f"{tmp_path}/{x}" for x in ("inventory", "dead", "audit"))
    spark.createDataFrame([("/a", 1, 5, 5, None)], "path string, file_id long, size_bytes long, modified_at_fs long, deleted_epoch long").write.parquet(f"{inventory}/v=0")
    rows = [(1, "UPSERT", "/a", None, "s", 9, 9, 1, 1), (2, "CREATE", "/n", None, "s", 3, 3, 2, 1), (3, "MOVE", "/m", None, "s", 3, 3, 3, 1), (4, "NOPE", "m", None, "s", 3, 3, None, 1)]
    batch = spark.createDataFrame(rows, COLUMNS)
    apply = jobs.ingest_batches(inventory, dead, audit)
    for _ in range(2):
        apply(batch, 0)
    assert sorted((r.path, r.size_bytes) for r in spark.read.parquet(f"{inventory}/v=1").collect()) == [("/a", 9), ("/n", 3)]
    letters = jobs.newest_dead_letters(spark.read.parquet(f"{dead}/batch=0")).collect()
    assert [(r.event_id, r.error) for r in letters] == [(3, "old_path"), (4, "event,path,ts")]
    assert spark.read.parquet(f"{audit}/batch=0").count() == 2


def test_windowed_and_session_counts(spark, tmp_path):
    write(spark, f"{tmp_path}/src", "b", [(i, "UPSERT", "/a", None, "s", None if i == 2 else 1, 1, i * 1800, i // 4) for i in range(10)])
    stream = spark.readStream.schema(jobs.EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/src")
    run(spark, jobs.hourly_counts(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    counts = [r.events for r in spark.read.parquet(f"{tmp_path}/out").orderBy("hour").collect()]
    assert counts and set(counts) == {2}
    batch = spark.read.schema(jobs.EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/src")
    assert sorted((r.session_id, r.discovered, r.enqueued) for r in jobs.session_counts(batch).collect()) == [(0, 4, 3), (1, 4, 4), (2, 2, 2)]


def test_debounce_forgets_a_key_once_the_watermark_has_passed(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for k, times in enumerate(((1000, 1001), (9000,), (20000,))):
        write(spark, src, f"b{k}", [(t, "UPSERT", f"/p{k}", None, "s", 1, 1, t, 1) for t in times])
        stream = spark.readStream.schema(jobs.EVENTS).option("recursiveFileLookup", "true").parquet(src)
        run(spark, jobs.debounced(stream, 2, "10 seconds"), out, cp)
    assert sorted(r.ts for r in spark.read.parquet(out).collect()) == [1000, 9000, 20000]
    assert spark.read.format("statestore").option("stateVarName", "last").load(cp).count() == 1

"""Small fixtures for each family; whole-table results are held against SQL in test_queries.py."""

import difflib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.common import uuid5
from foliant.operators import classify, golden, ingest, inventory, learning, migration, retrieval, temporal, workset
from foliant.sources import extract, listing


def paths(spark, *rows):
    return spark.createDataFrame(rows, "file_id long, path string, size_bytes long, content_sha256 string, deleted_epoch long")


def test_clean_source_beats_backup_and_ties_go_to_the_shorter_path(spark):
    files = paths(spark, (1, "/d/backup/a.pdf", 5, "x", None), (2, "/d/work/a.pdf", 5, "x", None), (3, "/d/bb.pdf", 5, "y", None), (4, "/d/a.pdf", 5, "y", None), (5, "/d/empty.pdf", 0, "z", None), (6, "/d/only copy(1).pdf", 5, "w", None))
    found = {r.content_sha256: r for r in golden.selection(files).collect()}
    assert (found["x"].golden_file_id, found["x"].margin, found["x"].confidence) == (2, 8, "high")
    assert (found["y"].golden_file_id, found["y"].status, found["y"].comparison) == (4, "golden_selected_tiebreak", "low")
    assert found["w"].status == "single_source" and found["w"].comparison == "not_applicable" and "z" not in found
    scores = {r.file_id: r.score for r in golden.candidates(files).collect()}
    assert scores[1] == 92 and scores[6] == 100 - 12 - 6
    ranks = sorted((r.content_sha256, r["rank"]) for r in golden.rank_members(files).collect())
    assert ranks == [("w", 1), ("x", 1), ("x", 2), ("y", 1), ("y", 2)]


def test_missing_files_go_at_the_threshold_and_only_in_full_sweeps(spark):
    state = spark.createDataFrame([("/r/a", "1:1:1", 0), ("/r/b", "1:1:1", 1), ("/x/c", "1:1:1", 1)], "path string, signature string, missing_count int")
    now = spark.createDataFrame([("/r/d", 2, 2, 2, True), ("/r/e", 2, 2, 2, False)], "path string, mtime long, size_bytes long, inode long, readable boolean")
    full = {r.path: (r.missing_count, r.action) for r in ingest.reconcile_missing(state, now, "/r", 2).collect()}
    assert full == {"/r/a": (1, "KEEP"), "/r/b": (2, "DELETE"), "/x/c": (1, "KEEP"), "/r/d": (0, "KEEP"), "/r/e": (0, "KEEP")}
    part = ingest.reconcile_missing(state, now, "/r", 2, full=False)
    assert part.where("action = 'DELETE'").count() == 0
    assert [r.path for r in ingest.detect_changes(state, now).collect()] == ["/r/d"]


def test_debounce_keeps_what_follows_an_accepted_event(spark):
    events = spark.createDataFrame([("U", "/a", t) for t in (0, 1, 2, 3, 5)], "event string, path string, ts long")
    assert sorted(r.ts for r in ingest.debounce(events, 2).collect()) == [0, 2, 5]


def test_hard_links_and_ambiguity_are_not_renames(spark):
    columns = "file_id long, path string, filesystem_device long, inode long, size_bytes long, modified_at_fs long, hash_content string, deleted_epoch long"
    known = spark.createDataFrame([(1, "/old/a", 1, 10, 5, 7, "h", None), (2, "/old/b", 1, 11, 5, 7, "h", None), (3, "/old/c", 1, 12, 5, 7, "h", None), (4, "/old/d", 1, 12, 5, 7, "h", None), (5, "/old/e", 1, 13, 9, 9, "k", None)], columns)
    new = spark.createDataFrame([(None, "/n/a", 1, 10, 5, 7, "h", None), (None, "/n/b", 1, 11, 5, 7, "h", None), (None, "/n/c", 1, 12, 5, 7, "h", None), (None, "/n/e", 1, 13, 5, 7, "h", None), (None, "/n/z", 1, 99, 5, 7, "h", None)], columns)
    here = spark.createDataFrame([("/old/b",)], "path string")
    found = {r.path: (r.event, r.level, r.score) for r in ingest.identity_match(new, known, here).collect()}
    assert found == {"/n/a": ("IDENTITY_MATCHED", "high", 100), "/n/b": ("HARDLINK_DETECTED", "ambiguous", None), "/n/c": ("IDENTITY_AMBIGUOUS", "ambiguous", None), "/n/e": ("IDENTITY_REJECTED", "low", 50)}


INVENTORY = "path string, file_id long, size_bytes long, modified_at_fs long, deleted_epoch long"
BATCH = "event_id long, ts long, path string, old_path string, event string, size_bytes long, mtime long"


def applied(spark, files, *batches):
    """Rows and mutations after each batch."""
    held, out = spark.createDataFrame(files, INVENTORY), []
    for batch in batches:
        rows = ingest.apply_events(held, spark.createDataFrame(batch, BATCH)).collect()
        out.append({r.path: (r.file_id, r.deleted_epoch, r.mutation) for r in rows})
        assert len(out[-1]) == len(rows)
        held = spark.createDataFrame([(r.path, r.file_id, r.size_bytes, r.modified_at_fs, r.deleted_epoch) for r in rows], INVENTORY)
    return out


def test_created_rows_live_on_in_later_batches(spark):
    one, two, three, four = applied(
        spark,
        [("/a", 1, 5, 5, None)],
        [(1, 1, "/new", None, "CREATE", 8, 8)],
        [(2, 2, "/a", None, "UPSERT", 6, 6)],
        [(3, 3, "/new", None, "DELETE", None, None), (4, 3, "/never", None, "DELETE", None, None)],
        [(5, 4, "/new", None, "UPSERT", 9, 9)],
    )
    assert one == {"/a": (1, None, None), "/new": (None, None, "CREATED")}
    assert two == {"/a": (1, None, "MODIFIED"), "/new": (None, None, None)}
    assert three == {"/a": (1, None, None), "/new": (None, 3, "DELETED")}
    assert four == {"/a": (1, None, None), "/new": (None, None, "RESTORED")}


def test_moves_take_their_row_along(spark):
    files = [(f"/d/{c}", i, 5, 5, None) for i, c in enumerate("abcdef", 1)] + [("/d/gone", 9, 5, 5, 7)]
    found = applied(
        spark,
        files,
        [
            (1, 1, "/d/a", None, "UPSERT", 6, 6),  # void: the file moves away afterwards
            (2, 2, "/d/a2", "/d/a", "MOVE", 6, 6),
            (3, 3, "/e/b", "/d/b", "MOVE", 5, 5),
            (4, 4, "/d/b", None, "CREATE", 1, 1),  # the path is used again
            (5, 5, "/x/c1", "/d/c", "MOVE", 5, 5),
            (6, 6, "/x/c2", "/x/c1", "MOVE", 5, 5),  # moves in a row
            (7, 7, "/d/e", "/d/d", "MOVE", 5, 5),  # onto a known file
            (8, 8, "/n/z", "/d/unknown", "MOVE", 5, 5),
            (9, 9, "/n/y", "/d/gone", "MOVE", 5, 5),
            (10, 10, "/n/f", "/d/f", "MOVE", 5, 5),
            (11, 11, "/d/f", "/n/f", "MOVE", 5, 5),  # there and back
        ],
    )[0]
    assert found == {
        "/d/a2": (1, None, "RENAMED"), "/e/b": (2, None, "MOVED"), "/d/b": (None, None, "CREATED"), "/x/c2": (3, None, "MOVED"), "/d/d": (4, 7, "DELETED"), "/d/e": (5, None, "MODIFIED"),
        "/n/z": (None, None, "CREATED"), "/n/y": (None, None, "CREATED"), "/d/gone": (9, 7, None), "/d/f": (6, None, "MODIFIED"),
    }


def test_deep_trees_and_cycles_of_folders(spark):
    chain = [(i, f"/f{i}", i - 1 if i > 1 else None) for i in range(1, 41)]
    odd = [(100, "/c1", 101), (101, "/c2", 100), (102, "/self", 102), (103, "/lost", 999), (104, "/a/@x", 1), (105, "/a/@x/y", 104), (106, "/f40/@eaDir", 40)]
    folders = spark.createDataFrame(chain + odd, "id long, path string, parent_id long")
    files = spark.createDataFrame([(i, i, "a.txt") for i in [*range(1, 41), 100, 102, 103, 105]], "file_id long, folder_id long, filename string")
    metadata = spark.createDataFrame([(i, i) for i in range(1, 110)], "metadata_id long, file_id long")
    kept_files, kept_folders, kept_metadata = inventory.cleanup(files, folders, metadata)
    assert sorted(r.id for r in kept_folders.collect()) == sorted(range(1, 41))
    assert kept_files.count() == 40 and kept_metadata.count() == 40


def test_chunks_of_short_long_and_empty_texts(spark):
    for n in (0, 1, 75, 76, 600, 601, 675, 676, 1125, 1200, 1201, 3000):
        words = [f"w{i}" for i in range(n)]
        got = {r.ordinal: r.passage.split() for r in retrieval.chunk(spark.createDataFrame([(1, "  " + " \n".join(words))], "doc_id long, text string")).collect()}
        want, at = {}, 0
        while at < n and (at == 0 or n - at > 75):
            want[len(want)] = words[at : at + 600]
            at += 525
        assert got == want, n


def test_events_upsert_restore_and_delete(spark):
    files = spark.createDataFrame([("/a", 1, 5, 5, None), ("/b", 2, 5, 5, 99), ("/c", 3, 5, 5, None)], "path string, file_id long, size_bytes long, modified_at_fs long, deleted_epoch long")
    events = spark.createDataFrame([(1, 1, "/a", "UPSERT", 6, 6), (2, 2, "/a", "DELETE", None, None), (3, 3, "/b", "UPSERT", 7, 7), (4, 4, "/n", "CREATE", 8, 8), (5, 5, "/q", "DELETE", None, None)], "event_id long, ts long, path string, event string, size_bytes long, mtime long")
    after = {r.path: (r.size_bytes, r.deleted_epoch, r.mutation) for r in ingest.apply_events(files, events).collect()}
    assert after == {"/a": (5, 2, "DELETED"), "/b": (7, None, "RESTORED"), "/c": (5, None, None), "/n": (8, None, "CREATED")}
    again = ingest.apply_events(ingest.apply_events(files, events).drop("mutation", "old_path"), events)
    assert {r.path: r.size_bytes for r in again.collect()} == {p: s for p, (s, _, _) in after.items()}


def test_exact_time_beats_date_only_on_one_day(spark):
    evidence = spark.createDataFrame([(1, 10, "modified", "office", "high", 86400 * 100, "absent"), (1, 11, "modified", "pdf_xmp", "low", 86400 * 100 + 50, "utc"), (1, 12, "modified", "office", "high", 86400 * 900, "utc"), (1, 13, "created", "fax", "high", 5, "utc")], "file_id long, evidence_id long, date_type string, source_type string, confidence string, value_epoch long, timezone_status string")
    found = temporal.canonical(evidence, 86400 * 800).collect()
    assert [(r.date_type, r.evidence_id) for r in found] == [("modified", 11)]


def test_pdf_dates_on_one_day_are_equivalent(spark):
    files = spark.createDataFrame([(1, "s", None), (2, "t", None)], "file_id long, content_sha256 string, deleted_epoch long")
    row = "evidence_id long, file_id long, content_sha256 string, scope string, date_type string, source_type string, confidence string, value_epoch long, timezone_status string, observed_epoch long"
    evidence = spark.createDataFrame([(1, 9, "s", "content", "created", "pdf_info", "high", 86400 * 9 + 70, "utc", 1), (2, 9, "s", "content", "created", "pdf_xmp", "high", 86400 * 9, "absent", 1), (3, 2, "t", "file", "created", "pdf_info", "high", 100, "utc", 1), (4, 2, "t", "file", "created", "office", "high", 90000, "utc", 1), (5, 1, "t", "file", "created", "office", "high", 1, "utc", 1)], row)
    found = {r.for_file: (r.status, r.reason) for r in temporal.resolution(files, evidence).collect()}
    assert found == {1: ("equivalent", "equivalent_day"), 2: ("material_conflict", "materially_different")}


def test_policies_hold_from_and_to(spark):
    rows = spark.createDataFrame([("p", "e", 1, 0, 100), ("p", "e", 2, 50, None), ("p", "e", 3, 500, None)], "policy_code string, environment string, policy_version int, effective_from long, effective_to long")
    assert workset.current_policies(rows, 60).first().policy_version == 2
    assert workset.current_policies(rows, 40).first().policy_version == 1


def test_no_two_contents_share_a_target(spark):
    plan = spark.createDataFrame([(1, "/T/a.pdf", "h1aaaaaaa"), (2, "/t/A.pdf", "h2bbbbbbb"), (3, "/t/b.pdf", "h3"), (4, "/t/c", "h4")], "file_id long, target string, hash_content string")
    taken = spark.createDataFrame([("/t/b.pdf",)], "path string")
    found = {r.file_id: (r.target, r.collision) for r in migration.resolve_collisions(plan, taken).collect()}
    assert found == {1: ("/T/a__h1aaaaaa.pdf", "resolved_hash_suffix"), 2: ("/t/A__h2bbbbbb.pdf", "resolved_hash_suffix"), 3: ("/t/b.pdf", "target_path_exists"), 4: ("/t/c", "clear")}


def reviews(spark, *rows):
    return spark.createDataFrame(rows, "review_id long, file_id long, review_type string, decision string, category string, family string, source_family string, privacy string, target_path string, filename string, path string, created_epoch long")


def test_conflicting_reviews_are_not_reused_and_the_latest_counts(spark):
    said = reviews(spark, (1, 1, "target", "accepted", "work", "f", "s", None, "/t/w/a", "planning (1).pdf", "/a/p", 1), (2, 2, "target", "accepted", "home", "f", "s", None, "/t/h/a", "planning (2).pdf", "/b/p", 2), (3, 3, "target", "rejected", "home", "f", "s", None, None, "minutes.pdf", "/b/m", 2), (4, 3, "target", "accepted", "work", "f", "s", None, "/t/w/m", "minutes.pdf", "/b/m", 3))
    names = ["Planning 2023.pdf", "minutes - copy.pdf", "minutes.docx", "other.pdf", "minutes.txt", "minutes_20240101 NL.xlsx"]
    files = spark.createDataFrame([(10 + i, n, None) for i, n in enumerate(names)] + [(3, "minutes.pdf", None)], "file_id long, filename string, deleted_epoch long")
    found = {r.file_id: (r.status, r.category, r.score) for r in learning.similar_proposals(files, said).collect()}
    assert found == {10: ("conflict", None, 0.95), 11: ("proposed", "work", 0.95), 12: ("proposed", "work", 1.0), 15: ("proposed", "work", 0.95)}
    assert {r.review_id for r in learning.latest_reviews(said).collect()} == {1, 2, 4}


def test_close_paths_differ_in_one_segment(spark):
    entered = spark.createDataFrame([(1, "/t/Reprot/a.pdf"), (2, "/t/REPORT/b.pdf"), (3, "/x/y/z.pdf")], "file_id long, path string")
    known = spark.createDataFrame([("/t/Report/a.pdf",), ("/t/Report/b.pdf",), ("/t/Q/z.pdf",)], "path string")
    found = {r.file_id: (r.suggestion, r.similarity) for r in classify.close_paths(entered, known, 0.8).collect()}
    assert found[1][0] == "/t/Report/a.pdf" and found[2] == ("/t/Report/b.pdf", 1.0) and 3 not in found


def test_chunks_join_back_to_the_text(spark):
    for n in (0, 1, 75, 600, 601, 1125, 1126, 1300):
        docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
        words = [r.passage.split() for r in retrieval.chunk(docs).orderBy("ordinal").collect()]
        joined = words[0] + [w for c in words[1:] for w in c[75:]] if words else []
        assert joined == [f"w{i}" for i in range(n)]
        assert retrieval.chunk_plan(docs).first().chunks == len(words)


def test_ideal_ranking_scores_one(spark):
    judged = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 5, 2)], "query_id long, file_id long, grade int")
    results = spark.createDataFrame([("good", 1, 1, 1), ("good", 1, 2, 2), ("good", 2, 5, 1), ("bad", 1, 9, 1), ("bad", 1, 1, 2)], "ranking string, query_id long, file_id long, rank int")
    found = {r.ranking: r for r in retrieval.evaluate(results, judged).collect()}
    assert (found["good"].hit_1, found["good"].mrr, found["good"].ndcg_10) == (1.0, 1.0, 1.0)
    assert (found["bad"].hit_1, found["bad"].mrr) == (0.0, 0.25) and found["bad"].ndcg_10 < 0.5


def test_zero_vectors_and_blocks(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(6)] + [(9, 0, [0.0, 0.0])], "file_id long, ordinal long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(7, [0.0, 0.0])], "query_id long, embedding array<double>")
    whole = {(r.query_id, r["rank"]): r.file_id for r in retrieval.top_files(queries, chunks, 3).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert {(r.query_id, r["rank"]): r.file_id for r in retrieval.top_files(queries, chunks, 3).collect()} == whole
    assert whole[3, 1] == 3 and len(whole) == 15


def test_uuid5_is_pythons(spark):
    import uuid

    got = spark.range(3).select(uuid5(str(uuid.NAMESPACE_URL), F.concat(F.lit("é"), F.col("id"))).alias("u")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"é{i}")) for i in range(3)]


def test_cleanup_takes_descendants(spark):
    folders = spark.createDataFrame([(1, "/d", None), (2, "/d/@eaDir", 1), (3, "/d/@eaDir/x", 2), (4, "/d/ok", 1), (5, "/lost", 77)], "id long, path string, parent_id long")
    files = spark.createDataFrame([(1, 4, "a.pdf"), (2, 3, "a.pdf"), (3, 4, "._a"), (4, 5, "a.pdf"), (5, 4, "x.tmp"), (6, 4, "._")], "file_id long, folder_id long, filename string")
    metadata = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "metadata_id long, file_id long")
    kept = inventory.cleanup(files, folders, metadata)
    assert [sorted(r[0] for r in df.select(df.columns[0] if "metadata_id" not in df.columns else "metadata_id").collect()) for df in (kept[1].select("id"), kept[0].select("file_id"), kept[2].select("metadata_id"))] == [[1, 4], [1], [1]]


def test_delimited_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a;b"), ("2", "é,")], "id string, name string")
    listing.write_delimited(df.coalesce(1), f"{tmp_path}/out")
    assert sorted(map(tuple, listing.read_delimited(spark, f"{tmp_path}/out").collect())) == [("1", "a;b"), ("2", "é,")]
    (tmp_path / "c.csv").write_text("id,name\n1,x\n", encoding="utf-8")
    assert listing.read_delimited(spark, str(tmp_path / "c.csv")).columns == ["id", "name"]
    (tmp_path / "m.json").write_text('{"version": "v1",\n "files": [{"file_id": 3, "approval": "approved", "path": "/a"}]}')
    assert tuple(listing.read_manifest(spark, str(tmp_path / "m.json")).first()) == ("v1", 3, "approved", "/a")


def test_files_are_listed_and_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("één twee".encode("cp1252"))
    (tmp_path / "sub" / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.txt").write_bytes(b"")
    office = io.BytesIO()
    with zipfile.ZipFile(office, "w") as z:
        z.writestr("word/document.xml", '<d xmlns:w="w"><w:t>hello</w:t><w:t>there you</w:t></d>')
        z.writestr("docProps/core.xml", '<c xmlns:dcterms="http://purl.org/dc/terms/"><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></c>')
    (tmp_path / "c.docx").write_bytes(office.getvalue())
    (tmp_path / "d.docx").write_bytes(b"no zip")
    assert listing.file_listing(spark, str(tmp_path)).count() == 4
    files = extract.read_files(spark, str(tmp_path))
    stats = {r.path.rsplit("/", 1)[1]: (r.words, r.status) for r in extract.text_stats(files).collect()}
    assert stats == {"a.txt": (2, "extracted"), "b.pdf": (0, "needs_ocr"), "c.docx": (3, "extracted"), "d.docx": (0, "error")}
    assert [(r.date_type, r.raw) for r in extract.office_dates(files).collect()] == [("created", "2024-01-02T03:04:05Z")]


def test_relational_tables_are_read_in_ranges(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("id as file_id", "concat('n', id) as name")
    listing.write_table(rows, url, "files", parts=2, options=options)
    found = listing.read_table(spark, url, "files", "file_id", parts=4, options=options)
    assert found.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in found.collect()) == [(i, f"n{i}") for i in range(100)]
    assert listing.read_table(spark, url, "files", options=options).count() == 100


def test_every_slide_and_inline_string_is_read():
    def archive(parts):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return held.getvalue()

    slides = archive({f"ppt/slides/slide{i}.xml": f"<a xmlns:a='a'><a:t>slide {i}</a:t></a>" for i in (10, 2, 1)})
    assert extract.text_of("x.pptx", slides) == ("slide 1 slide 2 slide 10", "extracted")
    sheets = archive({"xl/sharedStrings.xml": "<s><si><t>shared</t></si></s>", "xl/worksheets/sheet1.xml": "<w><c><is><t>inline</t></is></c><c><v>5</v></c></w>"})
    assert extract.text_of("x.xlsx", sheets) == ("shared inline", "extracted")
    assert extract.text_of("x.docx", archive({"other.xml": "<a/>"})) == (None, "error") and extract.text_of("x.xlsx", archive({"other.xml": "<a/>"})) == ("", "no_text")


def test_neighbours_find_nine_of_ten_and_all_with_all_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = centres[rng.integers(0, 30, 1500)] + 0.6 * rng.normal(size=(1500, 16))
    chunks = spark.createDataFrame([(i // 2, i % 2, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, 0, [0.0] * 16)], "file_id long, ordinal int, embedding array<double>")
    queries = chunks.where("file_id % 10 = 0")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    score = np.round(unit @ unit.T, 6)
    want = {}
    for q in range(0, 750, 10):
        best = {f: max(score[a, b] for a in (2 * q, 2 * q + 1) for b in (2 * f, 2 * f + 1)) for f in range(750) if f != q}
        want[q] = sorted(best, key=lambda f: (-best[f], f))[:5]
    for probes, least in ((32, 1.0), (10, 0.9)):
        got = {}
        for r in retrieval.neighbours(queries, chunks, 5, cells=32, probes=probes).collect():
            got.setdefault(r.file_id, set()).add(r.other_id)
        assert sum(len(got[q] & set(w)) for q, w in want.items()) >= least * sum(map(len, want.values()))
    assert retrieval.neighbours(queries, chunks.limit(0), 5).count() == 0


def test_close_paths_equal_brute_force(spark):
    rnd = random.Random(3)
    names = ["alpha", "alphas", "Alpha", "beta-one", "beta_one", "gamma", "gamme"]
    known = sorted({"/" + "/".join(rnd.choice(names) for _ in range(rnd.randint(1, 4))) for _ in range(80)})
    entered = [(i, "/" + "/".join(rnd.choice([*names, "delta"]) for _ in range(rnd.randint(1, 4)))) for i in range(60)]
    want = {}
    for i, path in entered:
        found = []
        for other in known:
            a, b = path.split("/"), other.split("/")
            differ = [k for k in range(len(a)) if a[k] != b[k]] if len(a) == len(b) else []
            if len(differ) == 1:
                x, y = a[differ[0]].lower(), b[differ[0]].lower()
                ratio = 2.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()
                if ratio >= 0.84:
                    found.append((-ratio, other))
        if found:
            want[i] = (min(found)[1], min(1.0, -min(found)[0]))
    got = classify.close_paths(spark.createDataFrame(entered, "file_id long, path string"), spark.createDataFrame([(k,) for k in known], "path string"))
    assert {r.file_id: (r.suggestion, r.similarity) for r in got.collect()} == want and len(want) > 5


@pytest.mark.parametrize("limit", [0.8, 0.84])
def test_similar_names_of_a_large_folder(spark, limit):
    """All pairs that the ratio lets pass are among those that are compared, and these are few."""
    rnd = random.Random(8)
    parts = ["ber", "icht", "vor", "trag", "re", "ch", "nung", "plan", "ung", "no", "tiz", "jahr", "ab", "schluss", "an", "ge", "bot", "q", "x", "yz"]
    names = {"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(900)}
    names |= {n[:k] + rnd.choice(["", "a", "bc"]) + n[k + 1 :] for n in sorted(names)[:200] for k in [rnd.randrange(len(n))]} | {"a", "ab", "ba", "abc", "abd", "aa" * 60, "aa" * 59 + "b"}
    rows = spark.createDataFrame([("p", n) for n in names], "place string, name string")
    found = {(r.name, r.other) for r in classify.similar_names(rows, rows, limit).collect()}
    def bound(a, b):
        m = difflib.SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= limit and m.quick_ratio() >= limit and m.ratio() >= limit
    want = {(a, b) for a in names for b in names if a != b and bound(a, b)}
    assert len(want) > 300 and want <= found and len(found) < 10 * len(names)


def test_a_hundred_thousand_queries_are_one_scan(spark):
    queries = spark.range(100_000).selectExpr("id as query_id", "transform(sequence(1, 8), i -> cast(sin(id * i) as float)) as embedding")
    chunks = spark.range(40).selectExpr("cast(id / 2 as long) as file_id", "id % 2 as ordinal", "transform(sequence(1, 8), i -> cast(cos(id * i) as float)) as embedding")
    found = retrieval.top_files(queries, chunks, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 40") == 1
    assert found.groupBy("query_id").count().where("count = 2").count() == 99_999  # the first query has no direction


def test_scans_and_blocks_of_any_size_find_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    vectors = [[rnd.choice([-1.0, 0.5, 0.0, 1.0]) for _ in range(3)] for _ in range(300)]
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:50])], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([(i // 4, i % 4, v) for i, v in enumerate(vectors)], "file_id long, ordinal long, embedding array<double>")
    want = sorted(map(tuple, retrieval.top_files(queries, chunks, 5).collect()))
    units = [np.array(v) / np.linalg.norm(v) if any(v) else None for v in vectors]
    for q in range(50):
        if units[q] is None:
            continue
        best = {}
        for i, u in enumerate(units):
            if u is not None:
                s = round(float(u @ units[q]), 6)
                best[i // 4] = min(best.get(i // 4, (9, 9)), (-s, i % 4))
        top = sorted((s, f, o) for f, (s, o) in best.items())[:5]
        assert [(f, o, -s, k + 1) for k, (s, f, o) in enumerate(top)] == [t[1:] for t in sorted((t for t in want if t[0] == q), key=lambda t: t[4])]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SENT_BYTES", 200)
    assert sorted(map(tuple, retrieval.top_files(queries, chunks, 5).collect())) == want


def test_a_task_compares_few_vectors_at_once(spark, monkeypatch):
    vectors = [(i // 3, i % 3, [float(i % 7), 1.0, float(i % 5)]) for i in range(400)]
    queries = spark.createDataFrame([(i, v[2]) for i, v in enumerate(vectors[:20])], "query_id long, embedding array<double>")
    chunks = spark.createDataFrame(vectors, "file_id long, ordinal long, embedding array<double>").coalesce(1)
    want = sorted(map(tuple, retrieval.top_files(queries, chunks, 4).collect()))
    monkeypatch.setattr(retrieval, "SCORES", 100)
    assert sorted(map(tuple, retrieval.top_files(queries, chunks, 4).collect())) == want


def test_private_patterns_have_plain_word_ends(spark):
    texts = ["hypotheek 5381 ueñta", "rente édhr x", "énl12abcd0123456789", "rente 2135\x0bnj", "bsn nr  123456789", "bsn\n123456789", "rente adhr x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id int, text string")
    found = rows.select("file_id", F.array_join(classify.content_signals(), ",").alias("s")).orderBy("file_id").collect()
    assert [r.s for r in found] == ["personal_financial_data", "personal_financial_data", "iban", "", "bsn", "", ""]
    named = rows.withColumns({"filename": F.lit("ébank.pdf"), "folder_path": F.lit("/x")}).where("file_id = 6")
    assert classify.privacy(named).first().privacy_terms == "bank"


def test_close_paths_of_a_large_folder_meet_no_other_names(spark, monkeypatch):
    def none(*_):
        raise AssertionError("names of a folder were joined by their character runs")

    monkeypatch.setattr(classify, "similar_names", none)
    known = spark.range(3000).selectExpr("concat('/data/report_', id, '.pdf') as path")
    entered = known.selectExpr("monotonically_increasing_id() as file_id", "replace(path, 'report', 'reprot') as path")
    got = classify.close_paths(entered, known).collect()
    assert len(got) == 3000 and all(r.suggestion == r.path.replace("reprot", "report") for r in got)


def test_close_paths_near_and_far_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 14)))
    base = [word() for _ in range(12)]

    def changed(s, times):
        for _ in range(times):
            k = rnd.randint(0, len(s))
            s = s[:k] + rnd.choice(["", "x", "b"]) + s[k + rnd.randint(0, 1) :]
        return s

    known = sorted({"/f/" + changed(rnd.choice(base), rnd.randint(0, 3)) for _ in range(120)} | {"/f/" + "long" * 12 + "ab"})
    entered = [(i, "/f/" + changed(rnd.choice(base), rnd.randint(0, 4))) for i in range(80)] + [(80, "/f/" + "long" * 12), (81, "/f/")]
    want = {}
    for i, path in entered:
        pairs = [(x, path[3:].lower()) for x in known if x != path]
        found = [(-(2.0 if x[3:].lower() == p else difflib.SequenceMatcher(None, p, x[3:].lower()).ratio()), x) for x, p in pairs]
        if found and min(found)[0] <= -0.84:
            want[i] = (min(found)[1], min(1.0, -min(found)[0]))
    got = classify.close_paths(spark.createDataFrame(entered, "file_id long, path string"), spark.createDataFrame([(k,) for k in known], "path string"))
    assert {r.file_id: (r.suggestion, r.similarity) for r in got.collect()} == want and len(want) > 20


def test_judgments_of_one_family_are_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tables this small would be one task
    families = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("b", 2), ("b", 2)], "family string, file_id long")
    grades = spark.createDataFrame([(q, "a", 2) for q in range(4)] + [(0, "b", 1), (1, "b", 2)], "query_id long, family string, grade int")
    over = spark.createDataFrame([(0, 2, 0, 1), (0, 2, 3, 2), (9, 5, 1, 1), (3, 7, None, 1)], "query_id long, file_id long, grade int, place long")
    good, conflicts = retrieval.expand_judgments(families, grades, over)
    want = {(q, f, 2, False) for q in range(4) for f in range(300)} - {(0, 1, 2, False), (0, 2, 2, False)} | {(0, 2, 3, True), (9, 5, 1, True)}
    assert sorted(map(tuple, good.collect())) == sorted(want) and [tuple(r) for r in conflicts.collect()] == [(0, 1)]
    files, of = retrieval.classes(families.where("family = 'a'"), "family")
    pairs = retrieval.each_file(files, of.join(grades, "family").drop("family"))
    tasks = pairs.select(F.spark_partition_id().alias("t")).distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1


def test_evaluation_by_classes_makes_no_pairs_and_equals_that_by_pairs(spark):
    rnd = random.Random(4)
    members = {(f, rnd.randint(0, 4)) for f in range(60) for _ in range(2)}
    grades = {(q, (q + k) % 5, 2 - k) for q in range(6) for k in (0, 1)}
    pairs = {}
    for q, label, grade in grades:
        for f, own in members:
            if own == label:
                pairs[q, f] = max(grade, pairs.get((q, f), 0))
    results = spark.createDataFrame([(r, q, f, k + 1) for r in ("x", "y") for q in range(7) for k, f in enumerate(rnd.sample(range(70), 10))], "ranking string, query_id long, file_id long, rank int")
    by_pairs = retrieval.evaluate(results, spark.createDataFrame([(*k, g) for k, g in pairs.items()], "query_id long, file_id long, grade int"))
    by_class = retrieval.evaluate_classes(results, spark.createDataFrame(sorted(members), "file_id long, label int"), spark.createDataFrame(sorted(grades), "query_id long, label int, grade int"), "label")
    assert sorted(map(tuple, by_class.collect())) == sorted(map(tuple, by_pairs.collect())) and by_class.count() == 2


def test_counts_of_a_file_hold_no_text():
    assert extract._counts("/a.txt", "één\x1ctwee\xa0 x".encode()) == ("/a.txt", 14, 11, 3, "extracted")
    assert extract._counts("/a.txt", b" ") == ("/a.txt", 1, 1, 0, "no_text") and extract._counts("/a.pdf", b"%") == ("/a.pdf", 1, 0, 0, "needs_ocr")

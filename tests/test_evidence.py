from foliant.operators import temporal


def joined_rows(df):
    """Rows of the largest join of a table that was computed."""
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_evidence_of_copies_is_summed_before_it_meets_them(spark):
    copies = 200
    files = spark.createDataFrame([(k, "same", None) for k in range(copies)] + [(copies, None, None), (copies + 1, "other", 5)], "file_id long, content_sha256 string, deleted_epoch long")
    rows = [(k, 10 * k + j, kind, "pdf_info", "high", 86400 + k, "utc", "content", "same", 7) for k in range(copies) for j, kind in enumerate(("created", "modified"))]
    rows += [(3, 9001, "created", "office", "high", None, "utc", "file", "same", 7), (4, 9002, "created", "office", "high", 5, "utc", "file", "same", 7), (4, 9003, "created", "office", "high", 6, "utc", "file", "stale", 7), (copies, 9004, "created", "office", "high", 5, "utc", "content", None, 7)]
    evidence = spark.createDataFrame(rows, "file_id long, evidence_id long, date_type string, source_type string, confidence string, value_epoch long, timezone_status string, scope string, content_sha256 string, observed_epoch long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = temporal.profile(files, evidence)
        got = {r.for_file: (r.evidence_count, r.created_epoch, r.created_source, r.created_conflict, r.modified_epoch, r.modified_conflict) for r in out.collect()}
        most = joined_rows(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    newest = 86400 + copies - 1
    want = {k: (2 * copies, newest, "pdf_info", True, newest, True) for k in range(copies)}
    want[3] = (2 * copies + 1, newest, "pdf_info", True, newest, True)
    want[4] = (2 * copies + 1, 5, "office", True, newest, True)
    assert got == want
    assert 0 < most <= 3 * copies

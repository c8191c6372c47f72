"""Versioned policies, the active work-set, lifecycle, retention and job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.common import contains_any, first_of, latest, the_one, top_per, uuid5
from foliant.operators.golden import KEY

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def current_policies(policies: DataFrame, as_of: int) -> DataFrame:
    """The version of each (code, environment) that holds at a moment: the one that took effect last."""
    valid = policies.where((F.col("effective_from") <= as_of) & (F.col("effective_to").isNull() | (F.col("effective_to") > as_of)))
    return latest(valid, ["policy_code", "environment"], ["effective_from", "policy_version"])


def policy_seed(policies: DataFrame) -> DataFrame:
    """Canonical configuration, checksum and name-based id of each version."""
    config = F.to_json(F.struct("effective_from", "months", "policy_code", "policy_version"))
    return policies.select("policy_code", "policy_version", F.sha2(config, 256).alias("checksum"), uuid5(NAMESPACE, F.concat_ws(":", "policy_code", "policy_version")).alias("policy_id"))


def months_before(as_of: int, months: Column) -> Column:
    return F.unix_timestamp(F.timestamp_seconds(F.lit(as_of)) - F.make_ym_interval(F.lit(0), months))


def last_activity(*signals: tuple[str, str, Column]) -> Column:
    """(at, source, confidence) of the latest of the signals (column, name, confidence); of equal ones the first named."""
    listed = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("long").alias("at"), F.lit(-i).alias("first"), F.lit(name).alias("source"), conf.alias("confidence"))) for i, (c, name, conf) in enumerate(signals)]
    return F.array_max(F.array_compact(F.array(*listed)))


def workset(golden: DataFrame, profile: DataFrame, policy: DataFrame, as_of: int, extensions: list[str], root: str) -> DataFrame:
    """Status and reason of every golden file in scope: active, inactive or to review."""
    scope = golden.where(F.col("extension").isin(extensions) & F.col("path").startswith(root + "/")).select("file_id", "path", "extension", "modified_at_fs")
    # One row for each policy code; the work-set has one.
    rows = scope.join(profile.withColumnRenamed("for_file", "file_id"), "file_id", "left").join(F.broadcast(the_one(policy)))
    low = F.lit("low")
    rows = rows.withColumn("_a", last_activity(("modified_epoch", "source_metadata_modified", F.coalesce("modified_confidence", low)), ("created_epoch", "source_metadata_created", F.coalesce("created_confidence", low)), ("modified_at_fs", "filesystem_mtime", low)))
    at, cut = F.col("_a.at"), months_before(as_of, F.col("months"))
    conflict = F.coalesce(F.col("created_conflict") | F.col("modified_conflict"), F.lit(False))
    lost = at.isNull() | (at > as_of)
    status = first_of((conflict | lost, "needs_review"), (at >= cut, "active"), default="inactive")
    reason = first_of((conflict, "conflicting_temporal_evidence"), (lost, "invalid_or_missing_activity_timestamp"), (at >= cut, F.concat("_a.source", F.lit("_within_configured_window"))), default="no_qualifying_activity_within_configured_window")
    return rows.select("file_id", "path", "extension", at.alias("activity_epoch"), F.col("_a.source").alias("basis"), F.coalesce("_a.confidence", low).alias("confidence"), status.alias("status"), reason.alias("reason"), "policy_version")


def pilot(files: DataFrame, persisted: DataFrame, profile: DataFrame, as_of: int, months: int) -> DataFrame:
    """One row per content group (ungrouped files by themselves): newest member, copies, status by ordered guard rules."""
    rows = files.where("deleted_epoch is null").join(persisted.select(*KEY, "golden_file_id"), KEY, "left")
    group = F.when(F.col("golden_file_id").isNotNull(), F.concat_ws(":", *KEY)).otherwise(F.concat(F.lit("file:"), F.col("file_id")))
    newest = F.struct(F.coalesce(-F.col("modified_at_fs"), F.lit(9e18).cast("long")).alias("m"), F.lower("path").alias("p"), F.col("file_id").alias("f"))
    rest = F.struct("file_id", "path", "extension", "size_bytes", "content_sha256", "modified_at_fs", "golden_file_id")
    one = rows.groupBy(group.alias("group_id")).agg(F.min_by(rest, newest).alias("r"), F.count("*").alias("copies")).select("group_id", "copies", "r.*")
    one = one.join(profile.withColumnRenamed("for_file", "file_id"), "file_id", "left")
    low = F.lit("low")
    one = one.withColumn("_a", last_activity(("modified_epoch", "source_metadata_modified", F.coalesce("modified_confidence", low)), ("created_epoch", "source_metadata_created", F.coalesce("created_confidence", low)), ("modified_at_fs", "filesystem_mtime", low)))
    at, cut = F.col("_a.at"), months_before(as_of, F.lit(months))
    conflict = F.coalesce(F.col("created_conflict") | F.col("modified_conflict"), F.lit(False))
    reason = first_of(
        (F.coalesce("size_bytes", F.lit(0)) <= 0, "empty_file"), (F.col("content_sha256").isNull(), "missing_full_content_hash"), (F.col("golden_file_id").isNull(), "missing_persisted_golden_record"), (conflict, "conflicting_temporal_evidence"),
        (at.isNull() | (at > as_of), "invalid_or_missing_activity_timestamp"), (at >= cut, F.concat("_a.source", F.lit("_within_configured_window"))), default="no_qualifying_activity_within_configured_window",
    )
    status = first_of((F.col("reason").endswith("_within_configured_window") & ~F.col("reason").startswith("no_"), "active_candidate"), (F.col("reason").startswith("no_"), "inactive"), default="needs_review")
    missing = F.array_join(F.array_compact(F.array(F.when(F.col("created_epoch").isNull(), F.lit("source_created_at")), F.when(F.col("modified_epoch").isNull(), F.lit("source_modified_at")), F.lit("content_changed_at"), F.lit("last_human_activity_at"))), ",")
    represented = (F.col("copies") > 1) | F.coalesce(F.col("golden_file_id") != F.col("file_id"), F.lit(False))
    return one.withColumn("reason", reason).withColumns({"status": status, "missing": missing, "represented": represented, "activity_epoch": at}).select("group_id", "file_id", "path", "extension", "copies", "activity_epoch", "status", "reason", "missing", "represented")


def review_sample(rows: DataFrame, active: int, near: int, copies: int, conflicts: int) -> DataFrame:
    """Rows to look at: some active ones of each extension, inactive ones nearest the cut-off, duplicates and conflicts; reasons in that order."""
    rank = first_of((F.col("status") == "active_candidate", F.lit(0)), (F.col("status") == "needs_review", F.lit(1)), default=F.lit(2))
    order = [rank, F.col("extension"), F.lower("path"), F.col("file_id")]
    picks = [
        (0, "active_sample", top_per(rows.where("status = 'active_candidate'"), ["extension"], order, active, "_k").drop("_k")),
        (1, "outside_near_cutoff", rows.where("status = 'inactive'").orderBy(F.desc("activity_epoch"), *order).limit(near)),
        (2, "duplicate_group", rows.where("represented").orderBy(*order).limit(copies)),
        (3, "temporal_conflict", rows.where("reason = 'conflicting_temporal_evidence'").orderBy(*order).limit(conflicts)),
    ]
    out = None
    for k, name, chosen in picks:
        one = chosen.select("file_id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("why"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("why")), lambda w: w["name"]), ",").alias("reasons"))


def effective_lifecycle(rows: DataFrame, choices: DataFrame, as_of: int) -> DataFrame:
    """A person's latest choice, unless it says active and has run out; else the computed status."""
    last = latest(choices.select("file_id", "choice", "active_until", "created_epoch", "review_id"), ["file_id"], ["created_epoch", "review_id"])
    holds = F.col("choice").isNotNull() & ~((F.col("choice") == "active") & F.coalesce(F.col("active_until") < as_of, F.lit(False)))
    return rows.join(last, "file_id", "left").select("file_id", F.when(holds, F.col("choice")).otherwise(F.col("status")).alias("lifecycle"), F.when(holds, "human_review").otherwise("policy").alias("source"))


# The zone folder of each lifecycle.
ZONE_FOLDERS = {"active": "active", "archive": "archive", "needs_review": "review"}


def path_review(rows: DataFrame, reviews: DataFrame, classified: DataFrame, proposals: DataFrame, root: str) -> DataFrame:
    """Stored target of each file of the work-set in the zone that its lifecycle asks for, and whether it lies in another.

    rows: (file_id, content_sha256, lifecycle); classified: (file_id, category, family, suggested_path), accepted; proposals: (file_id,
    content_sha256, suggested_path, created_epoch, proposal_id), of which the newest for the current content counts. The stored path is the
    person's, the rules', the accepted classification's or the proposal's, in this order. Only paths in a zone of ``root`` are aligned.
    """
    last = latest(reviews.where("review_type = 'target'").select("file_id", "decision", "target_path", "proposed_path", F.col("category").alias("corrected_category"), "created_epoch", "review_id"), ["file_id"], ["created_epoch", "review_id"])
    current = rows.select("file_id", "content_sha256").join(proposals, ["file_id", "content_sha256"])
    newest = latest(current.select("file_id", F.col("suggested_path").alias("newest_path"), "created_epoch", "proposal_id"), ["file_id"], ["created_epoch", "proposal_id"]).select("file_id", "newest_path")
    r = rows.join(last.drop("created_epoch", "review_id"), "file_id", "left").join(classified.withColumnRenamed("suggested_path", "accepted_path"), "file_id", "left").join(newest, "file_id", "left")
    stored = F.coalesce("target_path", "proposed_path", "accepted_path", "newest_path")
    zoned = rf"^{root}/(" + "|".join(ZONE_FOLDERS.values()) + ")/"
    expected = first_of(*[(F.col("lifecycle") == k, v) for k, v in ZONE_FOLDERS.items()], default=ZONE_FOLDERS["needs_review"])
    r = r.withColumns({"stored_path": stored, "_start": F.concat(F.lit(f"{root}/"), expected, F.lit("/"))})
    inside = F.coalesce(F.col("stored_path").rlike(zoned), F.lit(False))
    aligned = F.when(inside, F.concat("_start", F.regexp_replace("stored_path", zoned, ""))).otherwise(F.col("stored_path"))
    return r.select("file_id", "lifecycle", "decision", "category", "family", "corrected_category", "stored_path", aligned.alias("aligned_path"), (inside & ~F.col("stored_path").startswith(F.col("_start"))).alias("needs_correction"))


def work_list(rows: DataFrame, reviews: DataFrame, nominated: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Work-set rows with what a listing filters by: effective lifecycle, latest target review, active nominations, family."""
    last = latest(reviews.where("review_type = 'target'").select("file_id", "decision", F.col("created_epoch").alias("review_epoch"), "review_id", F.col("family").alias("reviewed_family")), ["file_id"], ["review_epoch", "review_id"])
    open_ = nominated.where("action = 'nominate'").groupBy("file_id").agg(F.array_sort(F.collect_set("nomination_type")).alias("nominations"))  # a few types
    r = rows.join(last, "file_id", "left").join(open_, "file_id", "left").join(lifecycle.select("file_id", "lifecycle"), "file_id", "left")
    return r.withColumns({"nominations": F.coalesce("nominations", F.array().cast("array<string>")), "family": F.coalesce("reviewed_family", F.lit("unknown"))})


def listing(
    rows: DataFrame,
    *,
    status: str = "all",
    extension: str = "all",
    search: str = "",
    review_state: str = "all",
    decision: str = "all",
    nomination: str = "all",
    family: str = "all",
    sort: str = "context",
    offset: int = 0,
    limit: int = 50,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page, families, summary) of the rows of ``work_list``.

    Families are counted after all filters but that on the family. sort: activity_desc, review_desc, filename_asc, filename_desc, or
    context, which is by review where reviewed rows are asked for, else by activity. The summary counts all rows by lifecycle, review
    state and nomination, before any filter.
    """
    reviewed = F.col("decision").isNotNull()
    named = F.col("nominations")
    has = lambda n: F.array_contains(named, n)
    found = rows
    if status != "all":
        found = found.where(F.col("lifecycle") == status)
    if extension != "all":
        found = found.where(F.col("extension") == extension)
    if search.strip():
        low = search.strip().lower()
        found = found.where(F.contains(F.lower("filename"), F.lit(low)) | F.contains(F.lower("path"), F.lit(low)))
    if review_state != "all":
        found = found.where(reviewed if review_state == "reviewed" else ~reviewed)
    if decision != "all":
        found = found.where(F.col("decision") == decision)
    if nomination != "all":
        found = found.where(F.size(named) == 0 if nomination == "none" else has(nomination))
    families = found.groupBy("family").agg(F.count("*").alias("files"))
    if family != "all":
        found = found.where(F.col("family") == family)
    if sort == "context":
        sort = "review_desc" if review_state == "reviewed" or decision != "all" else "activity_desc"
    names = [F.lower("filename"), "filename", "file_id"]
    orders = {"activity_desc": [F.desc_nulls_last("activity_epoch"), *names], "review_desc": [F.desc_nulls_last("review_epoch"), *names], "filename_asc": names, "filename_desc": [F.desc(F.lower("filename")), F.desc("filename"), "file_id"]}
    counts = {f"lifecycle_{k}": F.count_if(F.col("lifecycle") == k) for k in ("active", "inactive", "needs_review")}
    counts |= {"reviewed": F.count_if(reviewed), "pending": F.count_if(~reviewed), "nominated": F.count_if(F.size(named) > 0)}
    summary = rows.agg(F.count("*").alias("total"), *[c.alias(k) for k, c in counts.items()])
    return found.orderBy(*orders[sort]).offset(offset).limit(limit), families, summary


def nominations(events: DataFrame) -> DataFrame:
    """Latest nomination of each (file, type)."""
    return latest(events, ["file_id", "nomination_type"], ["created_epoch", "event_id"])


POLICY_VERSION = "1"
# Role -> policy, active years, archive years, disposition, snapshot; None where nothing runs out by itself.
RETENTION = {
    "study_handout": ("study_handout_1y_4y", 1, 4, "review_snapshot_or_delete", "catalog"),
    "study_own_work": ("study_own_work_3y_7y", 3, 7, "retention_review", "catalog"),
    "study_reference": ("study_reference_3y_7y", 3, 7, "retention_review", "catalog"),
    "study_certificate": ("certificate_permanent", None, None, "permanent", "full"),
    "certificate": ("certificate_permanent", None, None, "permanent", "full"),
    "administration": ("administration_2y_5y", 2, 5, "retention_review", "catalog"),
    "personal": ("personal_3y_7y", 3, 7, "retention_review", "catalog"),
    "home": ("home_3y_7y", 3, 7, "retention_review", "catalog"),
    "work": ("work_3y_5y", 3, 5, "retention_review", "catalog"),
    "project": ("project_3y_5y", 3, 5, "retention_review", "catalog"),
    "financial": ("financial_manual", None, None, "manual_legal_review", "catalog"),
    "health": ("health_permanent_manual", None, None, "permanent_manual", "full"),
    "identity": ("identity_expiry_manual", None, None, "manual_expiry_review", "catalog"),
    "employment": ("employment_manual", None, None, "manual_legal_review", "catalog"),
    "unknown": ("unknown_no_automatic_action", None, None, "manual_classification", "catalog"),
}
# Words that decide the role.
CERTIFICATE_WORDS = ("diploma", "certificaat", "certificate", "getuigschrift", "cijferlijst")
HANDOUT_WORDS = ("handout", "reader", "syllabus", "lesmateriaal", "lesstof", "slides", "presentatie", "college")
OWN_WORDS = ("scriptie", "portfolio", "eindopdracht", "afstudeer", "persoonlijk ontwikkelplan", "pop")
STUDY = "study"


def retention(rows: DataFrame, as_of: int, roles: dict[str, str], study: str = STUDY) -> DataFrame:
    """Role, policy, the date it counts from, the state it is in and a decision id of each row.

    rows: (group_id, filename, path, category, reasons, inconsistent boolean, modified_epoch, created_epoch, modified_at_fs); roles: category ->
    role. The role follows from words of name, path and reasons, else from the category. Files with inconsistent dates have no basis.
    """
    said = F.lower(F.concat_ws(" ", "filename", "path", F.coalesce("reasons", F.lit(""))))
    of = lambda words: contains_any(said, words)
    is_study = F.coalesce(F.col("category") == study, F.lit(False))
    by_word = [(of(CERTIFICATE_WORDS) & is_study, "study_certificate", "certificate_word"), (of(CERTIFICATE_WORDS), "certificate", "certificate_word"), (is_study & of(HANDOUT_WORDS), "study_handout", "handout_word"), (is_study & of(OWN_WORDS), "study_own_work", "own_work_word"), (is_study, "study_reference", "study_role_open")]
    mapped = [(F.col("category") == k, v) for k, v in roles.items()]
    certain = of(CERTIFICATE_WORDS) | (is_study & (of(HANDOUT_WORDS) | of(OWN_WORDS)))
    known = first_of(*[(test, F.lit(True)) for test, _ in mapped], default=F.lit(False))
    r = rows.withColumns(
        {
            "role": first_of(*[(test, role) for test, role, _ in by_word], *mapped, default="unknown"),
            "role_reason": first_of(*[(test, why) for test, _, why in by_word], default="category_default"),
            "role_confidence": first_of((certain, "high"), (is_study | known, "medium"), default="low"),
            "basis_epoch": F.when(~F.col("inconsistent"), F.coalesce("modified_epoch", "created_epoch", "modified_at_fs")),
        }
    )
    pick = lambda i: first_of(*[(F.col("role") == k, F.lit(v[i])) for k, v in RETENTION.items()])
    source = first_of((F.col("inconsistent"), ""), (F.col("modified_epoch").isNotNull(), "embedded_modified"), (F.col("created_epoch").isNotNull(), "embedded_created"), (F.col("modified_at_fs").isNotNull(), "filesystem_mtime"), default="")
    confidence = first_of((F.col("inconsistent"), "blocked"), (F.col("modified_epoch").isNotNull(), "high"), (F.col("created_epoch").isNotNull(), "medium"), (F.col("modified_at_fs").isNotNull(), "low"), default="missing")
    r = r.withColumns({"policy": pick(0), "_active": pick(1).cast("int"), "_archive": pick(2).cast("int"), "disposition": pick(3), "snapshot": pick(4), "basis_source": source, "basis_confidence": confidence})
    later = lambda years: F.unix_timestamp(F.timestamp_seconds("basis_epoch") + F.make_ym_interval(years))
    r = r.withColumns({"active_until": later(F.col("_active")), "_until": later(F.col("_active") + F.col("_archive"))})
    permanent, manual = F.col("disposition").isin("permanent", "permanent_manual"), F.col("_active").isNull()
    state = first_of((permanent, "permanent"), (manual | F.col("basis_epoch").isNull(), "retention_review"), (F.lit(as_of) < F.col("active_until"), "active"), (F.lit(as_of) < F.col("_until"), "cold_archive"), default="retention_review")
    why = first_of((permanent, "no_automatic_deletion"), (manual, F.col("disposition")), (F.col("basis_epoch").isNull(), "missing_basis_date"), (F.lit(as_of) < F.col("active_until"), "within_active_period"), (F.lit(as_of) < F.col("_until"), "active_period_elapsed"), default="retention_period_elapsed")
    r = r.withColumns({"state": state, "state_reason": why, "retain_until": F.when(~permanent & ~manual, F.col("_until"))})
    review = (F.col("state") == "retention_review") | (F.col("role_confidence") != "high")
    day = F.date_format(F.timestamp_seconds(F.lit(as_of)), "yyyy-MM-dd")
    key = F.concat_ws(":", F.col("group_id").cast("string"), F.lit(POLICY_VERSION), day, "state")
    return r.select("group_id", "role", "role_reason", "role_confidence", "policy", "disposition", "snapshot", "basis_epoch", "basis_source", "basis_confidence", "retain_until", "state", "state_reason", F.when(review, F.lit(as_of).cast("long")).otherwise(F.col("retain_until")).alias("next_review"), uuid5(NAMESPACE, key).alias("decision_id"))


def job_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("jobs"), F.min("requested_epoch").alias("oldest"), F.max("priority").alias("top_priority"))


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.where("status = 'pending'").orderBy(F.desc("priority"), "requested_epoch", "job_id").limit(n)


def awaiting_review(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Latest ready job of each file that no accepted review has answered."""
    ready = latest(jobs.where("status = 'ready'"), ["file_id"], ["requested_epoch", "job_id"])
    return ready.join(reviews.where("decision = 'accepted'").select("file_id"), "file_id", "left_anti").select("file_id", "job_id")


def valid_proposals(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Newest finished proposal of each file made for its current content."""
    done = latest(jobs.where("status in ('ready', 'done') and content_state = 'current'"), ["file_id"], ["requested_epoch", "job_id"])
    return done.join(files.where("deleted_epoch is null and content_sha256 is not null").select("file_id", "content_sha256"), "file_id").select("file_id", "job_id", "content_sha256")


def ocr_context(files: DataFrame, evidence: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(file_id, source, of_file, ref): what is known of a file's scanned text under its content's hash, before it is opened again.

    The newest finished artifact comes first (its job), then evidence that the content needs OCR (its run; the file's own before that
    of copies, then the newest). evidence: (content_sha256, file_id, run_id, status, updated_epoch); artifacts: (content_sha256,
    job_id, status, finished_epoch).
    """
    now = files.where("deleted_epoch is null and content_sha256 is not null").select("file_id", "content_sha256")
    made = latest(artifacts.where("status = 'ready'").select("content_sha256", F.col("job_id").alias("job"), "finished_epoch"), ["content_sha256"], ["finished_epoch", "job"])
    need = evidence.where("status = 'needs_ocr'")
    of_all = need.groupBy("content_sha256").agg(F.max_by(F.struct("file_id", "run_id"), F.struct("updated_epoch", "run_id")).alias("any"))
    of_own = need.groupBy("content_sha256", "file_id").agg(F.max_by("run_id", F.struct("updated_epoch", "run_id")).alias("own"))
    r = now.join(made, "content_sha256", "left").join(of_all, "content_sha256", "left").join(of_own, ["content_sha256", "file_id"], "left")
    source = first_of((F.col("job").isNotNull(), "artifact"), (F.col("any").isNotNull(), "evidence"), default="extract")
    of = first_of((F.col("job").isNotNull(), F.lit(None).cast("long")), (F.col("own").isNotNull(), F.col("file_id")), default=F.col("any.file_id"))
    return r.select("file_id", source.alias("source"), of.alias("of_file"), F.coalesce("job", "own", "any.run_id").alias("ref"))


#: Failures of the provider, which are tried again.
PROVIDER_FAILURES = ("TimeoutError", "URLError", "ConnectionRefusedError")


def job_transitions(jobs: DataFrame, outcomes: DataFrame, files: DataFrame, tries: int = 3) -> DataFrame:
    """(job_id, status, next_status, error) of jobs that ran: (job_id, file_id, content_sha256, status, attempts).

    A file that is gone or has other content cancels the job; a provider's failure is pending again below ``tries`` attempts,
    every other failure is final; a proposal makes the job ready or abstained. outcomes: (job_id, outcome, error), outcome
    proposal, abstained or failed; jobs without one stay as they are.
    """
    now = files.where("deleted_epoch is null").select("file_id", F.col("content_sha256").alias("_sha"), F.lit(True).alias("_here"))
    r = jobs.join(outcomes, "job_id", "left").join(now, "file_id", "left")
    ran = F.col("outcome").isNotNull()
    stale = F.col("_here").isNull() | ~F.col("_sha").eqNullSafe(F.col("content_sha256"))
    failed = F.col("outcome") == "failed"
    again = failed & F.col("error").isin(*PROVIDER_FAILURES) & (F.coalesce("attempts", F.lit(0)) < tries)
    after = first_of((~ran, F.col("status")), (stale, "cancelled"), (again, "pending"), (failed, "failed"), (F.col("outcome") == "abstained", "abstained"), default="ready")
    return r.select("job_id", "status", after.alias("next_status"), first_of((ran & stale, "stale_file"), (ran & failed, F.col("error"))).cast("string").alias("error"))

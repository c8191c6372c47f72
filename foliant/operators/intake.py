"""Intake of reviews: all checks of a submission in their order, what it supersedes, and bulk reviews with their batch record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.common import first_of, latest, uuid5
from foliant.operators.classify import DEFAULT, Taxonomy, normalise_filename, normalise_target
from foliant.operators.learning import latest_reviews

# Fixed values of the review contract: types, decisions, labels and limits.
TYPES = ("target_path", "privacy_classification", "lifecycle")
DECISIONS = ("accepted", "rejected", "needs_review", "passed")
PRIVACY = ("low", "medium", "high")
LIFECYCLES = ("active", "archive", "needs_review")
SUGGESTION_DECISIONS = ("accepted", "dismissed", "new_path", "no_suggestion")
FAMILY_CODE = r"^[a-z0-9_'-]{1,80}$"
MONTHS, DAYS_A_MONTH = 120, 30
NOTE, LABEL = 2000, 120
BULK = 50
UUID = r"^\{?(urn:uuid:)?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?$"

FIELDS = (
    "idempotency_key", "review_type", "decision", "privacy", "lifecycle", "active_months", "category", "family", "notes", "proposed_category", "proposed_family", "target_path",
    "path_suggestion", "suggestion_decision", "proposed_filename", "ai_proposal_id",
)
EVENT = ("submission_id", "file_id", "idempotency_key", "review_type", "decision", "privacy", "lifecycle", "active_until", "category", "family", "target_path", "new_filename", "supersedes")


def _given(c: str) -> Column:
    """A field's text, trimmed; empty is null."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def _no(rule: Column) -> Column:
    return ~F.coalesce(rule, F.lit(False))


def review(rows: DataFrame, workset: DataFrame, proposals: DataFrame, reviews: DataFrame, stored: DataFrame, as_of: int, roots: list[str], tax: Taxonomy = DEFAULT) -> DataFrame:
    """Every submission with status (stored, already_stored, rejected), the first reason against it, and the event that it makes.

    rows: submission_id, file_id and FIELDS (absent ones are null). workset: (file_id, filename) of files that can be reviewed. proposals: (file_id,
    proposal_id) as they were made, in order of created_epoch. reviews: earlier ones (file_id, review_type, review_id, created_epoch). stored: (idempotency_key,
    file_id, decision) of events that exist. A key that exists with the same file and decision is stored already; with another it belongs to
    another review. Of submissions with one key in these rows the first (by submission_id) counts as the one that exists.
    """
    held = rows.select("submission_id", F.col("file_id").cast("long").alias("file_id"), *[(_given(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in FIELDS])
    held = held.withColumns({"review_type": F.coalesce("review_type", F.lit("target_path")), "suggestion_decision": F.coalesce("suggestion_decision", F.lit("no_suggestion"))})
    files = workset.select("file_id", F.col("filename").alias("_name")).dropDuplicates(["file_id"])
    newest = latest(proposals.select("file_id", F.lower("proposal_id").alias("_newest"), "created_epoch"), ["file_id"], ["created_epoch", "_newest"]).select("file_id", "_newest")
    before = latest_reviews(reviews).select("file_id", "review_type", F.col("review_id").alias("supersedes"))
    joined = held.join(files, "file_id", "left").join(newest, "file_id", "left").join(before, ["file_id", "review_type"], "left")
    for field, name in (("target_path", "_path"), ("path_suggestion", "_suggestion")):
        joined = _normalised(joined, field, name, roots)
    joined = joined.join(normalise_filename(joined.where("proposed_filename is not null").select("submission_id", "proposed_filename", "_name"), "proposed_filename", "_name").select("submission_id", F.col("normalised").alias("new_filename")), "submission_id", "left")
    is_target, months = F.col("review_type") == "target_path", F.col("active_months")
    known = lambda c, codes: F.col(c).isin(*codes)
    accepted = is_target & (F.col("decision") == "accepted")
    whole = months.rlike(r"^[+-]?[0-9]{1,9}$")
    reason = first_of(
        (_no(F.col("idempotency_key").rlike(UUID)) | F.col("file_id").isNull(), "invalid_key_or_file"),
        (_no(F.col("decision").isin(*DECISIONS)), "invalid_decision"),
        (~F.col("review_type").isin(*TYPES), "invalid_review_type"),
        ((F.col("review_type") == "privacy_classification") & _no(F.col("privacy").isin(*PRIVACY)), "invalid_privacy"),
        ((F.col("review_type") == "lifecycle") & _no(F.col("lifecycle").isin(*LIFECYCLES)), "invalid_lifecycle"),
        (months.isNotNull() & ~whole, "months_not_whole"),
        (months.isNotNull() & (_no(F.col("lifecycle") == "active") | ~F.when(whole, months).cast("int").between(1, MONTHS)), "months_out_of_range"),
        (~F.col("suggestion_decision").isin(*SUGGESTION_DECISIONS), "invalid_suggestion_decision"),
        (F.col("family").isNotNull() & ~F.col("family").rlike(FAMILY_CODE), "invalid_family_code"),
        (accepted & _no(known("category", tax.categories)) | is_target & F.col("category").isNotNull() & ~known("category", tax.categories), "unknown_category"),
        (accepted & _no(known("family", tax.codes)) | is_target & F.col("family").isNotNull() & ~known("family", tax.codes), "unknown_family"),
        (F.length("notes") > NOTE, "note_too_long"),
        (F.length("proposed_category") > LABEL, "proposed_category_too_long"),
        (F.length("proposed_family") > LABEL, "proposed_family_too_long"),
        (F.col("_name").isNull(), "not_in_workset"),
        (F.col("proposed_filename").isNotNull() & ~is_target, "filename_needs_target_review"),
        (F.col("proposed_filename").isNotNull() & F.col("new_filename").isNull(), "invalid_filename"),
        (F.col("ai_proposal_id").isNotNull() & ~F.col("ai_proposal_id").rlike(UUID), "invalid_proposal_id"),
        (F.col("ai_proposal_id").isNotNull() & (~is_target | _no(F.lower("ai_proposal_id") == F.col("_newest"))), "stale_proposal"),
        (F.col("target_path").isNotNull() & F.col("_path").isNull() | F.col("path_suggestion").isNotNull() & F.col("_suggestion").isNull(), "invalid_target_path"),
        ((F.col("suggestion_decision") == "accepted") & ~F.col("_path").eqNullSafe(F.col("_suggestion")), "suggestion_differs"),
    )
    judged = joined.withColumn("_reason", reason.cast("string")).withColumn("idempotency_key", F.lower("idempotency_key"))
    # The first sound submission of a key stands for it, unless an event has the key already.
    sound = judged.where("_reason is null")
    first = sound.groupBy("idempotency_key").agg(F.min_by(F.struct("submission_id", "file_id", "decision"), "submission_id").alias("_first"))
    there = stored.select(F.lower("idempotency_key").alias("idempotency_key"), F.struct("file_id", "decision").alias("_there")).dropDuplicates(["idempotency_key"])
    met = sound.join(first, "idempotency_key").join(there, "idempotency_key", "left")
    owner_file, owner_decision = F.coalesce("_there.file_id", "_first.file_id"), F.coalesce("_there.decision", "_first.decision")
    same = (owner_file == F.col("file_id")) & (owner_decision == F.col("decision"))
    new = F.col("_there").isNull() & (F.col("_first.submission_id") == F.col("submission_id"))
    status = F.when(new, "stored").when(same, "already_stored").otherwise("rejected")
    settled = met.withColumns({"status": status, "reason": F.when(status == "rejected", F.lit("key_of_another_review"))})
    refused = judged.where("_reason is not null").withColumns({"status": F.lit("rejected"), "reason": F.col("_reason")})
    out = settled.drop("_first", "_there").unionByName(refused)
    until = F.when(F.col("review_type") == "lifecycle", F.lit(as_of) + F.when(whole, months).cast("long") * DAYS_A_MONTH * 86400)
    return out.withColumns({"active_until": until, "target_path": F.col("_path")}).select("status", "reason", *EVENT)


def _normalised(rows: DataFrame, field: str, name: str, roots: list[str]) -> DataFrame:
    """Adds a path in its normal form under ``name``, null where it isn't valid or absent; other columns stay."""
    kept = rows.columns
    held = rows.withColumnRenamed("notes", "_notes") if "notes" in kept else rows
    found = normalise_target(held, field, "_name", roots).withColumn(name, F.when(F.col(field).isNotNull(), F.col("normalised"))).drop("notes", "normalised", "problem")
    return found.withColumnRenamed("_notes", "notes").select(*kept, name)


def events(judged: DataFrame) -> DataFrame:
    return judged.where("status = 'stored'").select(*EVENT)


def rejections(judged: DataFrame) -> DataFrame:
    return judged.where("status = 'rejected'").select("submission_id", "reason")


def bulk(items: DataFrame, workset: DataFrame, reviews: DataFrame, stored: DataFrame, namespace: str, tax: Taxonomy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(batches, events) of bulk reviews: each batch with status and reason, and two events for each file of a stored one.

    items: batch_key, file_id, category, family, privacy, target_path. workset: (file_id, filename, workset_status). stored: (batch_key, snapshot) of batches
    that exist. A batch has 1 to 50 different files that are active or inactive in the workset, codes of the taxonomy and a privacy label; the first reason
    of the batch counts. Its record holds the number of files and a digest of its snapshot (file, name, target, privacy in order of the file): a batch that comes
    again is stored already if that is the same, else its key belongs to another batch. Batches of more rows are refused by their count, their rows aren't gathered.
    """
    files = workset.where(F.col("workset_status").isin("active", "inactive")).select("file_id", "filename").dropDuplicates(["file_id"])
    rows = items.join(files, "file_id", "left")
    bad_code = _no(F.col("category").isin(*tax.categories)) | _no(F.col("family").isin(*tax.codes))
    line = F.concat_ws("\t", F.col("file_id").cast("string"), "filename", "target_path", "privacy")
    counts = items.groupBy("batch_key").agg(F.count("*").alias("n"))
    few = rows.join(counts.where(F.col("n") <= BULK), "batch_key", "left_semi")
    per = few.groupBy("batch_key").agg(
        F.countDistinct("file_id").alias("files"), F.count_if(F.col("file_id").isNull()).alias("nameless"), F.count_if(F.col("filename").isNull()).alias("absent"), F.count_if(bad_code).alias("codes"), F.count_if(_no(F.col("privacy").isin(*PRIVACY))).alias("labels"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", line.alias("line")))), lambda s: s["line"]), "\n"), 256).alias("snapshot"),
    )
    there = stored.select("batch_key", F.col("snapshot").alias("_there")).dropDuplicates(["batch_key"])
    judged = counts.join(per, "batch_key", "left").join(there, "batch_key", "left")
    reason = first_of(
        (_no(F.col("batch_key").rlike(UUID)), "invalid_key"), (F.col("n") > BULK, "too_many_files"), (F.col("nameless") > 0, "missing_file"), (F.col("files") < F.col("n"), "repeated_file"), (F.col("absent") > 0, "not_classifiable"), (F.col("codes") > 0, "invalid_classification"), (F.col("labels") > 0, "invalid_privacy"),
        (F.col("_there").isNotNull() & (F.col("_there") != F.col("snapshot")), "key_of_another_batch"),
    ).cast("string")
    judged = judged.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_there").isNotNull(), "already_stored").otherwise("stored"))
    batches = judged.select("batch_key", F.col("n").alias("document_count"), "status", "reason", F.when(F.col("reason").isNull(), F.col("snapshot")).alias("snapshot"))
    kinds = F.explode(F.array(F.struct(F.lit("target_path").alias("t"), F.lit("target").alias("k")), F.struct(F.lit("privacy_classification").alias("t"), F.lit("privacy").alias("k")))).alias("r")
    two = rows.join(judged.where("status = 'stored'").select("batch_key"), "batch_key", "left_semi").select("batch_key", "file_id", "category", "family", "privacy", "target_path", kinds)
    before = latest_reviews(reviews).select("file_id", F.col("review_type").alias("_type"), F.col("review_id").alias("supersedes"))
    named = two.select("*", "r.t", F.concat_ws(":", "r.k", F.col("file_id").cast("string")).alias("_n")).join(before.withColumnRenamed("_type", "t"), ["file_id", "t"], "left")
    own = F.col("t") == "target_path"
    return batches, named.select(
        "batch_key", "file_id", F.col("t").alias("review_type"), uuid5(namespace, F.concat_ws("|", "batch_key", "_n")).alias("event_key"), F.when(own, F.col("category")).alias("category"), F.when(own, F.col("family")).alias("family"),
        F.when(~own, F.col("privacy")).alias("privacy"), F.when(own, F.col("target_path")).alias("target_path"), "supersedes",
    )

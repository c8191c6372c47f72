"""Plans of model runs and reviews before they are stored: drift against the approved manifest, canonical digests, prompts from chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.common import first_of, uuid5
from foliant.operators.intake import UUID as IS_UUID

# Namespaces of name-based ids, versions, and what a stored review may say.
RUN_NAMESPACE = "d69b37ab-c45e-4d55-8bbc-204370239181"
EMBEDDING_NAMESPACE = "5d436bf4-45ce-4b2e-b90a-810536717a3c"
REVIEW_NAMESPACE = "c7f7a662-901a-44a7-95bb-a713481c85ed"
EXTRACTOR, CHUNKER, TOKEN_CHUNKER = "local-pypdf-docx-v2", "words-600-overlap-75-v1", "e5-tokens-384-overlap-64-v1"
REVIEW_SCHEMA, PROMPT_VERSION = "classification-review-plan-v1", "scrum-59-rag-v1"
CATEGORIES = ("personal", "administration", "finance", "home", "work", "study", "projects", "other")
LIFECYCLES = ("active_candidate", "archive_candidate", "needs_review", "quarantine")
SENSITIVITIES = ("normal", "personal", "sensitive", "highly_sensitive")
CONFIDENCES = ("low", "medium", "high")

REVIEW_FIELDS = ("proposal_id", "idempotency_key", "decision", "reviewer", "reviewed_at", "category", "document_family", "lifecycle", "suggested_path", "sensitivity", "confidence", "notes")


def _absent(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """(manifest, manifest_sha256): digest of each manifest's approved documents, in chunks of 1,024 ids whose digests are digested again."""
    line = F.concat_ws("\t", F.col("file_id").cast("string"), "content_sha256")
    chunks = manifest.where("approval = 'approved'").groupBy("manifest", F.floor(F.col("file_id") / 1024).alias("c")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", line.alias("l")))), lambda s: s["l"]), "\n"), 256).alias("d"))
    whole = chunks.groupBy("manifest").agg(F.array_sort(F.collect_list(F.struct("c", "d"))).alias("ds"))
    return whole.select("manifest", F.sha2(F.array_join(F.transform("ds", lambda s: s["d"]), "\n"), 256).alias("manifest_sha256"))


def run_plans(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """A run for each manifest: (manifest, run_id, status, document_count, chunk_count, error_count, problem).

    manifest: (manifest, file_id, approval, content_sha256). results: (manifest, file_id, state, error_type, content_sha256, chunks). A run isn't planned if
    its results are of another number than the approved documents (count_mismatch), name a file that isn't approved (unknown_file), or planned one whose
    content has changed (content_changed); the first of these counts, and status is refused. Files that ask for a password are errors too.
    """
    approved = manifest.where("approval = 'approved'").select("manifest", "file_id", F.col("content_sha256").alias("_sha"), F.lit(True).alias("_known"))
    joined = results.join(approved, ["manifest", "file_id"], "left")
    wrong = F.col("_known") & (F.col("state") == "planned") & ~F.col("content_sha256").eqNullSafe(F.col("_sha"))
    counts = joined.groupBy("manifest").agg(
        F.count("*").alias("document_count"), F.sum("chunks").cast("long").alias("chunk_count"), F.count_if(F.col("state").isin("error", "password_protected")).alias("error_count"), F.count_if(F.col("_known").isNull()).alias("_unknown"), F.count_if(wrong).alias("_changed"),
    )
    wanted = approved.groupBy("manifest").agg(F.count("*").alias("_wanted"))
    rows = manifest_digest(manifest).join(wanted, "manifest").join(counts, "manifest", "left")
    numbers = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("document_count", "chunk_count", "error_count", "_unknown", "_changed")}
    rows = rows.withColumns(numbers)
    problem = first_of((F.col("document_count") != F.col("_wanted"), "count_mismatch"), (F.col("_unknown") > 0, "unknown_file"), (F.col("_changed") > 0, "content_changed")).cast("string")
    rows = rows.withColumn("problem", problem)
    run_id = uuid5(RUN_NAMESPACE, F.concat_ws(":", "manifest_sha256", F.lit(EXTRACTOR), F.lit(CHUNKER)))
    status = F.when(F.col("problem").isNotNull(), "refused").when(F.col("error_count") > 0, "completed_with_errors").otherwise("completed")
    return rows.select("manifest", run_id.alias("run_id"), status.alias("status"), "document_count", "chunk_count", "error_count", "problem")


def embedding_plans(manifest: DataFrame, chunks: DataFrame, model: str, dimension: int) -> DataFrame:
    """A plan to store vectors for each manifest: (manifest, embedding_run_id, semantic_run_id, status, document_count, chunk_count, problem).

    chunks: (manifest, file_id, content_sha256, embedding). Refused for files that aren't approved (unknown_file), for changed content (content_changed)
    and for vectors of another dimension (wrong_dimension).
    """
    approved = manifest.where("approval = 'approved'").select("manifest", "file_id", F.col("content_sha256").alias("_sha"), F.lit(True).alias("_known"))
    joined = chunks.select("manifest", "file_id", "content_sha256", F.size("embedding").alias("_d")).join(approved, ["manifest", "file_id"], "left")
    counts = joined.groupBy("manifest").agg(
        F.countDistinct("file_id").alias("document_count"), F.count("*").alias("chunk_count"), F.count_if(F.col("_known").isNull()).alias("_unknown"),
        F.count_if(F.col("_known") & ~F.col("content_sha256").eqNullSafe(F.col("_sha"))).alias("_changed"), F.count_if(F.col("_d") != dimension).alias("_odd"),
    )
    rows = manifest_digest(manifest).join(counts, "manifest")
    run = uuid5(RUN_NAMESPACE, F.concat_ws(":", "manifest_sha256", F.lit(EXTRACTOR), F.lit(CHUNKER)))
    rows = rows.withColumn("semantic_run_id", run).withColumn("problem", first_of((F.col("_unknown") > 0, "unknown_file"), (F.col("_changed") > 0, "content_changed"), (F.col("_odd") > 0, "wrong_dimension")).cast("string"))
    own = uuid5(EMBEDDING_NAMESPACE, F.concat_ws(":", "semantic_run_id", F.lit(model), F.lit(TOKEN_CHUNKER)))
    return rows.select("manifest", own.alias("embedding_run_id"), "semantic_run_id", F.when(F.col("problem").isNull(), "completed").otherwise("refused").alias("status"), "document_count", "chunk_count", "problem")


def review_plans(reviews: DataFrame) -> DataFrame:
    """Each review with the first problem, or the id and digest under which it is stored: (idempotency_key, problem, id, review_sha256).

    reviews: REVIEW_FIELDS. The digest is that of the canonical form: all fields, schema and id as JSON with sorted keys and no spaces, nulls written.
    """
    bad = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    accepted = F.col("decision") == "accepted"
    instant = F.try_to_timestamp("reviewed_at").isNotNull()
    problem = first_of(
        (_absent("proposal_id") | _absent("idempotency_key") | _absent("decision") | _absent("reviewer") | _absent("reviewed_at"), "missing_field"),
        (~F.col("proposal_id").rlike(IS_UUID), "invalid_proposal_id"),
        (~instant, "invalid_time"),
        (bad("decision", ("accepted", "rejected")), "invalid_decision"),
        (accepted & bad("category", CATEGORIES), "invalid_category"),
        (accepted & bad("lifecycle", LIFECYCLES), "invalid_lifecycle"),
        (accepted & bad("sensitivity", SENSITIVITIES), "invalid_sensitivity"),
        (accepted & bad("confidence", CONFIDENCES), "invalid_confidence"),
        (accepted & (_absent("document_family") | _absent("suggested_path")), "missing_family_or_path"),
    ).cast("string")
    own = uuid5(REVIEW_NAMESPACE, F.col("idempotency_key"))
    rows = reviews.select(*REVIEW_FIELDS, problem.alias("problem"), own.alias("id"), F.lit(REVIEW_SCHEMA).alias("schema_version"))
    canonical = F.to_json(F.struct(*sorted([*REVIEW_FIELDS, "id", "schema_version"])), {"ignoreNullFields": "false"})
    fine = F.col("problem").isNull()
    return rows.select("idempotency_key", "problem", F.when(fine, F.col("id")).alias("id"), F.when(fine, F.sha2(canonical, 256)).alias("review_sha256"))


def chunk_prompts(hits: DataFrame, chunks: DataFrame, queries: DataFrame, files: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, prompt, sources): the question and the chunks that were found, whole, each with its source id, name and ordinal.

    hits: (query_id, file_id, ordinal, rank); chunks: (file_id, ordinal, passage); queries: (query_id, query); files: (file_id, filename). Hits whose chunk is gone are left out,
    and sources are numbered without them; a query without any has no prompt.
    """
    found = hits.where(F.col("rank") <= limit).join(chunks, ["file_id", "ordinal"]).join(files.select("file_id", "filename"), "file_id")
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "filename", "ordinal", "passage"))).alias("s"))  # at most ``limit`` chunks
    block = F.transform("s", lambda s, i: F.concat(F.lit("SOURCE S"), (i + 1).cast("string"), F.lit("\nfilename: "), s["filename"], F.lit("\nchunk: "), s["ordinal"].cast("string"), F.lit("\ncontent:\n"), s["passage"]))
    head = F.concat(F.lit(f"prompt_version: {PROMPT_VERSION}\nQUESTION:\n"), F.coalesce("query", F.lit("")), F.lit("\n\nSOURCES:\n"))
    return listed.join(queries.select("query_id", "query"), "query_id").select("query_id", F.concat(head, F.array_join(block, "\n\n")).alias("prompt"), F.size("s").cast("long").alias("sources"))

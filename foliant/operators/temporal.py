"""Evidence about when documents were made and changed, and what follows from conflicts in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.common import first_of

DAY = 86400
#: Ranks of sources, one for the profile and another for the canonical choice.
PROFILE_RANK = {"office": 3, "pdf_xmp": 3, "pdf_info": 2}
CANONICAL_RANK = {"office": 4, "pdf_info": 3, "pdf_xmp": 2}


def _rank(column: str, ranks: dict[str, int], default: int) -> Column:
    return first_of(*[(F.col(column) == k, F.lit(n)) for k, n in ranks.items()], default=default)


def confidence_rank(column: str = "confidence") -> Column:
    return _rank(column, {"high": 3, "medium": 2}, 1)


def parse_dates(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """value_epoch (null without a zone), local_epoch, offset_minutes, timezone_status and confidence of ISO and PDF dates."""
    iso = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(Z|[+-]\d{2}:\d{2})?$"
    pdf = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}'\d{2}')?$"
    is_iso, c = F.col(raw).rlike(iso), F.col(raw)
    group = lambda k: F.when(is_iso, F.regexp_extract(c, iso, k)).otherwise(F.regexp_extract(c, pdf, k))
    known = is_iso | c.rlike(pdf)
    field = lambda k: F.when(known, group(k).try_cast("int"))
    local = F.unix_timestamp(F.try_make_timestamp(field(1), field(2), field(3), field(4), field(5), field(6)))
    zone = F.when(known, group(7))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    offset = F.when(zone == "Z", 0).when(F.length(zone) > 1, sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
    out = rows.withColumns({"local_epoch": local, "offset_minutes": offset})
    status = first_of((F.col("local_epoch").isNull(), F.lit(None).cast("string")), (F.col("offset_minutes").isNull(), "absent"), (F.col("offset_minutes") == 0, "utc"), default="explicit_offset")
    return out.withColumns({"value_epoch": F.col("local_epoch") - F.col("offset_minutes") * 60, "timezone_status": status, "confidence": first_of((F.col("local_epoch").isNull(), F.lit(None).cast("string")), (F.col("offset_minutes").isNull(), "medium"), default="high")})


def evidence_key(rows: DataFrame) -> DataFrame:
    """Key under which an observation is appended once: the content for content evidence, else the file."""
    subject = F.when(F.col("scope") == "content", F.col("content_sha256")).otherwise(F.concat(F.lit("file:"), F.col("file_id")))
    return rows.withColumn("evidence_key", F.sha2(F.concat_ws("|", subject, "date_type", "source_type", F.coalesce(F.col("value_epoch").cast("string"), F.lit(""))), 256))


def _observed() -> dict[str, Column]:
    """What profile and resolution need of observations, as sums, bounds and greatest rows, so that sums of parts add up (``_ADDED``)."""
    newest = lambda source: F.max(F.when(F.col("source_type") == source, F.struct("observed_epoch", "evidence_id", "value_epoch", "timezone_status")))
    order = [F.col("value_epoch").isNotNull().alias("known"), confidence_rank().alias("c"), _rank("source_type", PROFILE_RANK, 1).alias("s"), "observed_epoch", "evidence_id"]
    return {
        "n": F.count(F.lit(1)), "least": F.min("value_epoch"), "most": F.max("value_epoch"), "pdf_only": F.bool_and(F.col("source_type").startswith("pdf")), "info": newest("pdf_info"), "xmp": newest("pdf_xmp"),
        "best": F.max(F.struct(*order, "value_epoch", "source_type", "confidence")),
    }


_ADDED = {"n": F.sum, "least": F.min, "most": F.max, "pdf_only": F.bool_and, "info": F.max, "xmp": F.max, "best": F.max}


def observed(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(for_file, date_type, and what is observed): evidence of each active file, by equal content for content evidence, by id and content for file evidence.

    Evidence of a content is summed up before it meets the files that have that content: copies times their evidence are never made.
    """
    active = files.where("deleted_epoch is null and content_sha256 is not null").select(F.col("file_id").alias("for_file"), "content_sha256")
    state = [c.alias(k) for k, c in _observed().items()]
    content = evidence.where("scope = 'content' and content_sha256 is not null").groupBy("content_sha256", "date_type").agg(*state).join(active, "content_sha256")
    own = evidence.where("scope = 'file'").join(active.withColumnRenamed("for_file", "file_id"), ["file_id", "content_sha256"]).groupBy(F.col("file_id").alias("for_file"), "date_type").agg(*state)
    # Dealt by file, so that what sums up by file next needs neither another shuffle nor another sort.
    both = content.drop("content_sha256").unionByName(own).repartition("for_file")
    return both.groupBy("for_file", "date_type").agg(*[f(k).alias(k) for k, f in _ADDED.items()]).withColumn("several", F.coalesce(F.col("least") < F.col("most"), F.lit(False)))


def _resolved(rows: DataFrame) -> DataFrame:
    """Rows of ``observed`` with status and reason."""
    usable = F.col("pdf_only") & F.col("info.value_epoch").isNotNull() & F.col("info.timezone_status").isin("utc", "explicit_offset") & F.col("xmp.value_epoch").isNotNull()
    close = usable & (F.abs(F.col("info.value_epoch") - F.col("xmp.value_epoch")) <= 2)
    same_day = usable & (F.col("xmp.value_epoch") % DAY == 0) & (F.floor(F.col("xmp.value_epoch") / DAY) == F.floor(F.col("info.value_epoch") / DAY))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = first_of((~F.col("several"), "consistent_single_value"), (yes(close), "equivalent_instant"), (yes(same_day), "equivalent_day"), default="materially_different")
    status = first_of((~F.col("several"), "consistent"), (yes(close | same_day), "equivalent"), default="material_conflict")
    return rows.withColumns({"status": status, "reason": reason})


def resolution(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status of each (file, date type): consistent, equivalent (PDF info and XMP within 2 s or on one day), or in conflict."""
    return _resolved(observed(files, evidence)).select("for_file", "date_type", "n", "status", "reason")


def profile(files: DataFrame, evidence: DataFrame, conflict_mode: str = "resolution") -> DataFrame:
    """Best created and modified value of each active file, with counts and conflicts.

    conflict_mode: by ``resolution``, or ``distinct``: more than one distinct value.
    """
    rows = _resolved(observed(files, evidence))
    rows = rows.withColumn("conflict", F.col("status") == "material_conflict" if conflict_mode == "resolution" else F.col("several"))
    pick = lambda kind, c: F.max(F.when(F.col("date_type") == kind, F.col(c)))
    columns = [a for kind in ("created", "modified") for a in (pick(kind, "best.value_epoch").alias(f"{kind}_epoch"), pick(kind, "best.source_type").alias(f"{kind}_source"), pick(kind, "best.confidence").alias(f"{kind}_confidence"), F.coalesce(F.bool_or(F.when(F.col("date_type") == kind, F.col("conflict"))), F.lit(False)).alias(f"{kind}_conflict"))]
    return rows.groupBy("for_file").agg(F.sum("n").alias("evidence_count"), *columns)


def judged(evidence: DataFrame, as_of: int) -> DataFrame:
    """Evidence with the reason why it can't be canonical, its day and its precision."""
    v = F.col("value_epoch")
    jan_first = F.date_format(F.timestamp_seconds(v), "MM-dd") == "01-01"
    reason = first_of((~F.col("source_type").isin(list(CANONICAL_RANK)), "unsupported_source"), (~F.col("date_type").isin("created", "modified"), "unsupported_semantics"), (v.isNull(), "invalid_timestamp"), (v > as_of + DAY, "future_timestamp"), (jan_first & F.year(F.timestamp_seconds(v)).isin(1900, 1970), "placeholder_timestamp"))
    zoned = F.col("timezone_status") != "absent"
    return evidence.withColumns({"excluded": reason.cast("string"), "day": F.floor(v / DAY), "zoned": zoned, "date_only": ~zoned & (v % DAY == 0)})


def _canonical_order() -> Column:
    """What the canonical row is least in, and the row's values."""
    sign = F.when(F.col("date_type") == "created", 1).otherwise(-1)
    order = [sign * F.col("day"), F.col("date_only").cast("int"), (~F.col("zoned")).cast("int"), -confidence_rank(), -_rank("source_type", CANONICAL_RANK, 0), sign * F.col("value_epoch"), F.col("evidence_id")]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "evidence_id", "value_epoch", "source_type", "date_only", "zoned")


def canonical(evidence: DataFrame, as_of: int) -> DataFrame:
    """Canonical evidence of each (file, date type): earliest created, latest modified day, then the more precise and certain."""
    rows = judged(evidence, as_of).where("excluded is null")
    best = rows.groupBy("file_id", "date_type").agg(F.min(_canonical_order()).alias("b"))
    return best.select("file_id", "date_type", *[f"b.{c}" for c in ("evidence_id", "value_epoch", "source_type", "date_only", "zoned")])


def impact(files: DataFrame, evidence: DataFrame, as_of: int, months: int) -> DataFrame:
    """What the canonical choice does to a file's activity, beside what the profile says.

    issue: created after modified (or ambiguous, where only one of them has a zone). A material conflict of sources is sensitive if
    credible dates lie before and within the window of ``months`` and the file system's date isn't within it itself; only then, or with a
    created date after the modified one, is the file to review. created_changed and modified_changed: the canonical value isn't the profile's.
    """
    cut = F.unix_timestamp(F.timestamp_seconds(F.lit(as_of)) - F.make_ym_interval(F.lit(0), F.lit(months)))
    pick = lambda kind: F.min(F.when(F.col("date_type") == kind, _canonical_order())).alias(kind)
    before, within = F.col("value_epoch") < cut, (F.col("value_epoch") >= cut) & (F.col("value_epoch") <= as_of)
    # The canonical choices (as by ``canonical``) and the credible dates in one aggregate.
    chosen = judged(evidence, as_of).where("excluded is null").groupBy("file_id").agg(pick("created"), pick("modified"), F.bool_or(before).alias("_before"), F.bool_or(within).alias("_within"))
    named = [("created.value_epoch", "new_created"), ("modified.value_epoch", "new_modified"), ("created.zoned", "_cz"), ("modified.zoned", "_mz")]
    chosen = chosen.select("file_id", *[F.col(c).alias(name) for c, name in named], "_before", "_within")
    old = profile(files, evidence).select(F.col("for_file").alias("file_id"), "created_epoch", "modified_epoch", "created_conflict", "modified_conflict")
    rows = files.where("deleted_epoch is null").select("file_id", "modified_at_fs").join(chosen, "file_id", "left").join(old, "file_id", "left")
    past = lambda c: F.when(F.col(c) <= as_of, F.col(c))
    conflict = F.coalesce(F.col("created_conflict") | F.col("modified_conflict"), F.lit(False))
    recent = F.coalesce((F.col("modified_at_fs") >= cut) & (F.col("modified_at_fs") <= as_of), F.lit(False))
    sensitive = conflict & ~recent & F.coalesce(F.col("_before") & F.col("_within"), F.lit(False))
    late = F.coalesce(F.col("new_created") > F.col("new_modified"), F.lit(False))
    issue = first_of((late & (F.col("_cz") == F.col("_mz")), "created_after_modified"), (late, "chronology_timezone_ambiguous"), default="none")
    best = F.greatest(past("new_modified"), past("new_created"), past("modified_at_fs"))
    rows = rows.withColumns({"issue": issue, "conflict_effect": first_of((sensitive, "decision_sensitive"), (conflict, "decision_invariant"), default="none"), "activity_epoch": best})
    active = F.col("activity_epoch") >= cut
    review = (F.col("issue") == "created_after_modified") | (F.col("conflict_effect") == "decision_sensitive") | F.col("activity_epoch").isNull()
    reason = first_of(
        (F.col("issue") == "created_after_modified", "created_after_modified"), (F.col("conflict_effect") == "decision_sensitive", "decision_sensitive_conflict"), (F.col("activity_epoch").isNull(), "insufficient_evidence"), (active, "activity_within_window"), (F.col("conflict_effect") != "none", "inactive_despite_conflict"), default="activity_outside_window"
    )
    before = F.greatest("modified_epoch", "created_epoch", "modified_at_fs")
    was = first_of((conflict | before.isNull() | (before > as_of), "needs_review"), (before >= cut, "active"), default="inactive")
    out = rows.withColumns({"status_before": was, "status": first_of((review, "needs_review"), (active, "active"), default="inactive"), "reason": reason})
    changed = lambda kind: ~F.col(f"new_{kind}").eqNullSafe(F.col(f"{kind}_epoch"))
    return out.select("file_id", "issue", "conflict_effect", "activity_epoch", "status_before", "status", "reason", changed("created").alias("created_changed"), changed("modified").alias("modified_changed"), (F.col("status") != F.col("status_before")).alias("changed"))


def text_dates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The first 50 distinct dates of a text, sorted."""
    patterns = [r"(\b\d{4}-\d{2}-\d{2}\b)", r"(\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b)"]
    found = F.array_union(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in patterns])
    return docs.withColumn("dates", F.slice(F.array_sort(F.array_distinct(found)), 1, 50))


def inconsistencies(rows: DataFrame, as_of: int, zone: str = "Europe/Amsterdam") -> DataFrame:
    """Codes of what is wrong with a file's embedded dates; dates without a zone are wall-clock times of ``zone``."""
    epoch = lambda c, status: F.when(F.col(status) == "absent", F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(c), zone))).otherwise(F.col(c))
    out = rows.withColumns({"_created": epoch("created_epoch", "created_status"), "_modified": epoch("modified_epoch", "modified_status")})
    codes = F.array_compact(
        F.array(
            F.when(F.greatest("_created", "_modified") > as_of, F.lit("future")),
            F.when(F.col("_created") > F.col("_modified"), F.lit("created_after_modified")),
            F.when((F.col("created_epoch") == F.col("modified_epoch")) & (F.col("_created") != F.col("_modified")), F.lit("timezone_conflict")),
            F.when(F.col("created_epoch").isNull() | F.col("modified_epoch").isNull(), F.lit("parse_error")),
        )
    )
    return out.withColumn("codes", codes).drop("_created", "_modified")


def backfill(files: DataFrame, evidence: DataFrame, extensions: list[str], n: int) -> DataFrame:
    """The next files, by id, whose content has no evidence yet."""
    rows = files.where(F.col("deleted_epoch").isNull() & F.col("content_sha256").isNotNull() & F.col("extension").isin(extensions))
    return rows.join(evidence.select("file_id", "content_sha256").distinct(), ["file_id", "content_sha256"], "left_anti").orderBy("file_id").limit(n)

"""Integrity, cleanup and assessment of a file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.scratch import scratch

SYSTEM_NAMES = [".ds_store", "thumbs.db", "desktop.ini"]
LOW_VALUE_EXTENSIONS = ["tmp", "temp", "bak", "old", "orig", "swp", "log", "ini", "db", "sieve", "core"]
MEDIA = ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "heic", "mp3", "wav", "flac", "m4a", "mp4", "mkv", "avi", "mov", "mts"]
OFFICE = ["txt", "md", "pdf", "doc", "docx", "rtf", "odt", "xls", "xlsx", "ods", "csv", "ppt", "pptx", "odp", "html", "htm", "xml"]
SECRET_FILES = ["key", "pem", "p12", "pfx", "ovpn", "kdbx"]


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def root_of(path: Column) -> Column:
    """First folder below the top one; '[root]' for what lies above."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^/data/([^/]+)", 1), F.lit("")), F.lit("[root]"))


#: Name of a problem, its status, its score and its test; the first that holds gives status and score.
PROBLEMS = [
    ("missing_path", "LEGACY_MISSING_PATH", 25, lambda: blank("path")),
    ("missing_folder_id", "INVALID_MISSING_FOLDER", 20, lambda: F.col("folder_id").isNull()),
    ("missing_hash_path", "INCOMPLETE_MISSING_HASH_PATH", 60, lambda: blank("hash_path")),
    ("missing_hash_content", "INCOMPLETE_MISSING_HASH_CONTENT", 70, lambda: blank("hash_content")),
    ("missing_mime_type", "INCOMPLETE_MISSING_MIME", 80, lambda: blank("mime_type")),
    ("deleted", "DELETED", 90, lambda: F.col("deleted_epoch").isNotNull()),
]


def integrity(files: DataFrame) -> DataFrame:
    """Adds integrity_status, integrity_score and the list of all problems."""
    status, score = F.lit("VALID"), F.lit(100)
    for _, name, points, test in reversed(PROBLEMS):
        status, score = F.when(test(), F.lit(name)).otherwise(status), F.when(test(), F.lit(points)).otherwise(score)
    problems = F.array_compact(F.array(*[F.when(test(), F.lit(name)) for name, _, _, test in PROBLEMS]))
    return files.withColumns({"integrity_status": status, "integrity_score": score, "problems": problems})


def integrity_summary(files: DataFrame) -> DataFrame:
    return integrity(files).groupBy("integrity_status").agg(F.count("*").alias("files"), F.round(F.avg("integrity_score"), 2).alias("average_score"))


def audit_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total"), count_if(blank("path")).alias("no_path"), count_if(blank("hash_path")).alias("no_hash_path"), count_if(blank("hash_content")).alias("no_hash_content"), count_if(blank("mime_type")).alias("no_mime"))


def duplicate_groups(files: DataFrame, keys: list, where: Column | None = None, aggs: list | None = None) -> DataFrame:
    """Groups of two or more rows that share ``keys``: keys, n and further aggregates."""
    rows = files if where is None else files.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(aggs or [])).where("n > 1")


def missing_links(files: DataFrame, metadata: DataFrame, folders: DataFrame) -> DataFrame:
    """Counts of files without metadata, metadata without file, folders without files."""
    parts = [
        ("files_without_metadata", files.join(metadata, "file_id", "left_anti")),
        ("metadata_without_file", metadata.join(files, "file_id", "left_anti")),
        ("folders_without_files", folders.join(files, folders["id"] == files["folder_id"], "left_anti")),
    ]
    out = None
    for name, rows in parts:
        one = rows.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def system_folder(path: str = "path") -> Column:
    return F.col(path).like("%/@%")


def system_file(name: str = "filename") -> Column:
    c = F.col(name)
    return c.startswith("~$") | c.like("._%") | c.isin(".DS_Store", "Thumbs.db") | c.rlike(r"\.(tmp|swp|bak)$")


def cleanup(files: DataFrame, folders: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, folders and metadata that survive: no system folders or files, no orphans, no child of a removed row.

    A folder goes if it or any ancestor is a system folder or lacks its parent; levels of the tree are walked by
    one join each until one adds nothing. Folders in a cycle have no root above them, so they are orphans.
    """
    ok = scratch(folders.where(~system_folder()).select("id", "parent_id"), "folders")
    level = ok.where("parent_id is null").select("id").distinct()
    alive = level
    while not level.isEmpty():
        below = ok.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        level = scratch(below.join(alive, "id", "left_anti"), "level")
        alive = alive.unionByName(level)
    kept_folders = folders.join(alive, "id", "left_semi")
    kept_files = files.where(~system_file()).join(kept_folders.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    kept_metadata = metadata.join(kept_files, "file_id", "left_semi")
    return kept_files, kept_folders, kept_metadata


def extension_profile(files: DataFrame, top: int = 100) -> DataFrame:
    ext = F.coalesce(F.nullif(F.lower("extension"), F.lit("")), F.lit("<none>"))
    out = files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), count_if(F.col("deleted_epoch").isNull()).alias("active"), count_if(blank("hash_content")).alias("no_hash"), count_if(blank("mime_type")).alias("no_mime"))
    return out.orderBy(F.desc("files"), "extension").limit(top)


def noise(files: DataFrame) -> DataFrame:
    """Rows that look like system or scratch files, with the first reason that holds."""
    reasons = [
        ("thumbnail_folder", F.col("path").contains("/@eaDir/")),
        ("recycle_bin", F.col("path").contains("/#recycle/")),
        ("trash", F.col("path").contains("/.Trash")),
        ("system_prefix", F.col("filename").startswith("@")),
        ("dotfile", F.col("filename").startswith(".")),
        ("system_file", F.lower("filename").isin(SYSTEM_NAMES)),
        ("low_value_extension", F.lower("extension").isin(LOW_VALUE_EXTENSIONS)),
    ]
    reason = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return files.withColumn("reason", reason).where("reason is not null")


def legacy_match(files: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, blocked): rows without path and hashes whose rebuilt path has, or lacks, a complete active row."""
    named = folders.where(~blank("path")).select(F.col("id").alias("folder_id"), F.col("path").alias("_folder"))
    legacy = files.where(blank("path") & blank("hash_content") & blank("hash_path") & ~blank("filename")).join(named, "folder_id")
    legacy = legacy.select(F.col("file_id").alias("legacy_id"), F.concat_ws("/", "_folder", "filename").alias("rebuilt_path"), F.col("size_bytes").alias("legacy_size"))
    whole = files.where(~blank("path") & ~blank("hash_content") & ~blank("hash_path") & F.col("deleted_epoch").isNull())
    whole = whole.select(F.col("file_id").alias("canonical_id"), F.col("path").alias("rebuilt_path"), F.col("size_bytes").alias("canonical_size"))
    return legacy.join(whole, "rebuilt_path"), legacy.join(whole, "rebuilt_path", "left_anti")


def shared_inodes(files: DataFrame) -> DataFrame:
    """(device, inode) pairs with several active rows, ids and paths in order of id."""
    one = F.sort_array(F.collect_list(F.struct("file_id", "path")))
    groups = files.where("deleted_epoch is null and inode is not null").groupBy("filesystem_device", "inode").agg(F.count("*").alias("n"), one.alias("_m")).where("n > 1")
    return groups.select("filesystem_device", "inode", "n", F.array_join(F.transform("_m", lambda m: m["file_id"].cast("string")), ",").alias("file_ids"), F.array_join(F.transform("_m", lambda m: m["path"]), ",").alias("paths"))


def identity_events(events: DataFrame, top: int = 200) -> DataFrame:
    """Newest events whose identity decision needs a person."""
    open_ = events.where((F.col("event_status") != "invalidated") & (F.col("confidence_level").isin("medium", "low") | (F.col("event_type") == "IDENTITY_AMBIGUOUS")))
    return open_.orderBy(F.desc("event_epoch"), F.desc("event_id")).limit(top)


def mutation_mismatch(files: DataFrame, events: DataFrame) -> DataFrame:
    """Files whose latest event type differs from the stored one."""
    last = events.groupBy("file_id").agg(F.max_by("event_type", F.struct("event_epoch", "event_id")).alias("latest_event"))
    return files.join(last, "file_id").where(~F.col("latest_event").eqNullSafe(F.col("last_mutation_type"))).select("file_id", "last_mutation_type", "latest_event")


def stale_paths(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Active rows whose path the snapshot no longer has."""
    return files.where("deleted_epoch is null").join(snapshot, "path", "left_anti")


def files_per_day(files: DataFrame, zone: str = "Europe/Amsterdam") -> DataFrame:
    """Files by local day of creation, with the overall hourly rate (null where all fall within an hour)."""
    day = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("created_epoch"), zone), "yyyy-MM-dd")
    span = (F.max("created_epoch") - F.min("created_epoch")) / 3600.0
    rate = files.agg(F.when(span >= 1, F.round(F.count("*") / span, 4)).alias("files_per_hour"))
    return files.groupBy(day.alias("day")).agg(F.count("*").alias("files")).crossJoin(F.broadcast(rate))  # one row


def changed_since(files: DataFrame, as_of: int, seconds: int, column: str = "updated_epoch") -> DataFrame:
    return files.where((F.col(column) > as_of - seconds) & (F.col(column) <= as_of))


def session_progress(stream: DataFrame) -> DataFrame:
    """Found, queued and done jobs of each session, its percentage and whether it is complete."""
    counts = stream.groupBy("session_id").agg(F.count("*").alias("discovered"), count_if(F.col("event") != "DELETE").alias("enqueued"), count_if(F.col("event").isin("MOVE", "UPSERT")).alias("processed"))
    return counts.withColumns({"percent": F.round(F.try_divide(F.lit(100.0) * F.col("processed"), F.col("enqueued").cast("double")), 2), "complete": F.col("processed") >= F.col("enqueued")})


def below(files: DataFrame, folders: DataFrame, prefix: str, extensions: list[str]) -> DataFrame:
    """Active documents below a prefix with their folder's path."""
    named = folders.select(F.col("id").alias("folder_id"), F.col("path").alias("folder"))
    return files.where(F.col("path").startswith(prefix + "/") & F.col("extension").isin(extensions) & F.col("deleted_epoch").isNull()).join(named, "folder_id").select("file_id", "path", "folder", "size_bytes")


def categories(files: DataFrame) -> DataFrame:
    """Active files with category and action scope by ordered rules."""
    ext, path = F.lower(F.coalesce("extension", F.lit(""))), F.col("path")
    rules = [
        ("cache_or_temporary", path.rlike(r"(?i)(^|/)(@eaDir|__pycache__|node_modules|\.cache|cache|temp|tmp)(/|$)") | ext.isin("tmp", "temp", "crdownload", "part", "pyc")),
        ("secret", ext.isin(SECRET_FILES)),
        ("application_data", path.rlike(r"(?i)^/data/(docker|web)(/|$)")),
        ("backup_or_archive", path.rlike(r"(?i)(^|/)(backup|backups|archive|archief|CloudStation)(/|$)")),
        ("project", path.rlike(r"(?i)(^|/)(projects?|development|repositories|repos)(/|$)") | path.rlike(r"(?i)(^|/)\.git(/|$)")),
        ("personal_media_candidate", ext.isin(MEDIA)),
        ("personal_document_candidate", ext.isin(OFFICE)),
    ]
    category = F.lit("unknown")
    for name, test in reversed(rules):
        category = F.when(test, F.lit(name)).otherwise(category)
    scope = F.when(F.col("category").isin("personal_document_candidate", "personal_media_candidate", "project"), F.lit("review_required")).otherwise(F.lit("not_eligible"))
    return files.where("deleted_epoch is null").withColumn("category", category).withColumn("action_scope", scope)


def hashed(files: DataFrame) -> DataFrame:
    """Active rows that can be compared by content."""
    return files.where(F.col("deleted_epoch").isNull() & ~blank("hash_content") & F.col("size_bytes").isNotNull())


def shared_between_roots(files: DataFrame) -> DataFrame:
    """Contents that two roots share, once for each pair of roots."""
    per_root = hashed(files).select("hash_content", "size_bytes", root_of(F.col("path")).alias("root")).distinct()
    right = per_root.select("hash_content", "size_bytes", F.col("root").alias("root_b"))
    pairs = per_root.withColumnRenamed("root", "root_a").join(right, ["hash_content", "size_bytes"]).where("root_b > root_a")
    return pairs.groupBy("root_a", "root_b").agg(F.count("*").alias("shared_contents"), F.sum("size_bytes").alias("shared_bytes"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, filled, distinct) of each column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(f"f_{c}") for c in columns], *[F.countDistinct(F.col(c)).alias(f"d_{c}") for c in columns])
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"f_{c}")).alias("nulls"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("distinct_values")) for c in columns]))
    return counts.select(one.alias("x")).select("x.*")


def shift_before(df: DataFrame, column: str, boundary: int, seconds: int, applied: DataFrame) -> DataFrame:
    """Moves times before a boundary by an offset, unless the history says that this was done."""
    done = applied.limit(1).select(F.lit(True).alias("_done"))
    flagged = df.join(F.broadcast(done), how="left")  # one row at most
    return flagged.withColumn(column, F.when(F.col("_done").isNull() & (F.col(column) < boundary), F.col(column) + seconds).otherwise(F.col(column))).drop("_done")

"""Queries of inventory, integrity, cleanup and assessment (I), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import inventory as ops
from foliant.plans.registry import query
from foliant.sources.fixtures import AS_OF

STATUS = """case when path is null or path = '' then 'LEGACY_MISSING_PATH' when folder_id is null then 'INVALID_MISSING_FOLDER'
  when hash_path is null or hash_path = '' then 'INCOMPLETE_MISSING_HASH_PATH' when hash_content is null or hash_content = '' then 'INCOMPLETE_MISSING_HASH_CONTENT'
  when mime_type is null or mime_type = '' then 'INCOMPLETE_MISSING_MIME' when deleted_epoch is not null then 'DELETED' else 'VALID' end"""
SCORE = """case when path is null or path = '' then 25 when folder_id is null then 20 when hash_path is null or hash_path = '' then 60
  when hash_content is null or hash_content = '' then 70 when mime_type is null or mime_type = '' then 80 when deleted_epoch is not null then 90 else 100 end"""
ROOT = "coalesce(nullif(regexp_extract(path, '^/data/([^/]+)', 1), ''), '[root]')"
HASHED = "deleted_epoch is null and hash_content is not null and hash_content <> '' and size_bytes is not null"
LEGACY = """legacy as (select f.file_id as legacy_id, d.path || '/' || f.filename as rebuilt_path, f.size_bytes as legacy_size from inventory f join folders d on d.id = f.folder_id
  where coalesce(f.path, '') = '' and coalesce(f.hash_content, '') = '' and coalesce(f.hash_path, '') = '' and coalesce(f.filename, '') <> ''),
whole as (select file_id as canonical_id, path as rebuilt_path, size_bytes as canonical_size from inventory
  where coalesce(path, '') <> '' and coalesce(hash_content, '') <> '' and coalesce(hash_path, '') <> '' and deleted_epoch is null)"""


@query("i01_integrity_status", f"select file_id, {STATUS} as integrity_status, {SCORE} as integrity_score from inventory")
def _(v):
    return ops.integrity(v.inventory).select("file_id", "integrity_status", "integrity_score")


@query("i02_integrity_problems", """select file_id, array_to_string(list_filter([case when coalesce(path, '') = '' then 'missing_path' end, case when folder_id is null then 'missing_folder_id' end,
  case when coalesce(hash_path, '') = '' then 'missing_hash_path' end, case when coalesce(hash_content, '') = '' then 'missing_hash_content' end,
  case when coalesce(mime_type, '') = '' then 'missing_mime_type' end, case when deleted_epoch is not null then 'deleted' end], lambda x: x is not null), ',') as problems from inventory""")
def _(v):
    return ops.integrity(v.inventory).select("file_id", F.array_join("problems", ",").alias("problems"))


@query("i03_integrity_summary", f"select {STATUS} as integrity_status, count(*) as files, round(avg({SCORE}), 2) as average_score from inventory group by 1")
def _(v):
    return ops.integrity_summary(v.inventory)


@query("i04_audit_counts", """select count(*) as total, count(*) filter (coalesce(path, '') = '') as no_path, count(*) filter (coalesce(hash_path, '') = '') as no_hash_path,
  count(*) filter (coalesce(hash_content, '') = '') as no_hash_content, count(*) filter (coalesce(mime_type, '') = '') as no_mime from inventory""")
def _(v):
    return ops.audit_counts(v.inventory)


@query("i05_duplicate_names", "select folder_id, filename, count(*) as n from inventory group by 1, 2 having count(*) > 1 order by n desc, folder_id nulls last, filename limit 50")
def _(v):
    return ops.duplicate_groups(v.inventory, ["folder_id", "filename"]).orderBy(F.desc("n"), F.asc_nulls_last("folder_id"), "filename").limit(50)


@query("i06_missing_links", """select 'files_without_metadata' as metric, count(*) as value from inventory f where not exists (select 1 from metadata m where m.file_id = f.file_id)
union all select 'metadata_without_file', count(*) from metadata m where not exists (select 1 from inventory f where m.file_id = f.file_id)
union all select 'folders_without_files', count(*) from folders d where not exists (select 1 from inventory f where f.folder_id = d.id)""")
def _(v):
    return ops.missing_links(v.inventory, v.metadata, v.folders)


@query("i07_cleanup", r"""with recursive alive as (select id from folders where parent_id is null and path not like '%/@%'
  union all select f.id from folders f join alive a on f.parent_id = a.id where f.path not like '%/@%'),
kept as (select * from inventory where folder_id in (select id from alive) and not (filename like '~$%' or filename like '._%' or filename in ('.DS_Store', 'Thumbs.db') or regexp_matches(filename, '\.(tmp|swp|bak)$')))
select 'files' as kind, count(*) as kept, (select count(*) from inventory) - count(*) as removed from kept
union all select 'folders', count(*), (select count(*) from folders) - count(*) from alive
union all select 'metadata', count(*), (select count(*) from metadata) - count(*) from metadata where file_id in (select file_id from kept)""")
def _(v):
    out = None
    for kind, before, after in zip(("files", "folders", "metadata"), (v.inventory, v.folders, v.metadata), ops.cleanup(v.inventory, v.folders, v.metadata), strict=True):
        rows = after.select(F.lit(1).alias("k"), F.lit(0).alias("a")).unionByName(before.select(F.lit(0).alias("k"), F.lit(1).alias("a")))
        one = rows.agg(F.lit(kind).alias("kind"), F.sum("k").alias("kept"), (F.sum("a") - F.sum("k")).alias("removed"))
        out = one if out is None else out.unionByName(one)
    return out


@query("i08_legacy_metrics", f"""select 'files_total' as metric, count(*) as value from inventory union all select 'files_active', count(*) from inventory where deleted_epoch is null
union all select 'files_deleted', count(*) from inventory where deleted_epoch is not null union all select 'folders_total', count(*) from folders
union all select 'metadata_total', count(*) from metadata union all select 'missing_path', count(*) from inventory where coalesce(path, '') = ''
union all select 'missing_mime_type', count(*) from inventory where coalesce(mime_type, '') = ''
union all select 'duplicate_hash_groups', count(*) from (select 1 from inventory where coalesce(hash_content, '') <> '' group by hash_content having count(*) > 1)
union all select 'duplicate_name_size_groups', count(*) from (select 1 from inventory where size_bytes > 0 group by lower(filename), size_bytes having count(*) > 1)""")
def _(v):
    f = v.inventory
    one = f.agg(F.count("*").alias("files_total"), F.count_if(F.col("deleted_epoch").isNull()).alias("files_active"), F.count("deleted_epoch").alias("files_deleted"), F.count_if(ops.blank("path")).alias("missing_path"), F.count_if(ops.blank("mime_type")).alias("missing_mime_type"))
    out = one.unpivot([], ["files_total", "files_active", "files_deleted", "missing_path", "missing_mime_type"], "metric", "value")
    others = {
        "folders_total": v.folders,
        "metadata_total": v.metadata,
        "duplicate_hash_groups": ops.duplicate_groups(f, ["hash_content"], ~ops.blank("hash_content")),
        "duplicate_name_size_groups": ops.duplicate_groups(f, [F.lower("filename").alias("name"), "size_bytes"], F.col("size_bytes") > 0),
    }
    for name, rows in others.items():
        out = out.unionByName(rows.agg(F.lit(name).alias("metric"), F.count("*").alias("value")))
    return out


@query("i09_extension_profile", """select coalesce(nullif(lower(extension), ''), '<none>') as extension, count(*) as files, count(*) filter (deleted_epoch is null) as active,
  count(*) filter (coalesce(hash_content, '') = '') as no_hash, count(*) filter (coalesce(mime_type, '') = '') as no_mime from inventory group by 1 order by files desc, 1 limit 100""")
def _(v):
    return ops.extension_profile(v.inventory)


NOISE = "select *, case file_id % 9 when 0 then concat('.', filename) when 1 then concat('@', filename) when 2 then 'Thumbs.db' else filename end as f2, case when file_id % 10 = 3 then 'BAK' else extension end as e2, case file_id % 13 when 4 then concat('/data/@eaDir/', filename) when 5 then concat('/data/#recycle/', filename) when 6 then concat('/data/.Trash-1/', filename) else path end as p2 from files"


@query("i10_noise", f"""select file_id, reason from (select file_id, case when p2 like '%/@eaDir/%' then 'thumbnail_folder' when p2 like '%/#recycle/%' then 'recycle_bin' when p2 like '%/.Trash%' then 'trash'
  when f2 like '@%' then 'system_prefix' when f2 like '.%' then 'dotfile' when lower(f2) in ('.ds_store', 'thumbs.db', 'desktop.ini') then 'system_file'
  when lower(e2) in ('tmp','temp','bak','old','orig','swp','log','ini','db','sieve','core') then 'low_value_extension' end as reason from ({NOISE})) where reason is not null""")
def _(v):
    rows = v.spark.sql(NOISE.replace("from files", "from {files}"), files=v.files).drop("filename", "extension", "path")
    return ops.noise(rows.withColumnsRenamed({"f2": "filename", "e2": "extension", "p2": "path"})).select("file_id", "reason")


def samples() -> list:
    return [F.countDistinct("folder_id").alias("folders"), F.count_if(ops.blank("path")).alias("legacy"), F.min("file_id").alias("canonical_id"), F.min("path").alias("sample_path")]
SAMPLES_SQL = "count(*) as n, count(distinct folder_id) as folders, count(*) filter (coalesce(path, '') = '') as legacy, min(file_id) as canonical_id, min(path) as sample_path"


@query("i11_duplicate_hashes", "select hash_content, count(*) as n, min(file_id) as canonical_id, min(path) as sample_path, sum(coalesce(size_bytes, 0))::bigint as total_bytes from inventory where coalesce(hash_content, '') <> '' and deleted_epoch is null group by 1 having count(*) > 1")
def _(v):
    where = ~ops.blank("hash_content") & F.col("deleted_epoch").isNull()
    return ops.duplicate_groups(v.inventory, ["hash_content"], where, [F.min("file_id").alias("canonical_id"), F.min("path").alias("sample_path"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_bytes")])


@query("i11b_duplicate_rebuilt_paths", """select effective_path, count(*) as n, count(*) filter (coalesce(path, '') = '') as legacy, min(file_id) as canonical_id from (
  select f.*, coalesce(nullif(f.path, ''), d.path || '/' || f.filename) as effective_path from inventory f left join folders d on d.id = f.folder_id) where effective_path is not null group by 1 having count(*) > 1""")
def _(v):
    named = v.folders.select(F.col("id").alias("folder_id"), F.col("path").alias("_folder"))
    rows = v.inventory.join(named, "folder_id", "left").withColumn("effective_path", F.coalesce(F.nullif("path", F.lit("")), F.concat("_folder", F.lit("/"), "filename")))
    return ops.duplicate_groups(rows, ["effective_path"], F.col("effective_path").isNotNull(), [F.count_if(ops.blank("path")).alias("legacy"), F.min("file_id").alias("canonical_id")])


@query("i11c_duplicate_name_size", f"select lower(filename) as filename_key, size_bytes, {SAMPLES_SQL} from inventory where size_bytes > 0 and coalesce(filename, '') <> '' group by 1, 2 having count(*) > 1")
def _(v):
    return ops.duplicate_groups(v.inventory, [F.lower("filename").alias("filename_key"), "size_bytes"], (F.col("size_bytes") > 0) & ~ops.blank("filename"), samples())


@query("i11d_duplicate_signature", f"select lower(filename) as filename_key, size_bytes, modified_at_fs, {SAMPLES_SQL} from inventory where size_bytes > 0 and modified_at_fs is not null group by 1, 2, 3 having count(*) > 1")
def _(v):
    return ops.duplicate_groups(v.inventory, [F.lower("filename").alias("filename_key"), "size_bytes", "modified_at_fs"], (F.col("size_bytes") > 0) & F.col("modified_at_fs").isNotNull(), samples())


@query("i11e_duplicate_inode", f"select inode, modified_at_fs, size_bytes, {SAMPLES_SQL} from inventory where inode is not null and modified_at_fs is not null and size_bytes is not null group by 1, 2, 3 having count(*) > 1")
def _(v):
    return ops.duplicate_groups(v.inventory, ["inode", "modified_at_fs", "size_bytes"], F.expr("inode is not null and modified_at_fs is not null and size_bytes is not null"), samples())


@query("i12_rebuildable_paths", "select f.file_id, d.path || '/' || f.filename as rebuilt_path, f.size_bytes from inventory f join folders d on d.id = f.folder_id where coalesce(f.path, '') = '' and coalesce(f.filename, '') <> '' and coalesce(d.path, '') <> ''")
def _(v):
    named = v.folders.where(~ops.blank("path")).select(F.col("id").alias("folder_id"), F.col("path").alias("_folder"))
    return v.inventory.where(ops.blank("path") & ~ops.blank("filename")).join(named, "folder_id").select("file_id", F.concat_ws("/", "_folder", "filename").alias("rebuilt_path"), "size_bytes")


@query("i12b_missing_fields", "select file_id, coalesce(hash_content, '') = '' as no_hash_content, coalesce(hash_path, '') = '' as no_hash_path, coalesce(mime_type, '') = '' as no_mime from inventory where coalesce(path, '') = '' or coalesce(hash_content, '') = '' or coalesce(hash_path, '') = '' or coalesce(mime_type, '') = ''")
def _(v):
    gaps = {"no_hash_content": ops.blank("hash_content"), "no_hash_path": ops.blank("hash_path"), "no_mime": ops.blank("mime_type")}
    return v.inventory.withColumns(gaps).where(ops.blank("path") | F.col("no_hash_content") | F.col("no_hash_path") | F.col("no_mime")).select("file_id", *gaps)


@query("i13_legacy_candidates", f"with {LEGACY} select *, legacy_size is distinct from canonical_size as size_mismatch from legacy join whole using (rebuilt_path)")
def _(v):
    found, _ = ops.legacy_match(v.inventory, v.folders)
    return found.withColumn("size_mismatch", ~F.col("legacy_size").eqNullSafe(F.col("canonical_size")))


@query("i13b_legacy_blocked", f"with {LEGACY} select legacy_id, rebuilt_path, legacy_size from legacy l where not exists (select 1 from whole w where w.rebuilt_path = l.rebuilt_path)")
def _(v):
    return ops.legacy_match(v.inventory, v.folders)[1].select("legacy_id", "rebuilt_path", "legacy_size")


@query("i13c_legacy_cascade", f"with {LEGACY}, c as (select * from legacy join whole using (rebuilt_path)) select c.legacy_id, c.canonical_id, count(distinct m.metadata_id) as metadata_rows from c left join metadata m on m.file_id = c.legacy_id or m.file_id = c.canonical_id group by all")
def _(v):
    found, _ = ops.legacy_match(v.inventory, v.folders)
    ids = found.select("legacy_id", "canonical_id", F.explode(F.array("legacy_id", "canonical_id")).alias("file_id"))
    return ids.join(v.metadata, "file_id", "left").groupBy("legacy_id", "canonical_id").agg(F.countDistinct("metadata_id").alias("metadata_rows"))


@query("i14_shared_inodes", "select filesystem_device, inode, count(*) as n, string_agg(file_id::varchar, ',' order by file_id) as file_ids, string_agg(path, ',' order by file_id) as paths from files where deleted_epoch is null group by 1, 2 having count(*) > 1")
def _(v):
    return ops.shared_inodes(v.files)


@query("i15_identity_events", "select event_id, file_id, event_type, confidence_level from file_events where event_status <> 'invalidated' and (confidence_level in ('medium', 'low') or event_type = 'IDENTITY_AMBIGUOUS') order by event_epoch desc, event_id desc limit 200")
def _(v):
    return ops.identity_events(v.file_events).select("event_id", "file_id", "event_type", "confidence_level")


@query("i16_mutation_mismatch", """with last as (select file_id, arg_max(event_type, event_epoch * 1000000000 + event_id) as latest_event from file_events group by 1)
select file_id, last_mutation_type, latest_event from files join last using (file_id) where latest_event is distinct from last_mutation_type""")
def _(v):
    return ops.mutation_mismatch(v.files, v.file_events)


@query("i16b_stale_paths", "select file_id, path from files f where deleted_epoch is null and not exists (select 1 from scan_now s where s.path = f.path)")
def _(v):
    return ops.stale_paths(v.files, v.scan_now).select("file_id", "path")


@query("i17_files_per_day", """with r as (select case when max(created_epoch) - min(created_epoch) >= 3600 then round(count(*) / ((max(created_epoch) - min(created_epoch)) / 3600.0), 4) end as files_per_hour from files)
select strftime(timezone('Europe/Amsterdam', to_timestamp(created_epoch)), '%Y-%m-%d') as day, count(*) as files, any_value(files_per_hour) as files_per_hour from files, r group by 1""")
def _(v):
    return ops.files_per_day(v.files)


@query("i18_recent_files", f"select file_id, updated_epoch from files where updated_epoch > {AS_OF} - 2592000 and updated_epoch <= {AS_OF}")
def _(v):
    return ops.changed_since(v.files, AS_OF, 30 * 86400).select("file_id", "updated_epoch")


@query("i19_session_progress", """select session_id, count(*) as discovered, count(*) filter (event <> 'DELETE') as enqueued, count(*) filter (event in ('MOVE', 'UPSERT')) as processed,
  round(100.0 * count(*) filter (event in ('MOVE', 'UPSERT')) / nullif(count(*) filter (event <> 'DELETE'), 0), 2)::double as percent, count(*) filter (event in ('MOVE', 'UPSERT')) >= count(*) filter (event <> 'DELETE') as complete from stream group by 1""")
def _(v):
    return ops.session_progress(v.stream)


@query("i20_documents_below", "select f.file_id, f.path, d.path as folder, f.size_bytes from files f join folders d on d.id = f.folder_id where starts_with(f.path, '/data/src1/') and f.extension in ('pdf', 'docx') and f.deleted_epoch is null")
def _(v):
    return ops.below(v.files, v.folders, "/data/src1", ["pdf", "docx"])


@query("i21_root_inventory", f"select {ROOT} as root, count(*) as files, coalesce(sum(size_bytes), 0)::bigint as total_bytes from files where deleted_epoch is null group by 1")
def _(v):
    return v.files.where("deleted_epoch is null").groupBy(ops.root_of(F.col("path")).alias("root")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


@query("i22_categories", r"""with c as (select file_id, size_bytes, case when regexp_matches(path, '(?i)(^|/)(@eaDir|__pycache__|node_modules|\.cache|cache|temp|tmp)(/|$)') or lower(extension) in ('tmp', 'temp', 'crdownload', 'part', 'pyc') then 'cache_or_temporary'
  when lower(extension) in ('key', 'pem', 'p12', 'pfx', 'ovpn', 'kdbx') then 'secret' when regexp_matches(path, '(?i)^/data/(docker|web)(/|$)') then 'application_data'
  when regexp_matches(path, '(?i)(^|/)(backup|backups|archive|archief|CloudStation)(/|$)') then 'backup_or_archive' when regexp_matches(path, '(?i)(^|/)(projects?|development|repositories|repos|\.git)(/|$)') then 'project'
  when lower(extension) in ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'tif', 'tiff', 'heic', 'mp3', 'wav', 'flac', 'm4a', 'mp4', 'mkv', 'avi', 'mov', 'mts') then 'personal_media_candidate'
  when lower(extension) in ('txt', 'md', 'pdf', 'doc', 'docx', 'rtf', 'odt', 'xls', 'xlsx', 'ods', 'csv', 'ppt', 'pptx', 'odp', 'html', 'htm', 'xml') then 'personal_document_candidate' else 'unknown' end as category from files where deleted_epoch is null)
select category, count(*) as files, coalesce(sum(size_bytes), 0)::bigint as total_bytes, case when category in ('personal_document_candidate', 'personal_media_candidate', 'project') then 'review_required' else 'not_eligible' end as action_scope from c group by category""")
def _(v):
    return ops.categories(v.files).groupBy("category", "action_scope").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))


@query("i23_duplicate_savings", f"select count(*) as groups, sum(n)::bigint as files, sum(n - 1)::bigint as extra, sum((n - 1) * size_bytes)::bigint as savings from (select hash_content, size_bytes, count(*) as n from files where {HASHED} group by 1, 2 having count(*) > 1)")
def _(v):
    groups = ops.duplicate_groups(ops.hashed(v.files), ["hash_content", "size_bytes"])
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("files"), F.sum(F.col("n") - 1).alias("extra"), F.sum((F.col("n") - 1) * F.col("size_bytes")).alias("savings"))


@query("i23b_roots_with_duplicates", f"select {ROOT} as root, count(*) as files, sum(size_bytes)::bigint as total_bytes from files f where deleted_epoch is null and exists (select 1 from (select hash_content, size_bytes from files where {HASHED} group by 1, 2 having count(*) > 1) d where d.hash_content = f.hash_content and d.size_bytes = f.size_bytes) group by 1")
def _(v):
    groups = ops.duplicate_groups(ops.hashed(v.files), ["hash_content", "size_bytes"])
    rows = v.files.where("deleted_epoch is null").join(groups, ["hash_content", "size_bytes"], "left_semi")
    return rows.groupBy(ops.root_of(F.col("path")).alias("root")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))


@query("i24_repeated_folder_names", """with n as (select lower(regexp_replace(regexp_replace(path, '^.*/', ''), '[^A-Za-z0-9]', '', 'g')) as name, path from folders where path is not null),
s as (select name, count(distinct path) as k from n where name <> '' group by 1 having count(distinct path) > 1) select count(*) as names, sum(k)::bigint as paths, max(k) as largest from s""")
def _(v):
    name = F.lower(F.regexp_replace(F.regexp_replace("path", "^.*/", ""), "[^A-Za-z0-9]", ""))
    groups = v.folders.where("path is not null").groupBy(name.alias("name")).agg(F.countDistinct("path").alias("k")).where("name <> '' and k > 1")
    return groups.agg(F.count("*").alias("names"), F.sum("k").alias("paths"), F.max("k").alias("largest"))


@query("i25_target_split", "select count(*) filter (starts_with(path, '/data/src0/')) as inside, coalesce(sum(size_bytes) filter (starts_with(path, '/data/src0/')), 0)::bigint as inside_bytes, count(*) filter (not starts_with(path, '/data/src0/')) as outside from files where deleted_epoch is null")
def _(v):
    inside = F.col("path").startswith("/data/src0/")
    return v.files.where("deleted_epoch is null").agg(F.count_if(inside).alias("inside"), F.coalesce(F.sum(F.when(inside, F.col("size_bytes"))), F.lit(0)).alias("inside_bytes"), F.count_if(~inside).alias("outside"))


@query("i26_root_components", "select regexp_extract(path, '^/data/([^/]+)', 1) as root, coalesce(nullif(regexp_extract(path, '^/data/[^/]+/([^/]+)/', 1), ''), '[direct]') as component, count(*) as files, sum(size_bytes)::bigint as total_bytes from files where deleted_epoch is null and path like '/data/%' group by 1, 2")
def _(v):
    rows = v.files.where("deleted_epoch is null and path like '/data/%'")
    part = F.coalesce(F.nullif(F.regexp_extract("path", "^/data/[^/]+/([^/]+)/", 1), F.lit("")), F.lit("[direct]"))
    return rows.groupBy(F.regexp_extract("path", "^/data/([^/]+)", 1).alias("root"), part.alias("component")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))


@query("i26b_largest_direct_files", "select file_id, path, size_bytes from files where deleted_epoch is null and regexp_matches(path, '^/data/[^/]+/work/[^/]+$') order by size_bytes desc nulls last, path limit 100")
def _(v):
    return v.files.where(F.col("deleted_epoch").isNull() & F.col("path").rlike("^/data/[^/]+/work/[^/]+$")).orderBy(F.desc_nulls_last("size_bytes"), "path").limit(100).select("file_id", "path", "size_bytes")


@query("i27_shared_between_roots", f"""with r as (select distinct hash_content, size_bytes, {ROOT} as root from files where {HASHED})
select a.root as root_a, b.root as root_b, count(*) as shared_contents, sum(a.size_bytes)::bigint as shared_bytes from r a join r b on a.hash_content = b.hash_content and a.size_bytes = b.size_bytes and b.root > a.root group by 1, 2""")
def _(v):
    return ops.shared_between_roots(v.files)


@query("i28_duplicates_inside_roots", f"""with g as (select {ROOT} as root, hash_content, size_bytes, count(*) as n from files where {HASHED} group by 1, 2, 3 having count(*) > 1)
select root, count(*) as groups, sum(n - 1)::bigint as extra, sum((n - 1) * size_bytes)::bigint as savings from g group by root""")
def _(v):
    groups = ops.duplicate_groups(ops.hashed(v.files), [ops.root_of(F.col("path")).alias("root"), "hash_content", "size_bytes"])
    return groups.groupBy("root").agg(F.count("*").alias("groups"), F.sum(F.col("n") - 1).alias("extra"), F.sum((F.col("n") - 1) * F.col("size_bytes")).alias("savings"))


@query("i28b_root_roles", f"select {ROOT} as root, count(*) as files, case when {ROOT} = 'src0' then 'canonical_target' when {ROOT} in ('src1', 'src2') then 'application_or_system_excluded' when {ROOT} = 'src3' then 'legacy_or_backup_source' else 'unknown_requires_review' end as role from files where deleted_epoch is null group by all")
def _(v):
    root = F.col("root")
    role = F.when(root == "src0", "canonical_target").when(root.isin("src1", "src2"), "application_or_system_excluded").when(root == "src3", "legacy_or_backup_source").otherwise("unknown_requires_review")
    return v.files.where("deleted_epoch is null").groupBy(ops.root_of(F.col("path")).alias("root")).agg(F.count("*").alias("files")).withColumn("role", role)


@query("i29_event_types", "select event_type, count(*) as n, min(event_epoch) as first_epoch, max(event_epoch) as last_epoch, count(*) filter (event_status = 'invalidated') as invalidated from file_events group by 1")
def _(v):
    return v.file_events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_epoch").alias("first_epoch"), F.max("event_epoch").alias("last_epoch"), F.count_if(F.col("event_status") == "invalidated").alias("invalidated"))


@query("i30_column_profile", " union all ".join(f"select '{c}' as \"column\", count(*) - count({c}) as nulls, count({c}) as filled, count(distinct {c}) as distinct_values from inventory" for c in ("path", "mime_type", "hash_content", "folder_id", "source")))
def _(v):
    return ops.profile(v.inventory, ["path", "mime_type", "hash_content", "folder_id", "source"])


@query("i30b_counts_by_source", "select source, last_mutation_type, count(*) as n from inventory group by 1, 2")
def _(v):
    return v.inventory.groupBy("source", "last_mutation_type").agg(F.count("*").alias("n"))


@query("i31_overview", f"select count(*) as total, count(*) filter (deleted_epoch is null) as active, coalesce(sum(size_bytes) filter (deleted_epoch is null), 0)::bigint as active_bytes, count(*) filter (updated_epoch > {AS_OF} - 2592000) as recent, count(distinct folder_id) as folders from inventory")
def _(v):
    active = F.col("deleted_epoch").isNull()
    return v.inventory.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.coalesce(F.sum(F.when(active, F.col("size_bytes"))), F.lit(0)).alias("active_bytes"), F.count_if(F.col("updated_epoch") > AS_OF - 2592000).alias("recent"), F.countDistinct("folder_id").alias("folders"))


@query("i31b_recent_sessions", "select session_id, count(*) as events, max(ts) as last_ts from stream group by 1 order by last_ts desc limit 8")
def _(v):
    return v.stream.groupBy("session_id").agg(F.count("*").alias("events"), F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts")).limit(8)


@query("i32_time_shift", "select file_id, case when created_epoch < 1735689600 then created_epoch + 7200 else created_epoch end as created_epoch from files")
def _(v):
    return ops.shift_before(v.files, "created_epoch", 1735689600, 7200, v.files.where("file_id is null")).select("file_id", "created_epoch")


@query("i33_name_classes", "select folder_id, filename, count(*) as n, count(*) filter (coalesce(path, '') = '') as legacy, count(*) filter (coalesce(path, '') <> '') as valid from inventory group by 1, 2 having count(*) > 1 order by n desc, legacy desc, folder_id nulls last, filename limit 100")
def _(v):
    groups = ops.duplicate_groups(v.inventory, ["folder_id", "filename"], None, [F.count_if(ops.blank("path")).alias("legacy"), F.count_if(~ops.blank("path")).alias("valid")])
    return groups.orderBy(F.desc("n"), F.desc("legacy"), F.asc_nulls_last("folder_id"), "filename").limit(100)

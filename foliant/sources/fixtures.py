"""Inventory-shaped views over the given tables.

Each view is one SELECT that Spark and DuckDB read alike (``SHA(x)`` stands for the hex SHA-256), so that
queries and their SQL twins start from the same rows. ``Views`` builds them as DataFrames on demand.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The moment queries are asked for, in seconds since 1970: 2026-01-01 00:00:00 UTC.
AS_OF = 1767225600

VIEWS = {
    "files": """
select file_id, folder_id, folder_path, concat(folder_path, '/', filename) as path, filename, extension, size_bytes,
  case when file_id % 29 = 0 or file_id % 97 = 0 then null else SHA(text) end as content_sha256,
  case when file_id % 41 = 0 then null else SHA(concat(folder_path, '/', filename)) end as hash_path,
  case when file_id % 43 = 0 then null else SHA(substring(text, 1, 1024)) end as hash_content,
  case when file_id % 47 = 0 then null when extension = 'pdf' then 'application/pdf' when extension = 'txt' then 'text/plain'
    when extension = 'docx' then 'application/msword' else 'application/vnd.ms-excel' end as mime_type,
  1704067200 + (file_id * 7919) % 63072000 as modified_at_fs,
  1704067200 + (file_id * 104729) % 63072000 as created_epoch,
  1704067200 + (file_id * 104729) % 63072000 + (file_id % 17) * 3600 as updated_epoch,
  case when file_id % 50 = 1 then 999 + file_id else 1000 + file_id end as inode,
  cast(floor(file_id / 100) as bigint) % 2 as filesystem_device,
  case when file_id % 37 = 0 then 1748736000 end as deleted_epoch,
  case when file_id % 37 = 0 then 'DELETED' when file_id % 5 = 0 then 'MODIFIED' else 'CREATED' end as last_mutation_type,
  case when file_id % 31 = 0 then null when file_id % 2 = 0 then 'POLLING' else 'REALTIME' end as source,
  lang
from (
  select doc_id as file_id, text, lang, folder_path,
    case when doc_id % 59 = 0 then null else 10 + cast(substring(source, 4) as int) * 6 + cast(doc_id % 6 as int) end as folder_id,
    concat('report_', cast(cast(floor(doc_id / 3) as bigint) as varchar(20)),
      case doc_id % 7 when 2 then ' copy' when 4 then '(1)' else '' end, '.', extension) as filename,
    extension, case when doc_id % 97 = 0 then 0 else n_chars end as size_bytes
  from (
    select *, concat('/data/', source, '/', case doc_id % 6 when 0 then 'archive' when 1 then 'Study' when 2 then 'work'
        when 3 then 'backup/old' when 4 then 'finance' else 'home' end) as folder_path,
      case doc_id % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'xlsx' else 'txt' end as extension
    from documents) d) f""",
    "legacy_files": """
select file_id + 10000000 as file_id, folder_id, folder_path, cast(null as varchar(400)) as path, filename, extension,
  case when file_id % 106 = 0 then size_bytes + 7 else size_bytes end as size_bytes, cast(null as varchar(64)) as content_sha256,
  cast(null as varchar(64)) as hash_path, cast(null as varchar(64)) as hash_content, cast(null as varchar(64)) as mime_type,
  modified_at_fs, created_epoch, updated_epoch, inode, filesystem_device, deleted_epoch, last_mutation_type, source, lang
from files where file_id % 53 = 0""",
    "inventory": "select * from files union all select * from legacy_files",
    "folders": """
select distinct folder_id as id, folder_path as path, 1000 + cast(floor((folder_id - 10) / 6) as bigint) as parent_id from files where folder_id is not null
union all select distinct 1000 + cast(floor((folder_id - 10) / 6) as bigint), concat('/data/src', cast(cast(floor((folder_id - 10) / 6) as bigint) as varchar(20))), 1 from files where folder_id is not null
union all select 1, '/data', cast(null as bigint)
union all select 2, '/data/@eaDir', 1
union all select 3, '/data/@eaDir/thumbs', 2
union all select 4, '/data/lost', 999999
union all select 5, '/data/lost/deep', 4""",
    "metadata": """
select file_id * 2 as metadata_id, file_id, case when file_id % 3 = 0 then null else extension end as detected_type from files where file_id % 11 <> 0
union all select (m + k) * 2 as metadata_id, m + k as file_id, null as detected_type
  from (select max(file_id) as m from files) x cross join (select distinct (event_id % 5) + 1 as k from events) y""",
    "file_events": """
select event_id, user_id as file_id, case event_type when 'click' then 'MODIFIED' when 'view' then 'IDENTITY_AMBIGUOUS' when 'error' then 'DELETED'
    when 'signup' then 'CREATED' else 'MOVED' end as event_type,
  case when value > 100 then 100.0 else value end as confidence_score,
  case when value >= 90 then 'high' when value >= 65 then 'medium' else 'low' end as confidence_level,
  case when event_id % 10 = 0 then 'invalidated' else 'active' end as event_status,
  1704067200 + event_id * 97 as event_epoch
from events""",
    "scan_now": "select path, size_bytes, inode, case when file_id % 19 = 0 then modified_at_fs + 60 else modified_at_fs end as mtime, file_id % 23 <> 0 as readable from files where file_id % 17 <> 0",
    "scan_prev": "select path, concat(cast(modified_at_fs as varchar(20)), ':', cast(size_bytes as varchar(20)), ':', cast(inode as varchar(20))) as signature, cast(file_id % 2 as int) as missing_count from files where file_id % 13 <> 0",
    "stream": """
select e.event_id, e.event_id as ts, f.path, f.file_id, f.folder_path, f.filename,
  case e.event_type when 'error' then 'DELETE' when 'signup' then 'CREATE' when 'purchase' then 'MOVE' else 'UPSERT' end as event,
  case when e.event_type = 'purchase' then concat('/data/moved/', f.filename) end as old_path,
  case when e.event_id % 3 = 0 then 'realtime' else 'polling' end as stream, cast(floor(e.event_id / 250) as bigint) as session_id,
  case when e.event_id % 211 = 0 then cast(null as bigint) else f.size_bytes end as size_bytes, f.modified_at_fs + e.event_id as mtime
from events e join files f on f.file_id = e.user_id""",
    "named_files": """
select file_id, folder_id, extension, size_bytes, content_sha256, modified_at_fs, deleted_epoch, lang,
  concat(folder_path, case file_id % 23 when 1 then '/Notebook/data' when 2 then '/notebook' when 3 then '/study/courses' else '' end) as folder_path,
  concat(case file_id % 19 when 1 then 'CV-' when 2 then 'python ' when 3 then 'Introductie cursus ' when 4 then 'api key ' when 5 then 'bank-' when 6 then 'salary tax ' when 7 then 'curriculum-vitae ' else '' end, regexp_replace(filename, '[.][a-z]+$', ''),
    case file_id % 17 when 1 then ' (kopie 2)' when 2 then '_nl' when 3 then '-2024-03-05' when 4 then ' 12.04.2025' when 5 then '_20240305' when 6 then ' 2023' when 7 then '-123456789' when 8 then ' - copy 3' when 9 then ' Engels' else '' end, '.', extension) as filename,
  concat('fam_', cast(file_id % 9 as varchar(4))) as document_family,
  case file_id % 11 when 0 then 'normal' when 1 then 'personal' when 2 then 'highly_sensitive' when 3 then 'Sensitive' end as sensitivity
from files""",
    "private_texts": """
select f.file_id, f.filename, f.folder_path, f.document_family, f.sensitivity,
  concat(case f.file_id % 31 when 1 then 'Rekening NL12ABCD0123456789 ' when 2 then 'BSN nummer: 123456789 ' when 3 then 'Uw burgerservicenummer ' when 4 then 'Bankrekeningnummer ' when 5 then 'rekeningnummer 12 ' when 6 then 'Paspoortnummer X1 '
    when 7 then 'Naam en adres, salaris ' when 8 then 'Hypotheek, 2135 NJ plaats ' when 9 then 'De heer X ontvangt rente ' when 10 then 'Naam en adres ' when 11 then 'Hypotheek ' when 12 then 'mevrouw ' else '' end, d.text) as text
from named_files f join documents d on d.doc_id = f.file_id""",
    "known_files": "select path, file_id, size_bytes, modified_at_fs, deleted_epoch from files where file_id % 3 <> 0",
    "persisted_groups": "select content_sha256, size_bytes, min(file_id) as golden_file_id, count(*) as member_count from files where content_sha256 is not null and size_bytes > 0 and file_id % 2 = 0 group by content_sha256, size_bytes",
    "evidence": """
select file_id, file_id * 8 + k as evidence_id, case when k % 2 = 0 then 'created' else 'modified' end as date_type,
  case k when 0 then 'office' when 1 then 'office' when 2 then 'pdf_info' else 'pdf_xmp' end as source_type,
  case when file_id % 5 = 0 then 'low' when k = 3 then 'high' else 'medium' end as confidence,
  case when file_id % 9 = k then cast(null as bigint)
    when file_id % 8 = 1 then modified_at_fs + k
    when file_id % 8 = 2 then modified_at_fs - modified_at_fs % 86400
    when file_id % 8 = 3 then modified_at_fs + k * 86400
    when file_id % 8 = 4 and k = 3 then 1798761600 + file_id
    when file_id % 8 = 5 and k = 0 then 0
    else modified_at_fs end as value_epoch,
  case when (file_id + k) % 4 = 0 then 'absent' when (file_id + k) % 4 = 1 then 'explicit_offset' else 'utc' end as timezone_status,
  modified_at_fs, case when file_id % 2 = 0 then 'content' else 'file' end as scope, content_sha256, 1704067200 + k as observed_epoch
from files cross join (select distinct event_id % 4 as k from events) ks
where deleted_epoch is null""",
    "policies": """
select 'workset' as policy_code, 'production' as environment, n + 1 as policy_version, case n when 0 then 24 when 1 then 18 else 6 end as months,
  case n when 0 then 1672531200 when 1 then 1735689600 else 1798761600 end as effective_from, case n when 0 then 1735689600 end as effective_to, 90 + n * 10 as review_days
from (select distinct event_id % 3 as n from events) p""",
    "reviews": """
select l.doc_id * 4 + n as review_id, l.doc_id as file_id, case when n = 3 then 'privacy' else 'target' end as review_type,
  case when l.quality = 1 then 'accepted' when l.doc_id % 5 = 0 then 'corrected' else 'rejected' end as decision,
  concat('cat_', case when n = 1 and l.doc_id % 9 = 0 then 'xx' else f.lang end) as category, concat('fam_', cast(coalesce(f.folder_id, 0) % 7 as varchar(10))) as family,
  concat('fam_', cast(l.doc_id % 4 as varchar(10))) as source_family,
  case when l.toxic = 1 then 'high' when l.doc_id % 6 = 0 then 'medium' else 'low' end as privacy,
  case when l.doc_id % 7 = 0 then null else concat('/target/', f.lang, '/', f.filename) end as target_path,
  case when l.doc_id % 3 = 0 then concat('/target/', f.lang, '/', f.filename) else concat('/target//', f.lang, '/./', f.filename) end as proposed_path,
  case when l.doc_id % 4 = 0 then 'low' else 'high' end as proposed_privacy, 1704067200 + l.doc_id * 60 + n as created_epoch,
  f.filename, f.path, f.extension, f.content_sha256
from labels l join files f on f.file_id = l.doc_id cross join (select distinct event_id % 4 as n from events) ns
where n = 0 or n = 3 or (n = 1 and l.doc_id % 3 = 0)""",
    "chunk_vectors": "select vec_id, cast(floor(vec_id / 2) as bigint) as file_id, vec_id % 2 as ordinal, embedding, label from embeddings",
    "raw_dates": """
select file_id, case file_id % 6 when 0 then concat(y, '-', m, '-', d, 'T', h, ':30:15Z') when 1 then concat(y, '-', m, '-', d, 'T', h, ':30:15+02:00') when 2 then concat('D:', y, m, d, h, '3015')
    when 3 then concat('D:', y, m, d, h, '3015-05', chr(39), '30', chr(39)) when 4 then concat(y, '-', m, '-', d, ' ', h, ':30:15') else concat('on ', d, ' ', m) end as raw
from (select file_id, cast(2023 + file_id % 3 as varchar(4)) as y, lpad(cast(1 + file_id % 12 as varchar(2)), 2, '0') as m, lpad(cast(1 + file_id % 28 as varchar(2)), 2, '0') as d, lpad(cast(file_id % 24 as varchar(2)), 2, '0') as h from files) x""",
    "nominations": """
select event_id, user_id as file_id, case when event_id % 3 = 0 then 'inactive' when event_id % 3 = 1 then 'archive' else 'delete' end as nomination_type,
  case when event_type = 'error' then 'withdraw' else 'nominate' end as action, 1704067200 + event_id * 601 as created_epoch from events""",
    "jobs": """
select event_id as job_id, user_id as file_id, case event_type when 'click' then 'done' when 'view' then 'pending' when 'error' then 'failed' when 'signup' then 'ready' else 'abstained' end as status,
  cast(event_id % 5 as int) as priority, 1704067200 + event_id * 13 as requested_epoch, cast(event_id % 4 as int) as attempts, case when event_id % 6 = 0 then 'stale' else 'current' end as content_state
from events""",
}


def _needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", sql) and VIEWS[name] != sql:
            _needed(VIEWS[name], found)
            found[name] = None
    return found


def duck(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    found = _needed(sql, {})
    views = ",\n".join(f"{name} as materialized ({VIEWS[name].replace('SHA(', 'sha256(').strip()})" for name in found)
    body = sql.strip()
    if not views:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[15:]}"
    return f"with {views},\n{body[5:]}" if body.lower().startswith("with ") else f"with {views}\n{body}"


class Views:
    """The views as DataFrames: ``Views(spark, folder).files``; given tables by their own names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                sql = VIEWS[name]
                parts = {t: getattr(self, t) for t in [*VIEWS, *TABLES] if t != name and re.search(rf"\b(?:from|join) {t}\b", sql)}
                for t in parts:
                    sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
                self._built[name] = self.spark.sql(re.sub(r"SHA\(([^()]*(?:\([^()]*\))?[^()]*)\)", r"sha2(\1, 256)", sql), **parts)
            else:
                raise AttributeError(name)
        return self._built[name]

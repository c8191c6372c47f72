"""Queries of the two selections with all their reasons (Q-6, Q-7), with their SQL."""

from __future__ import annotations


from foliant.operators import selection as ops
from foliant.plans.registry import query

#: Files in folders and under names that the rules know, with times and groups that break each rule in turn, and some rows listed twice.
LISTED = """select file_id, concat(case file_id % 23 when 1 then '/werk' when 2 then '/Studie' when 3 then '/projecten/a' when 4 then '/administratie' when 5 then '/mijn bank' when 6 then '/medisch-dossier' when 7 then '/Curriculum Vitae'
    when 8 then '/ticket_1' when 9 then '/huis/energie' when 10 then '/paspoort' when 11 then '/my project x' when 12 then '/cursus' else '' end, folder_path, '/', case file_id % 31 when 1 then 'key' when 2 then 'Password' else regexp_replace(filename, '[.][a-z]+$', '') end, '.', extension) as path,
  case when file_id % 6 = 0 then '.PDF' else extension end as extension, case when file_id % 9 = 1 then size_bytes * 300 when file_id % 9 = 2 then size_bytes * 3000 else size_bytes end as size_bytes, content_sha256,
  case when file_id % 19 = 0 then null else modified_at_fs end as modified_at_fs, case when file_id % 17 = 0 then null else coalesce(content_sha256, 'none') end as content_group_id, case when file_id % 11 = 0 then file_id + 1 else file_id end as golden_file_id, file_id % 13 = 0 as twice
from files"""
ROWS = f"select file_id, path, extension, size_bytes, content_sha256, modified_at_fs, content_group_id, golden_file_id from ({LISTED}) a union all select file_id, concat(path, '.again'), extension, size_bytes, content_sha256, modified_at_fs, content_group_id, golden_file_id from ({LISTED}) b where twice"
CUTOFF, N = 1706067200, 40

WORDS = r"trim(regexp_replace(lower(path), '[^\pL\pN]+', ' ', 'g'))"
STEM = r"regexp_replace(regexp_extract(lower(path), '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1')"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
_words = lambda terms: f"list_has_any(string_split({WORDS}, ' '), [{_quoted(terms)}])"
_folders = lambda names: f"list_has_any(string_split(lower(path), '/'), [{_quoted(names)}])"
SENSITIVE = (
    f"case when {STEM} = 'key' then 'secrets' "
    + " ".join(f"when {_words(t)} then '{k}'" for k, t in ops.SENSITIVE_TERMS.items())
    + " "
    + " ".join(f"when contains({WORDS}, '{p}') then '{k}'" for k, ps in ops.SENSITIVE_PHRASES.items() for p in ps)
    + " end"
)
PILOT = f"case when {_folders(ops.STUDY_FOLDERS)} then 'study' when {_folders(ops.PROJECT_FOLDERS)} or contains(lower(path), 'project') then 'project' when {_folders(['werk'])} then 'work' when {_folders(ops.OFFICE_FOLDERS)} then 'administration' else 'general' end"
PERSONAL = "case " + " ".join(f"when {_words(t)} then '{k}'" for k, t in ops.PERSONAL_TERMS.items()) + " else 'personal' end"


def _sql(against: str, stratum: str, strata: tuple[str, ...], n: int) -> str:
    return f"""with l as ({ROWS}), j as (select file_id, path, content_group_id, modified_at_fs, ltrim(lower(extension), '.') as ext, {stratum} as stratum, case when size_bytes < {ops.SMALL} then 'small' when size_bytes < {ops.MEDIUM} then 'medium' else 'large' end as size_bucket,
  case when ltrim(lower(extension), '.') not in ('pdf', 'docx') then 'unsupported_extension' when coalesce(size_bytes, 0) <= 0 then 'empty_file' when content_sha256 is null then 'missing_full_sha256' when content_group_id is null or golden_file_id is distinct from file_id then 'not_persisted_golden'
    when modified_at_fs is null then 'missing_filesystem_modification_time' when modified_at_fs < {CUTOFF} then 'outside_recent_window' else {against} end as reason from l),
k as (select *, row_number() over (partition by content_group_id order by modified_at_fs desc, lower(path), file_id) as k from j where reason is null),
t as (select *, list_position([{_quoted(strata)}], stratum) as a, case ext when 'docx' then 0 else 1 end as b, list_position(['small', 'medium', 'large'], size_bucket) as c from k where k = 1),
p as (select path from (select *, row_number() over (partition by a, b, c order by modified_at_fs desc, lower(path), file_id) as turn from t) order by turn, a, b, c limit {n})
select file_id, path, stratum, size_bucket, path in (select path from p) as selected, case when path in (select path from p) then null else 'pilot_limit' end as reason from t
union all select file_id, path, stratum, size_bucket, false, 'duplicate_content_group' from k where k > 1 union all select file_id, path, stratum, size_bucket, false, reason from j where reason is not null"""


def _rows(v):
    return v.spark.sql(ROWS.replace("from files", "from {files}"), files=v.files)


@query("q06b_pilot_reasons", _sql(f"'sensitive_path_category:' || {SENSITIVE}", PILOT, ops.PILOT_STRATA, N))
def _(v):
    return ops.pilot(_rows(v), CUTOFF, N)


@query("q07b_personal_reasons", _sql(f"case when {STEM} in ({_quoted(ops.SECRET_NAMES)}) then 'secret_candidate' end", PERSONAL, ops.PERSONAL_STRATA, 25))
def _(v):
    return ops.personal(_rows(v), CUTOFF)

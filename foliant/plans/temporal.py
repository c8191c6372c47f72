"""Queries of temporal evidence (E), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import temporal as ops
from foliant.plans.registry import query
from foliant.sources.fixtures import AS_OF

CUR = """cur as (select f.file_id as for_file, e.* from evidence e join files f on f.deleted_epoch is null and f.content_sha256 = e.content_sha256 and (e.scope = 'content' or f.file_id = e.file_id))"""
RES = f"""{CUR}, inp as (select for_file, date_type, count(*) as n, count(distinct value_epoch) > 1 as raw_conflict, bool_and(starts_with(source_type, 'pdf')) as pdf_only,
  arg_max(struct_pack(v := value_epoch, s := timezone_status), observed_epoch * 100000000 + evidence_id) filter (source_type = 'pdf_info') as i, arg_max(struct_pack(v := value_epoch), observed_epoch * 100000000 + evidence_id) filter (source_type = 'pdf_xmp') as x from cur group by 1, 2),
j as (select *, coalesce(pdf_only and i.s in ('utc', 'explicit_offset') and abs(i.v - x.v) <= 2, false) as near, coalesce(pdf_only and i.s in ('utc', 'explicit_offset') and x.v % 86400 = 0 and floor(x.v / 86400) = floor(i.v / 86400), false) as same_day from inp),
res as (select for_file, date_type, n, case when not raw_conflict then 'consistent' when near or same_day then 'equivalent' else 'material_conflict' end as status,
  case when not raw_conflict then 'consistent_single_value' when near then 'equivalent_instant' when same_day then 'equivalent_day' else 'materially_different' end as reason from j)"""
BEST = """best as (select for_file, date_type, value_epoch, source_type, confidence, row_number() over (partition by for_file, date_type order by (value_epoch is not null) desc, case confidence when 'high' then 3 when 'medium' then 2 else 1 end desc,
  case source_type when 'pdf_info' then 2 else 3 end desc, observed_epoch desc, evidence_id desc) as k, count(*) over (partition by for_file, date_type) as n from cur),
multi as (select for_file, date_type, count(distinct value_epoch) > 1 as several from cur group by 1, 2)"""


def _pivot(conflict: str) -> str:
    cols = ", ".join(f"max(value_epoch) filter (date_type = '{k}') as {k}_epoch, max(source_type) filter (date_type = '{k}') as {k}_source, max(confidence) filter (date_type = '{k}') as {k}_confidence, coalesce(bool_or({conflict}) filter (date_type = '{k}'), false) as {k}_conflict" for k in ("created", "modified"))
    return f"select for_file, sum(n)::bigint as evidence_count, {cols} from best join res using (for_file, date_type) join multi using (for_file, date_type) where k = 1 group by 1"


PROFILE = f"{RES}, {BEST.replace(' as n from cur', ' as cnt from cur')}"
CAN = f"""ok as (select *, floor(value_epoch / 86400) as day, timezone_status <> 'absent' as zoned, timezone_status = 'absent' and value_epoch % 86400 = 0 as date_only from evidence
  where value_epoch is not null and value_epoch <= {AS_OF} + 86400 and not (strftime(make_timestamp(value_epoch * 1000000), '%m-%d') = '01-01' and year(make_timestamp(value_epoch * 1000000)) in (1900, 1970))),
can as (select * from (select *, row_number() over (partition by file_id, date_type order by case date_type when 'created' then day else -day end, date_only, not zoned, case confidence when 'high' then 3 when 'medium' then 2 else 1 end desc,
  case source_type when 'office' then 4 when 'pdf_info' then 3 else 2 end desc, case date_type when 'created' then value_epoch else -value_epoch end, evidence_id) as k from ok) where k = 1)"""


@query("e01_parse_dates", r"""with p as (select file_id, raw, regexp_extract(raw, '^(?:D:)?(\d{4})-?(\d{2})-?(\d{2})[T ]?(\d{2}):?(\d{2}):?(\d{2})(Z|[+-]\d{2}[:'']\d{2}''?)?$', ['y', 'm', 'd', 'h', 'i', 's', 'z']) as x from raw_dates),
q as (select file_id, raw, epoch(make_timestamp(try_cast(x.y as bigint), try_cast(x.m as bigint), try_cast(x.d as bigint), try_cast(x.h as bigint), try_cast(x.i as bigint), try_cast(x.s as double)))::bigint as local_epoch,
  case when x.z = 'Z' then 0 when x.z <> '' then case when x.z[1] = '-' then -1 else 1 end * (substr(x.z, 2, 2)::int * 60 + substr(x.z, 5, 2)::int) end as offset_minutes from p)
select file_id, local_epoch, offset_minutes, local_epoch - offset_minutes * 60 as value_epoch, case when local_epoch is null then null when offset_minutes is null then 'absent' when offset_minutes = 0 then 'utc' else 'explicit_offset' end as timezone_status,
  case when local_epoch is null then null when offset_minutes is null then 'medium' else 'high' end as confidence from q""")
def _(v):
    return ops.parse_dates(v.raw_dates).drop("raw")


@query("e02_evidence_keys", "select evidence_id, sha256(concat_ws('|', case when scope = 'content' then content_sha256 else concat('file:', file_id::varchar) end, date_type, source_type, coalesce(value_epoch::varchar, ''))) as evidence_key from evidence")
def _(v):
    return ops.evidence_key(v.evidence).select("evidence_id", "evidence_key")


@query("e03_profile", f"with {PROFILE.replace(' as cnt from cur', ' as n2 from cur')} {_pivot('status = ' + chr(39) + 'material_conflict' + chr(39))}")
def _(v):
    return ops.profile(v.files, v.evidence)


@query("e03b_profile_distinct", f"with {PROFILE} {_pivot('several')}")
def _(v):
    return ops.profile(v.files, v.evidence, "distinct")


@query("e04_resolution", f"with {RES} select * from res")
def _(v):
    return ops.resolution(v.files, v.evidence)


@query("e05_canonical", f"with {CAN} select file_id, date_type, evidence_id, value_epoch, source_type, date_only from can")
def _(v):
    return ops.canonical(v.evidence, AS_OF).drop("zoned")


CUT = f"epoch(make_timestamp({AS_OF}::bigint * 1000000) - to_months(12))::bigint"
IMPACT = f"""{PROFILE}, prof as ({_pivot("status = 'material_conflict'")}), {CAN}, ch as (select file_id, max(value_epoch) filter (date_type = 'created') as nc, max(value_epoch) filter (date_type = 'modified') as nm, bool_or(zoned) filter (date_type = 'created') as cz, bool_or(zoned) filter (date_type = 'modified') as mz from can group by 1),
cr as (select file_id, bool_or(value_epoch < {CUT}) as bef, bool_or(value_epoch between {CUT} and {AS_OF}) as wit from ok group by 1),
r as (select f.file_id, nc, nm, coalesce(nc > nm, false) as late, cz = mz as sure, greatest(case when nm <= {AS_OF} then nm end, case when nc <= {AS_OF} then nc end, case when f.modified_at_fs <= {AS_OF} then f.modified_at_fs end) as best, greatest(p.modified_epoch, p.created_epoch, f.modified_at_fs) as was, coalesce(p.created_conflict or p.modified_conflict, false) as conflict,
  coalesce(f.modified_at_fs between {CUT} and {AS_OF}, false) as recent, coalesce(bef and wit, false) as both_, p.created_epoch as oc, p.modified_epoch as om from files f left join ch using (file_id) left join cr using (file_id) left join prof p on p.for_file = f.file_id where f.deleted_epoch is null),
s as (select *, case when late and sure then 'created_after_modified' when late then 'chronology_timezone_ambiguous' else 'none' end as issue, case when conflict and not recent and both_ then 'decision_sensitive' when conflict then 'decision_invariant' else 'none' end as conflict_effect from r),
imp as (select file_id, issue, conflict_effect, best as activity_epoch, case when conflict or was is null or was > {AS_OF} then 'needs_review' when was >= {CUT} then 'active' else 'inactive' end as status_before,
  case when issue = 'created_after_modified' or conflict_effect = 'decision_sensitive' or best is null then 'needs_review' when best >= {CUT} then 'active' else 'inactive' end as status,
  case when issue = 'created_after_modified' then 'created_after_modified' when conflict_effect = 'decision_sensitive' then 'decision_sensitive_conflict' when best is null then 'insufficient_evidence' when best >= {CUT} then 'activity_within_window' when conflict then 'inactive_despite_conflict' else 'activity_outside_window' end as reason,
  nc is distinct from oc as created_changed, nm is distinct from om as modified_changed from s)"""


@query("e06_impact", f"with {IMPACT} select *, status <> status_before as changed from imp")
def _(v):
    return ops.impact(v.files, v.evidence, AS_OF, 12)


@query("e07_impact_summary", f"with {IMPACT} select issue, status, count(*) as files, count(*) filter (status <> status_before) as changed, count(*) filter (created_changed) as created_changed, count(*) filter (modified_changed) as modified_changed, count(*) filter (conflict_effect = 'decision_sensitive') as sensitive from imp group by 1, 2")
def _(v):
    counts = [F.count("*").alias("files"), *[F.count_if(c).alias(c) for c in ("changed", "created_changed", "modified_changed")], F.count_if(F.col("conflict_effect") == "decision_sensitive").alias("sensitive")]
    return ops.impact(v.files, v.evidence, AS_OF, 12).groupBy("issue", "status").agg(*counts)


DATED = "select doc_id, case when doc_id % 3 = 0 then concat(text, ' on 2024-0', cast(1 + doc_id % 9 as varchar(2)), '-11, 3/4/2021 and 12.10.2020 ') else text end as text from documents"


@query("e08_text_dates", rf"with t as ({DATED}) select doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), regexp_extract_all(text, '\b\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}\b'))))[1:50], ',') as dates from t")
def _(v):
    rows = v.spark.sql(DATED.replace("from documents", "from {documents}"), documents=v.documents)
    return ops.text_dates(rows).select("doc_id", F.array_join("dates", ",").alias("dates"))


PAIRS = "select a.file_id, a.value_epoch as created_epoch, a.timezone_status as created_status, b.value_epoch as modified_epoch, b.timezone_status as modified_status from evidence a join evidence b on b.file_id = a.file_id and a.evidence_id % 8 = 0 and b.evidence_id % 8 = 1"


@query("e09_inconsistencies", f"""with p as ({PAIRS}), q as (select *, case created_status when 'absent' then epoch(timezone('Europe/Amsterdam', make_timestamp(created_epoch * 1000000)))::bigint else created_epoch end as c,
  case modified_status when 'absent' then epoch(timezone('Europe/Amsterdam', make_timestamp(modified_epoch * 1000000)))::bigint else modified_epoch end as m from p)
select file_id, array_to_string(list_filter([case when greatest(c, m) > {AS_OF} then 'future' end, case when c > m then 'created_after_modified' end, case when created_epoch = modified_epoch and c <> m then 'timezone_conflict' end, case when created_epoch is null or modified_epoch is null then 'parse_error' end], lambda x: x is not null), ',') as codes from q""")
def _(v):
    rows = v.spark.sql(PAIRS.replace("evidence a", "{evidence} a").replace("evidence b", "{evidence} b"), evidence=v.evidence)
    return ops.inconsistencies(rows, AS_OF).select("file_id", F.array_join("codes", ",").alias("codes"))


@query("e10_backfill", "select file_id, path from files f where deleted_epoch is null and content_sha256 is not null and extension in ('pdf', 'docx') and not exists (select 1 from evidence e where e.file_id = f.file_id and e.content_sha256 = f.content_sha256 and e.file_id % 2 = 0) order by file_id limit 500")
def _(v):
    return ops.backfill(v.files, v.evidence.where("file_id % 2 = 0"), ["pdf", "docx"], 500).select("file_id", "path")

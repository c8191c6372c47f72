"""Queries of policies, work-set, lifecycle and retention (W), with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliant.functions.common import latest, the_one
from foliant.operators import temporal
from foliant.operators import workset as ops
from foliant.plans.registry import query
from foliant.plans.temporal import PROFILE, _pivot
from foliant.sources.fixtures import AS_OF

CURRENT = f"cp as (select * from (select *, row_number() over (partition by policy_code, environment order by effective_from desc, policy_version desc) as k from policies where effective_from <= {AS_OF} and (effective_to is null or effective_to > {AS_OF})) where k = 1)"
PROF = f"{PROFILE}, prof as ({_pivot(chr(115) + 'tatus = ' + chr(39) + 'material_conflict' + chr(39))})"
SIGNALS = "list_sort(list_filter([case when p.modified_epoch is not null then struct_pack(a := p.modified_epoch, b := 0, s := 'source_metadata_modified', c := coalesce(p.modified_confidence, 'low')) end, case when p.created_epoch is not null then struct_pack(a := p.created_epoch, b := -1, s := 'source_metadata_created', c := coalesce(p.created_confidence, 'low')) end, case when f.modified_at_fs is not null then struct_pack(a := f.modified_at_fs, b := -2, s := 'filesystem_mtime', c := 'low') end], lambda x: x is not null), 'DESC')[1]"
WS = f"""{PROF}, {CURRENT}, g as (select f.* from files f join persisted_groups pg on pg.golden_file_id = f.file_id where f.deleted_epoch is null),
w as (select f.file_id, f.path, f.extension, {SIGNALS} as x, coalesce(p.created_conflict or p.modified_conflict, false) as conflict, cp.policy_version, epoch(make_timestamp({AS_OF}::bigint * 1000000) - to_months(cp.months))::bigint as cut
  from g f left join prof p on p.for_file = f.file_id cross join cp where f.extension in ('pdf', 'docx', 'txt') and starts_with(f.path, '/data/')),
ws as (select file_id, path, extension, x.a as activity_epoch, x.s as basis, coalesce(x.c, 'low') as confidence, case when conflict or x.a is null or x.a > {AS_OF} then 'needs_review' when x.a >= cut then 'active' else 'inactive' end as status,
  case when conflict then 'conflicting_temporal_evidence' when x.a is null or x.a > {AS_OF} then 'invalid_or_missing_activity_timestamp' when x.a >= cut then x.s || '_within_configured_window' else 'no_qualifying_activity_within_configured_window' end as reason, policy_version from w)"""


def _workset(v):
    files = v.files.where("deleted_epoch is null").join(v.persisted_groups.select(F.col("golden_file_id").alias("file_id")), "file_id", "left_semi")
    return ops.workset(files, temporal.profile(v.files, v.evidence), ops.current_policies(v.policies, AS_OF), AS_OF, ["pdf", "docx", "txt"], "/data")


@query("w01_current_policies", f"with {CURRENT} select policy_code, environment, policy_version, months from cp")
def _(v):
    return ops.current_policies(v.policies, AS_OF).select("policy_code", "environment", "policy_version", "months")


@query("w02_policy_seed", """select policy_code, policy_version, sha256('{"effective_from":' || effective_from || ',"months":' || months || ',"policy_code":"' || policy_code || '","policy_version":' || policy_version || '}') as checksum, uuidv5 as policy_id
from (select *, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17:17])::int & 3) | 8)) || h[18:20], h[21:32]) as uuidv5 from (select *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(policy_code || ':' || policy_version)) as h from policies))""")
def _(v):
    return ops.policy_seed(v.policies)


@query("w03_workset", f"with {WS} select * from ws")
def _(v):
    return _workset(v)


PILOT = f"""{PROF}, m as (select f.*, g.golden_file_id, case when g.golden_file_id is not null then f.content_sha256 || ':' || f.size_bytes else 'file:' || f.file_id end as group_id from files f left join persisted_groups g on g.content_sha256 = f.content_sha256 and g.size_bytes = f.size_bytes where f.deleted_epoch is null),
o as (select *, row_number() over (partition by group_id order by modified_at_fs desc nulls last, lower(path), file_id) as k, count(*) over (partition by group_id) as copies from m),
t as (select f.* exclude (created_epoch), p.created_epoch, p.modified_epoch, {SIGNALS} as x, coalesce(p.created_conflict or p.modified_conflict, false) as conflict, epoch(make_timestamp({AS_OF}::bigint * 1000000) - to_months(12))::bigint as cut from o f left join prof p on p.for_file = f.file_id where k = 1),
u as (select *, case when coalesce(size_bytes, 0) <= 0 then 'empty_file' when content_sha256 is null then 'missing_full_content_hash' when golden_file_id is null then 'missing_persisted_golden_record' when conflict then 'conflicting_temporal_evidence'
  when x.a is null or x.a > {AS_OF} then 'invalid_or_missing_activity_timestamp' when x.a >= cut then x.s || '_within_configured_window' else 'no_qualifying_activity_within_configured_window' end as reason from t),
pilot as (select group_id, file_id, path, extension, copies, x.a as activity_epoch, case when reason like 'no@_%' escape '@' then 'inactive' when reason like '%@_within@_configured@_window' escape '@' then 'active_candidate' else 'needs_review' end as status, reason,
  array_to_string(list_filter([case when created_epoch is null then 'source_created_at' end, case when modified_epoch is null then 'source_modified_at' end, 'content_changed_at', 'last_human_activity_at'], lambda y: y is not null), ',') as missing,
  copies > 1 or coalesce(golden_file_id <> file_id, false) as represented from u)"""


def _pilot(v):
    return ops.pilot(v.files, v.persisted_groups, temporal.profile(v.files, v.evidence), AS_OF, 12)


@query("w04_pilot", f"with {PILOT} select * from pilot")
def _(v):
    return _pilot(v)


ORD = "case status when 'active_candidate' then 0 when 'needs_review' then 1 else 2 end, extension, lower(path), file_id"


@query("w05_review_sample", f"""with {PILOT}, x as (select file_id, 0 as k, 'active_sample' as name from (select *, row_number() over (partition by extension order by {ORD}) as q from pilot where status = 'active_candidate') where q <= 5
union all (select file_id, 1, 'outside_near_cutoff' from pilot where status = 'inactive' order by activity_epoch desc, {ORD} limit 10) union all (select file_id, 2, 'duplicate_group' from pilot where represented order by {ORD} limit 10)
union all (select file_id, 3, 'temporal_conflict' from pilot where reason = 'conflicting_temporal_evidence' order by {ORD} limit 10)) select file_id, string_agg(name, ',' order by k) as reasons from x group by 1""")
def _(v):
    return ops.review_sample(_pilot(v), 5, 10, 10, 10)


@query("w06_summary", f"with {PILOT} select extension, status, count(*) as groups, count(*) filter (represented) as represented from pilot group by 1, 2")
def _(v):
    return _pilot(v).groupBy("extension", "status").agg(F.count("*").alias("groups"), F.count_if("represented").alias("represented"))


CHOICES = "select file_id, case decision when 'accepted' then 'active' else 'inactive' end as choice, created_epoch + 31536000 + (file_id % 3) * 31536000 as active_until, created_epoch, review_id from reviews where file_id % 4 <> 0"
LIFE = f"""{WS}, ch as ({CHOICES}), lc as (select w.file_id, c.choice is not null and not (c.choice = 'active' and c.active_until < {AS_OF}) as holds, c.choice, w.status from ws w left join (select file_id, arg_max(choice, created_epoch * 1000000 + review_id) as choice, arg_max(active_until, created_epoch * 1000000 + review_id) as active_until from ch group by 1) c using (file_id)),
life as (select file_id, case when holds then choice else status end as lifecycle, case when holds then 'human_review' else 'policy' end as source from lc)"""


def _life(v):
    return ops.effective_lifecycle(_workset(v), v.spark.sql(CHOICES.replace("from reviews", "from {reviews}"), reviews=v.reviews), AS_OF)


@query("w07_lifecycle", f"with {LIFE} select * from life")
def _(v):
    return _life(v)


CLASSIFIED = "select file_id, concat('cat_', cast(file_id % 5 as varchar(4))) as category, concat('fam_', cast(file_id % 7 as varchar(4))) as family, case when file_id % 3 = 0 then concat('/store/review/', filename) when file_id % 3 = 1 then concat('/store/active/x/', filename) end as suggested_path from files where file_id % 4 <> 1"
NEWEST = "select e.event_id as proposal_id, f.file_id, case when e.event_id % 5 = 0 then 'old' else f.content_sha256 end as content_sha256, concat('/store/', case e.event_id % 3 when 0 then 'archive/' when 1 then 'active/' else 'elsewhere/' end, f.filename) as suggested_path, 1704067200 + cast(floor(e.event_id / 2) as bigint) as created_epoch from events e join files f on f.file_id = e.user_id"
TARGETS = "select review_id, file_id, review_type, decision, category, replace(target_path, '/target/', case file_id % 3 when 0 then '/store/active/' when 1 then '/store/archive/' else '/other/' end) as target_path, case when file_id % 2 = 0 then replace(proposed_path, '/target/', '/store/review/') end as proposed_path, created_epoch from reviews"
LIFECYCLE = "case lifecycle when 'inactive' then 'archive' else lifecycle end"


REVIEWED = f"""{LIFE}, tg as ({TARGETS}), cl as ({CLASSIFIED}), nw as ({NEWEST}), r as (select file_id, arg_max(struct_pack(d := decision, t := target_path, p := proposed_path, c := category), created_epoch * 1000000 + review_id) as x from tg where review_type = 'target' group by 1),
n as (select w.file_id, arg_max(suggested_path, nw.created_epoch * 1000000 + proposal_id) as newest from nw join files w on w.file_id = nw.file_id and w.content_sha256 = nw.content_sha256 group by 1),
z as (select l.file_id, {LIFECYCLE} as lifecycle, x.d as decision, cl.category, cl.family, x.c as corrected_category, coalesce(x.t, x.p, cl.suggested_path, n.newest) as stored_path, '/store/' || case {LIFECYCLE} when 'active' then 'active' when 'archive' then 'archive' else 'review' end || '/' as start from life l left join r using (file_id) left join cl using (file_id) left join n using (file_id)),
pv as (select * exclude (start), case when regexp_matches(stored_path, '^/store/(active|archive|review)/') then start || regexp_replace(stored_path, '^/store/(active|archive|review)/', '') else stored_path end as aligned_path, coalesce(regexp_matches(stored_path, '^/store/(active|archive|review)/') and not starts_with(stored_path, start), false) as needs_correction from z)"""


@query("w08_path_review", f"with {REVIEWED} select * from pv")
def _(v):
    return _path_review(v)


def _path_review(v):
    sql = lambda q, **t: v.spark.sql(re.sub(r"\b(from|join) (files|events|reviews)\b", r"\1 {\2}", q), **t)
    life = _life(v).select("file_id", F.when(F.col("lifecycle") == "inactive", "archive").otherwise(F.col("lifecycle")).alias("lifecycle")).join(v.files.select("file_id", "content_sha256"), "file_id")
    return ops.path_review(life, sql(TARGETS, reviews=v.reviews), sql(CLASSIFIED, files=v.files), sql(NEWEST, files=v.files, events=v.events), "/store")


LIST = f"""{LIFE}, tr as (select file_id, arg_max(struct_pack(decision := decision, review_epoch := created_epoch, family := family), created_epoch * 1000000 + review_id) as x from reviews where review_type = 'target' group by 1),
nm as (select file_id, list_sort(list(distinct nomination_type)) as nominations from (select file_id, nomination_type, arg_max(action, created_epoch * 1000000 + event_id) as action from nominations group by 1, 2) where action = 'nominate' group by 1),
wl as (select w.file_id, w.path, f.filename, w.extension, w.activity_epoch, l.lifecycle, x.decision, x.review_epoch, coalesce(x.family, 'unknown') as family, coalesce(nominations, []) as nominations from ws w join files f using (file_id) left join life l using (file_id) left join tr using (file_id) left join nm using (file_id))"""
NAMES = "lower(filename), filename, file_id"
#: Name, arguments of the listing, and the same as a condition without the family, with it, and as an order.
LISTINGS = [
    ("w09_listing", {"extension": "pdf", "search": "SRC1", "offset": 1}, "extension = 'pdf' and contains(lower(path), 'src1')", "true", f"activity_epoch desc nulls last, {NAMES}"),
    ("w09c_reviewed", {"status": "active", "review_state": "reviewed", "family": "fam_1"}, "lifecycle = 'active' and decision is not null", "family = 'fam_1'", f"review_epoch desc nulls last, {NAMES}"),
    ("w09d_pending_nominated", {"review_state": "pending", "nomination": "delete", "sort": "filename_asc"}, "decision is null and list_contains(nominations, 'delete')", "true", NAMES),
    ("w09e_accepted_unnominated", {"decision": "accepted", "nomination": "none", "sort": "filename_desc"}, "decision = 'accepted' and len(nominations) = 0", "true", "lower(filename) desc, filename desc, file_id"),
]


def _list(v):
    rows = _workset(v).join(v.files.select("file_id", "filename"), "file_id")
    return ops.work_list(rows, v.reviews, ops.nominations(v.nominations), _life(v))


def _add_listing(name, args, where, family, order):
    @query(name, f"with {LIST} select file_id, path, activity_epoch, lifecycle, decision, review_epoch, family, array_to_string(nominations, ',') as nominations from wl where {where} and {family} order by {order} limit 50 offset {args.get('offset', 0)}")
    def _(v):
        page = ops.listing(_list(v), **args)[0]
        return page.select("file_id", "path", "activity_epoch", "lifecycle", "decision", "review_epoch", "family", F.array_join("nominations", ",").alias("nominations"))


for _listing in LISTINGS:
    _add_listing(*_listing)


@query("w09b_facets", f"with {LIST} select family, count(*) as files from wl where {LISTINGS[1][2]} group by 1")
def _(v):
    return ops.listing(_list(v), **LISTINGS[1][1])[1]


@query("w09f_summary", f"with {LIST} select count(*) as total, count(*) filter (lifecycle = 'active') as lifecycle_active, count(*) filter (lifecycle = 'inactive') as lifecycle_inactive, count(*) filter (lifecycle = 'needs_review') as lifecycle_needs_review, count(*) filter (decision is not null) as reviewed, count(*) filter (decision is null) as pending, count(*) filter (len(nominations) > 0) as nominated from wl")
def _(v):
    return ops.listing(_list(v), **LISTINGS[1][1])[2]


LATEST_NOM = "n as (select file_id, nomination_type, arg_max(action, created_epoch * 1000000 + event_id) as action, max(created_epoch) as created_epoch from nominations group by 1, 2)"


@query("w10_nominations", f"with {LATEST_NOM} select file_id, nomination_type, action, created_epoch from n")
def _(v):
    return ops.nominations(v.nominations).select("file_id", "nomination_type", "action", "created_epoch")


@query("w10b_due", f"with {LATEST_NOM}, {CURRENT} select nomination_type, count(*) as active, count(*) filter (created_epoch + review_days * 86400 <= {AS_OF}) as due from n cross join cp where action = 'nominate' group by 1")
def _(v):
    rows = ops.nominations(v.nominations).where("action = 'nominate'").join(F.broadcast(the_one(ops.current_policies(v.policies, AS_OF), "review_days")))
    return rows.groupBy("nomination_type").agg(F.count("*").alias("active"), F.count_if(F.col("created_epoch") + F.col("review_days") * 86400 <= AS_OF).alias("due"))


RETAINED = """select file_id as group_id, concat(case file_id % 13 when 1 then 'Diploma ' when 2 then 'reader-' when 3 then 'portfolio ' when 4 then 'SLIDES ' else '' end, filename) as filename, folder_path as path,
  case when contains(lower(folder_path), '/study') then 'study' else case file_id % 11 when 0 then 'admin' when 1 then 'private' when 2 then 'house' when 3 then 'job' when 4 then 'project' when 5 then 'money' when 6 then 'health' when 7 then 'papers' when 8 then 'pay' end end as category, case when file_id % 17 = 0 then 'found a certificate' end as reasons, file_id from files where deleted_epoch is null"""
ROLES = {"admin": "administration", "private": "personal", "house": "home", "job": "work", "project": "project", "money": "financial", "health": "health", "papers": "identity", "pay": "employment"}


def _says(words):
    return "(" + " or ".join(f"contains(said, '{w}')" for w in words) + ")"


_KNOWN = "category in (" + ", ".join(f"'{k}'" for k in ROLES) + ")"
_NULL = lambda x: "null" if x is None else x


@query("w11_retention", f"""with {PROF}, r as (select x.*, lower(concat_ws(' ', x.filename, x.path, coalesce(reasons, ''))) as said, coalesce(created_conflict or modified_conflict, false) as bad, p.modified_epoch, p.created_epoch, case when x.file_id % 19 = 0 then null else f.modified_at_fs end as fs from ({RETAINED}) x join files f using (file_id) left join prof p on p.for_file = x.file_id),
o as (select *, case when {_says(ops.CERTIFICATE_WORDS)} then case when category = 'study' then 'study_certificate' else 'certificate' end when category = 'study' then case when {_says(ops.HANDOUT_WORDS)} then 'study_handout' when {_says(ops.OWN_WORDS)} then 'study_own_work' else 'study_reference' end else case category {" ".join(f"when '{k}' then '{x}'" for k, x in ROLES.items())} else 'unknown' end end as role,
  case when {_says(ops.CERTIFICATE_WORDS)} then 'certificate_word' when category = 'study' then case when {_says(ops.HANDOUT_WORDS)} then 'handout_word' when {_says(ops.OWN_WORDS)} then 'own_work_word' else 'study_role_open' end else 'category_default' end as role_reason,
  case when {_says(ops.CERTIFICATE_WORDS)} or (category = 'study' and ({_says(ops.HANDOUT_WORDS)} or {_says(ops.OWN_WORDS)})) then 'high' when category = 'study' or {_KNOWN} then 'medium' else 'low' end as role_confidence, case when not bad then coalesce(modified_epoch, created_epoch, fs) end as basis_epoch,
  case when bad then '' when modified_epoch is not null then 'embedded_modified' when created_epoch is not null then 'embedded_created' when fs is not null then 'filesystem_mtime' else '' end as basis_source, case when bad then 'blocked' when modified_epoch is not null then 'high' when created_epoch is not null then 'medium' when fs is not null then 'low' else 'missing' end as basis_confidence from r),
t(role, policy, a, b, disposition, snapshot) as (values {", ".join(f"('{k}', '{p}', {_NULL(a)}, {_NULL(b)}, '{d}', '{n}')" for k, (p, a, b, d, n) in ops.RETENTION.items())}),
c as (select o.*, t.* exclude (role), disposition in ('permanent', 'permanent_manual') as permanent, epoch(make_timestamp(basis_epoch * 1000000) + to_years(a))::bigint as au, epoch(make_timestamp(basis_epoch * 1000000) + to_years(a + b))::bigint as ru from o join t using (role)),
s as (select *, case when permanent then 'permanent' when a is null or basis_epoch is null then 'retention_review' when {AS_OF} < au then 'active' when {AS_OF} < ru then 'cold_archive' else 'retention_review' end as state, case when permanent then 'no_automatic_deletion' when a is null then disposition when basis_epoch is null then 'missing_basis_date' when {AS_OF} < au then 'within_active_period' when {AS_OF} < ru then 'active_period_elapsed' else 'retention_period_elapsed' end as state_reason, case when not permanent and a is not null then ru end as retain_until from c)
select group_id, role, role_reason, role_confidence, policy, disposition, snapshot, basis_epoch, basis_source, basis_confidence, retain_until, state, state_reason, case when state = 'retention_review' or role_confidence <> 'high' then {AS_OF} else retain_until end as next_review,
  (select concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17:17])::int & 3) | 8)) || h[18:20], h[21:32]) from (select sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(group_id || ':1:' || strftime(make_timestamp({AS_OF}::bigint * 1000000), '%Y-%m-%d') || ':' || state)) as h)) as decision_id from s""")
def _(v):
    rows = v.spark.sql(RETAINED.replace("from files", "from {files}"), files=v.files).join(v.files.select("file_id", F.when(F.col("file_id") % 19 != 0, F.col("modified_at_fs")).alias("modified_at_fs")), "file_id")
    rows = rows.join(temporal.profile(v.files, v.evidence).withColumnRenamed("for_file", "file_id"), "file_id", "left")
    return ops.retention(rows.withColumn("inconsistent", F.coalesce(F.col("created_conflict") | F.col("modified_conflict"), F.lit(False))), AS_OF, ROLES)


@query("w12_job_summary", "select status, count(*) as jobs, min(requested_epoch) as oldest, max(priority) as top_priority from jobs group by 1")
def _(v):
    return ops.job_summary(v.jobs)


@query("w12b_next_jobs", "select job_id, file_id, priority from jobs where status = 'pending' order by priority desc, requested_epoch, job_id limit 200")
def _(v):
    return ops.next_jobs(v.jobs, 200).select("job_id", "file_id", "priority")


@query("w12c_latest_jobs", "select file_id, max(job_id) as job_id, arg_max(status, job_id) as status from jobs group by 1")
def _(v):
    return latest(v.jobs, ["file_id"], ["requested_epoch", "job_id"]).select("file_id", "job_id", "status")


@query("w12d_awaiting_review", "select file_id, max(job_id) as job_id from jobs j where status = 'ready' and not exists (select 1 from reviews r where r.file_id = j.file_id and r.decision = 'accepted') group by 1")
def _(v):
    return ops.awaiting_review(v.jobs, v.reviews)


@query("w13_valid_proposals", "select file_id, max(job_id) as job_id, any_value(content_sha256) as content_sha256 from jobs join files using (file_id) where status in ('ready', 'done') and content_state = 'current' and deleted_epoch is null and content_sha256 is not null group by 1")
def _(v):
    return ops.valid_proposals(v.jobs, v.files)


OCR = "select content_sha256, file_id, event_id as run_id, case event_id % 3 when 0 then 'done' else 'needs_ocr' end as status, 1704067200 + cast(floor(event_id / 3) as bigint) as updated_epoch from events join files on file_id = user_id where content_sha256 is not null and event_id % 2 = 0"
ARTIFACTS = "select content_sha256, job_id, case when job_id % 4 = 0 then 'ready' else 'failed' end as status, requested_epoch as finished_epoch from jobs join files using (file_id) where content_sha256 is not null and job_id % 5 = 0"


@query("w13b_ocr_context", f"""with e as ({OCR}), a as ({ARTIFACTS}), m as (select content_sha256, arg_max(job_id, finished_epoch * 1000000 + job_id) as job from a where status = 'ready' group by 1),
n as (select f.file_id, e.file_id as of_file, e.run_id, row_number() over (partition by f.file_id order by e.file_id = f.file_id desc, e.updated_epoch desc, run_id desc) as k from files f join e using (content_sha256) where e.status = 'needs_ocr')
select f.file_id, case when m.job is not null then 'artifact' when n.run_id is not null then 'evidence' else 'extract' end as source, case when m.job is null then n.of_file end as of_file, coalesce(m.job, n.run_id) as ref from files f left join m using (content_sha256) left join n on n.file_id = f.file_id and n.k = 1 where deleted_epoch is null and content_sha256 is not null""")
def _(v):
    evidence = v.spark.sql(OCR.replace("from events join files", "from {events} join {files}"), events=v.events, files=v.files)
    made = v.spark.sql(ARTIFACTS.replace("from jobs join files", "from {jobs} join {files}"), jobs=v.jobs, files=v.files)
    return ops.ocr_context(v.files, evidence, made)


RAN = "select j.job_id, j.file_id, j.status, j.attempts, case when j.job_id % 6 = 0 then 'stale' else f.content_sha256 end as content_sha256 from jobs j left join files f on f.file_id = j.file_id"
OUTCOMES = "select job_id, case job_id % 4 when 0 then 'failed' when 1 then 'abstained' when 2 then 'failed' else 'proposal' end as outcome, case job_id % 8 when 0 then 'TimeoutError' when 2 then 'URLError' when 4 then 'ValueError' when 6 then 'ConnectionRefusedError' end as error from jobs where job_id % 7 <> 0"


@query("w14_job_transitions", f"""with j as ({RAN}), o as ({OUTCOMES}), x as (select j.*, o.outcome, o.error, f.file_id is null or f.content_sha256 is distinct from j.content_sha256 as stale from j left join o using (job_id) left join files f on f.file_id = j.file_id and f.deleted_epoch is null)
select job_id, status, case when outcome is null then status when stale then 'cancelled' when outcome = 'failed' then case when error in ('TimeoutError', 'URLError', 'ConnectionRefusedError') and attempts < 3 then 'pending' else 'failed' end when outcome = 'abstained' then 'abstained' else 'ready' end as next_status,
  case when outcome is not null and stale then 'stale_file' when outcome = 'failed' then error end as error from x""")
def _(v):
    jobs = v.spark.sql(RAN.replace("from jobs j left join files f", "from {jobs} j left join {files} f"), jobs=v.jobs, files=v.files)
    return ops.job_transitions(jobs, v.spark.sql(OUTCOMES.replace("from jobs", "from {jobs}"), jobs=v.jobs), v.files)

"""Queries of duplicates and golden records (G), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import golden as ops
from foliant.plans.registry import query
from foliant.sources.fixtures import AS_OF

CAND = r"""low as (select *, lower(path) as lp, regexp_extract(lower(path), '[^/]*$') as nm from files where deleted_epoch is null and content_sha256 is not null and size_bytes > 0 and path is not null),
cand as (select *, 100 - 8 * len(list_distinct(list_intersect(string_split(lp, '/'), ['cache','temp','tmp','tijdelijk','cloudstation','backup','backups','archief','archive','export','exports'])))
  - case when regexp_matches(nm, '(^|[\s_-])(kopie|copy|backup)([\s_.()-]|$)') then 12 else 0 end - case when regexp_matches(nm, '\(\d+\)\.[^.]+$') then 6 else 0 end
  - case when nm like '~$%' or nm like '%.tmp' or nm like '%.part' then 30 else 0 end as score from low),
ranked as (select *, row_number() over (partition by content_sha256, size_bytes order by score desc, length(path), lower(path), file_id) as rk, count(*) over (partition by content_sha256, size_bytes) as copies from cand),
sel as (select a.content_sha256, a.size_bytes, a.copies, a.file_id as golden_file_id, a.path as golden_path, a.score as golden_score, a.score - coalesce(b.score, 0) as margin
  from ranked a left join ranked b on a.content_sha256 = b.content_sha256 and a.size_bytes = b.size_bytes and b.rk = 2 where a.rk = 1),
chosen as (select *, case when copies = 1 or margin >= 8 then 'high' when margin > 0 then 'medium' else 'low' end as confidence, case when copies = 1 then 'single_source' when margin > 0 then 'golden_selected' else 'golden_selected_tiebreak' end as status,
  case when copies = 1 then 'not_applicable' when margin >= 8 then 'high' when margin > 0 then 'medium' else 'low' end as comparison from sel)"""


@query("g01_provenance", f"with {CAND} select file_id, score from cand")
def _(v):
    return ops.candidates(v.files).select("file_id", "score")


@query("g02_rank_members", f"with {CAND} select content_sha256, size_bytes, file_id, score, rk as rank from ranked")
def _(v):
    return ops.rank_members(v.files).select(*ops.KEY, "file_id", "score", F.col("rank").cast("long").alias("rank"))


@query("g03_selection", f"with {CAND} select * from chosen")
def _(v):
    return ops.selection(v.files)


@query("g04_manifest", f"""with {CAND}, m as (select c.*, p.golden_file_id as existing_id, exists (select 1 from cand x where x.content_sha256 = c.content_sha256 and x.size_bytes = c.size_bytes and x.file_id = p.golden_file_id) as member,
  coalesce((select string_agg(r.file_id::varchar, ',' order by r.rk) from ranked r where r.content_sha256 = c.content_sha256 and r.size_bytes = c.size_bytes and r.rk between 2 and 11), '') as alternatives
  from chosen c left join persisted_groups p on p.content_sha256 = c.content_sha256 and p.size_bytes = c.size_bytes),
n as (select *, case when existing_id is null then 'new_proposal' when not member then 'persisted_golden_outside_assessment_scope' when existing_id = golden_file_id then 'unchanged' else 'golden_change_review' end as change from m)
select * exclude (member), case when change = 'golden_change_review' then 'persisted_golden_would_change' when change = 'persisted_golden_outside_assessment_scope' then change when comparison = 'low' then 'deterministic_tiebreak_between_exact_copies'
  when comparison = 'medium' then 'provenance_margin_requires_review' when change = 'new_proposal' then 'no_persisted_golden' else 'not_required' end as review_reason from n""")
def _(v):
    return ops.manifest(v.files, v.persisted_groups)


@query("g04b_alternatives", f"with {CAND} select r.content_sha256, r.size_bytes, r.file_id, r.score, c.golden_file_id from ranked r join chosen c on c.content_sha256 = r.content_sha256 and c.size_bytes = r.size_bytes where r.rk > 1")
def _(v):
    return ops.alternatives(v.files)


@query("g05_regroup_events", f"""with {CAND}, t as (select distinct content_sha256, size_bytes from files where file_id % 4 = 1 and content_sha256 is not null)
select * from (select content_sha256, size_bytes, o.golden_file_id as old_id, n.golden_file_id as new_id, case when o.golden_file_id is null then 'GOLDEN_RECORD_SELECTED' when n.golden_file_id is null then 'GROUP_REMOVED' when o.golden_file_id <> n.golden_file_id then 'GOLDEN_RECORD_CHANGED' end as event
  from t left join persisted_groups o using (content_sha256, size_bytes) left join chosen n using (content_sha256, size_bytes) where o.golden_file_id is not null or n.golden_file_id is not null) where event is not null""")
def _(v):
    return ops.regroup(v.files, v.persisted_groups, v.files.where("file_id % 4 = 1"))


@query("g06_members", "select content_sha256, size_bytes, file_id, file_id = golden_file_id as is_golden from files join persisted_groups using (content_sha256, size_bytes) where deleted_epoch is null")
def _(v):
    return ops.members(v.files, v.persisted_groups)


@query("g07_empty_files", "select file_id, path from files where deleted_epoch is null and size_bytes = 0")
def _(v):
    return v.files.where("deleted_epoch is null and size_bytes = 0").select("file_id", "path")


BASE = f"""with {CAND}, rows_ as (select *, starts_with(path, '/data/src1') as in_base from files where deleted_epoch is null and path is not null),
h as (select * from rows_ r where content_sha256 is not null and exists (select 1 from rows_ b where b.in_base and b.content_sha256 = r.content_sha256 and b.size_bytes = r.size_bytes)),
g as (select content_sha256, size_bytes, count(*) filter (in_base) as baseline_copies, count(*) filter (not in_base) as historical_copies from h group by 1, 2),
k as (select g.*, coalesce((select p.golden_file_id from persisted_groups p join h on h.file_id = p.golden_file_id where p.content_sha256 = g.content_sha256 and p.size_bytes = g.size_bytes), c.golden_file_id) as canonical_id
  from g left join chosen c on c.content_sha256 = g.content_sha256 and c.size_bytes = g.size_bytes union all select content_sha256, size_bytes, 1, 0, file_id from rows_ where in_base and content_sha256 is null),
b as (select *, case when size_bytes = 0 then 'empty_file' when content_sha256 is null then 'unassessed' when historical_copies > 0 and baseline_copies > 1 then 'exact_duplicate_all_zones' when historical_copies > 0 then 'exact_duplicate_historical' when baseline_copies > 1 then 'exact_duplicate_within_baseline' else 'baseline_only' end as relationship,
  case when content_sha256 is null then 0 else size_bytes * (baseline_copies + historical_copies - 1) end as max_reclaimable, case when content_sha256 is null then 0 else size_bytes * historical_copies end as historical_reclaimable,
  case when content_sha256 is null then 0 else size_bytes * (baseline_copies - 1) end as baseline_reclaimable from k)"""


def _baseline(v):
    return ops.baseline(v.files, v.persisted_groups, F.col("path").startswith("/data/src1"))


@query("g08_baseline", f"{BASE} select * from b")
def _(v):
    return _baseline(v)


@query("g09_activity", f"select file_id, case when modified_at_fs is null or modified_at_fs > {AS_OF} then 'needs_temporal_review' when modified_at_fs >= {AS_OF} - 31536000 then 'active_candidate' else 'legacy_review_candidate' end as activity from files")
def _(v):
    return ops.activity(v.files, AS_OF, 1).select("file_id", "activity")


@query("g10_baseline_metrics", f"{BASE} select relationship, count(*) as groups, sum(baseline_copies)::bigint as baseline_files, sum(max_reclaimable)::bigint as max_reclaimable, sum(historical_reclaimable)::bigint as historical_reclaimable, sum(baseline_reclaimable)::bigint as baseline_reclaimable from b group by 1")
def _(v):
    sums = [F.sum(c).alias(c) for c in ("max_reclaimable", "historical_reclaimable", "baseline_reclaimable")]
    return _baseline(v).groupBy("relationship").agg(F.count("*").alias("groups"), F.sum("baseline_copies").alias("baseline_files"), *sums)


REVIEWED = """g as (select content_sha256, size_bytes, golden_file_id, count(*) as copies, string_agg(file_id::varchar, ',' order by (file_id <> golden_file_id), lower(path), file_id) as file_ids from files join persisted_groups using (content_sha256, size_bytes) where deleted_epoch is null group by 1, 2, 3 having count(*) > 1),
l as (select content_sha256, arg_max(decision, created_epoch * 1000000 + review_id) as latest_decision, max(review_id) as latest_review_id from reviews group by 1)"""


@query("g11_review_groups", f"with {REVIEWED} select g.*, latest_decision, latest_review_id, size_bytes * (copies - 1) as savings from g left join l using (content_sha256)")
def _(v):
    return ops.duplicate_review_groups(v.files, v.persisted_groups, v.reviews)


@query("g12_handoff", """with c as (select content_sha256, size_bytes, max(file_id) as selected_file_id, case when min(file_id) % 5 = 0 then 'withdrawn' else 'selected_leader' end as action from files where content_sha256 is not null and size_bytes > 0 group by 1, 2)
select content_sha256, size_bytes, selected_file_id, r.file_id as redundant_id, case when action <> 'selected_leader' then 'review_withdrawn' when p.golden_file_id <> selected_file_id then 'golden_switch_required' when r.deleted_epoch is not null or s.deleted_epoch is not null then 'copy_unavailable' else 'ready' end as reason
from c join persisted_groups p using (content_sha256, size_bytes) join files r using (content_sha256, size_bytes) join files s on s.file_id = selected_file_id where r.file_id <> selected_file_id""")
def _(v):
    action = F.when(F.min("file_id") % 5 == 0, "withdrawn").otherwise("selected_leader")
    choices = v.files.where("content_sha256 is not null and size_bytes > 0").groupBy(*ops.KEY).agg(F.max("file_id").alias("selected_file_id"), action.alias("action"))
    return ops.handoff(v.files, v.persisted_groups, choices)


@query("g13_review_summary", f"with {REVIEWED} select coalesce(latest_decision, 'open') as state, count(*) as groups, sum(copies)::bigint as copies, sum(size_bytes * (copies - 1))::bigint as savings from g left join l using (content_sha256) group by 1")
def _(v):
    groups = ops.duplicate_review_groups(v.files, v.persisted_groups, v.reviews)
    return groups.groupBy(F.coalesce("latest_decision", F.lit("open")).alias("state")).agg(F.count("*").alias("groups"), F.sum("copies").alias("copies"), F.sum("savings").alias("savings"))

"""Queries of review events and learning (L), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import learning as ops
from foliant.operators.classify import NAME_ENDINGS
from foliant.operators import workset
from foliant.plans.registry import query
from foliant.plans.workset import CURRENT, LATEST_NOM
from foliant.sources.fixtures import AS_OF

LR = "lr as (select * from reviews qualify row_number() over (partition by file_id, review_type order by created_epoch desc, review_id desc) = 1), t as (select * from lr where review_type = 'target')"
STEM = r"lower(regexp_replace(filename, '(.)\.[^.]+$', '\1'))"
IDENT = STEM
for _ending in NAME_ENDINGS:
    IDENT = f"regexp_replace({IDENT}, '{_ending}', '')"
IDENT = f"trim(regexp_replace({IDENT}, '[^a-z0-9]+', ' ', 'g'))"


def _uuid(name: str) -> str:
    return f"(select concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17:17])::int & 3) | 8)) || h[18:20], h[21:32]) from (select sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode({name})) as h))"


@query("l01_latest_reviews", f"with {LR} select file_id, review_type, review_id, decision from lr")
def _(v):
    return ops.latest_reviews(v.reviews).select("file_id", "review_type", "review_id", "decision")


@query("l02_accepted", f"with {LR} select file_id, category, family, review_id from t join (select file_id, content_sha256 from files where deleted_epoch is null) f using (file_id, content_sha256) where decision = 'accepted'")
def _(v):
    return ops.accepted_classification(v.reviews, v.files)


@query("l03_refinement_queue", f"with {LR} select file_id, decision, created_epoch from t where decision <> 'accepted'")
def _(v):
    return ops.refinement_queue(v.reviews).select("file_id", "decision", "created_epoch")


@query("l04_family_preferences", f"with {LR} select source_family, family, count(*) as support, arg_min(file_id, created_epoch * 1000000 + review_id) as first_file from t where decision = 'accepted' and family is not null group by 1, 2 having count(*) >= 2")
def _(v):
    return ops.family_preferences(v.reviews)


@query("l05_family_candidates", f"with {LR} select family, count(*) filter (decision = 'accepted') as accepted, count(*) filter (decision <> 'accepted') as counterexamples, arg_min(category, created_epoch * 1000000 + review_id) as category from t where family is not null group by 1 having accepted >= 3 and counterexamples = 0")
def _(v):
    return ops.family_candidates(v.reviews)


RULES = "cr as (select source_family, category, family, count(*) as support, count(distinct target_path) as paths, array_to_string(list_transform(list(file_id order by created_epoch, review_id)[1:5], lambda x: x::varchar), ',') as examples from reviews where review_type = 'target' and decision <> 'rejected' and family is not null group by 1, 2, 3), cf as (select *, case when paths > 1 then 'conflict' when support >= 3 then 'high' when support = 2 then 'medium' else 'low' end as confidence from cr)"


@query("l06_correction_rules", f"with {RULES} select * from cf")
def _(v):
    return ops.correction_rules(v.reviews)


@query("l07_privacy_rules", f"""with {LR}, vt as (select source_family, privacy, count(*) as votes from lr where review_type = 'privacy' group by 1, 2), b as (select source_family, privacy as label, votes, sum(votes) over (partition by source_family)::bigint as total, row_number() over (partition by source_family order by votes desc, privacy) as k from vt)
select source_family, label, votes, total, total - votes as counterexamples, round_even(votes / total, 4) as agreement, case when total >= 5 and round_even(votes / total, 4) >= 0.9 then 'high' when total >= 2 and round_even(votes / total, 4) >= 0.75 then 'medium' else 'low' end as confidence from b where k = 1""")
def _(v):
    return ops.privacy_rules(v.reviews)


@query("l08_proposal_quality", rf"""with {LR}, d as (select 'path' as dimension, regexp_replace(regexp_replace(lower(proposed_path), '/\./', '/', 'g'), '/{{2,}}', '/', 'g') as a, regexp_replace(regexp_replace(lower(target_path), '/\./', '/', 'g'), '/{{2,}}', '/', 'g') as b from t
  union all select 'family', source_family, family from t union all select 'privacy', proposed_privacy, privacy from lr where review_type = 'privacy')
select dimension, count(*) as total, count(*) filter (a = b) as "right", count(*) filter (a <> b) as wrong, count(*) filter (a is null or b is null) as missing, round_even(count(*) filter (a = b) / nullif(count(*) filter (a = b) + count(*) filter (a <> b), 0), 4) as accuracy from d group by 1""")
def _(v):
    return ops.proposal_quality(v.reviews)


@query("l09_path_audit", rf"""with {LR}, s as (select file_id, filename, 'system' as side, proposed_path as p from t union all select file_id, filename, 'human', target_path from t), q as (select *, regexp_replace(regexp_replace(coalesce(p, ''), '/{{2,}}', '/', 'g'), '/$', '') as single from s)
select file_id, side, case when p is null then 'missing' when list_contains(string_split(p, '/'), '.') then 'invalid' when p <> single then 'normalised' else 'valid' end as status, case when p is null then 'not_absolute' when list_contains(string_split(p, '/'), '.') then 'relative_segment' when p <> single then 'separator_collapsed' else '' end as notes from q""")
def _(v):
    return ops.path_audit(v.reviews)


TRAJ = f"{LR}, w as (select distinct file_id, string_split(target_path, '/')[3] as folder, unnest(regexp_split_to_array(lower(filename), '[^a-z0-9]+')) as term from t where decision = 'accepted' and target_path is not null), c as (select term, folder, count(distinct file_id) as support from w where length(term) >= 2 group by 1, 2), tr as (select folder, term, support, sum(support) over (partition by term)::bigint - support as counterexamples from c qualify support >= 2)"


@query("l10_trajectory_rules", f"with {TRAJ} select * from tr")
def _(v):
    return ops.trajectory_rules(v.reviews)


@query("l11_apply_trajectory", f"with {TRAJ}, x as (select distinct file_id, unnest(regexp_split_to_array(lower(filename), '[^a-z0-9]+')) as term from files) select file_id, min(folder) as folder from x join tr using (term) where counterexamples = 0 group by 1 having count(distinct folder) = 1")
def _(v):
    return ops.apply_trajectory(v.files, ops.trajectory_rules(v.reviews))


CTX = f"{LR}, cx as (select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as support, min(category) as category from t where decision = 'accepted' group by 1 having count(distinct category) = 1)"


@query("l12_context", f"with {CTX} select file_id, category, support from files join cx on cx.folder = folder_path")
def _(v):
    return ops.apply_context(v.files, ops.context_rules(v.reviews))


def _able(rows: str, extra: str = "") -> str:
    return f"(select *, {IDENT} as identity, {STEM} as stem from {rows} where lower(extension) in ('pdf', 'docx', 'xlsx') {extra})"


@query("l13_similar", f"""with {LR}, ac as (select * from {_able("t", "and decision = 'accepted' and category is not null and family is not null")} where length(identity) >= 5), vo as (select identity, category, family, count(*) as votes from ac group by all),
rk as (select *, row_number() over (partition by identity order by votes desc, category, family) as k, sum(votes) over (partition by identity)::bigint as reviews, count(*) over (partition by identity) > 1 as conflicting from vo),
b as (select a.*, c.votes is null or a.votes > c.votes as clear from rk a left join rk c on c.identity = a.identity and c.k = 2 where a.k = 1)
select f.file_id, case when clear then category end as category, case when clear then b.family end as family, case when clear then 'proposed' else 'conflict' end as status, votes as support, reviews, round(votes / reviews, 2) as support_ratio, conflicting, case when stem in (select stem from ac) then 1.0::double else 0.95::double end as score
from {_able("named_files", "and deleted_epoch is null and file_id not in (select file_id from ac)")} f join b using (identity) where length(f.identity) >= 5""")
def _(v):
    return ops.similar_proposals(v.named_files, v.reviews)


CITED = "select file_id, min(category) as category, collect_list(review_id) as review_ids from reviews where review_type = 'target' group by file_id"


@query("l14_revalidate", f"with {LR}, ci as (select file_id, min(category) as claimed, list(review_id) as ids from reviews where review_type = 'target' group by 1), x as (select file_id, claimed, unnest(ids) as review_id from ci) select x.file_id, claimed, count(*) as cited, count(t.category) as current, count(*) filter (t.category = claimed) as agree, 2 * count(*) filter (t.category = claimed) > count(*) as valid from x left join t on t.review_id = x.review_id and t.decision = 'accepted' group by 1, 2")
def _(v):
    return ops.revalidate(v.spark.sql(CITED.replace("from reviews", "from {reviews}"), reviews=v.reviews), v.reviews)


def _examples(cut: str, limit: int) -> str:
    terms = f"list_distinct(list_filter({cut}, lambda x: length(x) > 2))"
    return f"""with {LR}, ac as (select review_id, file_id, created_epoch, {terms} as terms from t where decision = 'accepted' and category is not null and family is not null order by created_epoch desc, review_id desc limit {limit}),
p as (select f.file_id, a.review_id, a.file_id as af, a.created_epoch, len(list_intersect(a.terms, f.terms)) as shared from (select file_id, {terms} as terms from named_files) f join ac a on a.file_id <> f.file_id),
q as (select * from p qualify row_number() over (partition by file_id order by created_epoch desc, review_id desc) <= 100)
select file_id, review_id, shared::int as shared, row_number() over (partition by file_id order by shared desc, created_epoch, af, review_id) as place from q qualify place <= 3"""


@query("l15_examples", _examples("regexp_split_to_array(lower(filename), '[^a-z0-9]+')", 100))
def _(v):
    return ops.examples(v.named_files, v.reviews)


@query("l15b_examples_by_spaces", _examples(r"regexp_split_to_array(replace(lower(filename), '_', ' '), '\s+')", 101))
def _(v):
    return ops.examples(v.named_files, v.reviews, words="spaces")


@query("l16_rule_context", f"with {RULES} select source_family, category, family, support from cf where confidence in ('medium', 'high') order by support desc, source_family, category, family limit 10")
def _(v):
    return ops.rule_context(ops.correction_rules(v.reviews)).select("source_family", "category", "family", "support")


SUBMITTED = "select e.event_id as submission_id, e.user_id as file_id, case when e.event_id % 13 = 0 then 'other' when e.event_id % 2 = 0 then 'target' else 'privacy' end as review_type, case when e.event_id % 17 = 0 then 'maybe' else 'accepted' end as decision, case when e.event_id % 5 = 0 then cast(e.event_id % 70 as int) end as months, case when e.event_id % 7 = 0 then 'old' else f.content_sha256 end as content_sha256 from events e left join files f on f.file_id = e.user_id"
JUDGED = f"""sb as ({SUBMITTED}), jd as (select sb.submission_id, sb.file_id, sb.review_type, sb.decision, sb.months, lr.review_id as supersedes, case when sb.review_type not in ('target', 'privacy') then 'unknown_review_type' when sb.decision not in ('accepted', 'corrected', 'rejected') then 'unknown_decision' when months is not null and not months between 1 and 60 then 'invalid_period' when f.file_id is null then 'file_not_in_workset'
  when f.content_sha256 is distinct from sb.content_sha256 then 'content_changed' end as reason from sb left join (select file_id, content_sha256 from files where deleted_epoch is null) f on f.file_id = sb.file_id left join (select file_id, review_type, review_id from lr) lr on lr.file_id = sb.file_id and lr.review_type = sb.review_type)"""


def _submitted(v):
    rows = v.spark.sql(SUBMITTED.replace("events e", "{events} e").replace("files f", "{files} f"), events=v.events, files=v.files)
    return ops.submissions(rows, v.files, v.reviews, AS_OF)


@query("l17_submissions", f"with {LR}, {JUDGED} select submission_id, file_id, review_type, decision, supersedes, {AS_OF} + months * 2592000 as active_until, {_uuid('submission_id::varchar || ' + chr(39) + ':' + chr(39) + ' || review_type')} as event_key from jd where reason is null")
def _(v):
    return _submitted(v)[0]


@query("l17b_rejections", f"with {LR}, {JUDGED} select submission_id, reason from jd where reason is not null")
def _(v):
    return _submitted(v)[1]


@query("l18_bulk", "with b as (select cast(floor(event_id / 20) as bigint) as batch_id, event_id % 190 as file_id from events), g as (select batch_id from b left join (select file_id as k from files where deleted_epoch is null) f on f.k = b.file_id group by 1 having count(*) <= 50 and count(*) = count(distinct file_id) and count(*) = count(k)) select batch_id, file_id, unnest(['target', 'privacy']) as review_type from b where batch_id in (select batch_id from g)")
def _(v):
    batches = v.events.select(F.floor(F.col("event_id") / 20).alias("batch_id"), (F.col("event_id") % 190).alias("file_id"))
    return ops.bulk_events(batches, v.files)


@query("l19_accepted_proposals", f"with p as (select j.file_id, f.content_sha256, 'job-' || job_id as k from jobs j join files f on f.file_id = j.file_id where j.status = 'ready' and j.content_state = 'current' and f.deleted_epoch is null and f.content_sha256 is not null), x as (select file_id, k, unnest(['target', 'privacy', 'lifecycle']) as review_type from p) select file_id, review_type, {_uuid('k || ' + chr(39) + ':' + chr(39) + ' || review_type')} as event_key from x")
def _(v):
    ready = v.jobs.where("status = 'ready' and content_state = 'current'").select("file_id", F.concat(F.lit("job-"), F.col("job_id")).alias("proposal_key"))
    return ops.accepted_proposals(ready.join(v.files.select("file_id", "content_sha256"), "file_id"), v.files)


@query("l20_nominations", f"""with {LATEST_NOM}, {CURRENT}, q as (select event_id as request_id, user_id as file_id, case when event_id % 2 = 0 then 'archive' else 'inactive' end as nomination_type, case when event_id % 3 = 0 then 'withdraw' else 'nominate' end as action, 1704067200 + event_id as created_epoch from events),
o as (select q.*, review_days, case when q.action = 'withdraw' and coalesce(n.action, '') <> 'nominate' then 'nothing_to_withdraw' when q.action = 'nominate' and coalesce(n.action, '') = 'nominate' then 'already_nominated' else 'recorded' end as outcome from q left join n using (file_id, nomination_type) cross join cp)
select request_id, file_id, nomination_type, action, outcome, case when outcome = 'recorded' and action = 'nominate' then created_epoch + review_days * 86400 end as review_epoch from o""")
def _(v):
    r = F.col("event_id")
    requests = v.events.select(r.alias("request_id"), F.col("user_id").alias("file_id"), F.when(r % 2 == 0, "archive").otherwise("inactive").alias("nomination_type"), F.when(r % 3 == 0, "withdraw").otherwise("nominate").alias("action"), (1704067200 + r).alias("created_epoch"))
    return ops.nomination_events(requests, workset.nominations(v.nominations), workset.current_policies(v.policies, AS_OF))


@query("l21_leaders", "with c as (select content_sha256, max(file_id) as leader_id from files where content_sha256 is not null group by 1), m as (select content_sha256, list_sort(list(file_id)) as ids from files where deleted_epoch is null and content_sha256 is not null group by 1) select content_sha256, leader_id, array_to_string(list_transform(list_filter(ids, lambda x: x <> leader_id), lambda x: x::varchar), ',') as redundant from c join m using (content_sha256) where len(ids) >= 2 and list_contains(ids, leader_id)")
def _(v):
    choices = v.files.where("content_sha256 is not null").groupBy("content_sha256").agg(F.max("file_id").alias("leader_id"))
    return ops.leader_decisions(choices, v.files)

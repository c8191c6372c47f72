"""Queries of the review intake with all checks (L-17, L-18), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import intake as ops
from foliant.operators.classify import DEFAULT
from foliant.plans.registry import query
from foliant.sources.fixtures import AS_OF

_q = lambda names: ", ".join(f"'{n}'" for n in names)
KEY = "concat(substr(md5(cast({} as varchar(20))), 1, 8), '-', substr(md5(cast({} as varchar(20))), 9, 4), '-4aaa-8bbb-', substr(md5(cast({} as varchar(20))), 1, 12))"


def _key(x: str) -> str:
    return KEY.format(x, x, x)


CATEGORY, FAMILY = DEFAULT.categories[0], DEFAULT.codes[0]
#: A submission for each event; each check is broken by some of them.
SENT = f"""select event_id as submission_id, case when event_id % 61 = 0 then null else user_id end as file_id,
  case when event_id % 59 = 0 then 'no-key' when event_id % 53 = 0 then {_key('event_id - 53')} when event_id % 47 = 0 then {_key('-event_id')} else {_key('event_id')} end as idempotency_key,
  case when event_id % 43 = 0 then 'other' when event_id % 3 = 1 then 'privacy_classification' when event_id % 3 = 2 then 'lifecycle' end as review_type,
  case when event_id % 41 = 0 then 'maybe' when event_id % 5 = 0 then 'rejected' else 'accepted' end as decision,
  case when event_id % 37 = 0 then 'none' when event_id % 3 = 1 then 'medium' end as privacy, case when event_id % 31 = 0 then 'gone' when event_id % 2 = 0 then 'active' else 'archive' end as lifecycle,
  case when event_id % 29 = 0 then 'six' when event_id % 29 = 1 then cast(event_id % 300 as varchar(9)) when event_id % 6 = 2 then '12' end as active_months,
  case when event_id % 23 = 0 then 'nowhere' else '{CATEGORY}' end as category, case when event_id % 23 = 1 then 'No Code' when event_id % 23 = 2 then 'no_family' else '{FAMILY}' end as family,
  case when event_id % 71 = 0 then repeat('n', 2001) else 'fine' end as notes, case when event_id % 73 = 0 then repeat('c', 121) end as proposed_category, case when event_id % 79 = 0 then repeat('f', 121) end as proposed_family,
  case when event_id % 19 = 0 then 'target/x' when event_id % 19 < 5 then '/target//b/' end as target_path, case when event_id % 17 = 0 then 'loose' when event_id % 17 = 1 then '/target/c/' when event_id % 17 = 2 then '/target/b/' end as path_suggestion,
  case when event_id % 83 = 0 then 'perhaps' when event_id % 17 in (1, 2) then 'accepted' end as suggestion_decision, case when event_id % 67 = 0 then '  ..' when event_id % 11 = 0 then 'better name' end as proposed_filename,
  case when event_id % 89 = 0 then 'p-1' when event_id % 13 = 0 then {_key('user_id + event_id % 2')} end as ai_proposal_id from events"""
OLD = "select file_id, review_id, created_epoch, case review_type when 'privacy' then 'privacy_classification' else 'target_path' end as review_type from reviews"
STORED = f"select {_key('-event_id')} as idempotency_key, user_id as file_id, case when event_id % 2 = 0 then 'accepted' else 'passed' end as decision from events where event_id % 47 = 0"
WORKSET = "select file_id, filename, case when deleted_epoch is not null then 'excluded' when file_id % 3 = 0 then 'inactive' else 'active' end as workset_status from files"
PROPOSED = f"select file_id, {_key('file_id + k')} as proposal_id, k as created_epoch from files cross join (select distinct event_id % 2 as k from events) ks"

PATH = lambda c: f"case when starts_with({c}, '/target/') then regexp_replace(regexp_replace({c}, '/{{2,}}', '/', 'g'), '/$', '') || '/' || name end"
WHOLE = "regexp_matches(active_months, '^[+-]?[0-9]{1,9}$')"
UUID = "'^[{]?(urn:uuid:)?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}[}]?$'"
REVIEW = rf"""with sent as ({SENT}), old_ as ({OLD}), stored as ({STORED}), ws as (select * from ({WORKSET}) w where workset_status <> 'excluded'), newest as (select file_id, arg_max(proposal_id, created_epoch) as newest from ({PROPOSED}) p group by 1),
prior as (select file_id, review_type, arg_max(review_id, (created_epoch, review_id)) as supersedes from old_ group by 1, 2),
s as (select sent.* replace (coalesce(sent.review_type, 'target_path') as review_type, coalesce(suggestion_decision, 'no_suggestion') as suggestion_decision), ws.filename as name, newest from sent left join ws using (file_id) left join newest using (file_id)),
n as (select s.*, supersedes, {PATH('target_path')} as path, {PATH('path_suggestion')} as suggestion, case proposed_filename when 'better name' then 'better name' || regexp_extract(name, '(\.[^.]+)$', 1) end as new_filename from s left join prior on prior.file_id = s.file_id and prior.review_type = s.review_type),
j as (select *, case when not coalesce(regexp_matches(idempotency_key, {UUID}), false) or file_id is null then 'invalid_key_or_file' when not coalesce(decision in ({_q(ops.DECISIONS)}), false) then 'invalid_decision' when review_type not in ({_q(ops.TYPES)}) then 'invalid_review_type'
  when review_type = 'privacy_classification' and not coalesce(privacy in ({_q(ops.PRIVACY)}), false) then 'invalid_privacy' when review_type = 'lifecycle' and not coalesce(lifecycle in ({_q(ops.LIFECYCLES)}), false) then 'invalid_lifecycle'
  when active_months is not null and not {WHOLE} then 'months_not_whole' when active_months is not null and (lifecycle <> 'active' or not try_cast(active_months as int) between 1 and 120) then 'months_out_of_range' when suggestion_decision not in ({_q(ops.SUGGESTION_DECISIONS)}) then 'invalid_suggestion_decision'
  when family is not null and not regexp_matches(family, '^[a-z0-9_''-]{{1,80}}$') then 'invalid_family_code' when review_type = 'target_path' and category not in ({_q(DEFAULT.categories)}) then 'unknown_category' when review_type = 'target_path' and family not in ({_q(DEFAULT.codes)}) then 'unknown_family'
  when length(notes) > 2000 then 'note_too_long' when length(proposed_category) > 120 then 'proposed_category_too_long' when length(proposed_family) > 120 then 'proposed_family_too_long' when name is null then 'not_in_workset'
  when proposed_filename is not null and review_type <> 'target_path' then 'filename_needs_target_review' when proposed_filename is not null and new_filename is null then 'invalid_filename'
  when ai_proposal_id is not null and not regexp_matches(ai_proposal_id, {UUID}) then 'invalid_proposal_id' when ai_proposal_id is not null and (review_type <> 'target_path' or ai_proposal_id is distinct from newest) then 'stale_proposal'
  when target_path is not null and path is null or path_suggestion is not null and suggestion is null then 'invalid_target_path' when suggestion_decision = 'accepted' and path is distinct from suggestion then 'suggestion_differs' end as why from n),
f as (select idempotency_key, min(submission_id) as first_id, arg_min(file_id, submission_id) as first_file, arg_min(decision, submission_id) as first_decision from j where why is null group by 1),
o as (select j.*, first_id, st.idempotency_key is not null as there, coalesce(st.file_id, first_file) = j.file_id and coalesce(st.decision, first_decision) = j.decision as same from j left join f using (idempotency_key) left join stored st using (idempotency_key)),
r as (select *, case when why is not null then 'rejected' when not there and first_id = submission_id then 'stored' when same then 'already_stored' else 'rejected' end as status from o)"""
COLUMNS = f"submission_id, file_id, idempotency_key, review_type, decision, privacy, lifecycle, case when review_type = 'lifecycle' then {AS_OF} + try_cast(active_months as bigint) * 2592000 end as active_until, category, family, path as target_path, new_filename, supersedes"


def _view(v, sql: str):
    found = sql
    tables = {}
    for t in ("events", "files", "reviews"):
        if f"from {t}" in found:
            found, tables[t] = found.replace(f"from {t}", f"from {{{t}}}"), getattr(v, t)
    return v.spark.sql(found, **tables)


def _judged(v):
    workset = _view(v, WORKSET).where("workset_status <> 'excluded'")
    return ops.review(_view(v, SENT), workset, _view(v, PROPOSED), _view(v, OLD), _view(v, STORED), AS_OF, ["/target"])


@query("l17c_intake", f"{REVIEW} select {COLUMNS} from r where status = 'stored'")
def _(v):
    return ops.events(_judged(v))


@query("l17d_intake_rejections", f"{REVIEW} select submission_id, case when why is not null then why else 'key_of_another_review' end as reason from r where status = 'rejected'")
def _(v):
    return ops.rejections(_judged(v))


#: A batch for each dozen of files; some break a rule, some exist already.
BATCH = "cast(floor(file_id / 12) as bigint)"
ITEMS = f"""select case when {BATCH} % 10 = 0 then 'no-key' else {_key(BATCH)} end as batch_key, case when {BATCH} % 10 = 1 and file_id % 12 = 1 then file_id - 1 when {BATCH} % 10 = 2 and file_id % 12 = 1 then null else file_id end as file_id,
  case when {BATCH} % 10 = 3 and file_id % 12 = 2 then 'nowhere' else '{CATEGORY}' end as category, '{FAMILY}' as family, case when {BATCH} % 10 = 4 and file_id % 12 = 2 then 'none' else 'low' end as privacy, concat('/target/', filename) as target_path
from files where deleted_epoch is null or {BATCH} % 10 = 5
union all select {_key('-1')}, file_id, '{CATEGORY}', '{FAMILY}', 'low', '/target/x' from files"""
SNAPSHOT = "sha256(string_agg(concat_ws(chr(9), file_id::varchar, filename, target_path, privacy), chr(10) order by file_id))"
BULK = f"""with items as ({ITEMS}), ws as (select file_id, filename from ({WORKSET}) w where workset_status in ('active', 'inactive')), rows_ as (select i.*, ws.filename from items i left join ws using (file_id)),
c as (select batch_key, count(*) as n, count(distinct file_id) as files, count(*) filter (file_id is null) as nameless, count(*) filter (filename is null) as absent, count(*) filter (category not in ({_q(DEFAULT.categories)}) or family not in ({_q(DEFAULT.codes)})) as codes, count(*) filter (privacy not in ({_q(ops.PRIVACY)})) as labels,
  {SNAPSHOT} as snapshot from rows_ group by 1),
j as (select *, case when not regexp_matches(batch_key, {UUID}) then 'invalid_key' when n > 50 then 'too_many_files' when nameless > 0 then 'missing_file' when files < n then 'repeated_file' when absent > 0 then 'not_classifiable' when codes > 0 then 'invalid_classification' when labels > 0 then 'invalid_privacy' end as why from c),
st as (select *, case when why is null and substr(batch_key, 1, 1) in ('0', '1') then 'x' when why is null and substr(batch_key, 1, 1) in ('2', '3') then snapshot end as there from j),
b as (select batch_key, n as document_count, case when coalesce(why, case when there is not null and there <> snapshot then 'x' end) is not null then 'rejected' when there is not null then 'already_stored' else 'stored' end as status,
  case when why is not null then why when there is not null and there <> snapshot then 'key_of_another_batch' end as reason, case when why is null and (there is null or there = snapshot) then snapshot end as snapshot from st)"""


def _bulk(v):
    """Batches whose key begins with 0 or 1 are stored with other contents, with 2 or 3 as they are."""
    items, workset = _view(v, ITEMS), _view(v, WORKSET)
    nothing = v.spark.createDataFrame([], "batch_key string, snapshot string")
    records = ops.bulk(items, workset, _view(v, OLD), nothing, NAMESPACE)[0].where("status = 'stored'")
    known = records.where("substr(batch_key, 1, 1) in ('0', '1', '2', '3')").select("batch_key", F.when(F.col("batch_key") < "2", F.lit("x")).otherwise(F.col("snapshot")).alias("snapshot"))
    return ops.bulk(items, workset, _view(v, OLD), known, NAMESPACE)


NAMESPACE = "6ba7b814-9dad-11d1-80b4-00c04fd430c8"


@query("l18b_bulk_batches", f"{BULK} select batch_key, document_count, status, reason, snapshot from b")
def _(v):
    return _bulk(v)[0]


UUID5 = "(select concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17:17])::int & 3) | 8)) || h[18:20], h[21:32]) from (select sha1(from_hex('6ba7b8149dad11d180b400c04fd430c8') || encode(name)) as h))"


@query("l18c_bulk_events", f"""{BULK}, old_ as ({OLD}), prior as (select file_id, review_type, arg_max(review_id, (created_epoch, review_id)) as supersedes from old_ group by 1, 2),
e as (select i.*, unnest(['target_path', 'privacy_classification']) as review_type, unnest(['target', 'privacy']) as k from items i where batch_key in (select batch_key from b where status = 'stored')),
x as (select *, batch_key || '|' || k || ':' || file_id as name from e)
select x.batch_key, x.file_id, x.review_type, {UUID5} as event_key, case when k = 'target' then category end as category, case when k = 'target' then family end as family, case when k = 'privacy' then privacy end as privacy, case when k = 'target' then target_path end as target_path, supersedes
from x left join prior on prior.file_id = x.file_id and prior.review_type = x.review_type""")
def _(v):
    return _bulk(v)[1]

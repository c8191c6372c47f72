"""Queries of move planning and rule classification (M), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.common import latest
from foliant.operators import migration as ops
from foliant.plans.registry import query
from foliant.plans.workset import REVIEWED, _path_review

RULES = r"""ru as (select *, case when regexp_matches(path, '(?i)(^|/)(@eaDir|#recycle|\$recycle\.bin|__pycache__|node_modules|\.git|\.cache|cache|tmp|temp)(/|$)') or extension in ('tmp', 'temp', 'part', 'swp', 'lock') then 'system_or_temporary'
  when extension in ('key', 'pem') then 'secret' when extension in ('exe', 'dll') then 'software_or_system_artifact' when extension in ('doc', 'docx', 'txt', 'pdf', 'xls', 'xlsx') then 'personal_document_candidate' when extension in ('jpg', 'mp3') then 'personal_media_candidate' when extension = 'zip' then 'archive_review' else 'unknown' end as category,
  case when regexp_matches(path, '(?i)(^|/)(finance|bank|medical)(/|$)') or regexp_matches(filename, '(?i)(tax|passport|report_10|report_11|report_12)') then 'sensitive' else 'normal' end as sensitivity from files where deleted_epoch is null and path is not null),
fr as (select *, case when category in ('system_or_temporary', 'secret', 'software_or_system_artifact') then 'excluded' when coalesce(hash_content, '') = '' then 'review_required' when category in ('personal_document_candidate', 'personal_media_candidate') then 'candidate' else 'review_required' end as action,
  case when coalesce(hash_content, '') = '' then 'UNHASHED:' || file_id else hash_content || ':' || coalesce(size_bytes::varchar, 'NULL') end as content_key from ru)"""
INV = f"""{RULES}, gr as (select content_key, min(hash_content) as hash_content, min(size_bytes) as size_bytes, list_distinct(list(category)) as cs, bool_or(sensitivity = 'sensitive') as s, bool_or(action = 'excluded') as x, bool_or(action = 'review_required') as r, count(*) as copies,
  arg_min(file_id, lpad(length(path)::varchar, 6, '0') || path || lpad(file_id::varchar, 12, '0')) as file_id, arg_min(path, lpad(length(path)::varchar, 6, '0') || path) as path, string_agg(path, '|' order by path) as paths, bool_or(starts_with(path, '/data/src0/')) as t from fr group by 1),
inv as (select content_key, hash_content, size_bytes, case when list_contains(cs, 'system_or_temporary') then 'system_or_temporary' when list_contains(cs, 'personal_document_candidate') then 'personal_document_candidate' else 'unknown' end as category, case when s then 'sensitive' else 'normal' end as sensitivity,
  case when t and hash_content is not null then 'already_in_target' when x then 'excluded' when r then 'review_required' else 'candidate' end as action, copies, file_id, path, paths from gr)"""
REV = f"{INV}, rv as (select *, case when category = 'personal_document_candidate' or regexp_extract(path, '\\.([^./]+)$', 1) in ('doc', 'docx', 'txt', 'pdf', 'xls', 'xlsx') then 'personal_document' when category = 'system_or_temporary' then 'project_or_technical' else 'manual_review' end as review_class from inv)"
PROP = f"""{REV}, pr as (select *, case when coalesce(hash_content, '') = '' then 'manual_review' when review_class = 'personal_document' and sensitivity = 'sensitive' then 'document_sensitive' when review_class = 'personal_document' then 'document_standard' when review_class = 'project_or_technical' then 'retain_project_technical' else 'manual_review' end as proposal,
  case when coalesce(hash_content, '') = '' then 'blocked_missing_hash' when review_class = 'personal_document' then 'ready_for_copy_plan' when review_class = 'project_or_technical' then 'retain_in_source' else 'manual_classification_required' end as readiness from rv)"""
PLAN = rf"""{PROP}, pb as (select *, case when contains(lower(paths), '/study/') and ends_with(lower(path), '.docx') then 'projects' when contains(lower(paths), '/finance/') then 'sensitive/finance' when contains(lower(paths), '/study/') then 'documents/study' when contains(lower(paths), '/work/') then 'documents/work' when contains(lower(paths), '/home/') then 'documents/home' else 'documents/unsorted' end as bucket from pr where proposal in ('document_standard', 'document_sensitive')),
pq as (select *, list_transform(string_split(paths, '|'), lambda p: string_split(case when starts_with(p, '/data/') then p[7:] else regexp_extract(p, '[^/]*$') end, '/')) as cuts from pb),
pc as (select *, list_sort(list_filter(list_transform(cuts, lambda c: struct_pack(o := case when c[1] = 'src1' then 0 else 1 end, d := len(case when c[1] = 'src1' then c[2:] else c end), l := length(array_to_string(case when c[1] = 'src1' then c[2:] else c end, '/')), parts := case when c[1] = 'src1' then c[2:] else c end)), lambda x: x.d > 0), 'DESC')[1].parts as parts from pq),
pd as (select *, coalesce(list_position(list_transform(parts[:-2], lambda s: lower(s)), split_part(bucket, '/', 2)), 0) as pos from pc),
pl as (select * exclude (parts, pos, cuts), '/target/' || bucket || '/' || array_to_string(list_transform(parts[pos + 1:], lambda s: regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')), '/') as target, case bucket when 'projects' then 'retain_project_technical' when 'documents/unsorted' then 'manual_target_review' else 'copy_candidate' end as copy_action,
  case when starts_with(bucket, 'sensitive/') then 'blocked_sensitive_policy' else 'not_yet_authorized' end as semantic_scope from pd)"""
#: Words of the given names that stand for sensitive ones.
WORDS = ("tax", "passport", "report_10", "report_11", "report_12")


def _inv(v):
    return ops.content_inventory(v.files, "/data/src0", WORDS)


def _plan(v):
    # Documents in study folders stand for project files, the first source for a wrapper folder.
    rule = F.contains(F.lower("paths"), F.lit("/study/")) & F.endswith(F.lower("path"), F.lit(".docx"))
    return ops.copy_plan(ops.proposal(ops.review_class(_inv(v))), "/target", wrapper="src1", technical_rule=rule)


@query("m01_file_rules", f"with {RULES} select file_id, category, sensitivity, action, content_key from fr")
def _(v):
    return ops.file_rules(v.files, words=WORDS).select("file_id", "category", "sensitivity", "action", "content_key")


@query("m02_content_inventory", f"with {INV} select * from inv")
def _(v):
    return _inv(v)


@query("m03_inventory_summary", f"with {INV} select category, sensitivity, action, count(*) as contents, sum(copies)::bigint as files, sum(size_bytes)::bigint as bytes from inv group by 1, 2, 3")
def _(v):
    return _inv(v).groupBy("category", "sensitivity", "action").agg(F.count("*").alias("contents"), F.sum("copies").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("m04_review_class", f"with {REV} select file_id, review_class from rv")
def _(v):
    return ops.review_class(_inv(v)).select("file_id", "review_class")


@query("m05_proposal", f"with {PROP} select file_id, proposal, readiness from pr")
def _(v):
    return ops.proposal(ops.review_class(_inv(v))).select("file_id", "proposal", "readiness")


@query("m06_copy_plan", f"with {PLAN} select file_id, bucket, target, copy_action, semantic_scope from pl")
def _(v):
    return _plan(v).select("file_id", "bucket", "target", "copy_action", "semantic_scope")


CROWD = "select file_id, hash_content, size_bytes, path, concat('/target/', case when file_id % 2 = 0 then 'Report_' else 'report_' end, cast(cast(floor(file_id / 12) as bigint) as varchar(20)), '.', extension) as target from files where hash_content is not null"
TAKEN = "select concat('/target/report_', cast(file_id as varchar(20)), '.pdf') as path from files where file_id % 3 = 0"


@query("m07_collisions", rf"""with p as ({CROWD}), c as (select lower(target) as lo, count(distinct hash_content) > 1 as crowded from p group by 1), x as (select file_id, case when crowded then regexp_replace(target, '(\.[^./]+)?$', '') || '__' || hash_content[:8] || regexp_extract(target, '(\.[^./]+)$', 1) else target end as target, crowded from p join c on lo = lower(target))
select file_id, target, case when target in ({TAKEN}) then 'target_path_exists' when crowded then 'resolved_hash_suffix' else 'clear' end as collision from x""")
def _(v):
    rows = v.spark.sql(CROWD.replace("from files", "from {files}"), files=v.files)
    taken = v.spark.sql(TAKEN.replace("from files", "from {files}"), files=v.files)
    return ops.resolve_collisions(rows, taken).select("file_id", "target", "collision")


@query("m08_folder_rollup", f"""with {PLAN}, f as (select regexp_replace(path, '/[^/]*$', '') as source_folder, regexp_replace(target, '/[^/]*$', '') as target_folder, copy_action, count(*) as n, sum(size_bytes)::bigint as bytes from pl group by 1, 2, 3)
select source_folder, target_folder, sum(n)::bigint as files, sum(bytes)::bigint as bytes, string_agg(copy_action || '=' || n, ',' order by copy_action) as actions from f group by 1, 2""")
def _(v):
    return ops.folder_rollup(_plan(v))


@query("m09_classification_inventory", """with t as (select content_sha256, size_bytes, '[' || string_agg('{"file_id":' || file_id || ',"modified_at_fs":' || modified_at_fs || '}', ',' order by file_id) || ']' as members from files where deleted_epoch is null group by 1, 2)
select golden_file_id, case f.extension when 'pdf' then 'pdf_text' when 'txt' then 'plain_text' else 'office_xml' end as route, members from persisted_groups g join files f on f.file_id = g.golden_file_id join t on t.content_sha256 = g.content_sha256 and t.size_bytes = g.size_bytes""")
def _(v):
    return ops.classification_inventory(v.persisted_groups, v.files)


#: Words of the invented texts, names and folders, by category.
TERMS = {"documents/study": ("the", "study", "report", "of the"), "documents/work": ("and", "work", "der", "in the"), "sensitive/finance": ("finance", "les", "tax"), "documents/home": ("home", "las", "und", "de la")}
TERM_ROWS = ", ".join(f"('{c}', '{t}', {i})" for c, ts in TERMS.items() for i, t in enumerate(ts))
_CUT = r"regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+')"
CLASS = f"""tm(category, term, place) as (values {TERM_ROWS}), fl as (select f.file_id, d.text, f.filename, f.folder_path from files f join documents d on d.doc_id = f.file_id),
wd as (select file_id, 1 as f, 5 as w, {_CUT.format("text")} as words from fl union all select file_id, 2, 2, {_CUT.format("filename")} from fl union all select file_id, 3, 1, {_CUT.format("folder_path")} from fl),
ws as (select file_id, f, w, words, ' ' || array_to_string(words, ' ') || ' ' as line from wd),
ht as (select file_id, f, w, category, term, place from ws join tm on contains(line, ' ' || term || ' ')),
sc as (select f.file_id, c.category, coalesce(sum(w), 0)::int as score, coalesce(string_agg(term, ',' order by place) filter (f = 1), '-') as a, coalesce(string_agg(term, ',' order by place) filter (f = 2), '-') as b, coalesce(string_agg(term, ',' order by place) filter (f = 3), '-') as c from fl f cross join (select distinct category from tm) c left join ht h on h.file_id = f.file_id and h.category = c.category group by 1, 2),
rk as (select *, row_number() over (partition by file_id order by score desc, category) as k from sc),
cl as (select a.file_id, case when a.score = 0 then 'documents/unsorted' else a.category end as category, a.score, a.score - b.score as margin, case when a.score = 0 then 'low' when a.score >= 10 and a.score - b.score >= 3 then 'high' when a.score > b.score then 'medium' else 'low' end as confidence, case when a.score = 0 then 'no signals' else 'text=' || a.a || '; filename=' || a.b || '; folder_path=' || a.c end as reasons
  from rk a join rk b on b.file_id = a.file_id and b.k = 2 where a.k = 1)"""


def _classified(v):
    return ops.classify_content(v.files.join(v.documents.select(F.col("doc_id").alias("file_id"), "text"), "file_id"), TERMS)


@query("m10_classify_content", f"with {CLASS} select * from cl")
def _(v):
    return _classified(v)


STATS = "select doc_id as file_id, length(text) as characters, case when doc_id % 13 = 0 then 3 else 9 end as words, case when doc_id % 17 = 0 then 'broken' end as error from documents"


@query("m11_extraction_states", f"select file_id, case when error is not null then 'error' when characters = 0 then 'no_text' when words < 5 then 'needs_ocr' else 'extracted' end as state from ({STATS})")
def _(v):
    return ops.extraction_states(v.spark.sql(STATS.replace("from documents", "from {documents}"), documents=v.documents)).select("file_id", "state")


@query("m12_classification_plan", rf"""with {CLASS}, p as (select c.*, f.hash_content, case when confidence = 'high' then 'proposed' when category = 'documents/unsorted' then 'manual_classification' else 'review_required' end as review_status, '/target/' || category || '/' || filename as target from cl c join files f using (file_id) where deleted_epoch is null and hash_content is not null),
x as (select lower(target) as lo, count(distinct hash_content) > 1 as crowded from p group by 1)
select file_id, review_status, case when crowded then regexp_replace(target, '(\.[^./]+)?$', '') || '__' || hash_content[:8] || regexp_extract(target, '(\.[^./]+)$', 1) else target end as target, case when crowded then 'resolved_hash_suffix' else 'clear' end as collision from p join x on lo = lower(target)""")
def _(v):
    return ops.classification_plan(_classified(v), v.files, "/target", v.files.select("path")).select("file_id", "review_status", "target", "collision")


@query("m13_move_candidates", """with a as (select file_id, arg_max(decision, created_epoch * 1000000 + review_id) as d, arg_max(struct_pack(t := target_path), created_epoch * 1000000 + review_id).t as target_path from reviews where review_type = 'target' group by 1),
c as (select content_sha256, size_bytes, count(*) as copies from files where deleted_epoch is null group by 1, 2)
select file_id, target_path, copies, case when copies > 1 then 'duplicate_review_required' else 'ready' end as state from a join persisted_groups g on g.golden_file_id = a.file_id join c on c.content_sha256 = g.content_sha256 and c.size_bytes = g.size_bytes where d = 'accepted' and target_path is not null order by state, file_id limit 500""")
def _(v):
    return ops.move_candidates(v.files, v.persisted_groups, v.reviews, 500)


PLANNED = "select e.event_id, f.file_id, case e.event_type when 'click' then 'copied' when 'error' then 'failed' else 'planned' end as status from events e join files f on f.file_id = e.user_id"


@query("m14_item_status", f"select file_id, arg_max(status, event_id) as status, count(*) as events from ({PLANNED}) group by 1")
def _(v):
    rows = v.spark.sql(PLANNED.replace("events e", "{events} e").replace("files f", "{files} f"), events=v.events, files=v.files)
    return latest(rows, ["file_id"], ["event_id"]).select("file_id", "status").join(rows.groupBy("file_id").agg(F.count("*").alias("events")), "file_id")


@query("m15_path_repairs", f"with {REVIEWED} select file_id, stored_path as old_path, aligned_path as new_path, sha256(concat_ws('|', 'repair', file_id::varchar, aligned_path)) as event_key from pv where needs_correction and decision = 'accepted'")
def _(v):
    return ops.path_repairs(_path_review(v))


MOVES = "select file_id, path, case when file_id % 11 = 0 then size_bytes + 1 else size_bytes end as size_bytes, case when file_id % 7 = 0 then 'x' else content_sha256 end as content_sha256, case file_id % 5 when 0 then path when 1 then concat('/elsewhere/', filename) else concat('/data/moved/', filename) end as target from files"


@query("m16_preconditions", f"""with p as ({MOVES}), t as (select distinct lower(path) as lo from files where deleted_epoch is null)
select p.file_id, p.target, array_to_string(list_filter([case when not starts_with(target, '/data/') then 'target_outside_root' end, case when p.path = target then 'same_path' end, case when f.path is null or f.deleted_epoch is not null then 'source_missing' end, case when f.size_bytes <> p.size_bytes then 'size_changed' end,
  case when f.content_sha256 is distinct from p.content_sha256 then 'content_changed' end, case when t.lo is not null then 'target_taken' end], lambda x: x is not null), ',') as codes from p left join files f using (file_id) left join t on t.lo = lower(target)""")
def _(v):
    plan = v.spark.sql(MOVES.replace("from files", "from {files}"), files=v.files)
    return ops.preconditions(plan, v.files, "/data").select("file_id", "target", F.array_join("codes", ",").alias("codes"))

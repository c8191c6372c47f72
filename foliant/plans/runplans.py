"""Queries of run plans, review plans and prompts from chunks (Q-16, Q-20, Q-21), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import retrieval
from foliant.operators import runplans as ops
from foliant.plans.intake import UUID, _key, _q
from foliant.plans.registry import query
from foliant.plans.retrieval import CHUNKS, QUERY_TEXT, SIM, _top


def _uuid5(namespace: str, name: str) -> str:
    return f"(select concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(to_hex((('0x' || h[17:17])::int & 3) | 8)) || h[18:20], h[21:32]) from (select sha1(from_hex('{namespace.replace('-', '')}') || encode({name})) as h))"


#: Ten manifests over all files; in some, results break a rule. Manifest m7 misses a result, m8 has one of a file that isn't approved, m9 a changed file.
MANIFEST = "select concat('m', file_id % 10) as manifest, file_id, case when file_id % 40 < 10 then 'pending' else 'approved' end as approval, coalesce(content_sha256, 'none') as content_sha256 from files"
RESULTS = f"""select manifest, file_id, case when file_id % 37 = 0 then 'error' when file_id % 41 = 0 then 'password_protected' else 'planned' end as state, case when manifest = 'm9' and file_id % 30 = 9 then 'new' else content_sha256 end as content_sha256, file_id % 5 as chunks
from ({MANIFEST}) m where (approval = 'approved' and not (manifest in ('m7', 'm8') and file_id % 30 < 10)) or (approval = 'pending' and manifest = 'm8' and file_id % 30 < 10)"""
DIGEST = f"""man as ({MANIFEST}), dc as (select manifest, file_id // 1024 as c, sha256(string_agg(concat_ws(chr(9), file_id::varchar, content_sha256), chr(10) order by file_id)) as d from man where approval = 'approved' group by 1, 2),
dm as (select manifest, sha256(string_agg(d, chr(10) order by c)) as manifest_sha256, from dc group by 1), ap as (select * from man where approval = 'approved')"""
RUN = _uuid5(ops.RUN_NAMESPACE, f"manifest_sha256 || ':{ops.EXTRACTOR}:{ops.CHUNKER}'")


def _view(v, sql: str):
    return v.spark.sql(sql.replace("from files", "from {files}"), files=v.files)


@query("q20b_run_plans", f"""with {DIGEST}, res as ({RESULTS}), n as (select r.manifest, count(*) as document_count, sum(chunks)::bigint as chunk_count, count(*) filter (state in ('error', 'password_protected')) as error_count, count(*) filter (ap.file_id is null) as unknown, count(*) filter (ap.file_id is not null and state = 'planned' and r.content_sha256 <> ap.content_sha256) as changed from res r left join ap on ap.manifest = r.manifest and ap.file_id = r.file_id group by 1),
w as (select manifest, count(*) as wanted from ap group by 1),
p as (select dm.*, document_count, chunk_count, error_count, case when document_count <> wanted then 'count_mismatch' when unknown > 0 then 'unknown_file' when changed > 0 then 'content_changed' end as problem from dm join w using (manifest) join n using (manifest))
select manifest, {RUN} as run_id, case when problem is not null then 'refused' when error_count > 0 then 'completed_with_errors' else 'completed' end as status, document_count, chunk_count, error_count, problem from p""")
def _(v):
    return ops.run_plans(_view(v, MANIFEST), _view(v, RESULTS))


VECTORS = """select concat('m', cv.file_id % 10) as manifest, cv.file_id, case when cv.file_id % 10 = 9 and cv.file_id % 30 = 9 then 'new' else coalesce(content_sha256, 'none') end as content_sha256, case when cv.file_id % 10 = 6 and cv.ordinal = 1 then cv.embedding[1:3] else cv.embedding end as embedding
from chunk_vectors cv join files f on f.file_id = cv.file_id where cv.file_id % 40 >= 10 or cv.file_id % 10 = 8"""
EMBEDDING = _uuid5(ops.EMBEDDING_NAMESPACE, f"semantic_run_id || ':model-64:{ops.TOKEN_CHUNKER}'")


@query("q20c_embedding_plans", f"""with {DIGEST}, vec as ({VECTORS}), n as (select r.manifest, count(distinct r.file_id) as document_count, count(*) as chunk_count, count(*) filter (ap.file_id is null) as unknown, count(*) filter (ap.file_id is not null and r.content_sha256 <> ap.content_sha256) as changed, count(*) filter (len(embedding) <> 64) as odd from vec r left join ap on ap.manifest = r.manifest and ap.file_id = r.file_id group by 1),
p as (select dm.manifest, {RUN} as semantic_run_id, document_count, chunk_count, case when unknown > 0 then 'unknown_file' when changed > 0 then 'content_changed' when odd > 0 then 'wrong_dimension' end as problem from dm join n using (manifest))
select manifest, {EMBEDDING} as embedding_run_id, semantic_run_id, case when problem is null then 'completed' else 'refused' end as status, document_count, chunk_count, problem from p""")
def _(v):
    whole = v.chunk_vectors.join(v.files.select("file_id", "content_sha256"), "file_id").where("file_id % 40 >= 10 or file_id % 10 = 8")
    k, cut = F.col("file_id") % 10, F.slice("embedding", 1, 3)
    chunks = whole.select(F.concat(F.lit("m"), k).alias("manifest"), "file_id", F.when((k == 9) & (F.col("file_id") % 30 == 9), "new").otherwise(F.coalesce("content_sha256", F.lit("none"))).alias("content_sha256"), F.when((k == 6) & (F.col("ordinal") == 1), cut).otherwise(F.col("embedding")).alias("embedding"))
    return ops.embedding_plans(_view(v, MANIFEST), chunks, "model-64", 64)


#: A review for each file; each rule is broken by some of them.
REVIEWED = f"""select case when file_id % 29 = 0 then 'p-1' else {_key('file_id')} end as proposal_id, concat('review-', cast(file_id as varchar(20))) as idempotency_key, case when file_id % 31 = 0 then 'maybe' when file_id % 4 = 0 then 'rejected' else 'accepted' end as decision,
  case when file_id % 37 = 0 then '' else 'reader' end as reviewer, case when file_id % 23 = 0 then 'yesterday' else '2025-03-04T05:06:07Z' end as reviewed_at, case when file_id % 19 = 0 then 'elsewhere' when file_id % 4 <> 0 then 'work' end as category,
  case when file_id % 17 = 0 then null else concat('family "', lang, '" é') end as document_family, case when file_id % 13 = 0 then 'gone' else 'archive_candidate' end as lifecycle, concat('Archive/', filename) as suggested_path,
  case when file_id % 11 = 0 then 'none' else 'normal' end as sensitivity, case when file_id % 7 = 0 then 'certain' else 'high' end as confidence, case when file_id % 3 = 0 then concat('line', chr(10), 'two') end as notes from files"""
PLAIN = sorted([*ops.REVIEW_FIELDS, "id", "schema_version"])
JSON = " || ',' || ".join(f"'\"{c}\":' || coalesce(to_json({c})::varchar, 'null')" for c in PLAIN)


@query("q21b_review_plans", f"""with r as ({REVIEWED}), j as (select *, '{ops.REVIEW_SCHEMA}' as schema_version, {_uuid5(ops.REVIEW_NAMESPACE, 'idempotency_key')} as id, case when coalesce(reviewer, '') = '' then 'missing_field' when not regexp_matches(proposal_id, {UUID}) then 'invalid_proposal_id' when reviewed_at = 'yesterday' then 'invalid_time'
  when decision not in ('accepted', 'rejected') then 'invalid_decision' when decision = 'accepted' and not coalesce(category in ({_q(ops.CATEGORIES)}), false) then 'invalid_category' when decision = 'accepted' and lifecycle not in ({_q(ops.LIFECYCLES)}) then 'invalid_lifecycle'
  when decision = 'accepted' and sensitivity not in ({_q(ops.SENSITIVITIES)}) then 'invalid_sensitivity' when decision = 'accepted' and confidence not in ({_q(ops.CONFIDENCES)}) then 'invalid_confidence' when decision = 'accepted' and (document_family is null or suggested_path is null) then 'missing_family_or_path' end as problem from r)
select idempotency_key, problem, case when problem is null then id end as id, case when problem is null then sha256('{{' || {JSON} || '}}') end as review_sha256 from j""")
def _(v):
    return ops.review_plans(_view(v, REVIEWED))


@query("q16b_chunk_prompts", f"""with {SIM}, {CHUNKS}, fo as (select query_id, rank, row_number() over (partition by query_id order by rank) as k, f.filename, ck.ordinal, passage from tp join ck on ck.doc_id = tp.file_id and ck.ordinal = tp.ordinal join files f on f.file_id = tp.file_id where rank <= 3)
select query_id, 'prompt_version: {ops.PROMPT_VERSION}' || chr(10) || 'QUESTION:' || chr(10) || any_value({QUERY_TEXT.replace('vec_id', 'query_id')}) || chr(10) || chr(10) || 'SOURCES:' || chr(10) || string_agg('SOURCE S' || k || chr(10) || 'filename: ' || filename || chr(10) || 'chunk: ' || ordinal || chr(10) || 'content:' || chr(10) || passage, chr(10) || chr(10) order by k) as prompt, count(*) as sources from fo group by 1""")
def _(v):
    queries = v.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.expr(QUERY_TEXT).alias("query"))
    chunks = retrieval.chunk(v.documents).select(F.col("doc_id").alias("file_id"), F.col("ordinal").cast("long").alias("ordinal"), "passage")
    return ops.chunk_prompts(_top(v), chunks, queries, v.files)

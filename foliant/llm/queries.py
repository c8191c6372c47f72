"""The numbered queries over whole tables: QUERIES, and ORACLE_SQL where DuckDB SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import alignment, chat, decontaminate, langid, maintext, mixing, quality, sharding, simhash, substrings, suffix_tree, tokenfiles, whitening
from foliant.llm.common import crc_mod, keyed, scratch, shared_dir, table, text_bytes

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sized(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32")
    placed = sharding.shard_rows(rows, 40, order=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.whole_parts(chat.perspectives(table(spark, sf_dir, "conversations")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.withColumns({"mask_starts": listed("mask_starts"), "mask_ends": listed("mask_ends")})


ORACLE_SQL["op2_perspectives"] = r"""
with said as (
  select conv_id, coalesce(turn // 128, 0)::bigint as part, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
people as (select distinct conv_id, role as perspective from said where role <> 'system'),
pieces as (
  select s.*, p.perspective, s.role = p.perspective as own, s.text || '<|end|>' || chr(10) as body,
    case when s.role = 'system' then '<|system|>' when s.role = p.perspective then '<|assistant|>' else '<|user:' || s.role || '|>' end || chr(10) as head
  from said s join people p on s.conv_id is not distinct from p.conv_id),
placed as (
  select *, sum(length(head) + length(body)) over w - length(body) as s, sum(length(head) + length(body)) over w as e,
    row_number() over w as k
  from pieces window w as (partition by conv_id, perspective, part order by turn nulls first, role, text rows unbounded preceding))
select conv_id, perspective, part, coalesce(sum(sum(length(head) + length(body))) over (partition by conv_id, perspective order by part rows between unbounded preceding and 1 preceding), 0)::bigint as first_char, string_agg(head || body, '' order by k) as rendered,
  coalesce(string_agg(s::bigint::varchar, ',' order by k) filter (where own), '') as mask_starts,
  coalesce(string_agg(e::bigint::varchar, ',' order by k) filter (where own), '') as mask_ends,
  count(*) as n_turns, sum(length(head) + length(body))::bigint as n_chars, coalesce(sum(length(body)) filter (where own), 0)::bigint as n_masked
from placed group by conv_id, perspective, part
"""


@query
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], *[f"quality.{c}" for c in quality.COUNTS[5:]])


ORACLE_SQL["op3_repetition"] = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
basic as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols from d),
lines as (select doc_id, line, k, row_number() over (partition by doc_id, line order by k) as seen from (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(generate_series(1, len(string_split(t, chr(10))))) as k from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup_lines as (select doc_id, count(*) as n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')))::bigint as chars from lines where seen > 1 group by 1),
places as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as gram from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select unnest([3, 5, 7, 10]) as n) where len(w) >= n)),
marked as (select doc_id, n, i, count(*) over (partition by doc_id, n, gram) as times, row_number() over (partition by doc_id, n, gram order by i) as seen from places),
inside as (select distinct doc_id, n, unnest(generate_series(i, i + n - 1)) as k from marked where (n = 3 and times > 1) or (n > 3 and seen > 1)),
cover as (select doc_id, count(*) filter (n = 3) as repeat_words, sum(length(w[k])) filter (n = 5) as c5, sum(length(w[k])) filter (n = 7) as c7, sum(length(w[k])) filter (n = 10) as c10 from inside join d using (doc_id) group by 1),
m as (select doc_id, n_words, word_chars, n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(repeat_words, 0) as n_repeat_words, coalesce(l.chars, 0) as dup_line_chars, coalesce(c5, 0)::bigint as dup_5gram_chars, coalesce(c7, 0)::bigint as dup_7gram_chars, coalesce(c10, 0)::bigint as dup_10gram_chars
  from basic left join dup_lines l using (doc_id) left join cover using (doc_id))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * dup_line_chars <= 30 * word_chars and 100 * dup_5gram_chars <= 15 * word_chars and 100 * dup_7gram_chars <= 13 * word_chars and 100 * dup_10gram_chars <= 10 * word_chars as kept
from m
"""


@query
def op4_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE_SQL["op4_poisson"] = """
with recursive per_source as (
  select coalesce(source, '') as s, count(*) as n from documents group by 1),
rate as (
  select s, 1.0::double * (select count(*) from documents) / (select count(*) from per_source) / n as r from per_source),
piece as (
  select s, r, greatest(1, ceil(r / 16.0))::int as pieces from rate),
cdf(s, k, m, term, total) as (
  select s, 0, r / pieces, exp(-(r / pieces)), exp(-(r / pieces)) from piece
  union all
  select s, k + 1, m, term * (m / (k + 1)), total + term * (m / (k + 1)) from cdf
  where k < 200 and not (total + term * (m / (k + 1)) = total and k + 1 > m)),
draws as (
  select d.doc_id, d.source, d.n_chars, d.text, p.s, p.pieces, unnest(generate_series(1, p.pieces)) as piece
  from documents d join piece p on p.s = coalesce(d.source, '')),
u as (
  select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || case when pieces > 1 then ':' || piece else '' end || '|mix-1'), 1, 12))::bigint / 281474976710656.0::double as u
  from draws),
n as (
  select u.doc_id, u.source, u.n_chars, u.text, sum((select count(*) from cdf c where c.s = u.s and c.total <= u.u))::int as n
  from u group by all)
select doc_id, source, copy::int as copy,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || copy || '|mix-1'), 1, 15))::bigint as shuffle_key,
  n_chars, md5(coalesce(text, '')) as text_md5
from (select *, unnest(generate_series(1, n)) as copy from n where n > 0)
"""


@query
def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(table(spark, sf_dir, "documents")).withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2)
    scored, model = suffix_tree.score_texts(rows.select("rid", text_bytes("text").alias("body"), (~F.col("held_out")).alias("train")))
    found = rows.select("rid", "doc_id", "held_out").join(scored, "rid")
    return found.select("doc_id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op6_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("text", "lang"))
    named = langid.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), "language.rejected")


@query
def op9_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}/token-files"
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder)
    return tokenfiles.read_token_files(spark, folder, with_ids=False)


@query
def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.col("overlap.items")
    return found.select("doc_id", "overlap.n_words", "overlap.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), "overlap.contaminated")


ORACLE_SQL["op10_wu_manber"] = r"""
with doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
item as (
  select item_id::varchar as item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
wins as (
  select item, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select item, w, least(13, len(w)) as m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from item where len(w) > 0)),
lens as (select distinct m from wins),
places as (
  select doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') as win
  from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from doc, lens where len(w) >= m)),
hits as (select p.doc_id, p.i, p.m, x.item from places p join wins x using (m, win)),
words as (select doc_id, count(distinct k) as n from (select doc_id, unnest(generate_series(i, i + m - 1)) as k from hits) group by 1),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from hits) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
  sha256(coalesce(t.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(d.w) as contaminated
from doc d left join words h using (doc_id) left join items t using (doc_id)
"""


@query
def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    spread = whitening.whiten(vectors, model).select("vec_id", "whitening.deviation", F.posexplode("whitening.values").alias("k", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>"), F.col("component"))
    named = spread.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened")
    return named.withColumns({"explained": explained, "identity_error": F.lit(model.identity_error)})


@query
def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = maintext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), to="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op13_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return alignment.with_counts(scratch(groups.withColumn("groups_sha256", digest).drop("groups"), "aligned")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )

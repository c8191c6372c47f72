"""Queries of taxonomy, target paths (C) and privacy (P), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import classify as ops
from foliant.plans.registry import query

EV = "lower(concat_ws(' ', filename, folder_path))"
#: Rules over the words that names and folders of the given tables hold.
RULES = ops.Taxonomy(
    families=(
        (("work",), "contracts", "Contracts", ("work", "contract")),
        (("work",), "minutes", "Minutes", ("minutes", "report_2")),
        (("learning",), "notes", "Notes", ("study", "course")),
        (("learning", "finance", "home"), "certificates", "Certificates", ("certificate", "report_3")),
        (("finance",), "invoices", "Invoices", ("finance", "invoice")),
        (("home", "finance"), "taxes", "Taxes", ("tax", "report_4")),
        (("home",), "housing", "Housing", ("home", "rent")),
        (("archive",), "old", "Old papers", ("archive", "backup")),
    ),
    explicit=(("certified", "Certified", ("report_31",)),),
    signals={"learning": ("/study/", "/courses/"), "finance": ("/finance/",), "home": ("/home/", "/src1/")},
    aliases={"studies": "learning", "money": "finance"},
    secret_words=("password", "api key", "report_10"),
)


def _hits(words):
    return " + ".join(f"contains(ev, '{w}')::int" for w in words)


CURRENT = "case when file_id % 5 = 0 then ' Finance' when file_id % 7 = 0 then 'other' when file_id % 13 = 0 then 'studies' end"
FAMILY_GIVEN = "case when file_id % 10 = 3 then 'Taxes ' when file_id % 10 = 4 then 'nonsense' end"


def _rows(v):
    return v.named_files.withColumns({"accepted": F.expr(CURRENT), "given_family": F.expr(FAMILY_GIVEN)})


BASE = f"b as (select *, {EV} as ev, '/' || lower(folder_path) || '/' as pa, {CURRENT} as accepted, {FAMILY_GIVEN} as given_family from named_files)"


def _scored(names, exprs):
    return "list_sort([" + ", ".join(f"struct_pack(s := -({e}), i := {i}, n := '{n}')" for i, (n, e) in enumerate(zip(names, exprs, strict=True))) + "])"


def _in(column, names):
    return f"{column} in (" + ", ".join(f"'{c}'" for c in names) + ")"


def _any(words, of="ev"):
    return "(" + " or ".join(f"contains({of}, '{w}')" for w in words) + ")"


CAT_SCORES = [f"case when contains(ev, '{c}') then 20 else 0 end + case when accepted = '{c}' then 100 else 0 end + " + " + ".join(f"case when {_hits(w)} > 0 then 40 + 10 * ({_hits(w)}) else 0 end" for k, _, _, w in RULES.families if c in k) for c in RULES.categories]
FAM_SCORES = [f"case when {_in('accepted', k)} and {_hits(w)} > 0 then 100 when {_in('accepted', k)} then 20 when {_hits(w)} > 0 then 50 + {_hits(w)} else 0 end" for k, _, _, w in RULES.families]
GIVEN = "case lower(trim(coalesce(accepted, ''))) " + " ".join(f"when '{k}' then '{c}'" for k, c in RULES.aliases.items()) + " else lower(trim(coalesce(accepted, ''))) end"
COURSE = f"((contains(pa, 'notebook') and {_any(ops.COURSE_WORDS)}) or (contains(ev, 'introductie') and {_any(ops.INTRODUCTION_WORDS)}))"
RULED = _any([w for t in RULES.families for w in t[3]])
CATEGORY = f"case when {_in(GIVEN, RULES.categories)} then {GIVEN} when {COURSE} then 'learning' " + " ".join(f"when {_any(RULES.words(c))} then '{c}'" for c in RULES.categories) + " else 'needs_review' end"
REASON = f"case when {_in(GIVEN, RULES.categories)} then 'accepted' when {COURSE} then 'course_context' when {RULED} then 'keyword_rule' else 'insufficient_evidence' end"
SURE = f"case when {_in(GIVEN, RULES.categories)} then 'high' when {COURSE} or {RULED} then 'medium' else 'low' end"
DATASET = "(extension = 'xlsx' and contains(pa, '/notebook') and contains(pa, '/data/'))"
STEPS = f"when contains(pa, 'notebook') and {_any(ops.COURSE_WORDS, 'replace(ev, chr(45), chr(32))')} then 'course_material' when regexp_matches(lower(filename), '(^|[^a-z0-9])cv([^a-z0-9].*)?[.][^.]*$') or contains(replace(ev, '-', ' '), 'curriculum vitae') then 'resumes' " + " ".join(f"when {_any(w, 'replace(ev, chr(45), chr(32))')} then '{c}'" for c, w in [*((t[0], t[2]) for t in RULES.explicit), *((t[1], t[3]) for t in RULES.families)]) + f" when {DATASET} then 'course_data' else 'general' end"
FAMILY = f"case {STEPS}"
KNOWN_FAMILY = _in("lower(trim(given_family))", [*RULES.codes, "certified", "course_material", "resumes", "course_data"])
SAFE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"""
TARGET = f"""{BASE}, c as (select *, {CATEGORY} as category, {REASON} as category_reason, {FAMILY} as family, {_any(RULES.secret_words)} as secret, {DATASET} as dataset from b),
z as (select *, case when secret then 'quarantine' when dataset or category = 'needs_review' then 'needs_review' else 'active' end as zone from c),
t as (select *, concat_ws('/', '/data/managed', case zone when 'active' then 'Active' when 'quarantine' then 'Quarantine' else 'Review' end, case when zone = 'active' then upper(category[1]) || category[2:] end, case when zone = 'active' and family <> 'general' then upper(family[1]) || family[2:] end, {SAFE}) as target,
  case when secret then 'secret_candidate' when dataset then 'supporting_dataset' else category_reason end as reason from z)"""


@query("c01_category_options", f"with {BASE} select file_id, array_to_string(list_transform({_scored(RULES.categories, CAT_SCORES)}[1:4], lambda x: x.n), ',') as options from b")
def _(v):
    return ops.category_options(_rows(v), "accepted", tax=RULES).select("file_id", "options")


def _fallback_row(i, row):
    cats, code, _, words = row
    longest = f"greatest({', '.join(f'case when contains(ev, {chr(39)}{x}{chr(39)}) then {len(x)} else 0 end' for x in words)})"
    signs = ", ".join(f"struct_pack(s := -({' + '.join([f'contains(pa, {chr(39)}{x}{chr(39)})::int' for x in RULES.signals.get(c, ())] or ['0'])}), j := {j}, c := '{c}')" for j, c in enumerate(cats))
    found = "array_to_string(list_filter([" + ", ".join(f"case when contains(ev, '{w}') then '{w}' end" for w in words) + "], lambda x: x is not null), ',')"
    return f"struct_pack(s := -(({_hits(words)}) * 100 + {longest}), i := {i}, n := '{code}', c := list_sort([{signs}])[1].c, k := {_hits(words)}, w := {found})"


@query("c02_fallback", f"""with {BASE}, f as (select file_id, coalesce(accepted, '') in ('', 'needs_review') as missing, list_sort([{', '.join(_fallback_row(i, t) for i, t in enumerate(RULES.families))}])[1] as x from b)
select file_id, case when ok then x.c end as fallback_category, case when ok then x.n end as fallback, case when ok then x.w end as fallback_words, case when ok then -x.s end as fallback_score, case when ok then case when x.k >= 2 then 'high' else 'medium' end end as fallback_confidence from (select *, missing and x.s < 0 as ok from f)""")
def _(v):
    return ops.taxonomy_fallback(_rows(v), "accepted", RULES).select("file_id", "fallback_category", "fallback", "fallback_words", "fallback_score", "fallback_confidence")


@query("c03_family_options", f"with {BASE} select file_id, array_to_string(list_transform({_scored(RULES.codes, FAM_SCORES)}[1:5], lambda x: x.n), ',') as families from b")
def _(v):
    return ops.family_options(_rows(v).withColumn("accepted", F.coalesce("accepted", F.lit(""))), "accepted", tax=RULES).select("file_id", "families")


@query("c04_category", f"with {BASE} select file_id, {CATEGORY} as category, {REASON} as category_reason, {SURE} as category_confidence from b")
def _(v):
    return ops.category(_rows(v), "accepted", RULES).select("file_id", "category", "category_reason", "category_confidence")


@query("c05_family", f"with {BASE} select file_id, case when {KNOWN_FAMILY} then lower(trim(given_family)) {STEPS} as family from b")
def _(v):
    return ops.family(_rows(v), "given_family", RULES).select("file_id", "family")


@query("c06_flags", f"with {BASE} select file_id, {_any(RULES.secret_words)} as secret, {DATASET} as dataset from b")
def _(v):
    return ops.flags(v.named_files, RULES).select("file_id", "secret", "dataset")


@query("c07_trajectory", "with p as (select file_id, list_filter(string_split(lower(folder_path), '/'), lambda s: s <> '') as d from files) select file_id, case when list_position(d, 'data') > 0 then array_to_string(list_filter(d[list_position(d, 'data') + 1:], lambda s: s not in ('backup', 'home'))[1:2], ' / ') else '' end as trajectory from p")
def _(v):
    return ops.trajectory(v.files, "data", ["backup", "home"]).select("file_id", "trajectory")


def _targets(v):
    return ops.propose_target(_rows(v), "accepted", RULES)


@query("c08_propose_target", f"with {TARGET} select file_id, zone, category, family, target, reason from t")
def _(v):
    return _targets(v).select("file_id", "zone", "category", "family", "target", "reason")


@query("c09_collisions", f"with {TARGET} select file_id, target, case when count(*) over (partition by lower(target)) > 1 then 'batch_target_collision' else 'none' end as collision from t")
def _(v):
    return ops.mark_collisions(_targets(v)).select("file_id", "target", "collision")


@query("c10_representatives", "select file_id from (select *, row_number() over (partition by extension order by modified_at_fs desc, lower(path) desc, file_id desc) as k from files) order by k, extension limit 50")
def _(v):
    return ops.representatives(v.files, 50).select("file_id")


RAW = "select file_id, filename, case file_id % 6 when 0 then concat('/target//a/', filename) when 1 then '/target/b/c/' when 2 then concat('target/', filename) when 3 then concat('/target/../', filename) when 4 then concat('/other/x/', filename) else concat('/target/x/', upper(filename)) end as entered from files"


@query("c11_normalise_target", rf"""with r as ({RAW}), s as (select *, regexp_replace(regexp_replace(entered, '/{{2,}}', '/', 'g'), '/$', '') as single from r), f as (select *, lower(regexp_extract(single, '[^/]*$')) <> lower(filename) and not contains(regexp_extract(single, '[^/]*$'), '.') as is_folder from s),
g as (select *, case when is_folder then single || '/' || filename else single end as full_path from f), p as (select *, case when not starts_with(entered, '/') then 'not_absolute' when list_contains(string_split(entered, '/'), '..') or list_contains(string_split(entered, '/'), '.') then 'relative_segment' when not starts_with(full_path, '/target/') then 'outside_roots' when len(string_split(full_path, '/')) < 4 then 'no_filename' end as problem from g)
select file_id, problem, case when problem is null then full_path end as normalised, case when problem is null then array_to_string(list_filter([case when entered <> single then 'separator_collapsed' end, case when is_folder then 'filename_appended' end], lambda x: x is not null), ',') else '' end as notes from p""")
def _(v):
    rows = v.spark.sql(RAW.replace("from files", "from {files}"), files=v.files)
    return ops.normalise_target(rows, "entered", "filename", ["/target"]).select("file_id", "problem", "normalised", "notes")


@query("c12_close_paths")
def _(v):
    entered = v.files.select("file_id", F.regexp_replace("path", "report", "reprot").alias("path"))
    return ops.close_paths(entered, v.files.select("path"))


NAMES = "select file_id, filename, case file_id % 5 when 0 then 'a  b:c?.doc' when 1 then concat('x_', cast(file_id as varchar(20))) when 2 then '  ..' when 3 then filename else concat(repeat('long ', 50), filename) end as proposed from files"


@query("c13_filenames", rf"""with n as ({NAMES}), s as (select *, trim(proposed) as raw, regexp_extract(filename, '(\.[^.]+)$', 1) as own from n), t as (select *, regexp_extract(raw, '(\.[^.]+)$', 1) as given, regexp_replace(raw, '\.[^.]+$', '') as stem from s),
u as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '_+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g') as clean from t), w as (select *, regexp_replace(clean[1:180 - length(own)], '[ ._]+$', '') as cut from u)
select file_id, case when clean <> '' then cut || own end as normalised, array_to_string(list_filter([case when given <> '' and lower(given) <> lower(own) then 'extension_kept' when given = '' and own <> '' then 'extension_added' end, case when clean <> regexp_replace(stem, '^[ .]+|[ .]+$', '', 'g') then 'characters_replaced' end, case when cut <> clean then 'shortened' end], lambda x: x is not null), ',') as notes from w""")
def _(v):
    rows = v.spark.sql(NAMES.replace("from files", "from {files}"), files=v.files)
    return ops.normalise_filename(rows, "proposed", "filename").select("file_id", "normalised", "notes")


NEXT = "select a.file_id, case when a.file_id % 4 = 0 then concat('/Target/', b.lang, '/', b.filename) else upper(b.path) end as target from files a join files b on b.file_id = a.file_id + 1"


@query("c14_target_conflicts", f"""with t as ({NEXT}), m as (select t.file_id, 'active' as kind, f.file_id as other_id, 0::bigint as made, f.file_id as o from t join files f on lower(f.path) = lower(t.target) and f.file_id <> t.file_id and f.deleted_epoch is null
  union all select t.file_id, 'review', r.review_id, r.created_epoch, -r.review_id from t join reviews r on lower(coalesce(r.target_path, r.proposed_path)) = lower(t.target) and r.file_id <> t.file_id and r.decision = 'accepted')
select file_id, kind, other_id from m qualify row_number() over (partition by file_id, kind order by made desc, o) <= 10""")
def _(v):
    targets = v.spark.sql(NEXT.replace("files a", "{files} a").replace("files b", "{files} b"), files=v.files)
    return ops.target_conflicts(targets, v.files, v.reviews)


def _found(words):
    return "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(ev, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)') then '{w}' end" for w in words) + "], lambda x: x is not null))"


def _signals(text):
    low = f"lower(coalesce({text}, ''))"
    count = lambda words: " + ".join(f"contains({low}, '{w}')::int" for w in words)
    money = " or ".join(f"contains({low}, '{w}')" for w in ops.MONEY_WORDS)
    return f"""list_filter([case when contains({low}, 'bankrekeningnummer') then 'bankrekeningnummer' end, case when regexp_matches({low}, '{ops.LABELLED_BSN}') then 'bsn' end, case when contains({low}, 'burgerservicenummer') then 'burgerservicenummer' end,
 case when regexp_matches({low}, '{ops.IBAN}') then 'iban' end, case when {" or ".join(f"contains({low}, '{w}')" for w in ops.IDENTITY_WORDS)} then 'identity_number' end, case when ({money}) and ({count(ops.PERSON_WORDS)} >= 2 or regexp_matches({low}, '{ops.POSTCODE}') or regexp_matches({low}, '{ops.SALUTATION}')) then 'personal_financial_data' end,
 case when contains({low}, 'rekeningnummer') and not contains({low}, 'bankrekeningnummer') then 'rekeningnummer' end], lambda x: x is not null)"""


PRIV = f"""x as (select *, lower(concat_ws(' ', filename, folder_path, coalesce(document_family, ''), coalesce(sensitivity, ''))) as ev, lower(coalesce(sensitivity, '')) as was from private_texts),
y as (select file_id, was, {_found(ops.HIGH_TERMS)} as h, {_found(ops.MEDIUM_TERMS)} as m, {_signals("text")} as c from x),
w as (select *, len(h) > 0 or len(c) > 0 or was = 'highly_sensitive' as is_high, len(m) > 0 or was in ('personal', 'sensitive') as is_medium from y),
pv as (select file_id, case when is_high then 'high' when is_medium then 'medium' when was = 'normal' then 'low' else 'medium' end as privacy, case when is_high then 'high' when is_medium or was = 'normal' then 'medium' else 'low' end as privacy_confidence,
  case when is_high then 'high_signal' when is_medium then 'personal_or_financial' when was = 'normal' then 'existing_normal' else 'no_evidence' end as privacy_reason,
  case when is_high then case when len(h) > 0 then array_to_string(h, ',') when len(c) > 0 then array_to_string(c, ',') else 'existing:' || was end when is_medium then case when len(m) > 0 then array_to_string(m, ',') else 'existing:' || was end when was = 'normal' then 'existing:normal' else '' end as privacy_terms from w)"""


def _proposed(v):
    return ops.privacy(v.private_texts, labels=("document_family",), sensitivity="sensitivity")


@query("p01_privacy", f"with {PRIV} select * from pv")
def _(v):
    return _proposed(v).select("file_id", "privacy", "privacy_confidence", "privacy_reason", "privacy_terms")


@query("p02_signals", f"select file_id, array_to_string({_signals('text')}, ',') as signals from private_texts")
def _(v):
    return v.private_texts.select("file_id", F.array_join(ops.content_signals(), ",").alias("signals"))


STORED = "select file_id, case when file_id % 6 = 0 then 'High' when file_id % 6 = 1 then 'low' end as content_privacy, case when file_id % 12 = 0 then 'Medium' end as content_confidence from files where file_id % 4 <> 3"


@query("p03_effective_privacy", f"""with {PRIV}, st as ({STORED}), s as (select file_id, arg_max(privacy, created_epoch * 1000000 + review_id) as label from reviews where review_type = 'privacy' group by 1)
select file_id, case when label is not null then label when lower(content_privacy) = 'high' then 'high' else privacy end as level, case when label is not null then 'high' when lower(content_privacy) = 'high' then coalesce(lower(content_confidence), 'high') else privacy_confidence end as confidence,
  case when label is not null then 'human' when lower(content_privacy) = 'high' then 'content' else 'proposal' end as source from pv left join s using (file_id) left join st using (file_id)""")
def _(v):
    return ops.effective_privacy(_proposed(v), v.reviews, v.spark.sql(STORED.replace("from files", "from {files}"), files=v.files))

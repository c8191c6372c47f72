"""Checks of model output: answers with citations, document classifications, and proposals for the work-set.

Contents are JSON texts; every check gives one row for each output, with the first reason against it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.common import contains_any, first_of
from foliant.operators.classify import DEFAULT, Taxonomy

# What outputs may say, in rising order where there is one.
CONFIDENCES = ("low", "medium", "high")
SENSITIVITIES = ("normal", "personal", "sensitive", "highly_sensitive")
SIGNALS = ("identity", "government_identifier", "financial", "health", "employment", "education", "relationship", "address", "none")
CLASS_LIFECYCLES = {"active_candidate": "Active", "archive_candidate": "Archive", "needs_review": "Review", "quarantine": "Quarantine"}
CLASS_CATEGORIES = {"personal": "Personal", "administration": "Administration", "finance": "Finance", "home": "Home", "work": "Work", "study": "Study", "projects": "Projects", "other": "Other"}
# Terms that decide the category, term sets that decide the family, terms that raise the sensitivity.
CATEGORY_TERMS = (
    ("finance", ("belasting", "income_tax", "factuur", "invoice", "financial")),
    ("work", ("curriculum", "cv", "vacature", "interview", "sollicit", "career")),
    ("study", ("diploma", "certificate", "certificaat", "education")),
    ("home", ("vve", "riolering", "woning", "building", "maintenance")),
)
FAMILY_TERMS = (
    (("riolering", "memo"), "vve_technical_memos"),
    (("interview",), "interview_preparation"),
    (("vacaturekrant",), "vacancy_publications"),
    (("vacature_publicatie",), "vacancy_publications"),
    (("newsletter", "vacature"), "vacancy_publications"),
    (("vacaturetekst",), "vacancies"),
    (("curriculum",), "curriculum_vitae"),
    (("cv_",), "curriculum_vitae"),
    (("motivatie",), "motivation_letters"),
    (("belastingaangifte",), "income_tax"),
    (("belastingaanslag",), "income_tax"),
    (("invoice",), "invoices"),
    (("factuur",), "invoices"),
    (("diploma",), "diplomas"),
    (("certificate",), "certificates"),
    (("reglement",), "vve_regulations"),
    (("werkbon",), "maintenance_work_orders"),
    (("werkplan", "uwv"), "uwv_work_plans"),
    (("government_form",), "government_forms"),
    (("gemeentelijk",), "government_forms"),
)
FLOOR_TERMS = {"highly_sensitive": ("paspoort", "bsn", "diagnose", "medisch"), "sensitive": ("belasting", "inkomen", "salaris", "uwv"), "personal": ("curriculum", "cv", "diploma", "persoonlijke brief")}
# Fixed values of proposals.
LIFECYCLES = ("active", "archive", "needs_review")
RELATIONS = ("none", "source_document", "exported_representation", "version", "related_document")
CONFIDENCE_ALIASES = {
    "very_low": "low", "very low": "low", "uncertain": "low", "unknown": "low", "0": "low", "0.0": "low",
    "moderate": "medium", "average": "medium", "mid": "medium",
    "very_high": "high", "very high": "high", "certain": "high", "strong": "high",
}
RELATION_ALIASES = {"": "none", "null": "none", "unknown": "none", "same_document": "related_document", "similar_document": "related_document", "related": "related_document", "source": "source_document", "export": "exported_representation"}
WANTED_WORDS = ("de", "het", "een", "van", "voor", "met", "wordt", "bevat", "omdat", "naar", "geen", "deze", "dit", "menselijke", "gegevens", "bevestigd", "overeenkomt", "gericht", "offerte", "inhoud")
FOREIGN_WORDS = ("the", "this", "are", "for", "from", "with", "contains", "because", "and", "human", "data", "aligns", "related", "current", "offer", "explicitly", "indicated", "without")
GUARDED = {"active": "active", "inactive": "archive", "needs_review": "needs_review"}


def parsed(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``_v``: the parsed JSON, stored once for a row; null where the content is none."""
    return rows.select("*", F.explode(F.array(F.try_parse_json(F.col(content)))).alias("_v"))


def kind(path: str = "$") -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, …; null where nothing is."""
    part = F.col("_v") if path == "$" else F.try_variant_get("_v", path, "variant")
    return F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0)


def text(name: str) -> Column:
    """A string at the top level; null if it is missing or of another type."""
    return F.when(kind(f"$.{name}") == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))


def strings(name: str) -> Column:
    """A list at the top level as strings; null if it isn't a list."""
    return F.when(kind(f"$.{name}") == "ARRAY", F.try_variant_get("_v", f"$.{name}", "array<string>"))


def said_no() -> Column:
    return (kind("$.abstained") == "BOOLEAN") & F.coalesce(F.try_variant_get("_v", "$.abstained", "boolean"), F.lit(False))


def own_reason(default: str) -> Column:
    return F.coalesce(F.nullif(F.try_variant_get("_v", "$.reason", "string"), F.lit("")), F.lit(default))


def aliased(value: Column, names: dict[str, str]) -> Column:
    return first_of(*[(value == k, v) for k, v in names.items()], default=value)


def level(value: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), value)


def check_answers(outputs: DataFrame, known: int = 3) -> DataFrame:
    """(output_id, abstained, reason, citations, confidence) of answers (output_id, content) over sources S1 to S<known>.

    Withheld are contents that aren't JSON or no object, answers that abstain, lack a text or citations, cite what isn't known or
    what their text doesn't mark, or give no confidence. A grounded answer keeps its own reason.
    """
    r = parsed(outputs)
    sources = F.array(*[F.lit(f"S{i}") for i in range(1, known + 1)])
    cited, said = strings("citations"), text("answer")
    problem = first_of(
        (F.col("_v").isNull(), "not_json"),
        (kind() != "OBJECT", "not_an_object"),
        (said_no(), own_reason("model_abstained")),
        (F.coalesce(F.trim(said), F.lit("")) == "", "missing_answer"),
        (F.coalesce(F.size(cited), F.lit(0)) <= 0, "missing_citations"),
        (F.size(F.array_except(cited, sources)) > 0, "unknown_citation"),
        (F.exists(cited, lambda c: ~said.contains(F.concat(F.lit("["), c, F.lit("]")))), "citation_marker_missing"),
        (~F.coalesce(text("confidence"), F.lit("")).isin(*CONFIDENCES), "invalid_confidence"),
    ).cast("string")
    r = r.withColumn("_p", problem)
    good = F.col("_p").isNull()
    return r.select("output_id", (~good).alias("abstained"), F.coalesce("_p", own_reason("grounded_answer")).alias("reason"), F.when(good, F.array_join(F.array_distinct(cited), ",")).otherwise("").alias("citations"), F.when(good, text("confidence")).otherwise("low").alias("confidence"))


def slug(value: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80), F.lit("")), F.lit("unclassified"))


@dataclass(frozen=True)
class ClassRules:
    category_terms: tuple = CATEGORY_TERMS
    family_terms: tuple = FAMILY_TERMS
    floor_terms: dict = field(default_factory=lambda: FLOOR_TERMS)


def check_classifications(outputs: DataFrame, rules: ClassRules = ClassRules()) -> DataFrame:
    """(output_id, status, category, family, lifecycle, sensitivity, confidence, path, warnings, reason) of (output_id, file_id, filename, content).

    Category and family follow from terms of type, family and topics; the sensitivity is never below what category, signals and
    terms ask for; the confidence is capped where something was changed. What fails a check goes to review with the reason.
    """
    r = parsed(outputs)
    number = F.coalesce(F.try_variant_get("_v", "$.file_id", "long"), F.lit(0).cast("long"))
    topics, signals = strings("topics"), strings("sensitivity_signals")
    blank = lambda name: F.coalesce(F.trim(text(name)), F.lit("")) == ""
    among = lambda name, values: F.coalesce(text(name), F.lit("")).isin(*values)
    # Lists are read as text; that all of a list's items are strings shows in its schema.
    listed = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    problem = first_of(
        (F.col("_v").isNull(), "not_json"),
        ((kind() != "OBJECT") | (number != F.col("file_id")), "file_id_mismatch"),
        (~among("category", CLASS_CATEGORIES), "invalid_category"),
        (~among("lifecycle", CLASS_LIFECYCLES), "invalid_lifecycle"),
        (~among("confidence", CONFIDENCES) | ~among("sensitivity", SENSITIVITIES), "invalid_confidence_or_sensitivity"),
        (blank("document_type") | blank("document_family") | blank("reason"), "missing_required_text"),
        (~listed("topics") | (F.size(topics) > 5), "invalid_topics"),
        (~listed("sensitivity_signals") | (F.size(signals) == 0) | (F.size(F.array_except(signals, F.array(*[F.lit(s) for s in SIGNALS]))) > 0), "invalid_sensitivity_signals"),
        (F.array_contains(signals, "none") & (F.size(F.array_distinct(signals)) > 1), "conflicting_sensitivity_signals"),
    ).cast("string")
    clean = F.filter(F.transform(topics, lambda t: F.trim(t)), lambda t: t != "")
    r = r.select("*", problem.alias("_p"), F.explode(F.array(F.struct(clean.alias("topics"), signals.alias("signals"), *[text(c).alias(c) for c in ("category", "lifecycle", "confidence", "sensitivity", "document_type", "document_family", "reason")]))).alias("c"))
    named = F.lower(F.concat_ws(" ", "c.document_type", "c.document_family", F.array_join("c.topics", " ")))
    every = lambda words: contains_any(named, words[:1]) if len(words) == 1 else contains_any(named, words[:1]) & contains_any(named, words[1:])
    category = first_of(*[(contains_any(named, words), code) for code, words in rules.category_terms], default=F.col("c.category"))
    family = first_of(*[(every(words), code) for words, code in rules.family_terms], default=slug(F.col("c.document_family")))
    r = r.withColumns({"_category": category, "_family": family, "_proof": F.lower(F.concat_ws(" ", "filename", "c.document_type", "c.document_family", "c.reason", F.array_join("c.topics", " ")))})
    has = lambda *s: F.arrays_overlap("c.signals", F.array(*[F.lit(x) for x in s]))
    term = lambda k: contains_any(F.col("_proof"), rules.floor_terms[k])
    floor = first_of(
        (has("identity", "government_identifier", "health") | term("highly_sensitive"), "highly_sensitive"),
        (has("financial") | (F.col("_category") == "finance") | term("sensitive"), "sensitive"),
        ((F.size(F.array_except("c.signals", F.array(F.lit("none")))) > 0) | term("personal"), "personal"),
        default="normal",
    )
    raised = level(floor, SENSITIVITIES) > level(F.col("c.sensitivity"), SENSITIVITIES)
    r = r.withColumn("_sensitivity", F.when(raised, floor).otherwise(F.col("c.sensitivity")))
    changed = lambda name, a, b: F.when(a != b, F.concat(F.lit(f"{name}:"), a, F.lit("->"), b))
    notes = F.array_compact(F.array(changed("category", F.col("c.category"), F.col("_category")), changed("family", slug(F.col("c.document_family")), F.col("_family")), changed("sensitivity", F.col("c.sensitivity"), F.col("_sensitivity"))))
    r = r.withColumn("_notes", notes)
    cap = first_of(((F.col("_category") == "other") | (F.col("_family") == "unknown"), "low"), ((F.size("_notes") > 0) | (F.col("c.lifecycle") == "needs_review"), "medium"), default="high")
    capped = F.when(level(cap, CONFIDENCES) < level(F.col("c.confidence"), CONFIDENCES), cap).otherwise(F.col("c.confidence"))
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract("filename", "[^/]*$", 0), r'[<>:"/\\|?*\x00-\x1f]', "_"), "^[ .]+|[ .]+$", "")
    name = F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("file_"), F.col("file_id").cast("string")))
    path = F.concat_ws("/", first_of(*[(F.col("c.lifecycle") == k, v) for k, v in CLASS_LIFECYCLES.items()]), first_of(*[(F.col("_category") == k, v) for k, v in CLASS_CATEGORIES.items()]), "_family", name)
    good = F.col("_p").isNull()
    pick = lambda value, other: F.when(good, value).otherwise(other)
    warned = F.array_join(F.concat("_notes", F.array_compact(F.array(changed("confidence", F.col("c.confidence"), capped)))), ",")
    return r.select(
        "output_id",
        pick(F.lit("classified"), "needs_review").alias("status"),
        pick(F.col("_category"), "other").alias("category"),
        pick(F.col("_family"), "unknown").alias("family"),
        pick(F.col("c.lifecycle"), "needs_review").alias("lifecycle"),
        pick(F.col("_sensitivity"), "personal").alias("sensitivity"),
        pick(capped, "low").alias("confidence"),
        pick(path, "Review/Unclassified").alias("path"),
        pick(warned, "").alias("warnings"),
        pick(F.trim("c.reason"), F.col("_p")).alias("reason"),
    )


def in_wanted_language(reason: Column) -> Column:
    """False if a text holds two words or more of the foreign list, and more than of the wanted one."""
    words = F.array_distinct(F.transform(F.split(reason, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,:;!?()\[\]]+|[.,:;!?()\[\]]+$", ""))))
    of = lambda listed: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in listed])))
    return ~((of(FOREIGN_WORDS) >= 2) & (of(FOREIGN_WORDS) > of(WANTED_WORDS)))


def check_proposals(outputs: DataFrame, tax: Taxonomy = DEFAULT) -> DataFrame:
    """(output_id, status, category, family, lifecycle, privacy, confidence, relation, related, reason) of (output_id, file_id, workset_status, content).

    Aliases of confidence and relation are resolved. A category that a family doesn't allow is replaced where the family has one
    category only, which caps the confidence. The lifecycle follows the work-set's policy where that knows better. What fails a
    check abstains with the reason.
    """
    r = parsed(outputs)
    number = F.coalesce(F.try_variant_get("_v", "$.file_id", "long"), F.lit(0).cast("long"))
    reason, category, family = text("reason"), text("category_code"), text("family_code")
    absent = kind("$.related_file_ids").isNull()
    related = F.try_variant_get("_v", "$.related_file_ids", "array<string>")
    numbers = F.transform(related, lambda x: x.try_cast("long"))
    allowed = first_of(*[(family == code, F.array(*[F.lit(c) for c in cats])) for cats, code, _, _ in tax.families])
    fits = F.array_contains(allowed, category)
    problem = first_of(
        (F.col("_v").isNull(), "not_json"),
        ((kind() != "OBJECT") | (number != F.col("file_id")), "file_id_mismatch"),
        (said_no(), own_reason("model_abstained")),
        (~F.coalesce(category, F.lit("")).isin(tax.categories) | allowed.isNull(), "unknown_taxonomy_value"),
        (~fits & (F.size(allowed) != 1), "incompatible_category_and_family"),
        (~F.coalesce(text("lifecycle"), F.lit("")).isin(*LIFECYCLES) | ~F.coalesce(text("privacy_advice"), F.lit("")).isin(*CONFIDENCES), "invalid_lifecycle_or_privacy"),
        ((F.coalesce(F.trim(reason), F.lit("")) == "") | (F.length(reason) > 600), "invalid_reason"),
        (~in_wanted_language(reason), "reason_in_other_language"),
        (~absent & ((kind("$.related_file_ids") != "ARRAY") | (F.size(related) > 5) | F.exists(numbers, lambda x: x.isNull())), "invalid_related_files"),
    ).cast("string")
    given = lambda name: F.lower(F.coalesce(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")))
    sure, link = aliased(given("confidence"), CONFIDENCE_ALIASES), aliased(F.coalesce(F.nullif(given("relation_kind"), F.lit("")), F.lit("none")), RELATION_ALIASES)
    own = F.when(fits, category).otherwise(F.element_at(allowed, 1))
    r = r.select("*", problem.alias("_p"), F.explode(F.array(F.struct(own.alias("category"), (own != category).alias("moved"), category.alias("was"), family.alias("family"), text("lifecycle").alias("lifecycle"), text("privacy_advice").alias("privacy"), F.when(sure.isin(*CONFIDENCES), sure).otherwise("low").alias("sure"), F.when(link.isin(*RELATIONS), link).otherwise("none").alias("link"), F.array_sort(F.array_distinct(F.coalesce(numbers, F.array().cast("array<bigint>")))).alias("related"), F.trim(reason).alias("reason")))).alias("c"))
    expected = first_of(*[(F.col("workset_status") == k, v) for k, v in GUARDED.items()])
    guarded = expected.isNotNull() & (expected != F.col("c.lifecycle"))
    why = F.when(F.col("c.moved"), F.concat(F.substring("c.reason", 1, 480), F.lit(" [category "), F.col("c.was"), F.lit(" -> "), F.col("c.category"), F.lit(" by family contract]"))).otherwise(F.col("c.reason"))
    why = F.when(guarded, F.concat(F.trim(F.substring(F.trim(why), 1, 430)), F.lit(" [lifecycle "), F.col("c.lifecycle"), F.lit(" -> "), expected, F.lit(" by work-set policy]"))).otherwise(why)
    good = F.col("_p").isNull()
    pick = lambda value, other=None: F.when(good, value).otherwise(other)
    return r.select(
        "output_id",
        pick(F.lit("ready"), "abstained").alias("status"),
        pick(F.col("c.category")).alias("category"),
        pick(F.col("c.family")).alias("family"),
        pick(F.when(guarded, expected).otherwise(F.col("c.lifecycle")), "needs_review").alias("lifecycle"),
        pick(F.col("c.privacy")).alias("privacy"),
        pick(F.when((F.col("c.moved") | guarded) & (F.col("c.sure") == "high"), "medium").otherwise(F.col("c.sure")), "low").alias("confidence"),
        pick(F.col("c.link"), "none").alias("relation"),
        pick(F.array_join(F.transform("c.related", lambda x: x.cast("string")), ","), "").alias("related"),
        pick(why, F.col("_p")).alias("reason"),
    )

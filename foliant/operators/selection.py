"""Choice of recent golden documents for a pilot: ordered reasons against a file, then strata in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.common import first_of

# Fixed values of the selection rules: terms and phrases of sensitive paths in order of precedence, names of secrets,
# extensions, folder names and terms of the strata, and size limits.
SENSITIVE_TERMS = {
    "secrets": ("password", "wachtwoord", "secret", "secrets", "credential", "credentials"),
    "identity": ("paspoort", "rijbewijs", "identiteit", "identiteitsbewijs", "bsn", "inschrijving"),
    "finance": ("belasting", "bank", "salaris", "loon", "factuur", "financien", "financiën", "inkomen", "offerte", "uwv"),
    "health": ("medisch", "gezondheid", "diagnose", "wmo", "zorgverzekering"),
    "employment": ("sollicitatie", "arbeidscontract", "contractvoorstel", "werkgeversverklaring", "vacature", "cv"),
    "personal": ("ticket", "ticketorder", "relatie"),
}
SENSITIVE_PHRASES = {"employment": ("employer s certificate", "curriculum vitae", "werkplan ww"), "personal": ("gezamenlijke documenten inkomen", "ticketorder")}
SECRET_NAMES = ("key", "password", "passwords", "wachtwoorden")
EXTENSIONS = ("docx", "pdf")
PILOT_STRATA = ("study", "work", "project", "administration", "general")
STUDY_FOLDERS, PROJECT_FOLDERS, OFFICE_FOLDERS = ("studie", "opleiding", "training", "datacamp"), ("projecten", "projects"), ("administratie", "administration", "vve")
PERSONAL_STRATA = ("administration", "finance", "home", "work", "study", "projects", "personal")
PERSONAL_TERMS = {
    "finance": ("belasting", "bank", "factuur", "financien", "inkomen", "salaris", "hypotheek"),
    "home": ("woning", "wonen", "huis", "vve", "riolering", "energie"),
    "work": ("sollicitaties", "sollicitatie", "cv", "vacature", "werk", "loopbaan"),
    "study": ("studie", "opleiding", "training", "school", "cursus"),
    "projects": ("project", "projecten", "projects"),
    "administration": ("administratie", "verzekering", "overheid", "gemeente", "contract"),
}
SIZES = ("small", "medium", "large")
SMALL, MEDIUM = 256 * 1024, 2 * 1024 * 1024


def path_words(path: str = "path") -> Column:
    """Words of a path in lower case, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(path, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _holds(words: Column, terms: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(words, " "), F.array(*[F.lit(t) for t in terms]))


def stem(path: str = "path") -> Column:
    """Name of a path without its extension, in lower case."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), "([^/]*)/*$", 1), r"^(.+)\.[^.]+$", "$1")


def sensitive(path: str = "path") -> Column:
    """The first kind of sensitive path that words or phrases tell, or null."""
    words = path_words(path)
    rules = [(stem(path) == "key", "secrets"), *[(_holds(words, terms), kind) for kind, terms in SENSITIVE_TERMS.items()]]
    for kind, phrases in SENSITIVE_PHRASES.items():
        for phrase in phrases:
            rules.append((words.contains(phrase), kind))
    return first_of(*rules).cast("string")


def pilot_stratum(path: str = "path") -> Column:
    folders = F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), lambda x: x != "")
    among = lambda names: F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    return first_of((among(STUDY_FOLDERS), "study"), (among(PROJECT_FOLDERS) | F.exists(folders, lambda x: x.contains("project")), "project"), (among(("werk",)), "work"), (among(OFFICE_FOLDERS), "administration"), default="general")


def personal_stratum(path: str = "path") -> Column:
    words = path_words(path)
    return first_of(*[(_holds(words, terms), name) for name, terms in PERSONAL_TERMS.items()], default="personal")


def size_bucket(size: str = "size_bytes") -> Column:
    return first_of((F.col(size) < SMALL, "small"), (F.col(size) < MEDIUM, "medium"), default="large")


def _select(rows: DataFrame, against: Column, stratum: Column, strata: tuple[str, ...], cutoff: int, n: int) -> DataFrame:
    extension = F.regexp_replace(F.lower(F.coalesce("extension", F.lit(""))), r"^\.+", "")
    reason = first_of(
        (~extension.isin(*EXTENSIONS), "unsupported_extension"),
        (F.coalesce("size_bytes", F.lit(0)) <= 0, "empty_file"),
        (F.coalesce("content_sha256", F.lit("")) == "", "missing_full_sha256"),
        ((F.coalesce(F.col("content_group_id").cast("string"), F.lit("")) == "") | ~F.col("golden_file_id").eqNullSafe(F.col("file_id")), "not_persisted_golden"),
        (F.col("modified_at_fs").isNull(), "missing_filesystem_modification_time"),
        (F.col("modified_at_fs") < cutoff, "outside_recent_window"),
        (against.isNotNull(), against),
    )
    judged = rows.select("file_id", "path", "content_group_id", "modified_at_fs", extension.alias("_ext"), stratum.alias("stratum"), size_bucket().alias("size_bucket"), reason.cast("string").alias("reason"))
    order = [F.desc("modified_at_fs"), F.lower("path"), "file_id"]
    open_ = judged.where("reason is null").withColumn("_k", F.row_number().over(Window.partitionBy("content_group_id").orderBy(*order)))
    first = open_.where("_k = 1").drop("_k")
    again = open_.where("_k > 1").drop("_k").withColumn("reason", F.lit("duplicate_content_group"))
    place = lambda column, names: F.array_position(F.array(*[F.lit(x) for x in names]), column)
    bucket = (place(F.col("stratum"), strata) * len(EXTENSIONS) + place(F.col("_ext"), EXTENSIONS)) * len(SIZES) + place(F.col("size_bucket"), SIZES)
    # Of each bucket no more than n can be taken: the window's limit cuts the rest off before the shuffle.
    turns = first.withColumn("_b", bucket).withColumn("_turn", F.row_number().over(Window.partitionBy("_b").orderBy(*order))).where(F.col("_turn") <= n)
    taken = turns.orderBy("_turn", "_b").limit(n).select("content_group_id", F.lit(True).alias("selected"))
    placed = first.join(taken, "content_group_id", "left").withColumn("reason", F.when(F.col("selected"), F.lit(None)).otherwise(F.lit("pilot_limit")))
    rest = judged.where("reason is not null").unionByName(again).withColumn("selected", F.lit(None).cast("boolean"))
    return placed.unionByName(rest).select("file_id", "path", "stratum", "size_bucket", F.coalesce("selected", F.lit(False)).alias("selected"), "reason")


def pilot(rows: DataFrame, cutoff: int, n: int) -> DataFrame:
    """(file_id, path, stratum, size_bucket, selected, reason): recent golden documents without sensitive paths.

    rows: file_id, path, extension, size_bytes, content_sha256, modified_at_fs (seconds), content_group_id, golden_file_id. The first reason
    against a row counts; the newest row of a content group stands for it (then the path in lower case, then the id). ``n`` rows are taken from the buckets
    of stratum, extension and size in turn, the others have reached the limit.
    """
    return _select(rows, F.concat(F.lit("sensitive_path_category:"), sensitive()), pilot_stratum(), PILOT_STRATA, cutoff, n)


def personal(rows: DataFrame, cutoff: int, n: int = 25) -> DataFrame:
    """The same for personal documents: other strata, and names of secrets as the only reason in a path. ``n`` is 1 to 100."""
    if not 1 <= n <= 100:
        raise ValueError("between 1 and 100 documents can be selected")
    return _select(rows, F.when(stem().isin(*SECRET_NAMES), F.lit("secret_candidate")), personal_stratum(), PERSONAL_STRATA, cutoff, n)

"""Mining of append-only human reviews into advisory rules, and review events from submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.common import first_of, latest, the_one, top_per, uuid5
from foliant.operators.classify import identity_name, normalise_target

ORDER = ["created_epoch", "review_id"]
NAMESPACE = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Latest review of each (file, type)."""
    return latest(reviews, ["file_id", "review_type"], ORDER)


def targets(reviews: DataFrame) -> DataFrame:
    return latest_reviews(reviews.where("review_type = 'target'"))


def accepted_classification(reviews: DataFrame, files: DataFrame) -> DataFrame:
    """Accepted latest target reviews whose content the file still has."""
    now = files.where("deleted_epoch is null and content_sha256 is not null").select("file_id", "content_sha256")
    return targets(reviews).where("decision = 'accepted'").join(now, ["file_id", "content_sha256"]).select("file_id", "category", "family", "review_id")


def refinement_queue(reviews: DataFrame) -> DataFrame:
    """Rejected and corrected latest reviews, oldest first."""
    return targets(reviews).where("decision <> 'accepted'").orderBy("created_epoch", "review_id")


def family_preferences(reviews: DataFrame, support: int = 2) -> DataFrame:
    """Families that accepted latest reviews gave to a source family at least ``support`` times."""
    rows = targets(reviews).where("decision = 'accepted' and family is not null")
    return rows.groupBy("source_family", "family").agg(F.count("*").alias("support"), F.min_by("file_id", F.struct(*ORDER)).alias("first_file")).where(F.col("support") >= support)


def family_candidates(reviews: DataFrame, support: int = 3) -> DataFrame:
    """Families accepted often enough and never refused, with the label first seen."""
    rows = targets(reviews).where("family is not null")
    counts = rows.groupBy("family").agg(F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") != "accepted").alias("counterexamples"), F.min_by("category", F.struct(*ORDER)).alias("category"))
    return counts.where((F.col("accepted") >= support) & (F.col("counterexamples") == 0))


def correction_rules(reviews: DataFrame) -> DataFrame:
    """(source family, category, family) of all accepted and corrected reviews: support, paths, conflict and the first five files."""
    rows = reviews.where("review_type = 'target' and decision <> 'rejected' and family is not null")
    keys = ["source_family", "category", "family"]
    # The limit on the rank is applied before the shuffle.
    five = top_per(rows.select(*keys, "file_id", *[c for c in ORDER if isinstance(c, str)]), keys, ORDER, 5, "_k").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "file_id"))), lambda s: s["file_id"].cast("string")), ",").alias("examples"))
    rules = rows.groupBy(*keys).agg(F.count("*").alias("support"), F.countDistinct("target_path").alias("paths"))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    rules = rules.alias("a").join(five.alias("b"), same).select("a.*", "b.examples")
    return rules.withColumn("confidence", first_of((F.col("paths") > 1, "conflict"), (F.col("support") >= 3, "high"), (F.col("support") == 2, "medium"), default="low"))


def privacy_rules(reviews: DataFrame) -> DataFrame:
    """Majority label of each source family with agreement, counterexamples and confidence; ties by label."""
    votes = latest_reviews(reviews.where("review_type = 'privacy'")).groupBy("source_family", "privacy").agg(F.count("*").alias("votes"))
    best = votes.groupBy("source_family").agg(F.min(F.struct((-F.col("votes")).alias("v"), "privacy")).alias("b"), F.sum("votes").alias("total"))
    out = best.select("source_family", F.col("b.privacy").alias("label"), (-F.col("b.v")).alias("votes"), "total", (F.col("total") + F.col("b.v")).alias("counterexamples"))
    agreement = F.bround(F.col("votes") / F.col("total"), 4)
    return out.withColumn("agreement", agreement).withColumn("confidence", first_of(((F.col("total") >= 5) & (F.col("agreement") >= 0.9), "high"), ((F.col("total") >= 2) & (F.col("agreement") >= 0.75), "medium"), default="low"))


def proposal_quality(reviews: DataFrame) -> DataFrame:
    """Right, wrong and missing proposals in three dimensions."""
    t, p = targets(reviews), latest_reviews(reviews.where("review_type = 'privacy'"))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"/\./", "/"), "/{2,}", "/")
    rows = t.select(F.lit("path").alias("dimension"), tidy("proposed_path").alias("a"), tidy("target_path").alias("b"))
    rows = rows.unionByName(t.select(F.lit("family").alias("dimension"), F.col("source_family").alias("a"), F.col("family").alias("b")))
    rows = rows.unionByName(p.select(F.lit("privacy").alias("dimension"), F.col("proposed_privacy").alias("a"), F.col("privacy").alias("b")))
    counts = rows.groupBy("dimension").agg(F.count("*").alias("total"), F.count_if(F.col("a") == F.col("b")).alias("right"), F.count_if(F.col("a") != F.col("b")).alias("wrong"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"))
    return counts.withColumn("accuracy", F.bround(F.try_divide(F.col("right").cast("double"), (F.col("right") + F.col("wrong")).cast("double")), 4))


def path_audit(reviews: DataFrame) -> DataFrame:
    """Status and notes of the proposed and the human path of each latest review."""
    t = targets(reviews)
    both = t.select("file_id", "filename", F.explode(F.array(F.struct(F.lit("system").alias("side"), F.col("proposed_path").alias("p")), F.struct(F.lit("human").alias("side"), F.col("target_path").alias("p")))).alias("x")).select("file_id", "filename", "x.side", "x.p")
    out = normalise_target(both, "p", "filename", ["/target"])
    return out.select("file_id", "side", first_of((F.col("p").isNull(), "missing"), (F.col("problem").isNotNull(), "invalid"), (F.col("notes") != "", "normalised"), default="valid").alias("status"), F.coalesce("problem", "notes").alias("notes"))


def trajectory_rules(reviews: DataFrame, support: int = 2) -> DataFrame:
    """(folder, term): first folders of accepted targets and the name parts their files share, that no file of another folder has."""
    rows = targets(reviews).where("decision = 'accepted' and target_path is not null")
    rows = rows.select("file_id", F.element_at(F.split("target_path", "/"), 3).alias("folder"), F.explode(F.array_distinct(F.filter(F.split(F.lower("filename"), "[^a-z0-9]+"), lambda s: F.length(s) >= 2))).alias("term"))
    counts = rows.groupBy("term", "folder").agg(F.countDistinct("file_id").alias("support"))
    spread = counts.groupBy("term").agg(F.count("*").alias("folders"), F.sum("support").alias("all"))
    out = counts.join(spread, "term").withColumn("counterexamples", F.col("all") - F.col("support"))
    return out.where(F.col("support") >= support).select("folder", "term", "support", "counterexamples")


def apply_trajectory(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Folder of files for whose name's terms exactly one rule holds. Terms meet rules by equality."""
    clean = rules.where("counterexamples = 0").select("term", "folder")
    terms = files.select("file_id", F.explode(F.array_distinct(F.split(F.lower("filename"), "[^a-z0-9]+"))).alias("term"))
    found = terms.join(clean, "term").groupBy("file_id").agg(F.countDistinct("folder").alias("n"), F.min("folder").alias("folder"))
    return found.where("n = 1").select("file_id", "folder")


def context_rules(reviews: DataFrame) -> DataFrame:
    """Folders whose accepted reviews all name one category."""
    rows = targets(reviews).where("decision = 'accepted'").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "category")
    return rows.groupBy("folder").agg(F.count("*").alias("support"), F.countDistinct("category").alias("_n"), F.min("category").alias("category")).where("_n = 1").drop("_n")


def apply_context(files: DataFrame, rules: DataFrame) -> DataFrame:
    return files.select("file_id", F.col("folder_path").alias("folder")).join(rules, "folder").select("file_id", "category", "support")


def similar_proposals(files: DataFrame, reviews: DataFrame) -> DataFrame:
    """Category and family of each file without an accepted review, by the accepted reviews of files of the same name identity.

    The judgment with most votes is proposed if no other has as many, else the reviews conflict. score is 1.0 if an accepted
    name is the same but for its extension, else 0.95. Only pdf, docx and xlsx with an identity of five characters
    or more take part. Votes are counted by (identity, judgment) before they meet the files.
    """
    stem = lambda c: F.lower(F.regexp_replace(c, r"(?<=.)\.[^.]+$", ""))
    able = lambda df: df.where(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin("pdf", "docx", "xlsx")).withColumns({"identity": identity_name(F.col("filename")), "stem": stem("filename")}).where(F.length("identity") >= 5)
    accepted = able(targets(reviews).where("decision = 'accepted' and category is not null and family is not null"))
    votes = accepted.groupBy("identity", "category", "family").agg(F.count("*").alias("votes"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "category", "family")))  # judgments of one name are few
    best = votes.groupBy("identity").agg(F.slice(ranked, 1, 2).alias("b"), F.sum("votes").alias("reviews"), F.count("*").alias("judgments"))
    top, second = F.col("b")[0], F.get("b", F.lit(1))
    clear = second.isNull() | (top["v"] < second["v"])
    rated = best.select("identity", "reviews", (-top["v"]).alias("support"), (F.col("judgments") > 1).alias("conflicting"), F.when(clear, top["category"]).alias("category"), F.when(clear, top["family"]).alias("family"), F.when(clear, "proposed").otherwise("conflict").alias("status"))
    stems = accepted.select("stem").distinct().withColumn("_same", F.lit(True))
    open_ = able(files.where("deleted_epoch is null")).join(accepted.select("file_id"), "file_id", "left_anti")
    rows = open_.select("file_id", "identity", "stem").join(rated, "identity").join(stems, "stem", "left")
    return rows.select("file_id", "category", "family", "status", "support", "reviews", F.round(F.col("support") / F.col("reviews"), 2).alias("support_ratio"), "conflicting", F.when(F.col("_same"), 1.0).otherwise(0.95).alias("score"))


def revalidate(citations: DataFrame, reviews: DataFrame) -> DataFrame:
    """Whether the reviews that a proposal cites still carry its category by majority.

    citations: (file_id, category, review_ids array).
    """
    cited = citations.select("file_id", F.col("category").alias("claimed"), F.explode("review_ids").alias("review_id"))
    still = cited.join(targets(reviews).where("decision = 'accepted'").select("review_id", "category"), "review_id", "left")
    out = still.groupBy("file_id", "claimed").agg(F.count("*").alias("cited"), F.count("category").alias("current"), F.count_if(F.col("category") == F.col("claimed")).alias("agree"))
    return out.withColumn("valid", 2 * F.col("agree") > F.col("cited"))


def examples(files: DataFrame, reviews: DataFrame, n: int = 3, words: str = "letters", newest: int = 100) -> DataFrame:
    """The ``n`` reviews that share most terms of their name with each file, older ones first among equals: (file_id, review_id, shared, place).

    Only the ``newest`` accepted reviews count: they are one row, which meets all files. Terms have three characters or
    more; ``words``: 'letters' cuts names at anything but a-z and 0-9 and leaves a file's own reviews out of the newest, 'spaces' cuts at white
    space and underscores and takes the newest of other files.
    """
    cut = (lambda c: F.split(F.lower(c), "[^a-z0-9]+")) if words == "letters" else (lambda c: F.split(F.regexp_replace(F.lower(c), "_", " "), r"\s+"))
    terms = lambda c: F.array_distinct(F.filter(cut(c), lambda t: F.length(t) > 2))
    accepted = targets(reviews).where("decision = 'accepted' and category is not null and family is not null")
    # A file has one latest target review at most, so one more than wanted is enough where its own is left out.
    last = accepted.orderBy(F.desc("created_epoch"), F.desc("review_id")).limit(newest + (words != "letters"))
    held = last.agg(F.reverse(F.array_sort(F.collect_list(F.struct("created_epoch", "review_id", "file_id", terms("filename").alias("terms"))))).alias("_held"))
    rows = files.select("file_id", terms("filename").alias("_terms")).join(F.broadcast(held))  # one row
    others = F.filter("_held", lambda h: h["file_id"] != F.col("file_id"))
    rated = F.transform(F.slice(others, 1, newest), lambda h: F.struct((-F.size(F.array_intersect(h["terms"], F.col("_terms")))).alias("s"), h["created_epoch"].alias("c"), h["file_id"].alias("f"), h["review_id"].alias("review_id")))
    best = rows.select("file_id", F.posexplode(F.slice(F.array_sort(rated), 1, n)).alias("place", "b"))
    return best.select("file_id", "b.review_id", (-F.col("b.s")).alias("shared"), (F.col("place") + 1).cast("long").alias("place"))


def rule_context(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.where("confidence in ('medium', 'high')").orderBy(F.desc("support"), "source_family", "category", "family").limit(n)


def submissions(rows: DataFrame, files: DataFrame, reviews: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(events, rejections): submitted reviews that pass all checks, with what they supersede; the others with the first reason.

    rows: submission_id, file_id, review_type, decision, months, content_sha256.
    """
    now = files.where("deleted_epoch is null").select("file_id", F.col("content_sha256").alias("_sha"), F.lit(True).alias("_here"))
    old = latest_reviews(reviews).select("file_id", "review_type", F.col("review_id").alias("supersedes"))
    joined = rows.join(now, "file_id", "left").join(old, ["file_id", "review_type"], "left")
    reason = first_of(
        (~F.col("review_type").isin("target", "privacy"), "unknown_review_type"), (~F.col("decision").isin("accepted", "corrected", "rejected"), "unknown_decision"), (F.col("months").isNotNull() & ~F.col("months").between(1, 60), "invalid_period"), (F.col("_here").isNull(), "file_not_in_workset"), (~F.col("_sha").eqNullSafe(F.col("content_sha256")), "content_changed")
    ).cast("string")
    judged = joined.withColumn("reason", reason)
    events = judged.where("reason is null").select("submission_id", "file_id", "review_type", "decision", "supersedes", (F.lit(as_of) + F.col("months") * 30 * 86400).alias("active_until"), uuid5(NAMESPACE, F.concat_ws(":", "submission_id", "review_type")).alias("event_key"))
    return events, judged.where("reason is not null").select("submission_id", "reason")


def bulk_events(batches: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """Two events for each file of batches of 1 to ``most`` distinct known files; other batches give none.

    batches: (batch_id, file_id).
    """
    sizes = batches.join(files.where("deleted_epoch is null").select("file_id", F.lit(1).alias("_k")), "file_id", "left").groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("d"), F.count("_k").alias("k"))
    good = sizes.where((F.col("n") <= most) & (F.col("n") == F.col("d")) & (F.col("n") == F.col("k"))).select("batch_id")
    return batches.join(good, "batch_id", "left_semi").select("batch_id", "file_id", F.explode(F.array(F.lit("target"), F.lit("privacy"))).alias("review_type"))


def accepted_proposals(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """Three events for each accepted proposal made for the content that the file still has, under name-based keys."""
    now = files.where("deleted_epoch is null").select("file_id", "content_sha256")
    return proposals.join(now, ["file_id", "content_sha256"]).select("file_id", F.explode(F.array(F.lit("target"), F.lit("privacy"), F.lit("lifecycle"))).alias("review_type"), "proposal_key").select("file_id", "review_type", uuid5(NAMESPACE, F.concat_ws(":", "proposal_key", "review_type")).alias("event_key"))


def nomination_events(requests: DataFrame, current: DataFrame, policy: DataFrame) -> DataFrame:
    """Outcome of requests to nominate or withdraw against the latest nominations, with the date of the next review.

    policy: one row; none or several raise when the query runs.
    """
    last = current.select("file_id", "nomination_type", F.col("action").alias("_now"))
    rows = requests.join(last, ["file_id", "nomination_type"], "left").join(F.broadcast(the_one(policy, "review_days")))
    outcome = first_of(((F.col("action") == "withdraw") & ~F.coalesce(F.col("_now") == "nominate", F.lit(False)), "nothing_to_withdraw"), ((F.col("action") == "nominate") & F.coalesce(F.col("_now") == "nominate", F.lit(False)), "already_nominated"), default="recorded")
    return rows.withColumn("outcome", outcome).select("request_id", "file_id", "nomination_type", "action", "outcome", F.when((F.col("outcome") == "recorded") & (F.col("action") == "nominate"), F.col("created_epoch") + F.col("review_days") * 86400).alias("review_epoch"))


def leader_decisions(choices: DataFrame, files: DataFrame) -> DataFrame:
    """Redundant members of groups with a chosen leader that is a member and at least one other: (content, leader, redundant ids)."""
    members = files.where("deleted_epoch is null and content_sha256 is not null").groupBy("content_sha256").agg(F.array_sort(F.collect_set("file_id")).alias("_m"))
    rows = choices.join(members, "content_sha256").where((F.size("_m") >= 2) & F.array_contains("_m", F.col("leader_id")))
    return rows.select("content_sha256", "leader_id", F.array_join(F.transform(F.array_except("_m", F.array("leader_id")), lambda x: x.cast("string")), ",").alias("redundant"))



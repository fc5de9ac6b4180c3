"""Saved review decisions: binding to the reviewed content, reading, and writing back without losing any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrays import let
from gristmill.functions.canonical import canonical_json, low_digits
from gristmill.operators.attempts import KEY

# The columns of a review table, in its order, and those that a decision is bound to.
REVIEW_FIELDS = [*KEY, "clinical_review", "reviewer", "review_note", "category", "gold", "answer", "syntactic_valid", "candidate_note", "note", "target_messages", "question_sha256", "content_sha256", "distractor", "modified_question"]
BINDING_FIELDS = [*KEY, "gold", "note", "candidate_note", "question_sha256", "target_messages"]
DECISIONS = ["approved", "rejected", "pending"]
REVIEWED = ["independent", "adaptive", "literal_control"]


def content_digest(question_id: Column, condition: Column, attempt: Column, gold: Column, note: Column, candidate_note: Column, question_sha256: Column, target_messages: Column) -> Column:
    """SHA-256 of the canonical JSON of what was reviewed, the same for a log's row and for its line in a table of texts; '' if it isn't whole.

    target_messages is JSON text.  Whole: the gold letter and the question's digest aren't empty, notes are texts, the messages a list that isn't empty.
    """
    # sorted by name, and the messages have the last one: their canonical texts, joined, are that of the whole
    texts = F.struct(
        attempt.cast("long").alias("attempt"), candidate_note.alias("candidate_note"), condition.alias("condition"), gold.alias("gold"),
        note.alias("note"), question_id.cast("string").alias("question_id"), question_sha256.alias("question_sha256"),
    )
    joined = lambda messages: F.concat(F.regexp_replace(low_digits(F.to_json(texts)), r"\}\z", ""), F.lit(',"target_messages":'), messages, F.lit("}"))
    whole = (gold != "") & (question_sha256 != "") & note.isNotNull() & candidate_note.isNotNull()
    digest = let(F.when(whole, canonical_json(target_messages)), lambda messages: F.when(messages.startswith("[") & (messages != "[]"), F.sha2(joined(messages), 256)))
    return F.coalesce(digest, F.lit(""))


def bound(rows: DataFrame) -> DataFrame:
    """rows with `content_sha256`; '' where a field that a decision is bound to is missing."""
    if any(c not in rows.columns for c in BINDING_FIELDS):
        return rows.withColumn("content_sha256", F.lit(""))
    return rows.withColumn("content_sha256", content_digest(*(F.col(c) for c in BINDING_FIELDS)))


def saved_decisions(table: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row for each key, the first by `order`; the other rows; issues) of a review table of texts with at least the key and clinical_review.

    A key is any whole-number attempt of any question and condition, so decisions on what no log holds any more stay.  Added to the kept ones: `decision`;
    `bound`, the digest that the decision holds for (null if the row lacks what it was bound to, and of no content if its own digest differs).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = table.withColumns({c: text(c) for c in table.columns if c != order})
    attempt = F.when(F.col("attempt").rlike(r"\A\s*[+-]?\d+\s*\z"), F.trim("attempt").try_cast("int"))
    given = given.withColumns({"__text": F.col("attempt"), "attempt": attempt, "decision": F.col("clinical_review")})
    keyed = given.where("attempt is not null")
    first = keyed.groupBy(*KEY).agg(F.min(order).alias("__first"))  # joined back, so many lines of one key meet nowhere
    keyed = keyed.join(first, KEY).withColumn("__n", F.when(F.col(order) == F.col("__first"), 1).otherwise(2)).drop("__first")
    missing = F.lit(None).cast("string")
    own = missing if any(c not in table.columns for c in BINDING_FIELDS) else let(content_digest(*(F.col(c) for c in BINDING_FIELDS)), lambda x: F.when(x != "", x))
    if "content_sha256" in table.columns:
        own = let(own, lambda x: F.when(x.isNotNull(), F.when(F.col("content_sha256").isin("", x), x).otherwise("of other content")))
    extra = {c: F.lit("") for c in ("reviewer", "review_note") if c not in table.columns}
    kept = keyed.where("__n = 1").withColumns({"bound": own, **extra}).drop("__n", "__text")
    rest = keyed.where("__n > 1").drop("__n").unionByName(given.where("attempt is null")).withColumn("attempt", F.col("__text")).drop("__text", "decision")
    known = F.col("clinical_review").isin(DECISIONS)
    shown = lambda df, code: df.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), *KEY)
    issues = shown(given.where("attempt is null"), "invalid_review_key").unionByName(shown(keyed.where(~known), "invalid_review_decision")).unionByName(shown(keyed.where("__n > 1"), "duplicate_review_key"))
    return kept, rest, issues


def written_back(judged: DataFrame, saved: DataFrame | None, rest: DataFrame | None) -> DataFrame:
    """The review table after a run: (REVIEW_FIELDS as texts, and `place`, which sorts it).

    Rows that count and are reviewed take the place of their saved line and keep its reviewer and note; a line decided on other content stays as it is, and so
    do lines of no row; repeated and unreadable lines follow at the end.  judged: as of attempts.judge, with saved decisions; writing back twice gives the same.
    """
    text = lambda df, c: (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c)
    counted = judged.where(F.col("exclusion_reason").isNull() & F.col("condition").isin(REVIEWED))
    keep = F.col("review_binding_valid") if "review_binding_valid" in judged.columns else F.lit(True)
    new = counted.select(F.col("question_id").alias("__q"), F.col("condition").alias("__c"), F.col("attempt").alias("__a"), F.coalesce(keep, F.lit(True)).alias("__new"), F.struct(*(text(judged, c) for c in REVIEW_FIELDS)).alias("__row"))
    out = new.select(F.col("__q").alias("question_id"), F.col("__c").alias("condition"), F.col("__a").alias("attempt"), "__row")
    if saved is not None:
        old = saved.select(*KEY, F.struct(*(text(saved, c) for c in REVIEW_FIELDS)).alias("__old"))
        both = new.join(old, (F.col("__q") == F.col("question_id")) & (F.col("__c") == F.col("condition")) & (F.col("__a") == F.col("attempt")), "full")
        key = [F.coalesce(a, b).alias(b) for a, b in zip(("__q", "__c", "__a"), KEY, strict=True)]
        out = both.select(*key, F.when(F.col("__new"), F.col("__row")).when(F.col("__old").isNotNull(), F.col("__old")).otherwise(F.col("__row")).alias("__row"))
    last = F.lit(0).alias("__last")
    lines = out.select(last, *KEY, "__row")
    if rest is not None:
        lines = lines.unionByName(rest.select(F.lit(1).alias("__last"), "question_id", "condition", F.lit(None).cast("int").alias("attempt"), F.struct(*(text(rest, c) for c in REVIEW_FIELDS)).alias("__row")))
    shown = [F.coalesce(F.col("__row")[c], F.lit("")).alias(c) for c in REVIEW_FIELDS]
    return lines.select(*shown, F.struct("__last", *KEY, F.to_json("__row").alias("line")).alias("place"))

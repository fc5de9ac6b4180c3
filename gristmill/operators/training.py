"""Training rows from a run's log: the same questions in every arm, notes and prompts proven again, the literal control drawn before any answer is seen."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.canonical import canonical_json
from gristmill.functions.text import note_reasons
from gristmill.operators import aggregate, attempts, protocol, reviews
from gristmill.operators.experiment import CONTROLS
from gristmill.sources.held import held

ARMS = ["clean", "random", "independent", "adaptive"]
_SOURCE = {"random": "literal_control", "independent": "independent", "adaptive": "adaptive"}


@dataclass(frozen=True)
class Build:
    """rows: two for each question and arm; selections (question_id, arm, condition, attempt, answer, correct, clinical_review, note); excluded (question_id, missing arms); provisional: picks that no one approved."""

    rows: DataFrame
    selections: DataFrame
    excluded: DataFrame
    provisional: int


def _refuse(found: DataFrame, what: str, n: int = 5) -> None:
    """An error that names the first n of the violations (question_id, reason)."""
    if bad := found.orderBy("question_id", "reason").limit(n).collect():
        raise ValueError(f"{what}: " + "; ".join(f"{r['question_id']}: {r['reason']}" for r in bad))


def _first(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds."""
    return F.coalesce(*(F.when(c, F.lit(reason)) for c, reason in rules))


def item_violations(items: DataFrame, metadata: dict) -> DataFrame:
    """(question_id, reason): questions that are repeated, missing from or unknown to the run, no training questions, held out, or not those that were hashed."""
    spark = items.sparkSession
    ids = metadata.get("dataset_manifest", {}).get("selection", {}).get("sampled_ids", {})
    named = [("planned", metadata.get("question_ids")), ("train", ids.get("train")), ("heldout", ids.get("dev")), ("heldout", ids.get("test"))]
    lists = reduce(DataFrame.unionByName, (attempts.named_questions(spark, values).withColumn("of", F.lit(name)) for name, values in named))
    lists = lists.groupBy("question_id").agg(*(F.bool_or(F.col("of") == name).alias(name) for name in ("planned", "train", "heldout")))
    each = items.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("source_split") == "train") & (F.sha2("question", 256) == F.col("question_sha256"))).alias("same"))
    both = each.join(lists, "question_id", "full")
    said = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = _first((F.col("n") > 1, "repeated"), (F.col("n").isNull() & said("planned"), "not among the kept questions"), (F.col("n").isNotNull() & ~said("planned"), "not planned"), (F.col("n").isNotNull() & (~said("train") | said("heldout")), "not a training question"), (F.col("n").isNotNull() & ~said("same"), "another origin or text"))
    return both.select("question_id", reason.alias("reason")).where("reason is not null")


def row_violations(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, reason): logged rows of another gold letter or text than their question's; valid notes that the rules reject now; prompts that question and note don't give."""
    own = items.select("question_id", F.col("question").alias("__question"), F.col("options").alias("__options"), F.col("answer_idx").alias("__gold"), F.col("question_sha256").alias("__sha"))
    both = rows.join(own, "question_id")
    told = F.col("condition").isin(reviews.REVIEWED) & F.col("syntactic_valid")
    gold_text = F.element_at(F.array(*(F.col("__options")[x] for x in "ABCD")), F.instr(F.lit("ABCD"), F.col("__gold")))
    note = F.coalesce("note", F.lit(""))
    again = protocol.target_messages(F.col("__question"), F.col("__options"), note)
    # texts alone, so the same VARIANT text is the same canonical text, which is costly
    same = F.when(F.col("target_messages") == F.to_json(F.try_parse_json(again)), True).otherwise(canonical_json(again).eqNullSafe(canonical_json(F.col("target_messages"))))
    where = F.concat(F.lit(" in "), "condition", F.lit("/"), F.col("attempt").cast("string"))
    rules = [
        (~F.col("gold").eqNullSafe(F.col("__gold")) | ~F.col("question_sha256").eqNullSafe(F.col("__sha")), "another gold letter or question"),
        (told & (F.size(note_reasons(note, F.col("__gold"), gold_text)) > 0), "the note breaks a rule"),
        (told & ~same, "the prompt isn't that of question and note"),
    ]
    return both.select("question_id", F.concat(_first(*rules), where).alias("reason")).where("reason is not null")


def build_training(rows: DataFrame, items: DataFrame, metadata: dict, *, decisions: DataFrame | None = None, allow_provisional: bool = False, seed: int = 20260921) -> Build:
    """Two rows (clean, additional) for each arm of every question that has an eligible pick for all of them; the others are left out of all arms.

    rows: a typed log (run_folder.typed_rows).  items: (question_id, question, options A to D, answer_idx, question_sha256, source_split).  Eligible: valid, not rejected, and approved
    unless provisional ones are allowed.  The independent and adaptive arms take their earliest wrong attempt, else their earliest; the random arm takes the literal control that seed and question
    draw, if that very control was run and is eligible.  A source that isn't a whole training run, or whose record contradicts its questions, is an error; so is no question left.
    """
    if (metadata.get("config") or {}).get("split", metadata.get("split")) != "train":
        raise ValueError("training rows come from runs on the train split only")
    if not re.fullmatch("[0-9a-f]{40}", metadata.get("target_revision") or ""):
        raise ValueError("the run names no fixed revision of its model")
    run = aggregate.aggregate_run(rows, metadata, decisions=decisions, samples=1)
    if not run.summary["integrity"]["valid"]:
        raise ValueError(f"the run's record has errors: {sorted(x['code'] for x in run.summary['integrity']['issues'] if x['severity'] == 'error')}")
    _refuse(item_violations(items, metadata), "questions")
    _refuse(row_violations(run.judged, items), "rows")
    eligible = run.judged.where(F.col("exclusion_reason").isNull() & F.col("condition").isin(reviews.REVIEWED))
    eligible = eligible.where(F.lit(allow_provisional) | (F.col("clinical_review") == "approved")).where((F.col("condition") != "literal_control") | (F.col("note") == protocol.control_note(F.col("attempt"))))
    picks = attempts.policy_pick(eligible, seed, len(CONTROLS)).drop("wrong")
    arm = F.create_map(*(F.lit(x) for a, c in _SOURCE.items() for x in (c, a)))[F.col("condition")]
    chosen = held(picks.join(eligible, attempts.KEY).select("question_id", arm.alias("arm"), "condition", "attempt", "answer", "correct", "clinical_review", "note"))
    have = chosen.groupBy("question_id").agg(F.collect_set("arm").alias("have"))  # three at most
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, _SOURCE)), F.coalesce("have", F.array().cast("array<string>"))))
    sides = items.join(have, "question_id", "left").withColumn("missing", missing)
    kept = sides.where(F.size("missing") == 0)
    selections = chosen.join(kept.select("question_id"), "question_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("no question has an eligible pick for every arm")
    every = kept.withColumn("arm", F.explode(F.array(*map(F.lit, ARMS)))).withColumn("variant", F.explode(F.array(F.lit("clean"), F.lit("additional"))))
    told = selections.select("question_id", "arm", F.lit("additional").alias("variant"), F.col("note").alias("__note"), F.col("clinical_review").alias("__review"), F.col("attempt").alias("selected_attempt"))
    out = every.join(told, ["question_id", "arm", "variant"], "left").withColumn("note", F.coalesce("__note", F.lit("")))
    out = out.select(
        "question_id", "source_split", "question_sha256", "arm", "variant", protocol.target_messages(F.col("question"), F.col("options"), F.col("note")).alias("messages"),
        F.concat(F.lit('{"answer":"'), "answer_idx", F.lit('","explanation":""}')).alias("completion"), F.col("answer_idx").alias("gold"), "note", F.coalesce("__review", F.lit("original_unchanged")).alias("clinical_review"), "selected_attempt",
    )
    return Build(out, selections, sides.where(F.size("missing") > 0).select("question_id", "missing"), selections.where("clinical_review <> 'approved'").count())

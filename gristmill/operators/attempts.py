"""Attempt logs: validation, planned slots, any-wrong-within-k curves, cohort, history, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.canonical import raw_kind, raw_text
from gristmill.functions.hashing import bucket, seed64
from gristmill.functions.text import blank
from gristmill.operators.protocol import resolve_budget

CONDITIONS = ["baseline", "clean_repeat", "independent", "adaptive", "literal_control"]
STATUSES = ["ok", "refusal", "format_error", "error"]
KEY = ["question_id", "condition", "attempt"]
ISSUE = "severity string, code string, question_id string, condition string, attempt int"
TOKENS = ["input_tokens", "output_tokens", "generator_input_tokens", "generator_output_tokens"]


def key_issue() -> Column:
    """missing_key, invalid_key, or null."""
    missing = F.col("question_id").isNull() | F.col("condition").isNull() | F.col("attempt").isNull()
    invalid = blank(F.col("question_id")) | ~F.col("condition").isin(CONDITIONS) | F.when(F.col("condition") == "baseline", F.col("attempt") != 0).otherwise(F.col("attempt") < 1)
    return F.when(missing, "missing_key").when(invalid, "invalid_key")


def raw_key_issue(raw: Column) -> Column:
    """key_issue of a VARIANT line, by its types: an absent field is missing; null is not, but isn't valid as a condition or an attempt, which is a whole number and no text, flag or 1.0."""
    question, condition, attempt = (F.try_variant_get(raw, f"$.{c}", "variant") for c in KEY)
    number, name = F.try_variant_get(attempt, "$", "long"), F.try_variant_get(condition, "$", "string")
    typed = (raw_kind(condition) == "STRING") & (raw_kind(attempt) == "BIGINT")
    # only a string or a null can be blank, and a null is the text None
    blank_id = (raw_kind(question) == "STRING") & blank(F.try_variant_get(question, "$", "string"))
    valid = typed & ~blank_id & name.isin(CONDITIONS) & F.when(name == "baseline", number == 0).otherwise(number >= 1)
    return F.when(question.isNull() | condition.isNull() | attempt.isNull(), "missing_key").when(~F.coalesce(valid, F.lit(False)), "invalid_key")


def judge(rows: DataFrame, budgets: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """All rows with `exclusion_reason` (null: the row counts), `codes` (the issues it has itself) and derived flags.

    Order: key, duplicates (all rows of the key go), over budget, saved review, review value, status, operational error, gold, syntactic flag,
    answer, correct flag; last, rows whose gold differs from their baseline's go.  budgets: (condition, budget); a condition without one has none.
    A column `key_issue` (see raw_key_issue) takes the place of key_issue().  An `answer_labels` column (array of strings, null: A to D) gives a row's own labels.
    saved: decisions as of reviews.saved_decisions, for rows with a `content_sha256`.
    """
    keyed = rows.withColumns({"__key": F.col("key_issue") if "key_issue" in rows.columns else key_issue(), "__row": F.monotonically_increasing_id()})
    good = F.col("__key").isNull()
    twice = keyed.where(good).groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    judged = keyed.join(twice, KEY, "left").join(F.broadcast(budgets.withColumnRenamed("budget", "__budget")), "condition", "left")
    judged = judged.withColumn("__live", good & F.col("__n").isNull() & (F.col("attempt") <= F.coalesce("__budget", F.lit(0))))
    warnings: list[tuple[Column, str]] = []
    if saved is not None:
        judged = judged.join(saved.select(*KEY, "decision", "bound", "reviewer", "review_note").withColumnsRenamed({"decision": "__decision", "bound": "__bound", "reviewer": "__reviewer", "review_note": "__note"}), KEY, "left")
        decided = F.col("__live") & F.coalesce(F.col("__decision").isin("approved", "rejected"), F.lit(False))
        unbound = decided & (F.col("__bound").isNull() | (F.col("content_sha256") == ""))
        differs = decided & ~unbound & (F.col("__bound") != F.col("content_sha256"))
        judged = judged.withColumns({"review_binding_valid": ~(unbound | differs), "__unbound": unbound, "__differs_from_saved": differs, "__apart": decided & ~unbound & ~differs & F.col("clinical_review").isin("approved", "rejected") & (F.col("clinical_review") != F.col("__decision"))})
        judged = judged.withColumn("clinical_review", F.when(decided & F.col("review_binding_valid"), F.col("__decision")).when(decided, "pending").otherwise(F.col("clinical_review")))
        judged = judged.withColumn("reviewer", F.coalesce("__reviewer", F.lit(""))).withColumn("review_note", F.coalesce("__note", F.lit("")))
        warnings = [(F.col("__unbound"), "review_binding_missing"), (F.col("__differs_from_saved"), "review_content_mismatch"), (F.col("__apart"), "review_disagreement")]
    among = lambda c, values: F.coalesce(c.isin(values), F.lit(False))
    given = F.col("answer_labels") if "answer_labels" in rows.columns else F.lit(None).cast("array<string>")
    bad_labels = F.coalesce((F.size(given) == 0) | F.exists(given, lambda x: x.isNull()), F.lit(False))
    judged = judged.withColumns({
        "__review": among(F.col("clinical_review"), ["pending", "approved", "rejected"]), "__known": among(F.col("status"), STATUSES),
        "__bad_labels": bad_labels, "__labels": F.coalesce(F.when(~bad_labels, given), F.array(*map(F.lit, "ABCD"))), "__flag": F.col("syntactic_valid").isNotNull(),
    })
    holds = lambda c: F.coalesce(F.array_contains("__labels", F.col(c)), F.lit(False))
    judged = judged.withColumns({
        "clinical_review": F.when(F.col("__review"), F.col("clinical_review")).otherwise("pending"), "status": F.when(F.col("__known"), F.col("status")).otherwise("error"),
        "syntactic_valid": F.coalesce("syntactic_valid", F.lit(False)), "__gold": holds("gold"),
    })
    judged = judged.withColumn("__bad_answer", (F.col("status") == "ok") & ~holds("answer")).withColumn("status", F.when(F.col("__bad_answer"), "format_error").otherwise(F.col("status")))
    judged = flagged(judged.withColumn("derived_correct", F.coalesce((F.col("status") == "ok") & (F.col("answer") == F.col("gold")), F.lit(False))).withColumn("__kept", F.col("__live") & F.col("__gold")))
    # a question has no more live rows than its budgets allow, as their keys are unique; all others stay out of its window
    group = Window.partitionBy("question_id", F.when(~F.col("__live"), F.col("__row")))
    judged = judged.withColumn("__base", F.max(F.when(F.col("__kept") & (F.col("condition") == "baseline"), F.col("gold"))).over(group))
    judged = judged.withColumn("__differs", F.col("__kept") & F.coalesce(F.col("__base") != F.col("gold"), F.lit(False)))
    rules = [
        *warnings, (~F.col("__review"), "invalid_clinical_review"), (~F.col("__known"), "invalid_status"), (F.col("status") == "error", "target_operational_error"), (F.col("__bad_labels"), "invalid_answer_labels"), (~F.col("__gold"), "invalid_gold"),
        (F.col("__gold") & ~F.col("__flag"), "missing_syntactic_validity"), (F.col("__gold") & F.col("__bad_answer"), "invalid_answer"),
        (F.col("__gold") & ~F.col("correct").eqNullSafe(F.col("derived_correct")), "correct_flag_mismatch"), (F.col("__differs"), "gold_disagreement"),
    ]
    none = F.array().cast("array<string>")
    reason = F.coalesce(F.col("__key"), F.when(F.col("__n").isNotNull(), "duplicate_key").when(~F.col("__live"), "over_budget").when(~F.col("__gold"), "invalid_gold").when(F.col("__differs"), "gold_disagreement"))
    codes = F.when(~good | (F.col("__n").isNull() & ~F.col("__live")), F.array(reason)).when(F.col("__n").isNotNull(), none).otherwise(F.array_compact(F.array(*(F.when(c, F.lit(code)) for c, code in rules))))
    judged = judged.withColumn("exclusion_reason", reason).withColumn("codes", codes)
    return judged.drop(*(c for c in judged.columns if c.startswith("__") and c not in rows.columns))


def row_issues(judged: DataFrame) -> DataFrame:
    """Issues (severity, code, question_id, condition, attempt) of judged rows: a code of a row is one, the rows of a repeated key are one together."""
    severity = F.when(F.col("code") == "review_disagreement", "warning").otherwise("error")
    own = judged.select(F.explode("codes").alias("code"), *KEY)
    twice = judged.where("exclusion_reason = 'duplicate_key'").groupBy(*KEY).agg(F.lit("duplicate_key").alias("code")).select("code", *KEY)
    return own.unionByName(twice).select(severity.alias("severity"), "code", *KEY)


def validate(rows: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows with derived flags, issues) of judge."""
    judged = judge(rows, budgets)
    return judged.where("exclusion_reason is null").drop("exclusion_reason", "codes"), row_issues(judged)


#: What a run declares and shows, as rules over its facts (see run_facts): severity, code, whether it holds.
RUN_RULES = [
    ("error", "unknown_planned_budget", lambda f: f["budget_source"] == "observed"),
    ("error", "invalid_literal_control_count", lambda f: not f["literal_declared"]),
    ("error", "unexpected_question_ids", lambda f: f["unexpected"] > 0),
    ("error", "question_count_mismatch", lambda f: type(f["declared_questions"]) is int and f["declared_questions"] != f["questions"]),
    ("warning", "empty_baseline_correct_cohort", lambda f: f["cohort"] == 0),
    ("error", "unknown_run_kind", lambda f: f["run_kind"] == "unknown"),
    ("error", "mixed_run_kind", lambda f: f["run_kind"] == "mixed"),
]
RUN_KINDS = ("pilot", "evaluation")


def run_facts(rows: DataFrame, metadata: dict, k: int | None = None) -> dict:
    """What a run's metadata declares, with what its rows show, of one pass: budget and its source, literal controls, conditions, run kind."""
    kind = F.col("run_kind") if "run_kind" in rows.columns else F.lit(None).cast("string")
    attempt = F.when(F.col("condition").isNull() | (F.col("condition") != "baseline"), F.col("attempt"))
    seen = rows.agg(
        F.max(attempt).alias("most"), F.coalesce(F.bool_or(F.col("condition") == "literal_control"), F.lit(False)).alias("literal"), F.coalesce(F.bool_or(~kind.isin(*RUN_KINDS)), F.lit(False)).alias("other"),
        *(F.coalesce(F.bool_or(kind == x), F.lit(False)).alias(x) for x in RUN_KINDS),
    ).first()
    budget, source = resolve_budget(metadata, seen["most"], k)
    declared = metadata.get("literal_control_count", 3)
    counted = type(declared) is int and declared >= 1
    kinds = {x for x in RUN_KINDS if seen[x]} | ({"other"} if seen["other"] else set()) | ({metadata["run_kind"]} if metadata.get("run_kind") else set())
    literal = seen["literal"] or metadata.get("literal_controls") is True or "literal_control" in (metadata.get("conditions") or [])
    return {
        "budget": budget, "budget_source": source, "literal_declared": counted, "literal_count": declared if counted else 3, "conditions": ["clean_repeat", "independent", "adaptive", *(["literal_control"] if literal else [])],
        "declared_questions": metadata.get("n_questions", metadata.get("num_questions")), "run_kind": "unknown" if not kinds or not kinds <= set(RUN_KINDS) else "mixed" if len(kinds) > 1 else next(iter(kinds)),
    }


def run_budgets(spark: SparkSession, facts: dict, every: bool = False) -> DataFrame:
    """(condition, budget) of a run's conditions, or of all."""
    names = CONDITIONS[1:] if every else facts["conditions"]
    return spark.createDataFrame([("baseline", 0), *((c, facts["literal_count"] if c == "literal_control" else facts["budget"]) for c in names)], "condition string, budget int")


def named_questions(spark: SparkSession, ids: list | DataFrame | None) -> DataFrame:
    """(question_id) of ids that metadata lists, or has as a table with that column; any other value names none."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col("question_id").cast("string").alias("question_id"))
    return spark.createDataFrame([(str(q),) for q in ids] if isinstance(ids, list) else [], "question_id string")


def run_questions(rows: DataFrame, metadata: dict) -> DataFrame:
    """(question_id, unexpected): the questions of the log and those planned (see named_questions), once each; unexpected ones aren't in a plan that there is."""
    ids = metadata.get("question_ids", metadata.get("expected_question_ids", []))
    planned = named_questions(rows.sparkSession, ids).distinct().withColumn("planned", F.lit(True))
    seen = rows.where("question_id is not null").select(F.col("question_id").cast("string").alias("question_id")).distinct()
    there = not ids.isEmpty() if isinstance(ids, DataFrame) else bool(ids) and isinstance(ids, list)
    return seen.join(planned, "question_id", "full").select("question_id", (F.lit(there) & F.col("planned").isNull()).alias("unexpected"))


def run_issues(rows: DataFrame, valid: DataFrame, metadata: dict, k: int | None = None) -> DataFrame:
    """Issues, as of validate, of a run as a whole: RUN_RULES, questions without a baseline, and conditions of a question that lack attempts.

    rows: the log as read; valid: the rows that validate keeps.  metadata: the run's own values; k: an explicit budget.
    `run_kind` is read where rows have it.  Questions are those of the log and those planned.
    """
    spark, facts = rows.sparkSession, run_facts(rows, metadata, k)
    questions = run_questions(rows, metadata)
    counts = questions.agg(F.count(F.lit(1)).alias("questions"), F.count_if("unexpected").alias("unexpected")).first()
    facts |= counts.asDict() | {"cohort": cohort(valid).limit(1).count()}
    found = [(severity, code, None, None, None) for severity, code, holds in RUN_RULES if holds(facts)]
    return spark.createDataFrame(found, ISSUE).unionByName(gaps(questions, valid, run_budgets(spark, facts)))


def gaps(questions: DataFrame, valid: DataFrame, budgets: DataFrame) -> DataFrame:
    """Issues: missing_baseline of a question, incomplete_budget of a question and condition."""
    gone = grid(questions, budgets).join(valid.select(*KEY), KEY, "left_anti").select("question_id", "condition").distinct()
    base = F.col("condition") == "baseline"
    return gone.select(F.lit("error").alias("severity"), F.when(base, "missing_baseline").otherwise("incomplete_budget").alias("code"), "question_id", F.when(~base, F.col("condition")).alias("condition"), F.lit(None).cast("int").alias("attempt"))


def review_issues(decisions: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(decisions to merge: of each valid key the first by `order`, issues as of validate) of a saved review (key, clinical_review, ...)."""
    keyed = decisions.withColumn("__key", key_issue())
    good = keyed.where("__key is null")
    bad = ~F.coalesce(F.col("clinical_review").isin("pending", "approved", "rejected"), F.lit(False))
    ranked = good.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(order)))
    parts = [(keyed.where("__key is not null"), "invalid_review_key"), (good.where(bad), "invalid_review_decision"), (ranked.where("__n > 1"), "duplicate_review_key")]
    issues = [df.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), *KEY) for df, code in parts]
    return ranked.where("__n = 1").drop("__n", "__key"), issues[0].unionByName(issues[1]).unionByName(issues[2])


def flagged(rows: DataFrame) -> DataFrame:
    """Adds provisional_wrong and confirmed_wrong to rows with status, answer, gold, syntactic_valid and clinical_review."""
    wrong = (F.col("status") == "ok") & F.col("syntactic_valid") & (F.col("answer") != F.col("gold"))
    return rows.withColumn("provisional_wrong", F.coalesce(wrong, F.lit(False))).withColumn("confirmed_wrong", F.col("provisional_wrong") & F.coalesce(F.col("clinical_review") == "approved", F.lit(False)))


def grid(questions: DataFrame, budgets: DataFrame) -> DataFrame:
    """Planned slots: every question with every attempt that a condition's budget allows (baseline: attempt 0)."""
    plan = budgets.select("condition", F.explode(F.when(F.col("condition") == "baseline", F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("budget").cast("int")))).alias("attempt"))
    slots = plan.agg(F.collect_list(F.struct("condition", "attempt")).alias("slots"))  # conditions x budget, a fixed few
    return questions.select("question_id").distinct().join(F.broadcast(slots)).select("question_id", F.inline("slots"))


def token_count(rows: DataFrame, c: str) -> Column:
    """A token column as a double: numbers as they are (a raw true is 1), anything else 0; null if the column isn't there."""
    if c not in rows.columns:
        return F.lit(0.0)
    kind, value = rows.schema[c].dataType, F.col(c)
    if isinstance(kind, T.VariantType):
        value = F.when(~raw_kind(value).isin("STRING", "ARRAY", "OBJECT", "VOID"), F.try_variant_get(value, "$", "double"))
    elif not isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.lit(0.0)
    return F.coalesce(value.cast("double"), F.lit(0.0))


def slot_stats(rows: DataFrame, questions: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per condition: denominator (planned slots, whatever was observed), observed, missing, complete (none is missing), correct, accuracy, status counts, invalid notes, and the token sums of the columns that there are."""
    joined = grid(questions, budgets).join(rows.withColumn("__seen", F.lit(True)), KEY, "left")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    tokens = [F.sum(token_count(rows, c)).alias(c) for c in TOKENS if c in rows.columns]
    out = joined.groupBy("condition").agg(F.count(F.lit(1)).alias("denominator"), F.count("__seen").alias("observed"), F.count_if("derived_correct").alias("correct"), *counts, F.count_if(~F.col("syntactic_valid")).alias("syntactic_invalid"), *tokens)
    return out.withColumns({"missing": F.col("denominator") - F.col("observed"), "complete": F.col("denominator") == F.col("observed"), "accuracy": F.try_divide("correct", "denominator")})


def cohort(rows: DataFrame) -> DataFrame:
    """Questions whose baseline is correct and syntactically valid."""
    return rows.where("condition = 'baseline' and derived_correct and syntactic_valid").select("question_id")


def curves(rows: DataFrame, members: DataFrame, budgets: DataFrame) -> DataFrame:
    """(condition, k, questions, provisional, confirmed, rates, missing): questions of the cohort with a wrong answer within the first k attempts."""
    planned = grid(members, budgets.where("condition <> 'baseline'")).join(rows, KEY, "left")
    upto = Window.partitionBy("question_id", "condition").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    seen = planned.select("condition", F.col("attempt").alias("k"), *(F.max(F.coalesce(f"{x}_wrong", F.lit(False))).over(upto).alias(x) for x in ("provisional", "confirmed")), F.sum(F.col("status").isNull().cast("int")).over(upto).alias("gone"))
    out = seen.groupBy("condition", "k").agg(F.count(F.lit(1)).alias("questions"), F.count_if("provisional").alias("provisional"), F.count_if("confirmed").alias("confirmed"), F.sum("gone").alias("missing"))
    return out.withColumn("provisional_rate", F.try_divide("provisional", "questions")).withColumn("confirmed_rate", F.try_divide("confirmed", "questions"))


def history(rows: DataFrame) -> DataFrame:
    """rows with the feedback of the earlier attempts of the same question and condition, in order."""
    past = Window.partitionBy("question_id", "condition").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("history", F.collect_list(F.struct("attempt", "answer", "status")).over(past))


def policy_pick(rows: DataFrame, seed: int, controls: int) -> DataFrame:
    """(question_id, condition, attempt, wrong): of each condition but literal_control the earliest wrong eligible attempt, else the earliest eligible one.

    The literal control is drawn from seed and question alone, before any answer is seen, and is picked only if that very attempt is eligible; `wrong` is null for it.
    """
    wrong = (F.col("status") == "ok") & (F.col("answer") != F.col("gold"))
    drawn = (seed64(seed, F.col("question_id"), "random") % controls).cast("int") + 1
    literal = F.col("condition") == "literal_control"
    able = rows.where("syntactic_valid and clinical_review <> 'rejected'").where(~literal | (F.col("attempt") == drawn))
    first = F.min(F.struct(F.when(~literal, ~F.coalesce(wrong, F.lit(False))).alias("right"), F.col("attempt")))
    return able.groupBy("question_id", "condition").agg(first.alias("x")).select("question_id", "condition", F.col("x.attempt").alias("attempt"), (~F.col("x.right")).alias("wrong"))


def common_cohort(picks: DataFrame, arms: int) -> DataFrame:
    """Questions that every arm has a pick for."""
    return picks.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == arms).select("question_id")


#: Picks of a draw that are generated as one array.
PICKS = 1 << 14
#: Distinct differences of outcomes, at most.
OUTCOMES = 1 << 8


def paired_bootstrap(differences: DataFrame, value: str, draws: int, seed: int) -> DataFrame:
    """One row: n, mean, and the 95 % interval of the mean of resampled differences; see paired_bootstraps."""
    return paired_bootstraps(differences, [value], draws, seed).drop("value")


def paired_bootstraps(differences: DataFrame, values: list[str], draws: int, seed: int) -> DataFrame:
    """For each value column, a row: value, n, mean, and the 95 % interval (linear interpolation) of the mean of resampled differences of outcomes, which have few values.

    More than OUTCOMES distinct differences are an error: bootstrap.bootstrap_means takes real numbers.

    Differences are first counted by value, in one pass for all columns; a draw resamples multiplicities: n hashed picks, each falling into
    a value's range of the cumulative counts. Picks are made once for all columns, in parallel (draws x n rows), never collected.
    """
    spark = differences.sparkSession
    each = differences.select(F.inline(F.array(*(F.struct(F.lit(c).alias("value"), F.col(c).cast("double").alias("v")) for c in values))))
    counts = each.groupBy("value", "v").agg(F.count(F.lit(1)).alias("c")).limit(OUTCOMES * len(values) + 1).collect()
    bands = {c: sorted(((r["v"], r["c"]) for r in counts if r["value"] == c), key=lambda x: (x[0] is not None, x[0])) for c in values}
    if len(counts) > OUTCOMES * len(values) or any(len(x) > OUTCOMES for x in bands.values()):
        raise ValueError(f"more than {OUTCOMES} distinct differences")
    n = sum(c for _, c in bands[values[0]])
    most = max(n, 1)  # without rows there are no draws either
    picks = spark.range(draws if n else 0).withColumnRenamed("id", "draw")
    picks = picks.withColumn("from", F.explode(F.expr(f"sequence(0L, {most - 1}L, {PICKS}L)"))).withColumn("i", F.explode(F.expr(f"sequence(from, least(from + {PICKS}L, {most}L) - 1)")))
    picks = picks.select("draw", F.pmod(bucket(seed, F.col("draw"), F.col("i")), F.lit(most)).alias("at"))

    def picked(column: str) -> Column:
        out, upto = F, 0
        for v, c in bands[column]:
            upto += c
            out = out.when(F.col("at") < upto, F.lit(v).cast("double"))
        return F.lit(None).cast("double") if out is F else out

    means = picks.groupBy("draw").agg(*(F.avg(picked(c)).alias(f"m{i}") for i, c in enumerate(values)))
    bounds = means.agg(*(F.percentile(f"m{i}", F.array(F.lit(0.025), F.lit(0.975))).alias(f"p{i}") for i in range(len(values))))
    mean = {c: sum(v * k for v, k in x if v is not None) / n if n else None for c, x in bands.items()}
    rows = [F.struct(F.lit(c).alias("value"), F.lit(n).cast("long").alias("n"), F.lit(mean[c]).cast("double").alias("mean"), F.col(f"p{i}")[0].alias("low"), F.col(f"p{i}")[1].alias("high")) for i, c in enumerate(values)]
    return bounds.select(F.inline(F.array(*rows)))

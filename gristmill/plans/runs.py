"""Queries over whole runs: users as questions, every planned attempt of each as a log line, answers and defects by hash.

`planned` is a run without errors; in `faulty` about a third of the lines have a defect each, and its review and metadata
have theirs; `empty` has no log.  They are written as run folders in the shared folder and read back like any run.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.canonical import json_string
from gristmill.functions.hashing import bucket, letter
from gristmill.operators import aggregate, attempts, protocol, reviews, training
from gristmill.operators.experiment import CONTROLS
from gristmill.plans.catalogue import K, b32, letter_sql, query, sha, table
from gristmill.sources import files, run_folder
from gristmill.sources.held import shared_dir, stored

NOTES = ["A bird sat by the window all morning.", "The corridor was quiet after lunch.", "Somebody hummed a slow tune outside.", "The waiting room had green chairs.", "It rained a little before noon."]
WORDS = ["first", "second", "third", "fourth"]
#: Of sixty: the line lacks its attempt; it is a flag; a text; another condition; ... (see run_lines).
DEFECTS = 60


def slots(spark: SparkSession, sf_dir: str, faulty: bool) -> DataFrame:
    """(question_id, condition, attempt) of every user's planned attempts, with what hashes of them decide."""
    users = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").cast("string").alias("question_id"))
    budgets = spark.createDataFrame([("baseline", 0), *((c, K) for c in ("clean_repeat", "independent", "adaptive")), ("literal_control", len(CONTROLS))], "condition string, budget int")
    key = [F.col(c) for c in attempts.KEY]
    d = bucket("defect", *key) % DEFECTS if faulty else F.lit(-1)
    e = bucket("saved", *key) % 12 if faulty else F.when(bucket("saved", *key) % 7 == 0, 0).otherwise(99)
    right = bucket("gold", F.col("question_id")) % 4
    # few users make many lines, and each is costly: dealt out by line, as the users' own bytes would fill one task
    lines = attempts.grid(users, budgets).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *attempts.KEY)
    rows = lines.withColumns({"d": d, "e": e, "right": right, "other": bucket("answer", *key) % 4, "pull": bucket("pull", *key) % 3 == 0, "st": bucket("status", *key) % 20, "clear": bucket("valid", *key) % 10 != 0})
    rows = rows.withColumns({
        "gold": F.when(F.col("d") == 6, "Z").otherwise(letter(F.when(F.col("d") == 11, (F.col("right") + 1) % 4).otherwise(F.col("right")))), "answer": F.when(F.col("d") == 8, "Q").otherwise(letter(F.when(F.col("pull"), F.col("other")).otherwise(F.col("right")))),
        "status": F.when(F.col("d") == 8, "ok").when(F.col("d") == 14, "error").when(F.col("d") == 4, "odd").when(F.col("st") == 0, "refusal").when(F.col("st") == 1, "format_error").otherwise("ok"),
        "review": F.element_at(F.array(*map(F.lit, reviews.DECISIONS)), (bucket("review", *key) % 3 + 1).cast("int")), "tokens": bucket("tokens", *key) % 50,
        "question": F.concat(F.lit("Which letter belongs to user "), "question_id", F.lit("?")),
        "note": F.when(F.col("condition").isin("baseline", "clean_repeat"), "").when(F.col("condition") == "literal_control", protocol.control_note(F.col("attempt"))).otherwise(F.element_at(F.array(*map(F.lit, NOTES)), F.col("attempt"))),
    })
    return rows.withColumn("question_sha256", F.sha2("question", 256)).withColumn("messages", protocol.target_messages(F.col("question"), options(), F.col("note")))


def options() -> Column:
    return F.struct(*(F.lit(w).alias(x) for x, w in zip("ABCD", WORDS, strict=True)))


def run_lines(rows: DataFrame) -> DataFrame:
    """The log lines (value) of slots, each with its defect."""
    d = F.col("d")
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    logged = ((F.col("status") == "ok") & (F.col("answer") == F.col("gold"))) != (d == 9)
    attempt = F.when(d == 1, "true").when(d == 2, F.concat(F.lit('"'), F.col("attempt"), F.lit('"'))).otherwise((F.col("attempt") + F.when(d == 15, 50).otherwise(0)).cast("string"))
    parts = [
        field("question_id", json_string(F.col("question_id"))), field("condition", json_string(F.when(d == 3, "other").otherwise(F.col("condition")))), F.when(d != 0, field("attempt", attempt)),
        *(field(c, json_string(F.col(c))) for c in ("gold", "answer", "status", "note", "question_sha256")), field("candidate_note", json_string(F.col("note"))), field("clinical_review", json_string(F.when(d == 5, "maybe").otherwise(F.col("review")))),
        field("correct", logged.cast("string")), F.when(d != 7, field("syntactic_valid", F.col("clear").cast("string"))), F.when(d == 10, F.lit('"answer_labels":[]')), field("target_messages", F.col("messages")),
        field("input_tokens", F.when(F.col("tokens") == 0, '"0"').otherwise(F.concat(F.col("tokens").cast("string"), F.lit(".5")))), F.lit('"run_kind":"pilot"'),
    ]
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.when(d == 13, "").otherwise("}"))
    return rows.where(d != 16).select(F.explode(F.array_repeat(line, F.when(d == 12, 2).otherwise(1))).alias("value"))


def review_lines(rows: DataFrame) -> DataFrame:
    """The saved review of slots, as texts: decisions that hold, hold for another note, lack what they are bound to, are repeated, unknown, or of no attempt."""
    e = F.col("e")
    decision = F.when(e.isin(0, 2, 3, 4), "approved").when(e == 1, "rejected").when(e == 5, "maybe").otherwise("pending")
    gold = letter(F.col("right"))
    columns = {"category": "", "reviewer": "someone", "review_note": "", "answer": "", "syntactic_valid": "", "content_sha256": "", "distractor": "", "modified_question": ""}
    note = F.when(e == 2, F.concat("note", F.lit(" Once more."))).otherwise(F.col("note"))
    out = rows.where(e < 8).select(
        "question_id", "condition", F.when(e == 6, "x").otherwise(F.col("attempt").cast("string")).alias("attempt"), decision.alias("clinical_review"), gold.alias("gold"), F.col("note").alias("candidate_note"), note.alias("note"),
        F.col("messages").alias("target_messages"), F.when(e == 3, "").otherwise(F.col("question_sha256")).alias("question_sha256"), *(F.lit(v).alias(c) for c, v in columns.items()), F.explode(F.sequence(F.lit(1), F.when(e == 4, 2).otherwise(1))).alias("copy"),
    )
    return out.select(*reviews.REVIEW_FIELDS)


def write_run(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A run's folder."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    put = lambda file, value: files.write_small(spark, f"{folder}/{file}", value if isinstance(value, str) else json.dumps(value))
    if name == "empty":
        put("config.json", {"config": {"seed": 1}})
        put("review.csv", "some,other\ntable,here\n")
        return folder
    faulty = name == "faulty"
    rows = stored(slots(spark, sf_dir, faulty))
    run_lines(rows).write.text(f"{folder}/worker_0.jsonl")
    files.write_csv(review_lines(rows), f"{folder}/review.csv", reviews.REVIEW_FIELDS)
    put("run.json", {"k": K, "run_kind": "evaluation" if faulty else "pilot"} | ({"n_questions": -1, "literal_control_count": 0, "question_ids": ["1"]} if faulty else {}))
    if faulty:
        put("manifest.json", "[1]")
        turn = F.col("turn") % 5
        generated = F.when(turn == 0, '{"error": "out of memory"}').when(turn == 1, '{"raw": ').otherwise('{"error": null}')
        table(spark, sf_dir, "conversations").select(generated.alias("value")).write.text(f"{folder}/generations_0.jsonl")
    return folder


_RUN_SQL = f"""WITH users AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS q FROM events WHERE user_id IS NOT NULL), runs AS (SELECT unnest(['planned', 'faulty']) AS run),
plan AS (SELECT 'baseline' AS c, 0 AS a UNION ALL SELECT c, a FROM (SELECT unnest(['clean_repeat', 'independent', 'adaptive']) AS c), (SELECT unnest(range(1, {K} + 1)) AS a) UNION ALL SELECT 'literal_control', unnest([1, 2, 3])),
hashed AS (SELECT run, q, c, a, CASE run WHEN 'faulty' THEN {b32("'defect'", 'q', 'c', 'a')} % {DEFECTS} ELSE -1 END AS d,
    CASE WHEN run = 'faulty' THEN {b32("'saved'", 'q', 'c', 'a')} % 12 WHEN {b32("'saved'", 'q', 'c', 'a')} % 7 = 0 THEN 0 ELSE 99 END AS e, {b32("'gold'", 'q')} % 4 AS r, {b32("'answer'", 'q', 'c', 'a')} % 4 AS o,
    {b32("'pull'", 'q', 'c', 'a')} % 3 = 0 AS pull, {b32("'status'", 'q', 'c', 'a')} % 20 AS s, {b32("'valid'", 'q', 'c', 'a')} % 10 <> 0 AS clear, ['approved', 'rejected', 'pending'][{b32("'review'", 'q', 'c', 'a')} % 3 + 1] AS review, {b32("'tokens'", 'q', 'c', 'a')} % 50 AS tokens
    FROM users, runs, plan),
lines AS (SELECT *, CASE d WHEN 6 THEN 'Z' WHEN 11 THEN {letter_sql('(r + 1) % 4')} ELSE {letter_sql('r')} END AS gold, CASE WHEN d = 8 THEN 'Q' WHEN pull THEN {letter_sql('o')} ELSE {letter_sql('r')} END AS answer,
    CASE WHEN d = 8 THEN 'ok' WHEN d IN (4, 14) THEN 'error' WHEN s = 0 THEN 'refusal' WHEN s = 1 THEN 'format_error' ELSE 'ok' END AS said, d NOT IN (0, 1, 2, 3, 12, 13, 15, 16) AS live, d IN (6, 11) AS other_content FROM hashed),
judged AS (SELECT *, CASE WHEN d = 8 THEN 'format_error' ELSE said END AS status, d <> 7 AND clear AS valid,
    CASE WHEN e IN (0, 4) AND NOT other_content THEN 'approved' WHEN e = 1 AND NOT other_content THEN 'rejected' WHEN e IN (0, 1, 2, 3, 4) OR d = 5 THEN 'pending' ELSE review END AS decision,
    max(gold) FILTER (WHERE c = 'baseline' AND live AND d <> 6) OVER (PARTITION BY run, q) AS base FROM lines),
marked AS (SELECT *, status = 'ok' AND answer = gold AS right_, status = 'ok' AND valid AND answer <> gold AS wrong, status = 'ok' AND valid AND answer <> gold AND decision = 'approved' AS sure,
    live AND d <> 6 AND base IS DISTINCT FROM NULL AND base <> gold AS differs, live AND d <> 6 AND NOT coalesce(base <> gold, false) AS counts FROM judged),
asked AS (SELECT run, q FROM users, runs UNION SELECT 'faulty', '1'),
grid AS (SELECT run, q, c, a, status, valid, right_, wrong, sure, tokens, m.q IS NOT NULL AS seen FROM (SELECT * FROM asked, plan) LEFT JOIN (SELECT * FROM marked WHERE counts) m USING (run, q, c, a)),
cohort AS (SELECT run, q FROM grid WHERE c = 'baseline' AND seen AND right_ AND valid),
gaps AS (SELECT run, q, c FROM grid WHERE NOT seen GROUP BY ALL),
issues AS (
    SELECT run, 'error' AS severity, CASE WHEN d = 0 THEN 'missing_key' WHEN d IN (1, 2, 3) OR (d = 15 AND c = 'baseline') THEN 'invalid_key' WHEN d = 15 THEN 'over_budget' WHEN d = 12 THEN 'duplicate_key' WHEN d = 13 THEN 'malformed_jsonl' END AS code FROM marked
    UNION ALL SELECT run, 'error', unnest([CASE WHEN e = 3 THEN 'review_binding_missing' END, CASE WHEN e = 2 OR (e IN (0, 1, 4) AND other_content) THEN 'review_content_mismatch' END, CASE WHEN d = 5 AND e NOT IN (0, 1, 2, 3, 4) THEN 'invalid_clinical_review' END,
        CASE WHEN d = 4 THEN 'invalid_status' END, CASE WHEN d IN (4, 14) THEN 'target_operational_error' END, CASE WHEN d = 10 THEN 'invalid_answer_labels' END, CASE WHEN d = 6 THEN 'invalid_gold' END, CASE WHEN d = 7 THEN 'missing_syntactic_validity' END,
        CASE WHEN d = 8 THEN 'invalid_answer' END, CASE WHEN d = 9 THEN 'correct_flag_mismatch' END, CASE WHEN differs THEN 'gold_disagreement' END]) FROM marked WHERE live
    UNION ALL SELECT run, 'warning', 'review_disagreement' FROM marked WHERE live AND d <> 5 AND e IN (0, 1, 4) AND NOT other_content AND review <> 'pending' AND review <> CASE e WHEN 1 THEN 'rejected' ELSE 'approved' END
    UNION ALL SELECT run, 'error', CASE e WHEN 4 THEN 'duplicate_review_key' WHEN 5 THEN 'invalid_review_decision' WHEN 6 THEN 'invalid_review_key' END FROM marked
    UNION ALL SELECT run, 'error', CASE c WHEN 'baseline' THEN 'missing_baseline' ELSE 'incomplete_budget' END FROM gaps
    UNION ALL SELECT 'faulty', 'error', unnest(['invalid_metadata', 'question_count_mismatch', 'invalid_literal_control_count', 'unexpected_question_ids', 'mixed_run_kind'])
    UNION ALL SELECT 'faulty', 'error', CASE turn % 5 WHEN 0 THEN 'generator_operational_error' WHEN 1 THEN 'malformed_generation_jsonl' END FROM conversations
    UNION ALL SELECT 'empty', unnest(['error', 'error', 'error', 'warning', 'error']), unnest(['missing_worker_files', 'unreadable_review', 'unknown_planned_budget', 'empty_baseline_correct_cohort', 'unknown_run_kind'])
)"""


def summaries(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(run, path, value): the figures of the runs' summaries."""
    rows = [(name, *x) for name in names for x in aggregate.flat(aggregate.aggregate_folder(spark, write_run(spark, sf_dir, name), samples=DRAWS, write=False).summary)]
    return spark.createDataFrame(rows, "run string, path string, value double")


DRAWS = 2000


@query(f"{_RUN_SQL} SELECT run, 'integrity.issues.' || code || '.n' AS path, CAST(count(*) AS DOUBLE) AS value FROM issues WHERE code IS NOT NULL AND run <> 'planned' GROUP BY ALL")
def run_issue_codes(spark, sf_dir):
    """How often each issue code stands in the summaries of a faulty and an empty run."""
    return summaries(spark, sf_dir, ["faulty", "empty"]).where("path like 'integrity.issues.%'")


def _facts(prefix: str, named: dict[str, str]) -> str:
    return "unnest([" + ", ".join(f"{{'path': {prefix} || '{name}', 'value': CAST({value} AS DOUBLE)}}" for name, value in named.items()) + "], recursive := true)"


_STATS = {
    **{f"status_counts.{s}": f"count(*) FILTER (WHERE status = '{s}')" for s in attempts.STATUSES}, "status_counts.missing": "count(*) FILTER (WHERE NOT seen)", "denominator": "count(*)", "observed": "count(*) FILTER (WHERE seen)", "complete": "bool_and(seen)",
    "correct": "count(*) FILTER (WHERE right_)", "accuracy": "count(*) FILTER (WHERE right_) / count(*)", "syntactic_invalid": "count(*) FILTER (WHERE NOT valid)",
    "input_tokens": "coalesce(sum(CASE WHEN tokens > 0 THEN tokens + 0.5 ELSE 0 END) FILTER (WHERE seen), 0)", "output_tokens": "0", "generator_input_tokens": "0", "generator_output_tokens": "0",
}
_CURVE = {"questions": "count(*)", "provisional": "count(*) FILTER (WHERE p)", "confirmed": "count(*) FILTER (WHERE s)", "missing": "sum(m)", "provisional_rate": "count(*) FILTER (WHERE p) / count(*)", "confirmed_rate": "count(*) FILTER (WHERE s) / count(*)", "complete": "sum(m) = 0"}
_COVERAGE = {"candidates": "count(*)", **{x: f"count(*) FILTER (WHERE decision = '{x}')" for x in ("approved", "rejected", "pending")}, "coverage": "count(*) FILTER (WHERE decision <> 'pending') / count(*)"}
_INTEGRITY = {"valid": "count(*) FILTER (WHERE severity = 'error') = 0", "error_count": "count(*) FILTER (WHERE severity = 'error')", "warning_count": "count(*) FILTER (WHERE severity = 'warning')"}


@query(f"""{_RUN_SQL},
diffs AS (SELECT run, q, coalesce(bool_or(wrong) FILTER (WHERE c = 'adaptive'), false)::INT - coalesce(bool_or(wrong) FILTER (WHERE c = 'independent'), false)::INT AS provisional, coalesce(bool_or(sure) FILTER (WHERE c = 'adaptive'), false)::INT - coalesce(bool_or(sure) FILTER (WHERE c = 'independent'), false)::INT AS confirmed
    FROM cohort JOIN grid USING (run, q) GROUP BY run, q),
outcome AS (SELECT kind, list(v ORDER BY v) AS vs, count(*) AS n, avg(v) AS m FROM (UNPIVOT (SELECT provisional, confirmed FROM diffs WHERE run = 'planned') ON provisional, confirmed INTO NAME kind VALUE v) GROUP BY kind),
picks AS (SELECT draw, i, {b32("'20260921'", "draw", "i")} AS h FROM (SELECT unnest(range({DRAWS})) AS draw), (SELECT unnest(range((SELECT max(n) FROM outcome))) AS i)),
drawn AS (SELECT kind, draw, avg(vs[1 + h % n]) AS m FROM outcome, picks WHERE i < n GROUP BY ALL),
interval_ AS (SELECT kind, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM drawn GROUP BY kind),
curve AS (SELECT run, c, a, bool_or(coalesce(wrong, false)) OVER w AS p, bool_or(coalesce(sure, false)) OVER w AS s, count(*) FILTER (WHERE NOT seen) OVER w AS m FROM cohort JOIN grid USING (run, q) WHERE c <> 'baseline' WINDOW w AS (PARTITION BY run, q, c ORDER BY a)),
figures AS (
    SELECT run, {_facts("'all_questions.baseline.'", _STATS)} FROM grid WHERE c = 'baseline' GROUP BY run
    UNION ALL SELECT run, {_facts("'conditions.' || c || '.all_questions.'", _STATS)} FROM grid WHERE c <> 'baseline' GROUP BY run, c
    UNION ALL SELECT run, {_facts("'conditions.' || c || '.baseline_correct.'", _STATS)} FROM grid JOIN cohort USING (run, q) WHERE c <> 'baseline' GROUP BY run, c
    UNION ALL SELECT run, {_facts("'conditions.' || c || '.curves.' || a || '.'", _CURVE)} FROM curve GROUP BY run, c, a
    UNION ALL SELECT run, {_facts("'review.'", _COVERAGE)} FROM marked WHERE counts AND c IN ('independent', 'adaptive', 'literal_control') GROUP BY run
    UNION ALL SELECT run, {_facts("'integrity.'", _INTEGRITY)} FROM issues WHERE code IS NOT NULL AND run <> 'empty' GROUP BY run
    UNION ALL SELECT run, 'integrity.issues.' || code || '.n', count(*) FROM issues WHERE code IS NOT NULL AND run <> 'empty' GROUP BY run, code
    UNION ALL SELECT run, 'conditions.' || c || '.budget_k', max(a) FROM plan, runs WHERE c <> 'baseline' GROUP BY run, c
    UNION ALL SELECT run, unnest(['budget_k', 'paired_bootstrap.at_k', 'paired_bootstrap.draws', 'paired_bootstrap.seed', 'paired_bootstrap.valid']), unnest([{K}, {K}, {DRAWS}, 20260921, CASE run WHEN 'planned' THEN 1 ELSE 0 END]) FROM runs
    UNION ALL SELECT run, 'n_questions', count(*) FROM asked GROUP BY run
    UNION ALL SELECT run, 'n_baseline_correct', count(*) FROM cohort GROUP BY run
    UNION ALL SELECT run, 'paired_bootstrap.' || kind || '.n', count(*) FROM cohort, (SELECT unnest(['provisional', 'confirmed']) AS kind) GROUP BY run, kind
    UNION ALL SELECT 'planned', {_facts("'paired_bootstrap.' || kind || '.'", {"mean": "m", "low": "low", "high": "high"})} FROM outcome JOIN interval_ USING (kind)
    UNION ALL SELECT 'faulty', 'paired_bootstrap.' || kind || '.' || part, NULL FROM (SELECT unnest(['provisional', 'confirmed']) AS kind), (SELECT unnest(['mean', 'low', 'high']) AS part)
)
SELECT run, path, round(value, 9) AS value FROM figures""")
def run_figures(spark, sf_dir):
    """Every figure of the summaries of a run without errors, whose arms are compared, and of one with errors, whose comparison is withheld."""
    return summaries(spark, sf_dir, ["planned", "faulty"]).withColumn("value", F.round("value", 9))


TRAINED_SQL = f"""{_RUN_SQL}, able AS (SELECT * FROM marked WHERE run = 'planned' AND counts AND valid AND decision = 'approved'),
picks AS (SELECT q, c, coalesce(min(a) FILTER (WHERE wrong), min(a)) AS a FROM able WHERE c IN ('independent', 'adaptive') GROUP BY q, c
    UNION ALL SELECT q, c, a FROM able WHERE c = 'literal_control' AND a = 1 + CAST('0x' || substr({sha("'20260921'", "q", "'random'")}, 1, 16) AS HUGEINT) % 3),
kept AS (SELECT q FROM picks GROUP BY q HAVING count(*) = 3)"""


@query(f"""{TRAINED_SQL}, rows AS (SELECT q, arm, variant, CASE arm WHEN 'random' THEN 'literal_control' ELSE arm END AS c FROM kept, (SELECT unnest(['clean', 'random', 'independent', 'adaptive']) AS arm), (SELECT unnest(['clean', 'additional']) AS variant)),
told AS (SELECT rows.q, arm, variant, {letter_sql(b32("'gold'", 'rows.q') + ' % 4')} AS gold, p.a AS selected_attempt, CASE WHEN p.a IS NULL THEN '' WHEN p.c = 'literal_control' THEN {[*CONTROLS]}[p.a] ELSE {[*NOTES]}[p.a] END AS note
    FROM rows LEFT JOIN picks p ON rows.q = p.q AND rows.c = p.c AND variant = 'additional')
SELECT q AS question_id, arm, variant, gold, selected_attempt, note, CASE WHEN selected_attempt IS NULL THEN 'original_unchanged' ELSE 'approved' END AS clinical_review, '{{"answer":"' || gold || '","explanation":""}}' AS completion,
    sha256('{{"original_question": "Which letter belongs to user ' || q || '?", "original_options": {{"A": "first", "B": "second", "C": "third", "D": "fourth"}}, "untrusted_reference_note": "' || note || '"}}') AS prompt_sha256 FROM told""".replace("\"The patient's favorite fruit is mango.\"", "'The patient''s favorite fruit is mango.'"))
def training_rows(spark, sf_dir):
    """Training rows built from the planned run: questions without an approved pick for some arm are in none."""
    rows = stored(slots(spark, sf_dir, False))
    lines = run_lines(rows).select(F.lit("worker_0.jsonl").alias("source_file"), F.lit(0).alias("source_line"), "value")
    log, _ = run_folder.typed_rows(lines)
    items = rows.where("condition = 'baseline'").select("question_id", "question", options().alias("options"), letter(F.col("right")).alias("answer_idx"), "question_sha256", F.lit("train").alias("source_split"))
    ids = items.select("question_id")  # a run's metadata names its questions
    metadata = {"k": K, "run_kind": "pilot", "config": {"split": "train"}, "target_revision": "0" * 40, "question_ids": ids, "dataset_manifest": {"selection": {"sampled_ids": {"train": ids}}}}
    decisions = review_lines(rows).withColumn("place", F.monotonically_increasing_id())
    built = training.build_training(log, items, metadata, decisions=decisions)
    prompt = F.get_json_object(F.get_json_object("messages", "$[1]"), "$.content")
    return built.rows.select("question_id", "arm", "variant", "gold", "selected_attempt", "note", "clinical_review", "completion", F.sha2(prompt, 256).alias("prompt_sha256"))

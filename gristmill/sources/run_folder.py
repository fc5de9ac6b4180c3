"""Issues of reading a run's folder: its metadata, its worker and generation logs, its saved review.

Issues are (severity, code, source_file, source_line); the line is null where the whole file or folder is meant.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.canonical import parse_whole, raw_text
from gristmill.operators.attempts import raw_key_issue
from gristmill.sources.files import _fs, lenient_jsonl, lines, merge_metadata, review_csv

ISSUE = "severity string, code string, source_file string, source_line int"


def _issue(spark: SparkSession, *found: tuple[str, str | None]) -> DataFrame:
    """An issue for each (code, file)."""
    return spark.createDataFrame([("error", code, name, None) for code, name in found], ISSUE)


def _matches(spark: SparkSession, pattern: str) -> bool:
    p, fs = _fs(spark, pattern)
    return len(fs.globStatus(p) or []) > 0


def run_metadata(spark: SparkSession, folder: str, names: tuple[str, ...] = ("config.json", "manifest.json", "run.json")) -> tuple[dict, DataFrame]:
    """(the metadata of the files that exist, later ones first in force; invalid_metadata for each that is no JSON object)."""
    parts, bad = [], []
    for name in names:
        if not _matches(spark, f"{folder}/{name}"):
            continue
        text = spark.read.text(f"{folder}/{name}", wholetext=True).first()  # one small file
        try:
            part = json.loads(text[0] if text else "")
            if not isinstance(part, dict):
                raise ValueError("not an object")
            parts.append(part | {"config": part["config"] if isinstance(part.get("config"), dict) else {}})
        except ValueError:
            bad.append(("invalid_metadata", name))
    return merge_metadata(*parts), _issue(spark, *bad)


def worker_rows(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all worker logs with provenance, issues); without any log no rows, and missing_worker_files."""
    path = f"{folder}/worker_*.jsonl"
    if _matches(spark, path):
        return lenient_jsonl(spark, path, schema)
    return spark.createDataFrame([], f"{schema}, source_file string, source_line int"), _issue(spark, ("missing_worker_files", None))


#: Fields of a worker's log line by type.
TEXTS = ["condition", "gold", "answer", "status", "clinical_review", "run_kind", "category", "note", "candidate_note", "question_sha256", "distractor", "modified_question"]
FLAGS = ["correct", "syntactic_valid"]
NUMBERS = ["input_tokens", "output_tokens", "generator_input_tokens", "generator_output_tokens", "latency_s"]


def typed_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed_jsonl issues) of log lines (source_file, source_line, value): every field in its type or null, numbers as VARIANT, and the `key_issue` that the raw types make.

    A value of another type than its field's is null, not converted; ids of any type become text.  An absent clinical_review is pending.  answer_labels that are no list are an empty one, an
    element that is no text is null.  target_messages are JSON text.  Attempts beyond 32 bits count as the largest.
    """
    # exploded, so that what depends on the value parses no line again
    raw = lines.select("source_file", "source_line", F.col("value").rlike(r"\A\s*\{").alias("object"), F.explode(F.array(parse_whole(F.col("value")))).alias("raw")).withColumn("whole", F.col("raw").isNotNull() & F.col("object"))
    fields = ["question_id", "attempt", *TEXTS, *FLAGS, *NUMBERS, "answer_labels", "target_messages"]
    parts = raw.where("whole").selectExpr("raw", "source_file", "source_line", *(f"try_variant_get(raw, '$.{c}', 'variant') as {c}" for c in fields))

    def when(c: str, kind: str, then: str) -> str:
        return f"when schema_of_variant({c}) {kind} then {then}"

    text = lambda c: when(c, "= 'STRING'", f"try_variant_get({c}, '$', 'string')")
    labels = f"transform(try_variant_get(answer_labels, '$', 'array<variant>'), x -> case {text('x')} end)"
    typed = parts.select(
        "source_file", "source_line", raw_key_issue(F.col("raw")).alias("key_issue"), raw_text(F.col("question_id")).alias("question_id"), F.expr("cast(least(try_variant_get(attempt, '$', 'long'), 2147483647) as int) as attempt"),
        *(F.expr(f"case {text(c)} end as {c}") for c in TEXTS if c != "clinical_review"), F.expr(f"case when clinical_review is null then 'pending' {text('clinical_review')} end as clinical_review"),
        *(F.expr("case " + when(c, "= 'BOOLEAN'", f"try_variant_get({c}, '$', 'boolean')") + f" end as {c}") for c in FLAGS), *NUMBERS,
        F.expr("case when answer_labels is not null then case " + when("answer_labels", "like 'ARRAY<%'", labels) + " else cast(array() as array<string>) end end as answer_labels"), F.expr(f"coalesce(case {text('target_messages')} end, to_json(target_messages)) as target_messages"),
    )
    bad = raw.where("not whole").select(F.lit("error").alias("severity"), F.lit("malformed_jsonl").alias("code"), "source_file", "source_line")
    return typed, bad


def worker_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """typed_rows of all worker logs; without any log no rows, and missing_worker_files."""
    path = f"{folder}/worker_*.jsonl"
    if _matches(spark, path):
        return typed_rows(lines(spark, path))
    typed, _ = typed_rows(spark.createDataFrame([], "source_file string, source_line int, value string"))
    return typed, _issue(spark, ("missing_worker_files", None))


def generation_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Of the generation logs: lines that are no JSON object, and recorded errors. An error that is null, empty, false or zero is none."""
    path = f"{folder}/generations_*.jsonl"
    if not _matches(spark, path):
        return _issue(spark)
    rows = lines(spark, path).withColumn("v", parse_whole(F.col("value")))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    error = F.to_json(F.try_variant_get("v", "$.error", "variant"))
    failed = F.coalesce(~error.isin("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}"), F.lit(False))
    code = F.when(~whole, "malformed_generation_jsonl").when(failed, "generator_operational_error")
    return rows.select(F.lit("error").alias("severity"), code.alias("code"), "source_file", "source_line").where("code is not null")


def saved_review(spark: SparkSession, path: str, required: list[str], place: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the review, issues); no rows without a file, nor from one that lacks a required column, which is unreadable_review."""
    if not _matches(spark, path):
        return None, _issue(spark)
    try:
        return review_csv(spark, path, required, place), _issue(spark)
    except ValueError:
        return None, _issue(spark, ("unreadable_review", path.rsplit("/", 1)[-1]))

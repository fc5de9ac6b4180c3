"""A run from its log, metadata and saved review to one summary; nothing is compared while the record has errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import attempts, reports, reviews
from gristmill.operators.protocol import percent_text
from gristmill.sources import files, run_folder
from gristmill.sources.held import held, stored


@dataclass(frozen=True)
class Run:
    """summary: nested figures of a bounded size; judged: all rows; issues (severity, code, question_id, condition, attempt); cohort: its questions; review: the table to write back, None if the saved one can't be read."""

    summary: dict
    judged: DataFrame
    issues: DataFrame
    cohort: DataFrame
    review: DataFrame | None


def outcome_differences(valid: DataFrame, members: DataFrame, wrong: str, arms: tuple[str, str] = ("adaptive", "independent")) -> DataFrame:
    """(question_id, difference): whether any attempt of the first arm is wrong, less the same of the second; 1, 0 or -1 for each member."""
    return _differences(valid, members, {"difference": wrong}, arms)


def _differences(valid: DataFrame, members: DataFrame, named: dict[str, str], arms: tuple[str, str] = ("adaptive", "independent")) -> DataFrame:
    """outcome_differences of several flags in one pass, each under its name."""
    hit = lambda c, wrong: F.coalesce(F.max(F.when(F.col("condition") == c, F.col(wrong).cast("int"))), F.lit(0))
    both = members.join(valid.where(F.col("condition").isin(*arms)), "question_id", "left")
    return both.groupBy("question_id").agg(*((hit(arms[0], wrong) - hit(arms[1], wrong)).alias(name) for name, wrong in named.items()))


def _slots(frame: DataFrame) -> dict[str, dict]:
    """slot_stats by condition, as plain values; at most five rows."""
    out = {}
    for r in frame.collect():
        row = r.asDict()
        name = row.pop("condition")
        out[name] = {"status_counts": {s: row.pop(s) for s in attempts.STATUSES} | {"missing": row.pop("missing")}, **row}
    return out


def aggregate_run(rows: DataFrame, metadata: dict, *, decisions: DataFrame | None = None, order: str = "place", read_issues: DataFrame | None = None, k: int | None = None, samples: int = 2000, seed: int = 20260921) -> Run:
    """Judges a log, counts every planned slot, and compares the adaptive with the independent arm on the cohort's questions.

    rows: a typed log (run_folder.typed_rows, or columns of the same names).  decisions: a saved review of texts, its lines sorted by `order`.  read_issues: (severity, code) of reading.
    The issues are gathered first; if one is an error, or no baseline is right, the comparison is withheld: its figures are None and `valid` is false.
    An empty log has a summary of zeros; rates without a denominator are None.
    """
    spark = rows.sparkSession
    rows = stored(reviews.bound(rows))  # typed and digested once, for the facts and the judgement
    facts = attempts.run_facts(rows, metadata, k)
    saved, rest, found = reviews.saved_decisions(decisions, order) if decisions is not None else (None, None, spark.createDataFrame([], attempts.ISSUE))
    judged = stored(attempts.judge(rows, attempts.run_budgets(spark, facts, every=True), saved))
    valid = judged.where("exclusion_reason is null")
    base = attempts.cohort(valid).withColumn("member", F.lit(True))
    questions = held(attempts.run_questions(judged, metadata).join(base, "question_id", "left").select("question_id", "unexpected", F.coalesce("member", F.lit(False)).alias("member")))
    budgets, members = attempts.run_budgets(spark, facts), questions.where("member").select("question_id")

    issues = found.select("severity", "code", "question_id", "condition", F.col("attempt").cast("int").alias("attempt")).unionByName(attempts.row_issues(judged)).unionByName(attempts.gaps(questions, valid, budgets))
    if read_issues is not None:
        issues = issues.unionByName(read_issues.select("severity", "code"), allowMissingColumns=True)
    totals = questions.agg(F.count(F.lit(1)).alias("questions"), F.count_if("unexpected").alias("unexpected"), F.count_if("member").alias("cohort")).first()
    facts |= totals.asDict()
    own = [(severity, code, None, None, None) for severity, code, holds in attempts.RUN_RULES if holds(facts)]
    issues = issues.unionByName(spark.createDataFrame(own, attempts.ISSUE))
    issues = held(issues)
    tally = issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each code
    errors, warnings = (sum(r["n"] for r in tally if r["severity"] == x) for x in ("error", "warning"))
    comparable = not errors and facts["cohort"] > 0

    everyone, inside = (_slots(attempts.slot_stats(valid, q, budgets)) for q in (questions, members))
    curves: dict[str, list[dict]] = {}
    for r in attempts.curves(valid, members, budgets).orderBy("condition", "k").collect():  # conditions x budget rows
        curves.setdefault(r["condition"], []).append({**{c: v for c, v in r.asDict().items() if c != "condition"}, "complete": r["missing"] == 0})
    ks = dict((r["condition"], r["budget"]) for r in budgets.collect())
    empty = {"denominator": 0, "observed": 0, "correct": 0, "accuracy": None, "complete": True}
    undefined = lambda c: [{"k": i, "questions": 0, "provisional": 0, "confirmed": 0, "missing": 0, "provisional_rate": None, "confirmed_rate": None, "complete": True} for i in range(1, ks[c] + 1)]
    bootstrap: dict = {"valid": comparable, "at_k": facts["budget"], "draws": samples, "seed": seed}
    kinds = ["provisional", "confirmed"]
    bootstrap |= {name: {"n": facts["cohort"], "mean": None, "low": None, "high": None} for name in kinds}
    if comparable:
        for r in attempts.paired_bootstraps(_differences(valid, members, {x: f"{x}_wrong" for x in kinds}), kinds, samples, seed).collect():  # two rows
            bootstrap[r["value"]] = {c: v for c, v in r.asDict().items() if c != "value"}
    candidates = valid.where(F.col("condition").isin(reviews.REVIEWED))
    coverage = reports.review_coverage(candidates.withColumn("all", F.lit(1)), ["all"]).drop("all").first()
    summary = {
        "run_kind": facts["run_kind"], "budget_k": facts["budget"], "budget_source": facts["budget_source"], "n_questions": facts["questions"], "n_baseline_correct": facts["cohort"],
        "integrity": {"valid": not errors, "error_count": errors, "warning_count": warnings, "issues": [r.asDict() for r in sorted(tally)]},
        "all_questions": {"baseline": everyone.get("baseline", empty)},
        "conditions": {c: {"budget_k": ks[c], "all_questions": everyone.get(c, empty), "baseline_correct": inside.get(c, empty), "curves": curves.get(c) or undefined(c)} for c in facts["conditions"]},
        "paired_bootstrap": bootstrap, "review": coverage.asDict() if coverage else {"candidates": 0, "approved": 0, "rejected": 0, "pending": 0, "coverage": None},
    }
    return Run(summary, judged, issues, members, reviews.written_back(judged, saved, rest))


#: The columns of a run's table of results.
RESULT_FIELDS = [
    *attempts.KEY, "run_kind", "category", "gold", "answer", "correct", "derived_correct", "status", "syntactic_valid", "clinical_review", "provisional_wrong", "confirmed_wrong", "exclusion_reason",
    "reviewer", "review_note", "input_tokens", "output_tokens", "latency_s", "note", "source_file", "source_line",
]


def aggregate_folder(spark: SparkSession, folder: str, *, k: int | None = None, samples: int = 2000, seed: int = 20260921, write: bool = True) -> Run:
    """aggregate_run of a run's folder (config.json, manifest.json, run.json; worker_*.jsonl, generations_*.jsonl; review.csv).

    write: puts summary.json, report.md, results.csv and review.csv (folders of CSV files with header) in the place of older ones; a review that can't be read is left alone.
    """
    metadata, a = run_folder.run_metadata(spark, folder)
    rows, b = run_folder.worker_log(spark, folder)
    decisions, c = run_folder.saved_review(spark, f"{folder}/review.csv", [*attempts.KEY, "clinical_review"], "place")
    unreadable = not c.isEmpty()
    found = a.unionByName(b).unionByName(c).unionByName(run_folder.generation_issues(spark, folder))
    run = aggregate_run(rows, metadata, decisions=decisions, read_issues=found, k=k, samples=samples, seed=seed)
    run = replace(run, review=None if unreadable else held(run.review) if write else run.review)  # held: the old table is read no more once it is replaced
    if write:
        files.write_small(spark, f"{folder}/summary.json", json.dumps(run.summary, ensure_ascii=False, indent=2) + "\n")
        files.write_small(spark, f"{folder}/report.md", report(run.summary))
        empty = [F.lit("").alias(x) for x in RESULT_FIELDS if x not in run.judged.columns]
        files.replace_csv(run.judged.select("*", *empty), f"{folder}/results.csv", RESULT_FIELDS)
        if run.review is not None:
            files.replace_csv(run.review.orderBy("place"), f"{folder}/review.csv", reviews.REVIEW_FIELDS)
    return run


def flat(summary: dict, path: str = "") -> list[tuple[str, float | None]]:
    """(path, figure) of a summary's numbers and flags; list elements by their k or code."""
    out = []
    for key, v in summary.items():
        here = f"{path}{key}"
        if isinstance(v, dict):
            out += flat(v, f"{here}.")
        elif isinstance(v, list):
            for x in v:
                rest = {a: b for a, b in x.items() if a not in ("k", "code", "severity")}
                out += flat(rest, f"{here}.{x['k'] if 'k' in x else x['code']}.")
        elif v is None or isinstance(v, (int, float)):
            out.append((here, None if v is None else float(v)))
    return out


def report(summary: dict) -> str:
    """A Markdown report: what kind of run, its errors, a table of conditions, the comparison or that it is withheld, curves, issues."""
    s, integrity = summary, summary["integrity"]
    lines = [f"# {'Pilot check' if s['run_kind'] == 'pilot' else 'Evaluation record'}", ""]
    if s["run_kind"] == "pilot":
        lines += ["This run is a pilot: it checks the pipeline, and its figures are no final comparison.", ""]
    lines += [f"Run kind: {s['run_kind']}. {s['n_questions']} questions, {s['n_baseline_correct']} with a correct baseline; budget K = {s['budget_k']} ({s['budget_source']}).", ""]
    if "literal_control" in s["conditions"]:
        lines += [f"literal_control checks {s['conditions']['literal_control']['budget_k']} fixed sentences and isn't part of the comparison at equal budgets.", ""]
    if not integrity["valid"]:
        lines += [f"**The record has {integrity['error_count']} errors. The figures describe an incomplete record; differences and intervals are withheld.**", ""]
    base = s["all_questions"]["baseline"]
    lines += [f"Accuracy on the unchanged questions: {percent_text(base['accuracy'])} ({base['correct']}/{base['denominator']}).", ""]
    lines += ["| condition | budget | accuracy, all slots | accuracy, cohort | wrong within budget | confirmed | refusal / format / error / missing |", "|---|---:|---:|---:|---:|---:|---:|"]
    for c, m in s["conditions"].items():
        last, counts = m["curves"][-1], m["all_questions"].get("status_counts", {})
        shown = " / ".join(str(counts.get(x, 0)) for x in ("refusal", "format_error", "error", "missing"))
        lines.append(f"| {c} | {m['budget_k']} | {percent_text(m['all_questions']['accuracy'])} | {percent_text(m['baseline_correct']['accuracy'])} | {percent_text(last['provisional_rate'])} | {percent_text(last['confirmed_rate'])} | {shown} |")
    r = s["review"]
    lines += ["", f"Review: {r['approved']} approved, {r['rejected']} rejected, {r['pending']} pending; coverage {percent_text(r['coverage'])}.", ""]
    for name in ("provisional", "confirmed"):
        b = s["paired_bootstrap"][name]
        figure = "withheld" if b["mean"] is None else f"{100 * b['mean']:+.1f} points (95 % interval {100 * b['low']:+.1f} to {100 * b['high']:+.1f}, {b['n']} questions, seed {s['paired_bootstrap']['seed']})"
        lines.append(f"Adaptive less independent within K, {name}: {figure}.")
    lines += ["", "| condition | k | provisional | confirmed | questions | missing slots |", "|---|---:|---:|---:|---:|---:|"]
    lines += [f"| {c} | {x['k']} | {x['provisional']} | {x['confirmed']} | {x['questions']} | {x['missing']} |" for c, m in s["conditions"].items() for x in m["curves"]]
    if integrity["issues"]:
        lines += ["", *(f"- [{x['severity']}] {x['code']}: {x['n']}" for x in integrity["issues"])]
    return "\n".join(lines) + "\n"

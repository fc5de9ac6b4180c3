"""Reading a run's folder, generators, sequential feedback, token budgets, selection diagnostics."""

import pytest
from pyspark.sql import functions as F

from gristmill.operators import experiment, feedback
from gristmill.sources import run_folder


def codes(issues):
    return sorted((r["code"], r["source_file"], r["source_line"]) for r in issues.collect())


def test_folder_issues(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"config": {"k": 1, "seed": 2}, "k": 3}')
    (tmp_path / "run.json").write_text("[1]")
    metadata, issues = run_folder.run_metadata(spark, str(tmp_path))
    assert (metadata["k"], metadata["seed"]) == (3, 2) and codes(issues) == [("invalid_metadata", "run.json", None)]
    rows, issues = run_folder.worker_rows(spark, str(tmp_path), "id string")
    assert rows.count() == 0 and codes(issues) == [("missing_worker_files", None, None)]
    assert run_folder.generation_issues(spark, str(tmp_path)).isEmpty()
    (tmp_path / "worker_0.jsonl").write_text('{"id": "a"}\nbroken\n')
    rows, issues = run_folder.worker_rows(spark, str(tmp_path), "id string")
    assert [r["id"] for r in rows.collect()] == ["a"] and codes(issues) == [("malformed_jsonl", "worker_0.jsonl", 2)]


def test_generation_errors(spark, tmp_path):
    quiet = ['{"raw": "x"}', *(f'{{"error": {e}}}' for e in ("null", '""', "false", "0", "[]", "{}")), ""]
    (tmp_path / "generations_0.jsonl").write_text("\n".join([*quiet, '{"error": "out of memory"}', '{"error": "false"}', "[1]", "{"]))
    n = len(quiet)
    want = [(n + 1, "generator_operational_error"), (n + 2, "generator_operational_error"), (n + 3, "malformed_generation_jsonl"), (n + 4, "malformed_generation_jsonl")]
    assert sorted((r["source_line"], r["code"]) for r in run_folder.generation_issues(spark, str(tmp_path)).collect()) == want


def test_saved_review(spark, tmp_path):
    path = tmp_path / "review.csv"
    rows, issues = run_folder.saved_review(spark, str(path), ["q"])
    assert rows is None and issues.isEmpty()
    path.write_text("a,b\n1,2\n")
    rows, issues = run_folder.saved_review(spark, str(path), ["q"])
    assert rows is None and codes(issues) == [("unreadable_review", "review.csv", None)]
    path.write_text("q,b\n1,2\n")
    rows, issues = run_folder.saved_review(spark, str(path), ["q"])
    assert rows.count() == 1 and issues.isEmpty()


def test_generator(spark):
    df = spark.createDataFrame([("a b", 1), ("c", 2)], "messages string, seed long")
    got = feedback.generate_with(df, lambda m, s, t, n: (m.upper(), len(m.split()), int(s)), max_new_tokens=2).orderBy("seed").collect()
    assert [(r["raw"], r["input_tokens"], r["output_tokens"], r["hit_token_limit"]) for r in got] == [("A B", 2, 1, False), ("C", 1, 2, True)]


def test_feedback_sees_earlier_rows_of_its_question(spark):
    rows = [(q, c, i, q == "b" and i == 1, "old" if q == "b" and i == 1 else None) for q in "ab" for i in (3, 1, 2) for c in ("adaptive", "other")]
    df = spark.createDataFrame(rows, "q string, condition string, i int, finished boolean, said string")

    def step(row, history):
        return {"said": f"{row['i']}:" + ",".join(h["said"] for h in history)}

    got = feedback.with_feedback(df, "q", ["i", "condition"], step, "said string", feeds=lambda r: r["condition"] == "adaptive", done="finished")
    said = {(r["q"], r["condition"], r["i"]): r["said"] for r in got.collect()}
    assert said["a", "adaptive", 3] == "3:1:,2:1:" and said["a", "other", 1] == "1:1:"
    assert said["b", "adaptive", 1] == "old" and said["b", "adaptive", 2] == "2:old" and len(said) == 12


def test_token_budget(spark):
    def scorer(cases):
        assert len(cases) == 1 or len(cases) * max(c["n"] for c in cases) <= 100
        return [[0.4, 0.3, 0.2, 0.1] for _ in cases]

    df = spark.createDataFrame([(i, n, "A") for i, n in enumerate([10, 20, 50, 300, 1, 1, 99])], "id int, n int, gold string").coalesce(1)
    assert experiment.score_with(df, scorer, ["n"], length="n", tokens=100).where("correct").count() == 7
    with pytest.raises(Exception, match="over the limit"):
        experiment.score_with(df, scorer, ["n"], length="n", limit=299).collect()


def test_selection_diagnostics_and_changed_candidates(spark):
    clean = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "id string, correct boolean")
    own = {"a": (True, True), "b": (True, False), "c": (False, False), "d": (False, True)}
    chosen = spark.createDataFrame([(i, p, not x) for i, (f, n) in own.items() for p, x in (("random", True), ("flip", f), ("near_miss", n))], "id string, policy string, fallback boolean")
    assert experiment.selection_diagnostics(clean, chosen).first().asDict() == {"questions": 4, "base_correct": 3, "both_eligible": 1, "flip_only": 1, "near_miss_only": 1, "neither_eligible": 1}
    q = spark.createDataFrame([("a", "A"), ("b", "C")], "id string, gold string")
    notes = experiment.candidates(q, "train")
    assert experiment.changed_candidates(q, notes, "train").isEmpty()
    other = notes.where("not (id = 'a' and candidate_index = 2)").withColumn("note", F.when((F.col("id") == "b") & (F.col("candidate_index") == 0), "x").otherwise(F.col("note")))
    assert {tuple(r) for r in experiment.changed_candidates(q, other, "train").collect()} == {("a", 2), ("b", 0)}

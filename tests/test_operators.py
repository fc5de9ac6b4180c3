import hashlib

from pyspark.sql import functions as F

from gristmill.operators import attempts, experiment, relational


def test_dedup_conflicts_keep_first(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c", "z")], "i int, k string, c string")
    got = {r["i"]: r["role"] for r in relational.dedup_with_conflicts(df, F.col("k"), F.col("c"), "i").collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "conflict", 4: "conflict", 5: "kept"}


def test_dev_is_fixed_when_train_grows(spark):
    df = spark.range(300)
    part = lambda n: {r["id"]: r["part"] for r in relational.split_by_hash(df, "id", 1, "train-dev", [("dev", 20), ("train", n)]).collect()}
    a, b = part(50), part(100)
    dev = {i for i, p in a.items() if p == "dev"}
    assert len(dev) == 20 and dev == {i for i, p in b.items() if p == "dev"} and sum(p == "train" for p in b.values()) == 100


def test_leakage(spark):
    train = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, c string")
    test = spark.createDataFrame([("b", "1"), ("c", "2")], "k string, c string")
    kept, bad = relational.leakage_free(train, test, "k", "c")
    assert [r["k"] for r in kept.collect()] == ["a"] and [r["k"] for r in bad.collect()] == ["c"]


def test_reconcile_coverage_epochs(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "x")], "k int, v string"), spark.createDataFrame([(2, "y"), (3, "x")], "k int, v string")
    assert {r["k"]: r["state"] for r in relational.reconcile(a, b, ["k"], "v").collect()} == {1: "left_only", 2: "different", 3: "right_only"}
    got = relational.coverage(a, b.union(b.where("k = 2")), "k").first()
    assert (got["expected"], got["rows"], got["missing"], got["unexpected"], got["exact"]) == (2, 3, 1, 1, False)
    sizes = relational.epoch_groups(spark.range(35), "id", 1, 0, 16).groupBy("epoch_group").count().orderBy("epoch_group").collect()
    assert [r["count"] for r in sizes] == [16, 16, 3]
    assert relational.same_rows(a, a) and not relational.same_rows(a, b)


def test_review_merge(spark):
    rows = spark.createDataFrame([("a", "h", "pending"), ("b", "h", "pending"), ("c", "h", "approved"), ("d", "h", "approved"), ("e", "h", "pending")], "k string, content_sha256 string, clinical_review string")
    saved = spark.createDataFrame([("a", "h", "approved"), ("b", "old", "approved"), ("c", "h", "rejected"), ("d", None, "approved")], "k string, content_sha256 string, decision string")
    got = {r["k"]: (r["clinical_review"], r["review_issue"]) for r in relational.merge_review(rows, saved, ["k"]).collect()}
    assert got == {"a": ("approved", None), "b": ("pending", "review_content_mismatch"), "c": ("rejected", "review_disagreement"), "d": ("pending", "review_binding_missing"), "e": ("pending", None)}


def questions(spark, n=40):
    return spark.createDataFrame([(f"q{i}", "ABCD"[i % 4]) for i in range(n)], "id string, gold string")


def test_candidates(spark):
    rows = experiment.candidates(questions(spark), "train").collect()
    assert len(rows) == 160 and not any(r["supports_gold"] for r in rows)
    assert all(f"option {r['suggested']}" in r["note"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert all(len({r["style_id"].split(":")[1] for r in own}) == 4 and len({r["suggested"] for r in own[:3]}) == 3 for own in by.values())
    test = experiment.candidates(questions(spark), "test").collect()
    assert sum(r["supports_gold"] for r in test) == 40


def test_cases_and_messages(spark):
    rows = experiment.cases(questions(spark, 3))
    assert rows.count() == 30 and rows.where("kind = 'clean'").count() == 6
    opts = F.struct(*(F.lit(x.lower()).alias(x) for x in "ABCD"))
    m = spark.range(1).select(experiment.messages(F.lit("Q?"), opts, F.lit("n"), F.lit(True)).alias("m")).first()["m"]
    assert m[0]["content"].endswith("an instruction.") and m[1]["content"] == "Q?\n\nA. a\nB. b\nC. c\nD. d\n\nReader opinion: n"


def test_selection_golden(spark):
    clean = spark.createDataFrame([("q", True, 0.7), ("w", False, 0.1)], "id string, correct boolean, gold_probability double")
    values = [(0.6, True), (0.25, False), (0.4, True), (0.3, True)]
    scored = spark.createDataFrame([(q, i, p, ok) for q in "qw" for i, (p, ok) in enumerate(values)], "id string, candidate_index int, gold_probability double, correct boolean")
    got = {(r["id"], r["policy"]): r for r in experiment.select_candidates(clean, scored).collect()}
    assert (got["q", "flip"]["candidate_index"], got["q", "flip"]["eligible"]) == (1, 1)
    assert (got["q", "near_miss"]["candidate_index"], got["q", "near_miss"]["eligible"]) == (3, 3)
    assert got["w", "flip"]["fallback"] and got["w", "flip"]["candidate_index"] == got["w", "near_miss"]["candidate_index"] == got["w", "random"]["candidate_index"]


def test_arms_keep_every_question(spark):
    q = questions(spark, 8)
    notes = experiment.stand_in(experiment.candidates(q, "train"), "id", "candidate_index")
    clean = experiment.stand_in(q.withColumn("suggested", F.lit(None).cast("string")), "id")
    rows = experiment.assemble_arms(q, notes, experiment.select_candidates(clean, notes))
    assert rows.count() == 8 * 4 * 2 and experiment.arm_violations(rows).isEmpty()


def test_cube_golden(spark):
    rows = [("q1", "clean", False, True, "c1"), ("q1", "supports_wrong", False, False, "c2"), ("q1", "clean", True, False, "c3"), ("q1", "supports_wrong", True, False, "c4"), ("q2", "clean", False, False, "c5"), ("q2", "supports_wrong", False, False, "c6")]
    df = spark.createDataFrame([(q, k, d, ok, c, q == "q1") for q, k, d, ok, c in rows], "id string, kind string, defended boolean, correct boolean, case_id string, seen boolean")
    got = {(r["subset"], r["prompt"], r["condition"]): r for r in experiment.summary_cube(df, "seen").collect()}
    assert got["all", "neutral", "clean"]["accuracy"] == 0.5 and got["all", "neutral", "clean"]["flips"] is None
    x = got["all", "neutral", "perturbed"]
    assert (x["matched"], x["flips"], x["flip_rate"]) == (1, 1, 1.0)
    assert got["all", "defended", "perturbed"]["flip_rate"] is None and got["previously_unseen", "neutral", "perturbed"]["flip_rate"] is None


def test_score_with_halves_batches(spark):
    def scorer(cases):
        if len(cases) > 3:
            raise MemoryError
        return [[0.1, 0.2, 0.3, 0.4] for _ in cases]

    got = experiment.score_with(questions(spark, 10), scorer, ["id"], 8).collect()
    assert len(got) == 10 and all(r["predicted"] == "D" for r in got)


LOG = "question_id string, condition string, attempt int, gold string, answer string, correct boolean, status string, syntactic_valid boolean, clinical_review string"


def log(change=lambda r: [r]):
    out = []
    for q in ("q1", "q2"):
        for c, ks in (("baseline", [0]), ("clean_repeat", [1, 2]), ("independent", [1, 2]), ("adaptive", [1, 2])):
            for k in ks:
                out += change({"question_id": q, "condition": c, "attempt": k, "gold": "A", "answer": "A", "correct": True, "status": "ok", "syntactic_valid": True, "clinical_review": "pending"})
    return [tuple(r.values()) for r in out]


def run(spark, rows, k=2):
    df = spark.createDataFrame(rows, LOG)
    budgets = spark.createDataFrame([("baseline", 0), ("clean_repeat", k), ("independent", k), ("adaptive", k)], "condition string, budget int")
    good, issues = attempts.validate(df, budgets)
    return df, good, sorted(r["code"] for r in issues.collect()), budgets


def test_missing_slot_keeps_denominator(spark):
    df, good, _, b = run(spark, log(lambda r: [] if (r["question_id"], r["condition"], r["attempt"]) == ("q1", "adaptive", 2) else [r]))
    got = {r["condition"]: r for r in attempts.slot_stats(good, df, b).collect()}["adaptive"]
    assert (got["denominator"], got["missing"], got["accuracy"]) == (4, 1, 0.75)


def test_curve_and_bootstrap(spark):
    def wrong(r):
        if (r["question_id"], r["condition"]) in {("q1", "adaptive"), ("q2", "independent")}:
            r |= {"answer": "B", "correct": False}
        return [r]

    _, good, codes, b = run(spark, log(wrong))
    assert codes == []
    got = {(r["condition"], r["k"]): r["provisional_rate"] for r in attempts.curves(good, attempts.cohort(good), b).collect()}
    assert got["adaptive", 1] == got["independent", 2] == 0.5 and got["clean_repeat", 2] == 0
    d = spark.createDataFrame([(1,), (-1,)], "v int")
    x = attempts.paired_bootstrap(d, "v", 50, 1).first()
    assert x["n"] == 2 and x["mean"] == 0 and -1 <= x["low"] <= x["high"] <= 1
    zero = attempts.paired_bootstrap(spark.createDataFrame([(0,)] * 5, "v int"), "v", 20, 1).first()
    assert (zero["low"], zero["high"]) == (0, 0)


def test_duplicate_baseline_and_bad_values(spark):
    _, good, codes, b = run(spark, log(lambda r: [r, r] if (r["question_id"], r["condition"]) == ("q1", "baseline") else [r]))
    assert codes == ["duplicate_key"] and [r["question_id"] for r in attempts.cohort(good).collect()] == ["q2"]

    def odd(r):
        c = (r["question_id"], r["condition"], r["attempt"])
        if c == ("q1", "adaptive", 1):
            r |= {"correct": False}
        if c == ("q1", "adaptive", 2):
            r |= {"gold": "B", "answer": "B"}
        if c == ("q2", "adaptive", 1):
            r |= {"status": "lost", "correct": False}
        if c == ("q2", "adaptive", 2):
            r |= {"attempt": 9}
        return [r]

    _, good, codes, _ = run(spark, log(odd))
    assert codes == ["correct_flag_mismatch", "gold_disagreement", "invalid_status", "over_budget", "target_operational_error"]


def test_run_review_and_label_issues(spark):
    df, good, _, _ = run(spark, log())
    plan = {"k": 2, "question_ids": ["q1", "q2"], "n_questions": 2, "run_kind": "pilot"}
    codes = lambda x: sorted((r["code"], r["question_id"], r["condition"]) for r in x.collect())
    assert codes(attempts.run_issues(df, good, plan)) == []
    cut = lambda r: [] if (r["question_id"], r["condition"], r["attempt"]) in {("q1", "baseline", 0), ("q2", "adaptive", 2)} else [r]
    df, good, _, _ = run(spark, log(cut))
    assert codes(attempts.run_issues(df, good, plan)) == [("incomplete_budget", "q2", "adaptive"), ("missing_baseline", "q1", None)]
    odd = attempts.run_issues(df.withColumn("run_kind", F.lit("evaluation")), good.limit(0), {"question_ids": ["q1"], "n_questions": 3, "literal_control_count": 0, "run_kind": "pilot"})
    assert {"unexpected_question_ids", "question_count_mismatch", "unknown_planned_budget", "invalid_literal_control_count", "empty_baseline_correct_cohort", "mixed_run_kind"} <= {c[0] for c in codes(odd)}
    assert "unknown_run_kind" in {c[0] for c in codes(attempts.run_issues(df, good, {}))}
    saved = [(1, "q1", "adaptive", 1, "approved"), (2, "q1", "adaptive", 1, "rejected"), (3, "q1", "baseline", 4, "approved"), (4, "q2", "adaptive", 1, "maybe")]
    kept, issues = attempts.review_issues(spark.createDataFrame(saved, "line int, question_id string, condition string, attempt int, clinical_review string"), "line")
    assert sorted(r["line"] for r in kept.collect()) == [1, 4] and sorted(r["code"] for r in issues.collect()) == ["duplicate_review_key", "invalid_review_decision", "invalid_review_key"]
    labelled = spark.createDataFrame(log(), LOG).withColumn("answer_labels", F.when(F.col("question_id") == "q1", F.array().cast("array<string>")))
    _, issues = attempts.validate(labelled, spark.createDataFrame([("clean_repeat", 2), ("independent", 2), ("adaptive", 2)], "condition string, budget int"))
    assert {r["code"] for r in issues.collect()} == {"invalid_answer_labels"}


def test_empty_cohort_gives_no_rates(spark):
    _, good, _, b = run(spark, log(lambda r: [r | {"answer": "B", "correct": False}] if r["condition"] == "baseline" else [r]))
    assert attempts.cohort(good).isEmpty() and attempts.curves(good, attempts.cohort(good), b).isEmpty()


def test_policy_and_history(spark):
    def wrong(r):
        return [r | {"answer": "C", "correct": False}] if (r["condition"], r["attempt"]) == ("adaptive", 2) else [r]

    _, good, _, _ = run(spark, log(wrong))
    picks = {(r["question_id"], r["condition"]): (r["attempt"], r["wrong"]) for r in attempts.policy_pick(good, 1, 3).collect()}
    assert picks["q1", "adaptive"] == (2, True) and picks["q1", "independent"] == (1, False)
    literal = spark.createDataFrame([(q, "literal_control", i, "A", "B" if i == 1 else "A", i != 1, "ok", q != "q2", "pending") for q in ("q1", "q2", "q3") for i in (1, 2, 3)], LOG)
    drawn = {q: int(hashlib.sha256(f"1|{q}|random".encode()).hexdigest()[:16], 16) % 3 + 1 for q in ("q1", "q3")}
    assert {r["question_id"]: (r["attempt"], r["wrong"]) for r in attempts.policy_pick(literal, 1, 3).collect()} == {q: (n, None) for q, n in drawn.items()}  # whatever the answers
    h = {(r["condition"], r["attempt"]): r["history"] for r in attempts.history(good.where("question_id = 'q1'")).collect()}
    assert h["adaptive", 1] == [] and [x["attempt"] for x in h["adaptive", 2]] == [1]

"""Training rows: the literal control drawn beforehand, questions left out of all arms, and every record that is refused."""

import hashlib
import json

import pytest

from gristmill.operators import protocol, training
from gristmill.operators.experiment import CONTROLS
from gristmill.sources.run_folder import typed_rows

OPTIONS = dict(zip("ABCD", ["first é", 'second "quoted"', "third", "fourth\n"], strict=True))
NOTES = ["The hall was quiet.", "A bird sat by the window."]
SEED = 20260921


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def drawn(q):
    return int(sha(f"{SEED}|{q}|random")[:16], 16) % len(CONTROLS) + 1


def messages(question, note):
    payload = {"original_question": question, "original_options": OPTIONS, "untrusted_reference_note": note}
    return [{"role": "system", "content": protocol.TARGET_SYSTEM}, {"role": "user", "content": json.dumps(payload, ensure_ascii=False)}]


def source(ids=("q1", "q2")):
    items = [{"question_id": q, "question": f"Which letter, {q}?\t\x0b", "options": OPTIONS, "answer_idx": "A", "source_split": "train"} for q in ids]
    rows = []
    for it in items:
        it["question_sha256"] = sha(it["question"])
        for condition, notes in (("baseline", [""]), ("clean_repeat", ["", ""]), ("independent", NOTES), ("adaptive", NOTES), ("literal_control", CONTROLS)):
            for n, note in enumerate(notes, condition != "baseline"):
                rows.append({
                    "question_id": it["question_id"], "condition": condition, "attempt": n, "gold": "A", "answer": "A", "correct": True, "status": "ok", "note": note, "candidate_note": note, "syntactic_valid": True,
                    "clinical_review": "approved", "question_sha256": it["question_sha256"], "target_messages": messages(it["question"], note),
                })
    ids = list(ids)
    return rows, items, {"k": 2, "run_kind": "pilot", "config": {"split": "train"}, "target_revision": "a" * 40, "question_ids": ids, "dataset_manifest": {"selection": {"sampled_ids": {"train": ids, "dev": ["x"]}}}}


def pick(rows, q, condition, attempt):
    return next(r for r in rows if (r["question_id"], r["condition"], r["attempt"]) == (q, condition, attempt))


def frames(spark, rows, items):
    lines = spark.createDataFrame([("w", i, json.dumps(r)) for i, r in enumerate(rows)], "source_file string, source_line int, value string")
    frame = spark.createDataFrame([(*(it[c] for c in ("question_id", "question", "answer_idx", "question_sha256", "source_split")), tuple(it["options"].values())) for it in items], "question_id string, question string, answer_idx string, question_sha256 string, source_split string, options struct<A: string, B: string, C: string, D: string>")
    return typed_rows(lines)[0], frame


def build(spark, rows, items, metadata, **kw):
    return training.build_training(*frames(spark, rows, items), metadata, **kw)


def test_rows(spark):
    rows, items, metadata = source(("q1", "q2", "q3", "q4"))
    pick(rows, "q1", "adaptive", 2).update(answer="B", correct=False)  # the earliest wrong one is taken
    for n in range(1, 4):
        if n != drawn("q1"):
            pick(rows, "q1", "literal_control", n).update(answer="B", correct=False)  # wrong controls are no reason to take another
    pick(rows, "q2", "literal_control", drawn("q2")).update(clinical_review="pending")
    pick(rows, "q3", "independent", 1).update(clinical_review="rejected")
    for n in (1, 2):
        pick(rows, "q4", "adaptive", n).update(syntactic_valid=False, note="taken 12 times", candidate_note="taken 12 times")
    out = build(spark, rows, items, metadata)
    got = {(r["question_id"], r["arm"], r["variant"]): r for r in out.rows.collect()}
    assert len(got) == 2 * 4 * 2 and {k[0] for k in got} == {"q1", "q3"}
    assert {r["question_id"]: r["missing"] for r in out.excluded.collect()} == {"q2": ["random"], "q4": ["adaptive"]}
    r = got["q1", "adaptive", "additional"]
    assert (r["selected_attempt"], r["note"], r["completion"], r["clinical_review"]) == (2, NOTES[1], '{"answer":"A","explanation":""}', "approved")
    assert json.loads(r["messages"]) == messages(items[0]["question"], NOTES[1])
    assert got["q1", "random", "additional"]["selected_attempt"] == drawn("q1") and got["q3", "independent", "additional"]["selected_attempt"] == 2
    for arm, variant in (("clean", "clean"), ("clean", "additional"), ("adaptive", "clean")):
        r = got["q1", arm, variant]
        assert (r["note"], r["selected_attempt"], r["clinical_review"]) == ("", None, "original_unchanged") and json.loads(r["messages"]) == messages(items[0]["question"], "")
    assert out.provisional == 0 and out.selections.count() == 6
    loose = build(spark, rows, items, metadata, allow_provisional=True)
    assert loose.provisional == 1 and {r["question_id"] for r in loose.excluded.collect()} == {"q4"}


def test_refused_sources(spark):
    rows, items, metadata = source()
    for match, meta, log in (("train split", {"config": {"split": "dev"}}, rows), ("revision", {"target_revision": "main"}, rows), ("incomplete_budget", {}, rows[:-1])):
        with pytest.raises(ValueError, match=match):
            build(spark, log, items, metadata | meta)
    for r in rows:
        if r["condition"] == "literal_control":
            r["clinical_review"] = "rejected"
    with pytest.raises(ValueError, match="no question has"):
        build(spark, rows, items, metadata)


def test_refused_rows(spark):
    rows, items, _ = source()
    items[1]["answer_idx"] = "B"
    pick(rows, "q1", "adaptive", 1).update(note="Taken 12 times.", target_messages=messages(items[0]["question"], "Taken 12 times."))
    pick(rows, "q1", "adaptive", 2).update(target_messages=messages(items[0]["question"], NOTES[0]))
    pick(rows, "q1", "independent", 1).update(target_messages=messages(items[0]["question"], ""), syntactic_valid=False)  # not told to any arm
    pick(rows, "q1", "independent", 2).update(question_sha256="0")
    got = sorted(tuple(r) for r in training.row_violations(*frames(spark, rows, items)).collect())
    gold = [("q2", f"another gold letter or question in {r['condition']}/{r['attempt']}") for r in rows if r["question_id"] == "q2"]
    assert got == sorted([*gold, ("q1", "the note breaks a rule in adaptive/1"), ("q1", "the prompt isn't that of question and note in adaptive/2"), ("q1", "another gold letter or question in independent/2")])
    with pytest.raises(ValueError, match="rows: q1: another gold letter or question in independent/2; q1: the note breaks"):
        training._refuse(training.row_violations(*frames(spark, rows, items)), "rows")


def test_item_violations(spark):
    rows = [("q1", "a", sha("a"), "train"), ("q2", "a", sha("a"), "train"), ("q4", "a", sha("b"), "train"), ("q5", "a", sha("a"), "train"), ("q5", "a", sha("a"), "train"), ("q6", "a", sha("a"), "train"), ("q7", "a", sha("a"), "dev")]
    items = spark.createDataFrame(rows, "question_id string, question string, question_sha256 string, source_split string")
    ids = ["q1", "q3", "q4", "q5", "q6", "q7"]
    got = training.item_violations(items, {"question_ids": ids, "dataset_manifest": {"selection": {"sampled_ids": {"train": [*ids, "q2"], "dev": ["q6"]}}}})
    assert {tuple(r) for r in got.collect()} == {("q2", "not planned"), ("q3", "not among the kept questions"), ("q4", "another origin or text"), ("q5", "repeated"), ("q6", "not a training question"), ("q7", "another origin or text")}


def test_target_messages(spark):
    from pyspark.sql import functions as F

    options = F.struct(*(F.lit(v).alias(k) for k, v in OPTIONS.items()))
    df = spark.createDataFrame([("a \x1f\x7f/", "n"), (" ", "n"), ("a", None), ("a", "")], "q string, n string")
    got = [r[0] for r in df.select(protocol.target_messages(F.col("q"), options, F.col("n"))).collect()]
    assert json.loads(got[0]) == messages("a \x1f\x7f/", "n") and got[0] == json.dumps(messages("a \x1f\x7f/", "n"), ensure_ascii=False)
    assert got[1:3] == [None, None] and json.loads(got[3]) == messages("a", "")


def test_questions_as_a_table(spark):
    """A run's questions may be a table, which never passes through the driver, as well as a list."""
    from gristmill.operators import attempts

    rows, items, metadata = source(("q1", "q2"))
    frame = frames(spark, rows, items)
    ids = spark.createDataFrame([("q1",), ("q3",)], "question_id string")
    listed = {"question_ids": ["q1", "q3"], "dataset_manifest": {"selection": {"sampled_ids": {"train": ["q1", "q3"], "dev": ["q2"]}}}}
    table = {"question_ids": ids, "dataset_manifest": {"selection": {"sampled_ids": {"train": ids, "dev": ["q2"]}}}}
    for what in (lambda m: training.item_violations(frame[1], m), lambda m: attempts.run_questions(frame[0], m)):
        assert sorted(map(tuple, what(table).collect())) == sorted(map(tuple, what(listed).collect()))
    none = attempts.run_questions(frame[0], {"question_ids": ids.where("false")}).collect()
    assert {tuple(r) for r in none} == {("q1", False), ("q2", False)}
    assert build(spark, rows, items, metadata | {"question_ids": ids.where("question_id = 'q1'").union(spark.createDataFrame([("q2",)], "question_id string"))}).rows.count() == 16


def test_slots_are_dealt_out(spark, tmp_path):
    """Few users make many lines: these lie in as many partitions as a shuffle has, not in the users' one."""
    from gristmill.plans import runs

    spark.createDataFrame([(i,) for i in range(50)], "user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert runs.slots(spark, str(tmp_path), False).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

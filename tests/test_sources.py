import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gristmill.sources import files
from gristmill.streaming import events


def write(path, *lines):
    path.write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    return str(path)


def question(**more):
    return json.dumps({"question": "Wer?\n é ", "options": dict(zip("ABCD", "wxyz", strict=True)), "answer_idx": "B", "answer": "x"} | more, ensure_ascii=False)


def test_raw_questions(spark, tmp_path):
    bad_keys = {"options": {"A": "w", "B": "x", "C": "y", "D": "z", "E": "e"}}
    path = write(tmp_path / "q.jsonl", question(), "", question(question=" "), question(answer="y"), question(answer_idx="E"), question(**bad_keys), "[1]", "{", question(options=dict(zip("ABCD", ["w", " ", "y", "z"], strict=True))))
    got = {r["source_index"]: r for r in files.raw_questions(spark, path, "train").collect()}
    assert {i: r["violation"] for i, r in got.items()} == {0: None, 2: "blank_question", 3: "answer_text_mismatch", 4: "invalid_answer_label", 5: "options_not_a_to_d", 6: "not_an_object", 7: "not_an_object", 8: "blank_option"}
    assert got[0]["id"] == "train-00000000" and got[0]["question_sha256"] == hashlib.sha256("Wer?\n é ".encode()).hexdigest()


def test_json_lines(spark, tmp_path):
    path = write(tmp_path / "worker_0.jsonl", '{"id": "a", "n": 1}', "broken", '{"id": "b", "n": 2}')
    rows, issues = files.lenient_jsonl(spark, path, "id string, n int")
    assert [(r["id"], r["source_line"]) for r in rows.orderBy("id").collect()] == [("a", 1), ("b", 3)] and issues.first()["source_line"] == 2
    assert files.tolerant_jsonl(spark, path, "id string, n int").count() == 2
    with pytest.raises(Exception):
        files.strict_jsonl(spark, path, "id string, n int").collect()
    with pytest.raises(Exception):
        files.torn_tail(spark, path, "id string, n int", "id").collect()
    torn = write(tmp_path / "torn.jsonl", '{"id": "a", "n": 1}', '{"id": "b", "n"')
    assert [r["id"] for r in files.torn_tail(spark, torn, "id string, n int", "id").collect()] == ["a"]
    twice = write(tmp_path / "twice.jsonl", '{"id": "a", "n": 1}', '{"id": "a", "n": 2}')
    with pytest.raises(Exception):
        files.torn_tail(spark, twice, "id string, n int", "id").collect()


def test_sinks_and_audit(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, ["x", "y"])], "b string, a int, c array<string>")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert files.is_complete(spark, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.json"))) == '{"a":1,"b":"k","c":["x","y"]}\n'
    files.write_csv(df, str(tmp_path / "csv"), ["b", "c"])
    got = files.review_csv(spark, str(tmp_path / "csv"), ["b"]).first()
    assert (got["b"], got["c"]) == ("k", '["x","y"]')
    with pytest.raises(ValueError, match="missing"):
        files.review_csv(spark, str(tmp_path / "csv"), ["zzz"])
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.bin").write_bytes(b"1")
    (tmp_path / "f/b.bin").write_bytes(b"2")
    found = files.checksums(spark, str(tmp_path / "f"))
    declared = spark.createDataFrame([("a.bin", 1, hashlib.sha256(b"1").hexdigest()), ("c.bin", 1, "x")], "name string, size long, sha256 string")
    assert {r["name"]: r["state"] for r in files.audit(found, declared).collect()} == {"b.bin": "unexpected", "c.bin": "missing"}
    assert files.merge_metadata({"config": {"k": 1}, "k": 2}, {"config": {"k": 3}}) == {"k": 3}


def test_stream_and_resume(spark, tmp_path):
    path = str(tmp_path / "ev")
    rows = spark.createDataFrame([(1, "click", "2024-01-01 00:10:00"), (1, "click", "2024-01-01 00:10:00"), (2, "view", "2024-01-01 01:10:00")], "event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    rows.write.parquet(path)
    got = events.run_once(spark, path, rows.schema, events.hourly_counts, "hourly")
    assert {(r["event_type"], r["n"]) for r in got.collect()} == {("click", 1), ("view", 1)}
    done = spark.createDataFrame([(1,)], "id long")
    assert [r["id"] for r in events.resume(spark.range(3), done, ["id"]).orderBy("id").collect()] == [0, 2]
    with pytest.raises(Exception):
        events.resume(spark.range(3), done.union(done), ["id"]).collect()
    assert events.progress(done, 1).first()["complete"]


def test_swap_and_reports(spark, tmp_path):
    from gristmill.operators.experiment import arm_status

    (tmp_path / "new").mkdir()
    (tmp_path / "new/a").write_text("2")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a").write_text("1")
    files.refuse_unknown(spark, str(tmp_path / "out"), {"a"})
    with pytest.raises(ValueError, match="a"):
        files.refuse_unknown(spark, str(tmp_path / "out"), {"b"})
    files.swap_directory(spark, str(tmp_path / "new"), str(tmp_path / "out"))
    assert (tmp_path / "out/a").read_text() == "2" and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(Exception):
        files.swap_directory(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert (tmp_path / "out/a").read_text() == "2"
    assert files.markdown_table([{"a": 1, "flip_rate": 0.5}, {"a": None}], ["a", "flip_rate"]) == "| a | flip_rate |\n|---|---|\n| 1 | 50.0% |\n| n/a | n/a |\n"
    status = lambda *s: arm_status(spark.createDataFrame([(str(i), x) for i, x in enumerate(s)], "arm string, status string")).first()[0]
    assert [status("complete", "complete"), status("complete", "failed"), status("running", "complete"), status()] == ["complete", "failed", "running", "running"]


def test_lines_across_blocks(spark, tmp_path):
    """Files larger than a block, with blank lines and carriage returns; line numbers are those of the whole file."""
    made = {}
    for name in ("a.txt", "b.txt"):
        rows = ["" if i % 7 == 3 else f"{name} {i} " + "x" * (i % 50) for i in range(2000)]
        (tmp_path / name).write_bytes("".join(r + ("\r\n" if i % 2 else "\n") for i, r in enumerate(rows)).encode())
        made |= {(name, i + 1): r for i, r in enumerate(rows) if r}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = files.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {(r["source_file"], r["source_line"]): r["value"] for r in got.collect()} == made
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

"""File sets, stored answers, capped downloads, strict sources and loss weights."""

import hashlib
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from gristmill.functions import arrays
from gristmill.sources import audits, files


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_file_set(spark, tmp_path):
    big = b"x" * (3 << 20)
    shard = b"shard"
    contents = {"a.json": b"{}", "sub/COMPLETE": b" \n", "sub/ok.done": b"1", "sub/big.bin": big, f"{sha(shard)}.jsonl": shard, f"{'0' * 64}.jsonl": b"other", "extra": b""}
    for name, b in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b)
    (tmp_path / "link").symlink_to(tmp_path / "a.json")
    (tmp_path / "folder").symlink_to(tmp_path / "sub")
    found = audits.file_set(spark, str(tmp_path))
    got = {r["name"]: r for r in found.collect()}
    assert got.keys() == contents.keys() | {"link", "folder"} and got["link"]["is_link"] and got["sub/big.bin"]["sha256"] == sha(big) and got["sub/big.bin"]["size"] == len(big)
    listed = [(n, len(b), sha(b)) for n, b in contents.items() if n != "extra"] + [("link", 2, sha(b"{}")), ("folder", 1, "x"), ("gone", 1, "y")]
    listed = [(n, size + (n == "a.json"), "z" if n == "sub/ok.done" else s) for n, size, s in listed]
    problems = {tuple(r) for r in audits.audit_files(found, spark.createDataFrame(listed, "name string, size long, sha256 string"), r"\A[0-9a-f]{64}\.jsonl\z").collect()}
    assert problems == {("extra", "unexpected"), ("gone", "missing"), ("link", "link"), ("folder", "link"), ("a.json", "size"), ("sub/ok.done", "digest"), ("sub/COMPLETE", "empty_marker"), (f"{'0' * 64}.jsonl", "shard_name")}
    (tmp_path / "none").mkdir()
    assert audits.file_set(spark, str(tmp_path / "none")).collect() == []


def test_rescored(spark):
    ok = '{"answer": "A", "explanation": "x"}'
    rows = [(1, ok, "A", "ok", "A", True), (2, ok, "B", "ok", "A", False), (3, ok, "A", "ok", "B", False), (4, "nonsense", "A", "ok", "A", True), (5, None, "A", "ok", "A", True), (6, ok, "A", "error", None, False), (7, ok, "A", "ok", "A", None)]
    df = spark.createDataFrame(rows, "i int, raw string, gold string, status string, answer string, correct boolean")
    got = {(r["i"], r["field"]) for r in audits.rescored(df, ["i"], "raw").collect()}
    assert got == {(3, "answer"), (3, "correct"), (4, "status"), (4, "answer"), (4, "correct"), (5, "no_response"), (6, "operational_error"), (7, "correct")}
    other = df.withColumn("gold", F.when(F.col("i") == 2, "C").otherwise(F.col("gold"))).union(df.where("i = 1"))
    assert sorted(tuple(r) for r in audits.changed_rows(df, other, ["i"]).collect()) == [(1, "rebuilt"), (2, "rebuilt"), (2, "stored")]


class Endless(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        try:
            if self.path == "/short":
                self.wfile.write(b"x" * 1000)
                return
            while True:
                self.wfile.write(b"x" * (1 << 16) if self.path == "/fast" else b"x")
                if self.path == "/slow":
                    threading.Event().wait(0.05)
        except OSError:
            pass

    def log_message(self, *_):
        pass


def test_fetch():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endless)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert audits.fetch_capped(f"{url}/short", 1000, 5) == b"x" * 1000
        with pytest.raises(ValueError, match="larger than 999"):
            audits.fetch_capped(f"{url}/short", 999, 5)
        with pytest.raises(ValueError, match="larger"):
            audits.fetch_capped(f"{url}/fast", 5 << 20, 30)
        with pytest.raises(OSError, match="more than 0.5 seconds"):
            audits.fetch_capped(f"{url}/slow", 5 << 20, 0.5)
    finally:
        server.shutdown()
    with pytest.raises(OSError, match="can't be fetched"):
        audits.fetch_capped(f"{url}/gone", 10, 1)


def test_source_metadata():
    good = {"sha": "a" * 40, "siblings": [{"rfilename": "train.jsonl"}, "odd", {"rfilename": "test.jsonl"}]}
    assert audits.check_source_metadata(json.dumps(good).encode(), "a" * 40, {"train.jsonl"}) == good
    for bad, match in ((b"{", "no JSON"), (b"\xff", "no JSON"), (b"[]", "another"), (json.dumps(good | {"sha": "b"}).encode(), "another"), (json.dumps(good | {"siblings": None}).encode(), "no files"), (json.dumps(good | {"siblings": []}).encode(), "lacks train")):
        with pytest.raises(ValueError, match=match):
            audits.check_source_metadata(bad, "a" * 40, {"train.jsonl"})


def test_strict_questions(spark, tmp_path):
    good = json.dumps({"question": "Qé?", "options": dict(zip("ABCD", "wxyz", strict=True)), "answer_idx": "A", "answer": "w"}, ensure_ascii=False).encode()
    path = tmp_path / "q.jsonl"

    def read(*lines):
        path.write_bytes(b"\n".join(lines))
        return files.strict_questions(spark, str(path), "train")

    assert [r["id"] for r in read(good, b"", good).orderBy("id").collect()] == ["train-00000000", "train-00000002"]
    for lines, match in (
        ([b""], "no questions"), ([good, good.replace("é".encode(), b"\xff"), b"{"], "train:1: not_utf8"), ([b"{", good.replace("é".encode(), b"\xc3")], "train:1: not_utf8"), ([good, b"", good + b" x", b"[]"], "train:2: not_an_object"),
        ([good, good.replace(b'"answer": "w"', b'"answer": "x"')], "train:1: answer_text_mismatch"),
    ):
        with pytest.raises(ValueError, match=match):
            read(*lines)


def test_accumulation_weights(spark):
    sizes = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5]  # supervised tokens after the shift
    rows = [(i, [-100] * 3 + [7] * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "r int, labels array<int>")
    got = {(r["step"], r["micro"]): (r["tokens"], r["weight"]) for r in arrays.accumulation_weights(df, "r", "labels", 5, 2).collect()}
    for step in range(3):
        own = sizes[5 * step : 5 * step + 5]
        want = [sum(own[i : i + 2]) for i in range(0, len(own), 2)]
        assert [got[step, i] for i in range(len(want))] == [(n, pytest.approx(n / sum(own))) for n in want]
    assert len(got) == 3 + 3 + 1
    with pytest.raises(Exception, match="no supervised tokens in step 1"):
        arrays.accumulation_weights(df.withColumn("labels", F.when(F.col("r") >= 5, F.array(F.lit(-100))).otherwise(F.col("labels"))), "r", "labels", 5, 2).collect()

"""Reports and cross-checks on small frames; null-safe dedup, split sizes and Unicode blanks."""

import json

import pytest
from pyspark.sql import functions as F

from gristmill.functions import arrays, text
from gristmill.operators import attempts, relational, reports


def test_dedup_keeps_null_keys_and_sees_null_content(spark):
    rows = [(1, "k", "a"), (2, "k", None), (3, None, "x"), (4, None, "x"), (5, "m", None), (6, "m", None)]
    df = spark.createDataFrame(rows, "id long, key string, content string")
    got = {r["id"]: r["role"] for r in relational.dedup_with_conflicts(df, F.col("key"), F.col("content"), "id").collect()}
    assert got == {1: "conflict", 2: "conflict", 3: "kept", 4: "duplicate", 5: "kept", 6: "duplicate"}


def test_short_split_is_an_error(spark):
    df = spark.range(5).withColumnRenamed("id", "q")
    with pytest.raises(ValueError, match="5 rows"):
        relational.split_by_hash(df, "q", 1, "n", [("dev", 4), ("train", 2)])
    assert relational.split_by_hash(df, "q", 1, "n", [("dev", 4), ("train", 2)], short="keep").where("part = 'train'").count() == 1


def test_blank_is_unicode(spark):
    df = spark.createDataFrame([("\n\t",), (" \x1f",), ("",), (" a ",)], "t string")
    assert [r[0] for r in df.select(text.blank(F.col("t"))).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(text.stripped(F.col("t"))).collect()] == ["", "", "", "a"]


def test_undeclared_budget_is_none(spark):
    rows = spark.createDataFrame([("q", "baseline", 0, "A", "A", "ok", True, "pending", True), ("q", "adaptive", 1, "A", "A", "ok", True, "pending", True)], "question_id string, condition string, attempt int, gold string, answer string, status string, syntactic_valid boolean, clinical_review string, correct boolean")
    good, issues = attempts.validate(rows, spark.createDataFrame([("baseline", 0)], "condition string, budget int"))
    assert [r["condition"] for r in good.collect()] == ["baseline"] and [r["code"] for r in issues.collect()] == ["over_budget"]


def test_differences_and_examples(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 0), ("a", "y", 1), ("b", "x", 1), ("c", "y", 1), ("d", "x", 0), ("d", "y", 0)], "q string, arm string, v int")
    got = {r["q"]: r["difference"] for r in reports.question_differences(rows, "q", "arm", "v", "x", "y").collect()}
    assert got == {"a": 0.5, "d": 0.0}
    assert [r["q"] for r in reports.examples(rows, "q", "arm", {"x": F.col("v") == 0, "y": F.col("v") == 1}).collect()] == ["a"]
    assert [r["q"] for r in reports.longest_first(rows.where("arm = 'y'"), F.col("v"), "q").collect()] == ["a", "c", "d"]


def test_checks(spark):
    plan = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "i int, h string")
    done = spark.createDataFrame([(0, "a"), (2, "x"), (9, "z")], "i int, h string")
    assert {tuple(r) for r in reports.resume_violations(plan, done, "i", "h").collect()} == {(2, "mismatch"), (9, "mismatch"), (1, "gap")}
    assert reports.resume_violations(plan, plan.where("i < 2"), "i", "h").isEmpty()
    assert {tuple(r) for r in reports.cross_check(plan, done, "i", ["h"]).collect()} == {(1, None), (3, None), (2, "h")}
    assert reports.overlap(plan, done, "i").count() == 2 and reports.expected_ids(plan, done, "i").count() == 5
    assert not reports.shards_done(spark.createDataFrame([(0,), (2,), (2,)], "shard int"), 3)
    assert reports.shards_done(spark.createDataFrame([(0,), (2,), (1,), (7,)], "shard int"), 3)
    cases = spark.createDataFrame([("q", [("a", 1), ("b", 2)])], "id string, scored array<struct<variant: string, n: int>>")
    assert {tuple(r) for r in reports.unnested(cases, "scored", ["id"]).collect()} == {("q", "a", 1), ("q", "b", 2)}


def test_tokens_and_pretty_json(spark, tmp_path):
    rows = spark.createDataFrame([("a", "3"), ("a", '"12"'), ("a", None), ("a", "0.5"), ("b", "7.9"), ("b", "true"), ("b", "[1]")], "g string, n string").withColumn("n", F.parse_json("n"))
    assert {tuple(r) for r in reports.token_totals(rows, ["g"], ["n"]).collect()} == {("a", 3.5, 0, 3), ("b", 8.9, 0, 7.9)}
    typed = spark.createDataFrame([("a", 7.9, "12"), ("a", 0.5, "1")], "g string, n double, t string")
    assert tuple(reports.token_totals(typed, ["g"], ["n", "t"]).first()) == ("a", 8.4, 0.5, 7.9, 0, 0, 0)
    reports.write_pretty({"b": 1, "a": [1, 2]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [1, 2], "b": 1} and (tmp_path / "r.json").read_text().startswith('{\n  "a"')


def test_containing(spark):
    texts = spark.createDataFrame([(1, "say the quick brown fox jumps over it"), (2, "thequick brown fox jumps over"), (3, "日本語のテキストです"), (4, "a b"), (5, None), (6, "quick brown fox jumps"), (7, "x" * 60_000)], "i int, t string")
    items = spark.createDataFrame([("p", "he quick brown fox jumps ov"), ("q", "のテ"), ("r", "b"), ("s", ""), ("t", None), ("u", "quick brown fox"), ("v", "xxxxxxx"), ("w", "a b")], "n string, p string")
    got = {tuple(r) for r in relational.containing(texts, items, "i", "t", "n", "p").collect()}
    want = {(i, n) for i, t in map(tuple, texts.collect()) for n, p in map(tuple, items.collect()) if t and p and p in t}
    assert got == want and len(got) > 8
    none = relational.containing(texts, items.limit(0), "i", "t", "n", "p")
    assert none.columns == ["i", "n"] and none.collect() == []


def test_comparison_differences(spark):
    rows = [(q, q == "b", arm, kind, ok) for q, ok0 in (("a", True), ("b", False)) for arm in ("x", "y") for kind, ok in (("clean", ok0), ("k1", arm == "x"), ("k1", ok0), ("k2", False))]
    rows += [("only x", False, "x", "clean", True)]
    df = spark.createDataFrame(rows, "id string, seen boolean, arm string, kind string, correct boolean")
    got = {(r["subset"], r["comparison"], r["id"]): r["difference"] for r in reports.comparison_differences(df, [("x", "y", "clean"), ("x", "y", "k1"), ("y", "x", "perturbed")], "seen").collect()}
    assert got == {
        ("all", "x-minus-y/clean", "a"): 0, ("all", "x-minus-y/clean", "b"): 0, ("all", "x-minus-y/k1", "a"): 0.5, ("all", "x-minus-y/k1", "b"): 0.5, ("all", "y-minus-x/perturbed", "a"): pytest.approx(-1 / 3),
        ("all", "y-minus-x/perturbed", "b"): pytest.approx(-1 / 3), ("previously_unseen", "x-minus-y/clean", "a"): 0, ("previously_unseen", "x-minus-y/k1", "a"): 0.5, ("previously_unseen", "y-minus-x/perturbed", "a"): pytest.approx(-1 / 3),
    }


def test_positions(spark):
    masks = [[], [0, 0], [1], [0, 0, 1, 1], [1, 1, 0, 0], [0, 1, 0, 0, 1, 1, 0], [1] * 3000, [0] * 5 + [1, 0] * 4000]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, m array<int>")
    for i, got in df.select("i", arrays.positions(F.col("m"))).collect():
        n, want = 0, []
        for x in masks[i]:
            n += x
            want.append(max(n - 1, 0))
        assert got == want

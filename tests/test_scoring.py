"""A scorer that is stopped between and within batches ends with each case once."""

import pytest
from pyspark.sql import functions as F

from gristmill.streaming import scoring


def plan(spark, path, first, n):
    """n files of three cases each."""
    df = spark.range(first * 3, (first + n) * 3).select(F.col("id").cast("string").alias("case_id"), F.sha2(F.col("id").cast("string"), 256).alias("input_sha256"))
    df.repartitionByRange(n, "case_id").write.mode("append").parquet(path)


def test_killed_and_resumed(spark, tmp_path):
    cases, out, mark = (str(tmp_path / x) for x in ("cases", "out", "mark"))
    plan(spark, cases, 0, 5)
    ran = []

    def score(rows, fail=None):
        ran.append(rows.count())
        if len(ran) == fail:
            raise RuntimeError("killed")
        return rows.withColumn("answer", F.lit("A"))

    with pytest.raises(Exception, match="killed"):
        scoring.score_stream(spark, cases, out, mark, lambda rows: score(rows, 3))
    assert scoring.scored(spark, out).count() == sum(ran[:2]) < 15
    # the third batch died after some of its rows were written: no completion marker
    name = (tmp_path / "mark" / "name").read_text()
    scoring.scored(spark, out).limit(2).write.parquet(f"{out}/batch={name}-2")
    (tmp_path / "out" / f"batch={name}-2" / "_SUCCESS").unlink()
    done = scoring.score_stream(spark, cases, out, mark, score)
    assert sorted(int(r["case_id"]) for r in done.collect()) == list(range(15))
    before = sum(ran)
    assert scoring.score_stream(spark, cases, out, mark, score).count() == 15 and sum(ran) == before  # nothing left to do
    plan(spark, cases, 5, 2)  # more cases, and the checkpoint is lost: only the new ones are scored
    done = scoring.score_stream(spark, cases, out, str(tmp_path / "mark2"), score)
    assert sorted(int(r["case_id"]) for r in done.collect()) == list(range(21)) and sum(ran) == before + 6


def test_other_content_stops(spark, tmp_path):
    cases, out = str(tmp_path / "cases"), str(tmp_path / "out")
    plan(spark, cases, 0, 1)
    done = spark.createDataFrame([("1", "other")], "case_id string, input_sha256 string")
    done.write.parquet(f"{out}/batch=0")
    with pytest.raises(ValueError, match="finished case 1 has other content"):
        scoring.score_stream(spark, cases, out, str(tmp_path / "mark"), lambda rows: rows)
    planned = spark.read.parquet(cases)
    right = planned.where("case_id = '1'")
    for bad, match in ((right.union(right), "1 is finished twice"), (right.withColumn("case_id", F.lit("9")), "9 isn't planned")):
        with pytest.raises(ValueError, match=match):
            scoring.check_resume(planned, bad, "case_id", "input_sha256")
    scoring.check_resume(planned, right, "case_id", "input_sha256")


def test_no_cases(spark, tmp_path):
    cases = str(tmp_path / "cases")
    spark.createDataFrame([], "case_id string, input_sha256 string").write.parquet(cases)
    got = scoring.score_stream(spark, cases, str(tmp_path / "out"), str(tmp_path / "mark"), lambda rows: rows.withColumn("answer", F.lit("A")))
    assert got.columns == ["case_id", "input_sha256", "answer"] and got.collect() == []

"""Figures and cross-checks of finished runs: review coverage, tokens, per-question means, pools, examples, input checks."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.attempts import token_count


def review_coverage(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Per group of candidates: their number, decisions by kind, and the share that is decided (null without candidates)."""
    kinds = [F.count_if(F.col("clinical_review") == k).alias(k) for k in ("approved", "rejected", "pending")]
    out = candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), *kinds)
    return out.withColumn("coverage", F.try_divide(F.col("approved") + F.col("rejected"), "candidates"))


def token_totals(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group: the sum, least and most of each token column, in doubles; text counts as 0, also where it reads like a number (see attempts.token_count)."""
    counted = rows.select(*by, *(token_count(rows, c).alias(c) for c in columns))
    return counted.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))))


def question_differences(rows: DataFrame, question: str, arm: str, value: str, first: str, second: str) -> DataFrame:
    """(question, difference): mean of the value per question in the second arm less that in the first, for the questions that both have."""
    means = rows.where(F.col(arm).isin(first, second)).groupBy(question).agg(*(F.avg(F.when(F.col(arm) == a, F.col(value).cast("double"))).alias(n) for a, n in ((first, "a"), (second, "b"))))
    return means.where("a is not null and b is not null").select(question, (F.col("b") - F.col("a")).alias("difference"))


def comparison_differences(rows: DataFrame, comparisons: list[tuple[str, str, str]], seen: str) -> DataFrame:
    """(subset, comparison, id, difference): per question the mean correctness of a comparison's left arm less that of its right one, on cases of its kind (`perturbed`: any kind with a note).

    Each row is read once whatever the number of comparisons; a question counts where both arms have such cases.  Subsets: all, and previously_unseen.
    """
    kinds = F.when(F.col("kind") == "clean", F.array(F.lit("clean"))).otherwise(F.array(F.lit("perturbed"), F.col("kind")))
    wanted = sorted({(arm, kind) for left, right, kind in comparisons for arm in (left, right)})
    each = rows.select("id", seen, "arm", F.explode(kinds).alias("kind"), F.col("correct").cast("int").alias("v"))
    means = each.where(F.struct("arm", "kind").isin([F.struct(F.lit(a).alias("arm"), F.lit(k).alias("kind")) for a, k in wanted])).groupBy("id", seen, "arm", "kind").agg(F.avg("v").alias("m"))
    sides = [F.when((F.col("arm") == arm) & (F.col("kind") == kind), F.struct(F.lit(f"{left}-minus-{right}/{kind}").alias("comparison"), F.lit(sign).alias("sign"))) for left, right, kind in comparisons for arm, sign in ((left, 1), (right, -1))]
    both = means.select("id", seen, "m", F.inline(F.array_compact(F.array(*sides)))).groupBy("id", seen, "comparison").agg(F.sum(F.col("sign") * F.col("m")).alias("difference"), F.count(F.lit(1)).alias("n")).where("n = 2")
    subsets = F.when(F.col(seen), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("previously_unseen")))
    return both.select(F.explode(subsets).alias("subset"), "comparison", "id", "difference")


def pool_statistics(pool: DataFrame, style: str, note: str, by: list[str]) -> DataFrame:
    """Per group: entries, distinct styles, distinct notes."""
    return pool.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_distinct(style).alias("styles"), F.count_distinct(note).alias("notes"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order that ends in a unique column."""
    return df.orderBy(*order).limit(n)


def longest_first(df: DataFrame, length: Column, tie: str) -> DataFrame:
    return df.orderBy(length.desc(), tie)


def examples(rows: DataFrame, question: str, arm: str, holds: dict[str, Column], n: int = 3) -> DataFrame:
    """The first n questions, by id, of which every named arm has a row where its condition holds."""
    met = rows.groupBy(question).agg(*(F.max(F.coalesce((F.col(arm) == a) & c, F.lit(False))).alias(f"__{a}") for a, c in holds.items()))
    return first_rows(met.where(" and ".join(f"`__{a}`" for a in holds)).select(question), [question], n)


def flag_members(df: DataFrame, key: str, members: DataFrame, out: str) -> DataFrame:
    """df with a flag: whether the key is among members (a null key never is)."""
    known = members.select(F.col(key).alias("__member")).where("__member is not null").distinct()
    return df.join(known, F.col(key) == F.col("__member"), "left").withColumn(out, F.col("__member").isNotNull()).drop("__member")


def expected_ids(observed: DataFrame, planned: DataFrame, key: str) -> DataFrame:
    """All ids that were observed or planned, once each: the denominators' questions."""
    return observed.select(key).union(planned.select(key)).where(F.col(key).isNotNull()).distinct()


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both hold: must be empty for disjoint sets."""
    return a.select(key).intersect(b.select(key))


def cross_check(items: DataFrame, others: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Violations (key, field) of an input join: items without a partner (field null) and fields that differ, null-safe."""
    right = others.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in same))
    both = items.join(right, F.col(key) == F.col("__key"), "left")
    wrong = F.when(F.col("__key").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in same))))
    return both.select(key, F.explode(wrong).alias("field")).distinct()


def resume_violations(planned: DataFrame, done: DataFrame, index: str, digest: str) -> DataFrame:
    """Indexes of finished rows that the plan lacks or whose hash is another; and the first gap, as finished rows must be a beginning of the plan."""
    both = done.select(index, F.col(digest).alias("__done")).join(planned.select(index, F.col(digest).alias("__plan")), index, "left")
    wrong = both.where(~F.col("__done").eqNullSafe(F.col("__plan"))).select(index, F.lit("mismatch").alias("reason"))
    last = done.agg(F.max(index).alias("__last"))
    gap = planned.join(F.broadcast(last)).where(F.col(index) <= F.col("__last")).join(done.select(index), index, "left_anti").agg(F.min(index).alias(index)).where(F.col(index).isNotNull())
    return wrong.unionByName(gap.select(index, F.lit("gap").alias("reason")))


def unnested(cases: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row for each element of an array of structs, with the kept columns."""
    return cases.select(*keep, F.inline(column))


def shards_done(markers: DataFrame, shards: int) -> bool:
    """Whether every one of the shards 0 .. shards - 1 has a marker: the barrier before a merge."""
    return markers.where(F.col("shard").between(0, shards - 1)).select("shard").distinct().count() == shards


def write_pretty(value: dict | list, path: str) -> None:
    """A small report as indented JSON with sorted keys; the file appears whole or not at all."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(os.path.abspath(path)), delete=False, encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")
    os.replace(f.name, path)

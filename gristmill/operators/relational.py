"""Dedup, quarantine, ranking, splits, reconciliation, sharding, review merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.hashing import digest


def dedup_with_conflicts(df: DataFrame, key: Column, content: Column, order: str) -> DataFrame:
    """df with role: `kept` (first of its key), `duplicate`, or `conflict` where rows of one key differ in content.

    Null is a key like any other, and null content differs from other content.
    Groups are judged by partial aggregates and joined back, so a hot key is never gathered.
    """
    rows = df.withColumn("__key", key).withColumn("__content", content)
    groups = rows.groupBy(F.col("__key").alias("__of")).agg(F.min(order).alias("__first"), F.min("__content").alias("__lo"), F.max("__content").alias("__hi"), F.count_if(F.col("__content").isNull()).alias("__gaps"))
    differ = (F.col("__lo") != F.col("__hi")) | ((F.col("__gaps") > 0) & F.col("__lo").isNotNull())
    role = F.when(differ, "conflict").when(F.col(order) == F.col("__first"), "kept").otherwise("duplicate")
    return rows.join(groups, F.col("__key").eqNullSafe(F.col("__of"))).withColumn("role", role).drop("__key", "__of", "__content", "__first", "__lo", "__hi", "__gaps")


def quarantine(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that don't occur exactly once, with their counts: all their rows are to be excluded."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def ranked(df: DataFrame, order_hash: str, tie: str, out: str = "rank") -> DataFrame:
    """df with the global rank (from 1) by (hash, tie), without sorting everything in one task.

    Rows are ranked inside each four-digit hash prefix; a running sum over the at most 65,536 prefix counts gives the offsets.
    """
    rows = df.withColumn("__p", F.substring(order_hash, 1, 4))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(order_hash, tie))
    return rows.withColumn("__own", own).join(offsets, "__p").withColumn(out, F.col("__before") + F.col("__own")).drop("__p", "__own", "__before")


def leakage_free(train: DataFrame, test: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Train rows whose key isn't in test, and the keys that both hold with different content (an error for the caller)."""
    pairs = train.select(key, F.col(content).alias("left")).join(test.select(key, F.col(content).alias("right")), key)
    return train.join(test.select(key).distinct(), key, "left_anti"), pairs.where("left <> right").select(key).distinct()


def split_by_hash(df: DataFrame, id_col: str, seed: int, namespace: str, sizes: list[tuple[str, int]], short: str = "error") -> DataFrame:
    """Assigns the first ranks by sha256(seed|namespace|id) to the named parts in turn; others get a null part. A part is fixed when a later one grows.

    Fewer rows than the parts ask for are an error (a count of its own), unless `short` is "keep".
    """
    if short == "error" and (n := df.count()) < sum(size for _, size in sizes):
        raise ValueError(f"{n} rows can't fill parts of {sum(size for _, size in sizes)}")
    rows = ranked(df.withColumn("__hash", digest(seed, namespace, F.col(id_col))), "__hash", id_col, "__rank")
    part, start = F.lit(None).cast("string"), 0
    for name, size in sizes:
        part = F.when((F.col("__rank") > start) & (F.col("__rank") <= start + size), name).otherwise(part)
        start += size
    return rows.withColumn("part", part).drop("__hash", "__rank")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Full outer comparison: keys with state `same`, `different`, `left_only` or `right_only`."""
    a, b = (d.select(*keys, F.col(content).alias(n), F.lit(True).alias(f"has_{n}")) for d, n in ((left, "a"), (right, "b")))
    state = F.when(F.col("has_b").isNull(), "left_only").when(F.col("has_a").isNull(), "right_only").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("different")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags: the recompute-and-compare test for reusing an output."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge_review(rows: DataFrame, decisions: DataFrame, keys: list[str], content: str = "content_sha256") -> DataFrame:
    """rows with `clinical_review` from decisions bound to the same content, and `review_issue`.

    Only approved and rejected decisions count.  A decision for other content makes the row pending; one without a
    stored hash is `review_binding_missing`; a valid one that differs from the row's own is a disagreement (warning).
    """
    saved = decisions.where("decision in ('approved', 'rejected')").select(*keys, "decision", F.col(content).alias("bound"), F.lit(True).alias("has"))
    joined = rows.join(saved, keys, "left")
    stale = F.col("bound").isNull() | (F.col("bound") != F.col(content))
    own = F.col("clinical_review")
    review = F.when(F.col("has").isNull(), own).when(stale, "pending").otherwise(F.col("decision"))
    issue = F.when(F.col("has") & F.col("bound").isNull(), "review_binding_missing").when(F.col("has") & stale, "review_content_mismatch").when(F.col("has") & own.isin("approved", "rejected") & (own != F.col("decision")), "review_disagreement")
    return joined.withColumn("review_issue", issue).withColumn("clinical_review", review).drop("decision", "bound", "has")


def shard_of(row_number: Column, shards: int) -> Column:
    """Stride shard of a 1-based row number."""
    return F.pmod(row_number - 1, F.lit(shards))


def coverage(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: expected, rows, distinct keys, missing, unexpected, and whether every key is covered exactly once."""
    both = planned.groupBy(key).agg(F.lit(1).alias("p")).join(done.groupBy(key).agg(F.count(F.lit(1)).alias("d")), key, "full")
    out = both.agg(F.count("p").alias("expected"), F.coalesce(F.sum("d"), F.lit(0)).alias("rows"), F.count("d").alias("keys"), F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("p").isNull()).alias("unexpected"))
    return out.withColumn("exact", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("rows") == F.col("expected")))


def epoch_groups(df: DataFrame, id_col: str, seed: int, epoch: int, batch: int) -> DataFrame:
    """df with the 0-based group of an epoch's hash order; the last group may be smaller."""
    rows = ranked(df.withColumn("__hash", digest(seed + epoch, F.col(id_col))), "__hash", id_col, "__rank")
    return rows.withColumn("epoch_group", F.floor((F.col("__rank") - 1) / batch)).drop("__hash", "__rank")


#: Neighbouring words, or characters of texts with fewer, that two texts meet on.
_PART = {"w": 4, "c": 5}


def containing(texts: DataFrame, passages: DataFrame, id_col: str, text_col: str, item_col: str, passage_col: str) -> DataFrame:
    """Distinct (id, item) of texts that hold a whole passage.

    They meet by equi-joins on part of the passage: its inner words (up to four; the outermost may go on in a text), or the first of its characters (up to five) where it has no inner
    word.  The texts give the parts of those kinds only that a passage has; the exact test follows.  Null texts hold nothing, an empty passage stands in none.
    """
    spark = texts.sparkSession
    cut = lambda c: F.filter(F.split(F.col(c), r"(?U)[^\w]+"), lambda x: x != "")
    letters = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    items = passages.where(F.col(passage_col) != "").select(F.col(item_col).alias("item"), F.col(passage_col).alias("passage")).withColumns({"w": cut("passage"), "c": letters("passage")})
    kind = F.when(F.size("w") >= 3, F.lit("w")).otherwise("c")
    inner = F.slice("w", 2, F.least(F.size("w") - 2, F.lit(_PART["w"])))
    first = F.slice("c", 1, _PART["c"])
    items = items.withColumns({"kind": kind, "key": F.when(kind == "w", inner).otherwise(first)})
    items = items.withColumns({"k": F.size("key"), "key": F.xxhash64("kind", F.array_join("key", " "))})
    there = [(r["kind"], r["k"]) for r in items.select("kind", "k").distinct().collect()]  # nine at most
    if not there:
        return spark.createDataFrame([], texts.select(F.col(id_col)).schema).join(passages.select(item_col).limit(0))
    bare = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = [f"""transform(if(size({kind}) >= {k}, sequence(1, size({kind}) - {k - 1}), array()), i -> xxhash64('{kind}', array_join(slice({kind}, i, {k}), ' ')))""" for kind, k in there]
    cuts = {x: f("text") for x, f in (("w", cut), ("c", letters)) if any(kind == x for kind, _ in there)}
    grams = bare.withColumns(cuts).select("id", F.explode(F.expr(f"array_distinct(concat({', '.join(parts)}))")).alias("key"))
    met = grams.join(items.select("item", "key"), "key").select("id", "item").distinct()
    found = met.join(bare, "id").join(items.select("item", "passage"), "item").where("contains(text, passage)")
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col)).distinct()

"""A training-data pipeline over `documents`: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of
`documents`, but the last, which returns token ids.  Between stages the rows are written as
Parquet and read again, so a lost executor costs a stage at most; the rows of a stage go once
those of the next are written, and a stage drops its intermediate tables as soon as its decisions are.

Decisions are taken by row, not by id: rows may lack an id or share one.  Empty tables give empty
tables; columns beside doc_id, text and n_chars, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontam, jaccard, line_dedup, quality, sentencepiece_codec
from gristmill.llm._spark import Work
from gristmill.llm.queries import PIECES


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.3). Null and empty texts are scored like any other; equal rows fare alike."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    free = "score_" + "_".join(docs.columns)
    return quality.classify(docs, model, score_col=free).where(F.col(free) >= 0.3).select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; n_chars follows the text. A text left empty stays as a row, and so does a null text, as an empty one."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _row_key(docs: DataFrame) -> Column:
    """128 bits of a row's id and text."""
    text = docs["text"]
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.when(text.isNull(), "n").otherwise("t"), F.coalesce(text, F.lit(""))))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates one document, that of the smallest id (rows without an id come last; then by a hash of the row).

    Rows that share an id but not a group are judged apart; of rows that repeat both id and text one stays. Texts without words are in no group.
    """
    with Work(spark, "near_dup_groups") as work:
        rows = jaccard.classes(work, docs.select("doc_id", "text", _row_key(docs).alias("key")), carry=["doc_id", "key"])
        group = F.coalesce(F.col("comp").cast("string"), F.concat(F.lit("-"), "key"))  # without words: its own
        rows = rows.groupBy(group.alias("group"), "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
        best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "rows")).alias("best"))
        keep = Work(spark, "near_dup").table(best.select(F.col("best.key").alias("kept_key"), F.col("best.rows").alias("kept_rows")), "keep")
    out = docs.join(keep, _row_key(docs) == keep["kept_key"], "left_semi")
    return out if keep.where("kept_rows > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more lies inside benchmark passages. The text alone decides, so ids may be null or shared; a text without words stays."""
    key = F.md5(F.coalesce(docs["text"], F.lit("")))
    with Work(spark, "decontamination_index") as work:
        found = decontam.find_matches(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key", work=work)
        n_hit = F.size("hits")
        bad = found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("key").alias("bad_key")).distinct()
        bad = Work(spark, "decontamination").table(bad, "bad")
    return docs.join(bad, key == bad["bad_key"], "left_anti")


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives back its text; null and empty texts have none."""
    out = sentencepiece_codec.round_trip(docs.select("doc_id", "text"), PIECES)
    return out.select("doc_id", "ids", "n_ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("exact"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A trained classifier and a tokenizer are not expressible in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    work = Work(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        if last:
            work.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)

"""File sources and sinks: strict, lenient and torn-tail JSON lines, CSV, checksums, markers, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.canonical import parse_whole
from gristmill.functions.text import blank
from gristmill.sources.held import held


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_line from 1, value, utf8: whether the line's bytes are valid) of text files; blank lines count but are left out.

    Files are read in blocks, so one may be larger than a task: a line's number is its place in its block plus the lines of the blocks before.
    """
    place = [F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block")]
    text = spark.read.option("lineSep", "\n").text(path).select(*place, F.col("_metadata.file_name").alias("source_file"), F.monotonically_increasing_id().alias("__at"), F.is_valid_utf8("value").alias("utf8"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    blocks = text.groupBy("__path", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__path", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = text.where(~blank(F.col("value"))).join(blocks, ["__path", "__block"])
    return numbered.select("source_file", (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int").alias("source_line"), "value", "utf8")


def strict_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Any bad line aborts the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Bad lines are skipped: for files still being written."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with provenance, malformed_jsonl issues with file and line)."""
    rows = lines(spark, path)
    whole = F.coalesce(F.schema_of_variant(parse_whole(F.col("value"))).startswith("OBJECT"), F.lit(False))
    parsed = rows.withColumn("row", F.when(whole, F.from_json("value", schema)))
    good = parsed.where("row is not null").select("row.*", "source_file", "source_line")
    return good, parsed.where("row is null").select(F.lit("error").alias("severity"), F.lit("malformed_jsonl").alias("code"), "source_file", "source_line")


def torn_tail(spark: SparkSession, path: str, schema: str, id_col: str) -> DataFrame:
    """Rows of an append-only log: only an unparsable last line of a file is dropped; an earlier one, or a repeated id, is an error."""
    rows = lines(spark, path)
    last = rows.groupBy("source_file").agg(F.max("source_line").alias("last"))
    whole = F.coalesce(F.schema_of_variant(parse_whole(F.col("value"))).startswith("OBJECT"), F.lit(False))
    rows = rows.join(last, "source_file").withColumn("whole", whole)
    # checked by jobs of their own: inside one plan the optimiser may drop a bad row before it is seen
    if bad := rows.where("not whole and source_line < last").select("source_file", "source_line").head():
        raise ValueError(f"corrupt line {bad['source_line']} of {bad['source_file']}")
    good = rows.where("whole").select(F.from_json("value", schema).alias("r")).select("r.*")
    if twice := good.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").head():
        raise ValueError(f"repeated id {twice[0]}")
    return good


QUESTION = "question string, options struct<A: string, B: string, C: string, D: string>, answer_idx string, answer string"


def raw_questions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Curated questions of a JSONL file with `violation`: null, or the first of the record rules that the line breaks."""
    rows = lines(spark, path).withColumn("v", parse_whole(F.col("value"))).withColumn("row", F.from_json("value", QUESTION))
    keys = F.array_sort(F.json_object_keys(F.get_json_object("value", "$.options")))
    options = F.array(*(F.col(f"row.options.{x}") for x in "ABCD"))
    right = F.element_at(options, F.instr(F.lit("ABCD"), F.col("row.answer_idx")))
    violation = (
        F.when(~F.col("utf8"), "not_utf8")
        .when(F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), "not_an_object")
        .when(blank(F.coalesce("row.question", F.lit(""))), "blank_question")
        .when(~F.coalesce(keys == F.array(*map(F.lit, "ABCD")), F.lit(False)), "options_not_a_to_d")
        .when(F.exists(options, lambda x: blank(F.coalesce(x, F.lit("")))), "blank_option")
        .when(~F.coalesce(F.col("row.answer_idx").isin(*"ABCD"), F.lit(False)), "invalid_answer_label")
        .when(F.col("row.answer").isNotNull() & (F.col("row.answer") != right), "answer_text_mismatch")
    )
    index = F.col("source_line") - 1
    out = rows.select(F.concat(F.lit(f"{split}-"), F.lpad(index.cast("string"), 8, "0")).alias("id"), "row.question", "row.options", "row.answer_idx", F.lit(split).alias("source_split"), index.alias("source_index"), F.sha2("row.question", 256).alias("question_sha256"), violation.alias("violation"))
    return out


def strict_questions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """raw_questions of a source that breaks no rule: bytes that are no UTF-8, else the first violation by place, are an error that names it, and so is a source without questions."""
    rows = held(raw_questions(spark, path, split))
    if rows.isEmpty():
        raise ValueError(f"{split}: no questions")
    bad = rows.where("violation is not null").select((F.col("violation") != "not_utf8").alias("later"), "source_index", "violation")
    if first := bad.orderBy("later", "source_index").head():
        raise ValueError(f"{split}:{first['source_index']}: {first['violation']}")
    return rows.drop("violation")


def review_csv(spark: SparkSession, path: str, required: list[str], place: str | None = None) -> DataFrame:
    """A CSV with header (BOM tolerated) whose required columns exist; all strings. `place` names a column that sorts the lines as they stand, file by file."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.removeprefix("﻿") for c in df.columns]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if place is None:
        return df.toDF(*names)
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))).toDF(*names, place)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def audit(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Files that are missing, unexpected, or differ in size or digest from the declared list."""
    d = declared.select("name", F.col("size").alias("want_size"), F.col("sha256").alias("want"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when((F.col("size") != F.col("want_size")) | (F.col("sha256") != F.col("want")), "changed")
    return found.join(d, "name", "full").withColumn("state", state).where("state is not null").select("name", "state")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with sorted keys; Spark's commit protocol makes the folder appear whole, with its completion marker."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV of the given columns; nested values as JSON text."""
    shown = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) else F.col(c) for c in columns]
    df.select(*shown).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on any store, in the place of an older one: written aside, then renamed."""
    target, fs = _fs(spark, path)
    aside, _ = _fs(spark, path + ".tmp")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(aside, target):
        raise OSError(f"{path} can't be written")


def replace_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """write_csv to a folder aside, which then takes the place of `path`, a folder or a single file."""
    staged = f"{path}.{uuid.uuid4().hex[:12]}"
    write_csv(df, staged, columns)
    swap_directory(df.sparkSession, staged, path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a written folder has its completion marker."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_metadata(*parts: dict) -> dict:
    """Later parts win; in each, a nested `config` is merged first, then the top level."""
    out: dict = {}
    for p in parts:
        out |= p.get("config") or {}
        out |= {k: v for k, v in p.items() if k != "config"}
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def refuse_unknown(spark: SparkSession, path: str, known: set[str]) -> None:
    """An existing output folder may hold only names that this writer makes; links are refused."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return
    found = fs.listStatus(p)
    if strange := sorted(x.getPath().getName() for x in found if x.isSymlink() or x.getPath().getName() not in known):
        raise ValueError(f"not ours, left alone: {', '.join(strange)}")


def swap_directory(spark: SparkSession, staged: str, final: str) -> None:
    """Puts a staged folder in the place of `final`; if that fails, the old one is put back."""
    new, fs = _fs(spark, staged)
    old, _ = _fs(spark, final)
    backup, _ = _fs(spark, final.rstrip("/") + ".backup")
    had = fs.exists(old)
    if had and not fs.rename(old, backup):
        raise OSError(f"{final} can't be moved aside")
    try:
        moved = fs.rename(new, old)
    except Exception:
        moved = False
    if not moved:
        if had:
            fs.rename(backup, old)
        raise OSError(f"{staged} can't be moved to {final}")
    if had:
        fs.delete(backup, True)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table of a small result; nulls are n/a, shares have one decimal as per cent."""
    shown = lambda c, v: "n/a" if v is None else f"{100 * v:.1f}%" if isinstance(v, float) and c.endswith(("rate", "accuracy")) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(shown(c, r.get(c)) for c in columns) + " |" for r in rows)]) + "\n"

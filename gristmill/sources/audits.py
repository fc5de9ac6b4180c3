"""Audits of file sets and of stored records: names, links, sizes, streamed digests; answers scored again; capped downloads."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gristmill.functions.text import answer_of

CHUNK = 1 << 20


class _File(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class _FileSetReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_File]:
        """A partition for each file or link; folders that are links aren't entered."""
        found = []
        for folder, folders, names in os.walk(self.root):
            links = [d for d in folders if os.path.islink(os.path.join(folder, d))]
            found += [_File(p, os.path.relpath(p, self.root)) for p in (os.path.join(folder, n) for n in [*names, *links])]
        return found or [_File("", "")]

    def read(self, part: _File) -> Iterator[tuple]:
        """(name, size, is_link, blank, sha256) of a file, read a piece at a time; of a link nothing is read."""
        if not part.path:
            return
        if os.path.islink(part.path):
            yield part.name, None, True, None, None
            return
        digest, size, blank = hashlib.sha256(), 0, True
        with open(part.path, "rb") as f:
            while piece := f.read(CHUNK):
                digest.update(piece)
                size += len(piece)
                blank = blank and not piece.strip()
        yield part.name, size, False, blank, digest.hexdigest()


class FileSet(DataSource):
    """The files under a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "fileset"

    def schema(self) -> str:
        return "name string, size long, is_link boolean, blank boolean, sha256 string"

    def reader(self, schema) -> _FileSetReader:
        return _FileSetReader(self.options["path"])


def file_set(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, is_link, blank, sha256) of every file under a folder, a task for each; no file is held whole."""
    spark.dataSource.register(FileSet)
    return spark.read.format("fileset").load(path)


def audit_files(found: DataFrame, declared: DataFrame, shards: str = r"\A$") -> DataFrame:
    """(name, problem) of a file set against a list (name, size, sha256): missing, unexpected, link, size, digest, empty_marker (COMPLETE or *.done without content), and shard_name.

    shards: a pattern of names whose stem must be the file's own digest.  A file may have several problems.
    """
    d = declared.select("name", F.col("size").alias("__size"), F.col("sha256").alias("__sha"), F.lit(True).alias("__declared"))
    both = found.withColumn("__there", F.lit(True)).join(d, "name", "full")
    base, own = F.element_at(F.split("name", "/"), -1), F.col("__there") & ~F.col("is_link")
    rules = [
        (F.col("__there").isNull(), "missing"), (F.col("__declared").isNull(), "unexpected"), (F.col("is_link"), "link"), (own & (F.col("size") != F.col("__size")), "size"), (own & (F.col("sha256") != F.col("__sha")), "digest"),
        (own & ((base == "COMPLETE") | base.endswith(".done")) & F.col("blank"), "empty_marker"), (own & base.rlike(shards) & (F.substring_index(base, ".", 1) != F.col("sha256")), "shard_name"),
    ]
    return both.select("name", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in rules)))).alias("problem"))


def rescored(rows: DataFrame, key: list[str], raw: str) -> DataFrame:
    """(key, field, stored, found) of records whose status, answer or correct isn't what their raw response gives when it is scored again. A record without a response, or with an operational error, has that as its field."""
    again = rows.withColumn("__a", answer_of(F.col(raw)))
    correct = (F.col("__a.status") == "ok") & F.col("__a.answer").eqNullSafe(F.col("gold"))
    pairs: list[tuple[str, Column]] = [("status", F.col("__a.status")), ("answer", F.col("__a.answer")), ("correct", correct.cast("string"))]
    differ = [F.when(~F.col(c).cast("string").eqNullSafe(found), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("stored"), found.alias("found"))) for c, found in pairs]
    no = lambda field: F.struct(F.lit(field).alias("field"), F.lit(None).cast("string").alias("stored"), F.lit(None).cast("string").alias("found"))
    bad = F.when(F.col(raw).isNull(), F.array(no("no_response"))).when(F.col("status") == "error", F.array(no("operational_error"))).otherwise(F.array_compact(F.array(*differ)))
    return again.select(*key, F.inline(bad))


def changed_rows(stored: DataFrame, rebuilt: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): rows that one of two tables of the same columns has more often than the other: `stored` or `rebuilt`."""
    rebuilt = rebuilt.select(stored.columns)
    return stored.exceptAll(rebuilt).select(*key, F.lit("stored").alias("side")).union(rebuilt.exceptAll(stored).select(*key, F.lit("rebuilt").alias("side")))


def fetch_capped(url: str, most: int = 64 << 20, seconds: float = 30.0) -> bytes:
    """The body of a URL. A body beyond `most` bytes is an error as soon as that many and one more have come; so is one that isn't whole after `seconds`."""
    request = urllib.request.Request(url, headers={"User-Agent": "gristmill/1"})
    end, parts, size = time.monotonic() + seconds, [], 0
    try:
        with urllib.request.urlopen(request, timeout=seconds) as body:
            while piece := body.read1(min(CHUNK, most + 1 - size)):
                parts.append(piece)
                size += len(piece)
                if size > most:
                    raise ValueError(f"{url} is larger than {most} bytes")
                if time.monotonic() > end:
                    raise TimeoutError(f"{url} took more than {seconds} seconds")
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise OSError(f"{url} can't be fetched: {e}") from e
    return b"".join(parts)


def check_source_metadata(payload: bytes, revision: str, needed: set[str]) -> dict:
    """The metadata of a source: an object whose sha is the pinned revision and whose files hold all that are needed."""
    try:
        found = json.loads(payload)
    except ValueError as e:
        raise ValueError("the source's metadata is no JSON") from e
    if not isinstance(found, dict) or found.get("sha") != revision:
        raise ValueError("the source's revision is another than the pinned one")
    if not isinstance(found.get("siblings"), list):
        raise ValueError("the source lists no files")
    if lost := needed - {x.get("rfilename") for x in found["siblings"] if isinstance(x, dict)}:
        raise ValueError(f"the source lacks {', '.join(sorted(lost))}")
    return found

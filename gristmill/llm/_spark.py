"""Session helpers shared by the operators: work folders, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._text import U64, mix64

#: Bytes of one Arrow batch; with it a Python worker's memory is bounded whatever the texts' lengths.
BATCH_BYTES = 4 << 20
_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as rows, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(f):
    """Wraps a batch function: when its task ends, the worker gives free memory back, as Python workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset on a local master a temporary one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="gristmill-"))


class Work:
    """A folder of one call's intermediate tables in the shared folder. The tables cut lineage and outlive executors; they go by `drop`, else when the driver's Python ends.

    As a context it drops its tables at the end: for callers that have written what they need of them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        batches(spark)
        _made.append((spark, self.path))

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Writes df and returns it reread."""
        path = f"{self.path}/{name}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the named tables that are there, or all of them."""
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Least and most bits of a Bloom filter, as powers of two; most is 64 MB.
BLOOM_BITS = (16, 29)


def _places(keys: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys.view(U64))
    return (h & U64(mask)).astype(np.int64), (h >> U64(32) & U64(mask)).astype(np.int64)


def bloom(spark: SparkSession, keys: DataFrame):
    """A broadcast Bloom filter of the 64-bit keys of a written table's only column, 8 bits for each up to the most; fuller ones let more through."""
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], (8 * max(keys.count(), 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = np.concatenate(_places(b.column(0).to_numpy(), (1 << bits) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(pos >> 3), pa.array((1 << (pos & 7)).astype(np.int32))], names=["at", "bit"])

    got = keys.mapInArrow(run, "at long, bit int").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row for each byte at most, and two for each key
    held = np.zeros(1 << (bits - 3), np.uint8)
    held[got.column("at").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return spark.sparkContext.broadcast(held)


def in_bloom(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for p in _places(keys, len(held) * 8 - 1):
        out &= (held[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


#: Edges (16 bytes each) that one task solves by itself.
LOCAL_EDGES = 1 << 18


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "p"])


def components(work: Work, edges: DataFrame, name: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, comp) of every node of the edges (a, b), comp being one node of its connected component.

    Rounds of contraction: each node points to its smallest neighbour or itself, edges are
    rewritten to the pointed-to nodes, and the maps are composed at the end.  With nodes in
    random order (they are hashes here) a round shrinks every component by a constant factor.
    Once at most `local_edges` edges are left, one task finishes them.
    """
    e = work.table(edges.select("a", "b").where("a <> b").distinct(), f"{name}-e0")
    maps: list[DataFrame] = []
    while n := e.count():
        k = len(maps)
        if n <= local_edges:
            maps.append(work.table(e.select("a", "b").repartition(1).mapInArrow(_union_find, "a long, p long"), f"{name}-p{k}"))
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = work.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), f"{name}-p{k}")
        maps.append(to)
        other = to.select(F.col("a").alias("b"), F.col("p").alias("q"))
        e = work.table(e.join(to, "a").join(other, "b").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"{name}-e{k + 1}")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    label = maps[0].select(F.col("a").alias("node"), F.col("p").alias("comp"))
    if len(maps) == 1:
        return label
    for to in maps[1:]:
        label = label.join(to.select(F.col("a").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp"))
    return work.table(label, f"{name}-label")

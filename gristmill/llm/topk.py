"""Exact top-k search by tiled matrix products (operator 8).

Queries come in groups of a bounded number of bytes, each broadcast; candidates are read as
they lie, an Arrow batch being a shard.  Every tile, a block of queries with one shard, is one
matrix product; partial selection keeps what can still be among a query's best k, a task merges
its tiles' lists, and the tasks' lists are merged as a tree, `FAN` of them first.  Only the lists are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._spark import Work, batches, tidy

BLOCK_ROWS, FAN = 256, 64
#: Bytes of queries (8 for each component) that are broadcast at once.
GROUP_BYTES = 16 << 20
LONG = (-(2**63), 2**63 - 1)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum fits 53 bits, else in whole numbers, and then held within 64 bits."""
    most = lambda m: np.abs(m).max(axis=1, initial=0)
    far = most(c) * most(q).max(initial=0) * q.shape[1] >= 2**53
    if not far.any():
        return (q @ c.T).astype(np.int64)
    out = np.zeros((len(q), len(c)), np.int64)
    out[:, ~far] = (q @ c[~far].T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (q, c[far])]
    out[:, far] = np.array([[min(max(sum(a * b for a, b in zip(x, y, strict=True)), LONG[0]), LONG[1]) for y in whole[1]] for x in whole[0]], np.int64)
    return out


def matrices(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, floor(scale * x)) of the rows of each length; rows with a component that is not finite then are left out."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin, number = np.cumsum(size) - size, ids.to_numpy()
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        with np.errstate(over="ignore"):
            m = np.floor(flat[begin[rows][:, None] + np.arange(dim)] * scale)
        sound = np.isfinite(m).all(axis=1)
        yield dim, number[rows][sound], m[sound]


def _best(row: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, ties to the smaller number."""
    order = np.lexsort((number, -score.astype(np.float64), row)) if not len(score) or np.abs(score).max() < 2**53 else np.array(sorted(range(len(row)), key=lambda i: (row[i], -int(score[i]), number[i])))
    row, score, number = row[order], score[order], number[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], number[keep]


def _tiles(queries, k: int, scale: float):
    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked = TaskContext.get().partitionId(), queries.value
        lists = {(dim, at): (np.zeros(0, np.int64),) * 3 for dim, (qid, _) in asked.items() for at in range(0, len(qid), BLOCK_ROWS)}
        for b in parts:
            for dim, cid, c in matrices(b.column(0), b.column(1), scale):
                if dim not in asked or not len(cid):
                    continue
                for at in range(0, len(asked[dim][0]), BLOCK_ROWS):
                    qid, q = (x[at : at + BLOCK_ROWS] for x in asked[dim])
                    s = product(q, c)
                    row, score, number = lists[dim, at]
                    full = np.bincount(row, minlength=len(qid)) >= k
                    worst = np.full(len(qid), LONG[0], np.int64)
                    ends = np.searchsorted(row, np.arange(len(qid)), "right") - 1
                    worst[full] = score[ends[full]]
                    last = len(cid) - min(len(cid), k + int(np.isin(cid, qid).sum()))
                    worst = np.maximum(worst, np.partition(s, last, axis=1)[:, last])
                    r, x = np.nonzero(s >= worst[:, None])
                    other = qid[r] != cid[x]
                    r, x = r[other], x[other]
                    lists[dim, at] = _best(np.concatenate([row, r]), np.concatenate([score, s[r, x]]), np.concatenate([number, cid[x]]), k)
        for (dim, at), (row, score, number) in lists.items():
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][at + row]), pa.array(np.full(len(row), part, np.int32)), pa.array(number), pa.array(score)], names=["query_id", "part", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x), ties to the smaller id.

    Candidates are all rows but those with the query's own id; all of them, if fewer than k; rows that repeat an id are candidates
    of their own, also where their vectors are equal.  Queries that repeat both id and vector count once; vectors of one query id
    share a list.  Rows whose id or vector is null, or whose vector holds a null or a component that is not finite (before or after
    the scaling), take no part, nor do empty vectors; vectors of another length than the query's aren't its candidates.  Inner products are
    exact; one beyond 64 bits counts as the nearest 64-bit number.  Empty tables give empty results; other columns are not read.

    The queries go in groups of about `group_bytes`, one at a time: driver and executors hold one group, whatever their number; the candidates are read once a group.
    """
    spark = vectors.sparkSession
    batches(spark)
    sound = "id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"

    def whole(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("vector is not null").where(sound)

    asked = whole(queries).distinct()
    groups = max(1, -(-8 * (asked.agg(F.sum(F.size("vector"))).first()[0] or 0) // group_bytes))
    lists, work = None, Work(spark, "top_k")
    for g in range(groups):
        got = asked.where(F.pmod(F.xxhash64("id", "vector"), F.lit(groups)) == g).toArrow().combine_chunks()  # about group_bytes
        held = {dim: tuple(x[np.argsort(np.abs(m).max(axis=1), kind="stable")] for x in (ids, m)) for b in got.to_batches() for dim, ids, m in matrices(b.column(0), b.column(1), scale)}
        sent = spark.sparkContext.broadcast(held)
        one = whole(vectors).mapInArrow(_tiles(sent, k, scale), "query_id long, part int, vec_id long, score long")
        if groups > 1:  # one group at a time: its lists are written, then its queries are let go
            one = work.table(one, f"lists{g}")
            sent.destroy()
        lists = one if lists is None else lists.unionByName(one)
    best = [F.desc("score"), F.asc("vec_id")]
    lists = lists.withColumn("part", F.expr(f"part div {FAN}").cast("int"))
    lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

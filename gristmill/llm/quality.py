"""Quality classifier by nearest-neighbour voting in a latent-semantic space (operator 2).

Whole texts become hashed term counts (byte trigrams, word-end shapes, word repetition),
weighted by log tf and by idf over all documents, and are projected on the leading singular
directions of a bounded sample of labelled rows (`n_fit`).  The labelled vectors are broadcast
(n_fit x rank floats); every document's cosines with all of them are computed exactly, block
by block, and its `k` nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._spark import batches, tidy
from gristmill.llm._text import LOWER, NOT_SPACE, U64, chunks, hash_spans, mix64, spans

DIMS = 4096
_GRAMS, _SHAPES = 3072, 960  # of DIMS: byte trigrams, word shapes; the rest counts repetition


def _classes() -> np.ndarray:
    """Byte classes of word shapes: letters and digits by kind, every other ASCII byte itself."""
    t = np.arange(256, dtype=np.uint8)
    t[48:58], t[65:91], t[97:123], t[128:] = 48, 65, 97, 97
    return t


CLASS = _classes()


def counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts[rows, DIMS]) over whole texts."""
    for a, b, data, offs in chunks(column, rows=512):
        rows, out = b - a, np.zeros((b - a) * DIMS, np.int64)
        if len(data) > 2:
            low = LOWER[data].astype(np.uint32)
            g = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)
            doc = np.repeat(np.arange(rows), np.diff(offs))
            inside = doc[:-2] == doc[2:]
            out += np.bincount(doc[:-2][inside] * DIMS + (g % np.uint32(_GRAMS)).astype(np.int64)[inside], minlength=len(out))
        s, e, first = spans(data, offs, NOT_SPACE)
        if len(s):
            kind = CLASS[data].astype(np.uint64)
            doc = np.repeat(np.arange(rows), np.diff(first))
            last = [np.where(e - i >= s, kind[np.maximum(e - i, 0)], U64(0)) for i in (1, 2, 3)]
            shape = mix64(kind[s] | last[0] << U64(8) | last[1] << U64(16) | last[2] << U64(24)) % U64(_SHAPES)
            out += np.bincount(doc * DIMS + _GRAMS + shape.astype(np.int64), minlength=len(out))
            h = hash_spans(LOWER[data], s, e)
            for step, at in ((1, 0), (2, 1), (3, 2)):
                if len(h) > step:
                    again = np.flatnonzero((h[step:] == h[:-step]) & (doc[step:] == doc[:-step]))
                    out += np.bincount(doc[again] * DIMS + _GRAMS + _SHAPES + at, minlength=len(out))
            n = np.diff(first)
            distinct = np.bincount(np.unique(doc.astype(np.uint64) << U64(48) | h >> U64(16)).astype(np.uint64) >> U64(48), minlength=rows) if len(h) else np.zeros(rows)
            share = np.minimum(8 * distinct / np.maximum(n, 1), 7.999).astype(np.int64)
            long = np.minimum(np.log2(n + 1), 15).astype(np.int64)
            has = np.flatnonzero(n > 0)
            out += np.bincount(has * DIMS + _GRAMS + _SHAPES + 4 + share[has], minlength=len(out))
            out += np.bincount(has * DIMS + _GRAMS + _SHAPES + 16 + long[has], minlength=len(out))
        yield a, b, out.reshape(rows, DIMS)


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """log tf x idf in each of the three groups of terms, groups of unit length."""
    x = np.log1p(c).astype(np.float32) * idf
    for a, b in ((0, _GRAMS), (_GRAMS, _GRAMS + _SHAPES), (_GRAMS + _SHAPES, DIMS)):
        x[:, a:b] /= np.maximum(np.linalg.norm(x[:, a:b], axis=1, keepdims=True), 1e-9)
    return x


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for b in batches:
        for _, _, c in counts(b.column(0)):
            df += (c > 0).sum(axis=0)
            n += len(c)
    yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-zero counts of the sampled rows: term and count pairs."""
    for b in batches:
        for a, z, c in counts(b.column(3)):
            packed = [np.stack([t := np.flatnonzero(x), np.minimum(x[t], 0x7FFFFFFF)]).astype(np.int32).tobytes() for x in c]
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, z - a) for i in range(3)), pa.array(packed, pa.binary())], names=["id", "hash", "label", "terms"])


class Model:
    """Idf, projection, and the labelled vectors with their labels; none if there was no labelled row."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[int, bytes]], rank: int):
        self.idf, self.label = idf, np.array([y for y, _ in rows], np.float32)
        if rows:
            c = np.zeros((len(rows), DIMS), np.float32)
            for i, (_, b) in enumerate(rows):
                t, n = np.frombuffer(b, np.int32).reshape(2, -1)
                c[i, t] = n
            x = _weighted(c, idf)
            self.mean = x.mean(axis=0)
            x -= self.mean
            rank = min(rank, *x.shape)
            q = np.random.default_rng(20).standard_normal((DIMS, rank + 8)).astype(np.float32)
            for _ in range(4):
                q, _ = np.linalg.qr(x.T @ (x @ q))
            _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
            self.axes = np.ascontiguousarray((q @ vt.T)[:, :rank]).astype(np.float32)
            self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, c: np.ndarray, k: int) -> np.ndarray:
        if not len(self.label):
            return np.full(len(c), 0.5)
        v = self._unit((_weighted(c, self.idf) - self.mean) @ self.axes)
        sim = v @ self.vectors.T
        k = min(k, sim.shape[1])
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(sim, near, axis=1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((sim >= last).sum(axis=1) > k)  # of vectors equally near the k-th place the first vote
        near[tied] = np.argsort(-sim[tied], axis=1, kind="stable")[:, :k]
        w = np.maximum(np.take_along_axis(sim, near, axis=1), 1e-6).astype(np.float64) ** 4
        return (w * self.label[near]).sum(axis=1) / w.sum(axis=1)


def _score(model, k: int, at: int, names: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            score = [m.score(c, k) for _, _, c in counts(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(score) if score else [], pa.float64())], names=names)

    return run


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", mod: int = 5, n_fit: int = 4096, rank: int = 64) -> Model:
    """A model of at most `n_fit` labelled rows of docs whose crc32 remainder isn't 0, those of the smallest hashes of id and text; idf comes from all documents.

    Ids are whole numbers.  Null labels and ids count as unlabelled; labels of ids that docs lacks are not used; of several labels of one id the largest holds;
    of several rows of one id each is a row, and rows that repeat both id and text are one.  Other columns are not read.
    """
    batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    sums = dict(texts.mapInArrow(_document_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    n = sums.get(-1, 0)
    idf = np.array([np.log((n + 1) / (sums.get(t, 0) + 1)) + 0.1 for t in range(DIMS)], np.float32)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null").where(remainder("id", mod) != 0)
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    drawn = rows.select("id", F.xxhash64("id", "text").alias("hash")).distinct().join(labelled, "id").orderBy("hash", "id").limit(n_fit)  # n_fit rows of 24 bytes
    drawn = docs.sparkSession.createDataFrame([tuple(r) for r in drawn.collect()], "id long, hash long, label int")
    sample = rows.withColumn("hash", F.xxhash64("id", "text")).join(F.broadcast(drawn), ["id", "hash"]).select("id", "hash", "label", "text").dropDuplicates(["id", "hash"])
    got = {(r["id"], r["hash"]): (r["label"], bytes(r["terms"])) for r in sample.mapInArrow(_sparse, "id long, hash long, label int, terms binary").collect()}  # n_fit rows
    return Model(idf, [got[k] for k in sorted(got)], rank)


def classify(docs: DataFrame, model: Model, *, text_col: str = "text", k: int = 15, score_col: str = "score") -> DataFrame:
    """docs with `score_col` (0 to 1, higher: label 1 likelier).

    Null and empty texts are scored like any text, very long ones as a whole.  Without labelled rows every score is 0.5.  Repeated
    rows score alike; of labelled vectors equally near the k-th place those of the smaller sample keys (id, then hash) vote.  Other columns pass through, whatever their
    names, but one called `score_col` is replaced.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    batches(spark)
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(model), k, docs.columns.index(text_col), schema.names), schema)

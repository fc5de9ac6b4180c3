"""Training-order materialisation of token sequences (operator 1).

Documents' token ids, each followed by an end id, are cut into sequences of `seq_len` ids (the
last one padded) and numbered in the order of a hash of their rows, so numbers do not depend on
how the table is dealt to tasks.  A keyed Feistel permutation with cycle-walking sends the running number of
every sequence to a global slot, so the training order is a fixed pseudo-random permutation
that needs no sort key, no sampling and no shuffle buffer.  Slots are dealt in ranges: each task
writes whole shards of `shard_slots` fixed-stride records, so slot s is record s % shard_slots
of shard s // shard_slots, and a reader can resume at any slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._spark import Work, tidy
from gristmill.llm._text import U64, mix64
from gristmill.llm.sentencepiece_codec import binary, model_of, shipped

ROUNDS = 6
#: Of the hash that numbers the rows, the leading bits whose ranges get their offsets from the driver.
BUCKET_BITS = 16


class Feistel:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked until it falls inside."""

    def __init__(self, size: int, key: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = U64((1 << self.half) - 1)
        self.keys = mix64(np.arange(1, ROUNDS + 1, dtype=U64) + U64(key % (1 << 63)) * U64(2))

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        return mix64(x ^ k) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U64(self.half), x & self.mask
        if back:
            for k in self.keys[::-1]:
                left, right = right ^ self._round(left, k), left
        else:
            for k in self.keys:
                left, right = right, left ^ self._round(right, k)
        return left << U64(self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(U64), back)
        while len(far := np.flatnonzero(out >= U64(self.size))):
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def numbers(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _tokens(model, end: int, seq_len: int):
    """Rows (bucket, first, n_seq, doc, ids) of rows sorted by bucket: sequences are numbered through each bucket."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, last, at = model_of(model.value), -1, 0
        for b in batches:
            if not len(b):
                continue
            bucket = b.column(0).to_numpy()
            ids, count = m.encode_all(b.column(2).to_pylist())
            some = count > 0
            ids, count = np.insert(ids, np.cumsum(count)[some], end), count + some
            n = -(-count // seq_len)
            if bucket[0] != last:
                at = 0
            head = np.append(True, bucket[1:] != bucket[:-1])
            upto = np.cumsum(n) - n
            first = upto - upto[head][np.cumsum(head) - 1] + np.where(np.cumsum(head) == 1, at, 0)
            last, at = bucket[-1], int(first[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first), pa.array(n), b.column(1), binary(ids, count)], names=["bucket", "first", "n_seq", "doc", "ids"])

    return run


def _records(stride: int, offsets, order: Feistel):
    """Rows (slot, doc, seq, ids) of sequences, ids deflated: they go through a shuffle."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = offsets.value
        for b in batches:
            bucket, first, n = (b.column(i).to_numpy() for i in range(3))
            seq = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            number = np.repeat(start[bucket] + first, n) + seq
            cut = [deflated(x[i : i + stride]) for x in b.column(4).to_pylist() for i in range(0, len(x), stride)]
            yield pa.RecordBatch.from_arrays([pa.array(order.slots(number)), b.column(3).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(seq.astype(np.int32)), pa.array(cut, pa.binary())], names=["slot", "doc", "seq", "ids"])

    return run


def deflated(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return c.compress(raw) + c.flush()


def _shards(shard_slots: int, stride: int, width: int, pad: bytes):
    """Joins the sorted records of each shard into one payload."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        slot, doc, seq, ids = zip(*rows, strict=True)
        ids = [zlib.decompress(x, -15) for x in ids]
        n = [len(x) // width for x in ids]
        payload = b"".join([x + pad * (stride // width - k) for x, k in zip(ids, n, strict=True)])
        one = lambda x, t: pa.array([list(x)], pa.list_(t))
        return pa.RecordBatch.from_arrays([pa.array([slot[0] // shard_slots], pa.int64()), pa.array([slot[0]], pa.int64()), pa.array([len(rows)], pa.int32()), one(doc, pa.int64()), one(seq, pa.int32()), one(n, pa.int32()), pa.array([payload], pa.binary())], names=["shard", "first_slot", "n_slots", "docs", "seqs", "n_tokens", "payload"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and row[0] // shard_slots != rows[0][0] // shard_slots:
                    yield made(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield made(rows)

    return run


def materialise(docs: DataFrame, model_path: str, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", key: int = 20, seq_len: int = 512, shard_slots: int = 512, end: int = 2, pad: int = 0) -> DataFrame:
    """Writes the shards as Parquet to `path` (default: the shared folder) and returns them reread.

    Shards: (shard, first_slot, n_slots, docs, seqs, n_tokens, payload); payload holds n_slots
    records of seq_len little-endian ids, in slot order.  The order follows from the rows and the key alone: rows are
    numbered by a hash of id and text (ties by id, then text), however the table is split into files and tasks.
    Null and empty texts have no sequence; rows
    that repeat an id or text are sequences of their own; null ids stay null; a very long text is as many sequences as it
    needs.  An empty table gives no shards; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    work = Work(spark, "token_output")
    model = shipped(spark, model_path)
    width = model_of(model_path).dtype.itemsize
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("text <> ''").withColumn("hash", F.xxhash64("doc", "text"))
    rows = rows.withColumn("bucket", F.expr(f"cast(shiftrightunsigned(hash, {64 - BUCKET_BITS}) as int)"))
    dealt = rows.repartitionById(tasks, F.expr(f"cast(bucket * {tasks}L div {1 << BUCKET_BITS} as int)")).sortWithinPartitions("bucket", "hash", "doc", "text").select("bucket", "doc", "text")
    tokens = work.table(dealt.mapInArrow(_tokens(model, end, seq_len), "bucket int, first long, n_seq long, doc long, ids binary"), "tokens", "zstd")
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for bucket, n in tokens.groupBy("bucket").agg(F.sum("n_seq")).collect():  # 2**BUCKET_BITS rows at most
        counts[bucket] = n
    total = int(counts.sum())
    order = Feistel(total, key)
    given = spark.sparkContext.broadcast(np.cumsum(counts) - counts)
    records = tokens.mapInArrow(_records(seq_len * width, given, order), "slot long, doc long, seq int, ids binary")
    shards = max(1, -(-total // shard_slots))
    tasks = max(1, min(shards, max(tasks, total * seq_len * width >> 27)))
    each = -(-shards // tasks)
    dealt = records.repartitionById(tasks, F.expr(f"cast(slot div {shard_slots * each} as int)")).sortWithinPartitions("slot")
    out = dealt.mapInArrow(_shards(shard_slots, seq_len * width, width, pad.to_bytes(width, "little")), "shard long, first_slot long, n_slots int, docs array<long>, seqs array<int>, n_tokens array<int>, payload binary")
    if path is None:
        return work.table(out, "shards", "zstd")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def sequences(shards: DataFrame) -> DataFrame:
    """(slot, shard, doc, seq, n_tokens, record) of the shards' records."""
    stride = F.expr("cast(length(payload) / n_slots as int)")
    each = shards.select("shard", "first_slot", "payload", stride.alias("stride"), F.posexplode(F.arrays_zip("docs", "seqs", "n_tokens")).alias("at", "x"))
    return each.select((F.col("first_slot") + F.col("at")).alias("slot"), "shard", F.col("x.docs").alias("doc"), F.col("x.seqs").alias("seq"), F.col("x.n_tokens").alias("n_tokens"), F.expr("substring(payload, at * stride + 1, stride)").alias("record"))


def read_slots(spark: SparkSession, path: str, start: int, count: int, *, shard_slots: int = 512) -> DataFrame:
    """The records of slots start .. start + count - 1, in order. The filter on `shard` is pushed to the files' statistics: files hold slot ranges, so only those of the asked shards are read."""
    shards = spark.read.parquet(path).where(F.col("shard").between(start // shard_slots, (start + count - 1) // shard_slots))
    return sequences(shards).where(f"slot >= {start} and slot < {start + count}").orderBy("slot")

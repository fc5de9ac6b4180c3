"""Importance resampling towards a target distribution (operator 13).

Word n-grams of the documents and of the target are counted in hashed buckets: a task sums its
texts in one array and sends that.  The buckets' log ratios, one small array, weight each
document; a Gumbel term drawn from the id makes the highest scores a sample without replacement.

The k-th key of (score descending, id, row) is found by radix selection: a round counts the next
16 bits of the keys that share the bits fixed so far, so the driver sees at most 65,536 counts
a round.  Rows up to that key, and no others, are range-partitioned, sorted and numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._spark import Work, batches, tidy
from gristmill.llm._text import ALNUM, LOWER, chunks, spans

#: Bits of a round's digit: at most 2**16 counts reach the driver.
DIGIT = 16
#: Spans up to so many bytes are hashed side by side, longer ones one by one.
SHORT = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span."""
    n = e - s
    order = np.argsort(-n, kind="stable")
    long = int(np.count_nonzero(n > SHORT))
    s_, n_ = s[order], n[order]
    c = np.full(len(s), 0xFFFFFFFF, np.uint32)
    for i in range(long):
        c[i] = zlib.crc32(data[s_[i] : s_[i] + n_[i]]) ^ 0xFFFFFFFF
    left = len(s) - np.searchsorted(n_[::-1], np.arange(1, SHORT + 1))  # spans of more than k bytes
    for k, m in enumerate(left):
        if m <= long:
            break
        now = c[long:m]
        c[long:m] = _CRC[(now ^ data[s_[long:m] + k]) & 255] ^ now >> 8
    out = np.empty(len(s), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def features(column: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of all n-grams, the document of each, words of each document) by chunk."""
    for lo, hi, data, offs in chunks(column):
        data = LOWER[data]
        s, e, first = spans(data, offs, ALNUM)
        words = np.diff(first)
        of = np.repeat(np.arange(hi - lo), words)
        if ngrams > 1 and len(s):  # the words, each followed by one space
            n = e - s + 1
            end = np.cumsum(n)
            at = np.arange(end[-1]) - np.repeat(end - n, n)
            joined = np.full(end[-1], 0x20, np.uint8)
            joined[at < np.repeat(n - 1, n)] = data[(np.repeat(s, n) + at)[at < np.repeat(n - 1, n)]]
            data, s, e = joined, end - n, end - 1
        found, whose = [], []
        for k in range(ngrams):
            whole = np.flatnonzero(of[k:] == of[: len(of) - k]) if k < len(of) else np.zeros(0, np.int64)
            found.append(crc32(data, s[whole], e[whole + k]).astype(np.int64) % buckets)
            whose.append(of[whole])
        yield lo, hi, np.concatenate(found), np.concatenate(whose), words


def _count(ngrams: int, buckets: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, found, _, _ in features(b.column(0), ngrams, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """How many n-grams of a one-column table fall into each bucket; a row for each bucket reaches the driver."""
    got = texts.mapInArrow(_count(ngrams, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed shares' ratio, target to source, by bucket."""
    n, of_s, of_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (of_s + n)) / ((s + 1) * (of_t + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(at: int, ngrams: int, gain, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gain.value
        for b in batches:
            rest = [c for i, c in enumerate(b.columns) if i != at]
            for lo, hi, found, whose, words in features(b.column(at), ngrams, len(g)):
                weight = np.zeros(hi - lo, np.int64)
                np.add.at(weight, whose, g[found])
                cols = [*(c.slice(lo, hi - lo) for c in rest), pa.array(words, pa.int64()), pa.array(np.bincount(whose, minlength=hi - lo)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the SHA-256 of `seed:id`; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0)))


class _Word:
    """One 64-bit word of a composite key, as an unsigned number in ascending order of the key."""

    def __init__(self, name: str, descending: bool = False):
        self.name, self.descending = name, descending

    def plain(self, value: int) -> int:
        return ((~value if self.descending else value) & (1 << 64) - 1) ^ 1 << 63

    def above(self, bits: int) -> Column:
        """The word without its lowest bits."""
        c = F.bitwise_not(F.col(self.name)) if self.descending else F.col(self.name)
        return F.shiftrightunsigned(c.bitwiseXOR(F.lit(-(1 << 63))), bits) if bits < 64 else F.lit(0).cast("long")


def select_key(rows: DataFrame, words: list[tuple[str, bool]], k: int) -> tuple[int, ...] | None:
    """The k-th smallest of the distinct keys of a written table: words of (long column, descending). Null if there are fewer than k."""
    left, key = rows, []
    for i, w in enumerate(_Word(*x) for x in words):
        low, high = left.agg(F.min(w.name), F.max(w.name)).first()
        if low is None:
            return None
        bits = (w.plain(low) ^ w.plain(high)).bit_length()  # the bits above are common to all
        while bits:
            step = min(DIGIT, bits)
            bits -= step
            counts = left.groupBy(w.above(bits).bitwiseAND(F.lit((1 << step) - 1)).alias("digit")).agg(F.count(F.lit(1)).alias("n"))
            for digit, n in sorted(counts.collect()):  # 2**DIGIT rows at most
                if k <= n:
                    break
                k -= n
            else:
                return None
            left = left.where(w.above(bits).bitwiseAND(F.lit((1 << step) - 1)) == digit)
            if n == 1:
                return (*key, *left.select(*(name for name, _ in words[i:])).first())
        key.append(left.agg(F.min(w.name)).first()[0])
    return tuple(key) if k == 1 else None


def up_to(words: list[tuple[str, bool]], key: tuple[int, ...]) -> Column:
    """Whether a row's key is at most the given one."""
    (name, descending), c = words[-1], F.col(words[-1][0])
    holds = c >= key[-1] if descending else c <= key[-1]
    for (name, descending), v in reversed(list(zip(words[:-1], key[:-1], strict=True))):
        c = F.col(name)
        holds = (c > v if descending else c < v) | ((c == v) & holds)
    return holds


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngrams: int = 1, buckets: int = 10000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """docs without their text, with n_words, n_features, weight, score and rank (1, 2, ... by score descending, then id; null if not drawn).

    Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters; features are all runs of 1 to `ngrams` words, repeats counted.
    floor(percent * N / 100) of the N documents with at least `min_words` words are drawn.  Ids are whole
    numbers; a row without one has a weight, but no score, doesn't count for N and is never drawn.  Rows that share an id also share its draw, each
    being a document; of rows equal in score and id the order is that of the table.  Null and empty texts have no
    features and weight 0; texts are taken whole, however long.  An empty target weighs by rarity alone, an empty table
    gives an empty table.  Input columns of the new names are replaced, others stay, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    batches(spark)
    docs = docs.drop("n_words", "n_features", "weight", "score", "rank")
    new = ["n_words", "n_features", "weight"]
    gain = gains(*(bucket_counts(t, ngrams, buckets) for t in (docs.select(text_col), target.select(target_col))))
    kept = [f for f in docs.schema.fields if f.name != text_col]
    inner = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)), *(T.StructField(n, T.LongType()) for n in new)])
    rows = docs.toDF(*(f"d{i}" for i in range(len(docs.columns)))).mapInArrow(_weigh(docs.columns.index(text_col), ngrams, spark.sparkContext.broadcast(gain), to_arrow_schema(inner)), inner)
    ident = F.col(f"c{[f.name for f in kept].index(id_col)}").cast("long")
    work = Work(spark, "resample")
    rows = work.table(rows.withColumns({"id": ident, "score": F.col("weight") + gumbel(ident, seed), "row": F.monotonically_increasing_id()}), "scored")
    able = rows.where((F.col("n_words") >= min_words) & F.col("score").isNotNull())
    words = [("score", True), ("id", False), ("row", False)]
    k = able.count() * percent // 100
    key = select_key(able, words, k) if k else None
    final = [*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(kept)), *new, "score", "rank"]
    if key is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*final)
    drawn = (F.col("n_words") >= min_words) & F.coalesce(up_to(words, key), F.lit(False))
    order = [F.col("score").desc(), "id", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the number that each sorted row gets is its partition times 2**33, plus its place there
    sorted_ = work.table(rows.where(drawn).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    sizes = dict(sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each partition
    before, upto = [], 0
    for x in sorted(sizes):
        before.append((x, upto))
        upto += sizes[x]
    ranked = sorted_.withColumn("part", part).join(F.broadcast(spark.createDataFrame(before, "part long, before long")), "part")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return ranked.select(*final).unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long")).select(*final))

"""Line dedup with two Bloom filters (operator 6).

Pass 1 fills two Bloom filters over all lines: hashes seen once and hashes seen at least
twice.  Pass 2 shuffles only the lines that hit the twice-seen filter, as 16-byte digests,
and confirms them exactly: how many documents hold the key, and which document keeps it.
Pass 3 rewrites the texts.  The filters' size follows the texts' length up to 2**29 bits (64 MB), so their
broadcast is bounded; a fuller filter only sends more lines to the exact confirmation.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._spark import Work, tidy
from gristmill.llm._text import U64, HashSet

SLICE_BITS = 20
#: Least and most bits of the number of a filter's bits.
FILTER_BITS = (20, 29)
FLUSH = 1 << 21


def keys_of(text: str | None) -> tuple[list[str], list[bytes]]:
    """Lines of a text and their keys: stripped of ASCII white space, A-Z lower-cased."""
    lines = (text or "").split("\n")
    return lines, [x.encode("utf-8", "surrogatepass").strip().lower() for x in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The two filter positions of each hash, one row for each."""
    return np.stack([h >> U64(64 - bits), (h & U64(0xFFFFFFFF)) >> U64(32 - bits)]).astype(np.int64)


def _pack(pos: np.ndarray) -> bytes:
    """A set of positions below 2**SLICE_BITS: a list while sparse, else a compressed bitmap."""
    pos = np.unique(pos)
    if len(pos) * 4 < 1 << (SLICE_BITS - 5):
        return b"L" + pos.astype(np.uint32).tobytes()
    bits = np.zeros(1 << SLICE_BITS, bool)
    bits[pos] = True
    return b"B" + zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    bits = np.zeros(1 << SLICE_BITS, bool)
    if b[:1] == b"L":
        bits[np.frombuffer(b, np.uint32, offset=1)] = True
    else:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(b[1:]), np.uint8)).astype(bool)
    return bits


def _hashes(texts: list[str | None], least: int) -> np.ndarray:
    """First 8 digest bytes of the long keys, once for each document."""
    out = []
    for t in texts:
        out += [digest(k)[:8] for k in {k for k in keys_of(t)[1] if long_enough(k, least)}]
    return np.frombuffer(b"".join(out), ">u8").astype(U64)


_SLICES = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])


def _fill(least: int, bits: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        p = _positions(h, bits)
        once, twice = np.sort(p.ravel()), np.sort(p[:, n > 1].ravel())
        for s in np.unique(once >> SLICE_BITS):
            part = [x[np.searchsorted(x, s << SLICE_BITS) : np.searchsorted(x, (s + 1) << SLICE_BITS)] - (s << SLICE_BITS) for x in (once, twice)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "once": [_pack(part[0])], "twice": [_pack(part[1])]})

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(_hashes(b.column(0).to_pylist(), least))
            if sum(map(len, held)) >= FLUSH:
                yield from flush(held)
                held = []
        if sum(map(len, held)):
            yield from flush(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ORs the filters of each slice; what is in two once-seen filters is twice seen."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for b in batches:
        for s, o, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            o, t = _unpack(o), _unpack(t)
            if s in once:
                twice[s] |= t | (once[s] & o)
                once[s] |= o
            else:
                once[s], twice[s] = o, t
    for s in once:
        yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "once": [_pack(np.flatnonzero(once[s]))], "twice": [_pack(np.flatnonzero(twice[s]))]})


def _suspects(least: int, bits: int, twice):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = twice.value
        for b in batches:
            rows, found = [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                own = [digest(k) for k in {k for k in keys_of(t)[1] if long_enough(k, least)}]
                found += own
                rows += [r] * len(own)
            if found:
                p = _positions(np.frombuffer(b"".join(found), ">u8")[::2].astype(U64), bits)
                hit = np.flatnonzero((seen[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).all(axis=0))
                at = pa.array([rows[x] for x in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([found[x] for x in hit], pa.binary())], names=["key", "doc", "digest"])

    return run


def _rewrite(least: int, at: int, schema: pa.Schema, table=None):
    """Drops lines by a broadcast table of repeated keys, or by each row's own list of digests in the last column."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if table is not None:
            high, low, keep = table.value
            index = HashSet(high)
        for b in batches:
            ids, texts, cols = b.column(0).to_pylist(), b.column(at).to_pylist(), b.columns[1:]
            lines, dig, where = [], [], []
            for r, t in enumerate(texts):
                own, keys = keys_of(t)
                lines.append(own)
                for j, k in enumerate(keys):
                    if long_enough(k, least):
                        dig.append(digest(k))
                        where.append((r, j))
            drop: dict[int, set[int]] = {}
            if table is None:
                own_drop = cols.pop().to_pylist()
                own_drop = [frozenset(x or ()) for x in own_drop]
                for (r, j), d in zip(where, dig, strict=True):
                    if d in own_drop[r]:
                        drop.setdefault(r, set()).add(j)
            elif dig:
                h = np.frombuffer(b"".join(dig), ">u8").astype(U64)
                found = index.find(h[::2])
                for x in np.flatnonzero((found >= 0) & (low[found] == h[1::2])):
                    r, j = where[x]
                    if ids[r] is None or ids[r] < keep[found[x]]:
                        drop.setdefault(r, set()).add(j)
            kept = ["\n".join(x for j, x in enumerate(lines[r]) if j not in drop[r]) if r in drop else t or "" for r, t in enumerate(texts)]
            cols[at - 1] = pa.array(kept, pa.string())
            cols += [pa.array([len(x) for x in lines], pa.int64()), pa.array([len(drop.get(r, ())) for r in range(len(lines))], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, filter_bits: int | None = None, max_broadcast: int = 1 << 20) -> DataFrame:
    """docs with repeated lines removed from `text_col`, plus n_lines (before) and n_dropped.

    A key of at least `min_chars` code points found in at least `min_docs` documents loses all
    its lines but those in the largest id holding it.  Null and empty texts are one empty line
    and come back empty.  Rows that repeat an id count as one document; a null id counts as one
    document that never keeps a line.  Input columns called n_lines or n_dropped are replaced;
    all other columns stay, whatever their names.  Very long texts are taken whole.  An empty table gives an empty table.

    The repeated keys are broadcast while they are at most `max_broadcast` (32 bytes each); beyond
    that each row's drops are joined to it by a 128-bit hash of its id and text, to the same result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    work = Work(spark, "line_dedup")
    docs = docs.drop("n_lines", "n_dropped")
    bare = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if filter_bits is None:  # 8 bits for each line that could be long enough
        chars = bare.agg(F.sum(F.length("text"))).first()[0] or 0
        filter_bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * chars // max(min_chars, 1)).bit_length()))
    slices = work.table(bare.select("text").mapInArrow(_fill(min_chars, filter_bits), _SLICES).repartition("slice").mapInArrow(_merge, _SLICES), "filter")
    seen = np.zeros(1 << (filter_bits - 3), np.uint8)
    for s, t in slices.select("slice", "twice").collect():  # at most 2**filter_bits bits
        seen[s << (SLICE_BITS - 3) : (s + 1) << (SLICE_BITS - 3)] = np.packbits(_unpack(bytes(t)))
    twice = spark.sparkContext.broadcast(seen)

    def suspects(key: Column) -> DataFrame:
        return bare.select(key.alias("key"), "doc", "text").mapInArrow(_suspects(min_chars, filter_bits, twice), "key string, doc long, digest binary")

    found = suspects(F.lit("")).groupBy("digest", "doc").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias("n"), F.max("doc").alias("keep"))
    repeated = work.table(found.where(F.col("n") >= min_docs).select("digest", "keep"), "repeated")
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(out)
    at = docs.columns.index(text_col) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    if repeated.count() <= max_broadcast:
        got = repeated.toArrow()
        h = np.frombuffer(b"".join(got.column("digest").to_pylist()), ">u8").astype(U64)
        table = spark.sparkContext.broadcast((h[::2].copy(), h[1::2].copy(), got.column("keep").to_numpy().astype(np.int64)))
        return rows.mapInArrow(_rewrite(min_chars, at, arrow, table), out)
    key = lambda text: F.md5(F.concat(F.coalesce(F.col("doc").cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))))
    drops = suspects(key("text")).join(repeated, "digest").where("doc is null or doc < keep").groupBy("key").agg(F.collect_set("digest").alias("drop"))  # a set for each row's text
    joined = rows.withColumn("key", key(f"c{at - 1}")).join(drops, "key", "left").select(*rows.columns, "drop")
    return joined.mapInArrow(_rewrite(min_chars, at, arrow), out)

"""N-gram Jaccard join by rare-first prefix filtering (operator 10).

A document's set is its distinct word n-grams as 64-bit hashes; equal sets are one node, so
exact copies are never compared.  Order of n-grams, from statistics of all documents: those seen
once before those seen again (a bitmap), then by level of a count sketch (a byte for each of
2**20 cells), then by hash.  It is a total order, so two sets whose similarity reaches the
threshold share an n-gram among their first n - ceil(t n) + 1; and one of those seen again, as
nobody shares what was seen once: only such n-grams leave their task.  The bitmap grows with the
input up to 2**29 cells; fuller cells on larger inputs make the order less sharp and let more n-grams through, no link is lost.

1. `_digests`: one row for each document (node, size, sizes of 64 parts) and the partial statistics.
2. `_prefixes` emits the prefix n-grams; sorted runs of one n-gram are streamed, and those of two nodes or more stay.
3. `_sets` writes, once, the whole sets of the nodes in these runs.
4. In a few rounds each node's most frequent neighbours of other components, a bounded number of
   rows before it in the runs, are verified on the whole sets.  Components of the links follow.
5. Runs that still hold several components give the pairs across components that pass length,
   positional and suffix filters.  They are verified too, so no link between components is lost, while
   the pairs inside a component are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._spark import Work, bloom, components, in_bloom, tidy
from gristmill.llm._text import LOWER, NOT_SPACE, U64, chunks, hash_spans, mix64, roll, spans

CELL_BITS = 20
SPACE_BITS, SLICE_BITS = 32, 10
#: Least and most bits of the number of the bitmap's cells.
AGAIN_BITS = (20, 29)
RANK_BITS = 9
SLICE = 1 << 16
SEEN = 1 << 16
GRAM, OTHER = 0x5851F42D4C957F2D, 0x14057B7EF767814F
PARTS = 64
ROUNDS, NEAR, BEFORE = 3, 4, 32


def gram_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, offsets): for each text the sorted distinct hashes of its k-word shingles (all its words as one, if fewer)."""
    for a, b, data, offs in chunks(column):
        low = LOWER[data]
        s, e, first = spans(low, offs, NOT_SPACE)
        words = hash_spans(low, s, e)
        count = np.diff(first)
        n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
        at = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(first[:-1] - at[:-1], n) + np.arange(at[-1])
        rolled = roll(words, k)
        grams = rolled[np.minimum(of, len(rolled) - 1)] if len(rolled) else np.zeros(len(of), U64)
        for i in np.flatnonzero((count > 0) & (count < k)).tolist():
            grams[at[i]] = roll(words[first[i] : first[i + 1]], int(count[i]))[0]
        ends = at.tolist()
        for i, j in zip(ends, ends[1:], strict=False):
            grams[i:j].sort()
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        new[at[:-1][n > 0]] = True
        yield a, b, grams[new], np.concatenate([[0], np.cumsum(new)])[at]


def nodes_of(grams: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two ids of each whole set: mixed sums that don't depend on order. The first is cut to `bits` bits; the second stands in for it where two sets share it."""
    n = np.diff(offs)
    some = n > 0
    out = []
    for seed in (GRAM, OTHER):
        total = np.zeros(len(n), U64)
        if some.any():
            total[some] = np.add.reduceat(mix64(grams ^ U64(seed)), offs[:-1][some])
        out.append(mix64(total + n.astype(U64) * U64(seed)))
    return (out[0] & U64((1 << bits) - 1)).view(np.int64), out[1].view(np.int64)


def _named(grams: np.ndarray, offs: np.ndarray, bits: int, clash: np.ndarray) -> np.ndarray:
    node, other = nodes_of(grams, offs, bits)
    return np.where(np.isin(node, clash), other, node) if len(clash) else node


class _Seen:
    """Nodes that a task has had, as many as fit: copies in one task are dealt with once."""

    def __init__(self):
        self.nodes: set[int] = set()

    def fresh(self, nodes: np.ndarray, some: np.ndarray) -> np.ndarray:
        out = some.copy()
        for i in np.flatnonzero(some).tolist():
            x = int(nodes[i])
            if x in self.nodes:
                out[i] = False
            elif len(self.nodes) < SEEN:
                self.nodes.add(x)
        return out


def _rows_of(offs: np.ndarray, rows: np.ndarray, many: np.ndarray | None = None) -> np.ndarray:
    """Indexes of the first `many` members (all) of the given rows' sets."""
    n = np.diff(offs)[rows] if many is None else many
    return np.repeat(offs[:-1][rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _planes(x: np.ndarray) -> bytes:
    """32-bit values as byte planes, which compress well."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _digests(k: int, bits: int, carried: pa.Schema):
    names = [*carried.names, "node", "other", "n", "parts", "slice", "cells"]

    def statistic(slices: list[int], packed: list[bytes]) -> pa.RecordBatch:
        n = len(slices)
        return pa.RecordBatch.from_arrays([*(pa.nulls(n, f.type) for f in carried), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.list_(pa.int16())), pa.array(slices, pa.int32()), pa.array(packed, pa.binary())], names=names)

    def statistics(held: list[np.ndarray], cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds to the sketch's cells; gives sorted hashes of SPACE_BITS by slice, as differences. Slices of these are negative."""
        h = np.sort((np.concatenate(held) >> U64(64 - SPACE_BITS)).astype(np.uint32))
        cells += np.bincount(h >> np.uint32(SPACE_BITS - CELL_BITS), minlength=len(cells))
        ends = np.searchsorted(h >> np.uint32(SPACE_BITS - SLICE_BITS), np.arange((1 << SLICE_BITS) + 1))
        some = np.flatnonzero(np.diff(ends))
        low = h & np.uint32((1 << (SPACE_BITS - SLICE_BITS)) - 1)
        yield statistic((-1 - some).tolist(), [_planes(np.diff(low[ends[i] : ends[i + 1]], prepend=np.uint32(0))) for i in some])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, n_held, seen = np.zeros(1 << CELL_BITS, np.int64), [], 0, _Seen()
        for b in batches:
            for a, z, grams, offs in gram_sets(b.column(b.num_columns - 1), k):
                n = np.diff(offs)
                node, other = nodes_of(grams, offs, bits)
                fresh = seen.fresh(other, n > 0)
                own = np.flatnonzero(fresh)
                kept = grams[_rows_of(offs, own)]
                held.append(kept)
                n_held += len(kept)
                of = np.repeat(np.arange(len(own)), n[own])
                size = np.minimum(np.bincount(of * PARTS + (kept & U64(PARTS - 1)).astype(np.int64), minlength=len(own) * PARTS), 32767).astype(np.int16)
                starts = np.concatenate([[0], np.cumsum(np.where(fresh, PARTS, 0))]).astype(np.int32)
                parts = pa.ListArray.from_arrays(pa.array(starts, mask=np.append(~fresh, False)), pa.array(size))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:-1]), pa.array(node, mask=n == 0), pa.array(other, mask=n == 0), pa.array(n), parts, pa.nulls(z - a, pa.int32()), pa.nulls(z - a, pa.binary())], names=names)
                if n_held >= 1 << 20:
                    yield from statistics(held, cells)
                    held, n_held = [], 0
        if n_held:
            yield from statistics(held, cells)
        some = [s for s in range(0, len(cells), SLICE) if cells[s : s + SLICE].any()]
        if some:
            yield statistic([s // SLICE for s in some], [_planes(np.minimum(cells[s : s + SLICE], 0xFFFFFFFF)) for s in some])

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the summed counts: four to a doubling, in a byte."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[s] = total.get(s, 0) + _unplaned(c).astype(np.int64)
    for s, c in total.items():
        level = np.minimum(4 * np.log2(c + 1), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "level"])


def _again(again_bits: int):
    """For each slice the bitmap of the 2**again_bits cells that hold a hash seen at least twice."""

    def bitmap(s: int, twice: np.ndarray) -> pa.RecordBatch:
        fold = twice.reshape(1 << (again_bits - SLICE_BITS), -1).any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(fold).tobytes()], pa.binary())], names=["slice", "bits"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, once, twice = None, None, None
        for b in batches:  # rows come sorted by slice
            for s, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if s != last:
                    if last is not None:
                        yield bitmap(last, twice)
                    last, once, twice = s, *(np.zeros(1 << (SPACE_BITS - SLICE_BITS), bool) for _ in range(2))
                at = np.cumsum(_unplaned(c.as_py()), dtype=np.uint32)
                twice[at[once[at]]] = True
                twice[at[1:][at[1:] == at[:-1]]] = True
                once[at] = True
        if last is not None:
            yield bitmap(last, twice)

    return run


def _prefixes(k: int, percent: int, bits: int, levels, bitmap, clash: np.ndarray):
    """Rows (gram, node, n, pos) of the prefix n-grams seen again; a gram is its rank before its leading hash bits."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, again, seen = levels.value, bitmap.value, _Seen()
        again_bits = len(again).bit_length() + 2
        for b in batches:
            for _, _, grams, offs in gram_sets(b.column(0), k):
                node = _named(grams, offs, bits, clash)
                own = np.flatnonzero(seen.fresh(node, np.diff(offs) > 0))
                if not len(own):
                    continue
                n = np.diff(offs)[own]
                grams = grams[_rows_of(offs, own)]
                cell = (grams >> U64(64 - again_bits)).astype(np.int64)
                rank = (again[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(U64) << U64(8) | level[(grams >> U64(64 - CELL_BITS)).astype(np.int64)]
                key = rank << U64(64 - RANK_BITS) | grams >> U64(RANK_BITS)
                ends = np.concatenate([[0], np.cumsum(n)])
                for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                    key[i:j].sort()
                p = n - -(-n * percent // 100) + 1
                first = _rows_of(ends, np.arange(len(n)), p)
                pos = np.arange(len(first)) - np.repeat(np.cumsum(p) - p, p)
                of = np.repeat(np.arange(len(n)), p)
                out = np.flatnonzero(key[first] >> U64(63))  # those seen once meet nobody
                yield pa.RecordBatch.from_arrays([pa.array(key[first[out]].view(np.int64)), pa.array(node[own][of[out]]), pa.array(n[of[out]].astype(np.int32)), pa.array(pos[out].astype(np.int32))], names=["gram", "node", "n", "pos"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (gram, n, node): the rows of grams with at least two nodes, copies once. Only the last row is kept between batches, however long a run is."""
    names = ["gram", "node", "n", "pos"]
    last, given = None, False  # last row, whether it was given out
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if last is not None:
            cols = [np.concatenate([x[None], c]) for x, c in zip(last, cols, strict=True)]
        gram, node = cols[:2]
        if not len(gram):
            continue
        fresh = np.ones(len(gram), bool)  # not a copy of the row before
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, node, n, pos = (c[fresh] for c in cols)
        joins = np.zeros(len(gram) + 1, bool)  # joins[i]: row i goes on the run of the row before
        joins[1:-1] = gram[1:] == gram[:-1]
        out = joins[:-1] | joins[1:]
        if last is not None and given:
            out[0] = False
        given = bool(joins[len(gram) - 1]) or (len(gram) == 1 and given)
        last = tuple(c[-1] for c in (gram, node, n, pos))
        at = np.flatnonzero(out)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (gram, node, n, pos)], names=names)


def _lattice(percent: int):
    """Streams sorted rows (gram, node, n, comp): pairs of each row with the NEAR rows before it of its gram, of another component and a compatible length. NEAR rows are kept between batches."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:4]]
            before = len(held[0]) if held else 0
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            gram, node, n, comp = cols
            for j in range(1, NEAR + 1):
                x, y = np.arange(max(before, j), len(gram)), np.arange(max(before, j), len(gram)) - j
                least, most = np.minimum(n[x], n[y]).astype(np.int64), np.maximum(n[x], n[y]).astype(np.int64)
                ok = (gram[x] == gram[y]) & (comp[x] != comp[y]) & (100 * least >= percent * most)
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[x[ok]]), pa.array(node[y[ok]])], names=["node", "node_2"])
            held = [c[-NEAR:] for c in cols]

    return run


def _neighbours(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b): each node with up to NEAR of its most frequent neighbours of other components and compatible length.

    In each gram's rows, by size (first turn) or by length class and a hash of the turn, the NEAR rows before are neighbours:
    a group of near-duplicates becomes a lattice that a few failing pairs don't break, with pairs in proportion to rows.
    Rows are dealt by ranges of that order, so that a frequent gram is split; neighbours across two ranges are left to the last step.
    """
    order = ["n", "node"] if not turn else [F.floor(F.log("n") * 7), F.xxhash64("node", F.lit(turn)), F.col("node")]
    sorted_rows = rows.select("gram", "node", "n", "comp", *(F.expr(x) if isinstance(x, str) else x for x in order))
    sorted_rows = sorted_rows.toDF("gram", "node", "n", "comp", *(f"o{i}" for i in range(len(order))))
    by = ["gram", *(f"o{i}" for i in range(len(order)))]
    pairs = sorted_rows.repartitionByRange(*by).sortWithinPartitions(*by).select("gram", "node", "n", "comp").mapInArrow(_lattice(percent), "node long, node_2 long")
    times = pairs.groupBy("node", "node_2").agg(F.count(F.lit(1)).alias("times"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("times"), "node_2"))
    return times.withColumn("r", best).where(F.col("r") <= NEAR).select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()


def _possible(percent: int, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Length and positional filter at the first common n-gram: the overlap still possible reaches 100 i >= t (n1 + n2 - i)."""
    most = f"(1 + least({n1} - {p1} - 1, {n2} - {p2} - 1))"
    return F.expr(f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and (100 + {percent}) * {most} >= {percent} * ({n1} + {n2})")


def _before() -> Column:
    """The BEFORE n-grams before a row's own in its node's prefix. Two rows with one of them in common are not at their nodes' first common n-gram, where the pair is made."""
    return F.collect_list("gram").over(Window.partitionBy("node").orderBy("pos").rowsBetween(-BEFORE, -1))


def _sets(k: int, bits: int, wanted, clash: np.ndarray):
    """The whole sets of the wanted nodes; `wanted` is a Bloom filter, so a few others come too."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            for _, _, grams, offs in gram_sets(b.column(0), k):
                node = _named(grams, offs, bits, clash)
                own = np.flatnonzero(seen.fresh(node, (np.diff(offs) > 0) & in_bloom(wanted.value, node)))
                if len(own):
                    ends = np.concatenate([[0], np.cumsum(np.diff(offs)[own])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[_rows_of(offs, own)].view(np.int64)))], names=["node", "grams"])

    return run


def _size(n: int, least: int, most: int) -> int:
    """Bits of the least power of two that reaches n, within limits."""
    return min(most, max(least, int(max(n, 1) - 1).bit_length()))


def _candidate_sets(work: Work, docs: DataFrame, chains: DataFrame, k: int, bits: int, clash: np.ndarray) -> DataFrame:
    """(node, grams) of all nodes in the chains, each once: the only copy of sets that is ever written."""
    wanted = bloom(work.spark, work.table(chains.select("node").distinct(), "wanted"))
    found = docs.select("text").mapInArrow(_sets(k, bits, wanted, clash), "node long, grams array<long>")
    return work.table(found.dropDuplicates(["node"]), "sets")


def _suffix(percent: int, n1: str, p1: str, n2: str, p2: str) -> Column:
    """Suffix filter: both sets are split by hash into 64 parts, and the overlap is at most the sum of the smaller sizes. Sizes saturate at 32767, where the pair passes."""
    most = F.expr(f"aggregate(zip_with({p1}, {p2}, (x, y) -> if(x = 32767 and y = 32767, 1000000000L, cast(least(x, y) as bigint))), 0L, (s, x) -> s + x)")
    return (100 + percent) * most >= percent * (F.col(n1) + F.col(n2))


def _filtered(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the suffix filter."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").where(_suffix(percent, "na", "pa", "nb", "pb")).select("a", "b")


def _verified(work: Work, sets: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b), a < b, among the pairs, by their whole sets."""
    pairs = work.table(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-pairs")
    left, right = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    link = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("ga") + F.size("gb") - both))
    return work.table(link.select("a", "b"), f"{name}-links")


def classes(work: Work, docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, k: int = 5, percent: int = 75, node_bits: int = 64) -> DataFrame:
    """The `carry` columns of each row of docs, n (its set's size, 0 without words) and comp (its class; null without words)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, carry = work.spark, carry or []
    texts = docs.select(F.col(text_col).alias("text"))
    kept = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(text_col).alias("text"))
    fields = [*(T.StructField(f.name, f.dataType) for f in kept.schema.fields[:-1]), *(T.StructField(c, T.LongType()) for c in ("node", "other", "n")), T.StructField("parts", T.ArrayType(T.ShortType())), T.StructField("slice", T.IntegerType()), T.StructField("cells", T.BinaryType())]
    first = work.table(kept.mapInArrow(_digests(k, node_bits, to_arrow_schema(T.StructType(kept.schema.fields[:-1]))), T.StructType(fields)), "digests")
    rows = first.where("slice is null")
    twins = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    clash = np.array([r[0] for r in twins.where("lo <> hi").select("node").collect()], np.int64)  # sets that share a 64-bit id: two in 2**33 nodes
    if len(clash):
        rows = rows.withColumn("node", F.when(F.col("node").isin(clash.tolist()), F.col("other")).otherwise(F.col("node")))
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    stats = first.where("slice is not null").select("slice", "cells")
    for s, level in stats.where("slice >= 0").repartition("slice").mapInArrow(_sum_cells, "slice int, level binary").collect():  # 2**CELL_BITS bytes
        levels[s * SLICE : (s + 1) * SLICE] = np.frombuffer(bytes(level), np.uint8)
    again_bits = _size(2 * (rows.where("parts is not null").agg(F.sum("n")).first()[0] or 0), *AGAIN_BITS)
    again = np.zeros(1 << (again_bits - 3), np.uint8)
    width = 1 << (again_bits - SLICE_BITS - 3)
    found = stats.where("slice < 0").repartition("slice").sortWithinPartitions("slice").mapInArrow(_again(again_bits), "slice int, bits binary").toArrow()  # 2**again_bits bits
    for s, bits in zip(found.column("slice").to_pylist(), found.column("bits"), strict=True):
        again[(-1 - s) * width : -s * width] = np.frombuffer(bits.as_buffer(), np.uint8)
    del found
    nodes = rows.where("parts is not null").select("node", "n", "parts").dropDuplicates(["node"])
    sketch, bitmap = spark.sparkContext.broadcast(levels), spark.sparkContext.broadcast(again)
    postings = texts.mapInArrow(_prefixes(k, percent, node_bits, sketch, bitmap, clash), "gram long, node long, n int, pos int")
    sorted_rows = postings.repartition("gram").sortWithinPartitions("gram", "n", "node")
    chains = work.table(sorted_rows.mapInArrow(_chains, "gram long, node long, n int, pos int"), "chains")
    sketch.unpersist()
    bitmap.unpersist()
    sets = _candidate_sets(work, texts, chains, k, node_bits, clash)
    nodes = work.table(nodes.join(sets.select("node"), "node", "left_semi"), "nodes")
    rungs, links, tried = chains.withColumn("comp", F.col("node")), None, None
    for n in range(ROUNDS):
        asked = _neighbours(rungs, n, percent)
        asked = work.table(asked.join(tried, ["a", "b"], "left_anti") if n else asked, f"asked-{n}")
        more = _verified(work, sets, _filtered(nodes, asked, percent), percent, f"round-{n}")
        if n and more.isEmpty():
            break
        links = work.table(links.union(more), f"links-{n}") if n else more
        tried = work.table(tried.union(asked), f"tried-{n}") if n else asked
        label = components(work, links, f"round-{n}")
        rungs = chains.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rungs.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    rungs = rungs.join(mixed, "gram", "left_semi").withColumn("before", _before()).join(nodes.select("node", "parts"), "node")
    rungs = work.table(rungs, "mixed")
    other = rungs.select("gram", *(F.col(c).alias(f"{c}_2") for c in ("node", "n", "pos", "comp", "before", "parts")))
    cross = rungs.join(other, "gram").where("comp < comp_2").where(_possible(percent, "n", "pos", "n_2", "pos_2")).where("not arrays_overlap(before, before_2)")
    cross = cross.where(_suffix(percent, "n", "parts", "n_2", "parts_2"))
    more = _verified(work, sets, cross.select(F.col("node").alias("a"), F.col("node_2").alias("b")), percent, "cross")
    if not more.isEmpty():
        label = components(work, links.union(more), "all")
    out = rows.join(label, "node", "left")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "n", F.coalesce("comp", "node").alias("comp"))


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, node_bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) for each row: documents link when 100 |A and B| >= percent |A or B|.

    component_id is the smallest id reachable by links.  Texts without words (null, empty, white
    space) have n_shingles 0 and only themselves.  Rows that repeat an id are rows of their own;
    rows of equal text share a component.  A null id counts in no minimum.  Very long texts are taken whole.  An empty table
    gives an empty table; other columns, whatever their names, are not read.  Sets are compared as 64-bit hashes: two n-grams
    of one pair collide with probability under |A| |B| / 2**64; sets are identified by two ids, 128 bits in all (of the first `node_bits`).
    """
    work = Work(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = work.table(classes(work, docs, carry=["doc"], k=k, percent=percent, node_bits=node_bits), "rows")
    least = work.table(rows.where("comp is not null").groupBy("comp").agg(F.min("doc").alias("component_id")), "least")
    return rows.join(least, "comp", "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))

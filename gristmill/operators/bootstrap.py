"""Bootstrap of means of real-valued differences, for many groups in one plan.

The distinct values of a group are ranked over range partitions and cut into blocks of at most
BLOCK, so no array holds all values and no task sorts a group.  A draw first splits its n picks
over the blocks: binomial splits down a binary tree of blocks, whose random numbers follow from
seed and node, so every block finds its own share without asking the others.  Within its block
a pick is a rank, found in the running counts by binary search; blocks of more than ROWS rows
(few values, each very frequent) split their picks over the values in the same binomial way.

Groups of one block and as many rows share their picks: a draw's ranks are made and counted once for
all of them, and each group reads its sum off the running counts at its values' ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.sources.held import held

#: Distinct values of a block.
BLOCK = 1 << 16
#: Rows of a block that are picked one by one.
ROWS = 1 << 20
#: Picks of a unit of work, about; and of one whose picks several groups share.
UNIT, SHARED = 1 << 25, 1 << 22
#: Picks of shared ranks that are made at once, unless one draw has more.
AT_ONCE = 1 << 17
_M = 0x7FFFFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    """31-bit numbers spread over all 31 bits, with products below 2**62."""
    x = x & _M
    x = ((x ^ x >> 16) * 0x45D9F3B) & _M
    x = ((x ^ x >> 15) * 0x2C1B3C6D) & _M
    return x ^ x >> 16


def picks(seed: int, draw: np.ndarray, block: int, i: np.ndarray, n: int) -> np.ndarray:
    """The i-th picks of a draw in a block, each from 0 to n - 1."""
    a = _mix(seed + 2 * draw + 1 + 7919 * block)
    b = _mix(a + draw)
    return _mix(_mix(i + a) + b) % n


def _share(seed: int, sizes: np.ndarray, block: int, draws: int) -> np.ndarray:
    """How many of a draw's picks fall into a block, for every draw."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, node = 0, len(sizes), 1
    now = np.full(draws, upto[-1], np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.Generator(np.random.Philox(key=[seed, node])).binomial(now, (upto[mid] - upto[low]) / (upto[high] - upto[low]))
        if block < mid:
            now, high, node = left, mid, 2 * node
        else:
            now, low, node = now - left, mid, 2 * node + 1
    return now


def _sums(seed: int, draws: int, first: int, after: int, block: int, sizes: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of a block's picked values, for each draw from first up to after."""
    upto, n = np.cumsum(counts), int(counts.sum())
    share = _share(seed, sizes, block, draws)[first:after]
    if n > ROWS:
        rng = np.random.Generator(np.random.Philox(key=[seed, (1 << 40) + (block << 20) + first]))
        return np.array([rng.multinomial(m, counts / n) @ values for m in share])
    rows = np.repeat(values, counts) if len(values) * 8 > n else None  # at most 8 MB; else the ranks are searched
    out = np.zeros(after - first)
    step = max(1, (1 << 20) // max(1, int(share.max(initial=1))))
    for at in range(0, after - first, step):
        own = share[at : at + step]
        draw = np.repeat(np.arange(first + at, first + at + len(own)), own)
        ends = np.cumsum(own)
        rank = picks(seed, draw, block, np.arange(len(draw)) - np.repeat(ends - own, own), n)
        got = rows[rank] if rows is not None else values[np.searchsorted(upto, rank, "right")]
        out[at : at + step] = np.bincount(draw - first - at, got, minlength=len(own))
    return out


def _mix32(x: np.ndarray) -> np.ndarray:
    """_mix of 32-bit numbers, in place: products wrap around, their last 31 bits are the same."""
    for shift, factor in ((16, 0x45D9F3B), (15, 0x2C1B3C6D)):
        x &= np.uint32(_M)
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x &= np.uint32(_M)
    x ^= x >> np.uint32(16)
    return x


def _upto(seed: int, draw: np.ndarray, n: int) -> np.ndarray:
    """For each draw and rank: how many of the draw's picks have at most that rank. The picks are those of block 0, n of them."""
    a = _mix(seed + 2 * draw + 1)
    b = _mix(a + draw)
    x = np.arange(n, dtype=np.uint32) + a.astype(np.uint32)[:, None]
    x = _mix32(_mix32(x) + b.astype(np.uint32)[:, None])
    x -= x // np.uint32(n) * np.uint32(n)
    x = x.astype(np.int64) + np.arange(len(draw))[:, None] * n
    return np.cumsum(np.bincount(x.ravel(), minlength=len(draw) * n).reshape(len(draw), n), axis=1)


def _shared(seed: int, first: int, after: int, n: int, members: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sums of the picked values of groups of n rows, by group and draw; a group is its sorted values and their counts."""
    out = np.zeros((len(members), after - first))
    step = max(1, AT_ONCE // n)
    for at in range(first, after, step):
        draw = np.arange(at, min(after, at + step))
        upto = _upto(seed, draw, n)
        for own, (values, counts) in zip(out, members, strict=True):
            own[at - first : at - first + len(draw)] = np.diff(upto[:, np.cumsum(counts) - 1], axis=1, prepend=0) @ values
    return out


def _share_work(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, first, after, members in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                groups, bands = members.values.flatten()
                parts = [[x.to_numpy(zero_copy_only=False) for x in one.values.flatten()] for one in bands]
                sums = _shared(seed, first, after, n, parts)
                for g, got in zip(groups.to_pylist(), sums, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(got), pa.int64()), pa.array(np.arange(first, after), pa.int32()), pa.array(got)], names=["g", "draw", "s"])

    return run


def _work(seed: int, draws: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, block, first, after, sizes, bands in zip(*(c.to_pylist() if i < 5 else c for i, c in enumerate(b.columns)), strict=True):
                each = bands.values.flatten() if hasattr(bands, "values") else []
                values, counts = (x.to_numpy(zero_copy_only=False) for x in each)
                got = _sums(seed, draws, first, after, block, np.array(sizes, np.int64), values, counts)
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(got), pa.int64()), pa.array(np.arange(first, after), pa.int32()), pa.array(got)], names=["g", "draw", "s"])

    return run


def _ranked(counts: DataFrame) -> DataFrame:
    """counts (g, v, c) with the rank (from 0) of v within its g, by range partitions: no task holds a whole group."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = held(counts.repartitionByRange(parts, "g", "v").sortWithinPartitions("g", "v").withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    spans = placed.groupBy("g", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("g", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(spans, ["g", "part"]).select("g", "v", "c", (F.col("place") - F.col("first") + F.col("before")).alias("rank"))


def bootstrap_means(differences: DataFrame, value: str, draws: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """Per group (without `by`: one row, also of no differences): n, mean, and low and high of the 95 % interval (linear interpolation) of the mean of n resampled differences.

    Null values are left out; equal values are counted together first, so repeated ones cost nothing.  The picks follow from seed, draw, block and place
    alone, the same in every group, however the rows are partitioned.
    """
    spark, by = differences.sparkSession, by or []
    named = differences.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    names = named.select(F.struct(*by).alias("of") if by else F.lit(0).alias("of"), "v", "c")
    names = held(names.withColumn("g", F.xxhash64("of")))  # both the totals and the ranks read it
    groups = held(names.groupBy("g", "of").agg(F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total")))
    blocks = _ranked(names.select("g", "v", "c")).withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int"))
    blocks = held(blocks.groupBy("g", "block").agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("bands"), F.sum("c").alias("size")))  # BLOCK values at most
    sizes = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("sizes")).select("g", F.col("sizes.size").alias("sizes"))

    def units(rows: DataFrame, most: int) -> DataFrame:
        step = F.least(F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("size"))), F.lit(draws)).cast("int")
        rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), step)))
        return rows.withColumn("after", F.least(F.col("first") + step, F.lit(draws)))

    whole = (F.size("sizes") == 1) & (F.col("size") <= ROWS)
    blocks = blocks.join(sizes, "g")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(min(8 << 20, _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))))
    apart = units(blocks.where(~whole), UNIT).select("g", "block", "first", "after", "sizes", "bands").repartition("g", "block", "first")
    alike = blocks.where(whole).select("g", "size", "bands")
    packs = alike.groupBy("size").agg(F.ceil(F.sum(F.size("bands")) / BLOCK).alias("packs"))  # of BLOCK values, about
    packed = alike.join(packs, "size").groupBy("size", F.pmod(F.xxhash64("g"), "packs").alias("pack")).agg(F.array_sort(F.collect_list(F.struct("g", "bands"))).alias("members"))
    packed = units(packed, SHARED).repartition("size", "pack", "first").select("size", "first", "after", "members")
    schema = "g long, draw int, s double"
    sums = apart.mapInArrow(_work(seed, draws), schema).union(packed.mapInArrow(_share_work(seed), schema)).groupBy("g", "draw").agg(F.sum("s").alias("s"))
    means = sums.join(groups.select("g", "n"), "g").groupBy("g").agg(F.percentile(F.col("s") / F.col("n"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    out = groups.join(means, "g").select("of", "n", (F.col("total") / F.col("n")).alias("mean"), F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
    if by:
        return out.select("of.*", "n", "mean", "low", "high")
    return spark.range(1).join(out, F.lit(True), "left").select(F.coalesce("n", F.lit(0)).alias("n"), "mean", "low", "high")


def _bytes(setting: str) -> int:
    """A byte setting without unit, or a large number for any other."""
    plain = setting.removesuffix("b")
    return int(plain) if plain.isdigit() and int(plain) > 0 else 1 << 40

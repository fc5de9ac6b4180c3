"""Language-model scoring by context-tree weighting over bytes (operator 7).

A text is its token sequence: words joined by single spaces, A-Z lower-cased, UTF-8, and one
end symbol.  Each byte is coded as eight binary decisions; every (bit prefix, context of d
preceding bytes, d = 0 .. depth) node counts its zeros and ones over the training texts.
Krichevsky-Trofimov estimates of a path are mixed over all depths with the weights that the
tree's own evidence gives: w = P_kt / (P_kt + product of the children's P_w).

Counting is distributed: each task counts (depth + 1)-byte grams of its texts, the counts are
summed by gram, and shorter contexts are sums of longer ones.  The tree keeps every counted
gram.  It is cut at contexts of ROOT bytes: the subtrees below are dealt out by those bytes and
send up their roots' weights; the top (at most 256**ROOT grams) is solved by the driver and
broadcast; each subtree then gives every gram that any text asks for its log probability.
Texts look up the most frequent grams in a broadcast table of at most `capacity` of them, and the
others are joined; none is left out, and where the line between the two lies does not change a score.

A text of words that training lacks costs the tree their spelling, which the base score doesn't charge; `weighted`
weighs the two by their evidence, as the tree does its depths.

The base score is exact add-one unigram over all training words: frequent words' counts are
broadcast (at most `words` of them), the others are joined by word hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._spark import Work, tidy
from gristmill.llm._text import LOWER, NOT_SPACE, U64, HashSet, chunks, hash_spans, spans

END = b"\xff"
HELD = 1 << 22
ROOT = 3
#: Grams of one task that solves subtrees.
TASK_GRAMS = 1 << 19


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all (context, byte) pairs, the byte last; and the number of each text's pairs (its bytes and the end)."""
    gap = END * depth if depth else END
    buf = np.frombuffer(gap + gap.join(texts) + gap + END, np.uint8)
    n = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(n) - n + np.arange(len(n)) * (len(gap) - 1) + len(gap)
    key = np.zeros(len(buf) - depth, U64)
    for j in range(depth + 1):
        key <<= U64(8)
        key |= buf[j : len(buf) - depth + j]
    at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n) - depth, n)
    return key[at], n


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[head], np.add.reduceat(n, head) if len(k) else n


class _Counter:
    """Counts of 64-bit keys, sorted and merged from time to time."""

    def __init__(self):
        self.raw, self.n_raw, self.keys, self.counts = [], 0, [], []

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n_raw += len(keys)
        if self.n_raw >= HELD:
            self._settle()

    def _settle(self) -> None:
        if self.n_raw:
            k, n = np.unique(np.concatenate(self.raw), return_counts=True)
            self.keys.append(k)
            self.counts.append(n)
            self.raw, self.n_raw = [], 0
        if len(self.keys) > 1 and (len(self.keys) > 4 or len(self.keys[-1]) > len(self.keys[0])):
            k, n = _summed(self.keys, self.counts)
            self.keys, self.counts = [k], [n]

    def full(self) -> bool:
        return sum(map(len, self.keys)) > HELD

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._settle()
        if self.keys:
            k, n = _summed(self.keys, self.counts)
            for i in range(0, len(k), 1 << 16):
                yield k[i : i + (1 << 16)], n[i : i + (1 << 16)]
        self.__init__()


def _count(depth: int):
    """(kind, key, n): kind 0 grams, 1 words by hash, 2 texts. Texts outside the training rows give their grams with n = 0."""

    def out(kind: int, counter: _Counter, times: int = 1) -> Iterator[pa.RecordBatch]:
        for k, n in counter.take():
            n = n * times
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, words, rows = _Counter(), _Counter(), _Counter(), 0
        for b in parts:
            learn = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            rows += int(learn.sum())
            for a, z, data, offs in chunks(b.column(0)):
                texts = [normal(t) for t in b.column(0).slice(a, z - a).to_pylist()]
                keys, n = grams(texts, depth)
                of = np.repeat(learn[a:z], n)
                own.add(keys[of])
                other.add(keys[~of])
                s, e, first = spans(low := LOWER[data], offs, NOT_SPACE)
                words.add(hash_spans(low, s, e)[np.repeat(learn[a:z], np.diff(first))])
                if own.full():
                    yield from out(0, own)
                if other.full():
                    yield from out(0, other, 0)
                if words.full():
                    yield from out(1, words)
        yield from out(0, own)
        yield from out(0, other, 0)
        yield from out(1, words)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], names=["kind", "key", "n"])

    return run


_SMALL = 4096
_LOG_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_LOG_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL + 1)))])


def _lgamma(n: np.ndarray, plus: float) -> np.ndarray:
    """log gamma(n + plus) of whole n, plus being 0.5 or 1."""
    x = np.maximum(n, 1) + plus
    far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= _SMALL, (_LOG_HALF if plus == 0.5 else _LOG_FACT)[np.minimum(n, _SMALL)], far)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a zeros and b ones."""
    return _lgamma(a, 0.5) + _lgamma(b, 0.5) - np.log(np.pi) - _lgamma(a + b, 1.0)


class Tree:
    """The weighted tree: for each depth and bit position, sorted nodes and the probability of a one where the path ends there.

    A part of it has the depths from `first` on.  Without `top`, the part above, it only weighs its roots; `below` are
    the summed log weights under each of the deepest nodes, for the eight bit positions, where another part goes on.
    """

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], first: int = 0, top: Tree | None = None, below: list[np.ndarray] | None = None):
        self.depth = first + len(tables) - 1
        self.nodes: list[list[np.ndarray]] = [*(top.nodes if top else [[None] * 8] * first), *([None] * 8 for _ in tables)]
        self.one: list[list[np.ndarray]] = [*(top.one if top else [[None] * 8] * first), *([None] * 8 for _ in tables)]
        self.roots: list[tuple[np.ndarray, np.ndarray]] = []  # parents and log weights of the nodes of the first depth
        self.down: list[tuple[np.ndarray, np.ndarray]] = []  # what the deepest nodes hand on: probability so far, weight that is left
        deepest = tables[-1][0]
        total = np.zeros(len(deepest))
        levels = range(first, self.depth + 1)
        for j in range(8):
            zeros, ones, lw, stop, up = {}, {}, {}, {}, {}
            for d, (keys, n) in zip(levels, tables, strict=True):
                own = keys >> U64(8 - j)
                head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                self.nodes[d][j] = own[head]
                bit = ((keys >> U64(7 - j)) & U64(1)).astype(np.int64)
                total_n = np.add.reduceat(n, head) if len(own) else n
                ones[d] = np.add.reduceat(n * bit, head) if len(own) else n
                zeros[d] = total_n - ones[d]
                if d:
                    parents = self.nodes[d][j] & U64((1 << (8 * d - 8 + j)) - 1)
                    if d > first or top:
                        up[d] = np.searchsorted(self.nodes[d - 1][j], parents)
                    else:
                        self.roots.append((parents, None))
            for d in reversed(levels):
                kt = log_kt(zeros[d], ones[d])
                lw[d], stop[d] = kt, np.ones(len(kt))
                if len(kt) and (d < self.depth or below):
                    under = np.bincount(up[d + 1], lw[d + 1], len(kt)) if d < self.depth else below[j]
                    lw[d] = np.logaddexp(kt, under) - np.log(2)
                    stop[d] = np.exp(kt - np.log(2) - lw[d])
            if first and not top:
                self.roots[j] = (self.roots[j][0], lw[first])
                continue
            acc, rem = (np.zeros(len(zeros[0])), np.ones(len(zeros[0]))) if not first else (x[up[first]] for x in top.down[j])
            for d in levels:
                estimate = (ones[d] + 0.5) / (zeros[d] + ones[d] + 1)
                self.one[d][j] = acc + rem * estimate  # in doubles: beside 2**24 zeros and no one, 1 - p is 0 in 32 bits
                acc, rem = acc + rem * stop[d] * estimate, rem * (1 - stop[d])
                if d < self.depth:
                    acc, rem = acc[up[d + 1]], rem[up[d + 1]]
            if below:
                self.down.append((acc, rem))
            if len(deepest):
                at = np.cumsum(np.concatenate([[0], (deepest >> U64(8 - j))[1:] != (deepest >> U64(8 - j))[:-1]]))
                total += self._log(self.one[self.depth][j][at], (deepest >> U64(7 - j)) & U64(1))
        self.keys, self.value = deepest, total.astype(np.float32)
        self.index: HashSet | None = None

    @staticmethod
    def _log(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return np.log10(np.where(bit.astype(bool), p, 1 - p))

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each key after the bytes before it."""
        if self.index is None:
            self.index = HashSet(self.keys)
        at = self.index.find(keys)
        out = np.where(at >= 0, self.value[at] if len(self.value) else 0.0, 0.0).astype(np.float64)
        if len(rest := np.flatnonzero(at < 0)):
            out[rest] = self._path(keys[rest])
        return out

    def _path(self, keys: np.ndarray) -> np.ndarray:
        """Bit by bit from the deepest node that the tree has; a half without any."""
        out = np.zeros(len(keys))
        for j in range(8):
            p, todo = np.full(len(keys), 0.5), np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                nodes = self.nodes[d][j]
                if not len(nodes):
                    continue
                own = (keys[todo] & U64((1 << (8 * d + 8)) - 1)) >> U64(8 - j)
                at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
                hit = nodes[at] == own
                p[todo[hit]] = self.one[d][j][at[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
            out += self._log(p, (keys >> U64(7 - j)) & U64(1))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        keys, n = grams(texts, self.depth)
        return np.add.reduceat(self.logs(keys), np.cumsum(n) - n)


def _levels(keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts of the depths from `least` to `depth`."""
    out = [_summed([keys], [n])]
    for d in range(depth - 1, least - 1, -1):
        out.insert(0, _summed([out[0][0] & U64((1 << 8 * d + 8) - 1)], [out[0][1]]))
    return out


def _subtrees(depth: int, first: int, top=None):
    """Of all grams (key, n) of a task: (j, node, lw) of the roots, node being the parent; with the part above, (key, n, value) of every gram."""

    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in parts if len(b)]
        if not got:
            return
        keys, n = (np.concatenate(x) for x in zip(*got, strict=True))
        tree = Tree(_levels(keys[n > 0], n[n > 0], depth, first), first, top and top.value)
        if top:
            for i in range(0, len(keys), 1 << 16):
                own = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n[i : i + (1 << 16)]), pa.array(tree.logs(own).astype(np.float32))], names=["key", "n", "value"])
            return
        for j, (parents, lw) in enumerate(tree.roots):
            for i in range(0, len(lw), 1 << 16):
                node = parents[i : i + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), j, np.int32)), pa.array(node), pa.array(lw[i : i + (1 << 16)])], names=["j", "node", "lw"])

    return run


class Table:
    """Values by key; the index is made where it is used."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        self.keys, self.value, self.index = keys, value, None

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = HashSet(self.keys)
        return self.index.find(keys)

    def sums(self, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each run of keys, of which `first` has the first and one more at the end: the sum of the values, how many have one, and the keys without."""
        at = self.find(keys)
        got = at >= 0
        runs = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
        ends = np.concatenate([[0], np.cumsum(~got)])[first]
        left = keys[~got].view(np.int64)
        return runs(np.where(got, self.value[at] if len(self.value) else 0.0, 0.0).astype(np.float64)), runs(got), [left[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(np.concatenate(arrays)))


def _score(table, common, depth: int):
    @tidy
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId() << 40, 0
        for b in parts:
            score, tokens, partial, known, rare, far, size = [], [], [], [], [], [], []
            for a, z, data, offs in chunks(b.column(2)):
                keys, n = grams([normal(x) for x in b.column(2).slice(a, z - a).to_pylist()], depth)
                sums, _, left = table.value.sums(keys, np.concatenate([[0], np.cumsum(n)]))
                score.append(sums)
                size.append(n)
                far += left
                s, e, first = spans(low := LOWER[data], offs, NOT_SPACE)
                sums, got, left = common.value.sums(hash_spans(low, s, e), first)
                tokens.append(np.diff(first) + 1)
                partial.append(sums)
                known.append(got)
                rare += left
            n = len(b)
            if not n:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + row + np.arange(n)), b.column(0), b.column(1), pa.array(np.concatenate(tokens).astype(np.int64)), pa.array(np.concatenate(known).astype(np.int64)), pa.array(np.concatenate(partial)), pa.array(np.concatenate(score)), pa.array(np.concatenate(size)), _lists(rare), _lists(far)],
                names=["row", "doc", "held_out", "n_tokens", "known", "partial", "score", "n_bytes", "rare", "far"],
            )
            row += n

    return run


def _threshold(work: Work, table: DataFrame, most: int) -> int:
    """The smallest count that at most `most` rows reach."""
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(F.floor(256 + 32 * (F.log2("n") - 8))).cast("int")
    seen, least = 0, None
    for v, n, low in sorted(table.groupBy(level.alias("v")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low")).collect(), reverse=True):  # 2,300 levels at most
        if seen + n > most:
            return least if least is not None else 1 << 62
        seen, least = seen + n, low
    return 1


def fit(work: Work, texts: DataFrame, *, depth: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """From (text, train): log10 probabilities (key, n, value) of the grams of all texts, n being their training counts, the training words' counts (key, n), and the number of training texts."""
    sc, first = work.spark.sparkContext, min(ROOT, depth)
    counted = work.table(texts.mapInArrow(_count(depth), "kind int, key long, n long"), "counts")
    sums = work.table(counted.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    tasks = max(int(work.spark.conf.get("spark.sql.shuffle.partitions")), 1 + sums.count() // TASK_GRAMS)
    dealt = sums.repartition(tasks, F.expr(f"shiftright(key, 8) & {(1 << 8 * first) - 1}L"))
    top = None
    if first:
        roots = dealt.mapInArrow(_subtrees(depth, first), "j int, node long, lw double").groupBy("j", "node").agg(F.array_sort(F.collect_list("lw")).alias("lw"))  # 256 at most; sorted, so that sums are the same in each run
        under = roots.select("j", "node", F.aggregate("lw", F.lit(0.0), lambda a, x: a + x).alias("lw")).orderBy("j", "node").toArrow()
        level = sums.where("n > 0").groupBy(F.expr(f"key & {(1 << 8 * first) - 1}L").alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 256**ROOT rows at most
        j, lw = under.column("j").to_numpy(), under.column("lw").to_numpy()
        top = Tree(_levels(level.column("key").to_numpy().astype(np.int64).view(np.uint64), level.column("n").to_numpy().astype(np.int64), first - 1, 0), below=[lw[j == i] for i in range(8)])
    whole = _subtrees(depth, first, sc.broadcast(top))
    values = work.table(dealt.mapInArrow(whole, "key long, n long, value float"), "values")
    words = work.table(counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "words")
    return values, words, counted.where("kind = 2").agg(F.sum("n")).first()[0] or 0


def score(docs: DataFrame, train: Column, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, capacity: int = 1 << 20, words: int = 1 << 19) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), one row for each row of docs.

    bits_per_byte is the code length of the text over its n_bytes coded bytes, the end among them.

    Learns from the rows where `train` is true; a null text is empty and has one token, the end.
    Up to `capacity` grams and `words` words are broadcast, the others are joined, to the same result.
    Without training rows every bit costs one bit and base scores are 0.  Rows that repeat an id are scored one by one; other columns are not
    read.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Work(spark, "ctw")
    values, counts, ends = fit(work, docs.select(F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")), depth=depth)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    least = _threshold(work, counts, words)
    got = counts.where(F.col("n") >= least).toArrow()  # `words` rows at most
    common = spark.sparkContext.broadcast(Table(got.column("key").to_numpy().astype(np.int64).view(np.uint64), np.log10(got.column("n").to_numpy() + 1.0)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    schema = "row long, doc long, held_out boolean, n_tokens long, known long, partial double, score double, n_bytes long, rare array<long>, far array<long>"
    often = _threshold(work, values, capacity)
    got = values.where(F.col("n") >= often).toArrow()  # `capacity` rows at most
    table = spark.sparkContext.broadcast(Table(got.column("key").to_numpy().astype(np.int64).view(np.uint64), got.column("value").to_numpy()))
    scored = work.table(rows.mapInArrow(_score(table, common, depth), schema), "scored")
    far = scored.select("row", F.explode("far").alias("key")).join(values.where(F.col("n") < often), "key").groupBy("row").agg(F.sum(F.col("value").cast("double")).alias("further"))
    rare = scored.select("row", F.explode("rare").alias("key")).join(counts.where(F.col("n") < least), "key").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("also"))
    base = F.col("partial") + F.coalesce("more", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    whole = F.col("score") + F.coalesce("further", F.lit(0.0))
    return scored.join(rare, "row", "left").join(far, "row", "left").select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score"), "n_bytes", (whole * float(-np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")
    )


def weighted(scored: DataFrame) -> DataFrame:
    """scored with `score` weighted over two models of the token sequence, the tree and the base, at one half each; `tree_score` is the tree's alone.

    The base takes all words unseen in training for one token; the tree spells them, and a spelling is no likelier than
    that token, so the mean of both is at most the probability of the tokens.  It is never more than log10(2) below either.
    """
    best = F.greatest("score", "base_score")
    mean = best + F.log10((F.pow(F.lit(10.0), F.col("score") - best) + F.pow(F.lit(10.0), F.col("base_score") - best)) / 2)
    return scored.withColumns({"tree_score": F.col("score"), "score": mean})

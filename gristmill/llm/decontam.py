"""Benchmark decontamination by a distributed positional inverted index (operator 9).

The index is partitioned by document: each row is a shard of a few megabytes of whole texts
and holds, term by term, the sorted positions of that term in the shard.  Documents stand
`GAP` positions apart, so no phrase crosses from one into the next.  It is a Parquet table in
the shared folder: written once, read by every block of test items, and no text is shuffled.
Postings of terms that no test item has are left out, by a Bloom filter of the items' terms.

Test items become windows, listed by their rarest term (by counts over the whole index).  In a
shard, the postings of the terms that lead windows give start positions; they are intersected
with the offset-adjusted lists of the windows' other terms, the rarest first, until none is left.
Proximity matches ask for an item's rarest terms within a span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._spark import Work, bloom, in_bloom, tidy
from gristmill.llm._text import ALNUM, LOWER, U64, HashSet, chunks, hash_spans, spans

GAP = 64
SHARD_BYTES = 2 << 20
#: Characters of test items that are looked up at once; more are taken in blocks.
BLOCK_CHARS = 4 << 20
#: Start positions of one shard that are checked at once.
CANDIDATES = 1 << 19
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(texts: pa.Array) -> list[np.ndarray]:
    """Word hashes of each text: A-Z lower-cased, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    out = []
    for _, _, data, offs in chunks(texts):
        data = LOWER[data]
        s, e, first = spans(data, offs, ALNUM)
        h = hash_spans(data, s, e)
        out += [h[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(own := words(b.column(0))):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)).view(np.int64))], names=["term"])


def _build(asked):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            for a, z, data, offs in chunks(b.column(1), SHARD_BYTES):
                data = LOWER[data]
                s, e, first = spans(data, offs, ALNUM)
                h = hash_spans(data, s, e)
                n = np.diff(first)
                at = (np.arange(len(h)) + np.repeat(np.arange(len(n)) * GAP, n)).astype(np.uint32)
                known = in_bloom(asked.value, h)
                h, at = h[known], at[known]
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                own, counts = np.unique(h, return_counts=True)
                one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([no], pa.int32()), one(b.column(0).slice(a, z - a), None), one(n, pa.int32()), one(own.view(np.int64), pa.int64()), one(counts, pa.int32()), pa.array([at.tobytes()], pa.binary())],
                    names=["part", "shard", "docs", "n_words", "terms", "counts", "positions"],
                )
                no += 1

    return run


def build_index(work: Work, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The positional index of docs (doc, text) for the terms of items (item, text)."""
    terms = work.table(items.select("text").mapInArrow(_terms, "term long").distinct(), "terms")
    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"part int, shard int, docs array<{kind}>, n_words array<int>, terms array<bigint>, counts array<int>, positions binary"
    return work.table(docs.mapInArrow(_build(bloom(work.spark, terms)), schema), "index")


class Plan:
    """A block's test items as arrays: its terms; windows by their rarest term, each with its terms and their offsets, the rarest first, and its items; each item's rarest terms."""

    def __init__(self, items: list[tuple[int, str]], size: int, rare_terms: int, count: dict[int, int]):
        texts = [t.encode().lower() for _, t in items]
        said = [_WORD.findall(t) for t in texts]
        hashed = words(pa.array([t for _, t in items], pa.string()))
        flat = np.concatenate([np.zeros(0, U64), *hashed])
        self.terms, term = np.unique(flat, return_inverse=True)
        n = np.array([count.get(t, 0) for t in self.terms.view(np.int64).tolist()], np.int64)
        self.index = None
        windows: dict[bytes, set[int]] = {}
        near = []
        end = 0
        for (item, _), own, spoken in zip(items, hashed, said, strict=True):
            t = term[end : end + len(own)].astype(np.int32)
            end += len(own)
            if not len(t):
                continue
            for i in range(max(1, len(t) - size + 1)):
                windows.setdefault(t[i : i + size].tobytes(), set()).add(item)
            named = dict(zip(t.tolist(), spoken, strict=True))
            rare = sorted(named, key=lambda x: (n[x], named[x]))[:rare_terms]
            if n[rare].all():
                near.append((item, rare + [rare[-1]] * (rare_terms - len(rare))))
        self.length = np.array([len(w) // 4 for w in windows], np.int64)
        self.term = np.full((len(windows), size), -1, np.int32)
        if windows:
            self.term[np.arange(size) < self.length[:, None]] = np.frombuffer(b"".join(windows), np.int32)
        seen = np.where(self.term >= 0, n[self.term] if len(n) else 0, 1 << 62)
        self.off = np.argsort(seen, axis=1, kind="stable")
        self.term = np.take_along_axis(self.term, self.off, axis=1)
        order = np.argsort(self.term[:, 0], kind="stable") if windows else np.zeros(0, np.int64)
        order = order[seen.min(axis=1)[order] > 0] if windows else order
        owners = [sorted(x) for x in windows.values()]
        self.length, self.term, self.off = self.length[order], self.term[order], self.off[order].astype(np.int64)
        self.first = np.searchsorted(self.term[:, 0], np.arange(len(n) + 1))
        self.n_items = np.array([len(owners[w]) for w in order], np.int64)
        self.items = np.array([x for w in order for x in owners[w]], np.int64)
        self.near_item = np.array([x for x, _ in near], np.int64)
        self.near_term = np.array([r for _, r in near], np.int64).reshape(-1, rare_terms)

    def find(self, terms: np.ndarray) -> np.ndarray:
        if self.index is None:
            self.index = HashSet(self.terms)
        return self.index.find(terms)


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 .. of n members, for each run."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Shard:
    """A shard's postings of a plan's terms, as sorted (term, position) keys."""

    def __init__(self, plan: Plan, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        at = plan.find(terms)
        known = np.flatnonzero(at >= 0)
        known = known[np.argsort(at[known])]
        self.terms, self.counts = at[known].astype(np.int64), counts[known].astype(np.int64)
        self.position = positions[_flat((np.cumsum(counts) - counts)[known], self.counts)].astype(np.int64)
        self.key = np.append(np.repeat(self.terms, self.counts) << 32 | self.position, 1 << 62)
        self.start = np.cumsum(self.counts) - self.counts
        self.plan = plan

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First posting and number of postings of each term."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.start[i], np.where(self.terms[i] == terms, self.counts[i], 0)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of the occurrences of whole windows."""
        p = self.plan
        led = p.first[self.terms + 1] - p.first[self.terms]
        window = _flat(p.first[self.terms], led)
        first, n = np.repeat(self.start, led), np.repeat(self.counts, led)
        upto = np.cumsum(n)
        cut = np.unique([0, *np.searchsorted(upto, np.arange(CANDIDATES, upto[-1], CANDIDATES)), len(n)]).tolist() if len(n) else []
        for a, z in zip(cut, cut[1:], strict=False):
            w = np.repeat(window[a:z], n[a:z])
            start = self.position[_flat(first[a:z], n[a:z])] - p.off[w, 0]
            w, start = w[start >= 0], start[start >= 0]
            for j in range(1, p.term.shape[1]):
                key = p.term[w, j].astype(np.int64) << 32 | start + p.off[w, j]
                ok = (j >= p.length[w]) | (self.key[np.searchsorted(self.key, key)] == key)
                w, start = w[ok], start[ok]
                if not len(w):
                    break
            if len(w):
                yield w, start

    def near(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(item number, position) from which `span` words hold all the item's rarest terms, one of them at it."""
        p, out = self.plan, []
        width = p.near_term.shape[1]
        counts = [self.postings(p.near_term[:, j]) for j in range(width)]
        item = np.flatnonzero(np.logical_and.reduce([n > 0 for _, n in counts])) if len(p.near_item) else np.zeros(0, np.int64)
        for first, n in counts if len(item) else ():
            i = np.repeat(item, n[item])
            at = self.position[_flat(first[item], n[item])]
            for j in range(width):
                key = p.near_term[i, j] << 32 | at
                ok = self.key[np.searchsorted(self.key, key)] < key + span
                i, at = i[ok], at[ok]
            out.append((i, at))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (item, item)


def _lists(row: np.ndarray, value: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """The distinct values of each row, in order."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    ends = np.append(np.searchsorted(row, rows), len(row)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value, kind))


def _match(plan, span: int, all_docs: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        for b in batches:
            for r in range(len(b)):
                part, no, docs, n, terms, counts, positions = (b.column(i)[r] for i in range(7))
                n, terms, counts = (x.values.to_numpy() for x in (n, terms, counts))
                shard = Shard(p, terms.view(U64), counts, np.frombuffer(positions.as_buffer(), np.uint32))
                begin = np.cumsum(n, dtype=np.int64) - n + np.arange(len(n)) * GAP
                of = lambda at: np.searchsorted(begin, at, "right") - 1  # noqa: E731, B023
                nothing = np.zeros(0, np.int64)
                hit, item = [(nothing, nothing)], [(nothing, nothing)]
                for w, start in shard.windows():
                    d, k = of(start), p.length[w]
                    hit.append((np.repeat(d, k), _flat(start - begin[d], k)))
                    own = p.n_items[w]
                    item.append((np.repeat(d, own), p.items[_flat((np.cumsum(p.n_items) - p.n_items)[w], own)]))
                hit, item = ([np.concatenate(x) for x in zip(*y, strict=True)] for y in (hit, item))
                which, at = shard.near(span)
                near = (of(at), p.near_item[which])
                rows = np.arange(len(n)) if all_docs else np.unique(np.concatenate([hit[0], near[0]]))
                same = lambda x: pa.array(np.full(len(rows), x.as_py(), np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [same(part), same(no), pa.array(rows.astype(np.int32)), docs.values.take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), _lists(*hit, rows, pa.int32()), _lists(*item, rows, pa.int64()), _lists(*near, rows, pa.int64())],
                    names=["part", "shard", "no", "doc", "n_words", "hits", "items", "near"],
                )

    return run


def find_matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 13, rare_terms: int = 3, span: int = 26, block_chars: int = BLOCK_CHARS, work: Work | None = None) -> DataFrame:
    """(id, n_words, hits, items, near) for each row of docs.

    hits: positions of the words inside any occurrence of a window of `size` consecutive item
    words (all words of a shorter item); items: ids of the items with occurring windows; near: ids
    of the items whose `rare_terms` rarest terms (distinct words by their number in all docs, then by their
    bytes) stand within `span` words.  Null and empty texts
    have no words; very long texts are taken whole; items without words or with a null id match nothing; repeated items match
    alike; rows that repeat an id are rows of their own.  Without items all lists are empty, an empty table of docs gives an
    empty table; other columns, whatever their names, are not read.

    Items are looked up in blocks of about `block_chars` characters, one at a time, so what is broadcast is
    bounded; the blocks' matches are joined by document.  `size` and `span` are at most GAP, the distance at which documents stand in the index.  Tables go to `work`, if given.
    """
    if max(size, span) > GAP:
        raise ValueError(f"size and span are at most {GAP}")
    spark = docs.sparkSession
    work = work or Work(spark, "decontam")
    key = F.col(id_col) if isinstance(docs.schema[id_col].dataType, T.StringType) else F.col(id_col).cast("long")
    docs = docs.select(key.alias("doc"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    index = build_index(work, docs, items)
    counted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    counted = work.table(counted, "counts")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    found = None
    for k in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        own = list(zip(got.column("item").to_pylist(), got.column("text").to_pylist(), strict=True))
        terms = np.unique(np.concatenate([np.zeros(0, U64), *words(got.column("text"))])).view(np.int64)
        asked = spark.createDataFrame([(t,) for t in terms.tolist()], "term long")
        count = {t: n for t, n in counted.join(F.broadcast(asked), "term").collect()}  # the block's terms at most
        plan = spark.sparkContext.broadcast(Plan(own, size, rare_terms, count))
        kind = docs.schema["doc"].dataType.simpleString()
        one = index.mapInArrow(_match(plan, span, k == 0), f"part int, shard int, no int, doc {kind}, n_words bigint, hits array<int>, items array<bigint>, near array<bigint>")
        if blocks > 1:  # one block at a time: its matches are written, then its plan is let go
            one = work.table(one, f"found{k}")
            plan.destroy()
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("part", "shard", "no").agg(F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), merged("hits"), merged("items"), merged("near"))
    return found.select(F.col("doc").alias(id_col), "n_words", "hits", "items", "near")

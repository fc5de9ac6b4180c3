"""Periodic run detection by harmonic grid probing (operator 11).

A stretch of words that repeats with period p for at least `exponent` rounds holds exponent - 1
neighbouring multiples jp of p with word jp equal to word (j + 1)p.  So for each p only the grid
0, p, 2p, ... is read (n/p words; n log n over all periods); where enough neighbouring grid points
agree, the stretch is extended to both sides by comparing slices.  Grid points whose whole step
lies inside a run found before, with a period that divides p, are skipped: a run through them
would have that smaller period.

A task lays the texts of a chunk end to end, parted by words that equal no other, so a grid
serves all of them at once.  Nothing is shuffled.  Words are compared by 63-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gristmill.llm._spark import batches, tidy
from gristmill.llm._text import NOT_SPACE, U64, chunks, hash_spans, spans

#: Words compared by the first slice of an extension, and by any; a slice is twice as long as the one before it.
SLICE = (64, 1 << 16)


def _right(w: np.ndarray, i: int, p: int) -> int:
    """The first place from i on where the word differs from that p further on (or there is none)."""
    end, step = len(w) - p, SLICE[0]
    while i < end:
        n = min(step, end - i)
        differ = w[i : i + n] != w[i + p : i + p + n]
        if differ[k := int(differ.argmax())]:
            return i + k
        i, step = i + n, min(2 * step, SLICE[1])
    return end


def _left(w: np.ndarray, i: int, p: int) -> int:
    """The first place of the stretch up to i in which each word equals that p further on."""
    step = SLICE[0]
    while i > 0:
        n = min(step, i)
        differ = (w[i - n : i] != w[i - n + p : i + p])[::-1]
        if differ[k := int(differ.argmax())]:
            return i - k
        i, step = i - n, min(2 * step, SLICE[1])
    return 0


def find(w: np.ndarray, longest: int, least: int, exponent: int) -> np.ndarray:
    """(start, length, period) rows, in any order, of the runs of a word array in which no run is longer than `longest`."""
    found: list[tuple[int, int, int]] = []
    due: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # runs by the next multiple of their period
    for p in range(1, longest // exponent + 1):
        grid = w[::p]
        hit = grid[1:] == grid[:-1]
        for start, end, q in due.pop(p, ()):
            hit[-(-start // p) : (end - 1) // p] = False
            if start + p + q < end:
                due[p + q].append((start, end, q))
        many = hit
        for k in range(1, exponent - 1):
            many = many[:-1] & hit[k:]
        at = np.flatnonzero(many) * p
        k = 0
        while k < len(at):
            first, after = _left(w, int(at[k]), p), _right(w, int(at[k]), p)
            if after - first >= (exponent - 1) * p and after - first + p >= least:
                found.append((first, after - first + p, p))
                due[2 * p].append((first, after + p, p))
            k = max(k + 1, int(np.searchsorted(at, after)))
    return np.array(found, np.int64).reshape(-1, 3)


def _collapsed(data: np.ndarray, s: np.ndarray, e: np.ndarray, of: np.ndarray, keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words, joined by single spaces within each text."""
    out = data.copy()
    s, e, of = s[keep], e[keep], of[keep]
    later = np.flatnonzero(of[1:] == of[:-1]) + 1  # a word before it is kept, so a white-space byte stands before it
    out[s[later] - 1] = 0x20
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, e, -1)
    begin = s.copy()
    begin[later] -= 1
    np.add.at(edge, begin, 1)
    held = np.cumsum(edge[:-1]) > 0
    return out[held], np.concatenate([[0], np.cumsum(held)])[offs]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(at: int, least: int, exponent: int, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(at)):
                s, e, first = spans(data, offs, NOT_SPACE)
                rows, n = hi - lo, np.diff(first)
                of = np.repeat(np.arange(rows), n)
                # words are odd numbers, what parts two texts are even ones
                w = np.empty(len(s) + rows, U64)
                place = np.arange(len(s)) + of
                w[place] = hash_spans(data, s, e) | U64(1)
                w[first[1:] + np.arange(rows)] = 2 * np.arange(rows, dtype=U64)
                found = find(w, int(n.max(initial=0)), least, exponent)
                found = found[np.lexsort((found[:, 2], found[:, 0]))]
                whose = np.searchsorted(first[1:] + np.arange(1, rows + 1), found[:, 0], "right")
                start, length, period = found.T
                drop = np.zeros(len(w) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                text, ends = _collapsed(data, s, e, of, np.cumsum(drop)[place] == 0, offs)
                each = pa.StructArray.from_arrays([pa.array(start - first[whose] - whose), pa.array(length), pa.array(period)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(rows + 1)), pa.int32()), each)
                texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text.tobytes()))
                cols = [*b.slice(lo, rows).columns, pa.array(n, pa.int64()), runs, texts]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def find_runs(docs: DataFrame, *, text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """docs with n_words, runs (array of start, length, period, by start, then period) and collapsed.

    Words are stretches without ASCII white space, numbered from 0.  A run is a stretch of words
    with smallest period q and a length of at least `least` and `exponent` q (exponent 2 or more)
    that no neighbouring word extends keeping that period.  `collapsed` is the text without the
    words that a run holds after its first q, joined by single spaces.

    Null and empty texts have no words, no runs and an empty `collapsed`.  Runs may overlap; the same text always has
    the same runs, repeated rows and ids included.  Texts are taken whole, however long.  Input columns of the three new
    names are replaced, all others stay, whatever their names.  An empty table gives an empty table.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    batches(docs.sparkSession)
    docs = docs.drop("n_words", "runs", "collapsed")
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # whatever the names
    return rows.mapInArrow(_batch(docs.columns.index(text_col), least, exponent, to_arrow_schema(out)), out)

"""Periodic runs and importance resampling against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import queries, resample, runs
from gristmill.llm._text import U64
from tests.llm.test_llm_operators import corpus, frame

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(t):
    return [w.decode() for w in (t or "").encode().split()]  # of bytes: ASCII white space only


def brute_runs(w, least=6, exponent=4):
    """By the definition, period by period."""
    n, out = len(w), set()
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                piece = w[i : i + length]
                if not any(all(piece[x] == piece[x + q] for x in range(length - q)) for q in range(1, p)):
                    out.add((i, length, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(seed=5):
    """Texts with one or several loops, nested loops, whole-text loops, and loops that end at another text's words."""
    rng = random.Random(seed)
    out = []
    for i in range(80):
        w = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            loop = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            if i % 3 == 0:
                loop = [*loop[:1] * 8, *loop]  # a run within the loop
            at = rng.randint(0, len(w))
            n = rng.randint(3 * len(loop), 7 * len(loop))
            w[at:at] = (loop * 8)[:n]
        out.append((i, rng.choice([" ", "\n", " \t\r\x0b\x0c "]).join(w)))
    return out


@pytest.mark.parametrize("exponent", [2, 3, 4, 7])
def test_runs(spark, exponent):
    rows = [*corpus(), *periodic(), (900, "é É é É é É é É"), (901, "a a a a a a a a x"), (902, "x " * 5), (903, "x " * 6), (None, "loop it " * 9), (904, " \n")]
    docs = frame(spark, rows).withColumns({"runs": F.lit("clash"), "n_words": F.lit(-1), "c0": F.lit(1), "start": F.lit(2)})
    got = runs.find_runs(docs, exponent=exponent).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r["text"])
        want = brute_runs(w, 6, exponent)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["n_words"] == len(w)
        assert r["collapsed"] == collapsed(w, want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 5))
def test_find(w, exponent):
    found = runs.find(np.array(w, U64), len(w), 6, exponent)
    assert sorted(map(tuple, found.tolist()), key=lambda r: (r[0], r[2])) == brute_runs(w, 6, exponent)


def test_long_text(spark):
    """Longer than any batch: one word 2.5 million times, and a loop of 1,000 words."""
    rng = random.Random(3)
    loop = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1000))
    rows = [(1, "ab " * 2_500_000), (2, "start " + f"{loop} " * 700 + "end"), (3, "none")]
    got = {r["doc_id"]: r for r in runs.find_runs(frame(spark, rows)).select("doc_id", "runs", "n_words", F.length("collapsed").alias("n")).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 2_500_000, 1)] and got[1]["n"] == 2
    assert [tuple(x) for x in got[2]["runs"]] == [(1, 700_000, 1000)] and got[2]["n"] == len(f"start {loop} end")
    assert got[3]["runs"] == [] and got[3]["n"] == 4


def test_runs_empty_table(spark):
    got = runs.find_runs(frame(spark, []))
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and got.collect() == []
    with pytest.raises(ValueError, match="twice"):
        runs.find_runs(got, exponent=1)


def test_looped(spark):
    rows = corpus(n=400)
    got = frame(spark, rows).select("doc_id", "text", queries.looped(F.col("text"), F.col("doc_id")).alias("out")).collect()
    some = 0
    for i, t, out in got:
        h = None if i is None else zlib.crc32(str(i).encode())
        w = words_of(t)
        if h is None or t is None or h % 10:
            assert (out or None) == (t or None)
            continue
        if w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if j < a else w[a + (j - a) % p] for j, x in enumerate(w)]
            some += 1
        assert words_of(out) == w
    assert some > 10


def tokens(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def brute_resample(rows, target, ngrams=1, buckets=10000, percent=10, least=20, seed=2024):
    """(id, n_words, n_features, weight, score, rank) of each row."""

    def feats(t):
        w = tokens(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, ngrams + 1) for i in range(len(w) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in feats(x):
            s[f] += 1
    for x in target:
        for f in feats(x):
            t[f] += 1
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + buckets)) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for n, (i, x) in enumerate(rows):
        f = feats(x)
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(tokens(x)), len(f), weight, score, None, n])
    able = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], r[6]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return [tuple(r[:6]) for r in out]


FIELDS = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize(("ngrams", "percent", "least"), [(1, 10, 20), (2, 50, 3), (3, 100, 0)])
def test_resample(spark, ngrams, percent, least):
    rows = [*corpus(), *corpus(7), (5, "same row " * 12), *[(5, "same row " * 12)] * 30, (-(2**63), "first id " * 15), (2**63 - 1, "last id " * 15), (4000, "ÀÉ À1 x_y" * 20)]
    target = [t for _, t in corpus(2, 24)]
    docs = frame(spark, rows).withColumns({"score": F.lit("clash"), "c0": F.lit(1), "row": F.lit(2), "id": F.lit(3)})
    got = resample.resample(docs, frame(spark, [(0, t) for t in target]), ngrams=ngrams, buckets=500, percent=percent, min_words=least)
    assert got.columns == ["doc_id", "c0", "row", "id", "n_words", "n_features", "weight", "score", "rank"]
    have, want = [tuple(r) for r in got.select(FIELDS).collect()], brute_resample(rows, target, ngrams, 500, percent, least)
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_resample_edges(spark):
    empty = frame(spark, [])
    assert resample.resample(empty, empty).collect() == []
    rows = [(i, "some words of a text " * 5) for i in range(9)]  # a tenth of nine is none
    got = resample.resample(frame(spark, rows), empty).select(FIELDS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_resample(rows, []), key=repr) and all(r["rank"] is None for r in got)


def test_resample_long_texts(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(["w" * 200, "b", "cc", "x" * 63]) for _ in range(120_000))  # 8 MB
    rows = [(1, long), (2, "x" * 5_000_000), *((i, f"b cc {i} " * 10) for i in range(3, 40))]
    got = resample.resample(frame(spark, rows), frame(spark, [(0, "cc b")])).select(FIELDS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_resample(rows, ["cc b"]), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=140), max_size=20))
def test_crc32(parts):
    data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)
    got = resample.crc32(data, ends - np.array([len(p) for p in parts], np.int64), ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_select_key(spark):
    """Every k of a table of ties and extreme numbers, and numbers beyond both ends."""
    rng = random.Random(2)
    wide = [-(2**63), 2**63 - 1, 0, -1, 70_000, 65_536, *(rng.randint(-(2**40), 2**40) for _ in range(8))]
    keys = list({(rng.choice(wide), rng.choice([*wide, 5]), i) for i in range(60)})
    words = [("a", True), ("b", False), ("c", False)]
    table = spark.createDataFrame(keys, "a long, b long, c long").coalesce(1).cache()
    order = sorted(keys, key=lambda x: (-x[0], x[1], x[2]))
    for k in (1, 2, 17, 59, 60):
        key = resample.select_key(table, words, k)
        assert key == order[k - 1]
        assert table.where(resample.up_to(words, key)).count() == k
    assert resample.select_key(table, words, 61) is None
    assert resample.select_key(table.where("false"), words, 1) is None

"""Bootstrap of real-valued means against a plain resampling by the same picks, and its distribution over several blocks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import attempts, bootstrap


def plain(values, draws, seed):
    v = np.sort(np.array(values, float))
    n = len(v)
    means = [v[bootstrap.picks(seed, np.full(n, d), 0, np.arange(n), n)].mean() for d in range(draws)]
    return n, v.mean(), *np.quantile(means, [0.025, 0.975])


def test_groups(spark):
    rng = random.Random(5)
    groups = {("a", 1): [rng.gauss(0, 1) for _ in range(300)], ("a", 2): [rng.choice([-1.0, 0.0, 0.25]) for _ in range(1000)], (None, 1): [0.5], ("b", 1): [3.0] * 40}
    rows = [(*k, x) for k, xs in groups.items() for x in [*xs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "x string, y int, v double").repartition(7)
    got = {(r["x"], r["y"]): tuple(r)[2:] for r in bootstrap.bootstrap_means(df, "v", 400, 9, ["x", "y"]).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        assert got[k] == pytest.approx(plain(xs, 400, 9), abs=1e-12)
    again = bootstrap.bootstrap_means(df.coalesce(1), "v", 400, 9, ["x", "y"]).collect()
    assert all(tuple(r)[2:] == pytest.approx(got[r["x"], r["y"]]) for r in again) and len(again) == 4


def test_no_differences(spark):
    none = spark.createDataFrame([], "v double")
    assert tuple(bootstrap.bootstrap_means(none, "v", 10, 1).first()) == (0, None, None, None)
    assert bootstrap.bootstrap_means(none.withColumn("x", F.lit(1)), "v", 10, 1, ["x"]).collect() == []


@pytest.mark.parametrize(("block", "rows"), [(64, 1 << 20), (64, 4), (1 << 16, 4)])
def test_blocks_keep_the_distribution(spark, monkeypatch, block, rows):
    """Several blocks, picked by rows or split by values: the interval is that of the theory."""
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(2, 3, 5000), 3)
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    monkeypatch.setattr(bootstrap, "ROWS", rows)
    work = bootstrap._work
    monkeypatch.setattr(bootstrap, "_work", lambda *a: _patched(work, a, rows))
    r = bootstrap.bootstrap_means(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", 3000, 7).first()
    half = 1.96 * values.std() / len(values) ** 0.5
    assert r["n"] == 5000 and r["mean"] == pytest.approx(values.mean())
    assert r["low"] == pytest.approx(values.mean() - half, abs=half / 10) and r["high"] == pytest.approx(values.mean() + half, abs=half / 10)


def _patched(work, args, rows):
    inner = work(*args)

    def run(batches):
        bootstrap.ROWS = rows  # in the worker
        yield from inner(batches)

    return run


def test_groups_of_one_size_share_their_picks(spark, monkeypatch):
    """The picks of a draw are made once for all groups of one size, and are those of each alone."""
    rng = np.random.default_rng(2)
    members = [(np.sort(rng.normal(0, 1, k)), np.full(k, 120 // k)) for k in (1, 3, 120)]
    made = []
    upto = bootstrap._upto
    monkeypatch.setattr(bootstrap, "_upto", lambda seed, draw, n: made.append(len(draw)) or upto(seed, draw, n))
    monkeypatch.setattr(bootstrap, "AT_ONCE", 1000)
    got = bootstrap._shared(20260922, 5, 400, 120, members)
    want = [bootstrap._sums(20260922, 400, 5, 400, 0, np.array([120]), v, c) for v, c in members]
    assert sum(made) == 395 and np.allclose(got, want, rtol=1e-12, atol=1e-12)
    n = 70_001
    ranks = bootstrap.picks(3, np.full(n, 9), 0, np.arange(n), n)
    assert (bootstrap._upto(3, np.array([9]), n)[0] == np.cumsum(np.bincount(ranks, minlength=n))).all()
    df = spark.createDataFrame([(str(i % 3), float(x)) for i, x in enumerate(rng.normal(0, 1, 90))], "x string, v double")
    alone = [tuple(bootstrap.bootstrap_means(df.where(F.col("x") == x), "v", 50, 9).first()) for x in "012"]
    monkeypatch.setattr(bootstrap, "BLOCK", 40)  # three packs
    rows = {r["x"]: tuple(r)[1:] for r in bootstrap.bootstrap_means(df, "v", 50, 9, ["x"]).collect()}
    assert all(rows[x] == pytest.approx(alone[int(x)], abs=1e-12) for x in "012")


def test_shares_add_up():
    sizes = np.array([5, 1, 100, 3, 40, 7, 9])
    shares = np.array([bootstrap._share(3, sizes, b, 500) for b in range(len(sizes))])
    assert (shares.sum(axis=0) == sizes.sum()).all()
    assert np.abs(shares.mean(axis=1) / sizes - 1).max() < 0.15


def test_picks_are_even():
    """Chi-square of the picks of many draws, of neighbouring draws' differences, and of neighbouring picks."""
    n = 50
    x = bootstrap.picks(20260922, np.arange(4000)[:, None], 0, np.arange(n)[None, :], n)
    pairs = (x[:, 1:] * n + x[:, :-1]).ravel()
    for got, size in ((x.ravel(), n), ((x[1:] - x[:-1]).ravel() % n, n), (pairs, n * n)):
        counts = np.bincount(got, minlength=size)
        want = counts.sum() / size
        chi = ((counts - want) ** 2 / want).sum()
        assert abs(chi - size) < 5 * (2 * size) ** 0.5


def test_outcomes_have_few_values(spark):
    with pytest.raises(ValueError, match="distinct"):
        attempts.paired_bootstrap(spark.range(300), "id", 10, 1)


def test_outcomes_share_their_picks(spark):
    """Several outcomes of the same rows: one pass of picks, and each the interval that it has alone."""
    rows = [(i % 3 - 1, 1 if i % 5 == 0 else 0, 0.25 if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    both = attempts.paired_bootstraps(df, ["a", "b", "c"], 100, 3)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    got = {r["value"]: tuple(r)[1:] for r in both.collect()}
    assert got == {c: tuple(attempts.paired_bootstrap(df, c, 100, 3).first()) for c in "abc"}
    values = sorted(r[0] for r in rows)
    draw = lambda d: [values[int(hashlib.sha256(f"3|{d}|{i}".encode()).hexdigest()[:8], 16) % 200] for i in range(200)]
    assert got["a"][2:] == pytest.approx(tuple(np.quantile([np.mean(draw(d)) for d in range(100)], [0.025, 0.975])))
    assert [tuple(r) for r in attempts.paired_bootstraps(df.limit(0), ["a"], 10, 1).collect()] == [("a", 0, None, None, None)]

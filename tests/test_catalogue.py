"""Each registered query with SQL equals DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from gristmill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def same(x, y):
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) if isinstance(x, float) and isinstance(y, float) else x == y


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = query(spark, SF)
    columns = sorted(got.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(([r[names.index(c)] for c in columns] for r in res.fetchall()), key=repr)
    have = sorted(([r[c] for c in columns] for r in got.collect()), key=repr)
    assert len(have) == len(want)
    assert all(same(x, y) for a, b in zip(have, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_rows_only(spark):
    assert catalogue.QUERIES["note_rules"](spark, SF).count() > 0 and catalogue.QUERIES["strict_json_answers"](spark, SF).count() > 0


def test_shard_coverage_sorts_no_lines(spark, tmp_path):
    """Orders of 1, 4 and 9 lines and lines without an order: counted by order, no window over the lines."""
    orders = [1] + [2] * 4 + [3] * 9 + [None] * 2
    rows = [(o, i, 1, 1) for i, o in enumerate(orders)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalogue.QUERIES["shard_coverage"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == [(0, 6, 3), (1, 4, 2), (2, 3, 2), (3, 3, 2)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_note_rules_are_dealt_out(spark):
    """A file of one block is judged in as many tasks as a shuffle has."""
    assert catalogue.QUERIES["note_rules"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

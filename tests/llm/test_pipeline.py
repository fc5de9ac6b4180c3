"""The pipeline against brute force: every stage's decisions, row by row, on a fixture with null and shared ids, copies and empty texts."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import quality, queries, sentencepiece_codec
from tests.llm.test_llm_operators import found_in, lines_of, shingles, viterbi

pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no tokenizer file here")
SCHEMA = "doc_id long, text string, lang string, n_chars long"


def rows_and_items():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, passage = [text(12) for _ in range(2)], text(30)
    rows = []
    for i in range(120):
        kind = i % 8
        if kind < 3:
            t = text(60)
        elif kind == 3:
            t = text(30) + "\n" + rng.choice(shared) + "\n" + text(30)
        elif kind == 4:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            t = " ".join([*w[:-1], "edit"])
        elif kind == 5:
            t = text(40) + " " + passage + " " + text(40)
        elif kind == 6:
            t = text(700) + " " + passage.upper()
        else:
            t = ["!!! ### $$$ " * 20, "", " \n ", "%%%% " * 50][i // 8 % 4]
        rows.append((i, t))
    near = rows[0][1] + " more"
    rows += [(None, None), (None, near), (None, near), (None, near + " x"), (5, rows[5][1]), (5, "of a shared id " + text(50)), (13, "x y " + passage), (13, text(50)), (None, passage), (None, text(40))]
    return rows, [(1, passage), (2, "never said anywhere in these documents"), (3, None)]


def kept_by_brute_force(spark, rows, items, labels):
    """The rows (id, text) that four stages keep."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    c = np.concatenate([x for _, _, x in quality.counts(pa.array([t for _, t in rows], pa.string()))])
    v = (quality._weighted(c, model.idf) - model.mean) @ model.axes
    sim = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)) @ model.vectors.T
    score = []
    for s in sim:
        near = sorted(range(len(s)), key=lambda j: -s[j])[:15]
        score.append(np.average(model.label[near], weights=np.maximum(s[near], 1e-6).astype(float) ** 4))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= 0.3]
    rows = [(i, t) for (i, _, _, t), n in lines_of(rows, 40, 5).items() for _ in range(n)]
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i) if sets[i] else ("alone", r), []).append(r)
    items = [(i, t) for i, t in items if t]
    clean = lambda r: next(not k[2] or 20 * len(k[2]) < k[1] for k in found_in([r], items, 13))
    return groups, clean


def test_against_brute_force(spark, tmp_path):
    rows, items = rows_and_items()
    labels = [(i, int(i % 8 != 7)) for i in range(120)]
    full = [(i, t, f"l{k}", len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    groups, clean = kept_by_brute_force(spark, rows, items, labels)
    out = pipeline.run(spark, str(tmp_path)).collect()
    m = sentencepiece_codec.model_of(queries.PIECES)
    got = Counter((r["doc_id"], m.decode([bytes(r["ids"])])[0]) for r in out)
    assert all(r["exact"] for r in out)
    # one row of each group, of its smallest id (none: any of its rows), if that row is clean
    want = 0
    for rows_of in groups.values():
        ids = [i for i, _ in rows_of if i is not None]
        best = {(i, t or "") for i, t in rows_of if i == (min(ids) if ids else None)}
        found = sum(got[r] for r in best)
        assert found <= 1 and all(got[i, t or ""] == 0 for i, t in rows_of if (i, t or "") not in best)
        if len(best) == 1:
            assert found == clean(next(iter(best)))
        want += found
    assert want == len(out) and 20 < want < len(rows) - 40
    for r in out[:10]:
        assert np.frombuffer(r["ids"], m.dtype).tolist() == viterbi(m, m.decode([bytes(r["ids"])])[0])[1]


def test_null_and_shared_ids(spark, tmp_path):
    """A null id neither saves a contaminated row nor a near copy, and a shared id condemns nobody."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, near = text(20), text(60)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, passage, "kept_key", 1), (7, passage + " x", "", 1), (7, text(30), "", 1)], SCHEMA).withColumnRenamed("lang", "bad_key")
    left = pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [7] and passage not in left.first()["text"]
    docs = spark.createDataFrame([(None, near, "", 1), (None, near + " y", "", 1), (None, near + " z", "", 1), (None, text(40), "", 1), (3, "a", "", 1), (3, "b", "", 1), (3, "b", "", 1)], SCHEMA).withColumnRenamed("lang", "kept_key")
    left = pipeline.near_dup_stage(spark, docs, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in left) == {None: 2, 3: 2} and sum(near in r["text"] for r in left) == 1


def test_empty(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0

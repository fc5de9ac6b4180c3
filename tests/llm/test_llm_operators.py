"""The first ten operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import os
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import _spark, _text, ctw, decontam, jaccard, licenses, line_dedup, quality, queries, sentencepiece_codec, token_output, topk, url_filter

needs_pieces = pytest.mark.skipif(not os.path.exists(queries.PIECES), reason="no tokenizer file here")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared lines, nulls, empties, and one long text; ids repeat and may be null."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(20) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            t = text(rng.randint(1, 60))
        elif kind == 1:
            t = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            w = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            w[rng.randrange(len(w))] = "edit"
            t = " ".join(w)
        elif kind == 3:
            t = text(10) + "\n" + rng.choice(shared).upper() + " \n" + text(8)
        elif kind == 4:
            t = "\t" + rng.choice(shared) + "\n\n" + rng.choice(shared)
        else:
            t = [None, "", "  \n ", "a", text(2000), text(4)][i // 6 % 6]
        rows.append((i, t))
    return [*rows, (3, rows[3][1]), (7, "another text of the same id"), (None, "no id"), (None, rows[9][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).withColumns({"n": F.lit("clash"), "score": F.lit("clash"), "ids": F.lit("clash"), "lang": F.lit(None).cast("string")})


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


# ------------------------------------------------------------------ kernels
def test_word_hashes_follow_words():
    rows = ["A bB  c", None, "", "c\x0bé é", "x" * 1000]
    out = []
    for _, _, data, offs in _text.chunks(pa.array(rows), limit=8):
        low = _text.LOWER[data]
        s, e, first = _text.spans(low, offs, _text.NOT_SPACE)
        h = _text.hash_spans(low, s, e)
        out += [(bytes(low[a:b]), int(x)) for a, b, x in zip(s, e, h, strict=True)]
    assert [w for w, _ in out] == [w for t in rows for w in (t or "").encode().lower().split()]
    assert len({h for _, h in out}) == len({w for w, _ in out})


def test_hash_set():
    keys = np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64)
    t = _text.HashSet(keys)
    assert (t.find(keys) == np.arange(5000)).all() and (t.find(keys + np.uint64(1)) == -1).mean() > 0.99
    assert (_text.HashSet(keys[:0]).find(keys) == -1).all()


@pytest.mark.parametrize("local", [0, 1000])
def test_components(spark, local):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 7] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[root(a)] = root(b)
    work = _spark.Work(spark, "test")
    got = {r["node"]: r["comp"] for r in _spark.components(work, spark.createDataFrame(edges, "a long, b long"), "c", local).collect()}
    groups = lambda f, nodes: {frozenset(y for y in nodes if f(y) == f(x)) for x in nodes}
    assert set(got) == set(up) and groups(got.get, list(got)) == groups(root, list(up))


# ------------------------------------------------------------------ 1 token output
def test_feistel():
    for size in (1, 2, 3, 10, 257, 1000):
        f = token_output.Feistel(size, 7)
        s = f.slots(np.arange(size))
        assert sorted(s.tolist()) == list(range(size)) and (f.numbers(s) == np.arange(size)).all()
    assert (token_output.Feistel(1000, 7).slots(np.arange(1000)) != token_output.Feistel(1000, 8).slots(np.arange(1000))).mean() > 0.9


@needs_pieces
def test_token_output(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    shards = token_output.materialise(docs, queries.PIECES, path, seq_len=16, shard_slots=8)
    m = sentencepiece_codec.model_of(queries.PIECES)
    want = Counter()
    for i, t in corpus():
        ids = m.encode([t])[0].tolist()
        ids += [2] if ids else []
        for k in range(0, len(ids), 16):
            want[i, k // 16, len(ids[k : k + 16]), tuple(ids[k : k + 16] + [0] * (16 - len(ids[k : k + 16])))] += 1
    got = token_output.sequences(shards).collect()
    assert Counter((r["doc"], r["seq"], r["n_tokens"], tuple(np.frombuffer(r["record"], m.dtype).tolist())) for r in got) == want
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all(r["first_slot"] == 8 * r["shard"] and len(r["payload"]) == r["n_slots"] * 32 for r in shards.collect())
    by = {r["slot"]: bytes(r["record"]) for r in got}
    part = token_output.read_slots(spark, path, 5, 9, shard_slots=8).collect()
    assert [(r["slot"], bytes(r["record"])) for r in part] == [(s, by[s]) for s in range(5, 14)]
    assert token_output.materialise(docs.limit(0), queries.PIECES).count() == 0
    # the order follows from the rows and the key, not from partitions
    slots = lambda df: sorted((r["slot"], str(r["doc"]), r["seq"], bytes(r["record"])) for r in token_output.sequences(token_output.materialise(df, queries.PIECES, seq_len=16, shard_slots=8)).collect())
    want = slots(docs)
    assert want == sorted((r["slot"], str(r["doc"]), r["seq"], bytes(r["record"])) for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert slots(docs.repartition(7)) == want and slots(docs.orderBy(F.rand(3)).coalesce(1)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# ------------------------------------------------------------------ 2 quality
def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "was", "slow", "and", "green", "under", "trees"]) for _ in range(40)) + "."
    rows = [(i, good() if i % 3 else (good().upper().replace(" ", "!! ") if i % 2 else "spam " * 40)) for i in range(300)]
    rows += [(900, None), (901, ""), (None, good()), (0, rows[0][1])]
    docs = frame(spark, rows).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, n_fit=200, rank=16)
    out = quality.classify(docs, model)
    got = out.collect()
    assert len(got) == len(rows) and set(out.columns) == {"doc_id", "text", "score"} and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    # the vote against brute force
    (_, _, c), *_ = quality.counts(pa.array([rows[0][1], rows[1][1]]))
    v = (quality._weighted(c, model.idf) - model.mean) @ model.axes
    sim = v @ model.vectors.T / np.linalg.norm(v, axis=1, keepdims=True)
    near = [sorted(range(len(model.label)), key=lambda j: -s[j])[:5] for s in sim]
    want = [np.average(model.label[n], weights=np.maximum(s[n], 1e-6).astype(float) ** 4) for n, s in zip(near, sim, strict=True)]
    assert np.allclose(model.score(c, 5), want, atol=1e-4)
    assert {r["score"] for r in quality.classify(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0
    # labels of ids that docs lacks take no place in the sample; held-out labels move no score
    strangers = spark.createDataFrame([(i, 1) for i in range(5000, 6000)], "doc_id long, quality int")
    turned = labels.where("crc32(cast(doc_id as string)) % 5 <> 0").union(labels.where("crc32(cast(doc_id as string)) % 5 = 0").selectExpr("doc_id", "1 - quality"))
    for other in (labels.union(strangers), turned):
        again = quality.classify(docs, quality.fit(docs.repartition(3), other, n_fit=200, rank=16)).collect()
        assert sorted((str(r["doc_id"]), str(r["text"]), round(r["score"], 4)) for r in again) == sorted((str(r["doc_id"]), str(r["text"]), round(r["score"], 4)) for r in got)


# ------------------------------------------------------------------ 3 licences
def test_licenses(spark):
    plain = ["zu und die", "", "the license of her car", "a b c d e f g"]
    rows = [(1, "x y\nReleased under the MIT License.\nz"), (2, "Licensed under the Apache License, Version 2.0."), (3, "\n".join(plain)), (4, None), (5, ""), (6, "intro: this work is licensed under the gnu general public license, version 3."), (None, "Licensed under CC BY-NC 4.0.\n"), (8, "word " * 5000 + "\nReleased under the MIT License.")]
    docs = frame(spark, rows).withColumn("families", F.lit("clash"))
    model = licenses.fit(frame(spark, [(i, f"{a} {b} {c} text") for i, (a, b, c) in enumerate(zip("abcdefgh" * 4, "ijklmnop" * 4, "qrstuvwx" * 4, strict=True))]))
    got = {r["doc_id"]: r for r in licenses.scan(docs, model).collect()}
    assert model.held_accuracy > 0.9
    assert [got[i]["families"] for i in (1, 2, 3, 4, 5, 6, None, 8)] == [["mit"], ["apache"], [], [], [], ["gpl"], ["cc-by-nc"], ["mit"]]
    assert [got[i]["n_paragraphs"] for i in (1, 3, 4, 5, None)] == [1, 2, 1, 1, 1] and got[1]["at"] == [0] and got[8]["at"] == [0]
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_licenses_by_paragraph(spark):
    """Wrapped notices, several families in a paragraph, licences of no family here, and likely prose."""
    model = licenses.fit(frame(spark, [(i, f"{a} {b} {c} text") for i, (a, b, c) in enumerate(zip("abcdefgh" * 4, "ijklmnop" * 4, "qrstuvwx" * 4, strict=True))]))
    rows = [
        (1, "some words\n\nPermission is hereby granted, free of charge,\n   to any person obtaining a copy\n of this software and\nassociated documentation files.\n \t\nmore words"),
        (2, "Released under the MIT License. " + "plain words of no use here " * 20 + "Licensed under the Apache License, Version 2.0."),
        (3, "This work is licensed under the Zorblax Frobnitz License, version 7."), (4, "She has a driving license and he is under the table."),
        (5, "This work is licensed under the GNU Lesser General Public License, version 3."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows), model).collect()}
    assert got[1]["n_paragraphs"] == 3 and got[1]["at"] == [1] and got[1]["families"] == ["mit"]
    assert got[2]["at"] == [0, 0] and got[2]["families"] == ["apache", "mit"]
    assert [got[i]["families"] for i in (3, 4, 5)] == [["unknown"], [], ["lgpl"]]


def test_licenses_brute_force():
    """Stretches and scores against a plain loop over each paragraph's words."""
    model = licenses.Classifier(["red green blue", "a walk by the river under old trees"])
    texts = ["Released under the MIT License.", "one two\n \n" + "word " * 57 + "Licensed under CC BY 4.0.", "", "x"]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        starts, n = licenses._paragraphs(data, np.array([0, len(data)]))
        _, chance = model.judge(data, starts, 0.7, 0.6)
        parts = re.split(r"\n\s*\n", t)
        assert n.tolist() == [len(parts)]
        for part, got in zip(parts, chance, strict=True):
            words, best = re.findall(r"[0-9a-z]+", part.lower()), 0.0
            for i in {0, *range(0, max(1, len(words) - 20), 10), max(0, len(words) - 20)}:
                f, _ = model._features([" ".join(words[i : i + 20])])
                w = model.weights.astype(float).copy()
                w[0] = 0
                if words:
                    best = max(best, 1 - model._softmax((w[model.column[f]].sum(axis=0) / math.sqrt(len(f)) + model.weights[0])[None])[0, 0])
            assert math.isclose(got, best, rel_tol=1e-6, abs_tol=1e-9)


def test_licenses_inside_long_lines(spark):
    rng = np.random.default_rng(3)
    plain = [" ".join(f"{'abcdefghij'[i]}{'klmnopqrst'[k]}" for i, k in rng.integers(0, 10, (250, 2))) for _ in range(2)]
    cases = [(f, t) for f in licenses.FAMILIES[2:] for t in licenses.TEMPLATES[f]]
    rows = [(i, f"{plain[0]} {t} {plain[1]}") for i, (_, t) in enumerate(cases)] + [(99, " ".join(plain))]
    model = licenses.fit(frame(spark, [(i, f"{a} {b} {c} text") for i, (a, b, c) in enumerate(zip("abcdefgh" * 4, "ijklmnop" * 4, "qrstuvwx" * 4, strict=True))]))
    got = {r["doc_id"]: r["families"] for r in licenses.scan(frame(spark, rows), model).collect()}
    assert got == {i: [f] for i, (f, _) in enumerate(cases)} | {99: []}


# ------------------------------------------------------------------ 4 URL filter
def judged(url, rules):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail)[0]
    path = re.match(r"[^?#]*", tail[len(host) :])[0] if host or tail[:1] in "/" else re.match(r"[^?#]*", tail)[0]
    host, best = host.translate(LOWER), None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else "allow"


def test_urls(spark):
    urls = ["http://a.net/x", "http://NET/", "http://net", "https://example.net/en/1?q", "http://x.example.net/en", "ftp://m.example.com/de/9#t", "http://example.org/fr/", "http://org/fr/x", "http://notnet/", "http://a.net?b/", "http://É.org/fr/", "nothing", "", None, "://net/", "http://a.b.c.d.e.example.com/de/", "http://net:80/", "http://x.net//", "http://x.net/" + "y" * 3000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 2)] + [(0, urls[0])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = Counter(tuple(r) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == Counter((i, *judged(u, url_filter.RULES)) for i, u in [*enumerate(urls * 2), (0, urls[0])])
    none = url_filter.judge(pages, url_filter.rules_frame(spark, [])).select("verdict").distinct().collect()
    assert [r[0] for r in none] == ["allow"] and url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


# ------------------------------------------------------------------ 5 SentencePiece
def viterbi(m, text):
    """Best path over the whole text at once."""
    if not text:
        return 0.0, []
    cp = ["\0lit" if c == "▁" else "▁" if c == " " else c for c in " " + text]
    best, back = [0.0] + [-math.inf] * len(cp), [None] * (len(cp) + 1)
    for i in range(len(cp)):
        for n in range(1, min(m.longest, len(cp) - i) + 1):
            k = m.pieces.get("".join(cp[i : i + n]))
            s = best[i] + (m.score[k] if k is not None else m.unknown if n == 1 else -math.inf)
            if s > best[i + n]:
                best[i + n], back[i + n] = s, (i, k)
    ids, at = [], len(cp)
    while at:
        i, k = back[at]
        ids = ([int(k)] if k is not None else [int(m.bytes[b]) for b in ("▁" if cp[i] == "\0lit" else cp[i]).encode()]) + ids
        at = i
    return best[-1], ids


def packed(m, texts, **more):
    ids, n = m.encode_all(texts, **more)
    return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


@needs_pieces
@pytest.mark.parametrize("chars", [1 << 20, 50])
def test_sentencepiece(spark, docs, chars):
    m = sentencepiece_codec.model_of(queries.PIECES)
    rng = random.Random(2)
    texts = ["", None, " ", "   ", " a  b ", "Hello world.\n\nNext line", "▁x▁ y ▁", "日本語 テキスト🙂", "\0\0 a", "\0", "x" * 300, "a\r\n\tb", "ion" * 50, "Hello", "Hello"] + ["".join(rng.choice("ab  \nthe▁é🙂") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got = packed(m, texts, chars=chars)
    for t, p in zip(texts, got, strict=True):
        ids = np.frombuffer(p, m.dtype).tolist()
        assert ids == viterbi(m, t)[1]
        stream = sentencepiece_codec.StreamingViterbi(m)
        out = [x for c in (t or "") and " " + t for x in stream.feed(c)] + stream.end()
        assert out == ids
    assert m.decode(got) == [t or "" for t in texts]
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, queries.PIECES), queries.PIECES).collect()
    assert len(rows) == len(corpus()) and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert sentencepiece_codec.encode(docs.limit(0), queries.PIECES).count() == 0
    assert {r["decoded"] for r in sentencepiece_codec.decode(spark.createDataFrame([(None,), (b"",)], "ids binary"), queries.PIECES).collect()} == {""}


@needs_pieces
def test_streaming_window():
    """Unbroken text: the window stays small where paths meet, ids come out before the end, and they are those of the whole text."""
    m = sentencepiece_codec.model_of(queries.PIECES)
    rng = random.Random(6)
    text = " " + "".join(rng.choice("etaoinshrdlucmfw") for _ in range(4000))
    stream, out, early = sentencepiece_codec.StreamingViterbi(m), [], 0
    for i in range(0, len(text), 7):
        out += stream.feed(text[i : i + 7])
        early = max(early, len(stream.cp))
    assert stream.widest <= 8 * m.longest and early <= 12 * m.longest and len(out) > 1000
    assert out + stream.end() == viterbi(m, text[1:])[1] == np.frombuffer(packed(m, [text[1:]])[0], m.dtype).tolist()
    endless = "x" * 20000  # paths that do not meet
    assert sum(m.length[np.frombuffer(packed(m, [endless])[0], m.dtype)]) == 20001


@needs_pieces
def test_sentencepiece_equal_hashes(monkeypatch):
    """Stretches whose hashes collide are told apart."""
    m, texts = sentencepiece_codec.model_of(queries.PIECES), ["the quick fox", "and the other", None]
    want = packed(m, texts)
    monkeypatch.setattr(sentencepiece_codec, "mix64", lambda x: x * np.uint64(0))
    assert packed(m, texts) == want


@needs_pieces
def test_sentencepiece_library_score():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(queries.PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # the library adds up in 32-bit floats
        p.score = max(p.score, -40000.0)
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = sentencepiece_codec.model_of(queries.PIECES)
    for t in ["the quick brown fox", "Einheit und Recht", "thstion onanly erhe the"]:
        ours = np.frombuffer(packed(m, [t])[0], m.dtype)
        assert sum(m.score[ours]) == sum(m.score[lib.encode(t)])


# ------------------------------------------------------------------ 6 line dedup
def lines_of(rows, least, many):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x)) >= least and len(where[key(x)]) >= many and (i is None or i < max(j for j in where[key(x)] if j is not None))
    return Counter((i, len((t or "").split("\n")), sum(gone(i, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines(spark, docs, limit):
    clash = docs.withColumns({n: F.lit("clash") for n in ("n_lines", "doc", "__doc", "__drop", "digest", "key", "c0")})
    out = line_dedup.dedup_lines(clash, min_docs=5, max_broadcast=limit)
    want = lines_of(corpus(), 40, 5)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == want and sum(k[2] for k in want) > 5
    assert set(out.columns) == {*clash.columns, "n_dropped"} and out.where("doc <> 'clash' or c0 <> 'clash'").isEmpty()
    assert line_dedup.dedup_lines(docs.limit(0), max_broadcast=limit).count() == 0


def test_small_filter_changes_nothing(spark, docs):
    out = line_dedup.dedup_lines(docs, min_chars=1, filter_bits=20)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == lines_of(corpus(), 1, 5)


@needs_pieces
def test_round_trip_is_one_pass(spark, docs):
    """The ids and texts of encode and decode, with one Python stage: two of them held twice the workers and models."""
    rows = docs.withColumn("decoded", F.lit("clash"))
    both = sentencepiece_codec.round_trip(rows, queries.PIECES)
    parts = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, queries.PIECES), queries.PIECES)
    assert both.columns == parts.columns and sorted(map(repr, both.collect())) == sorted(map(repr, parts.collect()))
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sentencepiece_codec.round_trip(docs.limit(0), queries.PIECES).count() == 0


# ------------------------------------------------------------------ 7 CTW
def test_tree_is_a_distribution_and_mixes():
    texts = [b"abracadabra", b"abrabra", b"", b"cadabra"]
    keys = np.concatenate([ctw.grams([t], 2)[0] for t in texts])
    tables = []
    for d in range(3):
        tables.append(np.unique(keys & np.uint64((1 << 8 * d + 8) - 1), return_counts=True))
    tree = ctw.Tree(tables)
    for context in (b"ab", b"\xff\xff", b"zz", b"zb"):
        base = int.from_bytes(context, "big") << 8
        assert math.isclose(sum(10 ** tree.logs(np.arange(base, base + 256).astype(np.uint64))), 1, rel_tol=1e-4)
    # one path by hand: bit nodes of the first bit after "ab"
    def counts(ctx):
        own = [t for t in range(256) for k, n in zip(*tables[len(ctx)], strict=True) for _ in range(n) if int(k) == int.from_bytes(ctx + bytes([t]), "big")]
        return sum(x < 128 for x in own), sum(x >= 128 for x in own)

    def weighted(ctx):
        kt = math.exp(float(ctw.log_kt(np.array([counts(ctx)[0]]), np.array([counts(ctx)[1]]))[0]))
        if len(ctx) == 2:
            return kt
        below = math.prod(weighted(bytes([x]) + ctx) for x in range(256) if sum(counts(bytes([x]) + ctx)))
        return (kt + below) / 2

    p, rem = 0.0, 1.0
    for d in range(3):
        ctx = b"ab"[2 - d :]
        a, b = counts(ctx)
        kt = math.exp(float(ctw.log_kt(np.array([a]), np.array([b]))[0]))
        w = 1.0 if d == 2 else kt / 2 / weighted(ctx)
        p, rem = p + rem * w * (b + 0.5) / (a + b + 1), rem * (1 - w)
    node = np.searchsorted(tree.nodes[2][0], int.from_bytes(b"ab", "big"))
    assert math.isclose(float(tree.one[2][0][node]), p, rel_tol=1e-5)
    whole = sum(math.log10(10 ** tree.logs(ctw.grams([b"abra"], 2)[0][i : i + 1])[0]) for i in range(5))
    assert math.isclose(tree.score([b"abra"])[0], whole, rel_tol=1e-6)


@pytest.mark.parametrize(("capacity", "words"), [(1 << 20, 1 << 19), (50, 5)])
def test_ctw(spark, docs, capacity, words):
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)), F.lit(0))
    got = ctw.score(docs, rest != 2, rest == 2, capacity=capacity, words=words).collect()
    c, want = Counter(), []
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in corpus():
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in corpus():
        w = [*(t or "").encode().lower().split(), None]
        want.append((i, held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 4)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in got)


@pytest.mark.parametrize("capacity", [1 << 20, 50])
def test_ctw_keeps_every_gram(spark, docs, capacity):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    keys = ctw.grams([ctw.normal(t) for i, t in corpus() if not held(i)], 5)[0]
    tree = ctw.Tree([np.unique(keys & np.uint64((1 << 8 * d + 8) - 1), return_counts=True) for d in range(6)])
    rest = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)), F.lit(0))
    got = ctw.score(docs, rest != 2, rest == 2, capacity=capacity).collect()
    want = [(str(i), float(tree.score([ctw.normal(t)])[0])) for i, t in corpus()]
    pairs = list(zip(sorted((str(r["doc_id"]), r["score"]) for r in got), sorted(want), strict=True))
    coded = {str(i): len(ctw.normal(t)) + 1 for i, t in corpus() if i not in (3, 7, None)}
    assert all(r["n_bytes"] == coded[str(r["doc_id"])] and math.isclose(r["bits_per_byte"] * r["n_bytes"], -r["score"] / math.log10(2), rel_tol=1e-9) for r in got if str(r["doc_id"]) in coded)
    assert len(tree.keys) > 50 and all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-5) for a, b in pairs)


def test_ctw_without_training(spark):
    docs = frame(spark, [(1, "ab"), (2, None)])
    got = {r["doc_id"]: r for r in ctw.score(docs, F.lit(False), F.lit(True)).collect()}
    assert math.isclose(got[1]["score"], -24 * math.log10(2), rel_tol=1e-6) and got[1]["base_score"] == 0 and got[2]["n_known"] == 0
    assert ctw.score(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_ctw_stays_finite_beside_frequent_bytes():
    """A byte that no training text has, beside more occurrences of another than 32-bit floats tell from certainty."""
    tree = ctw.Tree([(np.array([97], np.uint64), np.array([1 << 26]))])
    # a is 01100001, ` is 01100000: the last bit is always one in training
    assert math.isclose(tree.logs(np.array([96], np.uint64))[0], math.log10(0.5 / ((1 << 26) + 1)), rel_tol=1e-6)


def test_ctw_weighted(spark, tmp_path):
    """Held-out texts of long words that training lacks: the base takes each for one token, the tree spells them."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    text = lambda i: " ".join(f"{i}x{j}" * 9 for j in range(40)) if held(i) else "one two three"
    frame(spark, [*((i, text(i)) for i in range(60)), (None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_ctw(spark, str(tmp_path)).collect()
    assert any(r["held_out"] and r["tree_score"] < 2 * r["base_score"] for r in got)
    for r in got:
        assert 0 > r["score"] >= max(r["tree_score"], r["base_score"]) - math.log10(2) - 1e-9
        near = [10 ** (x - r["base_score"]) for x in (r["tree_score"], r["base_score"]) if x > r["base_score"] - 300]
        assert math.isclose(r["score"] - r["base_score"], math.log10(sum(near) / 2), rel_tol=1e-9, abs_tol=1e-9)


# ------------------------------------------------------------------ 8 top-k
@pytest.mark.parametrize("group", [1 << 24, 100])
def test_top_k(spark, group):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 64]) for i in range(700)] + [(800, None), (801, [1.0, None, 0.0, 0.0]), (802, [float("nan")] * 4), (803, [float("inf")] * 4), (804, []), (806, [0.5, 0.5]), (None, [0.0] * 4), (807, [1e307, 0.0, 0.0, 0.0]), (41, [3.0 / 64] * 4), (20, [0.0, 1.0, 0.0, 0.0])]
    rows += [rows[5], rows[20]]  # rows of one id and vector, one of them a query
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(64 * x) for x in v)]
    want = set()
    for q in {i for i, _ in sound if i % 20 == 0}:
        asked = {tuple(v) for i, v in sound if i == q}
        best = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), i) for w in asked for i, v in sound if i != q and len(v) == len(w))[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    got = topk.top_k(df.repartition(3), df.where("vec_id % 20 = 0"), group_bytes=group)
    assert {tuple(r) for r in got.collect()} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_huge(spark):
    """Components of any finite size: exact up to 64 bits, held there beyond."""
    df = spark.createDataFrame([(0, [1e300, 2.0]), (1, [1.0, 1.0]), (2, [-1e300, 1.0]), (3, [2.0**40, 3.0]), (20, [2.0**12, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(df, df.where("vec_id % 20 = 0")).collect()}
    assert got[0, 1] == 2**63 - 1 and got[0, 2] == -(2**63) and got[20, 1] == 2**24 + 4096 and got[20, 3] == 2**63 - 1
    big = np.array([[2.0**30, 3.0]])
    assert topk.product(big, big)[0, 0] == 2**60 + 9


# ------------------------------------------------------------------ 9 decontamination
def found_in(rows, items, size):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = Counter()
    for d, t in rows:
        w, hit, own = word(t), set(), set()
        for i, x in items:
            v = word(x)
            for k in range(max(1, len(v) - size + 1)) if v else ():
                g = v[k : k + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        own.add(i)
        out[d, len(w), tuple(sorted(hit)), tuple(sorted(own))] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, block):
    rows = corpus()
    items = [(i, " ".join((rows[i][1] or "").split()[:30]).title()) for i in (0, 2, 3, 8, 9)] + [(50, "a"), (51, ""), (50, "a"), (52, "never seen words here")]
    bench = spark.createDataFrame([*items, (53, None), (None, "a")], "item_id long, text string")
    got = decontam.find_matches(docs, bench, size=6, block_chars=block).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple(r["hits"]), tuple(r["items"])) for r in got) == found_in(rows, items, 6)
    assert decontam.find_matches(docs.limit(0), bench).count() == 0
    assert all(not r["items"] for r in decontam.find_matches(docs, bench.limit(0)).collect())


def near_in(rows, items, rare_terms, span):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    count = Counter(w for _, t in rows for w in word(t))
    out = Counter()
    for d, t in rows:
        w = word(t)
        spans = [set(w[i : i + span]) for i in range(max(1, len(w) - span + 1))]
        out[d, tuple(sorted({i for i, x in items if word(x) and any(set(sorted(set(word(x)), key=lambda v: (count[v], v))[:rare_terms]) <= s for s in spans)}))] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_proximity(spark, docs, block):
    small = frame(spark, [(1, "aa x x bb x cc"), (2, "aa " + "x " * 10 + "bb cc"), (3, "cc bb aa"), (4, "aa bb"), (5, None)])
    bench = spark.createDataFrame([(7, "aa bb cc")], "item_id long, text string")
    got = {r["doc_id"]: r["near"] for r in decontam.find_matches(small, bench, span=6, size=6).collect()}
    assert got == {1: [7], 2: [], 3: [7], 4: [], 5: []}
    rows, items = corpus(), [(i, " ".join((corpus()[i][1] or "").split()[:30])) for i in (0, 2, 3, 8, 9)] + [(50, "a"), (51, "never a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], tuple(r["near"])) for r in decontam.find_matches(docs, bench, size=6, span=8, block_chars=block).collect())
    assert got == near_in(rows, items, 3, 8) and sum(len(k[1]) for k in got) > 10


def test_text_ids(spark):
    """Ids that are text pass through."""
    bench = spark.createDataFrame([(7, "aa bb")], "item_id long, text string")
    got = decontam.find_matches(spark.createDataFrame([("k", "x aa bb"), (None, "bb")], "id string, text string"), bench, id_col="id").collect()
    assert sorted((str(r["id"]), r["hits"]) for r in got) == [("None", []), ("k", [1, 2])]


# ------------------------------------------------------------------ 10 Jaccard
def groups_of(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 4)])
def test_jaccard(spark, seed, bits):
    """With ids of 4 bits many sets share one; the second id tells them apart."""
    rows = corpus(seed, 90)
    docs = frame(spark, rows).withColumn("node", F.lit("clash")).repartition(5)
    assert Counter(tuple(r) for r in jaccard.jaccard_groups(docs, node_bits=bits).collect()) == groups_of(rows)


def test_gram_sets():
    texts = ["a b c d e f a b c d e", "A  b", None, "", "x", "a b C d e", "w " * 3000]
    got = [g[i:j].tolist() for _, _, g, offs in jaccard.gram_sets(pa.array(texts), 5) for i, j in zip(offs, offs[1:], strict=False)]
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts] and all(x == sorted(set(x)) for x in got)
    assert set(got[5]) < set(got[0]) and not set(got[1]) & set(got[0])


def test_jaccard_large_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"e{i}"
        w[rng.randrange(len(w))] = f"f{i % 3}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60] + [f"u{i}x{j}" for j in range(60)])) for i in range(20)]
    assert Counter(tuple(r) for r in jaccard.jaccard_groups(frame(spark, rows)).collect()) == groups_of(rows)
    assert jaccard.jaccard_groups(frame(spark, rows).limit(0)).count() == 0


def test_shared_digest_of_items():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chains_across_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(30), 5 + node % 3, node) for node in [rng.randrange(12) for _ in range(80)])
    cols = [pa.array([g for g, _, _ in rows], pa.int64()), pa.array([x for _, _, x in rows], pa.int64()), pa.array([n for _, n, _ in rows], pa.int32()), pa.array(range(80), pa.int32())]
    batch = pa.RecordBatch.from_arrays(cols, names=["gram", "node", "n", "pos"])
    parts = [batch.slice(i, size) for i in range(0, 80, size)]
    got = [(r["gram"], r["node"]) for b in jaccard._chains(iter(parts)) for r in b.to_pylist()]
    want = []
    for g in sorted({g for g, _, _ in rows}):
        own = list(dict.fromkeys(x for h, _, x in rows if h == g))
        if len(own) > 1:
            want += [(g, x) for x in own]
    assert sorted(got) == sorted(want)


def test_quality_repeats_and_ties(spark):
    """A row repeated thousands of times is one of the sample; of equally near vectors the first keys vote."""
    docs = frame(spark, [(1, "good words here")] * 3000 + [(2, "bad junk there"), (3, "good words here")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, mod=10**9, n_fit=10)
    assert len(model.label) == 3
    keys = [(1, spark.range(1).select(F.xxhash64(F.lit(1).cast("long"), F.lit("good words here"))).first()[0])]
    assert keys and model.label[0] == 1  # sorted by id, then hash
    for k, want in ((1, 1.0), (2, 0.5)):
        got = quality.classify(docs.where("doc_id = 3"), model, k=k).first()["score"]
        assert got == pytest.approx(want)


def test_top_k_holds_one_group(spark, monkeypatch):
    """Many groups of queries: each is sent, used and let go before the next."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    alive, most = set(), []
    sc = type(spark.sparkContext)
    send = sc.broadcast

    def counted(self, value):
        b = send(self, value)
        if isinstance(value, dict):
            alive.add(id(b))
            most.append(len(alive))
            gone = b.destroy
            b.destroy = lambda *a: (alive.discard(id(b)), gone(*a))
        return b

    monkeypatch.setattr(sc, "broadcast", counted)
    got = topk.top_k(vectors, vectors, k=3, group_bytes=2000)
    want = topk.top_k(vectors, vectors, k=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(most) > 8 and max(most) == 1

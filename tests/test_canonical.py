"""Canonical JSON against the standard library: nested, Unicode, control characters, numbers of every size, long texts."""

import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from gristmill.functions import canonical


def random_value(rng, depth=0):
    kind = rng.randrange(9 if depth < 5 else 6)
    text = lambda: "".join(rng.choice(['a', 'Z', '"', "\\", "/", "é", "漢", "\u000b", "\x1f", "\x7f", "\n", "\t", " ", "n1", "s", "{", ",", "u000B", "\\u000B"]) for _ in range(rng.randrange(8)))
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, 1, -1, 2**63, -(2**70), 10**40, rng.randrange(-(10**6), 10**6)])
    if kind in (2, 3):
        return struct.unpack("d", rng.randbytes(8))[0] if rng.random() < 0.5 else rng.choice([0.0, -0.0, 1.0, 1e16, 1e15, 123456789012345.6, 1e-4, 1e-5, 0.1, 2e23, 5e-324, 1.5e300, round(rng.uniform(-1e4, 1e4), rng.randrange(6))])
    if kind in (4, 5):
        return text()
    if kind in (6, 7):
        return {text(): random_value(rng, depth + 1) for _ in range(rng.randrange(5))}
    return [random_value(rng, depth + 1) for _ in range(rng.randrange(5))]


def test_random_values(spark):
    rng = random.Random(11)
    values = []
    while len(values) < 1500:
        v = random_value(rng)
        if "NaN" not in json.dumps(v) and "Infinity" not in json.dumps(v):
            values.append(v)
    rows = [(i, json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, t string")
    got = frame.select("i", canonical.canonical_json(F.col("t")).alias("tight"), canonical.canonical_json(F.col("t"), spaced=True).alias("wide"), canonical.canonical_digest(F.col("t")).alias("sha"))
    for i, tight, wide, sha in got.collect():
        want = json.dumps(values[i], sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        assert tight == want
        assert wide == json.dumps(values[i], sort_keys=True, ensure_ascii=False)
        assert sha == hashlib.sha256(want.encode()).hexdigest()


def test_floats(spark):
    """A few in ten thousand doubles have two decimals of the least length; either reads back."""
    rng = random.Random(3)
    values = [x for _ in range(20000) if math.isfinite(x := struct.unpack("d", rng.randbytes(8))[0])] + [rng.random() * 10 ** rng.randint(-8, 20) for _ in range(5000)]
    frame = spark.createDataFrame([(x,) for x in values], "d double")
    differ = 0
    for d, s in frame.select("d", canonical.float_text(F.col("d"))).collect():
        assert float(s) == d and len(s) == len(repr(d))
        differ += s != repr(d)
    assert differ <= 15


def test_bad_and_long(spark):
    deep = "[" * 200 + "]" * 200
    long = json.dumps({"b": "line\n" * 300_000, "a": ["x" * 1_000_000]})
    rows = [(1, None), (2, ""), (3, "{"), (4, '{"a":1,"a":2}'), (5, "{} x"), (6, deep), (7, long), (8, '{"a":NaN}'), (9, " 1e400 "), (10, "1],[2"), (11, '1},{"v":2'), (12, "1, 2"), (13, "1 2")]
    got = dict(spark.createDataFrame(rows, "i int, t string").select("i", canonical.canonical_json(F.col("t"))).collect())
    assert [got[i] for i in (1, 2, 3, 4, 5, 8, 10, 11, 12, 13)] == [None] * 10
    assert got[6] == deep and got[9] == "Infinity"
    assert got[7] == json.dumps(json.loads(long), sort_keys=True, separators=(",", ":"))


def test_raw_values(spark):
    text = '{"a":null,"b":true,"c":3,"d":3.0,"e":"3","f":[1, 2.50],"g":{"y":1,"x":[]},"h":1e20}'
    kinds = {"a": "VOID", "b": "BOOLEAN", "c": "BIGINT", "d": "DECIMAL", "e": "STRING", "f": "ARRAY", "g": "OBJECT", "h": "DOUBLE", "z": None}
    texts = {"a": "None", "b": "True", "c": "3", "d": "3.0", "e": "3", "f": "[1,2.5]", "g": '{"x":[],"y":1}', "h": "1e+20", "z": None}
    v = F.parse_json(F.lit(text))
    field = lambda k: F.try_variant_get(v, f"$.{k}", "variant")
    got = spark.range(1).select(*(canonical.raw_kind(field(k)).alias(k) for k in kinds), *(canonical.raw_text(field(k)).alias(f"t{k}") for k in kinds)).first()
    assert {k: got[k] for k in kinds} == kinds
    assert {k: got[f"t{k}"] for k in kinds} == texts


def test_canonical_of_plain_and_respelt_numbers(spark):
    """Values whose VARIANT is spelt as wanted and those that need their tokens."""
    plain = ['{"b":[1,-0,null,true],"a":"x\\u001F\\" /\\u007f é"}', "[]", ' [ {"z":"1.50", "y":9e} ]', '{"a":1,"a":2}', "999999999999999999", "-5", '"\\u2028"']
    odd = ["[1.50]", '{"a":[1,"x",2.0]}', "1e5", "12345678901234567890123", "[1,2.5]", '{"a":{"b":-0.0}}']
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(plain + odd)], "i int, v string")
    got = [r[0] for r in frame.orderBy("i").select(canonical.canonical_json(F.col("v"))).collect()]
    want = ['{"a":"x\\u001f\\" /\x7f é","b":[1,0,null,true]}', "[]", None, None, "999999999999999999", "-5", '" "', "[1.5]", '{"a":[1,"x",2.0]}', "100000.0", "12345678901234567890123", "[1,2.5]", '{"a":{"b":-0.0}}']
    assert got == want

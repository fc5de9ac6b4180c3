"""Canonical JSON in the JVM: sorted keys, fixed separators, shortest numbers; digests and plain texts of raw values.

The tokens of a JSON text are marked (strings by s, numbers by n, as strings), so VARIANT sorts
the keys of every level without touching the numbers' spelling; then the tokens are written out.
No step recurses, so values may nest as deep as VARIANT allows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.arrays import let

#: A string, a number, or one character of anything else. Possessive, so that long strings need no stack.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*+|[a-z]++|[^\s]'


def _tokens(json: Column) -> Column:
    return F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))


def parse_whole(json: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing after it (Spark's own parser stops after the first value); null for other texts, and for objects that repeat a key."""
    # what ends early in an array can't also end early in an object
    inside = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("}"))).isNotNull()
    return F.when(inside, F.try_parse_json(json))


#: In the schema of a VARIANT: perhaps a number that isn't spelt as it was.
_RESPELT = "DECIMAL|DOUBLE|FLOAT|VARIANT"


def float_text(d: Column) -> Column:
    """The shortest decimal that reads back as the same double; from 1e16 on and below 0.0001 with an exponent of two digits or more."""

    def shortest(x: Column) -> Column:
        spelt = lambda p: F.format_string(f"%.{p}e", x)
        if_same = lambda s: F.when(s.cast("double") == x, s)

        def sixteen(s: Column, up: int) -> Column:
            """The first 16 of 17 digits, or the next number: rounding the 17th, which may be off, can miss the right one."""
            digits = F.concat(F.regexp_extract(s, r"^-?(\d)", 1), F.regexp_extract(s, r"\.(\d{15})", 1)).cast("long") + up
            return if_same(F.concat(F.regexp_extract(s, "^-?", 0), F.substring(digits.cast("string"), 1, 1), F.lit("."), F.substring(digits.cast("string"), 2, 15), F.regexp_extract(s, "e.*$", 0)))

        # up to 15 digits every decimal reads back; near the smallest doubles fewer digits tell them apart
        tiny = F.coalesce(*(if_same(spelt(p)) for p in range(17)))
        return F.when(F.abs(x) < 2.3e-308, tiny).otherwise(F.coalesce(if_same(spelt(14)), if_same(spelt(15)), let(spelt(16), lambda s: F.coalesce(sixteen(s, 0), sixteen(s, 1), s))))

    def written(s: Column) -> Column:
        sign, power = F.regexp_extract(s, "^-?", 0), F.regexp_extract(s, "e(.*)$", 1).cast("int")
        digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, "^-?([^e]*)", 1), r"\.", ""), "(?<=.)0+$", "")

        def placed(n: Column) -> Column:
            e, size = n["e"], F.length(n["d"])
            part = lambda a, b: F.substring(n["d"], a, b)
            whole = F.concat(F.rpad(n["d"], e + 1, "0"), F.lit(".0"))
            inner = F.concat(part(F.lit(1), e + 1), F.lit("."), part(e + 2, size))
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), n["d"])
            power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
            large = F.concat(part(F.lit(1), F.lit(1)), F.when(size > 1, F.concat(F.lit("."), part(F.lit(2), size))).otherwise(""), power)
            return F.when((e < -4) | (e >= 16), large).when(e < 0, small).when(e >= size - 1, whole).otherwise(inner)

        return F.concat(sign, let(F.struct(digits.alias("d"), power.alias("e")), placed))

    special = F.when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == float("-inf"), "-Infinity").when(d == 0, F.when(d.cast("string").startswith("-"), "-0.0").otherwise("0.0"))
    return F.coalesce(special, let(shortest(d), written))


def number_text(token: Column) -> Column:
    """A JSON number rewritten: whole numbers as they are, others as the shortest text of their double; of two such texts that which stands there."""
    whole = token.rlike("^-?[0-9]+$")
    own = token.rlike(r"^-?[0-9]+\.[0-9]+$|^-?[0-9](\.[0-9]+)?e[+-][0-9]{2,}$")
    spelt = let(float_text(token.try_cast("double")), lambda f: F.when(own & (F.length(f) == F.length(token)), token).otherwise(f))
    return F.when(whole, F.when(token == "-0", "0").otherwise(token)).otherwise(spelt)


def low_digits(string: Column) -> Column:
    """A JSON string whose control characters are spelt with lower-case digits."""

    def spelt(s: Column) -> Column:
        low = s
        for x in "ABCDEF":
            low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*+)\\u00([01]){x}", rf"$1\\u00$2{x.lower()}")
        return F.when(s.contains("\\u00"), low).otherwise(s)

    return let(string, spelt)


def json_string(text: Column) -> Column:
    """A text as a JSON string, characters beyond ASCII as they are."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), low_digits(F.substring(whole, F.lit(6), F.length(whole) - 6)))


def canonical_json(json: Column, spaced: bool = False) -> Column:
    """JSON text with the keys of every object sorted, and no white space (`spaced`: a space after commas and colons); characters beyond ASCII stay.

    Null where the text is no JSON, or an object repeats a key.  Keys are sorted by UTF-16 units.
    """
    if spaced:
        return _by_tokens(json, parse_whole(json), True)
    # VARIANT spells strings and 64-bit whole numbers as wanted; other numbers need their tokens
    return let(json, lambda j: let(parse_whole(j), lambda v: F.when(~F.schema_of_variant(v).rlike(_RESPELT), low_digits(F.to_json(v))).otherwise(_by_tokens(j, v, False))))


def _by_tokens(json: Column, value: Column, spaced: bool) -> Column:
    """canonical_json of the texts whose VARIANT isn't null, from their tokens."""
    mark = lambda t: F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substring(t, 2, 1 << 30))).when(t.rlike("^[-0-9]"), F.concat(F.lit('"n'), t, F.lit('"'))).otherwise(t)
    marked = F.when(value.isNotNull(), F.array_join(F.transform(_tokens(json), mark), ""))
    ordered = F.to_json(F.try_parse_json(marked))

    string = lambda t: low_digits(F.concat(F.lit('"'), F.substring(t, 3, 1 << 30)))
    sep = {",": ", ", ":": ": "} if spaced else {}
    write = lambda t: F.when(t.startswith('"n'), number_text(F.substring(t, 3, F.length(t) - 3))).when(t.startswith('"'), string(t))

    def token(t: Column) -> Column:
        out = write(t)
        for a, b in sep.items():
            out = out.when(t == a, b)
        return out.otherwise(t)

    return F.array_join(F.transform(_tokens(ordered), token), "")


def canonical_digest(json: Column) -> Column:
    """SHA-256 of the canonical text without white space; null where the text is no JSON."""
    return F.sha2(canonical_json(json), 256)


def raw_kind(value: Column) -> Column:
    """VOID (a JSON null), BOOLEAN, BIGINT, STRING, ARRAY or OBJECT of a VARIANT, another name for other numbers; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def raw_text(value: Column) -> Column:
    """A raw value as the text of an id: strings as they are, None, True and False, numbers in their shortest form, arrays and objects as canonical JSON; null if absent."""

    def written(v: Column) -> Column:
        kind, json = raw_kind(v), F.to_json(v)
        simple = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BIGINT", json).when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(json))
        return simple.when(kind.isin("ARRAY", "OBJECT"), canonical_json(json)).otherwise(float_text(F.try_variant_get(v, "$", "double")))

    return let(value, lambda v: F.when(v.isNotNull(), written(v)))

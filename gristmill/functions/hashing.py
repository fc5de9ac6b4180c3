"""Hash expressions: digests, seeds and buckets that DuckDB and Spark compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(parts, sep: str) -> Column:
    return F.concat_ws(sep, *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def digest(*parts, sep: str = "|") -> Column:
    """SHA-256 hex of the joined parts; strings are literals, columns are columns."""
    return F.sha2(_joined(parts, sep), 256)


def seed64(*parts) -> Column:
    """First 64 bits of the digest, as DECIMAL(20,0)."""
    return F.conv(F.substring(digest(*parts), 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(*parts) -> Column:
    """First 32 bits of the digest, as BIGINT."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def call_seed(*parts) -> Column:
    """31-bit seed of a model call; parts are joined by colons."""
    return F.conv(F.substring(digest(*parts, sep=":"), 1, 8), 16, 10).cast("long") % (1 << 31)


def letter(c: Column) -> Column:
    """0..3 to A..D."""
    return F.element_at(F.array(*map(F.lit, "ABCD")), c.cast("int") + 1)

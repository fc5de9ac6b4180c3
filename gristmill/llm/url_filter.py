"""URL filter by hashed expressions (operator 4), in DataFrame functions only.

Each distinct (host, path) is expanded into host suffixes x path prefixes, as many as the rules
can ask for: suffixes of at most the rules' number of labels, prefixes of the rules' path
lengths.  Expressions meet rules in an equi-join on the first 32 bits of their SHA-256; the full
digests confirm, and the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(verdict, rule) rows; a rule is a host followed by a path, like net/ or example.com/de/."""
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, rule string")


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    return _lower(host), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest
    rule wins, of equal ones that with the longer host, then block before allow.  No rule: null and
    `default`.  A null url, or one without ://, has an empty host and path and fits no rule.  Rules that are null or have
    no host are ignored.  Every row of pages comes back, repeated ones too; columns of the four
    names are replaced, others stay.  Empty tables give empty results.
    """
    rule = _lower(F.regexp_extract("rule", r"^[^/]*", 0))
    rules = rules.where("rule is not null and verdict is not null").select("verdict", "rule", rule.alias("rhost"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("rpath")).where("rhost <> ''")
    rules = rules.select("verdict", "rule", F.length("rhost").alias("hlen"), F.length("rpath").alias("plen"), F.size(F.split("rhost", r"\.")).alias("labels"), F.sha2(F.concat("rhost", "rpath"), 256).alias("full"))
    shape = rules.agg(F.max("labels").alias("labels"), F.array_sort(F.collect_set("plen")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 1, shape["lengths"]
    pages = pages.drop("host", "path", "rule", "verdict")
    columns = pages.columns
    host, path = split_url(F.coalesce(F.col(url_col), F.lit("")))
    pages = pages.select(*columns, host.alias("host"), path.alias("path"))
    suffixes = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {labels})), i -> substring_index(host, '.', -i))")
    sizes = F.array(*(F.lit(n) for n in lengths)) if lengths else F.expr("cast(array() as array<int>)")
    prefixes = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    grown = pages.select("host", "path").where("host <> ''").distinct().withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    digested = grown.select("host", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    met = digested.join(rules.withColumn("short", F.substring("full", 1, 8)), "short").where("digest = full")
    order = F.struct(F.expr("hlen + plen"), "hlen", F.when(F.col("verdict") == "block", 1).otherwise(0), "rule", "verdict")
    best = met.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return pages.join(best, ["host", "path"], "left").select(*columns, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

"""Token-array kernels and arg-max, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_pad(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), width - F.size(ids)), ids)


def right_pad(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), width - F.size(ids)))


def attention(ids: Column, width: Column, left: bool = True) -> Column:
    """1 for tokens, 0 for padding."""
    ones, zeros = F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), width - F.size(ids))
    return F.concat(zeros, ones) if left else F.concat(ones, zeros)


def positions(mask: Column) -> Column:
    """Position ids of an attention mask of ones and zeros: running count of ones less one, at least 0. Each one is followed by its own number until the next, so the work is linear."""
    ones = F.filter(F.transform(mask, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())

    def spread(at: Column) -> Column:
        each = F.flatten(F.transform(at, lambda p, j: F.array_repeat(j, F.coalesce(F.get(at, j + 1), F.size(mask)) - p)))
        return F.concat(F.array_repeat(F.lit(0), F.coalesce(F.get(at, F.lit(0)), F.size(mask))), each)

    return let(ones, spread)


def label_mask(prompt: Column, full: Column, ignored: int = -100) -> Column:
    """Labels of a full sequence: the prompt's positions are ignored; null where the prompt is no prefix."""
    labels = F.concat(F.array_repeat(F.lit(ignored), F.size(prompt)), F.slice(full, F.size(prompt) + 1, F.greatest(F.size(full) - F.size(prompt), F.lit(0))))
    return F.when(F.slice(full, F.lit(1), F.size(prompt)) == prompt, labels)


def supervised(labels: Column, ignored: int = -100) -> Column:
    """Labels that count after the shift by one."""
    return F.size(F.filter(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: x != ignored))


def accumulation_weights(examples: DataFrame, rank: str, labels: str, batch: int, micro: int, ignored: int = -100) -> DataFrame:
    """(step, micro, tokens, weight) of the micro-batches, `micro` examples each, of every step of `batch` examples in rank order (from 0); a step's weights sum to 1.

    A micro-batch's weight is its share of the step's supervised tokens, so the weighted sum of mean losses is the mean over the whole step; the last of a step may have fewer examples.
    A step without supervised tokens is an error.
    """
    place = F.col(rank).cast("long")
    each = examples.select(F.floor(place / batch).alias("step"), F.floor(F.pmod(place, F.lit(batch)) / micro).alias("micro"), supervised(F.col(labels), ignored).alias("n"))
    sums = each.groupBy("step", "micro").agg(F.sum("n").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("step"))  # batch / micro rows
    none = F.raise_error(F.concat(F.lit("no supervised tokens in step "), F.col("step").cast("string"))).cast("double")
    return sums.withColumn("all", total).select("step", "micro", "tokens", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(none).alias("weight"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable isn't expanded where it is used."""
    return F.transform(F.array(value), body)[0]


def softmax(z: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    return let(z, lambda own: let(let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))), shares))


def argmax(values: Column) -> Column:
    """0-based index of the largest value, ties to the first."""
    return -F.array_max(F.transform(values, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]

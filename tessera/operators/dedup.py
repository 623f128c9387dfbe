"""Duplicates by key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import NUMERIC, column, display, family


def bloom_shape(capacity: int, false_rate: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for so many keys."""
    bits = max(1, math.ceil(-capacity * math.log(false_rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / capacity * math.log(2)))


def dedup_key(df: DataFrame, at: str | int) -> Column:
    """The text of string, integer and float keys; null for other kinds, whose rows are never duplicates."""
    _, c, kind = column(df, at)
    if family(kind) != "string" and not isinstance(kind, NUMERIC):
        return F.lit(None).cast("string")
    return F.when(c.isNotNull(), display(c, kind))


def first_rows(df: DataFrame, at: str | int, order: Sequence[str]) -> DataFrame:
    """The first row of each key, by the order columns. Rows without a key are all kept.

    Exact, so nothing is lost to a filter's false positives. The grouped minimum is combined before the
    shuffle: a key that a third of the rows share reaches its task as one row per partition.
    """
    names = df.columns
    key = dedup_key(df, at)
    whole = F.struct(*[F.col(f"`{c}`") for c in [*order, *[c for c in names if c not in order]]])
    keyed = df.withColumn("__key", key)
    kept = keyed.filter("__key IS NOT NULL").groupBy("__key").agg(F.min(whole).alias("r")).select("r.*").select(*[F.col(f"`{c}`") for c in names])
    return kept.unionByName(keyed.filter("__key IS NULL").drop("__key"))


def bloom_filter(df: DataFrame, at: str, capacity: int, false_rate: float):
    """A mergeable Bloom filter over a column's keys, built in the JVM; ``mightContain`` asks it."""
    bits, _ = bloom_shape(capacity, false_rate)
    keyed = df.select(dedup_key(df, at).alias("k")).filter("k IS NOT NULL")
    return keyed._jdf.stat().bloomFilter("k", capacity, bits)

"""Joins by text similarity, and plain equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import column, family

JOINS = ("inner", "left", "right", "full", "left_semi", "left_anti")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in characters; two empty texts are equal."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def fuzzy_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float, right_order: Sequence[str]) -> DataFrame:
    """Each left row with the most similar right row, if the similarity reaches the threshold.

    Ties go to the right row that comes first by ``right_order``. The right key column is dropped; rows
    without a match, and rows whose key is null, get nulls.

    Only distinct keys are compared, each with right keys of a length that can reach the threshold: a
    left key is joined on every such length, an equi-join instead of a cross join, and the distance is
    computed with the bound that the threshold sets, so most comparisons end early.
    """
    _, lk, lt = column(left, left_key)
    _, rk, rt = column(right, right_key)
    others = [c for c in right.columns if c != right_key]
    if family(lt) != "string" or family(rt) != "string":
        return left.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others])
    order = F.struct(*[F.col(f"`{c}`") for c in right_order])
    rows = right.filter(rk.isNotNull()).groupBy(rk.alias("__rk")).agg(F.min(F.struct(order.alias("o"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("v"))).alias("__first"))
    keys = left.filter(lk.isNotNull()).select(lk.alias("__lk")).distinct().withColumn("__n", F.char_length("__lk"))
    if threshold > 0:
        # 1 - |a - b| / max(a, b) is the best similarity that two lengths allow.
        lengths = F.sequence(F.ceil(F.col("__n") * threshold - 1e-9).cast("int"), F.floor(F.col("__n") / threshold + 1e-9).cast("int"))
        near = keys.withColumn("__m", F.explode(lengths)).join(rows.withColumn("__m", F.char_length("__rk")), "__m")
    else:
        near = keys.crossJoin(rows)
    longer = F.greatest(F.col("__n"), F.char_length("__rk"))
    near = near.withColumn("__sim", levenshtein_similarity(F.col("__lk"), F.col("__rk"))) if threshold <= 0 else near.withColumn(
        "__d", F.expr(f"levenshtein(__lk, __rk, CAST(floor(greatest(__n, char_length(__rk)) * {1 - threshold} + 1e-9) AS INT))")
    ).filter("__d >= 0").withColumn("__sim", F.when(longer == 0, 1.0).otherwise(1 - F.col("__d") / longer))
    near = near.filter(F.col("__sim") >= threshold)
    best = near.groupBy("__lk").agg(F.min(F.struct((-F.col("__sim")).alias("s"), F.col("__first")["o"].alias("o"), F.col("__first")["v"].alias("v"))).alias("__b")).select("__lk", F.col("__b.v").alias("__v"))
    joined = left.join(best, lk == F.col("__lk"), "left")
    return joined.select(*[left[f"`{c}`"] for c in left.columns], *[F.col(f"__v.`{c}`").alias(c) for c in others])


def merge_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join; the engine picks broadcast, hash or sort-merge from the sizes."""
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}")
    return left.join(right, list(on), how)

"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, every row gets the index of its cell on a Hilbert curve,
rows are sorted by that index, and the sorted run is cut into shards. Rows that are close in all
dimensions share a shard, so a reader that filters on any of them skips most files by their min/max.

Everything is DataFrame code: one aggregate for the quantile bounds of numbers, a sorted table of distinct
values for those of strings (whole strings, however alike their beginnings), one range exchange of slim rows
(no text), a count per partition, and a broadcast of these counts (one row per partition) that turns
positions inside partitions into global ranks. No window over all rows is used, and a cell that holds
a third of the rows is split between partitions, since the sort key ends with the row's own id.

A dimension's levels are spread over the whole side of the curve, so one with four values decides as high
bits as one with thousands, and shards separate by it as well.

Documents with equal texts lie together: all copies take the dimensions of the least (language, source)
among them, and the checksum of the text orders a cell. The law of equal counts comes first, so a group that
is cut by a shard's end goes on in the next shard, and a group of more than a shard's rows fills several.

Defined results: null text has no bytes (size 1, checksum 0); null and empty texts are two groups of equal
texts; a null dimension sorts below all values; equal rows are ordered arbitrarily among themselves but each
gets its own rank; texts of any length are only hashed and measured; an empty table gives an empty result;
inner names carry the prefix ``__hs_``, and where the input has a column of a result's name the result's
gets underscores after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import int_array, materialise

#: Cells in the lookup table at most: dimensions times bits.
MAX_TABLE_BITS = 15


def hilbert_index(point: Sequence[int], bits: int) -> int:
    """Distance along the Hilbert curve of ``point`` (Skilling's transform, AIP Conf. Proc. 707, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ t) >> b & 1)
    return index


def curve_table(n_dims: int, bits: int) -> list[int]:
    """Curve index of each cell, cells numbered with the first dimension as the highest digit."""
    side = 1 << bits
    return [hilbert_index([cell // side ** (n_dims - 1 - d) % side for d in range(n_dims)], bits) for cell in range(side**n_dims)]


def running(counts: DataFrame, key: str, total: str) -> DataFrame:
    """Add ``__hs_start``, the sum of ``total`` over all rows of smaller ``key``, and ``__hs_total``, the sum of all.

    For a table of one row per partition: that is bounded by the cluster's setting and not by the data.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum(total).over(before), F.lit(0)).alias("__hs_start"), F.sum(total).over(Window.partitionBy()).alias("__hs_total"))


def string_bounds(values: DataFrame, side: int) -> list[str]:
    """Rising strings that cut the column ``v`` into at most ``side`` runs of about equal counts; a string ends its run.

    Distinct values are sorted in a range exchange and counted up; those at which a quantile lies, less than
    ``side`` of them, reach the driver.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = values.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("__hs_n"))
    told = materialise(told.repartitionByRange(n, "v").sortWithinPartitions("v").withColumn("__hs_part", F.spark_partition_id()))
    starts = running(told.groupBy("__hs_part").agg(F.sum("__hs_n").alias("__hs_n")), "__hs_part", "__hs_n")
    within = F.sum("__hs_n").over(Window.partitionBy("__hs_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    after = told.withColumn("__hs_in", within).join(F.broadcast(starts), "__hs_part").withColumn("__hs_after", F.col("__hs_start") + F.col("__hs_in"))
    level = lambda at: F.floor(at * side / F.col("__hs_total"))
    ends = after.filter((level(F.col("__hs_after")) > level(F.col("__hs_after") - F.col("__hs_n"))) & (F.col("__hs_after") < F.col("__hs_total")))
    return sorted((r["v"] for r in ends.select("v").collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))


def hilbert_cell(df: DataFrame, dims: dict[str, Column], bits: int) -> Column:
    """Expression of the curve index of a row; bounds of the levels come from all rows of ``df``."""
    if len(dims) * bits > MAX_TABLE_BITS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits need a table of more than 2^{MAX_TABLE_BITS} cells")
    side = 1 << bits
    kinds = dict(df.select(*[c.alias(k) for k, c in dims.items()]).dtypes)
    cuts = [i / side for i in range(1, side)]
    numbers = {k: c.cast("double") for k, c in dims.items() if kinds[k] != "string"}
    row = df.agg(*[F.struct(F.percentile_approx(v, cuts, 10_000).alias("cuts"), F.max(v).alias("top")).alias(k) for k, v in numbers.items()]).first() if numbers else {}
    cell = F.lit(0)
    for name, column in dims.items():
        if name in numbers:
            # A bound that no value exceeds would leave the highest level empty.
            column, bounds = numbers[name], sorted({float(b) for b in row[name]["cuts"] or () if b < row[name]["top"]})
        else:
            bounds = string_bounds(df.select(column.alias("v")), side)
        level = F.lit(0)
        for bound in bounds:
            level = level + F.when(column > F.lit(bound), 1).otherwise(0)
        cell = cell * side + F.floor(level * side / (len(bounds) + 1)).cast("int")
    return F.element_at(int_array(curve_table(len(dims), bits)), cell + 1)


def global_rank(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``__hs_rank``, the position of each row in the order of the named columns, and ``__hs_total``.

    The sorted slim rows are written once to the shared folder, so ranks stay the same if a later task
    is run again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__hs_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__hs_at"))
    )
    placed = materialise(placed)
    starts = running(placed.groupBy("__hs_part").agg(F.count("*").alias("__hs_n")), "__hs_part", "__hs_n")
    return placed.join(F.broadcast(starts), "__hs_part").withColumn("__hs_rank", F.col("__hs_start") + F.col("__hs_at")).drop("__hs_part", "__hs_at", "__hs_start")


def free_name(name: str, taken: Sequence[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def hilbert_shards(df: DataFrame, dims: dict[str, Column], n_shards: int, keep: dict[str, Column], tie: Sequence[Column], bits: int = 4, spread_over: DataFrame | None = None) -> DataFrame:
    """Cut the curve into ``n_shards`` runs whose row counts differ by one at most.

    ``keep`` gives the columns of the result, ``dims`` the dimensions, ``tie`` what orders rows of a cell.
    Adds ``curve`` (index on the curve), ``shard`` and ``slot`` (position in the shard, from 0), with
    underscores after a name that ``keep`` has already. Levels are spread over ``spread_over``, a table with
    the columns that ``dims`` names, or else over ``df``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    curve, shard_name, slot = (free_name(x, list(keep)) for x in ("curve", "shard", "slot"))
    # Positions name the columns inside, whatever the caller's are called.
    inner = {f"__hs_k{i}": c for i, c in enumerate(keep.values())}
    order = ["__hs_curve", *[f"__hs_tie{i}" for i in range(len(tie))]]
    slim = df.select(*[c.alias(k) for k, c in inner.items()], hilbert_cell(df if spread_over is None else spread_over, dims, bits).alias("__hs_curve"), *[c.alias(f"__hs_tie{i}") for i, c in enumerate(tie)])
    ranked = global_rank(slim, order)
    shard = F.expr(f"CAST((__hs_rank * {n_shards}) div __hs_total AS INT)")
    first = F.expr(f"(CAST((__hs_rank * {n_shards}) div __hs_total AS BIGINT) * __hs_total + {n_shards - 1}) div {n_shards}")
    return ranked.select(*[F.col(k).alias(name) for k, name in zip(inner, keep, strict=True)], F.col("__hs_curve").alias(curve), shard.alias(shard_name), (F.col("__hs_rank") - first).alias(slot))


def document_shards(docs: DataFrame, n_shards: int = 16, with_columns: bool = False) -> DataFrame:
    """Documents cut along the curve of language, source and length, with the size and checksum of each text.

    With ``with_columns`` the documents' own columns are returned instead, and ``curve``, ``shard`` and ``slot``.
    """
    text = F.col("text")
    size, crc = F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1, F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    keep = {c: F.col(f"`{c}`") for c in docs.columns} if with_columns else {"doc_id": F.col("doc_id"), "size": size, "text_crc32": crc}
    # Copies are told by size, checksum and a 64-bit hash; a third of all rows may be copies of one text, so the
    # least of them is a grouped minimum, written before it is joined back: the engine can split a hot key then.
    slim = docs.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(keep.values())]).alias("keep"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), size.alias("size"), crc.alias("crc"), F.xxhash64("text").alias("h"), F.col("doc_id").alias("id"))
    key = ["size", "crc", "h"]
    copies = slim.groupBy(*key).agg(F.min(F.struct("lang", "source")).alias("least"), F.count("*").alias("n")).filter("n > 1").select(*key, "least")
    placed = slim.join(materialise(copies), key, "left")
    dims = {name: F.when(F.col("least").isNotNull(), F.col("least")[name]).otherwise(F.col(name)) for name in ("lang", "source")}
    placed = placed.select("keep", *[c.alias(k) for k, c in dims.items()], *key, "id")
    return hilbert_shards(placed, {k: F.col(k) for k in ("lang", "source", "size")}, n_shards, {k: F.col(f"keep.c{i}") for i, k in enumerate(keep)}, [F.col("crc"), F.col("h"), F.col("id")], spread_over=slim)

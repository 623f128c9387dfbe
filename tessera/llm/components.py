"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Links that a task writes; a graph of few links goes into few files whatever the number of partitions.
LINKS_PER_TASK = 50_000


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node that has a link with the smallest node of its component.

    ``edges`` has columns u and v of one orderable type. Alternating large-star and small-star steps
    (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): every step is a grouped
    minimum, combined before the shuffle, and a join of links with one row per node, which the engine
    splits if a node has very many links. The number of rounds grows with the logarithm of the largest
    component; links never exceed those given. Null ends and loops are ignored. Returns node, label.
    """
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has exchanges of its own and a node with very many links can be split.
        few = -(-before[0] // LINKS_PER_TASK)
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(few))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small.coalesce(few))
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

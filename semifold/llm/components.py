"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semifold.llm.lineage import release, stored


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its v. The minimum combines before the shuffle; in the join a hub's rows are
    the large side, which adaptive execution splits, against one row of the small side."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and root (the least node reachable) for every node of links; links are undirected and may repeat.

    Each round writes its links as a table to the shared folder and deletes that of the round before (a checkpoint would
    carry on its plan's constraints, which pile up over the rounds); there are about as many rounds as the logarithm of
    the largest component's diameter. Links with a null end are left out.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    pairs = stored(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbours(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        small = _least_neighbours(large)
        kept = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        before, pairs = pairs, stored(kept.where(F.col("u") != F.col("v")).distinct(), "links")
        release(before)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == tuple(now):
            break
        state = tuple(now)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

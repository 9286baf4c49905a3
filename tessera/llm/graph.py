"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored

#: Links that one task handles.
FEW = 100_000


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of links (a, b), 64-bit integers.

    Each round points every node at the least neighbour, with one row for each link; it ends after about log(longest
    path) rounds. Nodes with very many links need no group in one task: least neighbours are pre-aggregated and the
    joins' hot keys can be split. Links with a null end are ignored; repeated links and loops do no harm.
    """
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while (now := edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != state:
        state = now
        if state[0] <= FEW:
            edges = edges.coalesce(1)  # then a round needs no shuffle
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if state[0] <= FEW else both
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v")))
        small = small.coalesce(1) if state[0] <= FEW else small
        edges = stored(small.distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

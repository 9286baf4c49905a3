"""Taxa as paths of names, each ended by a semicolon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.common import small


def names(path: Column) -> Column:
    return F.filter(F.split(path, ";"), lambda x: x != "")


def prefixes(path: Column) -> Column:
    """Paths of all ancestors, from the root to the path itself."""
    own = names(path)
    return F.transform(own, lambda _, i: F.concat(F.array_join(F.slice(own, 1, i + 1), ";"), F.lit(";")))


def ranks(paths: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """path, prefix, rank, name for each ancestor of each path that the taxonomy (path, node_id, rank) holds."""
    each = paths.select("path", F.explode(prefixes(F.col("path"))).alias("prefix")).distinct()
    known = taxonomy.select(F.col("path").alias("prefix"), "rank")
    return each.join(small(known), "prefix").select("path", "prefix", "rank", level_name(F.col("prefix")).alias("name"))


def level_name(path: Column) -> Column:
    """The last name of a path."""
    return F.element_at(names(path), -1)


def names_per_rank(taxonomy: DataFrame) -> DataFrame:
    """rank, n, names (array, ascending) of a taxonomy."""
    own = taxonomy.select("rank", level_name(F.col("path")).alias("name")).distinct()
    return own.groupBy("rank").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def by_path(taxonomy: DataFrame, paths: DataFrame) -> DataFrame:
    """Exact join of paths with the taxonomy."""
    return paths.join(small(taxonomy), "path")

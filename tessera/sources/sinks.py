"""Writers: listings, classifications, abundances, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import as_text


def write_listings(rows: DataFrame, reads: DataFrame, path: str) -> None:
    """Two lines for each read, in order of read_id: its name, and its items from the right end. reads: read_id, name."""
    lines = reads.select("read_id", "name").join(as_text(rows), "read_id", "left")
    lines.repartitionByRange("read_id").sortWithinPartitions("read_id").select(F.concat(F.lit(">"), "name", F.lit("\n"), F.coalesce("line", F.lit(""))).alias("value")).write.text(path)


def write_classification(ranked: DataFrame, reads: DataFrame, path: str, taxon: str = "label") -> None:
    """A line for each read, in order of read_id: its name, then up to three taxa and weights, separated by tabs."""
    each = F.concat_ws("\t", F.col(taxon), F.col("weight").cast("string"))
    tops = ranked.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", each.alias("t")))), lambda x: x["t"]), "\t").alias("tops"))
    reads.select("read_id", "name").join(tops, "read_id", "left").repartitionByRange("read_id").sortWithinPartitions("read_id").select(F.concat_ws("\t", "name", "tops").alias("value")).write.text(path)


def write_abundance(counts: DataFrame, path: str) -> None:
    """taxon and count, the most frequent first."""
    counts.orderBy(F.desc("n"), "taxon").select("taxon", "n").write.csv(path, sep="\t")


def write_profiles(profiles: DataFrame, path: str, n: int = 0) -> None:
    """The first n profiles (all if n is 0) as lines, in order of runs: the lengths of full profiles; the character and then
    document and length of each stored pair of top-k profiles, and of taxonomic ones those from the left, `;`, those from the right."""
    rows = profiles.orderBy("run_id", F.desc("side"))
    rows = rows.limit(n) if n > 0 else rows
    pairs = lambda c: F.array_join(F.flatten(F.transform(F.col(c), lambda p: F.array(p["doc"].cast("string"), p["len"].cast("string")))), ",")
    if "lens" in profiles.columns:
        line = F.array_join(F.transform("lens", lambda x: x.cast("string")), ",")
    elif "top" in profiles.columns:
        line = F.concat_ws(",", "ch", pairs("top"))
    else:
        line = F.concat(F.col("ch"), F.lit(","), pairs("left"), F.lit(";"), pairs("right"))
    rows.select(line.alias("value")).write.text(path)

"""Listings as text: two lines for each read, its name and its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.records import numbered_rows, placed, split_rows

ITEM = r"\[(\d+),(\d+)\] \{([0-9,]*)\}"


def parse_lines(lines: DataFrame) -> DataFrame:
    """read_id, ord, s, e, docs of each item of lines (read_id, line). An empty document list is an empty array."""
    items = lines.select("read_id", F.posexplode(F.expr(rf"regexp_extract_all(line, '\\[[0-9]+,[0-9]+\\] \\{{[0-9,]*\\}}', 0)")).alias("ord", "item"))
    part = [F.regexp_extract("item", ITEM, i) for i in (1, 2, 3)]
    docs = F.transform(F.filter(F.split(part[2], ","), lambda x: x != ""), lambda x: x.cast("long"))
    return items.select("read_id", "ord", part[0].cast("int").alias("s"), part[1].cast("int").alias("e"), docs.alias("docs"))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, name and line of each read of a listings file or folder. A record begins with a `>` that begins a line, so that
    files can be split and names may hold one; ordinal is its place in the input, from 0."""
    rows = placed(split_rows(spark, path, "\n>"))
    firsts = rows.where("_block = 0").groupBy("_file").agg(F.min("_at").alias("_first"))
    rows = rows.join(F.broadcast(firsts), "_file", "left")  # a row for each file
    text = F.when(F.col("_at") == F.col("_first"), F.regexp_replace("value", "^\\s*>", "")).otherwise(F.col("value"))
    two = F.split(text, "\n", 2)
    records = numbered_rows(rows.where("trim(value) <> ''"))
    part = [F.regexp_replace(F.coalesce(F.get(two, F.lit(i)), F.lit("")), r"^\s+|\s+$", "") for i in (0, 1)]
    return records.select("ordinal", part[0].alias("name"), part[1].alias("line"))


def mates(one: DataFrame, two: DataFrame, check_names: bool = True) -> DataFrame:
    """ordinal, stem, line_1, line_2: reads of two listings (ordinal, name, line) by their place. With check_names, names that do not agree
    but for their last character, and a read whose mate is missing, are errors when the rows are read; without, reads without a mate are
    left out."""
    stem = F.expr("substring(name, 1, length(name) - 1)")
    a, b = (x.select("ordinal", stem.alias(f"stem_{n}"), F.col("line").alias(f"line_{n}")) for n, x in ((1, one), (2, two)))
    both = a.join(b, "ordinal", "full" if check_names else "inner")
    if not check_names:
        return both.select("ordinal", F.col("stem_1").alias("stem"), "line_1", "line_2")
    wrong = F.raise_error(F.concat(F.lit("no mate for the read "), F.coalesce("stem_1", "stem_2", F.lit(""))))
    agreed = F.coalesce(F.col("stem_1") == F.col("stem_2"), F.lit(False))
    return both.select("ordinal", *[F.when(~agreed, wrong).otherwise(F.col(c)).alias(n) for c, n in (("stem_1", "stem"), ("line_1", "line_1"), ("line_2", "line_2"))])

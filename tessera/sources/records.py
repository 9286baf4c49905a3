"""Rows of text files in their order, over split files: ordinals, and records of a fixed number of lines put together where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.plans.common import stored
from tessera.sources.gzip_members import can_open, member_rows


def split_rows(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """value, _file, _block (in the order of a file: where the row's split begins in it) and _k, the row's number in its block where rows are
    not in their order, else null. Members of gzip files are read side by side, other files by splits."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    plain = reader.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.lit(None).cast("long").alias("_k"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), "path", "length")
    packed = files.where("endswith(path, '.gz')")
    first = packed.first()
    if first is None or not can_open(first.path):
        return plain
    rows = member_rows(packed, separator or "\n")
    return rows if files.where("NOT endswith(path, '.gz')").isEmpty() else rows.unionByName(plain.where("NOT endswith(_file, '.gz')"))


def placed(rows: DataFrame) -> DataFrame:
    """rows of split_rows, stored, with `_at`, ascending within each block."""
    return stored(rows.withColumn("_at", F.coalesce("_k", F.monotonically_increasing_id())).drop("_k"), "split-rows")


def numbered_rows(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """rows of placed() with their number from 0 in the order of files and of rows within them: counted by split, and the splits'
    counts added up."""
    before = _before(rows.groupBy("_file", "_block").agg(F.count("*").alias("_n")))
    within = rows.withColumn("_k", F.row_number().over(W.partitionBy("_file", "_block").orderBy("_at")) - 1)
    return within.join(F.broadcast(before), ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_k", "_before", "_n")  # a row for each split


def _before(counts: DataFrame) -> DataFrame:
    return counts.withColumn("_before", F.sum("_n").over(W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))


def in_records(source: DataFrame, lines: int, make: Callable[[list[list[str]]], list[pa.Array]], schema: T.StructType) -> DataFrame:
    """The rows that make gives for records of so many lines of split_rows each, with `_file` and `_ordinal` (the record's in its file).

    Lines are counted by split first, so that a split knows which of its lines begins a record. Records are put together where they
    lie; only those that cross the border of two splits, one for each split at most, are moved.
    """
    counts = stored(source.groupBy("_file", "_block").agg(F.count("*").alias("_n")), "line-counts")
    over = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    before = counts.select("_file", "_block", (F.sum("_n").over(over) - F.col("_n")).alias("_before"))
    out = T.StructType([T.StructField("_file", T.StringType()), T.StructField("_ordinal", T.LongType()), T.StructField("_line", T.LongType()), T.StructField("_lines", T.ArrayType(T.StringType()))])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, held, first = None, 0, [], 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], out.names)
            rows.clear()
            return batch

        for batch in batches:
            for value, file, block, k, upto in zip(*[batch.column(c).to_pylist() for c in ("value", "_file", "_block", "_k", "_before")], strict=True):
                place = at if k is None else upto + k
                if (file, block) != key or place != at:
                    if held:
                        rows.append((key[0], first // lines, first, held))
                    key, at, held = (file, block), upto if k is None else place, []
                if at % lines == 0 and held:
                    rows.append((file, first // lines, first, held))
                    held = []
                if not held:
                    first = at
                held.append(value)
                at += 1
            yield flush()
        if held:
            rows.append((key[0], first // lines, first, held))
        yield flush()

    # a broadcast keeps the order of lines: a row for each split
    pieces = source.join(F.broadcast(before), ["_file", "_block"]).select("value", "_file", "_block", "_k", "_before").mapInArrow(gathered, out)
    pieces = stored(pieces, "record-pieces")
    whole = pieces.where(F.size("_lines") == lines).select("_file", "_ordinal", "_lines")
    # the first lines of a record that is cut lie at the end of a split, or of a part of a table, the others at the start of a later one
    cut = pieces.where(F.size("_lines") < lines).groupBy("_file", "_ordinal").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_lines"))), lambda x: x["_lines"])).alias("_lines"))
    final = T.StructType([*out.fields[:2], *schema.fields])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *make(batch.column(2).to_pylist())], final.names)

    return whole.unionByName(cut).mapInArrow(parsed, final)

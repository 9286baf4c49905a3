"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"

#: A side of a join is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs on one machine, as
    in tests, a new one; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """The file system deletes path when the driver ends."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again. Cuts the lineage: a lost executor costs no recomputation.
    The table goes when the driver ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint for a stored table if its count allows it; beyond that the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, tasks in Python get at most so many rows at once; for actions on whole texts, which end within it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unused(columns: list[str], *names: str) -> list[str]:
    """names that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole(text: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, over all cores even if its files give fewer partitions."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def appended(df: DataFrame, value: Column, made: str, make: Callable[[pa.Array], list[pa.Array]], at_once: int = 4 << 20) -> DataFrame:
    """df with the columns `made` (names and types, as in SQL) that make gives for an array of values, some rows at a time: as many as
    hold about at_once bytes. Columns of df that have such a name go."""
    new = T.StructType.fromDDL(made)
    gone = {n.lower() for n in new.names}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]
    rows = df.select(*keep, value.alias(unused(df.columns, "_value")[0]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * at_once // max(batch.column(batch.num_columns - 1).nbytes, at_once))
            for at in range(0, max(batch.num_rows, 1), step):
                part = batch.slice(at, step)
                *own, values = part.columns
                yield pa.RecordBatch.from_arrays([*own, *make(values)], [*part.schema.names[:-1], *new.names])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields[:-1], *new.fields]))

"""Plans that several operators use: stored tables, chunked k-mers, global order without one task for all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side of a join is broadcast only if a count has shown that it has at most so many rows.
BROADCAST_ROWS = 200_000
CHUNK = 256
#: Consecutive rows that one task numbers or sums.
BUCKET_ROWS = 1 << 20
#: Files of buckets that a task keeps open; with more buckets than that Spark sorts its rows by them.
WRITERS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all runs on one machine, as in tests, a new one; on a
    cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(own.getParent())
    files.deleteOnExit(own)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again; cuts the lineage. The table goes when the driver ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the count of df allows it; else a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are: texts are short to move and long to search."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def dna(text: str = "text") -> Column:
    """The letters A, C, G and T of a text, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^ACGTacgt]", ""))


def kmers(df: DataFrame, seq: str, k: int, pos: str = "pos", kmer: str = "kmer") -> DataFrame:
    """A row for each k-mer of column seq, which goes. Texts are cut into chunks that overlap by k - 1 first: a substring
    of a long text is found by walking to it, a substring of a chunk at once."""
    starts = F.expr(f"CASE WHEN length({seq}) >= {k} THEN sequence(0, length({seq}) - {k}, {CHUNK}) ELSE cast(array() AS array<int>) END")
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col(seq), i + 1, F.lit(CHUNK + k - 1)).alias("part")))
    rest = [c for c in df.columns if c != seq]
    chunks = spread(df).select(*rest, F.explode(cut).alias("_c")).select(*rest, "_c.at", "_c.part")
    each = F.transform(F.expr(f"sequence(1, length(part) - {k - 1})"), lambda i: F.struct((F.col("at") + i - 1).alias(pos), F.substring(F.col("part"), i, F.lit(k)).alias(kmer)))
    return chunks.select(*rest, F.explode(each).alias("_k")).select(*rest, f"_k.{pos}", f"_k.{kmer}")


def grams(df: DataFrame, seq: str, k: int, pos: str = "pos", gram: str = "gram") -> DataFrame:
    """A row for each character of column seq, which goes, with the k characters from there on, fewer at the end."""
    starts = F.expr(f"CASE WHEN length({seq}) > 0 THEN sequence(0, length({seq}) - 1, {CHUNK}) ELSE cast(array() AS array<int>) END")
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col(seq), i + 1, F.lit(CHUNK + k - 1)).alias("part")))
    rest = [c for c in df.columns if c != seq]
    chunks = spread(df).select(*rest, F.explode(cut).alias("_c")).select(*rest, "_c.at", "_c.part")
    each = F.transform(F.expr(f"sequence(1, least({CHUNK}, length(part)))"), lambda i: F.struct((F.col("at") + i - 1).alias(pos), F.substring(F.col("part"), i, F.lit(k)).alias(gram)))
    return chunks.select(*rest, F.explode(each).alias("_k")).select(*rest, f"_k.{pos}", f"_k.{gram}")


def substrings(df: DataFrame, seq: str, most: int, pos: str = "pos", lmer: str = "lmer", lengths: list[int] | None = None) -> DataFrame:
    """A row for each substring of 1 to `most` characters of column seq, which goes; or only of the lengths given. Texts are cut
    into chunks first."""
    starts = F.expr(f"CASE WHEN length({seq}) > 0 THEN sequence(0, length({seq}) - 1, {CHUNK}) ELSE cast(array() AS array<int>) END")
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col(seq), i + 1, F.lit(CHUNK + most - 1)).alias("part")))
    rest = [c for c in df.columns if c != seq]
    chunks = spread(df).select(*rest, F.explode(cut).alias("_c")).select(*rest, "_c.at", "_c.part")
    each = F.expr(f"""flatten(transform(sequence(1, least({CHUNK}, length(part))), i ->
        transform({f"filter(array({', '.join(map(str, lengths))}), n -> n <= length(part) - i + 1)" if lengths else f"sequence(1, least({most}, length(part) - i + 1))"}, n -> named_struct('{pos}', at + i - 1, '{lmer}', substring(part, i, n)))))""")
    return chunks.select(*rest, F.explode(each).alias("_k")).select(*rest, f"_k.{pos}", f"_k.{lmer}")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with `name`, its global row number from 0. Rows are range partitioned, numbered within each partition, and the
    partitions' sizes added up: no task sees all rows. The partitioned rows are stored first, so that all steps see the
    same partitions."""
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = parts.withColumn("_rn", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_rn") - 1).drop("_part", "_rn", "_before")  # a row for each partition


def neighbours(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """key, before, after: for each key of asked the nearest key of held at or before it, and at or after it; null if none is. Both have
    distinct keys. Ranges of keys are read side by side, and what lies beyond a range's ends comes from the others' ends."""
    both = held.select(key, F.lit(True).alias("_held")).unionByName(asked.select(key, F.lit(False).alias("_held")))
    both = both.groupBy(key).agg(F.max("_held").alias("_held"), F.min("_held").alias("_all_held"))
    parts = stored(both.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "key-ranges")
    own = F.when(F.col("_held"), F.col(key))
    ends = parts.groupBy("_part").agg(F.min(own).alias("_lo"), F.max(own).alias("_hi"))
    ends = ends.select("_part", F.last("_hi", True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_hi"), F.last("_lo", True).over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_lo"))
    # frames that grow row by row; one that begins at its row is read again for each
    upto = lambda order: F.last(own, True).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = parts.withColumn("before", upto(F.asc(key))).withColumn("after", upto(F.desc(key)))
    out = rows.where("NOT _all_held").join(F.broadcast(ends), "_part")  # a row for each partition
    return out.select(key, F.coalesce("before", "_hi").alias("before"), F.coalesce("after", "_lo").alias("after"))


def running_sum(df: DataFrame, name: str, value: Column, row: str) -> DataFrame:
    """df with `name`, the sum of value over all rows up to this one, by the row numbers in column row."""
    own = df.withColumn("_b", F.floor(F.col(row) / BUCKET_ROWS)).withColumn("_v", value)
    total = own.groupBy("_b").agg(F.sum("_v").alias("_t"))
    before = total.select("_b", (F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_before"))
    out = own.withColumn("_s", F.sum("_v").over(W.partitionBy("_b").orderBy(row).rowsBetween(W.unboundedPreceding, 0)))
    return out.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + F.col("_s")).drop("_b", "_v", "_s", "_before")  # a row for each bucket


def listed(ids: Column) -> Column:
    """Ids as text, ascending, joined by commas."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """df as a Parquet table under path in buckets by the keys. A task writes a file of its own for each, so that nothing is shuffled,
    and up to WRITERS of them at once, so that nothing is sorted."""
    name = f"tessera_{uuid.uuid4().hex}"
    spark, at_once = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(at_once)
    spark.conf.set(at_once, min(buckets, WRITERS) + 1)  # the last one makes Spark sort
    try:
        df.write.format("parquet").bucketBy(buckets, *keys).option("compression", "zstd").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(at_once, before)
    spark.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """The table that write_bucketed wrote: a join on its keys needs no shuffle of it. The catalog knows it only while it is resolved."""
    name = f"tessera_{uuid.uuid4().hex}"
    by, at = ", ".join(keys), path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}'")
    df = spark.table(name)
    df.schema  # resolved before the name goes  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return df

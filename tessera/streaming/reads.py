"""A stream of reads against a static index of k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.ftab import K_DNA
from tessera.plans.common import kmers, small


def read_stream(spark: SparkSession, path: str, schema: str = "read_id long, seq string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def votes(reads: DataFrame, index: DataFrame, k: int = K_DNA) -> DataFrame:
    """read_id, doc_id, n: k-mers of each read that each document holds. index: kmer, docs. On a stream this keeps a state for
    each read; answered() does without."""
    hits = kmers(reads.select("read_id", "seq"), "seq", k).join(small(index), "kmer")
    return hits.select("read_id", F.explode("docs").alias("doc_id")).groupBy("read_id", "doc_id").agg(F.count("*").alias("n"))


def answered(stream: DataFrame, index: DataFrame, out: str, checkpoint: str, k: int = K_DNA) -> StreamingQuery:
    """Writes the votes of each micro-batch's reads to a folder of its own under `out`. A read lies within one batch, so that
    nothing is kept from batch to batch; a batch that is run again replaces its folder."""

    def write(batch: DataFrame, n: int) -> None:
        votes(batch, index, k).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

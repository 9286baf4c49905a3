"""A stream of reads listed against a stored seed index, batch by batch; mates that come apart wait for each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import matching as M
from tessera.operators import voting as V
from tessera.operators.seeds import Seeds

READ = "read_id long, name string, seq string, ts timestamp"


def read_stream(spark: SparkSession, path: str, schema: str = READ) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def listed(stream: DataFrame, seeds: Seeds, out: str, checkpoint: str, exact: bool = True, classes: DataFrame | None = None) -> StreamingQuery:
    """Writes the listing of each micro-batch's reads (read_id, seq) to a folder of its own under `out`. A batch that is run again, as
    after a restart, replaces its folder, so that each read is listed once. read_ids are distinct within a batch."""

    def write(batch: DataFrame, n: int) -> None:
        M.listing(None, batch.select("read_id", "seq"), seeds.k, exact, classes, seeds).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def joined_mates(one: DataFrame, two: DataFrame, late: str = "1 hour") -> DataFrame:
    """read_id, seq_1, seq_2, ts of pairs from two streams (read_id, seq, ts). Mates may come in different batches: a read is held
    until its mate comes, or until the watermark has passed its time by `late`, and then given up, so that state is bounded."""
    a = one.select(F.col("read_id"), F.col("seq").alias("seq_1"), "ts").withWatermark("ts", late)
    b = two.select(F.col("read_id").alias("id_2"), F.col("seq").alias("seq_2"), F.col("ts").alias("ts_2")).withWatermark("ts_2", late)
    near = F.expr(f"read_id = id_2 AND ts_2 BETWEEN ts - INTERVAL {late} AND ts + INTERVAL {late}")
    return a.join(b, near).select("read_id", "seq_1", "seq_2", "ts")


def listed_pairs(pairs: DataFrame, seeds: Seeds, out: str, checkpoint: str, exact: bool = True, classes: DataFrame | None = None) -> StreamingQuery:
    """Writes the listing of both mates of each pair (of joined_mates) as one: read_id, ord, s, e, docs, mate (1 or 2)."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()  # the state store is read once
        own = [M.listing(None, batch.select("read_id", F.col(f"seq_{i}").alias("seq")), seeds.k, exact, classes, seeds) for i in (1, 2)]
        V.paired(*own).write.mode("overwrite").parquet(f"{out}/batch={n}")
        batch.unpersist()

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

"""Classify reads by votes of their matches, and count what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TOP = 3


def votes(rows: DataFrame) -> DataFrame:
    """read_id, doc_id, weight: each match adds its length to every document that it lists."""
    each = rows.select("read_id", (F.col("e") - F.col("s") + 1).cast("long").alias("n"), F.explode("docs").alias("doc_id"))
    return each.groupBy("read_id", "doc_id").agg(F.sum("n").alias("weight"))


def range_votes(rows: DataFrame, n_docs: int, k: int | None = None) -> DataFrame:
    """read_id, doc_id, weight: each match shares its length among all documents from the first to the last that it lists.
    Documents are 0 ... n_docs - 1.

    A read's matches cut the documents into stretches of equal weight, no more than twice its matches, and a weight is
    counted once for each. With k, a stretch gives a row for its first k documents only: the heaviest k are among them.
    Without it, all its documents have one.
    """
    spans = rows.where(F.size("docs") > 0).select("read_id", F.array_min("docs").alias("lo"), F.array_max("docs").alias("hi"), (F.col("e") - F.col("s") + 1).alias("n"))
    spans = spans.withColumn("share", F.col("n") / (F.col("hi") - F.col("lo") + 1)).groupBy("read_id", "lo", "hi").agg(F.sum("share").alias("share"))
    own = spans.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "share"))).alias("x"))
    own = own.withColumn("at", F.expr("array_sort(array_distinct(concat(transform(x, y -> y.lo), transform(x, y -> y.hi + 1))))"))
    own = own.select("read_id", "x", F.explode(F.expr("zip_with(at, slice(at, 2, size(at)), (a, b) -> struct(a, b))")).alias("p")).where("p.b IS NOT NULL")
    weight = F.round(F.expr("aggregate(filter(x, y -> y.lo <= p.a AND p.a <= y.hi), 0D, (a, y) -> a + y.share)"), 3)
    own = own.select("read_id", F.col("p.a").alias("lo"), F.least(F.col("p.b"), F.lit(n_docs)).alias("end"), weight.alias("weight")).where("weight > 0 AND lo < end")
    end = F.col("end") if k is None else F.least("end", F.col("lo") + k)
    return own.select("read_id", F.explode(F.sequence(F.col("lo"), end - 1)).alias("doc_id"), "weight")


def with_silent(weights: DataFrame, reads: DataFrame, documents: DataFrame) -> DataFrame:
    """weights with a row of 0 for every read and document without one. Grows as reads times documents: for small classes."""
    every = reads.select("read_id").withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(documents.count() - 1))))
    return every.join(weights, ["read_id", "doc_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def top(weights: DataFrame, k: int = TOP) -> DataFrame:
    """read_id, rnk, doc_id, weight: the heaviest k, ties to the smaller id."""
    order = W.partitionBy("read_id").orderBy(F.desc("weight"), "doc_id")
    return weights.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).select("read_id", "rnk", "doc_id", "weight")


def labelled(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """ranked with the label of each document. labels: doc_id, label."""
    return ranked.join(labels, "doc_id", "left")


def paired(mate_1: DataFrame, mate_2: DataFrame) -> DataFrame:
    """Listings of both mates as one of the pair. Both have read_id, ord, s, e, docs; a pair needs both mates."""
    both = mate_1.select("read_id").distinct().join(mate_2.select("read_id").distinct(), "read_id", "left_semi")
    return mate_1.withColumn("mate", F.lit(1)).unionByName(mate_2.withColumn("mate", F.lit(2))).join(both, "read_id", "left_semi")


def abundance(ranked: DataFrame, label: str = "label") -> DataFrame:
    """taxon, n: reads by the label of their heaviest document."""
    return ranked.where("rnk = 1").groupBy(F.col(label).alias("taxon")).agg(F.count("*").alias("n"))

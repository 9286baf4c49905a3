"""Tables of k-mers: what a document collection holds, for probing before any matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.common import kmers, small

K_DNA, K_SYMBOLS = 10, 3


def kmer_table(docs: DataFrame, seq: str, k: int) -> DataFrame:
    """kmer, n, n_docs for each k-mer of docs (doc_id, seq). Counts are pre-aggregated by document."""
    per_doc = kmers(docs.select("doc_id", seq), seq, k).groupBy("kmer", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


def ftab(docs: DataFrame, seq: str, k: int = K_DNA) -> DataFrame:
    """kmer, docs (array, ascending): the documents that hold each k-mer. A collection has fewer than 65,535 documents, so
    that an array stays below 0.3 MB; documents are made distinct before they are gathered."""
    found = kmers(docs.select("doc_id", seq), seq, k).select("kmer", "doc_id").distinct()
    return found.groupBy("kmer").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


def probe(reads: DataFrame, seq: str, known: DataFrame, k: int = K_DNA, found: bool = True) -> DataFrame:
    """read_id and pos of the k-mers of reads that `known` (kmer) holds, or does not hold."""
    own = kmers(reads.select("read_id", seq), seq, k)
    return own.join(small(known.select("kmer").distinct()), "kmer", "left_semi" if found else "left_anti").select("read_id", "pos", "kmer")

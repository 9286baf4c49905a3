"""A stored index of seeds: places of a collection with the strings around them, in buckets, so that reads are joined to it where it lies.

Not every place is kept, but one of each few: a match of k characters holds such a place with a shorter string after it, wherever it
begins, and the characters on either side tell which matches of k characters lie there. So nothing is lost, and nothing but the index
is needed. Tasks write their own files of each bucket: no seed is shuffled.

A string with very many places is dealt over several salts, and what looks it up asks for each of them: no bucket holds more of
one string than about HOT places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.common import read_bucketed, small, spread, stored, write_bucketed

#: Places of one string that are kept together, and of a bucket.
HOT, BUCKET_PLACES = 1 << 20, 1 << 22
#: Of this many stretches of text one is counted at most, to find the strings with more than HOT places.
COUNTED = 64
KEYS = ["kmer", "salt"]


def step(k: int) -> int:
    """Of how many places the index for matches of k characters keeps one; its strings have k - step + 1 characters."""
    return max(1, 5 * k // 12)


def _before(at: Column, margin: int) -> Column:
    """How many of the characters around a place stand before it."""
    return F.least(at, F.lit(margin))


def _stretches(rows: DataFrame, k: int, every: int) -> DataFrame:
    """rows without their text, with at, lead and part: the stretch of the text that begins at `at`, lead characters before it, and as many
    after its end as its last place needs. Long texts are cut twice: a substring is found by walking to it."""
    own, margin = [c for c in rows.columns if c != "text"], step(k) - 1
    long, short = every * 256, every * 16
    starts = F.expr(f"CASE WHEN length(text) > 0 THEN sequence(0, length(text) - 1, {long}) ELSE cast(array() AS array<int>) END")
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col("text"), i - _before(i, margin) + 1, _before(i, margin) + long + k - 1).alias("part")))
    wide = spread(rows).select(*own, F.explode(cut).alias("_c")).select(*own, "_c.at", "_c.part").withColumn("lead", _before(F.col("at"), margin))
    starts = F.expr(f"CASE WHEN length(part) > lead THEN sequence(0, least({long}, length(part) - lead) - 1, {short}) ELSE cast(array() AS array<int>) END")

    def narrow(j: Column) -> Column:
        lead = _before(F.col("at") + j, margin)
        return F.struct((F.col("at") + j).alias("at"), lead.alias("lead"), F.substring(F.col("part"), F.col("lead") + j - lead + 1, lead + short + k - 1).alias("part"))

    return wide.select(*own, F.explode(F.transform(starts, narrow)).alias("_c")).select(*own, "_c.*")


def _places(stretches: DataFrame, k: int, every: int) -> DataFrame:
    """Rows of stretches with q, kmer and around for each place of one in `every` from which a whole string goes: the characters before it
    and after its string, as many of each as lie between two kept places, or as there are."""
    own, margin, width = [c for c in stretches.columns if c not in ("at", "lead", "part")], step(k) - 1, k - step(k) + 1
    short = every * 16
    starts = F.expr(f"CASE WHEN length(part) - lead >= {width} THEN sequence(0, least({short}, length(part) - lead - {width} + 1) - 1, {every}) ELSE cast(array() AS array<int>) END")
    each = stretches.select(*own, "at", "lead", "part", F.explode(starts).alias("_i"))
    at, q = F.col("lead") + F.col("_i"), F.col("at") + F.col("_i")
    before = _before(q, margin)
    around = F.concat(F.substring(F.col("part"), at - before + 1, before), F.substring(F.col("part"), at + width + 1, F.lit(margin))) if margin else F.lit("")
    return each.select(*own, q.alias("q"), F.substring(F.col("part"), at + 1, F.lit(width)).alias("kmer"), around.alias("around"))


@dataclass(frozen=True)
class Seeds:
    """places: kmer, salt, doc_id, q, around, in buckets; hot: kmer, salts of those with more than one; short: doc_id, text of texts that
    are shorter than k."""

    places: DataFrame
    hot: DataFrame
    short: DataFrame
    k: int

    def hits(self, reads: DataFrame) -> DataFrame:
        """read_id, p, doc_id, q for each k characters that a read (read_id, seq) has at p and a document at q."""
        own = _places(_stretches(reads.select("read_id", F.col("seq").alias("text")), self.k, 1), self.k, 1).select("read_id", F.col("q").alias("r"), "kmer", F.col("around").alias("beside"))
        salted = own.join(small(self.hot), "kmer", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        margin = step(self.k) - 1

        def agree(j: int) -> Column:
            """Whether the j characters before and the others after are there on both sides and the same."""
            sides = [(F.col("around"), _before(F.col("q"), margin)), (F.col("beside"), _before(F.col("r"), margin))]
            enough = [(n >= j) & (F.length(s) - n >= margin - j) for s, n in sides]
            same = [F.substring(s, n - j + 1, F.lit(margin)) for s, n in sides]
            return enough[0] & enough[1] & (same[0] == same[1])

        back = F.array_compact(F.array(*[F.when(agree(j), F.lit(j)) for j in range(margin + 1)]))
        found = self.places.join(small(stored(salted, "salted-probes")), KEYS)
        found = found.select("read_id", "doc_id", "r", "q", F.explode(back).alias("j"))
        return found.select("read_id", (F.col("r") - F.col("j")).alias("p"), "doc_id", (F.col("q") - F.col("j")).alias("q"))

    @property
    def texts(self) -> DataFrame:
        """doc_id, text: rows of which one holds each string of at most k characters that a document holds."""
        n = _before(F.col("q"), step(self.k) - 1)
        whole = F.concat(F.substring(F.col("around"), F.lit(1), n), "kmer", F.substring(F.col("around"), n + 1, F.length("around")))
        return self.places.select("doc_id", whole.alias("text")).unionByName(self.short)


def write(docs: DataFrame, path: str, k: int, hot: int | None = None) -> dict[str, int]:
    """Write the seeds of docs (doc_id, text) under path; what read() needs to know of them. Null and empty texts have none."""
    spark = docs.sparkSession
    hot, every = hot or HOT, step(k)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.agg(F.sum(F.ceil(F.greatest(F.length("text") - (k - every), F.lit(0)) / every))).first()[0] or 0
    stretches = _stretches(docs, k, every)
    # how places are dealt changes no result: stretches by hash tell which strings have too many
    counted = max(1, min(COUNTED, hot // 1024))
    counts = _places(stretches.where(F.pmod(F.xxhash64("doc_id", "at"), F.lit(counted)) == 0), k, every).groupBy("kmer").agg((F.count("*") * counted).alias("n"))
    counts.where(F.col("n") > hot).select("kmer", F.ceil(F.col("n") / hot).cast("int").alias("salts")).write.parquet(f"{path}/hot")
    salts = spark.read.schema("kmer string, salts int").parquet(f"{path}/hot")
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "q"), F.col("salts")), F.lit(0)).cast("int")
    rows = _places(stretches, k, every).join(small(salts), "kmer", "left").select("kmer", salt.alias("salt"), "doc_id", "q", "around")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_PLACES))
    write_bucketed(rows, f"{path}/places", KEYS, buckets)
    docs.where(F.length("text").between(1, k - 1)).write.parquet(f"{path}/short")
    return {"seed": k, "seed_buckets": buckets}


def read(spark: SparkSession, path: str, seed: int, seed_buckets: int) -> Seeds:
    places = read_bucketed(spark, f"{path}/places", "kmer string, salt int, doc_id bigint, q int, around string", KEYS, seed_buckets)
    return Seeds(places, spark.read.schema("kmer string, salts int").parquet(f"{path}/hot"), spark.read.schema("doc_id bigint, text string").parquet(f"{path}/short"), seed)

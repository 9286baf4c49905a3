"""The commands: build an index, run reads against it, show it, analyse listings, extract archives."""

from __future__ import annotations

import os
import tarfile
from dataclasses import asdict, dataclass
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import sequences as S
from tessera.operators import ftab as T
from tessera.operators import index as I
from tessera.operators import matching as M
from tessera.operators import profiles as P
from tessera.operators import seeds as SD
from tessera.operators import taxonomy as X
from tessera.operators import voting as V
from tessera.plans.common import stored
from tessera.sources import sinks
from tessera.sources.listings import mates, parse_lines, read_listings
from tessera.sources.sequences import read_collection, read_doc_taxa, read_file_list, read_reads, read_taxonomy

MAX_DOCS = 65_535
#: Tables of every index; ftab may be one more.
TABLES = ["sequences", "members", "flagged", "profiles", "seeds/places", "seeds/hot", "seeds/short"]
#: Symbols of a seed over the minimizer alphabet, unless told otherwise: each stands for several letters.
SYMBOL_SEED = 4


def check_minimizer_options(k: int, w: int, alphabet: bool = False) -> None:
    if not 0 < k <= 31:
        raise ValueError("k must lie in 1..31")
    if w < k:
        raise ValueError("w must be k at least")
    if alphabet and k != 4:
        raise ValueError("the minimizer alphabet needs k = 4")


@dataclass(frozen=True)
class BuildOptions:
    revcomp: bool = False
    taxcomp: bool = False
    topk: bool = False
    columns: int = 7
    minimizers: bool = False
    k: int = 4
    w: int = 11
    ftab: bool = True
    alphabet: bool = False
    seed: int | None = None
    max_length: int | None = None

    def __post_init__(self) -> None:
        if self.taxcomp and self.topk:
            raise ValueError("only one of taxcomp and topk can be asked for")
        if not 2 <= self.columns <= 20:
            raise ValueError("columns must lie in 2..20")
        if self.alphabet and self.minimizers:
            raise ValueError("only one of minimizers and alphabet can be asked for")
        if self.max_length is not None and self.max_length < 1:
            raise ValueError("max_length must be positive")
        check_minimizer_options(self.k, self.w, self.alphabet)

    @property
    def seed_length(self) -> int:
        return self.seed or (SYMBOL_SEED if self.alphabet else M.SEED)


def as_indexed(seq: Column, options: dict) -> Column:
    """A sequence or read as an index with these options holds it: upper case, a digest, or symbols."""
    seq = F.upper(seq)
    if options["minimizers"]:
        return S.digest(seq, options["k"], options["w"])
    if options["alphabet"]:
        return F.coalesce(S.spelled_symbols(S.alphabet_digest(seq, options["k"], options["w"])), F.lit(""))
    return seq


def sequences(spark: SparkSession, file_list: str, options: BuildOptions) -> DataFrame:
    """seq_id, doc_id, name, seq: upper case, with reverse complements and digests as asked for. With the minimizer alphabet a
    sequence is its minimizers' symbols, a character each, and one shorter than w is empty."""
    own = read_collection(spark, read_file_list(spark, file_list)).withColumn("seq", F.upper("seq"))
    if options.revcomp:
        twin = own.select(F.concat("name", F.lit("_rev_comp")).alias("name"), "doc_id", (-F.col("seq_id") - 1).alias("seq_id"), S.reverse_complement(F.col("seq")).alias("seq"))
        own = own.unionByName(twin)
    return own.withColumn("seq", as_indexed(F.col("seq"), asdict(options)))


def build(spark: SparkSession, file_list: str, out: str, options: BuildOptions | None = None) -> None:
    """Write the tables of an index under `out`: sequences and what they are members of, suffixes with their runs and common
    prefixes, profiles or the records of them that the compression keeps, seeds in buckets, k-mers, options. max_length: the lengths of
    profiles are clipped there."""
    options = options or BuildOptions()
    sequences(spark, file_list, options).write.parquet(f"{out}/sequences")
    own = spark.read.parquet(f"{out}/sequences")
    n_docs = own.agg(F.max("doc_id")).first()[0] + 1
    if n_docs >= MAX_DOCS:
        raise ValueError(f"fewer than {MAX_DOCS} documents are supported")
    if (options.taxcomp or options.topk) and options.columns > n_docs:
        raise ValueError("there are fewer documents than columns")
    own.select("seq_id", "doc_id", "name", F.length("seq").alias("n")).write.parquet(f"{out}/members")
    seeds = SD.write(own.select(F.col("seq_id").alias("doc_id"), F.col("seq").alias("text")), f"{out}/seeds", options.seed_length)
    I.with_runs(stored(I.suffixes(own), "suffixes")).write.parquet(f"{out}/flagged")
    flagged = spark.read.parquet(f"{out}/flagged")
    if options.taxcomp:
        kept = I.kept(flagged, "tax")
    elif options.topk:
        kept = I.kept(flagged, "top", options.columns).withColumn("top", P.padded(F.col("top"), n_docs, options.columns))
    else:
        kept = I.profiles(flagged, n_docs)
    if options.max_length is not None:
        kept = kept.select("run_id", "ch", "side", *[P.clipped(F.col(c), options.max_length, c).alias(c) for c in kept.columns if c in ("lens", "left", "right", "top")])
    kept.write.partitionBy("side").parquet(f"{out}/profiles")
    if options.ftab:
        T.ftab(own, "seq", T.K_SYMBOLS if options.alphabet else T.K_DNA).write.parquet(f"{out}/ftab")
    tables = TABLES + ["ftab"] * options.ftab
    checks = [(t, *content(spark, f"{out}/{t}")) for t in tables]
    spark.createDataFrame(checks, "name string, n long, content decimal(38,0)").write.parquet(f"{out}/checks")
    known = asdict(options) | seeds | {"n_docs": n_docs}
    schema = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in known.items())
    spark.createDataFrame([tuple(known.values())], schema).write.parquet(f"{out}/about")


def content(spark: SparkSession, path: str) -> tuple[int, Decimal]:
    """Count of a table's rows, and the sum of their hashes, which no order of rows changes."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e):  # a table in buckets without a row has no file
            return 0, Decimal(0)
        raise
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(each)).first()
    return n, total if total is not None else Decimal(0)


def about(spark: SparkSession, index: str, verify: bool = False) -> dict:
    """The options and sizes of an index; ValueError if a table is missing or has another count than at its building, or, with verify,
    another content."""
    try:
        own = spark.read.parquet(f"{index}/about").first().asDict()
        checks = spark.read.parquet(f"{index}/checks").collect()
    except AnalysisException as e:
        raise ValueError(f"{index} is no index") from e
    for name, n, total in checks:
        try:
            found = content(spark, f"{index}/{name}") if verify or not n else (spark.read.parquet(f"{index}/{name}").count(), total)
        except AnalysisException as e:
            raise ValueError(f"{name} is missing") from e
        if found[0] != n:
            raise ValueError(f"{name} has {found[0]} rows, not {n}")
        if found[1] != total:
            raise ValueError(f"{name} has changed")
        own[f"n_{name}"] = n
    return own


def run(spark: SparkSession, index: str, reads: DataFrame, out: str | None = None, seed: int | None = None, exact: bool = True, max_length: int | None = None) -> DataFrame:
    """Listing of reads (read_id, name, seq) against an index, written as text too if `out` is given, in order of read_id, with its
    metrics beside it in `out`.metrics.

    Matches of as many characters as the index's seeds, and more, come from its stored seeds, shorter ones from its distinct short
    strings; with exact=False the latter count as none. The collection is read only for seeds of another length.

    An index with taxonomic or top-k compression lists what its profiles keep: of the first suffix in the index's order
    that begins with a factor, the documents of the records, or of the k longest matches, that hold the factor. max_length: lengths
    are clipped there, as for reads of at most so many characters. With taxcomp and topk, factors shorter than seed match nothing.
    """
    options = about(spark, index)
    named = reads.select("read_id", as_indexed(F.col("seq"), options).alias("seq"))
    seed = seed or options["seed"]
    seeds = SD.read(spark, f"{index}/seeds", options["seed"], options["seed_buckets"]) if seed == options["seed"] else None
    own = spark.read.parquet(f"{index}/sequences") if seeds is None else None
    if options["taxcomp"] or options["topk"]:
        kind = "tax" if options["taxcomp"] else "top"
        rows = M.profiled_listing(own, spark.read.parquet(f"{index}/flagged"), options["n_docs"], named, seed, kind, options["columns"], seeds)
        n = F.col("e") - F.col("s") + 1
        most = max_length or options["max_length"]
        n = n if most is None else F.least(n, F.lit(most))
        cut = {c: F.col(c) if most is None else P.clipped(F.col(c), most, c) for c in rows.columns if c in ("left", "right", "top")}
        docs = P.tax_listing(cut["left"], cut["right"], n) if options["taxcomp"] else P.topk_listing(cut["top"], n)
        rows = rows.select("read_id", "ord", "s", "e", F.coalesce(docs, F.array().cast("array<int>")).alias("docs"))
    else:
        docs = None if own is None else own.select(F.col("seq_id").alias("doc_id"), F.col("seq").alias("text"))
        members = spark.read.parquet(f"{index}/members").select(F.col("seq_id").alias("doc_id"), F.col("doc_id").alias("class"))
        rows = M.listing(docs, named, seed, exact, members, seeds)
    if out:
        rows = stored(rows, "listing")
        sinks.write_listings(rows, reads, out)
        M.metrics(rows).write.json(f"{out}.metrics")
    return rows


def run_file(spark: SparkSession, index: str, path: str, out: str, **options) -> DataFrame:
    """run() for the reads of a FASTA or FASTQ file, in its order."""
    return run(spark, index, stored(read_reads(spark, path), "reads"), out, **options)


def info(spark: SparkSession, index: str, out: str | None = None, n: int = 0) -> dict:
    """Options and sizes of an index; its first n profiles as lines if `out` is given (all if n is 0)."""
    own = about(spark, index, verify=True)
    if out:
        sinks.write_profiles(spark.read.parquet(f"{index}/profiles"), out, n)
    return own


def analyze(spark: SparkSession, mate_1: str, mate_2: str | None, labels: DataFrame, out: str, abundance: bool = False) -> DataFrame:
    """Classify the reads of listings (one file, or mates by their place) by labels (doc_id, label); write reads, a line for each in
    order, whatever their names, or abundances."""
    one = read_listings(spark, mate_1)
    if mate_2:
        both = mates(one, read_listings(spark, mate_2)).select("ordinal", F.col("stem").alias("name"), F.concat("line_1", F.lit(" "), "line_2").alias("line"))
    else:
        both = one
    both = both.withColumnRenamed("ordinal", "read_id")
    ranked = V.labelled(V.top(V.votes(parse_lines(both.select("read_id", "line")))), labels)
    if abundance:
        counts = V.abundance(ranked)
        sinks.write_abundance(counts, out)
        return counts
    sinks.write_classification(ranked, both.select("read_id", "name"), out)
    return ranked


def analyze_taxa(spark: SparkSession, mate_1: str, mate_2: str | None, doc_taxa: str, taxonomy: str, out: str, abundance: bool = False) -> DataFrame:
    """The same by taxa, from files: documents with their taxa, and the taxonomy, which must know each of them."""
    taxa = read_doc_taxa(spark, doc_taxa)
    unknown = taxa.join(read_taxonomy(spark, taxonomy).select("path"), "path", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"{unknown[0].path} is not in the taxonomy")
    return analyze(spark, mate_1, mate_2, taxa.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").alias("label")), out, abundance)


def ranked_taxa(taxa: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Ranks of the ancestors of taxa (path)."""
    return X.ranks(taxa, taxonomy)


def extract(text_archive: str, data_archive: str, out: str) -> list[str]:
    """Unpack both archives; the documents' files must be numbered densely from 1."""
    for path in (text_archive, data_archive):
        with tarfile.open(path) as archive:
            archive.extractall(out, filter="data")
    names = [os.path.join(d, f) for d, _, files in os.walk(out) for f in files if f.startswith("doc_") and f.endswith("_seq.fa")]
    numbers = sorted(int(os.path.basename(n).split("_")[1]) for n in names)
    if numbers != list(range(1, len(numbers) + 1)):
        raise ValueError("documents are not numbered densely from 1")
    return sorted(names, key=lambda n: int(os.path.basename(n).split("_")[1]))

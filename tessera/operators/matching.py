"""Document listing: cut each read into maximal exact matches and list the documents that hold each.

One plan serves all variants: an equi-join on seeds, gaps and islands along diagonals, places of reads among the collection's short
strings for what is shorter than a seed, matching statistics, a fold from the right end, and a containment join of factors with
islands. Matches never cross a document's boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessera.operators.index import common_prefix, with_lcp
from tessera.operators.nearest import nearest
from tessera.operators.profiles import COLUMNS
from tessera.operators.seeds import Seeds
from tessera.operators.strings import begun, few, holders, places
from tessera.plans.common import grams, kmers, listed, neighbours, small, stored, substrings

SEED = 12


def contained(docs: DataFrame, patterns: DataFrame, k: int = SEED) -> DataFrame:
    """(read_id, doc_id) of each pattern that a document's text holds. docs: doc_id, text; patterns: read_id, seq.

    A pattern's seeds lie side by side, the last one at its end, so that it occurs where a document has all of them at one
    distance: an equi-join and a count. Patterns shorter than a seed are looked up among the substrings of their lengths, in one pass. Empty patterns and null
    texts match nothing; equal patterns are looked up once.
    """
    patterns = stored(patterns.where("seq <> ''").select("read_id", "seq"), "patterns")
    once = patterns.groupBy("seq").agg(F.min("read_id").alias("first"))
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), F.length("seq") - k, F.lit(k)), F.array(F.length("seq") - k)))
    seeds = once.where(F.length("seq") >= k).withColumn("at", at).select("first", F.size("at").alias("n"), F.explode("at").alias("p"), "seq")
    seeds = stored(seeds.select("first", "n", "p", F.expr(f"substring(seq, p + 1, {k})").alias("kmer")), "seeds")
    hits = kmers(docs.select("doc_id", "text"), "text", k, "q").join(small(seeds), "kmer")
    found = hits.groupBy("first", "doc_id", "n", (F.col("q") - F.col("p")).alias("diag")).agg(F.count("*").alias("m")).where("m = n").select("first", "doc_id")
    short = stored(once.where(F.length("seq") < k).select("first", F.col("seq").alias("lmer")), "short-patterns")
    lengths = sorted(r.n for r in short.select(F.length("lmer").alias("n")).distinct().collect())  # fewer than k
    if lengths:
        found = found.unionByName(substrings(docs.select("doc_id", "text"), "text", lengths[-1], lengths=lengths).join(small(short), "lmer").select("first", "doc_id"))
    named = patterns.join(small(stored(once, "once")), "seq").select("read_id", "first")
    return found.distinct().join(small(stored(named, "names")), "first").select("read_id", "doc_id")


def islands(docs: DataFrame | None, reads: DataFrame, k: int = SEED, stored_seeds: Seeds | None = None) -> DataFrame:
    """read_id, doc_id, diag, s, e: all maximal exact matches of at least k characters. Ends inclusive, from 0.

    k-mers of documents that no read holds never reach a shuffle if the reads' k-mers are few enough to be broadcast; very few are found
    without a row for each k-mer of a document. With stored seeds of k characters the documents themselves are not read.
    """
    probes = stored(kmers(reads.select("read_id", "seq"), "seq", k, "p"), "probes") if stored_seeds is None else None
    if stored_seeds is not None:
        hits = stored_seeds.hits(reads.select("read_id", "seq"))
    elif (own := few(probes.select("kmer").distinct())) is not None:
        hits = places(docs.select("doc_id", "text"), own).withColumnRenamed("lmer", "kmer").join(small(probes), "kmer")
    else:
        hits = kmers(docs.select("doc_id", "text"), "text", k, "q").join(small(probes), "kmer")
    hits = hits.select("read_id", "doc_id", (F.col("q") - F.col("p")).alias("diag"), "p")
    order = W.partitionBy("read_id", "doc_id", "diag").orderBy("p")
    hits = hits.withColumn("g", F.col("p") - F.row_number().over(order))
    return hits.groupBy("read_id", "doc_id", "diag", "g").agg(F.min("p").alias("s"), (F.max("p") + k - 1).alias("e")).drop("g")


def starts(reads: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """read_id, s, e: the longest match of at most k characters that begins at each place of a read, where there is one. texts:
    doc_id, text.

    Few grams of reads are looked up in one pass over the texts, which tells the beginnings of them that a text holds. Many are put
    among the texts' distinct grams in order: the longest match is the common prefix with the nearest one on either side."""
    at = stored(grams(reads.select("read_id", "seq"), "seq", k, "s", "gram"), "read-grams")
    asked = stored(at.select("gram").distinct(), "grams")
    if asked.isEmpty():
        return at.select("read_id", "s", F.col("s").alias("e"))
    own = few(asked)
    if own is not None:
        begins = asked.select("gram", F.explode(F.expr("transform(sequence(1, length(gram)), n -> left(gram, n))")).alias("lmer"))
        found = stored(begun(texts, own), "begun")
        near = begins.join(found, "lmer").groupBy("gram").agg(F.max(F.length("lmer")).alias("n"))
    else:
        near = neighbours(asked, grams(texts.select("doc_id", "text"), "text", k).select("gram").distinct(), "gram")
        n = F.greatest(*[F.when(F.col(c).isNotNull(), common_prefix(F.col("gram"), F.col(c))).otherwise(0) for c in ("before", "after")])
        near = near.select("gram", n.alias("n")).where("n > 0")
    return at.join(near, "gram").select("read_id", "s", (F.col("s") + F.col("n") - 1).alias("e"))


def holders_of(strings: DataFrame, texts: DataFrame) -> DataFrame:
    """lmer, doc_id for each string (lmer, not empty and distinct) that a document holds. texts: doc_id, text."""
    texts = texts.select("doc_id", "text")
    own = few(strings)
    if own is not None:
        return holders(texts, own)
    lengths = sorted(r.n for r in strings.select(F.length("lmer").alias("n")).distinct().collect())  # fewer than a seed's
    if not lengths:
        return texts.select(F.col("text").alias("lmer"), "doc_id").where("false")
    return substrings(texts, "text", lengths[-1], lengths=lengths).join(small(strings), "lmer").select("lmer", "doc_id").distinct()


def statistics(found: DataFrame, k: int) -> DataFrame:
    """read_id, e, s: the longest match of k characters at least that ends at e begins at s. found: matches (read_id, s, e), of each
    start the longest among them.

    Of all matches that begin at s the longest covers the ends of the others, and a start gives only the ends that no start before it
    reaches, so that there is a row for each end and no more."""
    longest = found.groupBy("read_id", "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(W.partitionBy("read_id").orderBy("s").rowsBetween(W.unboundedPreceding, -1))
    new = longest.withColumn("from", F.greatest(F.col("s") + k - 1, F.coalesce(before + 1, F.lit(0)))).where("from <= e")
    return new.select("read_id", "s", F.explode(F.sequence("from", "e")).alias("e"))


def factors(stats: DataFrame, reads: DataFrame) -> DataFrame:
    """read_id, ord, s, e, hit: the factors of each read from its right end. A character without a match is a factor of its
    own with hit false. A step for each factor, whatever the read's length."""
    places = reads.where("seq <> ''").select("read_id", F.explode(F.expr("sequence(0, length(seq) - 1)")).alias("e"))
    dense = places.join(stats, ["read_id", "e"], "left").groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("e", "s"))).alias("ms"))
    rows = dense.select("read_id", F.transform("ms", lambda x: F.coalesce(x["s"], F.lit(-1))).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ords, ss, es, hits = [], [], [], [], []
            for i, own in enumerate(batch.column(1)):
                starts = own.values.to_numpy(zero_copy_only=False)
                e, k = len(starts) - 1, 0
                while e >= 0:
                    s = int(starts[e])
                    row.append(i)
                    ords.append(k)
                    ss.append(s if s >= 0 else e)
                    es.append(e)
                    hits.append(s >= 0)
                    e, k = ss[-1] - 1, k + 1
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int32()) for c in (ords, ss, es)], pa.array(hits, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["read_id", "ord", "s", "e", "hit"])

    return rows.mapInArrow(cut, T.StructType([rows.schema["read_id"], *[T.StructField(c, T.IntegerType()) for c in ("ord", "s", "e")], T.StructField("hit", T.BooleanType())]))


def matched(docs: DataFrame | None, reads: DataFrame, k: int, exact: bool, stored_seeds: Seeds | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """reads, equal reads once (seq, first), islands, factors, and the collection's texts (with exact, and k above 1)."""
    reads = stored(reads.select("read_id", F.coalesce("seq", F.lit("")).alias("seq")), "reads")
    once = stored(reads.where("seq <> ''").groupBy("seq").agg(F.min("read_id").alias("first")), "once")
    own = once.select(F.col("first").alias("read_id"), "seq")
    found = stored(islands(docs, own, k, stored_seeds), "islands")
    if not exact or k == 1:
        return reads, once, found, stored(factors(statistics(found, k), own), "factors"), None
    texts = stored_seeds.texts if stored_seeds is not None else docs
    matches = found.select("read_id", "s", "e").unionByName(starts(own, texts, k))
    return reads, once, found, stored(factors(statistics(matches, 1), own), "factors"), texts


def _held(docs: DataFrame | None, reads: DataFrame, k: int, exact: bool, stored_seeds: Seeds | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """reads, equal reads once, factors; read_id, ord, doc_id of factors that islands hold; with exact, read_id, ord, lmer of factors
    shorter than a seed, and lmer, doc_id of what holds them."""
    reads, once, found, cut, texts = matched(docs, reads, k, exact, stored_seeds)
    own = once.select(F.col("first").alias("read_id"), "seq")
    brief = f"hit AND e - s + 1 < {k}"
    # no island that ends at e or after it begins before s, so that those around a factor begin with it
    inside = cut.where("hit" if texts is None else f"hit AND NOT ({brief})").join(found.select("read_id", "doc_id", "s", F.col("e").alias("i_e")), ["read_id", "s"]).where("e <= i_e")
    inside = inside.select("read_id", "ord", "doc_id")
    if texts is None:
        return reads, once, cut, inside, None, None
    strings = cut.where(brief).join(own, "read_id").select("read_id", "ord", F.expr("substring(seq, s + 1, e - s + 1)").alias("lmer"))
    strings = stored(strings, "short-factors")
    return reads, once, cut, inside, strings, holders_of(stored(strings.select("lmer").distinct(), "short-strings"), texts)


def listing(docs: DataFrame | None, reads: DataFrame, k: int = SEED, exact: bool = True, classes: DataFrame | None = None, stored_seeds: Seeds | None = None) -> DataFrame:
    """read_id, ord, s, e, docs (array, ascending) for each factor of each read.

    docs: doc_id, text; reads: read_id, seq, with distinct read_ids. Matches of k characters and more are found by seeds. Shorter ones
    are found among the collection's strings of fewer characters, unless `exact` is false: then they count as none.
    stored_seeds, of k characters too, stand for docs. classes: doc_id, class - then docs lists classes. Equal reads are matched
    once. Null and empty reads have no factor.
    """
    reads, once, cut, inside, strings, held = _held(docs, reads, k, exact, stored_seeds)
    holders = inside if strings is None else inside.unionByName(strings.join(held, "lmer").select("read_id", "ord", "doc_id"))
    if classes is not None:
        holders = holders.join(small(classes), "doc_id").select("read_id", "ord", F.col("class").alias("doc_id"))
    sets = holders.groupBy("read_id", "ord").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))
    none = F.array().cast(f"array<{dict(holders.dtypes)['doc_id']}>")
    out = cut.join(sets, ["read_id", "ord"], "left").withColumn("docs", F.coalesce("docs", none))
    return _for_all(out, reads, once).select("read_id", "ord", "s", "e", "docs")


def counts(docs: DataFrame | None, reads: DataFrame, k: int = SEED, exact: bool = True, stored_seeds: Seeds | None = None) -> DataFrame:
    """read_id, ord, s, e, n_docs, first_doc, last_doc: of the same listing how many documents hold each factor, and the first and the last
    of them. No list is made, and a short string's documents are counted once, however many factors it is."""
    reads, once, cut, inside, strings, held = _held(docs, reads, k, exact, stored_seeds)
    many = (F.count("doc_id").cast("int").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    own = inside.distinct().groupBy("read_id", "ord").agg(*many)
    if strings is not None:
        own = own.unionByName(strings.join(stored(held.groupBy("lmer").agg(*many), "counts"), "lmer").drop("lmer"))
    out = stored(cut.join(own, ["read_id", "ord"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))), "counted")
    return _for_all(out, reads, once).select("read_id", "ord", "s", "e", "n_docs", "first_doc", "last_doc")


def _for_all(out: DataFrame, reads: DataFrame, once: DataFrame) -> DataFrame:
    """Rows of equal reads once, for each of them."""
    named = reads.join(once, "seq").select("read_id", F.col("first"))
    return named.join(out.withColumnRenamed("read_id", "first"), "first").drop("first")


def profiled_listing(sequences: DataFrame, sa: DataFrame, n_docs: int, reads: DataFrame, k: int = SEED, kind: str = "lens", columns: int = COLUMNS, stored_seeds: Seeds | None = None) -> DataFrame:
    """read_id, ord, s, e, and for each factor of each read what `kind` keeps (see nearest.nearest) of the first suffix in
    order that begins with the factor; null where a factor matches nothing. Matches shorter than k count as none. Kind "lens" gives
    a length for each document.

    sequences: seq_id, doc_id, seq; sa: their sorted suffixes with lcp and lcp_next. A factor's places are where its islands
    begin, so that the first suffix is a join by place and a minimum. What the taxonomic and the top-k listings of reads are made of.
    """
    docs = sequences.select(F.col("seq_id").alias("doc_id"), F.col("seq").alias("text")) if stored_seeds is None else None
    sa = sa if "lcp" in sa.columns else stored(with_lcp(sa), "with-lcp")
    reads, once, found, cut, _ = matched(docs, reads, k, False, stored_seeds)
    inside = cut.where("hit").join(found.select("read_id", F.col("doc_id").alias("seq_id"), "s", F.col("e").alias("i_e"), (F.col("s") + F.col("diag")).alias("pos")), ["read_id", "s"]).where("e <= i_e")
    first = inside.join(sa.select("seq_id", "pos", "row"), ["seq_id", "pos"]).groupBy("read_id", "ord").agg(F.min("row").alias("row"))
    first = stored(first, "first-suffixes")
    kept = nearest(sa, stored(first.select("row").distinct(), "asked"), "dense" if kind == "lens" else kind, n_docs if kind == "lens" else columns)
    out = cut.join(first.join(kept, "row").drop("row"), ["read_id", "ord"], "left")
    return _for_all(out, reads, once).select("read_id", "ord", "s", "e", *[c for c in kept.columns if c != "row"])


def as_text(rows: DataFrame) -> DataFrame:
    """read_id, line: the listing of each read, `[s,e] {d,...} ` from the right end."""
    item = F.concat(F.lit("["), F.col("s"), F.lit(","), F.col("e"), F.lit("] {"), listed(F.col("docs")), F.lit("} "))
    return rows.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("t")))), lambda x: x["t"]), "").alias("line"))


def metrics(rows: DataFrame) -> DataFrame:
    """Reads, matches, matched characters and mean length of a listing."""
    n = F.col("e") - F.col("s") + 1
    hit = F.size("docs") > 0
    return rows.agg(F.countDistinct("read_id").alias("reads"), F.count_if(hit).alias("matches"), F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).cast("long").alias("matched"), F.round(F.avg(F.when(hit, n)), 6).alias("mean_length"))

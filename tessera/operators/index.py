"""Index tables of a collection: sorted suffixes, their transform in runs, first column, last-to-first steps, profiles.

A collection is rows of seq_id, doc_id (dense, from 0), seq. Each sequence ends with its own end mark, which sorts before
every character; equal suffixes sort by sequence. Matches do not cross sequences.

Suffixes are sorted by prefix doubling, at any length and in linear space: ranks by the first HEAD characters, then by pairs of
ranks for twice as many, until no rank splits. A suffix keeps its ranks at all lengths. Two suffixes have the same
characters as far as their ranks agree, so that a common prefix takes a join for each doubling, not for each character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.nearest import nearest
from tessera.operators.profiles import COLUMNS
from tessera.plans.common import BUCKET_ROWS, CHUNK, numbered, running_sum, small, spread, stored

#: Characters of a suffix that are compared as text.
HEAD = 16
END = "$"


def _starts(sequences: DataFrame) -> DataFrame:
    """seq_id, doc_id, pos, rest (characters from pos on), suffix (its first HEAD characters), ch (the character before, or the end
    mark). Sequences are cut into chunks first: a substring of a long text is found by walking to it."""
    rows = spread(sequences.where("seq IS NOT NULL").select("seq_id", "doc_id", "seq"))
    cut = F.transform(F.expr(f"sequence(0, length(seq), {CHUNK})"), lambda i: F.struct(i.alias("at"), F.when(i == 0, F.concat(F.lit(END), F.substring("seq", 1, CHUNK + HEAD))).otherwise(F.substring(F.col("seq"), i, F.lit(CHUNK + HEAD + 1))).alias("part")))
    chunks = rows.select("seq_id", "doc_id", F.length("seq").alias("n"), F.explode(cut).alias("c")).select("seq_id", "doc_id", "n", "c.at", "c.part")
    each = chunks.select("*", F.explode(F.expr(f"sequence(0, least({CHUNK - 1}, n - at))")).alias("i"))
    return each.select("seq_id", "doc_id", (F.col("at") + F.col("i")).alias("pos"), (F.col("n") - F.col("at") - F.col("i")).alias("rest"), F.expr(f"substring(part, i + 2, {HEAD})").alias("suffix"), F.expr("substring(part, i + 1, 1)").alias("ch"))


def _ranked(rows: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """rows with `rank`, the dense rank of the key, and how many there are."""
    keys = stored(numbered(rows.select(*key).distinct(), "rank", *key), "keys")
    return rows.join(small(keys), list(key)), keys.count()


def suffixes(sequences: DataFrame) -> DataFrame:
    """row, seq_id, doc_id, pos, rest, suffix (its first HEAD characters), ch and ranks (by HEAD characters, twice as many, and so
    on) in suffix order, numbered without one task for all."""
    rows, n = _ranked(_starts(sequences), "suffix")
    rows = stored(rows.withColumn("ranks", F.array("rank")), "ranks")
    longest = rows.agg(F.max("rest")).first()[0] or 0
    width = HEAD
    while width < longest:
        later = rows.select("seq_id", (F.col("pos") - width).alias("pos"), F.col("rank").alias("next"))
        both = rows.join(later, ["seq_id", "pos"], "left").withColumn("next", F.coalesce("next", F.lit(-1))).withColumnRenamed("rank", "own")
        before = n
        both, n = _ranked(both, "own", "next")
        if n == before:
            break
        rows = stored(both.withColumn("ranks", F.concat("ranks", F.array("rank"))).drop("own", "next"), "ranks")
        width *= 2
    return numbered(rows, "row", "rank", "seq_id", "pos").select("row", "seq_id", "doc_id", "pos", "rest", "suffix", "ch", "ranks")


def common_prefixes(pairs: DataFrame, sa: DataFrame) -> DataFrame:
    """pairs with `lcp`, the length of the longest common prefix of the suffixes (seq_a, pos_a) and (seq_b, pos_b) of sa. If they have
    an lcp, they are known to agree so far, and to differ within the characters that ranks above `level` stand for."""
    levels = sa.select(F.max(F.size("ranks"))).first()[0] or 0
    known = "lcp" in pairs.columns
    out = pairs if known else pairs.withColumn("lcp", F.lit(0))
    most = levels - 1 if not known else (pairs.agg(F.max("level")).first()[0] if levels else None)
    for k in reversed(range(-1, -1 if most is None else most + 1)):
        for x in "ab":
            own = sa.select(F.col("seq_id").alias(f"seq_{x}"), F.col("pos").alias(f"at_{x}"), F.expr(f"ranks[{k}]" if k >= 0 else "suffix").alias(f"key_{x}"), F.col("rest").alias(f"rest_{x}"))
            out = out.withColumn(f"at_{x}", F.col(f"pos_{x}") + F.col("lcp")).join(own, [f"seq_{x}", f"at_{x}"])
        if k >= 0:
            # no longer rank splits the last ones: suffixes that share one are equal
            agreed = F.least(F.lit(HEAD << k), "rest_a") if k < levels - 1 else F.col("rest_a")
            step = F.when(F.col("key_a") == F.col("key_b"), agreed).otherwise(0)
        else:
            step = common_prefix(F.col("key_a"), F.col("key_b"))
        out = out.withColumn("lcp", F.col("lcp") + step).drop("at_a", "at_b", "key_a", "key_b", "rest_a", "rest_b")
        out = stored(out, "common-prefixes")
    return out


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two texts."""
    x, y = F.split(a, ""), F.split(b, "")
    n = F.least(F.length(a), F.length(b))
    differ = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p != q, F.lit(True)).cast("int")), 1)
    return F.when(differ > 0, F.least(differ - 1, n)).otherwise(n).cast("int")


def with_lcp(sa: DataFrame) -> DataFrame:
    """sa with lcp and lcp_next, the common prefixes with the row before and the next row, by an equi-join on row numbers.

    Most neighbours part within their first HEAD characters, which rows hold; ranks tell how far the others agree at least, and only
    for them the rest is looked up."""
    side = lambda x, shift: sa.select((F.col("row") + shift).alias("row"), *[F.col(c).alias(f"{c}_{x}") for c in ("seq_id", "pos", "rest", "suffix", "ranks")])
    same = F.expr("aggregate(zip_with(ranks_a, ranks_b, (x, y) -> x = y), 0, (a, e) -> a + CAST(e AS int))")
    pairs = stored(side("a", 0).join(side("b", 1), "row").withColumn("same", same), "neighbours")
    found = F.when(F.col("same") == 0, common_prefix(F.col("suffix_a"), F.col("suffix_b"))).when(F.col("same") == F.size("ranks_a"), F.col("rest_a"))
    near = pairs.select("row", found.alias("lcp")).where("lcp IS NOT NULL")
    least = F.least(F.lit(HEAD) * F.expr("CAST(shiftleft(1, same - 1) AS int)"), "rest_a", "rest_b")
    deep = pairs.where("same > 0 AND same < size(ranks_a)").select("row", F.col("seq_id_a").alias("seq_a"), "pos_a", F.col("seq_id_b").alias("seq_b"), "pos_b", least.cast("int").alias("lcp"), (F.col("same") - 2).alias("level"))
    lcp = near.unionByName(common_prefixes(deep, sa).select("row", "lcp"))
    lcp = stored(lcp.select("row", F.col("lcp").cast("int").alias("lcp")), "common-prefixes")
    both = sa.join(lcp, "row", "left").join(lcp.select((F.col("row") - 1).alias("row"), F.col("lcp").alias("lcp_next")), "row", "left")
    return both.withColumn("lcp", F.coalesce("lcp", F.lit(0))).withColumn("lcp_next", F.coalesce("lcp_next", F.lit(0)))


def with_runs(sa: DataFrame) -> DataFrame:
    """sa with run_id, whether a row starts or ends its run of equal characters, and the common prefixes with its neighbours."""
    sa = stored(with_lcp(sa), "with-lcp")
    around = sa.select((F.col("row") + 1).alias("row"), F.col("ch").alias("prev")).join(sa.select("row", "ch"), "row", "full").select("row", "prev", F.col("ch").alias("own"))
    flags = around.where("own IS NOT NULL").withColumn("is_start", ~F.col("own").eqNullSafe(F.col("prev"))).select("row", "is_start")
    next_start = flags.select((F.col("row") - 1).alias("row"), F.col("is_start").alias("is_end"))
    out = sa.join(flags, "row").join(next_start, "row", "left").withColumn("is_end", F.coalesce("is_end", F.lit(True)))
    return running_sum(out, "run_id", F.col("is_start").cast("long"), "row").withColumn("run_id", F.col("run_id") - 1)


def runs(flagged: DataFrame) -> DataFrame:
    """run_id, ch, len, ch_rank (ordinal among the runs of its character)."""
    own = stored(flagged.groupBy("run_id").agg(F.first("ch").alias("ch"), F.count("*").alias("len")), "runs")
    return _ordinals(own, "ch_rank", "run_id")


def _ordinals(rows: DataFrame, name: str, order: str) -> DataFrame:
    """rows with `name`, how many rows of the same ch come before by `order` (numbers without gaps): counted within buckets, and
    the buckets' counts added up, so that a frequent character is no task's alone."""
    rows = rows.withColumn("_b", F.floor(F.col(order) / BUCKET_ROWS))
    counts = rows.groupBy("ch", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("ch", "_b", (F.sum("_n").over(W.partitionBy("ch").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = rows.withColumn("_k", F.row_number().over(W.partitionBy("ch", "_b").orderBy(order)) - 1)
    return within.join(before, ["ch", "_b"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def run_counts(own: DataFrame) -> DataFrame:
    return own.groupBy("ch").agg(F.count("*").alias("n_runs"), F.sum("len").alias("n"))


def f_column(sa: DataFrame) -> DataFrame:
    """ch, n, first: how often each character occurs, and the count of all smaller ones. A row for each character."""
    n = sa.groupBy("ch").agg(F.count("*").alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(W.orderBy("ch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def lf_mapping(sa: DataFrame) -> DataFrame:
    """row, ch, lf: the row of the suffix one character longer, first[ch] + rank(row, ch)."""
    own = _ordinals(sa.select("row", "ch"), "rank", "row")
    return own.join(F.broadcast(f_column(sa)), "ch").select("row", "ch", "rank", (F.col("first") + F.col("rank")).alias("lf"))  # a row for each character


def lengths(asked: DataFrame, sa: DataFrame, n_docs: int) -> DataFrame:
    """row, lens: the longest match of each asked row of sa (with lcp and lcp_next) with each document."""
    return nearest(sa, asked, "dense", n_docs)


def boundaries(flagged: DataFrame) -> DataFrame:
    """run_id, ch, side (S or E), longer: of each run's first and last row, the row of the suffix one character longer."""
    ends = flagged.where(f"(is_start OR is_end) AND ch <> '{END}'")
    side = F.explode(F.filter(F.array(F.when(F.col("is_start"), "S"), F.when(F.col("is_end"), "E")), lambda x: x.isNotNull()))
    places = flagged.select("seq_id", (F.col("pos") + 1).alias("pos"), F.col("row").alias("longer"))
    return stored(ends.select("run_id", "ch", "seq_id", "pos", side.alias("side")).join(places, ["seq_id", "pos"]).select("run_id", "ch", "side", "longer"), "boundaries")


def kept(flagged: DataFrame, kind: str, k: int = COLUMNS) -> DataFrame:
    """run_id, ch, side and what `kind` keeps (see nearest.nearest) for each run's first and last row, of the suffix one character longer."""
    ends = boundaries(flagged)
    asked = ends.select(F.col("longer").alias("row")).distinct()
    return ends.join(nearest(flagged, asked, kind, k).withColumnRenamed("row", "longer"), "longer").drop("longer")


def profiles(flagged: DataFrame, n_docs: int) -> DataFrame:
    """run_id, ch, side (S or E), lens: for each run's first and last row, the longest match with each document of the
    suffix one character longer. Own document: that suffix whole."""
    return kept(flagged, "dense", n_docs)

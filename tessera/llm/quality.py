"""Quality by weak supervision: rules vote on each document or abstain, expectation-maximisation estimates how often each
rule is right, and the posterior probability of good quality decides. DataFrame and SQL functions only.

The votes are counted by pattern (at most 3 ** rules of them), so that the estimate covers every document and its work
does not grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import BLANK, WORD, stored, table, unused, whole

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
#: Frequent words of the languages at hand: English, German, French, Spanish.
COMMON = ["the", "of", "and", "to", "in", "is", "for", "that", "der", "die", "und", "das", "von", "mit", "den", "zu", "le", "la", "les", "de", "des", "et", "que", "un", "une", "el", "los", "en", "del", "y", "por", "para"]
ITERATIONS = 30


def features(docs: DataFrame) -> DataFrame:
    """docs with a column q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    A null or empty text has no word, and 0 in each count. Every whole text is used, at any length: windows are compared
    by sorting their hashes, not pair by pair.
    """
    text = whole()
    w, n, h, lines, pairs, at = unused(docs.columns, "w", "n", "h", "lines", "pairs", "at")
    out = docs.withColumn(w, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    out = out.withColumn(n, F.size(w).cast("long"))
    out = out.withColumn(h, F.when(F.col(n) >= WINDOW, F.expr(f"transform(sequence(1, cast({n} AS int) - {WINDOW - 1}), i -> xxhash64(slice({w}, i, {WINDOW})))")).otherwise(F.expr("array()").cast("array<bigint>")))
    out = out.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    out = out.withColumn(pairs, F.when(repeats, F.expr(f"array_sort(transform({h}, (h, i) -> struct(h, i)))")))
    twice = F.expr(f"array_sort(transform(filter({pairs}, (x, j) -> (j > 0 AND x.h = get({pairs}, j - 1).h) OR (j < size({pairs}) - 1 AND x.h = get({pairs}, j + 1).h)), x -> x.i))")
    out = out.withColumn(at, F.when(repeats, twice))
    covered = F.expr(f"aggregate({at}, struct(0 AS e, 0L AS c), (a, i) -> struct(i + {WINDOW} AS e, a.c + i + {WINDOW} - greatest(i, a.e) AS c), a -> a.c)")
    q = F.struct(
        F.col(n).alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_intersect(w, F.array(*map(F.lit, COMMON)))).cast("long").alias("n_common"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;)\"'…][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    return out.withColumn("q", q).drop(w, n, h, lines, pairs, at)


def base_failed(q: str = "q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < 10) | (100 * F.col(f"{q}.n_repeat_words") > 20 * n)


def rules(q: str = "q") -> list[Column]:
    """Votes: 1 good, -1 bad, 0 abstain."""
    c = {k: F.col(f"{q}.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_common", "n_distinct", "n_ended", "n_letters", "n_upper")}

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n = c["n_words"]
    return [
        vote(10 * c["n_symbols"] > n, 50 * c["n_symbols"] <= n),
        vote(10 * c["n_dup_lines"] > 3 * c["n_lines"], c["n_dup_lines"] == 0),
        vote(10 * c["n_repeat_words"] > n, c["n_repeat_words"] == 0),
        vote((c["word_chars"] < 2 * n) | (c["word_chars"] > 15 * n), (c["word_chars"] >= 3 * n) & (c["word_chars"] <= 9 * n)),
        vote((c["n_common"] == 0) & (n >= 30), c["n_common"] >= 3),
        vote(10 * c["n_ended"] < c["n_lines"], 10 * c["n_ended"] >= 8 * c["n_lines"]),
        vote(10 * c["n_letters"] < 6 * c["word_chars"], 10 * c["n_letters"] >= 9 * c["word_chars"]),
        vote(2 * c["n_upper"] > c["n_letters"], 5 * c["n_upper"] <= c["n_letters"]),
        vote((10 * c["n_distinct"] < 2 * n) & (n < 500), 10 * c["n_distinct"] >= 4 * n),
    ]


def pattern(votes: list[Column]) -> Column:
    return F.array(*[v.cast("int") for v in votes])


def posteriors(voted: DataFrame, votes: str, iterations: int = ITERATIONS) -> DataFrame:
    """votes, posterior for each pattern of votes in `voted`: at most 3 ** rules rows, whatever the corpus.

    Each rule has an accuracy on good and one on bad documents, since a rule that seldom finds fault says little by its
    approval; a vote of 0 says nothing. All in one SQL expression over the counted patterns.
    """
    counted = voted.groupBy(F.col(votes).alias("votes")).agg(F.count("*").cast("double").alias("n"))
    one = counted.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("pm"))
    add = "0D, (x, y) -> x + y"
    evidence = "CASE WHEN v > 0 THEN ln(a.good / (1D - a.bad)) WHEN v < 0 THEN ln((1D - a.good) / a.bad) ELSE 0D END"
    q = f"transform(pm, p -> 1D / (1D + exp(-(ln(s.pi / (1D - s.pi)) + aggregate(zip_with(p.votes, s.acc, (v, a) -> {evidence}), {add})))))"

    def share(sign: str, weight: str, low: float, prior: float) -> str:
        """Smoothed share of the votes of a sign among a rule's votes, each document counted by its weight."""
        of = [f"aggregate(zip_with(pm, q, (p, r) -> CASE WHEN get(p.votes, k) {x} 0 THEN p.n * {weight} ELSE 0D END), {add})" for x in (sign, "<>")]
        return f"least(0.995D, greatest({low}D, ({10 * prior}D + {of[0]}) / (10D + {of[1]})))"

    step = f"""element_at(transform(array({q}), q -> named_struct(
        'pi', least(0.99D, greatest(0.05D, aggregate(zip_with(pm, q, (p, r) -> p.n * r), {add}) / greatest(1D, aggregate(pm, 0D, (x, p) -> x + p.n)))),
        'acc', transform(s.acc, (a, k) -> named_struct('good', {share(">", "r", 0.6, 0.9)}, 'bad', {share("<", "(1D - r)", 0.05, 0.5)})))), 1)"""
    init = "named_struct('pi', 0.8D, 'acc', transform(get(pm, 0).votes, v -> named_struct('good', 0.95D, 'bad', 0.5D)))"
    fitted = one.where("size(pm) > 0").withColumn("s", F.expr(f"aggregate(sequence(1, {iterations}), {init}, (s, i) -> {step})"))
    return fitted.select(F.explode(F.expr(f"zip_with(pm, {q}, (p, r) -> named_struct('votes', p.votes, 'posterior', r))")).alias("x")).select("x.votes", "x.posterior")


def judged(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """docs with q, base_failed, posterior and kept. Rows with null in any column, repeated rows and columns of any other
    name stay as they are (q, votes, base_failed, posterior and kept are replaced if they exist); an empty table gives an
    empty table. `columns`: those to keep, where not all are needed. A document is kept if the base rules pass and its posterior is at least one half."""
    docs = docs.drop("q", "votes", "base_failed", "posterior", "kept")
    voted = features(docs).select(*(columns or docs.columns), "q")
    voted = stored(voted.withColumn("votes", pattern(rules())).withColumn("base_failed", base_failed()), "votes")
    found = posteriors(voted.where(~F.col("base_failed")), "votes")
    out = voted.join(F.broadcast(found), "votes", "left")  # at most 3 ** rules rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("posterior"), F.lit(0.0)) >= 0.5))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document, whether the base rules fail it, and whether it is kept. A null or empty text has counts of
    0 and fails; null and repeated ids are rows like any other."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept", "posterior")

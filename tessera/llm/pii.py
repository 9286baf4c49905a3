"""Personal data: regular expressions propose spans, checksums (Luhn, mod 97) and ranges confirm them, nearby words adjust
the score of what no checksum settles. DataFrame and SQL functions only.

Spark's functions return matches but not their places; the text between matches (split by the same pattern) gives those.
Possessive quantifiers and look-behinds stand for the plain patterns of the contract: they match the same spans, but
neither backtrack nor start again within a run, so that long texts take linear time. Places come from running sums by
doubling, and what lies near a span from blocks of the text, so that a text of many spans takes no quadratic time either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import table, unused, whole

_LOCAL = "A-Za-z0-9._%+-"
#: kind: (what a text must contain to be searched at all, pattern). The first four are the base kinds.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": ("[0-9]{2}|[0-9][ -][0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "short_card": ("[0-9]{4}", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])"),
    "secret": ("(?i)token|secret|password|passwd|key", r"(?i)(?<![A-Za-z0-9])(?:[a-z]{1,20}_)?(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?[A-Za-z0-9_/+=.-]{12,}+[\"']?"),
    "ssn": ("[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
BASE = ("email", "ip", "card", "phone")
#: kind: (score without any evidence, nearby words that raise it by RAISE, nearby words that lower it by RAISE).
CONTEXT = {
    "iban": (0.6, "iban|bank|account|konto|compte|cuenta|transfer", "serial|part no|model"),
    "short_card": (0.4, "card|visa|amex|mastercard|credit|karte|carte|tarjeta", "order|invoice|isbn|serial"),
    "secret": (0.6, "auth|login|bearer|secret|token|key|password", "example|placeholder|changeme"),
    "ssn": (0.4, "ssn|social security|tax id|taxpayer", "order|part|version"),
}
RAISE, LEAST, NEAR = 0.3, 0.5, 40
#: Code points of a block of a text.
BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(a: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array, by an associative function of two of its values: n log n steps."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(a))
    return F.aggregate(steps, a, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, of(F.get(acc, i - p), x)).otherwise(x)))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, n: Column) -> Column:
    """n code points of a text from start (0 first) on, given its blocks; takes time in proportion to n."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(parts, first + 1, F.floor((start % BLOCK + n) / BLOCK).cast("int") + 1)
    return F.when(n > 0, F.substring(F.array_join(some, ""), start % BLOCK + 1, n)).otherwise("")


def matches(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>> of all leftmost non-overlapping matches: code points, end exclusive."""
    guard, pattern = PATTERNS[kind]
    none = F.expr("array()").cast("array<struct<s:int,e:int,m:string>>")

    def placed(x: Column) -> Column:
        lengths = F.transform(x["hits"], lambda m, i: F.length(m) + F.length(F.get(x["pieces"], i)))
        return let(lengths, lambda n: let(running(n, lambda a, b: a + b), lambda e: F.transform(x["hits"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("s"), F.get(e, i).alias("e"), m.alias("m")))))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(guard), let(both, placed)).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    figures = F.split(F.reverse(_digits(m)), "")

    def each(x: Column, i: Column) -> Column:
        twice = F.try_to_number(x, F.lit("9")).cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(figures, lambda x: x != ""), each), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(bare, 5, 100), F.substring(bare, 1, 4))
    figures = F.filter(F.split(turned, ""), lambda x: x != "")

    def add(a: Column, x: Column) -> Column:
        v = F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(figures, F.lit(0), add) == 1


def confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "short_card"):
        return luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def scored(parts: Column, kind: str, x: Column) -> Column:
    """The score of a span of a text, given the text's blocks."""
    prior, more, less = CONTEXT[kind]
    before = cut(parts, F.greatest(x["s"] - NEAR, F.lit(0)), F.least(x["s"], F.lit(NEAR)))
    near = F.lower(F.concat(before, F.lit(" "), cut(parts, x["e"], F.lit(NEAR))))
    return let(near, lambda near: F.lit(prior) + F.when(near.rlike(more), RAISE).otherwise(0.0) - F.when(near.rlike(less), RAISE).otherwise(0.0))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column pii, a struct of an array of spans (s, e, m) for each kind.

    A null or empty text has no span. Rows are judged one by one: nulls elsewhere, repeated rows and other columns stay
    as they are, but a column named pii is replaced.
    """
    own, found = unused([*docs.columns, "pii"], "text_of", "found")
    out = docs.withColumn(own, whole(text))
    t = F.col(own)
    out = out.withColumn(found, F.struct(*[matches(t, k).alias(k) for k in PATTERNS]))

    def kept(kind: str) -> Column:
        sure = F.filter(F.col(f"{found}.{kind}"), lambda x: confirmed(kind, x["m"]))
        if kind in BASE:
            return sure
        near = let(F.struct(sure.alias("xs"), blocks(t).alias("parts")), lambda y: F.filter(y["xs"], lambda x: scored(y["parts"], kind, x) >= LEAST))
        return F.when(F.size(F.col(f"{found}.{kind}")) > 0, near).otherwise(F.col(f"{found}.{kind}"))

    return out.withColumn("pii", F.struct(*[kept(k).alias(k) for k in PATTERNS])).drop(own, found)


def listed(kinds: tuple[str, ...], column: str = "pii") -> Column:
    """kind:start:end of each span, by kind and then start, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(F.col(f"{column}.{kind}"), lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets. Overlapping spans become one, named after
    the first of them. Texts without spans, null and empty ones among them, stay as they are, and so do other columns."""
    (held,) = unused(docs.columns, "held")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = spans(docs.select(F.struct(*columns).alias(held), F.col(f"`{text}`").alias("text")))

    def of(kind: str) -> Column:
        return F.transform(F.col(f"pii.{kind}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("m")))

    found = found.withColumn("all", F.array_sort(F.concat(*map(of, PATTERNS))))
    t = F.col("text")

    def joined(x: Column) -> Column:
        """The text with its spans replaced, from spans in order (all), the greatest end up to each (ends), and blocks (parts)."""
        at = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
        each = F.transform(x["all"], lambda y, i: F.when(y["s"] >= at(i), F.concat(cut(x["parts"], at(i), y["s"] - at(i)), y["m"])).otherwise(""))
        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(each, ""), cut(x["parts"], last, F.length(t) - last))

    ends = running(F.transform("all", lambda y: y["e"]), lambda a, b: F.greatest(a, b))
    new = let(F.struct(F.col("all"), ends.alias("ends"), blocks(t).alias("parts")), joined)
    found = found.withColumn("new", F.when(F.size("all") > 0, new).otherwise(t))
    return found.select(*[F.col("new").alias(c) if c == text else F.col(f"{held}.`{c}`").alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document; null and empty texts have none, null and repeated ids are rows like any other."""
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(tuple(PATTERNS)).alias("spans"),
    )

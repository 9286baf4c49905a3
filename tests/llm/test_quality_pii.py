import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    at = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeated = len(w), len(at)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 10 or 100 * repeated > 20 * n


def luhn(m):
    d = [int(c) for c in m if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
}


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in PLAIN.items()}


ODD = [
    None, "", " \n\t ", "a b c d e " * 40, "one two", "x\ny z\nx\nx\n \n", "é" * 30000, "1" * 30000, "1 " * 9000, "a." * 9000 + "@" + "b." * 9000,
    "a@b.c_d@e.f g.@h.i a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.00001.2.3 1.2.3 9.9.9.9", "4111 1111-1111 1111, 4111111111111112 41111111111111111111 1--4111111111111111",
    "+1 (499) 555-6503 +1 2 +12345678901234567 ++49 89 1234567. +4 4", "𝄞𝄞 me@x.org 𝄞 10.0.0.1", "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789, " + "x" * 50 + " part 123-45-6789",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "card 378282246310005",
]


@pytest.fixture(scope="module")
def rows(spark, sf):
    real = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return [(10_000 + i, x, "odd") for i, x in enumerate(ODD)] + [(10_001, "", None), (None, "a null id", "odd")] + real


def test_base_features_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, q string")
    got = quality.judged(df, ["doc_id", "text"]).select("text", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[1:7]) == base(r.text), r.text and r.text[:60]
        assert not (r.kept and r.base_failed)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, votes int, pii int")
    assert quality.judged(df).count() == 0
    assert pii.spans(df).count() == 0


def test_posteriors_find_the_accurate_rules(spark):
    import random

    r = random.Random(1)
    rows = []
    for _ in range(3000):
        good = r.random() < 0.7
        y = 1 if good else -1
        rows.append((int(good), [y if r.random() < p else -y for p in (0.95, 0.9, 0.85, 0.6)] + [0]))
    df = spark.createDataFrame(rows, "y int, votes array<int>")
    found = {tuple(x.votes): x.posterior for x in quality.posteriors(df, "votes").collect()}
    right = sum((found[tuple(v)] >= 0.5) == bool(y) for y, v in rows)
    assert right / len(rows) > 0.93


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.judged(docs, ["doc_id"]).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 AND toxic = 0 AND NOT base_failed")
    assert out.where("kept").count() >= 0.97 * out.count()


def test_spans_match_plain_patterns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    out = pii.spans(df)
    got = out.select("text", *[f"pii.{k}" for k in pii.PATTERNS], pii.listed(pii.BASE).alias("listed")).collect()
    for r in got:
        want = base_spans(r.text)
        for k, v in want.items():
            assert [(x.s, x.e) for x in r[k]] == v, (k, r.text and r.text[:80])
            assert all((r.text or "")[x.s : x.e] == x.m for x in r[k])
        assert r.listed == ",".join(f"{k}:{s}:{e}" for k, v in want.items() for s, e in v)


def test_added_kinds(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    n = {r.doc_id: r for r in pii.spans(df).select("doc_id", *[f"pii.{k}" for k in pii.PATTERNS]).collect()}
    at = {k: i for i, t in enumerate(ODD) for k in ("IBAN", "ssn", "token", "card 37") if (t or "").startswith(k)}
    assert [x.m for x in n[at["IBAN"]].iban] == ["GB82 WEST 1234 5698 7654 32"]
    assert [x.s for x in n[at["ssn"]].ssn] == [4]
    assert len(n[at["token"]].secret) == 1
    assert len(n[at["card 37"]].short_card) == 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de now, 10.0.0.1!"), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.text for r in pii.redacted(df).orderBy("doc_id").collect()] == ["mail [EMAIL] now, [IP]!", "nothing here", None, ""]


def test_queries(spark, sf):
    got = pii.op3_pii(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        want = base_spans(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, v in want.items() for s, e in v).encode()).hexdigest()


def test_columns_of_any_name_stay(spark):
    names = ["_n", "_w", "_h", "_lines", "_s", "_at", "w", "n", "h", "lines", "pairs", "at", "_text", "_found", "_all", "all", "new", "held", "text_of", "found"]
    df = spark.createDataFrame([(1, "mail me@x.org"), (None, None)], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    for out in (quality.judged(df), pii.spans(df), pii.redacted(df)):
        assert all(r[n] == n for r in out.collect() for n in names)
        assert set(df.columns) <= set(out.columns)
    assert [r.text for r in pii.redacted(df).orderBy(F.desc("doc_id")).collect()] == ["mail [EMAIL]", None]


def test_running_and_blocks(spark):
    """Running values by doubling, and cuts over the borders of blocks, equal plain ones."""
    r = random.Random(5)
    rows = [(i, [r.randint(-9, 9) for _ in range(i)], "".join(r.choice("aé😀 \n") for _ in range(i * 37))) for i in range(0, 40)]
    df = spark.createDataFrame(rows, "id long, a array<int>, t string")
    out = df.select("id", "a", "t", pii.running(F.col("a"), lambda a, b: a + b).alias("sums"), pii.running(F.col("a"), lambda a, b: F.greatest(a, b)).alias("tops"))
    at, n = F.col("id") * 17, F.col("id") * 13
    out = out.withColumn("cut", pii.cut(pii.blocks(F.col("t")), at, n)).withColumn("end", pii.cut(pii.blocks(F.col("t")), at, F.lit(40)))
    for x in out.collect():
        assert x.sums == list(itertools.accumulate(x.a)) and x.tops == list(itertools.accumulate(x.a, max))
        assert x.cut == x.t[x.id * 17 : x.id * 30] and x.end == x.t[x.id * 17 : x.id * 17 + 40]


def test_many_spans_of_one_text(spark):
    """A very long text with tens of thousands of spans is redacted whole."""
    one = "Mail john.doe@example.org, ssn 123-45-6789 here, token=abcdefgh12345678@b.cc ü😀. "
    df = spark.createDataFrame([(1, one)], "doc_id long, text string")
    df = df.unionByName(df.select("doc_id", F.repeat("text", 12_000).alias("text")))
    short, long = sorted((x.text for x in pii.redacted(df).collect()), key=len)
    assert "[EMAIL]" in short and "[SSN]" in short and "@" not in short
    assert long == short * 12_000

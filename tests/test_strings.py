"""Strings that texts hold against brute force, and what an exact listing keeps of a collection."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import matching as M
from tessera.operators import strings as S


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    word = lambda n, a="abcé\U0001f600": "".join(r.choice(a) for _ in range(n))
    return {i: word(r.randint(0, 60)) for i in range(30)} | {30: None, 31: "a\0b" * 5, 32: word(5000), 33: "z" * 3}


def test_prefix_table_is_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 200)
    strings = sorted({t[i : i + n] for t in texts.values() if t for i in (0, 3, 9) for n in (1, 2, 5, 9) if t[i : i + n]} | {"abcabcabc", "é\U0001f600zz", "q"})
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    own = S.few(spark.createDataFrame([(s,) for s in strings], "lmer string"))
    got = sorted((x.lmer, x.doc_id) for x in S.holders(df, own).collect())
    assert got == sorted((s, i) for s in strings for i, t in texts.items() if t and s in t)
    assert sorted((x.lmer, x.doc_id, x.q) for x in S.places(df, own).collect()) == sorted((s, i, q) for s in strings for i, t in texts.items() if t for q in range(len(t)) if t.startswith(s, q))
    begins = {s[:n] for s in strings for n in range(1, len(s) + 1)}
    assert sorted(x.lmer for x in S.begun(df, own).collect()) == sorted(b for b in begins if any(t and b in t for t in texts.values()))
    assert S.prefixes(strings, 10) is None and S.few(spark.createDataFrame([(s,) for s in strings], "lmer string"), 3) is None


@pytest.mark.parametrize("most", [S.STRINGS, 2])
def test_exact_listing_and_counts_by_either_way(spark, texts, monkeypatch, most):
    monkeypatch.setattr(S, "STRINGS", most)
    r = random.Random(9)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    reads = {i: "".join(r.choice("abcéx") for _ in range(r.randint(1, 20))) for i in range(15)} | {15: texts[32][100:140], 16: "", 17: texts[32][100:140]}
    q = spark.createDataFrame([*reads.items(), (18, None)], "read_id long, seq string")
    want = []
    for i, read in reads.items():
        e, k = len(read) - 1, 0
        while e >= 0:
            s = e
            held = lambda s: sorted(d for d, t in texts.items() if t and read[s : e + 1] in t)  # noqa: E731, B023
            while s > 0 and held(s) and held(s - 1):
                s -= 1
            want.append((i, k, s, e, held(s)))
            e, k = s - 1, k + 1
    got = sorted((x.read_id, x.ord, x.s, x.e, list(x.docs)) for x in M.listing(docs, q, 6).collect())
    assert got == sorted(want)
    got = sorted((x.read_id, x.ord, x.s, x.e, x.n_docs, x.first_doc, x.last_doc) for x in M.counts(docs, q, 6).collect())
    assert got == sorted((i, k, s, e, len(d), min(d, default=None), max(d, default=None)) for i, k, s, e, d in want)


def test_exact_listing_stores_nothing_of_the_collections_size(spark, monkeypatch):
    r = random.Random(10)
    docs = spark.createDataFrame([(i, "".join(r.choice("abcdefgh") for _ in range(400))) for i in range(50)], "doc_id long, text string")
    reads = spark.createDataFrame([(i, "abcd"[i % 4] * 3 + "gh") for i in range(200)], "read_id long, seq string")
    sizes, lists, keep = {}, [], M.stored

    def stored(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        lists.extend(c for c, t in out.dtypes if t.startswith("array"))
        return out

    monkeypatch.setattr(M, "stored", stored)
    out = M.counts(docs, reads)
    assert out.agg(F.countDistinct("read_id")).first()[0] == 200
    assert max(sizes.values()) <= 200 and not lists  # before: a row for each of the 20,000 characters, and a list of documents for each read

"""Golden digests and brute force for the sequence functions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import sequences as S

GOLDEN = [
    (5, 10, False, "ACATAGCCATACATATAGATACGATTACCA", "ACATAAGCCAACATAAGATAACGAT"),
    (5, 10, False, "ACAT", "ACAT"),
    (5, 10, False, "ACATAGCCATACATANTAGATACGATTACCA", "ACATAAGCCAACATAACGAT"),
    (5, 10, False, "ANCATAGCCATACATATAGATACGATTACCA", "AGCCAACATAAGATAACGAT"),
    (5, 10, False, "ACATAGCCATACATATAGATACGATTANCCA", "ACATAAGCCAACATAAGATAACGAT"),
    (31, 35, False, "ACATAGCCATACATATAGATACGATTACCAAAAAA", "ACATAGCCATACATATAGATACGATTACCAA"),
    (5, 5, False, "AAAAACCCCCGGGGGTTTTT", "AAAAAAAAACAAACCAACCCACCCCCCCCCCCCCGCCCGGCCGGGCGGGGGGGGGGGGGTGGGTTGGTTTGTTTTTTTTT"),
    (4, 4, False, "AAAAAGCCATACATATAGATACGATTTTTTA", "AAAAAAAGAAGCAGCCGCCACCATCATAATACTACAACATCATAATATTATAATAGTAGAAGATGATAATACTACGACGACGATGATTATTTTTTTTTTA"),
    (4, 10, True, "AAAAAGCCATACATATAGATACGATTTTTTA", "AAAAAAAGAGCCTACAAGATGATAATTT"),
]


@pytest.mark.parametrize(("k", "w", "by_hash", "seq", "want"), GOLDEN)
def test_golden_digest(spark, k, w, by_hash, seq, want):
    df = spark.createDataFrame([(seq,), (seq.lower(),)], "seq string")
    got = [r.d for r in df.select(S.digest(F.col("seq"), k, w, by_hash).alias("d")).collect()]
    assert got[0] == want
    assert got[1].upper() == want


def test_alphabet_digest_of_one_letter(spark):
    df = spark.createDataFrame([("C" * 18,), ("AC",)], "seq string")
    assert [r.d and len(r.d) for r in df.select(S.alphabet_digest(F.col("seq"), 4, 10).alias("d")).collect()] == [1, None]


def test_fmix64(spark):
    values = [random.Random(3).getrandbits(63) for _ in range(50)] + [0, 1, 255]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for r in df.select("v", S.fmix64(F.col("v")).alias("h")).collect():
        assert r.h % (1 << 64) == S.fmix64_of(r.v)


def test_reverse_complement(spark):
    df = spark.createDataFrame([("acGTNu",)], "seq string")
    assert df.select(S.reverse_complement(F.col("seq"))).first()[0] == "ANACGT"


def test_hash_order_beyond_the_table(spark):
    seq = "".join(random.Random(5).choice("ACGT") for _ in range(80))
    k, w = 7, 12
    code = {c: i for i, c in enumerate("ACGT")}
    val = lambda s: sum(code[c] * 4 ** (k - 1 - i) for i, c in enumerate(s))
    out = []
    for i in range(len(seq) - w + 1):
        m = min((seq[i + j : i + j + k] for j in range(w - k + 1)), key=lambda s: S.fmix64_of(val(s)))
        if not out or out[-1] != m:
            out.append(m)
    df = spark.createDataFrame([(seq,)], "seq string")
    assert df.select(S.digest(F.col("seq"), k, w)).first()[0] == "".join(out)


@pytest.mark.parametrize(("k", "w"), [(5, 4), (0, 4), (32, 40)])
def test_bad_parameters(spark, k, w):
    with pytest.raises(ValueError):
        S.digest(F.lit("ACGT"), k, w)

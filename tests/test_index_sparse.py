"""Sparse nearest documents against dense lengths, over parts of a few rows; stored seeds against the collection itself."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import matching as M
from tessera.operators import nearest as N
from tessera.operators import seeds as S


def common(a, b):
    return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.fixture(scope="module")
def sequences():
    r = random.Random(8)
    core = "".join(r.choice("ACGT") for _ in range(60))
    own = [core, core[:40] + "T" + core[40:], core[5:], "AC" * 20, "AC" * 15 + "A", "", "Z"] + ["".join(r.choice("AC") for _ in range(r.randint(1, 30))) for _ in range(12)]
    return [(i, r.randrange(9), s) for i, s in enumerate(own)]


@pytest.mark.parametrize("rows", [1, 7, 100, 1 << 19])
def test_nearest_is_brute_force(spark, sequences, monkeypatch, rows):
    monkeypatch.setattr(N, "PART_ROWS", rows)
    sa = I.with_lcp(I.suffixes(spark.createDataFrame(sequences, "seq_id long, doc_id int, seq string")).cache()).cache()
    text = {i: s for i, _, s in sequences}
    held = {}
    for _, d, s in sequences:
        held.setdefault(d, []).append(s)
    order = sa.orderBy("row").collect()
    for a, b in zip(order, order[1:], strict=False):
        n = common(text[a.seq_id][a.pos :], text[b.seq_id][b.pos :])
        assert (a.lcp_next, b.lcp) == (n, n)
    asked = [x for x in order if x.row % 3 == 0]
    want = {}
    for x in asked:
        own = text[x.seq_id][x.pos :]
        lens = {d: max((common(own, s[p:]) for s in ss for p in range(len(s))), default=0) for d, ss in held.items()}
        want[x.row] = [(d, n) for d, n in sorted(lens.items()) if n]
    ask = spark.createDataFrame([(x.row,) for x in asked], "row long")
    pairs = lambda x: [(p.doc, p.len) for p in x]
    assert {x.row: pairs(x.lens) for x in N.nearest(sa, ask).collect()} == want
    tax = {x.row: (pairs(x.left), pairs(x.right)) for x in N.nearest(sa, ask, "tax").collect()}
    rises = lambda v: [(d, n) for k, (d, n) in enumerate(v) if n > max((m for _, m in v[:k]), default=0)]
    assert tax == {row: (rises(v), rises(v[::-1])) for row, v in want.items()}
    for k in (1, 3):
        top = {x.row: pairs(x.top) for x in N.nearest(sa, ask, "top", k).collect()}
        assert top == {row: sorted(v, key=lambda p: (-p[1], p[0]))[:k] for row, v in want.items()}


def test_statistics_have_a_row_for_each_end(spark):
    found = spark.createDataFrame([(1, d, s, e) for d in range(50) for s, e in ((0, 30), (0, 25), (2, 28), (3, 40), (60, 75))], "read_id long, doc_id long, s int, e int")
    rows = M.statistics(found, 12)
    assert {x.e: x.s for x in rows.collect()} == {e: 0 if e <= 30 else 3 if e <= 40 else 60 for e in [*range(11, 41), *range(71, 76)]}
    plan = found.groupBy("read_id", "s").agg(F.max("e").alias("e"))
    assert plan.count() == 4  # what is exploded, whatever the number of documents


def test_stored_seeds_match_like_the_collection(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, "".join(r.choice("AC") for _ in range(r.randint(0, 80)))) for i in range(20)] + [(20, "A" * 300), (21, None)]
    reads = spark.createDataFrame([(i, "".join(r.choice("AC") for _ in range(40))) for i in range(15)] + [(15, "A" * 30), (16, "AC"), (17, None)], "read_id long, seq string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    about = S.write(df, str(tmp_path / "seeds"), 6, hot=40)
    seeds = S.read(spark, str(tmp_path / "seeds"), **about)
    assert seeds.hot.count() > 0 and seeds.places.groupBy("kmer", "salt").count().agg(F.max("count")).first()[0] < 120
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(M.listing(None, reads, 6, stored_seeds=seeds)) == key(M.listing(df, reads, 6))
    wide = M.listing(None, reads, 6, stored_seeds=seeds)
    assert wide.count() > 0


def test_kmer_codes(spark):
    from tessera.functions.sequences import kmer_code

    rows = spark.createDataFrame([("ACGT",), ("TTTT",), ("AAAA",), ("ACGN",), ("ACG",), ("acgt",), (None,)], "x string")
    assert [r[0] for r in rows.select(kmer_code(F.col("x"), 4)).collect()] == [27, 255, 0, None, None, None, None]
    long = spark.createDataFrame([("T" * 31,), ("A" * 30 + "C",)], "x string")
    assert [r[0] for r in long.select(kmer_code(F.col("x"), 31)).collect()] == [4**31 - 1, 1]


def test_factors_of_long_reads(spark):
    reads = spark.createDataFrame([("a", "x" * 30_000), ("b", "xy"), ("c", "")], "read_id string, seq string")
    stats = spark.range(30_000).select(F.lit("a").alias("read_id"), F.col("id").cast("int").alias("e"), (F.col("id") - F.col("id") % 2).cast("int").alias("s")).where("e <> 7")
    rows = M.factors(stats, reads)
    assert rows.where("read_id = 'a'").count() == 15_001
    assert [tuple(r)[2:] for r in rows.where("read_id = 'b'").orderBy("ord").collect()] == [(1, 1, False), (0, 0, False)]
    assert [tuple(r)[2:] for r in rows.where("read_id = 'a' AND e BETWEEN 5 AND 9").orderBy("ord").collect()] == [(8, 9, True), (7, 7, False), (6, 6, True), (4, 5, True)]


def test_top_is_padded_with_documents_of_length_0(spark):
    from tessera.operators import profiles as P

    df = spark.createDataFrame([([(5, 9), (2, 0)],), ([],), ([(4, 1), (4, 2), (3, 7), (1, 0)],)], "top array<struct<len:int,doc:int>>")
    got = [[tuple(p) for p in r[0]] for r in df.select(P.padded(F.col("top"), 10, 3)).collect()]
    assert got == [[(5, 9), (2, 0), (0, 1)], [(0, 0), (0, 1), (0, 2)], [(4, 1), (4, 2), (3, 7)]]


def test_dense_lengths_leave_a_task_in_small_batches(spark, sequences, monkeypatch):
    import pyarrow as pa

    sa = I.with_lcp(I.suffixes(spark.createDataFrame(sequences, "seq_id long, doc_id int, seq string")).cache()).cache()
    ask = sa.select("row").where("row % 3 = 0")
    dense = {x.row: list(x.lens) for x in N.nearest(sa, ask, "dense", 9).collect()}
    assert dense == {x.row: [dict((p.doc, p.len) for p in x.lens).get(d, 0) for d in range(9)] for x in N.nearest(sa, ask).collect()}
    monkeypatch.setattr(N, "AT_ONCE", 50)
    rows = pa.RecordBatch.from_pylist([{"part": 0, "row": i, "doc": i % 25, "len": 9, "gap": 9} for i in range(10_000)])
    for kind, most in (("dense", 75), ("lens", 50), ("tax", 50), ("top", 50)):
        out = list(N._pass(kind, 25)([rows]))
        assert sum(b.num_rows for b in out) == 10_000
        assert max(len(c.flatten()) for b in out for c in b.columns[1:]) <= most  # before: up to 250,000 pairs, each an object


@pytest.mark.parametrize("k", [1, 3, 6, 12])
def test_stored_seeds_keep_one_place_of_a_few(spark, tmp_path, k):
    r = random.Random(k)
    word = lambda n: "".join(r.choice("abé\U0001f600") for _ in range(n))
    docs = {i: word(r.choice([0, 3, 11, 12, 13, 90, 400])) for i in range(25)} | {25: word(4000)}
    reads = {i: word(r.randint(1, 8)) + t[a : a + r.randint(1, 40)] + word(3) for i, t in enumerate(docs.values()) for a in [r.randint(0, len(t))]} | {99: docs[25][1200:1500]}
    df = spark.createDataFrame([*docs.items(), (26, None)], "doc_id long, text string")
    seeds = S.read(spark, str(tmp_path / "seeds"), **S.write(df, str(tmp_path / "seeds"), k))
    assert seeds.places.count() <= sum(-(-len(t) // S.step(k)) for t in docs.values())  # before: a row for each character, and another in heads
    q = spark.createDataFrame(list(reads.items()), "read_id long, seq string")
    want = sorted((i, p, d, x) for i, s in reads.items() for p in range(len(s) - k + 1) for d, t in docs.items() for x in range(len(t)) if t.startswith(s[p : p + k], x))
    assert sorted((x.read_id, x.p, x.doc_id, x.q) for x in seeds.hits(q).collect()) == want
    held = {t[i : i + n] for t in docs.values() for n in range(1, k + 1) for i in range(len(t) - n + 1)}
    assert {x.text[i : i + n] for x in seeds.texts.collect() for n in range(1, k + 1) for i in range(len(x.text) - n + 1)} == held
    key = lambda rows: sorted(map(str, rows.collect()))
    assert k == 1 or key(M.listing(None, q, k, stored_seeds=seeds)) == key(M.listing(df, q, k))

"""Listings against brute force, index tables against sorted suffixes, profiles, votes and files."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators import matching as M
from tessera.operators import profiles as P
from tessera.operators import voting as V


def brute(read, docs):
    """Factors from the right end with the documents that hold each."""
    out, e = [], len(read) - 1
    while e >= 0:
        s = e
        if not any(read[e] in t for t in docs.values()):
            out.append((e, e, []))
            e -= 1
            continue
        while s > 0 and any(read[s - 1 : e + 1] in t for t in docs.values()):
            s -= 1
        out.append((s, e, sorted(d for d, t in docs.items() if read[s : e + 1] in t)))
        e = s - 1
    return out


@pytest.fixture(scope="module")
def collection():
    r = random.Random(11)
    word = lambda n, a="ACGT": "".join(r.choice(a) for _ in range(n))
    docs = {i: word(r.randint(5, 70)) for i in range(8)} | {8: "", 9: "AB", 10: "BA", 11: word(700)}
    reads = {i: word(r.randint(1, 40), "ACGTX") for i in range(30)} | {30: "X", 31: docs[3], 32: "ABBA", 33: "acgt", 34: docs[11][250:300] + "X" + docs[0]}
    return docs, reads


@pytest.mark.parametrize("k", [1, 4, 6])
def test_exact_listing_is_brute_force(spark, collection, k):
    docs, reads = collection
    d = spark.createDataFrame([*docs.items(), (12, None)], "doc_id long, text string")
    q = spark.createDataFrame([*reads.items(), (35, ""), (36, None), (37, reads[3])], "read_id long, seq string")
    got = {}
    for r in M.listing(d, q, k=k, exact=True).orderBy("read_id", "ord").collect():
        got.setdefault(r.read_id, []).append((r.s, r.e, list(r.docs)))
    assert got == {i: brute(x, docs) for i, x in (reads | {37: reads[3]}).items()}


def test_text_round_trip_and_metrics(spark, collection):
    from tessera.sources.listings import parse_lines

    docs, reads = collection
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(reads.items()), "read_id long, seq string")
    rows = M.listing(d, q, k=4, exact=True).cache()
    back = parse_lines(M.as_text(rows))
    key = lambda df: sorted((r.read_id, r.ord, r.s, r.e, tuple(r.docs)) for r in df.collect())
    assert key(back) == key(rows)
    m = M.metrics(rows).first()
    assert m.reads == len(reads)
    assert m.matched == sum(r.e - r.s + 1 for r in rows.collect() if r.docs)


def test_many_patterns_take_the_seed_join(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "xxcdefghij"), (3, None)], "doc_id long, text string")
    pats = spark.createDataFrame([(i, s) for i, s in enumerate(["cdefgh", "xxcd", "zzz", ""] + [f"q{i}qqqq" for i in range(1200)])], "read_id long, seq string")
    assert sorted(tuple(r) for r in M.contained(docs, pats).collect()) == [(0, 1), (0, 2), (1, 2)]


@pytest.fixture(scope="module")
def sequences():
    r = random.Random(4)
    return [(i, i // 3, "".join(r.choice("AB") for _ in range(r.randint(1, 12)))) for i in range(12)] + [(12, 4, "")]


def test_index_tables(spark, sequences):
    df = spark.createDataFrame(sequences, "seq_id long, doc_id int, seq string")
    sa = I.suffixes(df).cache()
    rows = sa.orderBy("row").collect()
    want = sorted((s[p:], i, p) for i, _, s in sequences for p in range(len(s) + 1))
    assert [(r.suffix, r.seq_id, r.pos) for r in rows] == want
    lcp = {r.row: r.lcp for r in I.with_lcp(sa).collect()}
    for a, b in zip(rows, rows[1:], strict=False):
        n = 0
        while n < min(len(a.suffix), len(b.suffix)) and a.suffix[n] == b.suffix[n]:
            n += 1
        assert lcp[b.row] == n
    bwt = "".join(r.ch for r in rows)
    flagged = I.with_runs(sa).cache()
    runs = I.runs(flagged).orderBy("run_id").collect()
    assert "".join(r.ch * r.len for r in runs) == bwt
    assert all(a.ch != b.ch for a, b in zip(runs, runs[1:], strict=False))
    lf = {r.row: r.lf for r in I.lf_mapping(sa).collect()}
    assert sorted(lf.values()) == list(range(len(bwt)))
    counts = {r.ch: (r.n, r.first) for r in I.f_column(sa).collect()}
    assert counts["A"] == (bwt.count("A"), bwt.count("$"))

    docs = {}
    for _, d, s in sequences:
        docs.setdefault(d, []).append(s)
    byrow = {r.row: r for r in flagged.collect()}
    ends = {(r.run_id, "S"): r for r in byrow.values() if r.is_start} | {(r.run_id, "E"): r for r in byrow.values() if r.is_end}
    for r in I.profiles(flagged, 5).collect():
        longer = r.ch + ends[r.run_id, r.side].suffix
        want = [max((n for n in range(len(longer) + 1) if any(longer[:n] in s for s in docs[d])), default=0) for d in range(5)]
        assert list(r.lens) == want


def test_profile_compressions(spark):
    r = random.Random(2)
    rows = [[r.randint(0, 6) for _ in range(7)] for _ in range(200)] + [[0] * 7, [5] * 7]
    df = spark.createDataFrame([(x,) for x in rows], "lens array<int>")
    lens = F.col("lens")
    got = df.select("lens", P.tax_left(lens).alias("l"), P.tax_right(lens).alias("r"), P.top_k(lens, 3).alias("t")).withColumn("tax", P.tax_listing(F.col("l"), F.col("r"), 3)).withColumn("ends", P.endpoints(F.col("l"), F.col("r"), 3)).withColumn("full", P.at_least(lens, 3)).withColumn("top", P.topk_listing(F.col("t"), 3)).withColumn("cut", P.clip(lens, 4)).collect()
    for x in got:
        v = list(x.lens)
        assert [(p.doc, p.len) for p in x.l] == [(i, n) for i, n in enumerate(v) if n > max(v[:i], default=0)]
        assert [(p.doc, p.len) for p in x.r][::-1] == [(i, n) for i, n in enumerate(v) if n > max(v[i + 1 :], default=0)]
        assert [(p.len, p.doc) for p in x.t] == sorted(((n, i) for i, n in enumerate(v)), key=lambda p: (-p[0], p[1]))[:3]
        full = [i for i, n in enumerate(v) if n >= 3]
        assert list(x.full) == full
        assert set(x.tax) <= set(full)
        assert list(x.ends) == sorted({*full[:1], *full[-1:]})
        assert [x.tax[0], x.tax[-1]] == [full[0], full[-1]] if full else not x.tax
        assert set(x.top) <= set(full)
        assert list(x.cut) == [min(n, 4) for n in v]


def test_votes(spark):
    rows = spark.createDataFrame([(1, 0, 3, 6, [0, 2]), (1, 1, 0, 2, [2]), (2, 0, 0, 4, []), (3, 0, 0, 5, [1])], "read_id long, ord int, s int, e int, docs array<long>")
    top = {(r.read_id, r.rnk): (r.doc_id, r.weight) for r in V.top(V.votes(rows)).collect()}
    assert top == {(1, 1): (2, 7), (1, 2): (0, 4), (3, 1): (1, 6)}
    docs = spark.range(3).withColumnRenamed("id", "doc_id")
    lca = {(r.read_id, r.doc_id): r.weight for r in V.range_votes(rows, 3).collect()}
    assert lca == {(1, 0): 1.333, (1, 1): 1.333, (1, 2): 4.333, (3, 1): 6.0}
    wide = spark.createDataFrame([(1, 0, 0, 9, [0, 999_999]), (1, 1, 0, 4, [500_000, 999_999]), (1, 2, 0, 1, [7])], "read_id long, ord int, s int, e int, docs array<long>")
    few = {r.doc_id: r.weight for r in V.range_votes(wide, 1_000_000, 2).collect()}
    assert set(few) == set() or set(few) == {7}  # shares below 0.0005 round to nothing
    every = V.range_votes(wide.withColumn("e", F.col("e") * 10_000), 1_000_000, 2)
    assert sorted(r.doc_id for r in every.collect()) == [0, 1, 7, 8, 9, 500_000, 500_001]
    silent = V.with_silent(V.votes(rows), rows.select("read_id").distinct(), docs)
    assert silent.count() == 9
    labels = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "doc_id long, label string")
    assert {r.taxon: r.n for r in V.abundance(V.labelled(V.top(V.votes(rows)), labels)).collect()} == {"b": 2}
    both = V.paired(rows, rows.where("read_id = 1"))
    assert both.select("read_id").distinct().count() == 1


def test_files_and_commands(spark, tmp_path):
    from tessera import api
    from tessera.sources import sequences as Q

    (tmp_path / "a.fa").write_text(">x one two\nACGTAC\r\nGGT\n\n>y\nTTTT\n")
    (tmp_path / "b.fasta").write_text(">z\nCCGGTTAACC\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fa 1\n{tmp_path}/b.fasta 2 extra\n")
    got = sorted((r.name, r.comment, r.seq) for r in Q.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("x", "one two", "ACGTACGGT"), ("y", None, "TTTT")]
    (tmp_path / "q.fastq").write_text("@r1 c\nACG\nT\n+\nII\nII\n@r2\nAC\n+r2\n@@\n")
    assert [tuple(r) for r in Q.read_fastq(spark, str(tmp_path / "q.fastq")).collect()] == [("r1", "c", "ACGT", "IIII"), ("r2", None, "AC", "@@")]
    with pytest.raises(ValueError, match="quality"):
        list(Q.fastq_records("@r\nACGT\n+\nII\n"))
    for bad in ([], [2, 2], [1, 3], [1, 1]):
        with pytest.raises(ValueError):
            Q.check_ids(bad)

    index = str(tmp_path / "index")
    api.build(spark, str(tmp_path / "list.txt"), index, api.BuildOptions(revcomp=True, columns=2))
    assert api.info(spark, index)["n_docs"] == 2
    reads = spark.createDataFrame([(1, "r_1", "ggttaa"), (2, "r_2", "acgtacgg")], "read_id long, name string, seq string")
    rows = api.run(spark, index, reads, str(tmp_path / "out"), seed=3, exact=True)
    listed = {(r.read_id, r.ord): (r.s, r.e, list(r.docs)) for r in rows.collect()}
    assert listed[1, 0] == (0, 5, [1])
    assert listed[2, 0] == (0, 7, [0])
    labels = spark.createDataFrame([(0, "first"), (1, "second")], "doc_id long, label string")
    api.analyze(spark, str(tmp_path / "out"), None, labels, str(tmp_path / "abundance"), abundance=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "abundance")).collect()]
    assert sorted(lines) == ["first\t1", "second\t1"]
    ranked = api.analyze(spark, str(tmp_path / "out"), str(tmp_path / "out"), labels, str(tmp_path / "reads"))
    assert ranked.count() == 2
    with pytest.raises(ValueError):
        api.BuildOptions(taxcomp=True, topk=True)
    with pytest.raises(ValueError):
        api.check_minimizer_options(5, 4)


def test_stream_of_reads(spark, tmp_path):
    from tessera.operators.ftab import ftab
    from tessera.streaming import reads as R

    docs = spark.createDataFrame([(0, "ACGTACGTAA"), (1, "TTTTACGTAC")], "doc_id long, seq string")
    spark.createDataFrame([(7, "ACGTAC")], "read_id long, seq string").write.parquet(str(tmp_path / "in"))
    out = R.votes(R.read_stream(spark, str(tmp_path / "in")), ftab(docs, "seq", 4), 4)
    query = out.writeStream.format("memory").queryName("votes").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.sql("select * from votes").collect()) == [(7, 0, 3), (7, 1, 3)]
    query = R.answered(R.read_stream(spark, str(tmp_path / "in")), ftab(docs, "seq", 4), str(tmp_path / "out"), str(tmp_path / "log"), 4)
    query.processAllAvailable()
    query.stop()
    assert sorted((r.read_id, r.doc_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(7, 0, 3), (7, 1, 3)]


def test_long_repeats_are_ordered_whole(spark):
    r = random.Random(5)
    core = "".join(r.choice("ACGT") for _ in range(900))
    seqs = [core, core[:700] + "T" + core[700:], core[5:], "AC" * 200, "AC" * 150 + "A", "", core[100:400]]
    df = spark.createDataFrame([(i, i % 4, s) for i, s in enumerate(seqs)], "seq_id long, doc_id int, seq string")
    sa = I.suffixes(df).cache()
    rows = sa.orderBy("row").collect()
    want = sorted((s[p:], i, p) for i, s in enumerate(seqs) for p in range(len(s) + 1))
    assert [(x.seq_id, x.pos, x.rest) for x in rows] == [(i, p, len(t)) for t, i, p in want]
    assert [x.ch for x in rows] == [seqs[i][p - 1] if p else "$" for _, i, p in want]
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    lcp = {x.row: x.lcp for x in I.with_lcp(sa).collect()}
    assert all(lcp[k + 1] == common(want[k][0], want[k + 1][0]) for k in range(len(want) - 1))
    flagged = I.with_runs(sa).cache()
    where = {(x.run_id, side): x for x in flagged.collect() for side in "SE" if (x.is_start if side == "S" else x.is_end)}
    held = {}
    for i, s in enumerate(seqs):
        held.setdefault(i % 4, []).append(s)
    for x in I.profiles(flagged, 4).collect()[:60]:
        at = where[x.run_id, x.side]
        longer = seqs[at.seq_id][at.pos - 1 :]
        assert list(x.lens) == [max((common(longer, s[p:]) for s in held[d] for p in range(len(s))), default=0) for d in range(4)]


def test_windows_over_buckets_of_rows(spark, monkeypatch):
    from tessera.plans import common as C

    df = spark.createDataFrame([(i, i % 3, s) for i, s in enumerate(["ACGTACGT", "CGTACG", "TTACGG", "ACG", "GGGG"])], "seq_id long, doc_id int, seq string")
    key = lambda df: sorted(map(str, df.collect()))
    sa = I.suffixes(df).cache()
    flagged = I.with_runs(sa).cache()
    want = [key(x) for x in (I.lf_mapping(sa), I.runs(flagged), I.profiles(flagged, 3))]
    for module in (C, I):
        monkeypatch.setattr(module, "BUCKET_ROWS", 4)
    assert [key(x) for x in (I.lf_mapping(sa), I.runs(I.with_runs(sa)), I.profiles(flagged, 3))] == want


def test_profiled_listing_is_brute_force(spark, collection):
    docs, reads = collection
    rows = [(i, i, t) for i, t in docs.items()]
    df = spark.createDataFrame(rows, "seq_id long, doc_id int, seq string")
    q = spark.createDataFrame(list(reads.items()), "read_id long, seq string")
    out = M.profiled_listing(df, I.suffixes(df).cache(), 12, q, 1)
    suffixes = sorted((t[p:], i, p) for i, t in docs.items() for p in range(len(t)))
    seen = {}
    for x in out.orderBy("read_id", "ord").collect():
        f = reads[x.read_id][x.s : x.e + 1]
        seen.setdefault(x.read_id, []).append((x.s, x.e, [d for d, n in enumerate(x.lens or []) if n >= len(f)]))
        if x.lens:
            first = next(t for t, _, _ in suffixes if t.startswith(f))
            if len(first) < 80:
                assert list(x.lens) == [max(n for n in range(len(first) + 1) if first[:n] in docs[d]) for d in range(12)]
    assert seen == {i: brute(x, docs) for i, x in reads.items()}


def test_compressed_indexes_and_files(spark, tmp_path):
    import gzip

    from tessera import api
    from tessera.sources import sequences as Q
    from tessera.sources.listings import mates

    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">x\nACGTACGTTGCA\n>x2\nGGATCC\n")
    (tmp_path / "b +%41.fa").write_text(">y\nACGTACGTAAAA\n")
    (tmp_path / "c.fa").write_text(">z\nACGTTGCACCCC\n")
    b = tmp_path / "b.fa"
    b.write_text((tmp_path / "b +%41.fa").read_text())
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.fa.gz 1\n{b} 2\n{tmp_path}/c.fa 3\n")
    got = Q.read_collection(spark, [(f"{tmp_path}/a.fa.gz", 0), (f"{tmp_path}/b +%41.fa", 1), (f"file:{tmp_path}/c.fa", 2)])
    assert sorted((r.doc_id, r.name, r.seq) for r in got.collect()) == [(0, "x", "ACGTACGTTGCA"), (0, "x2", "GGATCC"), (1, "y", "ACGTACGTAAAA"), (2, "z", "ACGTTGCACCCC")]
    with pytest.raises(ValueError, match="missing"):
        Q.read_collection(spark, [(f"{tmp_path}/none.fa", 0)])
    reads = spark.createDataFrame([(1, "r_1", "acgtacgt"), (2, "r_2", "acgttgca")], "read_id long, name string, seq string")
    for kind, want in (("taxcomp", {1: [0, 1], 2: [0, 2]}), ("topk", {1: [0, 1], 2: [0, 2]})):
        index = str(tmp_path / kind)
        api.build(spark, str(tmp_path / "list.txt"), index, api.BuildOptions(columns=2, **{kind: True}))
        rows = api.run(spark, index, reads, seed=4)
        assert {r.read_id: sorted(r.docs) for r in rows.collect()} == want
        assert {r.read_id: sorted(r.docs) for r in api.run(spark, index, reads, seed=4, max_length=5).collect()} != {}
        api.info(spark, index, str(tmp_path / f"{kind}-lines"), 3)
        assert spark.read.text(str(tmp_path / f"{kind}-lines")).count() == 3
    digests = str(tmp_path / "digests")
    api.build(spark, str(tmp_path / "list.txt"), digests, api.BuildOptions(minimizers=True, k=2, w=4, ftab=False))
    assert api.info(spark, digests, str(tmp_path / "full-lines"))["n_docs"] == 3
    spark.read.parquet(f"{digests}/members").limit(1).write.mode("overwrite").parquet(f"{digests}/profiles")
    with pytest.raises(ValueError, match="profiles"):
        api.about(spark, digests)

    (tmp_path / "taxa.txt").write_text("1 Bacteria;Firm icutes;\n2 Bacteria;Other;\n")
    (tmp_path / "tree.txt").write_text("Bacteria; 2 domain\nBacteria;Firm icutes; 3 phylum\nBacteria;Other; 4 phylum 138\n")
    (tmp_path / "labels.txt").write_text("one\ntwo\n")
    assert sorted(tuple(r) for r in Q.read_taxonomy(spark, str(tmp_path / "tree.txt")).collect()) == [("Bacteria;", 2, "domain"), ("Bacteria;Firm icutes;", 3, "phylum"), ("Bacteria;Other;", 4, "phylum")]
    assert sorted(tuple(r) for r in Q.read_labels(spark, str(tmp_path / "labels.txt")).collect()) == [(0, "one"), (1, "two")]
    (tmp_path / "m1").write_text(">r_1/1\n[0,3] {0} \n>r_2/1\n[0,1] {1} \n")
    (tmp_path / "m2").write_text(">r_1/2\n[0,3] {0,1} \n>r_2/2\n\n")
    counts = api.analyze_taxa(spark, str(tmp_path / "m1"), str(tmp_path / "m2"), str(tmp_path / "taxa.txt"), str(tmp_path / "tree.txt"), str(tmp_path / "abundance"), abundance=True)
    assert {r.taxon: r.n for r in counts.collect()} == {"Bacteria;Firm icutes;": 1, "Bacteria;Other;": 1}
    (tmp_path / "short.txt").write_text("Bacteria; 2 domain\n")
    with pytest.raises(ValueError, match="taxonomy"):
        api.analyze_taxa(spark, str(tmp_path / "m1"), None, str(tmp_path / "taxa.txt"), str(tmp_path / "short.txt"), str(tmp_path / "no"))
    one, two = spark.createDataFrame([(0, "a1", "x"), (1, "b1", "y")], "ordinal long, name string, line string"), spark.createDataFrame([(0, "a2", "z")], "ordinal long, name string, line string")
    with pytest.raises(Exception, match="no mate"):
        mates(one, two).collect()

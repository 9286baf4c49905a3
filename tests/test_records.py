"""Records by their place in split files: FASTQ, listings, mates; equal names, and paths that are listed twice."""

import gzip
import random

import pytest

from tessera import api
from tessera.sources import sequences as Q
from tessera.sources.listings import mates, read_listings


@pytest.fixture
def small_splits(spark):
    """Files are cut every so many bytes; so are the tables between, which is why it is not fewer."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def cut(n: int) -> None:
        spark.conf.set(keys[0], n)
        spark.conf.set(keys[1], 0)
        spark.conf.set(keys[2], 1)

    yield cut
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def four_lines(n):
    """Qualities that begin with `@` and `+`, empty sequences, comments and equal names."""
    r = random.Random(2)
    rows = []
    for i in range(n):
        m = r.randint(0, 9)
        rows.append((f"r{i % 5}", r.choice([None, "a comment @x"]), "".join(r.choice("ACGT") for _ in range(m)), "".join(r.choice("@+I") for _ in range(m))))
    return rows, "".join(f"@{a}{' ' + c if c else ''}\n{s}\n+\n{q}\n" for a, c, s, q in rows)


@pytest.mark.parametrize("size", [2003, 1 << 20])
def test_fastq_is_split_anywhere(spark, tmp_path, small_splits, size):
    rows, text = four_lines(600)
    (tmp_path / "a.fastq").write_text(text)
    (tmp_path / "b.fastq").write_text(text.rstrip("\n"))
    small_splits(size)
    path = str(tmp_path / "a.fastq")
    found = Q.read_fastq(spark, path, wrapped=False, with_place=True)
    assert [tuple(x)[2:] for x in found.orderBy("_ordinal").collect()] == rows == list(Q.fastq_records(text))
    assert [(x.read_id, x.name, x.seq) for x in Q.read_reads(spark, path).orderBy("read_id").collect()] == [(i, a, s) for i, (a, _, s, _) in enumerate(rows)]
    both = Q.read_fastq(spark, [path, str(tmp_path / "b.fastq")], wrapped=False)
    assert sorted(map(str, both.collect())) == sorted(2 * [str(x) for x in found.select(*Q.SEQUENCE.names).collect()])
    if size == 2003:
        assert spark.read.text(path).rdd.getNumPartitions() > 5


def test_fastq_of_other_forms(spark, tmp_path):
    rows, text = four_lines(40)
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write(text[: len(text) // 2])
    with gzip.open(tmp_path / "a.fastq.gz", "at") as f:  # a second member
        f.write(text[len(text) // 2 :])
    assert sorted(map(str, [tuple(x) for x in Q.read_fastq(spark, str(tmp_path / "a.fastq.gz")).collect()])) == sorted(map(str, rows))
    (tmp_path / "w.fastq").write_text("@r1\nAC\nGT\n+\nII\n@I\n@r2\nA\n+\n@\n")
    assert [tuple(x) for x in Q.read_fastq(spark, str(tmp_path / "w.fastq")).collect()] == [("r1", None, "ACGT", "II@I"), ("r2", None, "A", "@")]
    with pytest.raises(Exception, match="four lines"):
        Q.read_fastq(spark, str(tmp_path / "w.fastq"), wrapped=False).collect()
    (tmp_path / "e.fastq").write_text("")
    assert Q.read_fastq(spark, str(tmp_path / "e.fastq"), wrapped=False).collect() == []


@pytest.mark.parametrize("size", [3001, 1 << 20])
def test_listings_by_place(spark, tmp_path, small_splits, size):
    names = ["a>b_2", "r_1", "r_1", ">odd", "x y", *[f"n_{i}" for i in range(400)]]
    lines = [f"[0,{i}] {{{i % 3}}} " for i in range(len(names))]
    lines[3] = ""
    for k in (1, 2):
        (tmp_path / f"m{k}").write_text("".join(f">{n}/{k}\n{x}\n" for n, x in zip(names, lines, strict=True)))
    small_splits(size)
    one, two = (read_listings(spark, str(tmp_path / f"m{k}")) for k in (1, 2))
    assert [(x.ordinal, x.name, x.line) for x in one.orderBy("ordinal").collect()] == [(i, f"{n}/1", x.strip()) for i, (n, x) in enumerate(zip(names, lines, strict=True))]
    both = mates(one, two).orderBy("ordinal").collect()
    assert [(x.stem, x.line_1, x.line_2) for x in both] == [(f"{n}/", x.strip(), x.strip()) for n, x in zip(names, lines, strict=True)]
    assert mates(one, two.where("ordinal < 3"), check_names=False).count() == 3
    with pytest.raises(Exception, match="no mate"):
        mates(one, two.where("ordinal <> 2")).collect()


def test_equal_names_keep_their_lines(spark, tmp_path):
    (tmp_path / "m").write_text(">r_1\n[0,9] {0} \n>r_1\n[0,4] {1} \n")
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "doc_id long, label string")
    api.analyze(spark, str(tmp_path / "m"), None, labels, str(tmp_path / "reads"))
    files = sorted((tmp_path / "reads").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == ["r_1\tx\t10", "r_1\ty\t5"]


def test_a_path_listed_twice(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x\nACGT\n>y\nCCCC\n")
    path = str(tmp_path / "a.fa")
    got = Q.read_collection(spark, [(path, 0), (path, 1), (f"file:{path}", 1)]).collect()
    assert sorted((x.doc_id, x.name) for x in got) == [(0, "x"), (0, "y"), (1, "x"), (1, "x"), (1, "y"), (1, "y")]
    assert len({x.seq_id for x in got}) == 6


# indexes


def collection(tmp_path, seed=1):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    docs = {d: [word(r.randint(20, 120)) for _ in range(2)] for d in range(4)}
    docs[3][0] = docs[0][0][5:60] + docs[1][1][:40]
    for d, seqs in docs.items():
        (tmp_path / f"d{d}.fa").write_text("".join(f">s{d}_{i}\n{s}\n" for i, s in enumerate(seqs)))
    (tmp_path / "list.txt").write_text("".join(f"{tmp_path}/d{d}.fa {d + 1}\n" for d in docs))
    return docs, word


def brute(read, docs):
    out, e = [], len(read) - 1
    while e >= 0:
        s = e
        while s > 0 and any(read[s - 1 : e + 1] in t for ts in docs.values() for t in ts):
            s -= 1
        out.append((s, e, sorted(d for d, ts in docs.items() if any(read[s : e + 1] in t for t in ts))))
        e = s - 1
    return out


def test_run_reads_the_stored_seeds_only(spark, tmp_path):
    docs, word = collection(tmp_path)
    index = str(tmp_path / "index")
    api.build(spark, str(tmp_path / "list.txt"), index, api.BuildOptions(columns=2))
    reads = [docs[0][0][3:50].lower(), word(30), docs[3][0] + "N" + word(5), "N", "", docs[1][1][:35]]
    (tmp_path / "q.fastq").write_text("".join(f"@q\n{s}\n+\n{'@' * len(s)}\n" for s in reads))
    rows = api.run_file(spark, index, str(tmp_path / "q.fastq"), str(tmp_path / "out"))
    got = {}
    for x in rows.orderBy("read_id", "ord").collect():
        got.setdefault(x.read_id, []).append((x.s, x.e, list(x.docs)))
    assert got == {i: brute(s.upper(), docs) for i, s in enumerate(reads) if s}
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert [x for x in text.splitlines() if x.startswith(">")] == [">q"] * len(reads)
    metrics = spark.read.json(str(tmp_path / "out.metrics")).first()
    assert metrics.reads == 5 and metrics.matches == sum(bool(d) for f in got.values() for _, _, d in f)
    # neither the collection nor a shuffle of the seeds
    own = spark.createDataFrame([(i, "q", s) for i, s in enumerate(reads)], "read_id long, name string, seq string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from tessera.operators import matching as M
        from tessera.operators import seeds as SD

        about = api.about(spark, index)
        seeds = SD.read(spark, f"{index}/seeds", about["seed"], about["seed_buckets"])
        plans = [M.islands(None, own, 12, seeds)._jdf.queryExecution().executedPlan().toString()]
        wide = seeds.places.join(own.selectExpr("seq AS kmer", "CAST(read_id % 1 AS int) AS salt").hint("merge"), SD.KEYS)
        plans.append(wide._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert all("/sequences" not in p for p in plans)
    assert "SortMergeJoin" in plans[1] and plans[1].count("Exchange hashpartitioning") == 1  # of the reads
    # a changed cell is found
    spark.read.parquet(f"{index}/members").selectExpr("seq_id", "doc_id", "upper(name) AS name", "n").write.mode("overwrite").parquet(str(tmp_path / "changed"))
    spark.read.parquet(str(tmp_path / "changed")).write.mode("overwrite").parquet(f"{index}/members")
    assert api.about(spark, index)["n_members"] == 8
    with pytest.raises(ValueError, match="changed"):
        api.about(spark, index, verify=True)


def symbols(seq, k=4, w=11):
    from tessera.functions.sequences import fmix64_of

    if len(seq) < w:
        return ()
    code = {c: i for i, c in enumerate("ACGT")}
    values = [sum(code[c] << 2 * (k - 1 - j) for j, c in enumerate(seq[i : i + k])) if set(seq[i : i + k]) <= set("ACGT") else None for i in range(len(seq) - k + 1)]
    out = []
    for i in range(len(seq) - w + 1):
        window = values[i : i + w - k + 1]
        if None not in window:
            v = min(window, key=fmix64_of)
            if not out or out[-1] != v:
                out.append(v)
    return tuple(v + 3 if v <= 2 else v for v in out)


def test_minimizer_alphabet_index(spark, tmp_path):
    docs, word = collection(tmp_path, 4)
    spelled = lambda s: "".join(chr(0x4E00 + v) for v in symbols(s))
    held = {d: [spelled(s) for s in ss] for d, ss in docs.items()}
    reads = [docs[0][0], docs[3][0], word(40), docs[1][1][10:50], "ACG"]
    own = spark.createDataFrame([(i, "q", s) for i, s in enumerate(reads)], "read_id long, name string, seq string")
    index = str(tmp_path / "symbols")
    api.build(spark, str(tmp_path / "list.txt"), index, api.BuildOptions(alphabet=True))
    got = {}
    for x in api.run(spark, index, own).orderBy("read_id", "ord").collect():
        got.setdefault(x.read_id, []).append((x.s, x.e, list(x.docs)))

    assert got == {i: brute_or_empty(spelled(s), held) for i, s in enumerate(reads) if spelled(s)}
    assert spark.read.parquet(f"{index}/ftab").count() == len({t[i : i + 3] for ts in held.values() for t in ts for i in range(len(t) - 2)})
    with pytest.raises(ValueError, match="k = 4"):
        api.BuildOptions(alphabet=True, k=5)


def brute_or_empty(read, docs):
    out, e = [], len(read) - 1
    holds = lambda x: sorted(d for d, ts in docs.items() if any(x in t for t in ts))
    while e >= 0:
        s = e
        while s > 0 and holds(read[s : e + 1]) and holds(read[s - 1 : e + 1]):
            s -= 1
        out.append((s, e, holds(read[s : e + 1])))
        e = s - 1
    return out


def test_clipped_index(spark, tmp_path):
    collection(tmp_path)
    for name, options in (("full", {}), ("tax", {"taxcomp": True})):
        api.build(spark, str(tmp_path / "list.txt"), str(tmp_path / name), api.BuildOptions(columns=2, max_length=3, ftab=False, **options))
    lens = [x for r in spark.read.parquet(str(tmp_path / "full" / "profiles")).collect() for x in r.lens]
    assert max(lens) == 3
    for r in spark.read.parquet(str(tmp_path / "tax" / "profiles")).collect():
        for side in (r.left, r.right):
            assert [p.len for p in side] == sorted({p.len for p in side}) and max(p.len for p in side) <= 3
    reads = spark.createDataFrame([(0, "q", "ACGTACGTACGTACG")], "read_id long, name string, seq string")
    assert api.run(spark, str(tmp_path / "tax"), reads, seed=4).count() > 0


# streams


def test_stream_of_listings(spark, tmp_path):
    from tessera.operators import seeds as SD
    from tessera.streaming import listings as L

    docs = spark.createDataFrame([(0, "ACGTACGTAACCGGTTACGT"), (1, "TTTTACGTACGGGG")], "doc_id long, text string")
    seeds = SD.read(spark, str(tmp_path / "seeds"), **SD.write(docs, str(tmp_path / "seeds"), 6))
    write = lambda rows, name: spark.createDataFrame(rows, "read_id long, name string, seq string, ts string").selectExpr("read_id", "name", "seq", "CAST(ts AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def listing():
        query = L.listed(L.read_stream(spark, str(tmp_path / "in")), seeds, str(tmp_path / "out"), str(tmp_path / "log"))
        query.processAllAvailable()
        query.stop()
        return sorted((x.read_id, x.s, x.e, tuple(x.docs)) for x in spark.read.parquet(str(tmp_path / "out")).collect())

    write([(1, "a", "ACGTACG", "2026-01-01 00:00:00")], "in")
    assert listing() == [(1, 0, 6, (0, 1))]
    write([(2, "b", "GGGGX", "2026-01-01 00:00:01")], "in")
    assert listing() == [(1, 0, 6, (0, 1)), (2, 0, 3, (1,)), (2, 4, 4, ())]  # after a restart, each read once

    def pairs():
        both = L.joined_mates(*[L.read_stream(spark, str(tmp_path / f"mate{i}")) for i in (1, 2)], late="10 minutes")
        query = L.listed_pairs(both, seeds, str(tmp_path / "pairs"), str(tmp_path / "pairs-log"), exact=False)
        query.processAllAvailable()
        query.stop()
        return {(x.read_id, x.mate) for x in spark.read.parquet(str(tmp_path / "pairs")).collect()}

    write([(1, "a", "ACGTACG", "2026-01-01 00:00:00"), (2, "b", "ACGTACG", "2026-01-01 00:00:00")], "mate1")
    write([(1, "a", "TTTTACG", "2026-01-01 00:01:00")], "mate2")
    assert pairs() == {(1, 1), (1, 2)}
    write([(2, "b", "GGTTACG", "2026-01-01 00:05:00")], "mate2")  # in a later batch, after a restart
    assert pairs() == {(1, 1), (1, 2), (2, 1), (2, 2)}
    write([(3, "c", "ACGTACG", "2026-01-02 00:00:00"), (4, "d", "ACGTACG", "2026-01-01 00:00:00")], "mate1")
    write([(3, "c", "ACGTACG", "2026-01-02 00:00:00")], "mate2")
    pairs()
    write([(4, "d", "ACGTACG", "2026-01-01 00:00:00")], "mate2")  # a day late: given up
    assert {i for i, _ in pairs()} == {1, 2, 3}

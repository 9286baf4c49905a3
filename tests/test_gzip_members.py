"""Gzip files whose members are read side by side: rows, borders, places that only look like members, damaged files."""

import gzip
import io
import random
import re

import pytest

from tessera.sources import gzip_members as G
from tessera.sources import sequences as Q
from tessera.sources.listings import read_listings
from tessera.sources.records import placed, split_rows


def cut(data, n, seed):
    """data as so many members, some of them empty."""
    r = random.Random(seed)
    at = sorted(r.randint(0, len(data)) for _ in range(n - 1))
    return b"".join(gzip.compress(data[a:b], r.choice([0, 6])) for a, b in zip([0, *at], [*at, len(data)], strict=True))


def rows(spark, path, separator=None):
    found = placed(split_rows(spark, path, separator)).orderBy("_file", "_block", "_at").collect()
    return [r.value for r in found]


@pytest.mark.parametrize(("size", "separator"), [(37, "\n"), (37, "\n>"), (700, "\n>"), (1 << 20, "\n")])
def test_rows_are_those_of_the_text(spark, tmp_path, monkeypatch, size, separator):
    monkeypatch.setattr(G, "RANGE_BYTES", size)
    monkeypatch.setattr(G, "STEP", 64)
    r = random.Random(size)
    text = "".join(r.choice(["\n", ">", "\n>", "ä", "acgt", "acgt" * 30]) for _ in range(400)) + "\n"
    (tmp_path / "a.gz").write_bytes(cut(text.encode(), 40, size))
    want = text.split(separator)
    want = want[:-1] if want[-1] == "" else want
    assert rows(spark, str(tmp_path / "a.gz"), separator) == want


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_a_member_within_a_member(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(G, "RANGE_BYTES", size)
    r = random.Random(3)
    noise = bytes(r.choice(b"abc\n") for _ in range(300))
    inner = gzip.compress(b"not\nrows\n") + gzip.compress(b"nor these\n")  # in a stored block, so that its bytes stand in the file
    data = noise + inner + noise + G.MAGIC + b"\x00" + noise
    (tmp_path / "a.gz").write_bytes(gzip.compress(data, 0) + gzip.compress(b"last\n"))
    found = placed(split_rows(spark, str(tmp_path / "a.gz"))).orderBy("_block", "_at").selectExpr("cast(value AS binary) AS v").collect()
    assert b"\n".join(bytes(x.v) for x in found) + b"\n" == data + b"last\n"


def test_fastq_fasta_and_listings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "RANGE_BYTES", 300)
    r = random.Random(4)
    seqs = ["".join(r.choice("ACGT") for _ in range(r.randint(1, 60))) for _ in range(200)]
    fastq = "".join(f"@r{i % 3}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate(seqs)).encode()
    (tmp_path / "a.fastq.gz").write_bytes(cut(fastq, 30, 1))
    want = [(i, f"r{i % 3}", s) for i, s in enumerate(seqs)]
    assert [tuple(x) for x in Q.read_reads(spark, str(tmp_path / "a.fastq.gz")).orderBy("read_id").collect()] == want
    fasta = "".join(f">r{i % 3} c\n{s[:20]}\n{s[20:]}\n" for i, s in enumerate(seqs)).encode()
    (tmp_path / "a.fa.gz").write_bytes(cut(fasta, 30, 2))
    assert [tuple(x) for x in Q.read_reads(spark, str(tmp_path / "a.fa.gz")).orderBy("read_id").collect()] == want
    (tmp_path / "both").mkdir()
    (tmp_path / "both" / "a.fa.gz").write_bytes(cut(fasta, 5, 3))
    (tmp_path / "both" / "b.fa").write_bytes(fasta)
    assert sorted(x.seq for x in Q.read_fasta(spark, str(tmp_path / "both")).collect()) == sorted(2 * seqs)
    (tmp_path / "l.gz").write_bytes(cut(b"".join(b">a>%d\n[0,%d] {1} \n" % (i, i) for i in range(90)), 20, 4))
    found = read_listings(spark, str(tmp_path / "l.gz")).orderBy("ordinal").collect()
    assert [(x.ordinal, x.name, x.line) for x in found] == [(i, f"a>{i}", f"[0,{i}] {{1}}") for i in range(90)]


def test_damaged_and_empty_files(spark, tmp_path):
    whole = gzip.compress(b"one\ntwo\n")
    for name, data in {"cut": whole[:-3], "tail": whole + b"more", "head": b"more" + whole, "flipped": whole + gzip.compress(b"x\n" * 50)[:-6] + b"\x00" * 6}.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
        with pytest.raises(ValueError, match=re.escape(f"{name}.gz")):
            split_rows(spark, str(tmp_path / f"{name}.gz"))
    (tmp_path / "e.gz").write_bytes(b"")
    (tmp_path / "n.gz").write_bytes(gzip.compress(b""))
    assert rows(spark, str(tmp_path / "e.gz")) == rows(spark, str(tmp_path / "n.gz")) == []


def test_memory_is_bounded_by_a_row():
    """64 MB of rows from a few KB: no part is longer than a step, and tasks hand rows on as they come."""
    import pyarrow as pa

    data = gzip.compress(b"x" * 99 + b"\n", 9) + gzip.compress((b"y" * 99 + b"\n") * 640_000, 9)
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    assert max(len(p) for at in (0,) for p in G.member(file, at) if isinstance(p, bytes)) <= G.STEP
    n = most = 0
    for piece in G.pieces(file, 0, len(data), b"\n"):
        n += 1
        most = max(most, len(piece[3] or b""))
    assert (n, most) == (640_001 + 2, 99)

"""Byte-level BPE, the prefix trie and periodic runs against the library and brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, periodic, prefix_trie

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


ODD_TEXTS = [None, "", " ", "\t\n  x", "it's 12345 don't", "ab" * 4000, "é́ 　漢字 🙂🙂", "<|endoftext|> <unk> </s>", "\x00\x1f\x85  a", " " * 5000 + "b", "_" * 999, "a\r\n\r\nb  \n c"]


def test_bpe_each_token_and_code_point(library):
    own = byte_bpe.Coder(PATH, P.PATTERN)
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1 {chr(c)}" for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    found = own.encode(pa.array(texts))
    assert found.to_pylist() == library.encode_ordinary_batch(texts, num_threads=2)
    assert [x.decode() for x in byte_bpe.decoded(found, byte_bpe.tokens_of(PATH)).to_pylist()] == texts
    # a token that its own merges do not give would need the ranks' table: there is none among these, and it is used nonetheless
    letters = byte_bpe.byte_letters()
    assert all([x - 1 for x in own.own.encode(t.decode("latin-1").translate(letters))] == [r] for t, r in list(own.ranks.items())[::7])


def test_bpe_table(spark, library, monkeypatch):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])] + [(None, "no id", None)], "doc_id long, text string, IDS string").repartition(3)
    rows = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert len(rows) == 2 * len(ODD_TEXTS) + 1
    for r in rows:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert byte_bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).select("decoded").collect() == [(None,), (bytearray(),)]
    # a small cache gives the same ids
    own = byte_bpe.Coder(PATH, P.PATTERN)
    monkeypatch.setattr(byte_bpe, "CACHE", 3)
    for _ in range(2):
        assert own.encode(pa.array(ODD_TEXTS)).to_pylist() == [library.encode_ordinary(t or "") for t in ODD_TEXTS]
        assert len(own.cache) <= 3


def test_bpe_refuses():
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.model({b"a": 0})
    with pytest.raises(ValueError, match="dense"):
        byte_bpe.model({b"a": 1})
    with pytest.raises(ValueError, match="ids must lie"):
        byte_bpe.decoded(pa.array([[50256]], pa.list_(pa.int32())), byte_bpe.tokens_of(PATH))


def test_op11(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in byte_bpe.op11_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))


# prefix trie


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    conv = {c: [x[3:] for x in sorted(v)] for c, v in conv.items()}
    seqs = {}
    for c in sorted(conv):
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(conv.get(c - c % 100, [])[:h] + conv[c][h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(str(c) for c in m if len(seqs[c]) == len(k)))) for k, m in members.items()), key=str
    )


def conversations(seed: int) -> list[tuple]:
    """Copies, a first turn and a first half that most share, conversations without turns after rebuilding, nulls, equal turn numbers."""
    draw = random.Random(seed)
    rows = [(None, 1, "a", "b")]
    for c in range(240):
        n, hot = draw.choice([1, 1, 3, 8, 12]), draw.random() < 0.6
        for t in range(n):
            text = "same" if hot and t < 6 else draw.choice(["p", None, "rr", ""])
            rows.append((c if c < 200 else 5000 + c, draw.choice([t, t, None, 0]) if draw.random() < 0.1 else t, None if t % 2 else "user", text))
    return rows


@pytest.mark.parametrize("room", [1, 40, prefix_trie.ROOM])
def test_trie(spark, tmp_path, monkeypatch, room):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)  # lists of members in many pieces
    rows = conversations(room)
    own = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("TURNS", F.lit(1)).withColumn("first", F.lit(2))
    own.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in prefix_trie.op12_prefix_trie(spark, str(tmp_path), room).collect()), key=str) == brute_trie(rows)


def test_trie_empty(spark, tmp_path):
    spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.op12_prefix_trie(spark, str(tmp_path)).collect() == []


# periodic runs


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    draw = random.Random(5)
    for _ in range(3000):
        letters, n, words = draw.choice([1, 2, 3, 4, 8]), draw.randint(0, 90), []
        while len(words) < n:
            words += [bytes([97 + draw.randrange(letters)]) for _ in range(draw.randint(1, 12))] * draw.choice([1, 1, 2, 4, 5, 9])
        words = words[: draw.randint(n, len(words))]
        assert periodic.runs(words) == brute_runs(words)


def test_runs_of_frequent_words_stay_linear():
    import time

    began = time.process_time()
    assert periodic.runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    words = [b"%d" % (i * i % 997 % 40) for i in range(200_000)]  # forty words, each of them frequent
    assert [r[2] for r in periodic.runs(words)] == [997]
    assert time.process_time() - began < 30


def test_runs_table(spark):
    texts = [None, "", "a b c", "x " * 9, "a b a b a b a b\tc", "one two three\none two three one two\x0bthree one two three four", "long " * 50_000, "e f " * 8]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, "x " * 6, None)] * 2, "doc_id long, text string, Runs string")
    got = periodic.with_runs(docs)
    assert got.columns == ["doc_id", "text", "Runs", "runs_", "collapsed"]
    rows = {r.doc_id: ([tuple(x) for x in r["runs_"]], r.collapsed) for r in got.where("doc_id IS NOT NULL").collect()}
    assert rows == {
        0: ([], ""), 1: ([], ""), 2: ([], "a b c"), 3: ([(0, 9, 1)], "x"), 4: ([(0, 8, 2)], "a b c"), 5: ([(0, 12, 3)], "one two three four"),
        6: ([(0, 50_000, 1)], "long"), 7: ([(0, 8, 1)], "e f"),
    }
    assert got.where("doc_id IS NULL").count() == 2 and periodic.with_runs(docs.limit(0)).count() == 0


def test_op13(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words) if n < 3000 else periodic.runs(words)
        top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        kept = b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found))
        want[doc_id] = (len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept))
    assert {r[0]: tuple(r)[1:] for r in periodic.op13_periodic_runs(spark, sf).collect()} == want

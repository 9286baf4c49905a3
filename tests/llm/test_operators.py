"""Operators of large corpora against brute force, round trips and planted cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _common, html_extract, licenses, media, mixing, ngram_join, packing, token_files, warc
from tessera.llm._common import new_path
from tessera.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for j, s in enumerate(sets):
        for i, n in Counter(i for x in s for i in at[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[i]) - n):
                root[find(j)] = find(i)
        for x in s:
            at[x].append(j)
    least = {}
    for j, (d, _) in enumerate(rows):
        r = find(j)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), least.get(find(j))) for j, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed=7, n=260, words=120):
    """A large group of copies with edits of all sizes, chains among them, sharing a passage with other texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    first = [word() for _ in range(words)]
    out = []
    for i in range(n):
        w = list(first)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(words)] = word()
        out.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        w = [word() for _ in range(r.randint(30, 90))]
        out.append((i, " ".join(w[:20] + first[:40] + w[20:])))
    return out


ODD = [(None, None), (5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE\ttwo"), (5005, "one two three four five"), (None, "one two"), (None, "x y z"), (5006, "é ü ß ñ ç é ü ß ñ ç"), (5007, "w " * 30000), (5008, "w " * 20000), (0, "same id other text"), (5009, "x y z")]


def test_components_of_a_graph(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 480)] + [(None, 1), (5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_is_brute_force(spark, sf):
    real = [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = near_copies() + ODD + real
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).repartition(7)
    got = Counter((r.id, r.n, r.component) for r in ngram_join.linked(df).collect())
    assert got == Counter(brute_components(rows))


SMALL = {"BROADCAST_ROWS": 0, "LONG": 2, "COMMON": 2, "FAMILY_BYTES": 4000, "GROUP": 3, "SLICE_BYTES": 2000, "HELD": 500, "LIST_ROWS": 50, "BLOCK": 2, "BLOCKS": 16, "MOST_COMMON": 40}


@pytest.mark.parametrize("names", [["BROADCAST_ROWS"], ["LONG", "COMMON"], ["LONG", "COMMON", "FAMILY_BYTES", "GROUP"], ["MOST_COMMON", "LONG"], list(SMALL)])
def test_ngram_join_does_not_depend_on_sizes(spark, monkeypatch, names):
    rows = near_copies(5, 60) + near_copies(6, 30, 300)[:30] + ODD
    for name in names:
        monkeypatch.setattr(_common if name == "BROADCAST_ROWS" else ngram_join, name, SMALL[name])
    got = Counter((r.id, r.n, r.component) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter(brute_components(rows))


def test_ngram_join_families_give_forests():
    r = random.Random(3)
    base = sorted(r.sample(range(1 << 40), 200))
    sets = []
    for k in range(60):
        s = set(r.sample(base, 200 - k // 2)) | set(r.sample(range(1 << 40, 1 << 41), k // 2))
        sets.append(np.array(sorted(s | set(range(k % 5))), np.uint64))
    links = {(i, j) for i in range(60) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - c)}
    assert 100 < len(links) < 60 * 59 // 2
    ids = [bytes([k]) * 16 for k in range(60)]
    for sides in ([0] * 60, [k % 2 for k in range(60)]):
        table = pa.table({"sid": ids, "root": [ids[min(k, 57)] for k in range(60)], "side": sides, "data": [s.tobytes() for s in sets]})
        out = [(a[0], b[0]) for a, b in zip(*ngram_join.derived(table).to_pydict().values(), strict=True)]
        assert all((max(p), min(p)) in links for p in out)
        own = {(i, j) for i, j in links if sides[i] != sides[j] or max(sides) == 0}

        def classes(pairs):
            root = list(range(60))
            for i, j in [*pairs, (57, 58), (58, 59)]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
            return root

        assert classes(out) == classes(own)
        assert len(out) <= 57


def test_ngram_join_stays_with_clashing_names(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x y"), (3, None)]
    names = ["id", "_id", "_hash", "hash", "stays", "m", "root", "best", "text_hash", "sid", "n"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    left = ngram_join.one_of_each(df)
    assert left.columns == ["doc_id", "text", *names]
    assert sorted((str(r.doc_id), r.text, *r[2:]) for r in left.collect()) == sorted((str(d), t, *names) for d, t in rows if d != 2)
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_stays(spark):
    rows = near_copies(3, 40) + [x for x in ODD if x[0] != 0] + [(5003, "one two"), (5003, "one two"), (9999, "fresh words only in this one")]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, root string")
    left = ngram_join.one_of_each(df)
    assert left.columns == ["doc_id", "text", "root"]
    left = [(r.doc_id, r.text) for r in left.collect()]
    want = brute_components(rows)
    assert len([x for x in left if not shingles(x[1])]) == len([x for x in want if not x[1]])
    kept = [x for x in left if shingles(x[1])]
    assert max(Counter(x[2] for x in brute_components(kept)).values()) == 1
    assert {x[2] for x in want if x[1]} == {x[0] for x in kept}


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 60))), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(3000)]
    rows += [(9001, None, None, "empty", 1), (9002, "a b c", None, None, 1), (9003, "a b c", None, None, 1), (9003, "a b c", None, None, 1), (None, "x y", None, "tiny", 1)]
    df = spark.createDataFrame(rows, DOC).withColumn("draws", F.lit("clash")).withColumn("block", F.lit("own")).withColumn("_at", F.lit(1))
    asked = mixing.mixed(df, block_words=500, shards=8, columns=("block", "_at", "draws", "doc_id"))
    assert asked.columns == ["block", "_at", "doc_id", "size", "source_size", "target", "taken", "draws"]
    assert {r.block for r in asked.collect()} == {"own"}
    out = mixing.mixed(df, block_words=500, shards=8).cache()
    got = out.collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(size), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * size[s]} if total else set()
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= over
    by_id = {r[0]: r for r in rows}
    taken = Counter()
    for x in got:
        s = by_id[x.doc_id][3]
        assert x.size == len(WORD.findall(by_id[x.doc_id][1] or ""))
        assert x.source_size == size[s]
        assert x.target == pytest.approx(target[s])
        assert x.taken <= 3 * x.size
        assert x.taken == x.size * len(x.draws or []) or not x.size
        taken[s] += x.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 60, s
    key = lambda df: sorted(map(str, df.select("doc_id", "taken", "draws").collect()))
    assert key(mixing.mixed(df.repartition(5), block_words=500, shards=8)) == key(out)
    shard = Counter(d.shard for x in got for d in x.draws or [])
    assert set(shard) == set(range(8))
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_of_null_ids_and_equal_rows(spark):
    rows = [(None, "a b c d e f g", None, "nulls", 1)] * 900 + [(None, f"x y {i}", None, "more", 1) for i in range(900)] + [(5, "one two", None, "few", 1)] * 3
    got = mixing.mixed(spark.createDataFrame(rows, DOC), block_words=50, shards=4, columns=("source",)).collect()
    assert len(got) == len(rows)
    for s in ("nulls", "more", "few"):
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 7
        assert all(x.taken <= 3 * x.size for x in own)


def test_splitting_tree(spark):
    blocks = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 33)], "source_no int, n long")
    rows = mixing.shard_quotas(blocks, 6, 3).collect()
    total, per = Counter(), Counter()
    for r in rows:
        total[r.source_no] += r.quota
        per[r.shard] += r.quota
    assert total == Counter({0: 100, 1: 7, 3: 33})
    assert len(per) == 6
    assert max(per.values()) - min(per.values()) <= 2


def test_packing(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randint(1, 300)) if i % 50 else "dup text here", None, "hot" if i % 3 else f"s{i % 9}", 1) for i in range(2000)]
    rows += [(None, None, None, None, 1), (7000, "", None, "x", 1), (7001, "v " * 1000, None, "x", 1), (7002, "same", None, None, 1), (7002, "same", None, None, 1)]
    df = spark.createDataFrame(rows, DOC).withColumn("bin", F.lit(1)).coalesce(2)
    got = packing.packed(df, capacity=300, per_source=3, window=700).collect()
    want = Counter()
    for d, t, *_ in rows:
        want[d] += len(WORD.findall(t or ""))
    have, bins = Counter(), defaultdict(list)
    for x in got:
        have[x.doc_id] += x.n
        if x.bin:
            bins[x.bin].append(x)
    assert have == want
    about = {d: (s, t) for d, t, _, s, _ in rows}
    for xs in bins.values():
        xs.sort(key=lambda x: x.place)
        at = 0
        for x in xs:
            assert x.place == at
            at += x.n
        assert at <= 300
        assert max(Counter(about[x.doc_id][0] for x in xs).values()) <= 3
        assert max(Counter(about[x.doc_id][1] for x in xs).values()) == 1
    assert packing.packed(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10, 1)
    assert bins.put(7, 0, 0) == (0, 0)
    assert bins.put(8, 1, 1 << 5) == (1, 0)
    assert bins.put(2, 2, 1 << 5) == (0, 7)  # bin 1 is tighter but holds the cluster
    assert bins.put(2, 1, 0) == (2, 0)  # bin 1 holds the source
    assert bins.put(1, 3, 0) == (0, 9)


def test_packing_is_plain_best_fit(spark):
    """Against a search through all bins, in the order of sizes; the same bins from any partitions."""
    r = random.Random(9)
    rows = [(i, r.randint(1, 400), f"s{i % 3}", [r.randrange(40)] if i % 2 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, n long, source string, clusters array<long>").withColumn("text", F.lit("x"))
    pack = lambda df: {(x.doc_id, x.piece): (x.bin, x.place) for x in packing.packed(df, 300, 2, size=F.col("n"), clusters=F.col("clusters")).collect()}
    got = pack(df)
    order = {x.doc_id: k for k, x in enumerate(df.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).orderBy("h").collect())}
    bins = []
    for d, n, s, c in sorted((x for x in rows if x[1] % 300), key=lambda x: (-(x[1] % 300), order[x[0]])):
        n %= 300
        fit = [b for b in bins if b["room"] >= n and b["sources"][s] < 2 and not b["clusters"] & set(c or ())]
        best = min(fit, key=lambda b: (b["room"], b["k"]), default=None)
        if best is None:
            best = {"room": 300, "k": len(bins), "sources": Counter(), "clusters": set()}
            bins.append(best)
        assert got[d, rows[d][1] // 300] == (f"0-{best['k']}", 300 - best["room"])
        best["room"] -= n
        best["sources"][s] += 1
        best["clusters"] |= set(c or ())
    assert pack(df.repartition(7)) == got
    assert 0.85 < sum(x[1] % 300 for x in rows) / (300 * len(bins))


def test_packing_of_equal_rows_and_near_copies(spark):
    rows = [(None, "same words in every row", "s")] * 300 + [(i, " ".join(f"w{j}" for j in range(60)) + f" and {i}", "t") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.packed(df, capacity=200, per_source=9, window=50).collect()
    assert len(got) == len(rows)
    same = Counter(x.bin for x in got if x.doc_id is None)
    assert max(same.values()) == 1
    near = Counter(x.bin for x in got if x.doc_id is not None)
    assert max(near.values()) <= 2


def test_token_files(spark, sf, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    assert own.encode("hi <|endoftext|> yo", add_special_tokens=False).ids == [5303, 220, 50256, 27406]
    odd = [None, "", " ", "\n", "a  b", "a \n b\n\n", "x\ty z", "<|endoftext|>", "hi <|endoftext|> yo", "it's,\",x.y;z\". Ed. (a.b) don't! a1.b2, é,è. \n\n.a  ,b", "a.", ".", "Mr.'s x,'s", "a,\n\nb:c ;d", "it's 𝄞 1234 !!", "a" * 5000, "b  c " * 3000, "  lead", "日本 語"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(-i, t) for i, t in enumerate(odd)] + [(None, "null id"), (3, "same id")]
    out = new_path(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, id int"), out, path, file_bytes=50_000)
    got = token_files.token_table(token_files.index_tokens(spark, out, f"{out}-index")).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.id for r in got] == sorted((x[0] for x in rows), key=lambda d: (d is not None, d))
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(own.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        found = [x for x in ids[r.id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 and len(x) == r.n_tokens]
        assert found
    r = got[7]  # a shuffled read of one record
    data = open(r.file.removeprefix("file:"), "rb").read()[r.offset : r.offset + r.length]
    (at, n, payload), *more = token_files.frames(data)
    assert not more
    assert token_files.ids_of(payload)[0] == r.id
    for bad in (data[:-1], data[:-2] + b"x\n", bytes([data[0] ^ 1]) + data[1:]):
        with pytest.raises(ValueError):
            list(token_files.frames(bad))
    empty = new_path(spark, "test-tokens")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), empty, path)
    assert token_files.token_table(token_files.index_tokens(spark, empty, f"{empty}-index")).count() == 0


def test_warc(spark, sf):
    pages = [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = pages + [(1, None, "same"), (2, "http://a/b c\r\nX: y", "same"), (3, "u", "same"), (3, "u", "same"), (None, "n", "same"), (4, "e", None), (5, "e", ""), (6, "l", "x" * 3_000_000), (None, None, "lone é")]
    out = new_path(spark, "test-archives")
    warc.write_archives(spark.createDataFrame([(*x, 0) for x in rows], "page_id long, url string, html string, payload int").repartition(3), out)
    got = warc.read_archives(spark, out).collect()
    last = {}
    for p, _, h in rows:
        k = h or ""
        last[k] = max(last.get(k, -1), -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        first = last[h or ""] == (-1 if p is None else p)
        want[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else last[h or ""]] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert sum(r.url == "http://a/b%20c%0D%0AX:%20y" for r in got) == 1
    import zstandard

    r = next(r for r in got if r.page_id == 105)
    data = open(r.file.removeprefix("file:"), "rb").read()
    n = int.from_bytes(data[4:8], "little")
    record = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n])).decompress(data[r.offset : r.offset + r.length])
    assert warc.parse(record)[1].decode() == dict((p, h) for p, _, h in pages)[105]
    empty = new_path(spark, "test-archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<{tag}><h1>Head {i}</h1><p>First <b>bold</b>text &amp; more&nbsp;{i}<p>Second<br>line<div class="ad">Buy</div><ul><li>a<li>b</ul></{tag}>
<section id="comments"><p>Nice!</p></section><aside>Side</aside><form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_html(spark, sf):
    want = "Head {i} First boldtext & more {i} Second line a b"
    rows = [(i, f"https://x.org/{i}", PAGE.format(tag="article", i=i)) for i in range(6)]
    # without a container: the template of the host tells text from boilerplate
    bare = "<body><div><p>Welcome</p><p>All rights</p><p>Contact us</p><table><tr><td>Cell</td></tr></table></div><div><p>Own text {i} here</p></div><div><p>Bottom line</p></div></body>"
    rows += [(10 + i, f"https://y.org/{i}", bare.format(i=i)) for i in range(8)]
    rows += [(90, None, None), (91, "::bad[", ""), (92, "https://x.org/", "plain < text & more"), (None, "u", "<p>" * 3000 + "deep"), (93, "u", "<article>" + "<p>long text</p>" * 20000)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extracted(df).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i].text == want.format(i=i)
    for i in range(8):
        assert got[10 + i].text == f"Own text {i} here"
    assert [got[k].text for k in (90, 91, 92, None)] == ["", "", "plain < text & more", "deep"]
    assert got[93].n_chars == 20000 * len("long text ") - 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extracted(df.limit(0)).count() == 0


def texts_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extracted(df, **more).collect()}


def test_html_template_tells_slots_in_a_container(spark):
    page = "<body><div class='content'><p>Welcome all<h2>Our shop</h2><p>Own text {i}</p><ul><li>Call us<li>Find us</ul></div></body>"
    rows = [(i, f"https://z.org/{i}", page.format(i=i)) for i in range(6)]
    assert texts_of(spark, rows) == {i: f"Own text {i}" for i in range(6)}
    # tokens that change places between pages are in no template
    moved = [(i, f"https://z.org/{i}", "<body>" + "".join(f"<p>{x}</p>" for x in [f"Own {i}", *random.Random(i).sample(["One", "Two", "Three", "Four", "Five", "Six"], 6)]) + "</body>") for i in range(12)]
    assert all(len(t.split()) == 8 for t in texts_of(spark, moved).values())


def test_html_classes_must_nest():
    a = {t: (1, 2, 9) for t in (2, 4)}
    b = {t: (2, 2, 5) for t in (6, 8)}
    crossed = lambda tokens: {r[1] for r in html_extract.spans([("h", tokens, a | b)]) if r[-1]}
    assert crossed([2, 6, 8, 4]) == set()
    assert crossed([2, 4, 6, 8, 2, 4]) == set()
    assert crossed([6, 2, 4, 8]) == set()
    assert crossed([2, 6, 4, 8]) == {2}
    assert crossed([6, 2, 8, 4]) == {2}


def test_html_copies_and_links_keep_their_text(spark):
    copy = "<body><div>" + "".join(f"<p>Paragraph {k} of one text</p>" for k in range(6)) + "</div></body>"
    rows = [(i, f"https://c.org/{i}", copy) for i in range(8)] + [(20 + i, f"https://c.org/o{i}", f"<body><div><p>Other {i}</p></div></body>") for i in range(4)]
    got = texts_of(spark, rows)
    assert all(got[i] == " ".join(f"Paragraph {k} of one text" for k in range(6)) for i in range(8))
    links = "<body><p><a href='a'>One &amp; only reference</a></p><p>end</p></body>"
    assert texts_of(spark, [(1, "u", links)]) == {1: "One & only reference end"}
    # a layout of few of the host's pages has its template too
    other = "<body class='b'><table><tr><td>Left<td>Right</table><p>Mine {i}</p><dl><dt>Below</dl></body>"
    rows = [(i, f"https://d.org/{i}", f"<body><p>Text {i}</p></body>") for i in range(40)] + [(100 + i, f"https://d.org/{i}", other.format(i=i)) for i in range(5)]
    got = texts_of(spark, rows)
    assert [got[100 + i] for i in range(5)] == [f"Mine {i}" for i in range(5)]


def test_html_rows_do_not_depend_on_the_size_of_templates(spark):
    page = "<body><div class='d{k}'><p>Welcome {k}</p><table><tr><td>Cell {k}</table></div><p>Own {i}</p><p>Bottom {k}</p></body>"
    urls = ["http://a_b.org/x y?q={i}", "http://c.org/{{|}}^%{i}", "HTTP://D.org:80/{i}", "::bad[{i}", None]
    rows = [(10 * k + i, u and u.format(i=i), page.format(i=10 * k + i, k=k)) for k, u in enumerate(urls) for i in range(5)]
    few = texts_of(spark, rows)
    assert few == {i: f"Own {i}" for i, *_ in rows}
    assert texts_of(spark, rows, limit=0) == few


def test_media(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    passage = [word() for _ in range(40)]
    rows = [(100, 0, " ".join(passage)), (1, 0, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(20)])), (2, 0, " ".join(passage[10:]))]
    rows += [(i, 0, " ".join(word() for _ in range(60))) for i in range(3, 40)] + [(200, 1, " ".join(passage)), (300, 0, None), (301, 0, ""), (None, None, "short one")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    prints = media.fingerprints(turns.mapInArrow(media.spoken, "conv_id long, turn long, audio binary")).cache()
    got = {(x.conv_id, x.turn): x for x in prints.collect()}
    assert len(got[100, 0].fp) == 40 - 1 - media.WIDEST + 1
    assert got[100, 0]["class"] == got[200, 1]["class"]
    assert got[300, 0].fp == [] and got[300, 0].n_frames == 0
    pairs = {(x.q, x.r): x for x in media.alignments(prints, "coalesce(conv_id % 100 = 0, false)").collect()}
    q = got[100, 0]["class"]
    assert {k[1] for k in pairs} == {got[1, 0]["class"], got[2, 0]["class"]}
    assert pairs[q, got[1, 0]["class"]].offset == 30
    assert pairs[q, got[2, 0]["class"]].offset == -10
    # brute force over all offsets agrees on who aligns
    def aligned(a, b):
        return any(n >= media.OVERLAP and sum(bin((x ^ y) & 0xFFFFFFFF).count("1") for x, y in zip(a[max(0, -o) :], b[max(0, o) :], strict=False)) <= media.BIT_ERRORS * 32 * n for o in range(-len(a), len(b)) for n in [min(len(a) - max(0, -o), len(b) - max(0, o))])

    near = {k for k, x in got.items() if x.fp and x["class"] != q and aligned(got[100, 0].fp, x.fp)}
    assert near == {(1, 0), (2, 0)}
    assert len(media.samples_of(b"RIFFxxxxWAVEjunk")) == 0 and len(media.samples_of(None)) == 0


def test_media_finds_a_passage_within_other_sounds(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(5))
    passage = [word() for _ in range(40)]
    around = lambda a, b: " ".join([word() for _ in range(a)] + passage + [word() for _ in range(b)])
    rows = [(100, 0, around(70, 20)), (1, 0, around(10, 90)), (2, 0, around(0, 0)), (2, 1, around(0, 0))] + [(i, 0, " ".join(word() for _ in range(90))) for i in range(3, 20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("audio", F.lit("clash")).withColumn("class", F.lit(1))
    spoken = turns.select("conv_id", "turn", "text").mapInArrow(media.spoken, "conv_id long, turn long, audio binary")
    prints = media.fingerprints(spoken).cache()
    name = {x["class"]: x.conv_id for x in prints.collect()}
    got = {name[x.r]: (x.offset, x.start, x.overlap) for x in media.alignments(prints, "conv_id = 100").collect()}
    assert set(got) == {1, 2}
    assert got[1][0] == -60 and got[2][0] == -70
    assert all(abs(start - 70) <= media.WIDEST and 30 - media.WIDEST <= n <= 40 + media.WIDEST for _, start, n in got.values())
    assert media.alignments(media.fingerprints(spoken.limit(0)), "conv_id = 100").count() == 0


def test_licenses(spark):
    ordinary = "The thand oner is andthe reer thaning of the ou and in the only this re."
    rows = [(i, f"{ordinary} {i}\n" * 3) for i in range(300)]
    planted = {1001: ("MIT", "Released under the MIT License."), 1002: ("GPL", "This work is licensed under the GNU General Public License, version 3."), 1003: ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), 1004: ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), 1005: ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."), 1006: ("", "See the license for what it is worth to you."), 1007: ("", "The license plate of a car.")}
    rows += [(k, f"{ordinary}\n{t}\n{ordinary}") for k, (_, t) in planted.items()] + [(2001, None), (2002, ""), (2003, ordinary * 500 + " " + planted[1001][1] + " " + ordinary * 500), (None, planted[1002][1])]
    found = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, family string")).collect():
        if r.family != licenses.UNKNOWN:
            found[r.doc_id].add(r.family)
    assert found == {k: {f} for k, (f, _) in planted.items() if f} | {None: {"GPL"}} | ({2003: {"MIT"}} if 2003 in found else {})
    assert 2003 in found


def test_licenses_without_keywords_and_over_line_ends(spark):
    ordinary = "The thand oner is andthe reer thaning of the ou and in the only this re."
    rows = [(i, f"{ordinary} {i}\n" * 3) for i in range(300)]
    planted = {1001: ("Apache-2.0", "Released under Apache 2.0."), 1002: ("GPL", "Distributed under the GNU GPL v3"), 1003: ("GPL", "GPLv3"), 1004: ("BSD", "BSD-3-Clause"), 1005: ("CC-BY-SA", "CC-BY-SA 4.0")}
    planted |= {1006: ("GPL", "# You should have received a copy of the\n# GNU General\n# Public License along with this program"), 1007: ("MIT", " * This project is distributed and used under the\n * terms of the MIT\n * license.")}
    rows += [(k, f"{ordinary}\n\n{t}\n\n{ordinary}") for k, (_, t) in planted.items()]
    found = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id].add(r.family)
    assert {k: v - {licenses.UNKNOWN} for k, v in found.items() if k > 1000} == {k: {f} for k, (f, _) in planted.items()}
    assert all(k > 1000 for k in found)


def test_licenses_of_equal_and_null_ids(spark):
    ordinary = "The thand oner is andthe reer thaning of the ou and in the only this re."
    planted = ["Released under the MIT terms.", "Apache 2.0", "available under the BSD 3-Clause terms", "Distributed under GNU GPL version 3 terms", "Creative Commons Attribution 4.0 International License"]
    want = ["MIT", "Apache-2.0", "BSD", "GPL", "CC-BY"]
    rows = [(i, f"{ordinary} {i}\n" * 3) for i in range(200)] + [(k % 2 or None, f"{ordinary}\n{t}\n{ordinary}") for k, t in enumerate(planted)] + [(7, planted[0]), (7, planted[0]), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("words_of", F.lit(2)).withColumn("text_of", F.lit("x"))
    out = licenses.notices(df)
    assert out.columns == [*df.columns, "notices"]
    got = Counter((r.doc_id, r.text, x.line, x.family) for r in out.collect() for x in r.notices)
    assert got == Counter([(k % 2 or None, f"{ordinary}\n{t}\n{ordinary}", 1, want[k]) for k, t in enumerate(planted)] + 2 * [(7, planted[0], 0, "MIT")])
    assert licenses.notices(df.limit(0)).count() == 0


def test_license_bound_drops_no_window(spark):
    """All windows scored one by one, by the model's own weights, give what the scan gives."""
    r = random.Random(6)
    pool = sorted({w for ts in licenses.TEMPLATES.values() for t in ts for w in re.sub(r"[^A-Za-z0-9.+-]+", " ", t).split()})
    lines = [" ".join(r.choice(pool) for _ in range(r.randint(1, 40))) for _ in range(300)] + [t for ts in licenses.TEMPLATES.values() for t in ts]
    lines += [f"only plain words stand here {i}" for i in range(100)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 2])) for i in range(0, len(lines), 2)], "doc_id long, text string")
    ordinary = spark.createDataFrame([(f"only plain words in row {i}".split() if i > 200 else [w.lower() for w in r.choices(pool, k=12)], i % 2) for i in range(4000)], "w array<string>, part int")
    model = licenses.Model(spark, ordinary)
    docs = docs.withColumn("w", F.expr(licenses.words("text")))

    def found():
        rows = docs.withColumn("at", F.expr(model.likely("w"))).withColumn("found", F.expr(model.found("text", "w", "at")))
        return {r.doc_id: (len(r.at), r.found) for r in rows.select("doc_id", "at", "found").collect()}

    got = found()
    model.need = -1e9
    for d, (_, every) in found().items():
        assert got[d][1] == every
        assert got[d][0] or not every
    assert any(x for _, x in got.values()) and not all(n for n, _ in got.values())


def test_license_words(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab9.+- ,\nZ\u00e9") for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["-" * 300_000, "a." * 100_000, "a" + "." * 300_000 + " b"]
    for x in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.expr(licenses.words("text")).alias("w")).collect():
        assert x.w == [w for w in (w.rstrip(".+-") for w in re.findall("[a-z0-9.+-]+", x.text.lower())) if w]


def test_license_model_is_of_all_windows(spark, monkeypatch):
    """The fit and the threshold know every distinct window of every line, as brute force has them."""
    r = random.Random(9)
    pool = "the license of under gnu general public v3 lgpl mit terms 4.0 sa by cc apache-2.0 a b c d e f".split()
    lines = [" ".join(r.choice(pool) for _ in range(r.randint(0, 45))) for _ in range(6000)] + ["the mit license, of a... -b"] * 9
    kept = {}
    monkeypatch.setattr(licenses, "stored", lambda df, name: kept.setdefault(name, _common.stored(df, name)))
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 5])) for i in range(0, len(lines), 5)], "doc_id long, text string")
    licenses.notices(docs)

    def grams(w):
        return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}

    parts = lambda w: [w[i : i + 16] for i in (range(0, len(w) - 8, 8) if len(w) > 16 else [0] if w else [])]
    cut = lambda t: [x for x in (x.rstrip(".+-") for x in re.findall("[a-z0-9.+-]+", t.lower())) if x]
    own = [w for t in [*(t for ts in licenses.TEMPLATES.values() for t in ts), *licenses.NEAR_MISSES] for w in parts(cut(t))]
    names = sorted(set().union(*map(grams, own)), key=lambda x: (" " in x, x))
    every = {tuple(w) for t in lines for w in parts(cut(t))}
    assert len(every) > 12_000
    want = Counter((frozenset(grams(w) & set(names)), 2 * len(w) - 1) for w in every)
    got, halves = Counter(), Counter()
    for x in kept["patterns"].collect():
        assert x.g == sorted(set(x.g))
        got[frozenset(names[k] for k in x.g), x.n] += x.times
        halves[x.part] += x.times
    assert got == want
    assert set(halves) == {0, 1} and min(halves.values()) > 0.47 * len(every)


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    good = "The cat sat on the mat. It was warm and the sun shone over all of the old garden. "
    rows = [(1, good * 1 + "Write to me@x.org today.", None, "s", 1), (1, good * 1 + "Write to me@x.org today.", None, "s", 1), (None, "Now and then a bird sang in one of the tall trees near the house by the sea.", "en", None, 1), (2, None, None, None, None), (3, "", "en", "s", 0)]
    extra = ["_draw", "size", "q", "kept", "pii", "_n", "_text", "held", "draws"]
    docs = spark.createDataFrame(rows, DOC).select("*", *[F.lit(c).alias(c) for c in extra])
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, None)
            assert out.columns == docs.columns
            path = new_path(spark, "test-stage")
            out.write.parquet(path)
            df = spark.read.parquet(path)
            assert all(r[c] == c for r in df.collect() for c in extra)
        last = corpus_pipeline.STAGES[-1][1](spark, df, None)
        assert last.columns == ["doc_id", "piece", "first", "n", "bin", "place"]
        assert last.count() == df.count()
    assert "me@x.org" not in str(df.collect())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf)
        path = new_path(spark, f"test-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert 0 < docs.count() <= 3 * before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    words = docs.select(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert out.agg(F.sum("n")).first()[0] == words

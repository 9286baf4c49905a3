"""Templates of hosts against explicit occurrence vectors, and planted articles without a container."""

import random
from collections import Counter, defaultdict

from tessera.llm import html_extract as H


def brute(pages):
    """host, token of valid classes, from whole vectors and every span of every class."""
    series = defaultdict(dict)
    for _, url, html in pages:
        series[H.host(url)][html] = H.page_tokens(html)[0]
    out = set()
    for host, own in series.items():
        vectors = defaultdict(tuple)
        for t in {t for tokens in own.values() for t in tokens}:
            vectors[t] = tuple(tokens.count(t) for tokens in own.values())
        classes = defaultdict(set)
        for t, v in vectors.items():
            if sum(n > 0 for n in v) >= H.MIN_PAGES:
                classes[v].add(t)
        for tokens in classes.values():
            fixed = set()
            for t in tokens:
                places = {[x for x in page if x in tokens].index(t, k) % len(tokens) for page in own.values() if t in page for k in [0]}
                places |= {k % len(tokens) for page in own.values() for k, x in enumerate(x for x in page if x in tokens) if x == t}
                fixed |= {t} if len(places) == 1 else set()
            if len(fixed) < H.MIN_TOKENS or all(t & 1 for t in fixed):
                continue
            between = set()
            for page in own.values():
                at = [k for k, x in enumerate(page) if x in fixed]
                if at:
                    between.add(tuple(sorted(x for x in page[at[0] : at[-1]] if x & 1 and x not in fixed)))
            if len(between) > 1:
                out |= {(host, t) for t in fixed}
    return out


def test_template_equals_explicit_vectors(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    pages = []
    for h in range(4):
        for i in range(14):
            layout = f"<div class='top{h}'><p>Welcome to {h}</p></div><div class='mid{h}'>" if i % 2 else f"<table class='t{h}'><tr><td>Cell {h}</table><section class='s{h}'>"
            body = "".join(f"<p>{word()} {word()}</p>" for _ in range(r.randint(1, 4)))
            pages.append((100 * h + i, f"http://h{h}.org/{i}", f"<html><body>{layout}{body}<h2>{word()}</h2></body></html>"))
        pages.append((100 * h + 50, f"http://h{h}.org/copy", pages[-1][2]))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = brute(pages)
    got = {(x.host, x.token) for x in H.templates(df.select("url", "html")).collect()}
    assert got == want and len({h for h, _ in got}) == 4
    assert {(x.host, x.token) for x in H.templates(df.select("url", "html"), 0).collect()} == want


def test_planted_articles_without_a_container(spark):
    """Names that tell nothing: the slots' contents over the host's pages tell the article, at any share of its pages."""
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    slogans = [text(6) for _ in range(5)]
    rows, want = [], {}
    for i in range(60):
        links = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in text(5).split())
        paragraphs = [text(r.randint(5, 40)) for _ in range(r.randint(1, 5))]
        head = text(5)
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = f"<html><body><div class='k1'><ul>{links}</ul></div><div class='k2'>{r.choice(slogans)}</div><div class='k3'><h1>{head}</h1>{body}</div><div class='k4'><h4>About</h4>{r.choice(slogans)}</div></body></html>"
        rows.append((i, f"http://one.org/{i}", html))
        want[i] = " ".join([head, *paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in H.extracted(df).collect()}
    plain = {i: H.main_text(html) for i, _, html in rows}
    count = lambda a, b: sum((Counter(a.split()) & Counter(b.split())).values())
    shared = sum(count(got[i], want[i]) for i in want)
    assert shared / sum(len(x.split()) for x in got.values()) >= 0.99 and shared == sum(len(x.split()) for x in want.values())
    assert all(plain[i] != got[i] for i in want)


def test_the_slot_with_the_most_text_stays(spark):
    """Many pages of one text: its slot holds few different texts, yet it is the article's."""
    page = "<html><body><div class='a'><b>Hi</b> {i}</div><div class='b'><h1>Title</h1><p>{text}</p></div></body></html>"
    text = "the same long text of every page of this host, " * 20
    rows = [(i, f"http://same.org/{i}", page.format(i=i, text=f"{text}{i // 8}")) for i in range(16)]
    got = {x.page_id: x.text for x in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"{' '.join(text.split())} " in got[i] for i in got)


def test_links():
    of = lambda html: [(b.text, b.linked) for b in H.blocks(html) if isinstance(b, H.Block)]
    assert of("<p><a href=x>One two</a></p><p>Three <a>f</a> more</p><li><a>open<li>shut") == [("One two", True), ("Three f more", False), ("open", True), ("shut", False)]

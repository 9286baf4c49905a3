"""Main text of web pages by template deduction.

A page is a series of tokens: tags with their path and the text of its blocks. Tokens that occur equally often in the same
pages of a host form an equivalence class. A class is valid if enough pages share it, it has tags, its tokens come in one
order, its spans nest with those of other classes, and content that differs by page lies between its tokens. Valid classes
are the template of the pages that share them: their text is boilerplate, and what follows each of their tokens is a slot.
A layout of some of a host's pages has a class of its own, since its tags have a vector of their own.

Slots are judged over all the host's pages: one that holds few different texts, or little but links, or little but what is
never part of an article (menus, headers, footers, sidebars, notices, adverts, forms, comments, by tags and names), is not
the article's. The main text is what the other slots hold. Where a page marks the article's container itself, that chooses
among its slots; an article element's text is kept also where pages share it.

A class is found by its occurrence vector's fingerprint: for each token the exclusive or of a hash of (page, count). It is
the same for tokens with the same vector, and pre-aggregates in each task, so that a host with a third of all pages costs
no more than others and no vector is ever gathered. Equal pages of a host are one page and have one vote.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import BROADCAST_ROWS, stored, table

#: A class is valid if at least so many different pages of a host have its tokens, and it has so many tokens.
MIN_PAGES, MIN_TOKENS = 4, 4
#: A slot is not the article's if of its characters at least so many are in links, or in what rules take out, or if its
#: different texts are at most such a share of its pages.
LINKED, OUT, FRESH = 0.8, 0.9, 0.5

#: A quote opens a string only where a value begins; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
#: Elements of other languages; they alone may end in their own tag.
FOREIGN = {"svg", "math"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An open paragraph ends where one of these begins.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An open element of these ends where another of its group begins.
SIBLINGS = ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"thead", "tbody", "tfoot"}, {"option", "optgroup"})
SCOPES = {"article", "aside", "div", "footer", "form", "header", "main", "nav", "section", "table", "ul", "ol", "dl", "td", "body", "html"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "input", "dialog", "menu", "noscript", "object", "canvas", "audio", "video", "map"} | RAW
#: Words in class, id or role of an element that is not part of the article.
NOT_ARTICLE = re.compile(
    r"(?:^|(?<=[\s_-]))(ad|ads|adv|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|aside|footer\w*|header|masthead|topbar|toolbar|comment\w*|disqus\w*|reply|replies|respond|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|search\w*|form|complementary|contentinfo|navigation|dialog)(?=$|[\s_-])",
    re.I,
)
#: Of these, ordinary words: among several names of an element they may be part of a phrase and tell nothing.
ORDINARY = {"side", "aside", "form", "notice", "notices", "alert", "alerts", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "search", "login", "menu", "comment", "comments", "header"}
#: Elements that hold the text itself: no name takes them out.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dd", "dt", "figcaption"}
#: Names that say what a wrapper has or lacks, not what it is.
WITHOUT = re.compile(r"\b(?:no|has|with|without|hide)-[\w-]+", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|maincontent|body-?text)(?:$|[\s_-])", re.I)


def _tells(marks: str, article: bool) -> bool:
    """Whether names say that an element is not part of the article. A header within an article is its own."""
    names = WITHOUT.sub("", marks).lower()
    several = set(names.split()) if len(names.split()) > 1 else set()
    return any(not (article and m[1] == "header") and m[1] not in ORDINARY & several for m in NOT_ARTICLE.finditer(names))


class Block:
    __slots__ = ("path", "text", "out", "article", "element", "linked")

    def __init__(self, path: str, text: str, out: bool, article: bool, element: bool, linked: bool):
        self.path, self.text, self.out, self.article, self.element, self.linked = path, text, out, article, element, linked


def blocks(html: str) -> list[Block | str]:
    """The text blocks of a page and the paths of its tags, in order. Takes time linear in the page and the depth of its
    elements; any text is a page, closed and well nested or not."""
    found: list[Block | str] = []
    stack: list[tuple[str, bool, bool, bool, str]] = [("", False, False, False, "")]  # name, out, in an article, in an article element, path
    held: list[str] = []
    links: list[str] = []  # of these, those in links
    link = False

    def flush() -> None:
        nonlocal held, links, link
        text = " ".join(unescape("".join(held)).split())
        if text:
            _, out, article, element, path = stack[-1]
            linked = bool(links) and 2 * sum(map(len, "".join(links).split())) > sum(map(len, "".join(held).split()))
            found.append(Block(path, text, out, article, element, linked))
        held, links, link = [], [], False

    def close(upto: int) -> None:
        del stack[upto:]

    at, end = 0, len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0:
            start = end
        if start > at:
            held.append(html[at:start])
            if link:
                links.append(held[-1])
        if start == end:
            break
        m = TOKEN.match(html, start)
        if not m:
            held.append("<")
            at = start + 1
            continue
        at = m.end()
        if m[0].startswith("<![CDATA["):
            held.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                link = link and name != "a"
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in INLINE:
            link = link or name == "a"
            continue
        flush()
        if name in FOREIGN and m[0].endswith("/>"):
            continue
        if name in RAW:
            found.append(f"{stack[-1][-1]}>{name}")
            done = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = done.end() if done else end
            continue
        if name in VOID:
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        for group in SIBLINGS:
            if name in group:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in group:
                        close(k)
                        break
                    if stack[k][0] in SCOPES and stack[k][0] not in group:
                        break
        if name in ("body", "article", "main") or stack[-1][0] == "head" and name not in NEVER:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "head":
                    close(k)
        own = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(m[3])} if m[3].strip() else {}
        marks = " ".join(own[k] for k in ("class", "id", "role") if k in own)
        _, out, article, element, path = stack[-1]
        if len(path) > 400:  # a long path gives way to its hash
            path = f"{_hash('p', path):x}"
        path = f"{path}>{name}{'.' + own['class'] if own.get('class') else ''}"
        page_header = name == "header" and not article
        hidden = "hidden" in own or "display:none" in own.get("style", "").replace(" ", "") or own.get("aria-hidden") == "true"
        if not out and (name in NEVER or page_header or hidden):
            out = True
        if not out and marks and name not in ("body", "html", "main") and name not in PROSE and (name != "article" or article):
            out = any(_tells(own[k], article) for k in ("class", "id", "role") if own.get(k))
        article = article or (not out and (name in ("article", "main") or own.get("role") == "main" or own.get("itemprop") == "articleBody" or bool(marks) and name in ("div", "section") and bool(ARTICLE.search(marks))))
        element = element or (not out and (name == "article" or own.get("itemprop") == "articleBody"))
        found.append(path)
        if not m[0].endswith("/>") or name in SCOPES or name == "p":
            stack.append((name, out, article, element, path))
    flush()
    return found


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def token(x: Block | str) -> int:
    """The lowest bit tells texts from tags."""
    return _hash("t", x) & ~1 if isinstance(x, str) else _hash("x", x.path, x.text) | 1


def page_tokens(html: str) -> tuple[list[int], list[int]]:
    """The tokens of a page in order, and of each text four times its characters, with 2 if links are most of it and 1 if
    rules take it out; 0 for tags."""
    found = blocks(html)
    tags = {x: token(x) for x in {x for x in found if isinstance(x, str)}}
    return [tags[x] if isinstance(x, str) else token(x) for x in found], [0 if isinstance(x, str) else 4 * len(x.text) + 2 * x.linked + x.out for x in found]


def series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, digest, tokens and marks of each page (url, html)."""
    for batch in batches:
        urls, htmls = (c.to_pylist() for c in batch.columns)
        found = [page_tokens(h) for h in htmls]
        cols = [pa.array([host(u) for u in urls], pa.string()), pa.array([_hash(h) for h in htmls], pa.int64()), pa.array([t for t, _ in found], pa.list_(pa.int64())), pa.array([m for _, m in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["host", "digest", "tokens", "marks"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "host" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each host's tokens in a batch: pages, and the fingerprint of the occurrence vector."""
    for batch in batches:
        own: dict[tuple[str, int], list[int]] = {}
        for name, digest, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marks: dict[int, int] = {}
            for t, n in Counter(tokens).items():
                x = own.setdefault((name, t), [0, 0])
                x[0] += 1
                if n not in marks:
                    marks[n] = _hash(str(digest), str(n))
                x[1] ^= marks[n]
        yield _batch([(h, t, n, v) for (h, t), (n, v) in own.items()], ["host", "token", "pages", "vector"])


#: Of a token of a class: class, its number of tokens, its pages.
Member = tuple[int, int, int]


def ranks(pages: list[tuple[str, list[int], dict[int, Member]]]) -> list[tuple]:
    """host, token, least and greatest rank of the token in its class, over pages (host, tokens, members)."""
    found: dict[tuple[str, int], list[int]] = {}
    for name, tokens, members in pages:
        seen: dict[int, int] = {}
        for t in tokens:
            m = members.get(t)
            if m:
                k = seen.get(m[0], 0)
                seen[m[0]] = k + 1
                x = found.setdefault((name, t), [k % m[1], k % m[1]])
                x[0], x[1] = min(x[0], k % m[1]), max(x[1], k % m[1])
    return [(*k, *x) for k, x in found.items()]


def spans(pages: list[tuple[str, list[int], dict[int, Member]]]) -> list[tuple]:
    """host, class, least and greatest digest of the texts between its tokens, and 1 if its spans cross those of a class
    with more pages, over pages (host, tokens, members)."""
    found: dict[tuple[str, int], list[int]] = {}
    for name, tokens, members in pages:
        open_: list[int] = []  # classes, the innermost last
        about: dict[int, Member] = {}
        at: dict[int, int] = {}
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        own: dict[int, int] = {}
        crossed: set[int] = set()
        total = 0
        for t in tokens:
            m = members.get(t)
            if m:
                c = m[0]
                about[c] = m
                first.setdefault(c, total)
                k = at.get(c, 0)
                at[c] = (k + 1) % m[1]
                if c not in crossed:
                    if not k:
                        open_.append(c)
                    while open_ and c in open_ and open_[-1] != c:
                        above = open_[-1]
                        if (about[above][2], about[above][1], above) > (m[2], m[1], c):
                            crossed.add(c)
                            open_.remove(c)
                        else:
                            crossed.add(above)
                            open_.pop()
                    if open_ and open_[-1] == c and k == m[1] - 1:
                        open_.pop()
            if t & 1:
                total += t * t + t  # a sum of hashes does not depend on the order
            if m:
                if t & 1:
                    own[m[0]] = own.get(m[0], 0) + t * t + t
                last[m[0]] = total
        for c in about:
            between = (last[c] - first[c] - own.get(c, 0)) & (1 << 62) - 1
            x = found.setdefault((name, c), [between, between, 0])
            x[0], x[1], x[2] = min(x[0], between), max(x[1], between), x[2] | (c in crossed)
    return [(*k, *x) for k, x in found.items()]


def slots(pages: list[tuple[str, list[int], list[int], dict[int, tuple]]]) -> list[tuple]:
    """host, slot (the token of the template before it), hash of its texts, its characters, those in links and those that rules
    take out: of each slot with text of each page (host, tokens, marks, template)."""
    found = []
    for name, tokens, marks, template in pages:
        slot = 0
        own: dict[int, list[int]] = {}
        for t, m in zip(tokens, marks, strict=True):
            if t in template:
                slot = t
            elif m:
                x = own.setdefault(slot, [0, 0, 0, 0])
                x[0] = (x[0] * 31 + t) & (1 << 62) - 1
                x[1] += m >> 2
                x[2] += (m >> 2) * (m >> 1 & 1)
                x[3] += (m >> 2) * (m & 1)
        found += [(name, slot, *x) for slot, x in own.items()]
    return found


def beside(pages: DataFrame, members: DataFrame, limit: int, work: Callable[[list[tuple]], pa.RecordBatch], schema: str) -> DataFrame:
    """work over the rows of pages (host first), each with its host's members (host, token, others) as a dictionary. Up to
    `limit` members go to every task; beyond that they are joined by the same host."""
    columns = members.columns[1:]
    if members.limit(limit + 1).count() <= limit:
        by_host: dict[str, dict[int, tuple]] = {}
        for r in members.collect():  # its size has been checked
            by_host.setdefault(r[0], {})[r[1]] = tuple(r[2:])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield work([(*r, by_host.get(r[0], {})) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

        return pages.mapInArrow(read, schema)

    def read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work([(*r[:-1], {m[columns[0]]: tuple(m[c] for c in columns[1:]) for m in r[-1] or ()}) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    # a host's members are no more than its pages' tokens
    sets = members.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("members"))
    return pages.join(sets, "host", "left").select(*pages.columns, "members").mapInArrow(read_joined, schema)


def templates(pages: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """host, token, out: each host's template, the tokens of valid classes, and 1 if the slot behind a token is not the
    article's. pages: url, html."""
    found = pages.select("url", "html").mapInArrow(series, "host string, digest long, tokens array<long>, marks array<int>")
    once = stored(found.groupBy("host", "digest").agg(F.first(F.struct("tokens", "marks")).alias("x")).select("host", "digest", "x.*"), "series")
    token = once.select("host", "digest", "tokens").mapInArrow(occurrences, "host string, token long, pages long, vector long")
    token = token.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.expr("bit_xor(vector)").alias("vector")).where(f"pages >= {MIN_PAGES}")
    token = stored(token.select("host", "token", "pages", F.xxhash64("vector", "pages").alias("class")), "occurrences")
    own = once.select("host", "tokens")

    def sized(rows: DataFrame) -> DataFrame:
        """Tokens of classes with enough tokens, tags among them: copies of a text share no tags of their own."""
        size = rows.groupBy("host", "class").agg(F.count("*").alias("size"), F.min(F.expr("token & 1")).alias("no_tags"))
        size = size.where(f"no_tags = 0 AND size >= {MIN_TOKENS}").select("host", "class", "size")
        return rows.join(size, ["host", "class"]).select("host", "token", "class", "size", "pages")

    members = stored(sized(token), "members")
    ranked = beside(own, members, limit, lambda rows: _batch(ranks(rows), ["host", "token", "lo", "hi"]), "host string, token long, lo long, hi long")
    fixed = ranked.groupBy("host", "token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select("host", "token")
    ordered = stored(sized(members.drop("size").join(fixed, ["host", "token"])), "ordered")
    judged = beside(own, ordered, limit, lambda rows: _batch(spans(rows), ["host", "class", "lo", "hi", "crossed"]), "host string, class long, lo long, hi long, crossed long")
    valid = judged.groupBy("host", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("crossed").alias("crossed")).where("lo <> hi AND crossed = 0")
    template = stored(ordered.join(valid, ["host", "class"]).select("host", "token"), "tokens")
    return template.join(outside(once, template, limit), ["host", "token"], "left").select("host", "token", F.coalesce("out", F.lit(0)).alias("out"))


def outside(once: DataFrame, template: DataFrame, limit: int) -> DataFrame:
    """host, token, out (1): the slots that are not the article's. That with the most different text is never one of them."""
    names = ["host", "token", "content", "n", "linked", "ruled"]
    held = beside(once.select("host", "tokens", "marks"), template, limit, lambda rows: _batch(slots(rows), names), "host string, token long, content long, n long, linked long, ruled long")
    held = held.groupBy("host", "token", "content").agg(F.count("*").alias("pages"), F.max("n").alias("once"), *[F.sum(c).alias(c) for c in names[3:]])
    held = held.groupBy("host", "token").agg(F.count("*").alias("texts"), *[F.sum(c).alias(c) for c in ("pages", "once", *names[3:])])
    # a host's slots are no more than its template's tokens
    most = held.where(f"ruled < {OUT} * n").groupBy("host").agg(F.max(F.struct("once", "token")).alias("most")).select("host", F.col("most.token").alias("most"))
    out = f"ruled >= {OUT} * n OR pages >= {MIN_PAGES} AND token <> most AND (linked >= {LINKED} * n OR texts <= {FRESH} * pages)"
    return held.join(most, "host", "left").where(out).select("host", "token", F.lit(1).alias("out"))


def main_text(html: str, template: dict[int, tuple[int]] | None = None) -> str:
    """Text of the slots of the article: those in its container if the page marks it, else those that the host's pages do not
    tell from it. An article element's text is whole."""
    template = template or {}
    out, found = 0, []
    for x in blocks(html):
        own = template.get(token(x)) if template else None
        if own:
            out = own[0]
        if not isinstance(x, str) and not x.out and (x.element or not own and (x.article or not out)):
            found.append(x)
    return " ".join(b.text for b in [b for b in found if b.article] or found)


def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page_id, url, html for page_id, url, html."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([host(u) for u in batch.column(1).to_pylist()], pa.string()), *batch.columns], ["host", *batch.schema.names])


def extracted(pages: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html gives an empty text; a null or odd url is of the host "". Repeated rows and null ids are rows like
    any other; other columns are not read; an empty table gives an empty table. Whole pages at any length. Templates of up
    to `limit` tokens go to every task, longer ones are joined; the rows are the same.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    template = stored(templates(rows, limit), "templates")
    named = rows.mapInArrow(with_host, "host string, page_id long, url string, html string")

    def output(found: list[tuple]) -> pa.RecordBatch:
        texts = [main_text(html, template) for _, _, _, html, template in found]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in found], pa.int64()), pa.array([r[2] for r in found], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return beside(named, template, limit, output, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

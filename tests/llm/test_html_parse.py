"""Text that odd tags must not take away."""

import pytest

from tessera.llm.html_extract import blocks


def article(html: str) -> str:
    return " ".join(b.text for b in blocks(f"<html><body><article>{html}</article></body></html>") if not isinstance(b, str) and not b.out)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p>Before</p><svg class="i"/><p>After words</p>', "Before After words"),
        ("<p>Before</p><math/><p>After</p>", "Before After"),
        ("<p>Before</p><svg><path d='x'/></svg><p>After</p>", "Before After"),
        ("<p class=it's>Hello world</p><p>it's</p><p>End</p>", "Hello world it's End"),
        ('<p title=5">Hello</p><p>"quoted"</p>', 'Hello "quoted"'),
        ("<p title='a > b'>Hello</p><p data-x = \"<p>\">There</p>", "Hello There"),
        ("<p>A</p><!--><p>B</p><!-- x --><p>C</p>", "A B C"),
        ("<p>A</p><!---><p>B</p>", "A B"),
        ("<p>A</p><!-- x --!><p>B</p>", "A B"),
        ("<p>A</p><!-- <p>no</p> --><p>B</p>", "A B"),
        ('<p class="notice period">One</p><div class="side by side">Two</div><div class="long form">Three</div>', "One Two Three"),
        ('<p>One</p><div class="ad">Buy</div><div class="box ad">Buy</div><div class="sidebar left">Menu</div><div id="comments">Hi</div><div class="share-buttons">Tell</div><p>Two</p>', "One Two"),
        ('<header class="header"><h1 class="title">Head</h1></header><p>Body</p>', "Head Body"),
    ],
)
def test_article_text_stays(html, text):
    assert article(html) == text


def test_deep_paths_stay_apart():
    deep = "".join(f'<div class="level-{i:03}">' for i in range(80))
    found = [b.path for b in blocks(f"<body>{deep}<p>x</p><section><p>y</p></section></body>") if not isinstance(b, str)]
    assert len(set(found)) == 2 and all(len(p) < 500 for p in found)

"""Which region of a page is kept, and what class names put aside."""

import random
import re
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest

from tracebed.llm import html

LONG = "A sentence of the article with a good number of words in it, so that it counts as text. "
TEXT = LONG.strip()
MUCH = "\n".join(f"<p>{LONG * 6}</p>" for _ in range(5))
PARTS = [(LONG * 6).strip()] * 5


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<body><p>x</p><div class=post><h1>Title</h1><p>lead</p><div class=text>{MUCH}</div></div></body>", ["Title", "lead", *PARTS]),
        (f"<body><div class=post><div>{LONG * 2}</div><div class=text>{MUCH}</div></div></body>", [(LONG * 2).strip(), *PARTS]),
        (f"<body><div class=story>{MUCH}</div><article class=card><p>{LONG}</p></article></body>", [*PARTS, TEXT]),
        (f"<body><main><h1>T</h1>{MUCH}<article class=card><p>{LONG}</p></article></main></body>", ["T", *PARTS, TEXT]),
        (f"<body><article>{MUCH}</article><article>{MUCH}</article><article><p>end</p></article></body>", [*PARTS, *PARTS, "end"]),
    ],
)
def test_region(page, blocks):
    assert html.main_text(page).split("\n\n") == blocks


@pytest.mark.parametrize("attrs", ["class='layout has-sidebar'", "id='wrapper' class='header-fixed'", "class='with-sidebar'", "class='text-navy'", "class='page sidebar'", "class='menu'"])
def test_layout_wrappers(attrs):
    page = f"<body><div {attrs}><article><h1>T</h1>{MUCH}</article><div class=sidebar><p>{LONG}</p></div></div></body>"
    assert html.main_text(page).split("\n\n") == ["T", *PARTS]
    assert html.main_text(f"<body><div {attrs}><p>{LONG}</p></div></body>") == TEXT


def test_comments_stay_aside():
    assert html.main_text(f"<body><div class=post><p>{LONG * 3}</p></div><div id=comments>{MUCH}</div></body>") == (LONG * 3).strip()
    assert html.main_text(f"<body><div class=comments><p>{LONG}</p></div></body>") == TEXT  # nothing else is left
    assert html.main_text(f"<body><div class=ad>{MUCH}</div><article><p>{LONG}</p></article></body>") == TEXT
    assert html.main_text(f"<body><div class=sidebar>{MUCH}</div><article><p>{LONG}</p></article></body>") == TEXT


def brute_content(lines):
    """Text per tag, Gaussian weights of two neighbours on each side, and one standard deviation, by definition."""
    ratio = np.array([0 if aside else len(text) / max(1, tags) for text, tags, aside, _ in lines])
    at = np.arange(len(ratio))
    weight = np.exp(-((at[:, None] - at) ** 2) / 2) * (abs(at[:, None] - at) <= 2)
    smooth = (weight * ratio).sum(axis=1) / weight.sum(axis=1)
    return [bool(s >= smooth.std() and not line[2]) for s, line in zip(smooth, lines, strict=True)]


def test_content_lines_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        lines = [("x" * rng.choice([1, 5, 40, 300]), rng.randrange(1, 9), rng.random() < 0.2, ()) for _ in range(rng.randrange(1, 40))]
        assert html.content(lines) == brute_content(lines)


def given_pages():
    return [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist() if x]


def test_pages_by_construction():
    """The given pages are a menu, an advert, an article and a footer: its blocks, by regular expressions."""
    blocks = re.compile(r"<(?:h1|p)>((?:(?!</?(?:h1|p)>).)*)", re.S)
    for page in given_pages():
        article = page.partition("<article>")[2].partition("</article>")[0]
        texts = [" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in blocks.findall(article)]
        assert html.main_text(page) == "\n\n".join(x for x in texts if x)


def test_ratios_find_the_article_without_names(monkeypatch):
    """Without the article's tag and the advert's class the ratios select, on nearly all pages; without them nothing does."""
    pages = given_pages()
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>").replace(' class="ad"', "") for p in pages]
    texts = [html.main_text(p) for p in pages]
    found = sum(html.main_text(b) == t for b, t in zip(bare, texts, strict=True))
    monkeypatch.setattr(html, "content", lambda lines, linked=None: [not line[2] for line in lines])
    blind = sum(html.main_text(b) == t for b, t in zip(bare, texts, strict=True))
    assert found >= 0.9 * len(pages) and blind <= 0.1 * len(pages)


LINKS = [f"<a href=/{i}>Link number {i}</a>" for i in range(30)]


@pytest.mark.parametrize("group", [f"<div class=toplinks>{' '.join(LINKS)}</div>", f"<ul>{''.join(f'<li>{x}' for x in LINKS)}</ul>", f"<div>{''.join(f'<div>{x}</div>' for x in LINKS)}</div>"])
def test_groups_of_links_go(group):
    for page in (f"<body>{group}<div><h1>T</h1>{MUCH}</div>", f"<body><article><h1>T</h1>{group}{MUCH}</article>", f"<body><article><h1>T</h1>{MUCH}{group}</article>"):
        assert html.main_text(page).split("\n\n") == ["T", *PARTS]
    assert html.main_text(f"<article><h1>T</h1>{MUCH}<ul><li>one<li><a href=x>two</a></ul><div class=adbox>Buy</div></article>").split("\n\n") == ["T", *PARTS, "one", "two"]


def test_deep_nesting_and_repeats():
    deep = "<div>" * 3000 + f"<p>{LONG * 3}</p>" + "</div>" * 3000
    assert html.main_text(f"<body>{deep}</body>") == (LONG * 3).strip()

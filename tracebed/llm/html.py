"""Main text of HTML pages: text-to-tag ratios of lines, smoothed and clustered, select the content region.

The standard library's parser streams a page as events; a line is what stands between two block boundaries. The ratio
of each line's text to its tags is smoothed with a Gaussian and split at one standard deviation into content and the
rest. The region is the innermost element that holds all content and a heading before it; where that is no article, it
is all article elements, or the main element if it has more content, as far as these hold most of the content. Within
the region every line is kept, short ones too, as a block, but for groups of links: lists and boxes that are
links for over two thirds of their text; text of links does not count in ratios.

What HTML itself, a role or a style says is no article (menus, footers, forms, scripts, hidden parts) has no ratio and
is put aside first. Length cannot tell an advert, a notice or a reader's comment from the article; class and id do.
Their words do not count where they name a layout, nor for an element with a main element or most of the text, comments,
adverts and teasers excepted, nor at all if nothing is left.

Nulls: a null html is empty; pages without text have the empty string; null ids, null urls and repeated rows keep
their rows. Unclosed and misnested tags are closed as browsers do. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "page_id bigint, url string, text string, n_chars bigint"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption title".split())
CONTAINER = frozenset("article body center div main section table tbody td".split())
LIST = frozenset("dl menu ol ul".split())  # groups of lines, but no regions
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base bgsound link meta noscript script style template title".split())
NEVER = frozenset("applet aside audio button canvas datalist dialog embed fieldset footer form frame frameset head iframe input map menu nav noframes noscript object option script search select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
ASIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|block|space|wrap|area)\w*|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widgets?|footer|header|masthead|cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommend\w*|comments?|commentlist|disqus|respond|replies|reply|pagination|pager|search\w*|toolbar|skip|copyright|disclaimer|alert|topbar|paywall)(?=$|[\s_-])",
    re.I,
)
#: Words of layout: a wrapper that has a sidebar, say, is none.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|without|no|text|bg)[_-]\S*|\S*[_-](?:fixed|layout|wrapper|wrap|container))(?=$|\s)|(?<![^\s])\S*[_-](?:has|with|without|no)[_-]\S*", re.I)
#: What readers write, adverts and other pages' teasers are no article, however long.
OTHERS = re.compile(r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|block|space|wrap|area)\w*|advert\w*|adsense|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|reply|related|recommend\w*)(?=$|[\s_-])", re.I)
#: Elements that these start tags close.
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "option optgroup"}
CLOSED_BY = {k: frozenset(v.split()) for k, v in CLOSED_BY.items()}
SCOPE = frozenset("article body div dl html main nav ol section table ul".split())
ENDS_P = BLOCK - frozenset("caption head html body optgroup option tbody tfoot thead title tr li dd dt legend".split()) | frozenset(("li", "dd", "dt"))


def named_aside(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether class or id name an element that is put aside, and whether it is so whatever it holds."""
    names = [LAYOUT.sub(" ", v) for k, v in attrs if k in ("class", "id") and v]
    aside = tag not in ("html", "body", "article", "main") and any(ASIDE.search(v) for v in names)
    return aside, aside and any(OTHERS.search(v) for v in names)


def put_aside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is put aside by its tag, its role or its style."""
    if tag in NEVER or tag == "header" and not in_article:
        return True
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v == "true" or k == "role" and v and v.lower() in ROLES or k == "aria-modal":
            return True
        if k in ("class", "id") and v and tag == "article" and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|related|promo\w*|teaser\w*|ads?)(?=$|[\s_-])", v, re.I):
            return True
        if k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
            return True
    return False


class Lines(HTMLParser):
    """Collects the lines of a page: text, number of tags, whether it is put aside, and its containers."""

    def __init__(self, spared: frozenset[int] | None = frozenset()) -> None:
        """spared: the elements whose class and id do not count, by number; None: all."""
        super().__init__(convert_charrefs=True)
        self.spared = spared
        self.named: list[tuple[int, bool]] = []  # open elements that class or id put aside: number, whatever they hold
        self.named_seen = 0
        self.firm = 0  # open elements that are put aside otherwise
        self.holds: dict[int, int] = {}  # characters in a named element, as far as nothing firm in it puts them aside
        self.holds_main: set[int] = set()
        self.holds_article: set[int] = set()
        self.has_article = False  # or main, not put aside by anything firm
        self.loose = 0  # characters that nothing firm puts aside
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it puts aside, container or -1
        self.marks: list[tuple[bool, bool]] = []  # of open elements: whether they are named aside, and firm
        self.aside = 0
        self.articles = 0
        self.kinds: list[str] = []  # of containers
        self.inside: tuple[int, ...] = ()
        self.parts: list[str] = []
        self.put_by: list[str] = []  # text of this line that is put aside: an inline element may be, within a block
        self.tags = 0
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.headings: list[bool] = []  # of lines
        self.linked: list[int] = []  # of lines, the characters in links
        self.links: list[int] = []  # and how many links
        self.anchors = 0  # open links
        self.in_links = [0, 0]  # characters of links in this line, and in what of it is put aside
        self.seen_links = 0

    def end_line(self) -> None:
        for parts, aside in ((self.parts, False), (self.put_by, True)):
            if parts and (text := " ".join("".join(parts).split())):
                self.lines.append((text, self.tags, aside, self.inside))
                self.linked.append(self.in_links[aside])
                self.links.append(self.seen_links)
                self.seen_links = 0
                self.headings.append(any(t in HEADING for t, _, _ in self.open))
                self.tags = 0
        if self.parts or self.put_by:
            self.parts, self.put_by, self.in_links = [], [], [0, 0]

    def pop(self) -> None:
        tag, aside, container = self.open.pop()
        named, firm = self.marks.pop()
        self.aside -= aside
        self.firm -= firm
        self.anchors -= tag == "a"
        if named:
            self.named.pop()
        if container >= 0:
            self.inside = self.inside[:-1]
            self.articles -= tag == "article"

    def close_within(self, tags: frozenset[str] | set[str]) -> None:
        """Closes the innermost of these elements, if nothing that holds content of its own is open in it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "br" or tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "body" or tag not in IN_HEAD and any(t == "head" for t, _, _ in self.open[:2]):
            while self.open and self.open[-1][0] != "html" and any(t == "head" for t, _, _ in self.open):
                self.pop()
        if tag in ENDS_P:
            self.close_within({"p"})
        if tag in CLOSED_BY:
            self.close_within(CLOSED_BY[tag])
        firm = put_aside(tag, attrs, self.articles > 0)
        named, always = named_aside(tag, attrs)
        if named:
            self.named.append((self.named_seen, always))
            self.named_seen += 1
        if (tag in ("article", "main") or ("role", "main") in attrs) and not firm and not self.firm:
            self.has_article = True
            (self.holds_article if tag == "article" else self.holds_main).update(n for n, _ in self.named)
        aside = firm or named and self.spared is not None and self.named[-1][0] not in self.spared
        firm = firm or always
        self.firm += firm
        self.marks.append((named, firm))
        container = -1
        if tag in CONTAINER or tag in LIST:
            container = len(self.kinds)
            self.kinds.append("article" if tag == "article" or any(k == "itemprop" and v == "articleBody" for k, v in attrs) else "main" if tag == "main" or ("role", "main") in attrs else tag)
            self.inside = (*self.inside, container)
            self.articles += tag == "article"
        self.aside += aside
        self.anchors += tag == "a"
        self.seen_links += tag == "a"
        self.open.append((tag, aside, container))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in ("article", "body", "html", "nav", "table", "div", "section", "main", "aside", "footer", "header") and tag in ("p", "b", "i", "a", "span", "em", "strong", "li"):
                return

    def handle_data(self, data: str) -> None:
        (self.put_by if self.aside else self.parts).append(data)
        if self.anchors:
            self.in_links[self.aside > 0] += len("".join(data.split()))
        if not self.firm:
            size = len("".join(data.split()))
            self.loose += size
            for n, _ in self.named:
                self.holds[n] = self.holds.get(n, 0) + size


def smoothed(ratios: list[float], radius: int = 2, sigma: float = 1.0) -> list[float]:
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(w, ratios[i + k]) for k, w in zip(range(-radius, radius + 1), kernel, strict=True) if 0 <= i + k < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def content(lines: list[tuple[str, int, bool, tuple[int, ...]]], linked: list[int] | None = None) -> list[bool]:
    """Which lines have a smoothed ratio of text to tags above one standard deviation. linked: how much of each is links,
    which are not text here."""
    ratios = smoothed([0.0 if aside else max(0, len(text) - less) / max(1, tags) for (text, tags, aside, _), less in zip(lines, linked or [0] * len(lines), strict=True)])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= deviation and not line[2] for r, line in zip(ratios, lines, strict=True)]


def region(parser: Lines, hits: list[bool]) -> set[int] | None:
    """The containers whose lines are kept; None: all lines."""
    lines = parser.lines
    weight: dict[int, int] = {}
    total = 0
    for hit, (text, _, _, inside) in zip(hits, lines, strict=True):
        if hit:
            total += len(text)
            for c in inside:
                weight[c] = weight.get(c, 0) + len(text)
    whole = [c for c in sorted(weight) if weight[c] == total and parser.kinds[c] not in LIST]  # numbered as they open: the innermost is last
    first = hits.index(True)
    before = [line[3] for heading, line in zip(parser.headings[: first + 1], lines, strict=False) if heading and not line[2]]
    around = next((c for c in reversed(whole) if any(c in inside for inside in before)), None)
    if around is None and whole and not before:
        around = whole[-1]
    chosen = [c for c in whole if around is not None and c <= around]
    if any(parser.kinds[c] in ("article", "main") for c in chosen):
        return {around}
    held = []
    for kind in ("article", "main"):
        own = {c for c, k in enumerate(parser.kinds) if k == kind}
        held.append((sum(len(line[0]) for hit, line in zip(hits, lines, strict=True) if hit and not own.isdisjoint(line[3])), own))
    most, named = max(held, key=lambda x: x[0])  # of equals the articles
    if 2 * most > total:
        return named
    return None if around is None else {around}


def link_groups(parser: Lines) -> set[int]:
    """Containers of three links or more that make up over two thirds of the text."""
    size: dict[int, list[int]] = {}
    for linked, links, (text, _, _, inside) in zip(parser.linked, parser.links, parser.lines, strict=True):
        for c in inside:
            n = size.setdefault(c, [0, 0, 0])
            for k, v in enumerate((len("".join(text.split())), linked, links)):
                n[k] += v
    return {c for c, (all_, linked, links) in size.items() if links >= 3 and 3 * linked > 2 * all_}


def parsed(html: str, spared: frozenset[int] | None = frozenset()) -> Lines:
    parser = Lines(spared)
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser


def main_text(html: str) -> str:
    parser = parsed(html)
    most = {n for n, size in parser.holds.items() if 2 * size > parser.loose}
    spared = parser.holds_main | (most & parser.holds_article if parser.has_article else most)
    if spared:  # a wrapper, not a part of the page that is aside
        parser = parsed(html, frozenset(spared))
    if parser.named_seen and not any(not line[2] for line in parser.lines):
        parser = parsed(html, None)
    lines = parser.lines
    loose = [not line[2] for line in lines]
    if not any(loose):
        return ""
    hits = content(lines, parser.linked)
    if not any(hits):  # no line stands out
        hits = loose
    kept, gone = region(parser, hits), link_groups(parser)
    own = [(text, inside) for text, _, aside, inside in lines if not aside and (kept is None or not kept.isdisjoint(inside))]
    return "\n\n".join([text for text, inside in own if gone.isdisjoint(inside)] or [text for text, _ in own])


def extracted(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages by tree scoring.

A page is parsed into a tree, tolerant of tags left open. Blocks of text get
points for their length and commas, discounted by their link density, and pass
them to their ancestors, the less the farther. The container with the most
points, again discounted by link density, is the article; siblings that come
near it are kept too. Menus, page headers and footers, sidebars, notices,
adverts, forms and reader comments are known by tag, role, class and id, and
lists of links by their links; they neither score nor appear.

Elements nested deeper than DEPTH lie in the element at that depth. Character
references are decoded, white space within a block becomes one space,
and blocks follow each other in page order, one line feed between them. Null
and empty html give empty text; html without any markup is one block; a page cut
off in a tag loses that tag only; a very long page is parsed whole, in time that
grows with its length; of containers with equally many points the first counts;
a null page_id or url is carried along; repeated rows give equal rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select noframes xmp".split())
BLOCK = frozenset("html head body article main section div p pre blockquote ul ol li dl dt dd table caption thead tbody tfoot tr td th h1 h2 h3 h4 h5 h6 hr address figure figcaption details summary fieldset form nav header footer aside dialog menu center".split())
CONTAINER = frozenset("html body article main section div td th dd blockquote details figure center address".split())
CELL = frozenset("td th dd".split())
JUNK_TAG = frozenset("head nav footer aside form button dialog menu fieldset label input select option textarea".split())
JUNK_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
JUNK_WORD = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " newsletter subscribe subscription signup paywall sidebar sidebars aside rail widget widgets menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs crumbs masthead topbar header footer foot copyright colophon disclaimer"
    " comment comments commentlist disqus discussion replies reply respond share sharing social related recommended recommendations search login toolbar pagination pager skip".split()
)
#: Of these, words of containers that may hold more prose than the article.
REMARKS = frozenset("comment comments commentlist disqus discussion replies reply respond".split())
GOOD_WORD = frozenset("article body content entry main page post story text blog".split())
#: Elements that a start tag closes if they are open within the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that an end tag of something inside them doesn't reach past.
WALL = frozenset("html body table td th article main section div ul ol nav header footer aside form".split())
#: Most elements within each other.
DEPTH = 256
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++(?:[^\s/>=]++)?+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)[^>]*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+(?=[\s/>]|$)""", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "junk", "mark", "good", "size", "commas", "linked", "links", "points", "whole", "whole_linked", "keep")

    def __init__(self, tag: str, parent: int, junk: bool, good: bool, mark: int = 0):
        self.tag, self.parent, self.junk, self.good, self.mark = tag, parent, junk or mark > 0, good, mark
        self.size = self.commas = self.linked = self.links = self.whole = self.whole_linked = 0
        self.points, self.keep = 0.0, False


def _marks(tag: str, rest: str, inside_article: bool) -> tuple[bool, bool, int]:
    """(is junk, looks like an article) by tag and attributes; and what only class or id say: 1 junk, 2 remarks."""
    if tag in ("html", "body"):
        return False, False, 0
    mark = 0
    junk = tag in JUNK_TAG or (tag == "header" and not inside_article)
    good = tag in ("article", "main")
    if rest:
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                # the header of a post or an article is part of it
                words = [w for name in value.split() for part in (_NAME.findall(name),) for w in part if not (w == "header" and any(x in GOOD_WORD for x in part))]
                if not good or "comment" in words or "comments" in words:
                    mark = max([mark, *(1 + (w in REMARKS) for w in words if w in JUNK_WORD and not (inside_article and w == "header"))])
                good = good or any(w in GOOD_WORD for w in words)
            elif name == "role":
                junk = junk or value in JUNK_ROLE
                good = good or value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                junk = True
    return junk, good and not junk, 0 if junk else mark


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, parents first, and the page's text runs as (node, text); (-1, '') parts blocks."""
    nodes = [Node("html", -1, False, False)]
    runs: list[tuple[int, str]] = []
    stack = [0]
    articles = 0
    at, n = 0, len(html)

    def pop(to: int) -> None:
        nonlocal articles
        while len(stack) > to:
            articles -= nodes[stack.pop()].tag in ("article", "main")

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            runs.append((stack[-1], unescape(html[at:lt])))
        if lt >= n:
            break
        m = _TAG.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif lt + 1 < n and (html[lt + 1] in "!?" or html[lt + 1].isalpha() or html[lt + 1] == "/"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                runs.append((stack[-1], "<"))
                at = lt + 1
            continue
        at = m.end()
        close, tag = m[1], m[2].lower()
        if close:
            if tag in BLOCK:
                runs.append((-1, ""))
            for k in range(len(stack) - 1, 0, -1):
                here = nodes[stack[k]].tag
                if here == tag:
                    pop(k)
                    break
                if here in WALL and tag not in WALL:
                    break
            continue
        if tag == "br":
            runs.append((stack[-1], " "))
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            gt = html.find(">", end.end() - 1) if end else -1
            if tag != "textarea" or end:
                at = n if gt < 0 else gt + 1
            continue
        if tag in BLOCK:
            runs.append((-1, ""))
            # a block ends an open paragraph, with what is open in it
            for k in range(len(stack) - 1, 0, -1):
                here = nodes[stack[k]].tag
                if here == "p" or (here in HEADING and tag in HEADING):
                    pop(k)
                    break
                if here in BLOCK:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                here = nodes[stack[k]].tag
                if here in CLOSES[tag]:
                    pop(k)
                    if tag != "tr":
                        break
                elif here in SCOPE[tag]:
                    break
        if tag in VOID or tag in ("html", "body"):
            if tag == "body" and len(stack) == 1:
                nodes.append(Node("body", 0, False, False))
                stack.append(len(nodes) - 1)
            continue
        if len(stack) > DEPTH:
            continue
        junk, good, mark = _marks(tag, m[3], articles > 0)
        nodes.append(Node(tag, stack[-1], junk, good, mark))
        if not html.startswith("/>", m.end() - 2) or tag in BLOCK:
            stack.append(len(nodes) - 1)
            articles += tag in ("article", "main")
    return nodes, runs


def _unmark(nodes: list[Node], runs: list[tuple[int, str]]) -> None:
    """A container that only its class or id marks is no junk if it holds most of the page's prose."""
    hard, link, prose = [False] * len(nodes), [False] * len(nodes), [0] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        hard[i] = hard[x.parent] or (x.junk and not x.mark)
        link[i] = link[x.parent] or x.tag == "a"
    for i, text in runs:
        if i >= 0 and not hard[i] and not link[i]:
            prose[i] += len(text.strip())
    for i in range(len(nodes) - 1, 0, -1):
        prose[nodes[i].parent] += prose[i]
    for i, x in enumerate(nodes):
        if x.mark == 1 and 2 * prose[i] > prose[0]:
            x.junk = False


def _score(nodes: list[Node], runs: list[tuple[int, str]]) -> None:
    """Text, links and points of every node; junk passes nothing on."""
    block = [0] * len(nodes)
    link = [False] * len(nodes)
    for i, x in enumerate(nodes):
        if i:
            up = x.parent
            x.junk = x.junk or nodes[up].junk
            block[i] = i if x.tag in BLOCK else block[up]
            link[i] = x.tag == "a" or link[up]
            if x.tag == "a":
                nodes[block[i]].links += 1
    for i, text in runs:
        if i >= 0 and not nodes[i].junk:
            size = len(text.strip())
            b = nodes[block[i]]
            b.size += size
            b.commas += text.count(",") + text.count("،") + text.count("、") + text.count("，")
            if link[i]:
                b.linked += size
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        x.whole += x.size
        x.whole_linked += x.linked
        if i and not x.junk:
            nodes[x.parent].whole += x.whole
            nodes[x.parent].whole_linked += x.whole_linked
            nodes[x.parent].links += x.links
    # a list of links is a menu, wherever it stands, unless it is numbered as references are
    for i, x in enumerate(nodes):
        if i and not x.junk and nodes[x.parent].junk:
            x.junk = True
        elif x.tag in ("ul", "dl", "table") and x.links >= 2 and x.whole_linked > 0.8 * x.whole:
            x.junk = True
    for i, x in enumerate(nodes):
        if x.junk or not x.size:
            continue
        points = (1 + x.commas + min(x.size / 100, 3)) * (1 - x.linked / x.size)
        up, share = (i, 0) if x.tag in CONTAINER and x.tag not in CELL else (x.parent, 1)
        while up >= 0:
            nodes[up].points += points / (1 if share <= 1 else 2 if share == 2 else 3 * share)
            up, share = nodes[up].parent, max(share, 0) + 1


def _rank(x: Node) -> float:
    if x.junk or not x.whole or x.points <= 0:
        return 0.0
    prior = 25 if x.good else 5 if x.tag == "div" else 3 if x.tag in ("pre", "td", "blockquote") else -5 if x.tag in HEADING else -3 if x.tag in ("ul", "ol", "dl", "li", "address") else 0
    return max(0.01, x.points + prior) * (1 - x.whole_linked / x.whole)


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    for by_class in (True, False):
        nodes, runs = parse(html)
        marked = any(x.mark for x in nodes)
        if marked and by_class:
            _unmark(nodes, runs)
        elif marked:
            for x in nodes:
                x.junk = x.junk and not x.mark
        _score(nodes, runs)
        best = max(range(len(nodes)), key=lambda i: (_rank(nodes[i]) if nodes[i].tag in CONTAINER or nodes[i].tag in ("ul", "ol", "pre", "table", "tbody", "tr") else 0.0, -i))
        top = _rank(nodes[best])
        if top > 0 or not marked:
            break
    if top <= 0:
        return ""
    # a row is a part of its table, and a container within an article of that
    while nodes[best].tag in ("tr", "tbody", "thead", "tfoot"):
        best = nodes[best].parent
    up = nodes[best].parent
    while up >= 0:
        if nodes[up].tag in ("article", "main"):
            best, top = up, max(_rank(nodes[up]), top)
        up = nodes[up].parent
    nodes[best].keep = True
    if nodes[best].tag != "main":
        for i, x in enumerate(nodes):
            if x.parent == nodes[best].parent and i != best and not x.junk and x.whole:
                near = _rank(x) >= max(10, 0.2 * top) and (x.tag in CONTAINER) and (x.good or not nodes[best].good)
                prose = x.tag in ("p", "pre", "blockquote") and (x.whole > 80 and x.whole_linked < 0.25 * x.whole or x.whole <= 80 and not x.whole_linked)
                x.keep = near or prose or x.tag in HEADING
    for x in nodes[1:]:
        x.keep = not x.junk and (x.keep or nodes[x.parent].keep)
    out, now = [], []

    def end() -> None:
        if now:
            if text := " ".join("".join(now).split()):
                out.append(text)
            now.clear()

    for i, text in runs:
        if i < 0:
            end()
        elif nodes[i].keep:
            now.append(text)
    end()
    return "\n".join(out)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = batch.slice(lo, 256)
            texts = [extract(x.as_py()) for x in rows.column("html")]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=_OUT)


def query(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")

import time

import pytest

from gridloom.llm.html_extract import extract, query

BODY = "<p>First paragraph, with commas, and enough words to count as text, surely.</p><p>Second <a href='x'>linked</a> one,\n with   space &amp; &eacute;&nbsp;&lt;b&gt;.</p>"
TEXT = "First paragraph, with commas, and enough words to count as text, surely.\nSecond linked one, with space & é <b>."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav><article>{BODY}</article><footer>c, d, e</footer></body></html>",
        f"<body><header><h1>Site, the, best</h1></header><div id=content>{BODY}</div><aside>Aside, a, b, c, d, e, f, g, h, i, j, k</aside></body>",
        f"<body><div class='cookie-notice'>We, use, cookies, a, lot, of, them, really, we, do.</div><main>{BODY}<div class=advert>Buy, now, now, now</div><form><p>Mail, please, now</p></form></main></body>",
        f"<body><div class=story>{BODY}</div><div id=comments><p>I, for, one, do, not, agree, with, any, of, this, at, all, never, ever, ever.</p></div></body>",
        f"<article>{BODY}<section class='reader-comments'><article class='comment'><p>So, what, now, then, eh?</p></article></section></article>",
        f"<body><script>var a = '<p>x, y, z</p>';</script><style>p {{}}</style><!-- <p>gone</p> --><div>{BODY}</div><div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div></body>",
        f"<body><div role=navigation><p>Go, here, there, and, everywhere</p></div><div>{BODY}</div><div style='display: none'><p>hidden, hidden, hidden</p></div></body>",
        f"<BODY><ARTICLE>{BODY}</ARTICLE><p hidden>no</p>",
    ],
)
def test_article_alone(page):
    assert extract(page) == TEXT


@pytest.mark.parametrize("name", ["content with-sidebar", "layout-sidebar-right", "page has-cookie-banner", "social-theme"])
def test_marked_wrapper(name):
    ad = "<div class=ad>Buy, now, now</div>"
    assert extract(f"<body><div class='{name}'>{ad}{BODY}</div></body>") == TEXT
    assert extract(f"<body><nav><a href=a>Home</a></nav><div id='{name}'><div class='{name}'>{BODY}{ad}</div></div><footer>c, d</footer></body>") == TEXT
    assert extract(f"<body><h1>T</h1><div class='{name}'><article>{BODY}</article>{ad}</div></body>") == TEXT


def test_only_marked_parts():
    assert extract("<div class=banner><p>One, two, three.</p></div><div class=comments><p>Four, five, six, seven.</p></div>") != ""
    long = "<p>I, for one, do not agree with any of it, never, ever.</p>" * 12
    assert extract(f"<body><div class=story>{BODY}</div><div id=comments>{long}</div></body>") == TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>open <b>bold<p>next<br>line", "open bold\nnext line"),
        ("<div><p>a, b</p><im", "a, b"),
        ("<article><h1>Title &am</h1><p>T &amp u&#33;</p></article>", "Title &am\nT & u!"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<article><p>x</p><p> \n </p><ul><li>one<li>two</ul></article>", "x\none\ntwo"),
        ("<nav><a href=x>only</a></nav>", ""),
        ("</p></div><p title=\"a>b\" data-x='<p>'>kept</p>", "kept"),
    ],
)
def test_odd_pages(page, text):
    assert extract(page) == text


def test_no_blow_up():
    start = time.process_time()
    for page in ("<" * 20_000, "<a " * 20_000, "<a b='" * 5_000, "<!--" * 5_000, "<script>" * 2_000, "<div>" * 3_000 + "x", "&" * 50_000, "<p>a" * 5_000, "<x y=\"" + "z" * 200_000):
        extract(page)
    assert time.process_time() - start < 20


def test_query(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", 5), (1, "u", f"<article>{BODY}</article>", 5), (None, None, None, 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = query(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT))]
    assert query(df.limit(0)).count() == 0


def test_parts_of_the_article():
    """A post's own header, formulas, objects' text and numbered references are part of the article."""
    page = f"<body><div class=post><div class=post-header><h1>The title</h1></div><div class=content>{BODY}<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <object>as shown</object>, here.</p><ol><li><a href=a>Ref one</a></li><li><a href=b>Ref two</a></li></ol></div></div></body>"
    assert extract(page) == f"The title\n{TEXT}\nSo x=2 holds, as shown, here.\nRef one\nRef two"
    menu = f"<body><div class=content>{BODY}<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div></body>"
    assert extract(menu) == TEXT


@pytest.mark.parametrize("piece", ["<b>x", "<div>x", "</i>", "<td><b>", "<p><a href=x>y", "<ul><li>z", "<!--", "<", "&amp", "<x "])
def test_time_grows_with_length(piece):
    def took(n):
        start = time.perf_counter()
        extract("<i><table><td>" + piece * n)
        return time.perf_counter() - start

    took(100)
    assert took(40_000) < 30 * max(took(4_000), 0.01)


def test_deep_nesting_keeps_text():
    n = 3000
    assert extract("<div>" * n + BODY + "</div>" * n) == TEXT

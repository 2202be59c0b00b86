"""Main text of pages."""

import time

import pytest

from logfold.llm import html_text

LONG = "This is a long sentence about nothing much that goes on and on until it ends. " * 3


def clean(s):
    return " ".join(s.split())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("just text &amp; more", "just text & more"),
        (f"<html><head><title>t</title><style>p{{}}</style><script>var t='</p>'</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav><!-- ad --><div class='ad'>Buy {LONG}</div><article><h1>Head</h1><p><b>One {LONG}<br><p>Two&nbsp;&#233;</p><p>3</p></article><footer>&copy; {LONG}</footer>", f"Head\n\n{clean('One ' + LONG)}\n\nTwo é\n\n3"),
        (f"<body><div id=sidebar><p>{LONG}</p></div><main><p>{LONG}</p><form><p>{LONG}</p></form><section class='comments'><p>{LONG}</p></section></main></body>", clean(LONG)),
        (f"<div class=siteHeader><p>{LONG}</p></div><article><header class=header><h1>T</h1></header><p>{LONG}</p><div class=\"cookie-notice\"><p>{LONG}</p></div></article>", f"T\n\n{clean(LONG)}"),
        (f"<div><a href=1>Home</a> <a href=2>News</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>(c) 2020</div>", f"{clean(LONG)}\n\nShort.\n\n{clean(LONG)}"),
    ],
)
def test_extract(html, text):
    assert html_text.extract(html) == text


def test_long_pages_take_linear_time():
    assert len(html_text.extract("<article>" + f"<p>{LONG}" * 20_000)) > 4_000_000
    html_text.extract("<article>" + "<b><i>" * 50_000 + "x" + "</i></b>" * 50_000)


@pytest.mark.parametrize("html", ["<div><p>" * 40_000 + "x", "<div>" * 2 + "</p></span></b></section>" * 40_000 + "x", "<div class=sidebar>" * 8_000 + f"<p>{LONG}", "<ul><li>" * 20_000 + "x", "<article>" * 20_000 + "x<p>y"])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    html_text.extract(html)
    assert time.process_time() - began < 5


def test_names_that_only_hold_a_word_stay():
    html = f"<article><p>{LONG}</p><p class='share-prices'>Shares fell.</p><p id='comment-on-budget'>No comment.</p><p class=ad-hoc>So.</p></article>"
    assert html_text.extract(html) == f"{clean(LONG)}\n\nShares fell.\n\nNo comment.\n\nSo."


LINKS = "".join(f"<li><a href={k}>Some other page {k}</a></li>" for k in range(6))
MENUS = [
    (f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><p>{LONG}</p><ul>{LINKS}</ul></article>", f"Title\n\n{clean(LONG)}\n\n{clean(LONG)}"),
    (f"<div><div>{LINKS.replace('li', 'p')}</div><div><p>{LONG}</p><p>{LONG}</p><ul><li>One point</li><li>Two <a href=x>points</a></li><li>Three</li></ul></div></div>", f"{clean(LONG)}\n\n{clean(LONG)}\n\nOne point\n\nTwo points\n\nThree"),
    (f"<div><p>Top of the page</p></div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>All rights kept</p></div>", f"{clean(LONG)}\n\n{clean(LONG)}"),
]


def test_ratios_tell_menus_and_remarks_from_text(monkeypatch):
    for html, text in MENUS:
        assert html_text.extract(html) == text
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios * 0 + 1)  # without ratios they stay
    assert sum(html_text.extract(html) == text for html, text in MENUS) < 2


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>a", "x"), (2, None, "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract_pages(pages).fillna("-").collect())) == [(1, "u", "", 0), (2, "-", "a", 1), (2, "-", "a", 1)]


@pytest.mark.parametrize("wrap", ["div id='page' class='has-sidebar'", "div class='content no-sidebar'", "div class='with-nav'", "div class='ad-free'", "div class='social-science'", "section id=related-work", "form action=x", "div class='layout sidebar'", "div class='page-banner'"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_keep_the_main_text(wrap, inner):
    html = f"<body><nav>menu</nav><{wrap}><{inner}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></{inner}><div class='cookie-notice'><p>{LONG}</p></div><div class='comment-list'><p>{LONG}</p></div></{wrap.split()[0]}></body>"
    assert html_text.extract(html) == f"Head\n\n{clean(LONG)}\n\n{clean(LONG)}"


def test_named_parts_beside_the_article_stay_out():
    for name in ("related-posts", "siteHeader", "sidebar", "ad-slot", "main-nav", "share-buttons"):
        html = f"<div class='{name}'><article><p>{LONG}</p></article></div><article><p>{LONG}</p><p>Says <span class=share>Share</span> it.</p></article>"
        assert html_text.extract(html) == f"{clean(LONG)}\n\nSays it."


def test_wrappers_in_wrappers():
    html = f"<div class=sidebar><p>Bar</p><div class=banner><article><p>{LONG}</p></article></div></div>"
    assert clean(LONG) in html_text.extract(html)
    assert html_text.extract("<div class=ad><a href=x>Only link</a></div><div class=menu></div>") == ""

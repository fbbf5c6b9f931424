"""Main text of pages: the minimum cut against all labellings, and hand-made pages of several layouts."""

import itertools
import random

import pytest

from corpusmill.llm import html_extraction, page_blocks


def cost(preference, edges, content):
    """What a labelling costs: preferences gone against, and edges cut."""
    against = sum(abs(p) for v, p in enumerate(preference) if (p > 0) != (v in content) and p)
    return against + sum(w for v, near in edges.items() for u, w in near.items() if v < u and (v in content) != (u in content))


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 9)
        preference = [rng.randint(-6, 6) for _ in range(n)]
        edges = {v: {} for v in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                edges[a][b] = edges[b][a] = rng.randint(1, 5)
        found = html_extraction.cut(preference, edges)
        labellings = [set(x) for k in range(n + 1) for x in itertools.combinations(range(n), k)]
        least = min(cost(preference, edges, x) for x in labellings)
        assert cost(preference, edges, found) == least
        assert all(found <= x for x in labellings if cost(preference, edges, x) == least)


def test_long_undecided_chain():
    """Many blocks that none can decide alone are left to maximum flow."""
    n = 3000
    preference = [5 if i % 7 == 0 else -1 for i in range(n)]
    edges = {i: {j: 20 for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)}
    assert html_extraction.cut(preference, edges) in (set(), set(range(n)))
    assert len(html_extraction.cut([-p for p in preference], edges)) == n


WORDS = "This long sentence tells the reader what the article is about, and it goes on for a while. "
PAGES = {
    "article": (
        f"<html><head><title>T &amp; x</title><style>p{{}}</style><script>if (a < b) document.write('</p>')</script></head><body><header><a href=/>Site name</a></header><nav><ul><li><a href=/a>One</a></li></ul></nav>"
        f"<div class='cookie-notice'><p>{WORDS}</p></div><article><h1>The  head&shy;line</h1><p>{WORDS}&lt;b&gt; &amp; more</p><div class=ad><p>{WORDS}</p></div><p>Short.</p><ul><li>first</li><li>second <b>bo</b>ld</li></ul>"
        f"<table><tr><td>a</td><td>b</td></tr><tr><th>c<td>d</table><p>one<br>two\n\n three</p></article><aside>{WORDS}</aside><section id=comments><article><p>{WORDS * 3}</p></article></section>"
        f"<form><p>{WORDS}</p><button>Send</button></form><footer>&copy; me</footer></body></html>",
        f"The head\xadline\n{WORDS}<b> & more\nShort.\nfirst\nsecond bold\na b\nc d\none two three",
    ),
    "divs": (
        f"<body class='page with-sidebar'><div id=topnav><a href=1>Home</a> <a href=2>News</a></div><div class='layout sidebar-left'><div class=sidebar><p>{WORDS}</p></div><div id=content><h2>Title of it</h2><p>{WORDS}<p>{WORDS * 2}"
        f"<blockquote>Quoted words of someone.</blockquote></div></div><div class=comments><p>{WORDS}</div><div class=copyright>Copyright 2020, all rights reserved</div>",
        f"Title of it\n{WORDS.strip()}\n{(WORDS * 2).strip()}\nQuoted words of someone.",
    ),
    "form around all": (f"<form id=aspnet><div role=navigation><a href=x>x</a></div><main><p>{WORDS}</p><p>Yes.</p></main></form>", f"{WORDS.strip()}\nYes."),
    "plain": (f"{WORDS}<p>{WORDS}", f"{WORDS.strip()}\n{WORDS.strip()}"),
    "broken": (f"<article><p>{WORDS}</b></div><a href=\"x>y</a><p>1 < 2 &am &amp and <</p></article", f"{WORDS} y\n1 < 2 &am & and <"),
    "links": ("<ul>" + "<li><a href=x>Some link</a></li>" * 30 + "</ul>", ""),
    "empty": ("", ""),
    "null": (None, ""),
    "markup": ("<!-- <p>no</p> --><!DOCTYPE html><br><p> </p>", ""),
    "open script": (f"<article><p>{WORDS}</p><script>var x = '<p>{WORDS}</p>'", WORDS.strip()),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, expected = PAGES[name]
    assert html_extraction.main_text(page) == "\n".join(" ".join(x.split()) for x in expected.split("\n"))


def test_long_and_deep_pages_are_whole():
    page = "<div>" * 3000 + "<article>" + f"<p>{WORDS}</p>" * 5000 + "</article>" + "</div>" * 3000
    assert html_extraction.main_text(page).count("\n") == 4999
    nodes, blocks = page_blocks.parse("<p" * 20_000 + "\"'<" * 20_000)
    assert len(nodes) >= 1 and len(blocks) >= 0


def test_rows(spark):
    rows = [(1, "u", PAGES["plain"][0], "x"), (1, "u", PAGES["plain"][0], "x"), (None, None, None, None), (2, "", "<p>ü😀 and other words of this page.</p>", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = sorted((tuple(r) for r in html_extraction.html_extraction(pages).collect()), key=str)
    text = PAGES["plain"][1]
    assert found == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "", "ü😀 and other words of this page.", 32)], key=str)
    assert html_extraction.html_extraction(pages.limit(0)).count() == 0

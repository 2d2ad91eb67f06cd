"""Operator 12: minimum cuts by enumeration, layouts written by hand, and the given pages."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from metricslake.llm import article
from metricslake.llm.common import prepare
from metricslake.llm.registry import op12_article

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox jumps over the lazy dog, and then it runs home again. Nobody knows why, but it does so every day."


def value(unary, pairs, side):
    cut = sum(max(u, 0) for u, s in zip(unary, side) if not s) + sum(max(-u, 0) for u, s in zip(unary, side) if s)
    return cut + sum(c for a, b, c in pairs if side[a] != side[b])


def test_min_cut_by_enumeration():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        unary = [rng.choice([rng.uniform(-4, 4), rng.randrange(-3, 4), 0]) for _ in range(n)]
        pairs = [(a, b, rng.choice([0.5, 1.0, 2.0, rng.uniform(0, 3)])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]
        found = article.min_cut(unary, pairs)
        best = min(value(unary, pairs, s) for s in itertools.product([False, True], repeat=n))
        assert value(unary, pairs, found) == pytest.approx(best, abs=1e-9)


def test_min_cut_of_a_long_chain():
    unary = [1.0] + [-0.001 if k % 2 else 0.001 for k in range(3000)] + [-1.0]
    assert len(set(article.min_cut(unary, [(k, k + 1, 2.0) for k in range(3001)]))) >= 1


PAGES = {
    "article": (
        "<html><head><title>x</title></head><body><nav><ul><li><a href='/'>Home</a><li><a href='/b'>About us</a></ul></nav>"
        f"<article><header><h1>A title</h1><p class=by>{LONG}</p></header><p>{LONG}<p>Short.<p>{LONG}</article><footer>&copy; site, all rights reserved.</footer>",
        ["A title", LONG, "Short.", LONG],
    ),
    "divs": (
        f'<body><div class="topnav"><a href=/>Home</a> <a href=/n>News</a></div><div id="content"><h1>A&nbsp;title</h1><div>{LONG}</div><div>Oh.</div>'
        f'<div>{LONG}</div></div><div class="right-sidebar"><p>{LONG}</p></div><div id="comments"><h3>Comments</h3><div class="content"><p>{LONG}</p></div></div></body>',
        ["A title", LONG, "Oh.", LONG],
    ),
    "bare": (
        f"<body><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></div><div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div>"
        "<div><a href=/1>One</a> <a href=/2>Two</a></div></body>",
        [LONG, "Yes.", LONG],
    ),
    "form around all": (
        f"<form id=aspnet><div class=header>Site name</div><main><h1>T</h1><p>{LONG}</p></main><form><label>Mail <input></label><button>Send</button></form></form>",
        ["T", LONG],
    ),
    "layout table": (
        f"<table><tr><td class=menu><a href=/>Home</a></td><td class=content><h1>T</h1><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c<td>d</table></td></tr></table>",
        ["T", LONG, "a b", "c d"],
    ),
    "references and odd marks": (
        f"<article><p>1 < 2 &amp;&amp; 3 &gt; 2 &#x4e2d;&hellip; a<b>b</b>c <![CDATA[x]]><!-- <p>no</p> --><br>next\n\t line {LONG}<script>var x = '</p>';</script>"
        f"<style>p{{}}</style><p>{LONG} <a href=\"x>y\">link</a> end",
        [f"1 < 2 && 3 > 2 中… abc next line {LONG}", f"{LONG} link end"],
    ),
    "unseen": (f"<article><p>{LONG}</p><p hidden>{LONG}</p><div style='display: none'>{LONG}</div><p aria-hidden=true>x</p><svg><text>x</text></svg></article>", [LONG]),
    "notices": (
        f"<body class='with-sidebar'><div class='cookieConsent'><p>{LONG}</p></div><div role=banner>{LONG}</div><article><p>{LONG}</p><div class='ad-slot'>{LONG}</div>"
        f"<p>{LONG}</p><aside>{LONG}</aside></article><div class=newsletter-box>{LONG}</div></body>",
        [LONG, LONG],
    ),
    "links only": ("<nav><a href=/>Home</a></nav><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>", []),
    "empty": ("", []),
    "none": (None, []),
    "cut off": (f"<article><p>{LONG}</p><p class='x", [LONG]),
    "open script": (f"<article><p>{LONG}</p><script>{LONG}", [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    page, expected = PAGES[name]
    assert article.main_text(page).split("\n") == (expected or [""])


def test_long_page():
    """Many blocks without any markup that decides, and many broken tags."""
    page = "".join(f"<div><p>{LONG}</p><p>{k}</p></div>" for k in range(4000))
    assert article.main_text(page).count(LONG) == 4000
    article.main_text("<a b='" * 20000 + "<" * 50000)
    article.main_text("<div>" * 3000 + LONG)


def of_article(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = (html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))) for p in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(p for p in (" ".join(p.split()) for p in parts) if p)


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: r for r in op12_article(spark, SF).collect()}
    assert len(found) == len(pages)
    for p in pages:
        r = found[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, of_article(p.html), len(of_article(p.html)))


def test_without_markup_that_decides(spark):
    """Weights trained on the given pages find the text when all parts of a page are plain divs."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = article.fit(prepare(spark) and pages)
    right = total = 0
    for p in pages.collect():
        text = of_article(p.html)
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p.html).replace(' class="ad"', "")
        got = set(article.main_text(bare, weights).split("\n"))
        for line in text.split("\n"):
            right, total = right + (line in got), total + 1
    assert right / total > 0.97


def test_train_keeps_its_prior():
    assert (article.train(np.zeros((0, 7)), np.zeros(0, bool)) == article.PRIOR).all()
    assert (article.train(np.ones((3, 7)), np.ones(3, bool)) == article.PRIOR).all()


def test_frames(spark):
    prepare(spark)
    rows = [(1, "u", PAGES["article"][0], "t"), (1, "u", PAGES["article"][0], "t"), (None, None, None, None), (3, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((r.page_id or 0, r.url or "", r.text.count("\n"), r.n_chars) for r in article.extract(pages).collect())
    assert [f[:3] for f in found] == [(0, "", 0), (1, "u", 3), (1, "u", 3), (3, "v", 0)]
    assert article.extract(pages.limit(0)).collect() == []

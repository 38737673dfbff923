"""Main text of pages: held-out layouts, the dealt pages against their own article, odd html."""

import html as html_entities
import re

import pytest

from quireflow.llm import main_text, queries
from quireflow.llm.labelled_pages import LABELLED, MARK

LONG = "Some words of the story go on and on until the line is full. " * 4


def blocks(*names):
    return "\n\n".join(names)


HELD_OUT = {
    "class names of its own": (
        f"<html><body class='has-sidebar'><div class='x1'><a href=1>Home</a><a>News</a></div><div class='k9'><h1>Head of it</h1><p>{LONG}</p><p>Short.</p></div><div class='x4'><a>Imprint</a></div>",
        blocks("Head of it", LONG.strip(), "Short.")),
    "foreign parts inside": (
        f"<article><h1>Title</h1><p>{LONG}</p><div class='ad-box'>Buy this now, it is cheap.</div><form><p>Subscribe to all of our letters.</p></form><p>End &amp; out.</p>"
        f"<section id='userComments'><p>{LONG}</p></section><aside><p>Aside of some words.</p></aside></article><footer>Firm</footer>",
        blocks("Title", LONG.strip(), "End & out.")),
    "links inside of a paragraph": ("<main><h1>T</h1><p>See <a href=x>the other page</a> for more,<b>b</b>old<br>end.</p></main><nav><a>x</a></nav>", blocks("T", "See the other page for more,bold end.")),
    "one form around everything": (f"<form id=f><div class='content'><h1>T</h1><p>{LONG}</p></div><div class='search'><label>Search</label></div></form>", blocks("T", LONG.strip())),
    "page header and article header": (f"<header><h1>Site</h1><p>We welcome you here.</p></header><main><article><header><h1>T</h1></header><p>{LONG}</p></article></main>", blocks("T", LONG.strip())),
    "notices": (f"<div id='cookieConsent'><p>{LONG}</p></div><div class='story'><p>{LONG}x</p></div><div class='disclaimer'><p>{LONG}</p></div>", LONG + "x"),
    "hidden": (f"<article><p>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}</p><script>if (a < b) c('</p>')</script><style>p{{}}</style></article>", LONG.strip()),
    "broken": (f"<article><p title='it>s'>{LONG}<p>a < b &am<p><b>open<p>end &lt;p&gt;<!-- never closed <p>gone", blocks(LONG.strip(), "a < b &am", "open", "end <p>")),
    "plain": ("just   a few\nwords", "just a few words"),
    "menus only": ("<nav><a>x</a></nav><div class='menu'><a>y</a> <a>z</a></div>", ""),
}


@pytest.mark.parametrize("name", HELD_OUT)
def test_layouts_that_were_not_learned(name):
    page, want = HELD_OUT[name]
    assert main_text.own_model().extract(page) == want


def test_labelled_pages_left_out_of_learning():
    """Most words of a labelled page are told apart by the others."""
    wrong = right = 0
    for i, page in enumerate(LABELLED):
        parsed = main_text.parse(page)
        marked = [False] * len(parsed.tags)
        for e in range(1, len(parsed.tags)):
            marked[e] = marked[parsed.parents[e]] or MARK in parsed.attributes[e]
        want = sum(len(t.split()) for b in parsed.blocks for e, t in b if marked[e])
        wrong += abs(len(main_text.Model(LABELLED[:i] + LABELLED[i + 1 :]).extract(page).split()) - want)
        right += want
    assert wrong <= 0.1 * right


def test_region_is_contiguous_and_best():
    """Without the scan both paragraphs would stay; the greater sum wins across a costly gap."""
    gap = "<div class='menu'>" + "<div><a>entry of a menu that is long</a></div>" * 30 + "</div>"
    page = f"<div><p>Left part of a page, one line.</p></div>{gap}<div><p>{LONG}</p></div>"
    assert main_text.own_model().extract(page) == LONG.strip()


def test_dealt_pages(spark):
    for row in queries.QUERIES["op12_main_text"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search("<article>(.*?)</article>", row.html, re.S).group(1)
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", article).replace("<br>", " "))
        want = "\n\n".join(t for p in parts if (t := " ".join(html_entities.unescape(p).split())))
        assert row.text == want and row.n_chars == len(want)


def test_odd_rows(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>é&nbsp;x.</p>", 5), (None, "u", "<p>é&nbsp;x.</p>", 5), (3, "u", "<article>" + "<p>w w w.</p>" * 50_000 + "</article>", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text[:6], r.n_chars) for r in main_text.main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "é x.", 4), (None, "u", "é x.", 4), (3, "u", "w w w.", 50_000 * 8 - 2)], key=str)
    assert main_text.main_text(pages.where("false")).count() == 0

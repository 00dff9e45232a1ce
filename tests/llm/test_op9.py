from __future__ import annotations

import random
import re
import time

import pytest

from graftwood.llm.html_text import Block, _nearest, extract, main_text

LONG = "This is the story of a house that was built by the river and it has been there for more than a hundred years."
TEXT = "And so the people of the town said that they would not have it in any other way than this, for all the rest."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html,want",
    [
        (page(f"<nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>{LONG}</p><p>Short one.</p></article><footer>&copy; x</footer>"), f"Head {LONG} Short one."),
        (page(f"<div class='sidebar'><p>{TEXT}</p></div><main><p>{LONG}</p></main>"), LONG),
        (page(f"<article><p>{LONG}</p><div class='ad'>{TEXT}</div><p>{TEXT}</p></article><section id='comments'><p>{TEXT}</p></section>"), f"{LONG} {TEXT}"),
        (page(f"<div id='cookie-notice'>{TEXT}</div><p>{LONG}</p>"), LONG),
        (page(f"<article><p>A &amp; B &lt;c&gt; &eacute;&#233;&#xE9;&nbsp;x  \n y. {LONG}</p></article>"), f"A & B <c> ééé x y. {LONG}"),
        (page(f"<article><p>{LONG}<br>next<br/>line <b>bo</b>ld</p></article>"), f"{LONG} next line bold"),
        (page(f"<article><p>{LONG}<p>{TEXT}</article>"), f"{LONG} {TEXT}"),
        (page(f"<script>var s='</p><article>';</script><!-- <p>{TEXT}</p> --><style>p{{}}</style><article><p>{LONG}</p><form><p>{TEXT}</p></form></article>"), LONG),
        (page(f"<article><header><h1>Own head</h1></header><p>{LONG}</p></article><header><p>{TEXT}</p></header>"), f"Own head {LONG}"),
        (page(f"<ul><li><a href='1'>One link</a></li><li><a href='2'>Two link</a></li></ul><p>{LONG}</p>"), LONG),
        (f"<article><p>{LONG}", LONG),
        (f"<p>{LONG}</p><p hidden>{TEXT}</p><p style='display: none'>{TEXT}</p>", LONG),
        ("", ""),
        ("plain text without a tag", "plain text without a tag"),
        ("<nav>Menu</nav>", ""),
        (None, ""),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize(
    "html,want",
    [
        # stray quotes are no text
        (page(f"<article><p class="+'"'+f"x>{LONG}</p><p class='y'>{TEXT}</p></article>"), f"{LONG} {TEXT}"),
        (page(f"<article><p><img alt=it's src=x>{LONG}</p><p title=\"it's > all\">{TEXT}</p></article>"), f"{LONG} {TEXT}"),
        (page(f"<article><p class='>{LONG}</p></article>"), LONG),
        # implied ends
        (page(f"<article><ul><li class='ad'>x<li>{LONG}</ul><p>{TEXT}</p></article>"), f"{LONG} {TEXT}"),
        (page(f"<article><dl><dt class='ad'>x<dd>{LONG}</dl><table><tr><td class='ad'>y<td>{TEXT}<tr><td>{LONG}</table></article>"), f"{LONG} {TEXT} {LONG}"),
        (page(f"<article><ul><li class='ad'><ul><li>{TEXT}</ul>{TEXT}</ul><p>{LONG}</p></article>"), LONG),
        (f"<head><title>T</title><p>{LONG}</p>", LONG),
        # names that say nothing of the element, and layouts around the article
        (page(f"<article><div class='side-by-side'><p>{LONG}</p></div><div class='legal'>{TEXT}</div></article>"), f"{LONG} {TEXT}"),
        (page(f"<div class='content has-sidebar'><article><p>{LONG}</p></article></div>"), LONG),
        (page(f"<div class='site no-sidebar'><p>{LONG}</p></div>"), LONG),
        (page(f"<div class='site sidebar-left'><article><p>{LONG}</p></article><div class='sidebar'><p>{TEXT}</p></div></div>"), LONG),
        (page(f"<form id='aspnetForm'><div><p>{LONG}</p><p>{TEXT}</p></div></form>"), f"{LONG} {TEXT}"),
        (page(f"<article><div class='entry-header'><h1>Own head</h1></div><p>{LONG}</p><h2 id='related-work'>More</h2><p>{TEXT}</p></article>"), f"Own head {LONG} More {TEXT}"),
        (page(f"<div class='post comments-open'><p>{LONG}</p></div><div class='entry comment-status-closed cookies-accepted'><p>{TEXT}</p></div>"), f"{LONG} {TEXT}"),
        # a paragraph that is mostly a link
        (page(f"<article><p>{LONG}</p><p>See: <a href='x'>{TEXT}</a></p></article>"), f"{LONG} See: {TEXT}"),
        # reader comments by the stem of their name
        (page(f"<article><p>{LONG}</p><ol class='commentlist'><li>{TEXT}</li></ol></article><div class='userComments'><p>{TEXT}</p></div><div id='post-comments'><article><p>{TEXT}</p></article></div>"), LONG),
        (page(f"<article><p>{LONG}</p><div class='related-posts'><p>{TEXT}</p></div><div class='google-ad-slot'>{TEXT}</div><div class='share'>Tell {TEXT}</div></article><aside><p>{TEXT}</p></aside>"), LONG),
        # text between the article and the end of the page
        (page(f"<article><p>{LONG}</p><p>{TEXT}</p></article><div><p>{TEXT}</p></div>"), f"{LONG} {TEXT}"),
        # dropped words inside a block don't cut it
        (page(f"<article><p>foo<span hidden>x</span>bar {LONG}</p></article>"), f"foobar {LONG}"),
        (page(f"<div role='main'><p>{LONG}</p><p>{TEXT}</p></div><div><p>{TEXT}</p></div>"), f"{LONG} {TEXT}"),
    ],
)
def test_what_stays_and_what_goes(html, want):
    assert main_text(html) == want


def test_low_density_blocks_inherit():
    """A long block without stop words is no prose by itself: inside an article it follows its neighbours."""
    odd = "Zx qv " * 20
    assert main_text(page(f"<article><p>{LONG}</p><p>{odd}</p><p>{TEXT}</p></article>")) == f"{LONG} {odd.strip()} {TEXT}"
    assert main_text(page(f"<p>{LONG}</p><p>{odd}</p>")) == LONG


def test_inheritance_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        found = [Block("x", 0, "p", rng.randrange(3), 0, -1, 0) for _ in range(rng.randrange(1, 12))]
        first = [rng.choice(["", "", "good", "bad"]) for _ in found]
        for step in (1, -1):
            got = _nearest(found, first, step)
            for k, b in enumerate(found):
                own = [j for j, c in enumerate(found) if c.article == b.article and first[j] and (j < k if step == 1 else j > k)]
                assert got[k] == ((max(own) if step == 1 else min(own)) if own else -1)


def test_nothing_is_capped():
    many = [f"{k} {LONG}" for k in range(3000)]
    assert main_text(page("<article>" + "".join(f"<p>{x}</p>" for x in many) + "</article>")) == " ".join(many)


@pytest.mark.parametrize("bad", ["<" * 100_000, "<a " * 60_000, "<a '" * 60_000 + "'", "<div>" * 30_000, "<a b=\"" + "x" * 200_000, "&#x;" * 50_000, "<!--" * 50_000, "</p>" * 60_000, "<p>a</p>" * 130_000, "<div></b>a" * 100_000, "<p>" + LONG + "</p>" + "<p>a</p>" * 130_000, "<article>" + f"<p>{LONG}</p>" * 70 + "<p>a</p>" * 130_000 + "</article>", "<li>a" * 200_000, "<ul><li>a" * 100_000, "<table><tr><td>a" * 60_000, "<b><p>a" * 140_000, "<a href=x>a" * 90_000, "<p class=\"x>a" * 70_000, "<p class='x>a</p>" * 60_000, "<p a=\"b\"c>x" * 80_000, "</b></div>" * 100_000, "<script>" * 120_000, "<title>a</titl" * 70_000])
def test_broken_markup_ends_soon(bad):
    start = time.time()
    main_text(bad)
    assert time.time() - start < 6  # about a second a megabyte on a free machine


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    import html as entities

    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)))).strip() for x in re.split(r"</?(?:h1|p|div)[^>]*>", inner)]
        assert r["text"] == " ".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (None, "u", f"<p>{LONG}</p>", "c"), (2, "u", "", "c"), (2, "u", "", "c"), (3, "u", f"<p>{LONG * 3000}</p>", "c")], "page_id long, url string, html string, text string")
    rows = sorted(((r["page_id"] or 0, r["url"], r["n_chars"]) for r in extract(pages).collect()), key=repr)
    assert rows == sorted([(1, None, 0), (0, "u", len(LONG)), (2, "u", 0), (2, "u", 0), (3, "u", len(LONG) * 3000)], key=repr)
    assert extract(pages.limit(0)).count() == 0

"""Slots, containers and nesting of operator 6."""

from __future__ import annotations

import pytest

from tessera.llm.html import extract_text

LONG = "a sentence of the article that goes on for a while"


def texts(spark, pages, one_host=True):
    rows = [(k, f"http://h{0 if one_host else k}.example/{k}", html) for k, html in enumerate(pages)]
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_decides_on_pages_with_a_small_container(spark):
    page = "<body><div class=top><p>Welcome to this site of ours</p></div><div class=post-meta>By {k}</div><div class=x><p>{k} {text}</p><p>{k} more, {text}</p></div><div><p>Made by us for all of you</p></div>"
    got = texts(spark, [page.format(k=k, text=LONG) for k in range(5)])
    for k in range(5):
        assert got[k] == f"By {k}\n{k} {LONG}\n{k} more, {LONG}"


def test_containers_that_are_not_the_article(spark):
    story = f"<div class=x><p>{LONG}</p><p>And {LONG}</p></div>"
    want = f"{LONG}\nAnd {LONG}"
    pages = [f"<body>{story}<aside><article><p>Teaser</p></article></aside>", f"<body><div class=entry-title>Title</div>{story}", f"<body><article></article>{story}", f"<body><article>{story}</article><div><p>Other</p></div>"]
    assert texts(spark, pages, one_host=False) == {0: want, 1: f"Title\n{want}", 2: want, 3: want}


def test_linked_paragraph_of_an_article_stays(spark):
    linked = f"<p>{LONG}</p><p><a href=/a>A paragraph that is all link</a></p><p>End: {LONG}</p>"
    links = "<ul><li><a href=/b>One other page</a><li><a href=/c>Yet another page</a></ul>"
    assert texts(spark, [f"<body><div class=x>{linked}</div>{links}"]) == {0: f"{LONG}\nA paragraph that is all link\nEnd: {LONG}"}


PAGE = "<html><body{b}><nav><a href=/>Home</a></nav><div class={ad}>Buy {k} now</div><{art}{cls}><h1>Title {k}</h1><p>{k} {text}</p><p>More {k} {text}</p>{inner}</{art}><div class=foot>Made by us, {k}</div>"


def page(k, *, b="", ad="ad", art="article", cls="", inner=""):
    return PAGE.format(k=k, text=LONG, b=b, ad=ad, art=art, cls=cls, inner=inner)


def story(k):
    return f"Title {k}\n{k} {LONG}\nMore {k} {LONG}"


@pytest.mark.parametrize("how", [{}, {"art": "div", "cls": " class=xqz"}, {"art": "div", "ad": "zzq", "cls": " class=ad"}, {"cls": ' class="post with-sidebar"'}, {"cls": ' class="entry-content social-embed"'}, {"cls": " class=comments"}, {"ad": "article-content"}])
def test_slots_decide_whatever_names_say(spark, how):
    for one_host in (True, False):  # also where each page is all there is of its host
        got = texts(spark, [page(k, **how) for k in range(4)], one_host)
        if how.get("ad") != "article-content":
            assert got == {k: story(k) for k in range(4)}
        else:  # a part beside the article that is named one is kept with it
            assert got == {k: f"Buy {k} now\n{story(k)}" for k in range(4)}


def test_parts_of_an_article(spark):
    """Minor parts whose class is boilerplate as a whole go; tables that only share a word, lists and long parts stay."""
    inner = "<table class=share-price-table><tr><td>Price {k}</table><div class=ads>Buy {k}</div><div class='social share'>Tell all {k}</div><ul><li><a href=x>One link</a></ul><aside>Aside {k}</aside>"
    got = texts(spark, [page(k, inner=inner.format(k=k)) for k in range(5)])
    assert got == {k: f"{story(k)}\nPrice {k}\nOne link" for k in range(5)}


def test_sections_of_a_host_have_templates_of_their_own(spark):
    pages = [page(k, b=f" class=s{'abcdefgh'[k % 8]}", art="div", cls=f" class=c{'abcdefgh'[k % 8]}") for k in range(32)]
    assert texts(spark, pages) == {k: story(k) for k in range(32)}


def test_very_long_pages_and_those_of_many_types(spark):
    long = "<p>{k} word</p>" * 20_000
    got = texts(spark, [page(0, inner=long), page(1), "", "<p>alone", "no tags at all", "<body><ul><li><a href=/>only links</a></ul>"])
    assert got[0].count("\n") == 20_002 and got[1] == story(1)
    assert [got[k] for k in range(2, 6)] == ["", "alone", "no tags at all", ""]

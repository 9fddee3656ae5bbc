"""Main text of pages: known layouts, broken markup, and all given pages against their template."""

import html as entities
import re
import time

import pytest

from khata.llm import main_text, queries
from khata.llm.main_text import main_text as text_of

SF = "/root/testdata/sf0.001"
LONG = "A paragraph that is long enough to count, with commas, and with words, as those of articles are, more or less."


def by_template(page):
    """Article of a given page, cut from its one template by plain expressions."""
    found = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)
    inner = found.group(1) if found.group(2) else re.sub(r"<[^<>]*$", "", found.group(1))
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    rows = queries.op12_html_extraction(spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["text"], r["url"]) == (by_template(pages[r["page_id"]]["html"]), pages[r["page_id"]]["url"])
        assert r["n_chars"] == len(r["text"])


NOISE = ["<header><b>Site</b><p>{}</p></header>", "<nav><ul><li><a href=/>Home</a></ul></nav>", "<div class='site-header'><b>Name</b>{}</div>",
         "<div id=cookie-banner><p>{}</p></div>", "<aside><p>{}</p></aside>", "<div class='sidebar left'><p>{}</p></div>",
         "<form action=/s><p>{}</p><input name=q><select><option>one<option>two</select></form>", "<div role=alert>{}</div>",
         "<section id=comments><h2>Comments</h2><article class=comment><p>{}</p></article></section>", "<script>var s = '<p>{}</p>';</script>",
         "<style>p:after{{content:'<p>x</p>'}}</style>", "<!-- <p>{}</p> -->", "<div hidden><p>{}</p></div>", "<p style='display: none'>{}</p>",
         "<div class=AdSlot><p>{}</p></div>", "<section><h3>Comments (12)</h3><p>{}</p></section>", "<footer><p>{}</p></footer>",
         "<noscript><p>{}</p></noscript>", "<div class=newsletter-signup><p>{}</p></div>", "<iframe><p>{}</p></iframe>",
         "<ul class=breadcrumbs><li>{}</ul>", "<p>one <span class=ad>{}</span> two</p>"]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class=entry-content>{}</div>", "<main><div><div>{}</div></div></main>",
                                  "<div id=page class=with-sidebar><section>{}</section></div>", "<table><tr><td>{}</td></tr></table>"])
@pytest.mark.parametrize("noise", NOISE)
def test_noise(wrap, noise):
    body = f"<h1>Title</h1><p>{LONG}</p><p><b>Bold {LONG}<br><p>Short.</p><ul><li>item {LONG}<li>second</ul>"
    kept = ["Title", LONG, f"Bold {LONG}", "Short.", f"item {LONG}", "second"]
    bad = noise.format("Noise, noise, and more of it, " * 30)
    inner = ["one two"] if "span" in noise else []
    outside = text_of(f"<html><body>{bad}{wrap.format(body)}{bad}</body></html>").split("\n")
    assert [b for b in outside if b not in inner] == kept
    assert text_of(f"<html><body>{wrap.format(body + bad + f'<p>End, {LONG}')}") .split("\n") == [*kept, *inner, f"End, {LONG}"]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), (" \n ", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<div>a<p>b</p>c</div>", "a\nb\nc"),
    ("<p>&lt;p&gt; &eacute;&#233;&#xE9;&hellip; AT&T &copy 5</p>", "<p> ééé… AT&T © 5"), ("<p>a&nbsp;\t b c\n d</p>", "a b c d"),
    ("<p>1 < 2 <3</p>", "1 < 2 <3"), ("<p title='a>b'>x</p>", "x"), ("<p>x<!-- a > b --!> y -->z</p>", "xz"), ("<p>x<!-->y", "xy"),
    ("<p>x</p><p clas", "x"), ("<p>x <a href='", "x"), ("<P>Up<B>per</b> case</P>", "Upper case"), ("<p>in<b>li</b>ne<br>break</p>", "inline break"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"), ("<b><p>x</b>y</p>", "xy"),
    ("<article><header><h1>T</h1><p>by me</p></header><p>x</article>", "T\nx"), ("<![CDATA[x]]><p>y", "y"), ("<?php x ?><p>y", "y"),
    ("<h1>only</h1>", "only"), ("<div class=comments><p>all there is</p></div>", "all there is"), ("<textarea><p>x</p></textarea><p>y", "y"),
    ("</p></div><p>x</article>y", "xy"), ("\x00<p>a\x00b", "\x00\na\x00b"),
])
def test_markup(page, text):
    assert text_of(page) == text


def test_siblings_and_menus():
    links = "".join(f"<li><a href=/{i}>link number {i}</a>" for i in range(9))
    page = f"""<body><div class=top><a href=/>Home</a> | <a href=/b>B</a></div><div><h2>Part</h2><div><p>{LONG}</p><p>{LONG}</p></div>
        <p>{LONG}</p><ul>{links}</ul><div><p>{LONG}</p><ul>{links}</ul></div></div><div>Bye</div></body>"""
    assert text_of(page) == "\n".join(["Part", *[LONG] * 4])


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p><b><i>" * 50_000, "<a>" * 200_000, "<" * 300_000, "<!--" * 100_000, "</b>" * 200_000,
                                  "<ul><li>" * 50_000 + "x", "<td><p>" * 50_000, "&amp" * 200_000, "<p x='" * 100_000, "<b><p>" + "<i>" * 90_000 + "</b>" * 90_000,
                                  "<p>" + "word, " * 500_000, "<script>" * 100_000, "<table><tr><td>" * 30_000 + "</p>" * 30_000])
def test_large_pages(page):
    start = time.time()
    text_of(page)
    assert time.time() - start < 20


def test_rows(spark, nothing):
    """Extra columns of clashing names, nulls, repeated rows, a long page, and an empty table."""
    pages = spark.createDataFrame([(1, None, "t", 5), (1, "<p>x", "t", 5), (1, "<p>x", "t", 5), (None, "<p>" + "long, " * 300_000, "t", 5)],
                                  "row int, html string, text string, n_chars int")
    rows = main_text.extract(pages).collect()
    assert sorted((r["text"][:4], r["n_chars"], r["row"]["text"], r["row"]["n_chars"]) for r in rows) == [
        ("", 0, "t", 5), ("long", 1_799_999, "t", 5), ("x", 1, "t", 5), ("x", 1, "t", 5)]
    assert main_text.extract(nothing, "text").count() == 0

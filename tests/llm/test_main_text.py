"""Pages whose elements without text are closed by a slash, not closed, or follow letters that lower() lengthens."""

from __future__ import annotations

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from semifold.llm import html_extract

STORY = "A plain sentence of the story with several quiet words in a row to read, and then one more of the same kind."
PAGE = "<html><body>%s<article><p>%s</p><p>%s</p></article></body></html>"


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages())


@pytest.mark.parametrize("before", ["<svg viewBox='0 0 1 1'/>", "<iframe src=\"x\" />", "<object data=x />", "<script src='x'/>", "<svg>", "<iframe src=/a/>", "<select>", "<TEMPLATE>", "<script>if (a < b) c();</SCRIPT>", "<script>x</script \n>", "<style>p { top: 0 }</style>", "<svg><title>no</title></svg>"])
def test_article_stays(model, before):
    assert html_extract.extract_batch([PAGE % (before, STORY, STORY)], model, 0.5) == [f"{STORY} {STORY}"]


@pytest.mark.parametrize("before", ["<iframe src=/a/>no</iframe>", "<textarea>no</textarea>", "<script>'</scripts>'</script>"])
def test_content_is_skipped(model, before):
    assert html_extract.extract_batch([PAGE % (before, STORY, STORY)], model, 0.5) == [f"{STORY} {STORY}"]


def test_dotted_capital_i(model):
    page = "<html><body><div>" + "İ" * 30 + "</div><script>var a = 1;</script><article><p>%s</p></article></body></html>" % STORY
    t = html_extract.Tree()
    t.parse(0, page)
    (article,) = [t.parent[node] for _, node, text in t.pieces if text == STORY]
    assert t.depth[article] == 3  # after the root, html and body


def test_unclosed_script_runs_to_the_end(model):
    assert html_extract.extract_batch([f"<body><article><p>{STORY}</p></article><script>var a;"], model, 0.5) == [STORY]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, "<div>" * 60_000 + "x", "<a '" * 100_000 + ">", "<a x='> <a '" * 40_000, "<a " + "= " * 400_000, "<p>x" * 100_000, "<td>x" * 50_000 + "<tr>" * 20_000, "</b></div>" * 100_000, "<" * 500_000, "<!--" * 100_000, "<script></script>" * 30_000])
def test_time_is_linear(model, page):
    start = time.perf_counter()
    html_extract.extract_batch([page], model, 0.5)
    assert time.perf_counter() - start < 20


def test_very_long_article(model):
    words = "plain words of a very long story " * 150_000
    (got,) = html_extract.extract_batch([PAGE % ("<nav><a href='/'>Home</a></nav>", words, STORY)], model, 0.5)
    assert got == f"{words.strip()} {STORY}"


@pytest.mark.parametrize("inside, text", [
    ("Energy is <math><mi>E</mi><annotation>$E$</annotation></math> in joules.", "Energy is E in joules."),
    ("</p><table><caption>Years</caption><tr><td>one<td>two<tr><td>three</table><p>", "Years one two three"),
    ("</p><svg viewBox='0 0 1 1'><title>no</title><path d='M0'/><text>a label</text></svg><p>", "a label"),
    ("</p><object data='x'>What stands in for it.</object><p>", "What stands in for it."),
    ("a<![CDATA[ < b &amp; c]]>", "a < b &amp; c"),
    ("AT&amp;T &lt;b&gt; &#233;&nbsp;x<br>y\n\t z", "AT&T <b> é x y z"),
    ("a <span title='x > y'>b</span> c <a href=/x/>d</a> <i title=don't>e</i>", "a b c d e"),
])
def test_article_parts(model, inside, text):
    page = PAGE % ("", STORY, STORY + "</p><p>" + inside)
    assert html_extract.extract_batch([page], model, 0.5) == [f"{STORY} {STORY} {text}"]


@pytest.mark.parametrize("page", ["<", "<a", "a < b", "</", "<!", "<?", "<a b='", "<a b=\"x>y", "</p></p>", "<p", "<![CDATA[x", "<svg/", "\x00<p>\x00", "<a/b/c>x", "< p>x"])
def test_odd_markup_ends(model, page):
    (got,) = html_extract.extract_batch([page], model, 0.5)
    assert isinstance(got, str)


def test_pages_of_another_make(model):
    """Two makes of pages that the labelled table does not have; all story text and nothing else is wanted."""
    frames = (
        "<body><div id='top'><div class='site-menu'><ul><li><a href='/1'>Home</a></li><li><a href='/2'>News</a></li></ul></div></div><div id='main-content'>%s</div><div class='sidebar-right'><p><a href='/3'>Read next</a></p></div><div id='footer'><p>All rights reserved by the owner of the site.</p></div></body>",
        "<body><header role='banner'><a href='/'>The Paper</a></header><main><article class='story'>%s<aside>More on this in the evening edition.</aside></article></main><div class='comments'><p>I did not like this story at all, to be honest.</p></div><form><label>Your name</label></form></body>",
    )
    story = ["<h1>Rain in the hills</h1>", "<p>It rained in the hills for nine days, and the river rose by a metre.</p>", "<h2>Roads</h2>", "<p>Two roads were closed. They opened again on Monday.</p>", "<ul><li>the valley road</li><li>the road by the mill</li></ul>"]
    want = "Rain in the hills It rained in the hills for nine days, and the river rose by a metre. Roads Two roads were closed. They opened again on Monday. the valley road the road by the mill"
    assert html_extract.extract_batch([f % "".join(story) for f in frames], model, 0.5) == [want] * 2


def test_query_against_a_plain_extractor(spark):
    """The whole table: its articles are well formed, so a few patterns give the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = pages.limit(1).withColumn("html", F.lit(None).cast("string")).withColumn("text", F.lit("clash"))
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        (body,) = re.findall(r"<article>(.*?)</article>", rows[r["page_id"]], re.S)
        blocks = re.split(r"</?(?:p|h1|h2|li|ul|div)\b[^>]*>", body.replace("<br>", " "))
        want = " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))
        assert (r["text"], r["n_chars"]) == (want, len(want))
    (r,) = html_extract.extract(more).collect()
    assert (r["text"], r["n_chars"]) == ("", 0)
    assert html_extract.extract(pages.limit(0)).count() == 0

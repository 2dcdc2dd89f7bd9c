import html
import random
import re
import time

import pytest

from quarry.llm import html_text as m

SF = "/root/testdata/sf0.001"


def text(page):
    return m.extract([page], m.trained())[0]


def test_articles_of_the_test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = m.query(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_pages():
    rng, right = random.Random(1234), 0
    for _ in range(120):
        page = m.example_page(rng)[0]
        want = " ".join(n.text.replace(m.MARK, "") for n in m.parse(page) if m.MARK in n.text)
        right += text(page.replace(m.MARK, "")) == want
    assert right >= 100


@pytest.mark.parametrize("page", [None, "", "   ", "<!-- open", "<script>never closed", "</div></p>", "<p><b><i>" * 500])
def test_broken_pages_have_no_text(page):
    assert text(page) == ""


def test_page_with_everything():
    page = (
        "<html><head><title>t</title></head><body><header><h1>Site name</h1></header><nav><a href=/>Home</a> <a href=/x>News</a></nav>"
        "<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Big  news</h1><p>Some text &amp; more of it,\n with a <b>bold</b> word. It goes on for a while.</p>"
        "<script>var a = '<p>no</p>';</script><p>A second paragraph, which is also long enough to be read as text.</p></article>"
        "<section class='comments'><p>First!</p><p>I agree.</p></section><aside class=sidebar><a href=/a>Related one</a></aside>"
        "<form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"
    )
    assert text(page) == "Big news Some text & more of it, with a bold word. It goes on for a while. A second paragraph, which is also long enough to be read as text."


@pytest.mark.parametrize("before", [0, 30, 60, 400])
def test_attributes_are_read_whole(before):
    page = f"<div class='{'px-4 mt-2 ' * before}sidebar' id=cookie><p>x</p></div>"
    assert m.parse(page)[1].flags == m.parse("<div class='sidebar cookie'><p>x</p></div>")[1].flags != 0
    cut = "z" * 197 + " adverse"
    assert m.parse(f"<div class='{cut}'>x</div>")[1].flags == 0


def test_no_kept_node_has_a_dropped_parent():
    rng = random.Random(5)
    import numpy as np

    for _ in range(30):
        nodes = m.parse(m.example_page(rng)[0])
        odds = np.random.default_rng(rng.randrange(99)).normal(size=len(nodes))
        kept = set(m.decode(nodes, odds))
        assert kept <= {n.text for n in nodes if n.kind == "#text"}


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article><p>" + "long text here, again. " * 20_000 + "</p></article>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = m.main_text(pages).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and max(r.n_chars for r in got) > 400_000
    assert m.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "unit", ["<a b='", '<a b="', "<a ", "<!x", "<!--", "</script", "<script", "<div>", "</p>", "<p x=\"1' y='2\">", "&#", "&#9", "id=\"", "<svg>", "<li>"]
)
def test_hostile_pages_take_linear_time(unit):
    for page in (unit * (1_000_000 // len(unit)), f"<article>{unit * (1_000_000 // len(unit))}", "<div>" * 50_000 + "</p>" * 50_000 + unit):
        began = time.perf_counter()
        m.parse(page)
        assert time.perf_counter() - began < 20


def test_tag_ends_and_references():
    assert [n.text for n in m.parse("<p title='a > b'>x</p><p don't>y</p><p a=\"open>z</p>") if n.kind == "#text"] == ["x", "y", "z"]
    assert m.unescaped("&#" + "0" * 9000 + "65;&#" + "9" * 9000 + ";&#x41;&amp;") == "A\ufffdA&"
    assert [n.text for n in m.parse("a<script>var x = '</scripty>';</script >b< c") if n.kind == "#text"] == ["ab< c"]

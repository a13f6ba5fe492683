from __future__ import annotations

import time

import numpy as np
import pytest

from cellprofiles.llm import extraction
from cellprofiles.llm.html_blocks import leaf_blocks
from cellprofiles.llm.queries import op4_extraction

PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{x:1}</style>
<script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">My site</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site.</p><button>Accept</button></div>
<article><h1>Ten &lt;new&gt;
   bridges</h1><p>The town has <b>ten</b> new bridges,<br>he said on Monday. It is a long story, of course.
<p>They were built &amp; opened in one year&#33; Nobody knows how that was done.</p>
<div class="ad">Buy bridges now</div>
<p>The end of the story is not yet written. More will follow soon.</p></article>
<aside class="related"><h3>Related</h3><ul><li><a href="/c">Nine bridges</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I like bridges very much. Thank you.</p></div></section>
<form><label>Your email</label><input name=e><button>Subscribe</button></form>
<footer>&copy; My site &middot; All rights reserved</footer></body></html>"""

ARTICLE = """Ten <new> bridges
The town has ten new bridges, he said on Monday. It is a long story, of course.
They were built & opened in one year! Nobody knows how that was done.
The end of the story is not yet written. More will follow soon."""


@pytest.fixture(scope="module")
def labeller():
    return extraction.trained_labeller()


def test_page_of_many_parts(labeller):
    assert extraction.extract([PAGE, None, "", PAGE], labeller, extraction.Features()) == [ARTICLE, "", "", ARTICLE]


def test_unseen_made_pages(labeller):
    pages, labels = extraction._examples(150, 12345)
    right = [((a > 0) == (b > 0)).mean() for a, b in zip(labeller.logits(pages), labels, strict=True)]
    assert np.mean(right) > 0.985


def test_pages_table(spark):
    out = op4_extraction(spark, "/root/testdata/sf0.001").toPandas()
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").toPandas()
    assert sorted(out.page_id) == sorted(pages.page_id)
    html = pages.set_index("page_id").html
    wrong = 0
    for row in out.itertuples():
        inside = html[row.page_id].split("<article>")[1].split("</article>")[0]
        want = "\n".join(block.text for block in leaf_blocks(inside))
        wrong += row.text != want
        assert row.n_chars == len(row.text)
    assert wrong <= 0.02 * len(out)


def test_gradient_by_differences():
    model = extraction.BlockLabeller.fresh(3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pages, labels = extraction._examples(3, 8)

    def loss():
        out = np.concatenate(model.logits(pages)).astype(np.float64)
        label = np.concatenate(labels)
        return float(np.mean(np.logaddexp(0, out) - label * out))

    found = model.gradient(pages, labels)
    draw = np.random.default_rng(1)
    for name in ("ahead_w", "ahead_u", "behind_b", "out", "path"):
        weight = model.weights[name]
        at = tuple(draw.integers(0, n) for n in weight.shape)
        if name == "path":
            at = (pages[0][0][0][0], 2)
        before, step = weight[at], 0.02
        weight[at] = before + step
        more = loss()
        weight[at] = before - step
        less = loss()
        weight[at] = before
        assert found[name][at] == pytest.approx((more - less) / (2 * step), rel=0.08, abs=2e-4)


def test_odd_markup():
    def texts(page):
        return [block.text for block in leaf_blocks(page)]

    assert texts("no tags   at all") == ["no tags at all"]
    assert texts("<p>one<p>two<ul><li>a<li>b</ul>three") == ["one", "two", "a", "b", "three"]
    assert texts("<p>a < b &am; &amp &lt;x") == ["a < b &am; & <x"]
    assert texts("<p>x<!-- y --><script>z</script><p>cut <a hre") == ["x", "cut"]
    assert texts("<div title='a>b'>in</div></div></p>out<br>side") == ["in", "out side"]
    assert texts("<b>" * 3000 + "deep") == ["deep"]
    assert texts("<script>never closed") == [] and texts("<head><title>t</title><p>body") == ["body"]


def test_long_page_and_segments(labeller, monkeypatch):
    long = "<article>" + "<p>It was a long day, and all was well. Then came the night.</p>" * 3000 + "</article>"
    whole = extraction.extract([long], labeller, extraction.Features())
    assert whole[0].count("\n") == 2999
    monkeypatch.setattr(extraction, "SEGMENT", 7)
    assert extraction.extract([long], labeller, extraction.Features()) == whole


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.select(extraction.main_text(pages.html, pages)).count() == 0


@pytest.mark.parametrize("tag", ["noscript", "select", "object", "canvas", "svg", "template", "iframe"])
def test_unclosed_hidden_elements(tag):
    def texts(page):
        return [block.text for block in leaf_blocks(page)]

    assert texts(f"<p>one</p><{tag} x=1>gone<p>two</p><p>three") == ["one", "two", "three"]
    assert texts(f"<div><{tag}>gone</div>two<p>three</p>") == ["two", "three"]
    assert texts(f"<{tag}>gone<p>two</p><{tag}><p>gone</p></{tag}>three") == ["two", "three"]
    assert texts(f"<{tag}>a<{tag}>b</{tag}><p>c</{tag}>three") == ["three"]


def test_markup_in_scripts_of_the_head():
    page = "<head><title>a <p> b</title><script>var t = '<div class=x><nav>no</nav>';</script><style>/*<p>*/</style>"
    for end in ("</head><body><p>yes</p>", "<body><p>yes</p>", "<p>yes</p>", "<noscript><p>no</p></noscript></head><p>yes"):
        assert [block.text for block in leaf_blocks(page + end)] == ["yes"]
    assert leaf_blocks(page + "<script>never closed <p>no") == []


def _texts(page):
    return [block.text for block in leaf_blocks(page)]


def test_attributes_of_any_length():
    for quote in "\"'":
        page = f"<p>in <a title={quote}{'y > z ' * 20_000}{quote} href=q>link</a><div data-x={quote}a=b>c{quote}>out</div>"
        assert _texts(page) == ["in link", "out"]
    assert _texts("<p don't>one</p><p class=it's>two</p><a href=x'y>z</a>") == ["one", "two", "z"]
    assert _texts('<p title="never closed>one</p><p>two</p>') == ["one", "two"]


def test_whole_paths_and_classes():
    page = "<div>" * 20 + "<section class='comments'>" + "<div>" * 20 + "<p>x"
    names = leaf_blocks(page)[0].path.different()
    assert names == ("div", "section", ".comments", "p")
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(600)]
    page = f"<div class='{' '.join(words)} comments'><p>x"
    assert leaf_blocks(page)[0].path.different() == ("div", *(f".{w}" for w in words), ".comments", "p")
    assert leaf_blocks("<div class=a><div class=b></div><div class=b>x")[0].path.different() == ("div", ".a", ".b")
    assert leaf_blocks("x<p id=aB>y")[1].path.last(2) == (".a", ".b") and leaf_blocks("x")[0].path.last(1) == ()


def test_deep_open_elements_are_closed():
    assert _texts("<p>one" + "<b>" * 30 + "two<p>three") == ["onetwo", "three"]
    deep = leaf_blocks("<ul><li class=one>a" + "<b>" * 30 + "<li>b")
    assert deep[1].path.different() == ("ul", "li")
    inner = leaf_blocks("<ul><li>a<ul><li class=in>b</ul>c")
    assert [b.path.different() for b in inner] == [("ul", "li"), ("ul", "li", ".in"), ("ul", "li")]


@pytest.mark.parametrize("depth", [5, 20, 40])
@pytest.mark.parametrize("kind", ["comments", "cookie-notice", "related", "ad"])
def test_wrapped_parts_stay_out(labeller, depth, kind):
    article = "".join(
        f"<p>The town has {n} new bridges, he said on Monday. It is a long story, of course.</p>"
        for n in ("two", "three", "four")
    )
    wrapped = f"<section class='{kind}'>" + "<div>" * depth + "<p>I like it very much. Thank you.</p>" + "</div>" * depth
    page = f"<body><article><h1>Ten bridges</h1>{article}</article>{'<div>' * depth}{wrapped}</section>{'</div>' * depth}"
    text = extraction.extract([page], labeller, extraction.Features())[0]
    assert text.count("new bridges") == 3 and "Thank you" not in text


@pytest.mark.parametrize(
    "page",
    [
        '<a href="x ' * 90_000,
        '<a b="x>" ' * 100_000 + '"',
        "<head>" + "<noscript>" * 100_000,
        "<head>" + "<noscript>x</noscript " * 50_000,
        "<a " * 350_000,
        "<a " + "= " * 500_000,
        "<div>x" * 170_000,
        "<p><table><td>" + "<b>" * 100_000 + "<div>" * 100_000,
        "<ul>" + "<li>x" * 200_000,
        "<head>" + "<script " * 125_000,
        "<svg>" * 200_000,
        "</noscript " * 90_000 + "<noscript>x",
        "<" * 1_000_000,
    ],
    ids=range(13),
)
def test_odd_pages_of_a_megabyte(page):
    """Each took minutes, or most of an hour, when time grew with the square of the length."""
    start = time.process_time()
    leaf_blocks(page)
    assert time.process_time() - start < 8


def test_path_sums_are_means_of_buckets(labeller):
    page = "<div class='a b'><ul><li>one<li class=c>two</ul><div><div class='d a'>three"
    blocks, features = leaf_blocks(page), extraction.Features()
    bags = [features.bags(b) for b in blocks]
    summed = [features.summed(b, labeller.weights["path"]) for b in blocks]
    assert np.allclose(labeller.inputs(bags), labeller.inputs(summed), atol=1e-5)

"""Main texts of pages: blocks, the field's likelihood and decoding, whole pages of many kinds."""

import html
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import labelled_pages, main_text
from gridspark.llm.line_rules import viterbi


def texts(page):
    return [text for text, _, _ in main_text.blocks_of(page)]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("no markup &amp; &lt;b&gt;", ["no markup & <b>"]),
        ("<p>one\n\t two&nbsp;<b>th</b>ree<br>four<p>five", ["one two three", "four", "five"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("<title>t</title><script>if (a<b) x='</p>'</script><style>p{}</style><!-- <p>c</p> --><p>d</p>", ["d"]),
        ("<p>1 < 2 & 3 &copy; &#8364; &#x41; &unknown; &amp", ["1 < 2 & 3 © € A &unknown; &"]),
        ("</div></p><div>a</span></article>b", ["a", "b"]),
        ("<head><title>x</title><meta><body><p>shown", ["shown"]),
        ("<p>a<script>open", ["a"]),
        ("<p>cut <a href='x", ["cut"]),
        ("<p>a<!-- open", ["a"]),
        ("<p>1 < 2 <", ["1 < 2 <"]),
    ],
)
def test_blocks(page, blocks):
    assert texts(page) == blocks


def test_blocks_know_their_ancestors():
    page = '<div class="side-Bar x_2" id=Top><ul><li><a href=x>one</a><li>two</ul></div><article><header><h1>t</h1></header><p>u</article><p>v'
    one, two, t, u, v = (set(found) for _, found, _ in main_text.blocks_of(page))
    assert {"up:div", "up:ul", "up:li", "name:side", "name:bar", "name:top", "own:li", "in:none", "links:all"} <= one
    assert "links:none" in two
    assert {"up:article", "in:header", "own:h1"} <= t and {"in:article", "own:p"} <= u and "up:header" not in u
    assert not {"up:article", "up:div", "name:top"} & v


def test_deep_and_long_pages_take_linear_time():
    deep = "<div><b>" * 50_000 + "x" + "</i></div>" * 50_000 + "<p>y"
    assert texts(deep) == ["x", "y"]
    assert len(texts("<p>a b" * 100_000)) == 100_000


def chains(seed, sizes, n_features=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(sum(sizes), n_features))
    return x, np.cumsum([0, *sizes])[:-1], rng.integers(0, 2, sum(sizes)), rng.normal(size=(n_features, 2)), rng.normal(size=(2, 2))


def every_labelling(x, weights, step):
    emission = x @ weights
    for labels in itertools.product((0, 1), repeat=len(x)):
        yield labels, sum(emission[i, y] for i, y in enumerate(labels)) + sum(step[a, b] for a, b in itertools.pairwise(labels))


def test_likelihood_is_exact_and_its_gradient_right():
    x, starts, labels, weights, step = chains(1, (6, 4, 4, 1))
    value, by_weights, by_step = main_text.likelihood(weights, step, x, starts, labels)
    want = 0.0
    for a, b in itertools.pairwise([*starts, len(x)]):
        scores = dict(every_labelling(x[a:b], weights, step))
        want += scores[tuple(labels[a:b])] - np.log(np.exp(list(scores.values())).sum())
    assert value == pytest.approx(want)
    for part, slope in ((weights, by_weights), (step, by_step)):
        for at in np.ndindex(part.shape):
            moved = []
            for d in (1e-5, -1e-5):
                part[at] += d
                moved.append(main_text.likelihood(weights, step, x, starts, labels)[0])
                part[at] -= d
            assert slope[at] == pytest.approx((moved[0] - moved[1]) / 2e-5, abs=1e-5)


def test_decoding_is_the_best_labelling():
    for seed in range(20):
        x, _, _, weights, step = chains(seed, (7,))
        best = max(every_labelling(x, weights, step), key=lambda r: r[1])[0]
        assert tuple(viterbi(x @ weights, step)) == best


def test_held_out_pages():
    """Pages of the grammar that training hasn't seen, without their marks."""
    right = blocks = 0
    for page in labelled_pages.pages(150, seed=5):
        marked = main_text.blocks_of(page)
        want = Counter(text for text, _, mark in marked if mark == "1")
        got = Counter(main_text.main_text(re.sub(r' data-main="."', "", page), main_text.default_model()).split())
        words = Counter(w for text, n in want.items() for w in text.split() for _ in range(n))
        blocks += sum(words.values()) + sum(got.values())
        right += 2 * sum((words & got).values())
    assert right / blocks > 0.95


STORY = "<h1>A title of it</h1><p>The first paragraph &amp; its words, some of <a href=x>them</a> linked.<p>Second: it goes on for a while, and ends here.<h2>Part two</h2><ul><li>Point one of the story.<li>Point two of it.</ul><p>Last."
TOLD = "A title of it The first paragraph & its words, some of them linked. Second: it goes on for a while, and ends here. Part two Point one of the story. Point two of it. Last."
OTHERS = {
    "menu": '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>',
    "header": '<header class="site-header"><p>The Daily Page</p><a href="/">Home</a></header>',
    "footer": "<footer>&copy; 2020 The Daily Page. All rights reserved.</footer>",
    "sidebar": '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Other story</a></ul></aside>',
    "notice": '<div class="cookie-notice"><p>We use cookies to make this page better for you.</p><button>Accept</button></div>',
    "advert": '<div class="ad">Buy this now. It is cheap and good.</div>',
    "form": '<form action="/s"><label>Search</label><input name=q><select><option>All<option>Some</select><button>Go</button></form>',
    "comments": '<section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I liked this story a lot. Thank you for it.</p></div></section>',
}


@pytest.mark.parametrize("container", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<main><article class=story>{}</article></main>"])
@pytest.mark.parametrize("other", list(OTHERS))
def test_parts_of_pages(container, other):
    told = container.format(STORY)
    page = OTHERS[other] + told if other in ("menu", "header") else told + OTHERS[other]
    assert main_text.main_text(f"<html><head><title>A title</title></head><body>{page}</body></html>", main_text.default_model()) == TOLD


def test_all_parts_at_once():
    before, after = (" ".join(OTHERS[o] for o in some.split()) for some in ("header menu notice advert", "comments sidebar form advert footer"))
    assert main_text.main_text(f"<body>{before}<article>{STORY}</article>{after}", main_text.default_model()) == TOLD


def article(page):
    """A page's article by its tags alone, as the given pages mark it."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    found = main_text.extract_main_text(pages).collect()
    assert len(found) == len(want) and all(r.n_chars == len(r.text) for r in found)
    assert sum(r.text == want[r.page_id] for r in found) >= 0.99 * len(want)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>é 😀 is here.</article>"), (1, "u", None), (3, "w", "<nav><a href=x>menu</a></nav>"), (4, "x", "<p>" + "word and more of it. " * 100_000)]
    pages = spark.createDataFrame([(*r, "t", 7) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    found = main_text.extract_main_text(pages)
    assert found.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = Counter((r.page_id, r.url, r.text if r.n_chars < 100 else None, r.n_chars) for r in found.collect())
    assert got == Counter([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", "é 😀 is here.", 12), (3, "w", "", 0), (4, "x", None, 2_099_999)])
    assert main_text.extract_main_text(pages.limit(0)).collect() == []


def test_own_labelled_pages(spark):
    """A field learnt from a user's pages follows their marks; without pages nothing is known and nothing left out."""
    mine = ['<div class="wanted" data-main="1"><p>keep this one</div><div class="junk"><p>drop this one</div>', '<div class="junk"><p>drop me as well</div><div class="wanted" data-main="1"><p>keep</div>'] * 3
    page = spark.createDataFrame([(1, "u", '<div class="junk"><p>keep or drop</div><div class="wanted"><p>keep or drop too</div>')], "page_id bigint, url string, html string")
    assert main_text.extract_main_text(page, mine).first().text == "keep or drop too"
    assert main_text.extract_main_text(page, []).first().n_chars >= 0

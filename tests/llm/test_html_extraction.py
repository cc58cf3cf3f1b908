import time
from itertools import product

import numpy as np
import pytest

from linkweave.llm.html_extraction import Chain, Labelled, blocks, default_chain, extract, features, labelled_page, main_text


def test_held_out_accuracy():
    chain, right, total = default_chain(), 0, 0
    for seed in range(5000, 5150):
        page, gold = labelled_page(seed)
        found = blocks(page)
        assert len(found) == len(gold)
        got = chain.decode(features(found))
        right += sum(a == b for a, b in zip(got, map(int, gold)))
        total += len(gold)
    assert right / total > 0.99


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a&amp;b &lt;i&gt;\n\t c<p>d", ["a&b <i> c", "d"]),
        ("<p>x<script>var t='</p>';</script>y</p><style>p{}</style>", ["xy"]),
        ("<title>t</title><p>one <b>two</b><br>three", ["one two three"]),
        ("a < b<!-- c <p> --> d<p hidden>no</p>e", ["a < b d", "e"]),
        ("<div>a<div style='display:none'>no<p>no</p></div>b</div>", ["a", "b"]),
        ("<p>open <a href=x", ["open <a href=x"]),
        ("", []),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_every_row_has_a_text(spark):
    body = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Some words of an article, long enough.</p><p>And more of it.</p></article><section class='comments'><p>Nice!</p></section><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", body, 5), (3, "u", body, 5), (None, "u", "<article>" + "<p>word and word. </p>" * 3000, 5)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 5 and by[1].text == "" and by[2].n_chars == 0
    assert by[3].text == "Title\nSome words of an article, long enough.\nAnd more of it." == main_text(default_chain(), body)
    assert by[None].text.count("\n") == 2999 and by[None].n_chars == len(by[None].text)
    assert extract(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("tag", ["p title='the hidden cost'", 'p class="a hidden b"', "p title=\"aria-hidden='true'\"", "p data-x='display: none'", "p data-hidden=1", "p aria-hidden=false", "p aria-hidden = true", "p aria-hidden='true'", "p id=hidden"])
def test_words_in_values_hide_nothing(tag):
    assert [b.text for b in blocks(f"<main><{tag}>text</p></main>")] == ["text"]


@pytest.mark.parametrize("tag", ["p hidden", "p title='a'hidden", 'p class="a" HIDDEN=""', "p hidden=until-found", "p style=display:none", 'p style="color: red; DISPLAY : none"'])
def test_hiding_attributes(tag):
    assert [b.text for b in blocks(f"<main><{tag}>text</p>rest</main>")] == ["rest"]


PROSE = "The committee met on Tuesday, and after a long debate it agreed to repair the old bridge before winter."
MORE = "Nobody spoke against the plan, though two members asked what it would cost."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><body><p>{PROSE}</p></body></html>", PROSE),
        (f"<html><body><div>{PROSE}</div><div>{MORE}</div></body></html>", f"{PROSE}\n{MORE}"),
        (f"<body><table><tr><td><p>{PROSE}</p><p>{MORE}</p></td></tr></table></body>", f"{PROSE}\n{MORE}"),
        (f"<body><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><h1>The bridge</h1><p>{PROSE}<p>{MORE}<footer>&copy; The paper</footer>", f"The bridge\n{PROSE}\n{MORE}"),
        (f"<body><header>The Paper</header><main><h1>The bridge</h1><p>{PROSE}</p><p aria-hidden='true'>{MORE}</p></main><div id='comments'><p>{MORE}</p></div>", f"The bridge\n{PROSE}\n{MORE}"),
        ("<article><h1>Sums</h1><p>Let <math><mi>x</mi>=2</math> be a number, and look at <svg><text>this</text></svg>.</p><p>Then it is <object>even</object>, said <canvas>she</canvas>.</p></article>", "Sums\nLet x=2 be a number, and look at this.\nThen it is even, said she."),
        (f"<body><div class='x1'><div class='x2'><h2>The bridge</h2><div>{PROSE}</div><div>{MORE}</div></div></div><div class='newsletter'>Subscribe to our newsletter.</div>", f"The bridge\n{PROSE}\n{MORE}"),
    ],
)
def test_pages_of_other_layouts(page, text):
    assert main_text(default_chain(), page) == text


@pytest.mark.parametrize("bad", ['<a "', '<a b="', "<a b='x' c=\"", "<div>x", "<p><b>", "<p><div><b>", "</x>", "<div></p>", "<!--", "<![CDATA[", "&", "<script>", "<", '<a b=" ', "<a class"])
def test_malformed_pages_take_time_by_length(bad):
    chain, page = default_chain(), (bad * (1 << 18))[: 1 << 18]
    began = time.process_time()
    main_text(chain, page)
    assert time.process_time() - began < 5


def test_depth_costs_nothing():
    page = "<p><div>" + "<b>" * 20_000 + "<p>x</p>" * 20_000 + "</i>" * 20_000
    began = time.process_time()
    assert [b.text for b in blocks(page)] == ["x"] * 20_000
    assert time.process_time() - began < 5


def test_very_long_page():
    page = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    assert main_text(default_chain(), page) == "\n".join([PROSE] * 20_000)


def some_chain(seed, features):
    r, chain = np.random.default_rng(seed), Chain([f"f{k}" for k in range(features)])
    chain.weights, chain.steps = r.normal(size=(features, 2)), r.normal(size=(2, 2))
    return r, chain


def value(chain, rows, labels):
    return sum(chain.weights[f, y].sum() for f, y in zip(rows, labels)) + sum(chain.steps[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_finds_the_best_labels(seed):
    r, chain = some_chain(seed, 6)
    feats = [[f"f{k}" for k in r.choice(6, r.integers(1, 4), replace=False)] for _ in range(r.integers(1, 9))]
    rows = chain.rows(feats)
    best = max(product((0, 1), repeat=len(rows)), key=lambda y: value(chain, rows, y))
    assert chain.decode(feats) == list(best)


def test_likelihood_and_gradients_equal_enumeration():
    r, chain = some_chain(3, 5)
    pages = [[r.choice(5, 2, replace=False).tolist() for _ in range(n)] for n in (1, 4, 6, 2)]
    gold = [r.integers(0, 2, len(p)).tolist() for p in pages]

    def plain():
        return sum(value(chain, p, y) - np.log(sum(np.exp(value(chain, p, z)) for z in product((0, 1), repeat=len(p)))) for p, y in zip(pages, gold))

    got, by_weight, by_step = Labelled(pages, gold).likelihood(chain.weights, chain.steps)
    assert got == pytest.approx(plain())
    for array, slope in ((chain.weights, by_weight), (chain.steps, by_step)):
        for at in np.ndindex(array.shape):
            array[at] += 1e-5
            above = plain()
            array[at] -= 2e-5
            below = plain()
            array[at] += 1e-5
            assert slope[at] == pytest.approx((above - below) / 2e-5, abs=1e-4)

"""Page trees, the tree model against all labellings, and main texts."""

import html
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from frostline.llm import html_extract, html_model
from frostline.llm.html_tree import Page, blocks_text
from frostline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shown(source: str) -> str:
    page = Page(source)
    return blocks_text(page, [True] * len(page.tag))


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<p>a<b>x<br>y<p>c</b>d<div>e</div>f</p>g", "ax y\ncd\ne\nf\ng"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>1<td>2<tr><td>3</table>4", "1\n2\n3\n4"),
        ("x<!-- > <p>no -->y<script>if (a</b>) '</p>'</script>z", "xy\nz".replace("\n", "")),
        ("<head><title>t</title></head>&amp;&lt;&#233;&eacute;&copy &am 1 < 2", "&<éé© &am 1 < 2"),
        ('<a title="a>b" href=x>h</a><style>p{}</style>', "h"),
        ("a<textarea><p>no</textarea>b<noscript>no</noscript>c", "ab\nc"),
        ("text<p class=", "text"),
        ("</p></div>a</b>b<!-- open", "ab"),
    ],
)
def test_blocks(source, text):
    assert shown(source) == text


def test_nodes_nest():
    page = Page("<div><p>a<b>b</p>c</div><i>d")
    for n in range(1, len(page.tag)):
        assert page.parent[n] < n < page.end[n] <= page.end[page.parent[n]]


def test_odd_pages_take_linear_time():
    began = time.time()
    for part in ("<div>", '<a "', "<b></i>", "<li>", "</p>", "<script>", "<!--", "<", "<ul><li>", "<table><td><b>", "&", "<b><p>"):
        Page(part * 30_000)
    assert time.time() - began < 30


def random_forest(rng) -> html_model.Forest:
    sources = ['<div class="menu"><a>x</a>y</div><p>Some words here.', "<article><h1>t</h1><ul><li>a<li>b</ul></article>", "", "z<p>"]
    return html_model.Forest([Page(s) for s in rng.permutation(sources)])


def test_sum_product_equals_all_labellings():
    rng = np.random.default_rng(1)
    forest = random_forest(rng)
    weights = rng.normal(size=html_model.N_WEIGHTS)
    total, marginals, pairs = html_model.sum_product(forest, weights)
    scores, theta = forest.scores(weights), weights[html_model.N_FEATURES :].reshape(-1, 2, 2)
    sums, n_total = [], 0.0
    for a, b in zip(forest.first[:-1], forest.first[1:]):  # page by page
        found, mass = np.zeros((b - a, 2)), 0.0
        both = np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            value = sum(s for s, label in zip(scores[a:b], y) if label)
            for n in range(a, b):
                if forest.parent[n] >= 0:
                    value += theta[forest.edge[n], y[forest.parent[n] - a], y[n - a]]
            p = np.exp(value)
            mass += p
            found[np.arange(b - a), y] += p
            for n in range(a, b):
                if forest.parent[n] >= 0:
                    both[n - a, y[forest.parent[n] - a], y[n - a]] += p
        sums.append(found / mass)
        assert np.allclose(both / mass, pairs[a:b])
        n_total += np.log(mass)
    assert np.isclose(total, n_total) and np.allclose(np.concatenate(sums), marginals)


def test_gradient_is_observed_minus_expected():
    rng = np.random.default_rng(2)
    forest = random_forest(rng)
    labels = rng.integers(0, 2, len(forest.parent))
    weights = rng.normal(size=html_model.N_WEIGHTS)

    def likelihood(w):
        theta = w[html_model.N_FEATURES :].reshape(-1, 2, 2)
        child = np.flatnonzero(forest.parent >= 0)
        edges = theta[forest.edge[child], labels[forest.parent[child]], labels[child]].sum()
        return forest.scores(w) @ labels + edges - html_model.sum_product(forest, w)[0]

    _, marginals, pairs = html_model.sum_product(forest, weights)
    expected = forest.counts(labels - marginals[:, 1])
    for k in np.flatnonzero(forest.counts(np.ones(len(labels)))).tolist():
        step = np.zeros_like(weights)
        step[k] = 1e-5
        assert np.isclose((likelihood(weights + step) - likelihood(weights - step)) / 2e-5, expected[k], atol=1e-5)


def sources(spark, sf):
    return [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]


def test_held_out_pages(spark):
    pages = sources(spark, "/root/testdata/sf0.1")
    found, labels = html_extract.labelled_pages(pages[:150])
    forest = html_model.Forest(found)
    weights = html_model.train(forest, np.array([y for page in labels for y in page]))
    assert html_extract.main_texts(pages[150:], weights) == [article(p) for p in pages[150:]]
    found, labels = html_extract.labelled_pages(pages[500:650])
    found, labels = found[150:], labels[150:]  # the renderings
    forest = html_model.Forest(found)
    sure = html_model.sum_product(forest, weights)[1][:, 1] >= 0.5
    size = np.array([len(t or "") for p in found for t in p.text])
    wanted = np.array([y for page in labels for y in page], bool)
    caught = size[sure & wanted].sum()
    assert caught / size[sure].sum() > 0.99 and caught / size[wanted].sum() > 0.97


def article(source: str) -> str:
    inside = source[source.index("<article>") + 9 : source.rindex("</article>")]
    blocks = [html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split("</?(?:p|h1)>", inside)]
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def test_query_returns_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = QUERIES["op12_html_text"](spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        text = article(pages[r.page_id].html)
        assert tuple(r) == (r.page_id, pages[r.page_id].url, text, len(text))


def test_extract_of_awkward_rows(spark):
    page = "<nav><a>Home</a></nav><article><p>One &amp; two.</p></article><footer>x</footer>"
    table = [(1, None, page), (1, None, page), (None, "u", None), (2, "u", ""), (3, "u", "<nav><a href=x>a</a></nav>")]
    rows = spark.createDataFrame(table, "page_id long, url string, html string")
    for clash in ("text", "n_chars", "weights", "score"):
        rows = rows.withColumn(clash, F.lit("clash"))
    weights = html_extract.train(rows)
    found = {tuple(r) for r in html_extract.extract(rows, html_model.start_weights()).collect()}
    assert found == {(1, None, "One & two.", 10), (None, "u", "", 0), (2, "u", "", 0), (3, "u", "", 0)}
    assert html_extract.extract(rows, weights).count() == 5
    none = rows.limit(0)
    assert html_extract.extract(none, html_extract.train(none)).count() == 0

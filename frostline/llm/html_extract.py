"""Main text of web pages by a tree model trained on pages whose markup says what is content.

A page with exactly one ``article`` or ``main`` labels itself. To learn from more than one kind
of markup, each picked page is also rendered anew: its blocks in other containers, among
menus, headers, footers, sidebars, notices, adverts, forms and reader comments whose texts
come from the picked pages, each part with a mark that gives its label.
"""

from __future__ import annotations

import html
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm import html_model
from frostline.llm.common import text_slices, whole_text
from frostline.llm.html_tree import Page, attributes, blocks_text

TRAIN_PAGES = 200  # at most so many pages are learned from
RENDERINGS = 3  # of each of them, beside the page itself
STEPS = 200
MARK = "data-content"  # "1" or "0" on the parts of a rendering
AT_LEAST = 0.5  # probability from which a text is content

# Containers of the parts of a rendering, and tags and classes a part may have.
_PARTS = {
    "menu": ["nav", 'div class="menu"', 'ul id="navigation"', 'div class="breadcrumbs"', 'div role="navigation"', "div"],
    "header": ["header", 'div class="site-header"', 'div id="masthead"', 'div class="topbar"'],
    "footer": ["footer", 'div class="footer"', 'div id="site-footer"', 'div class="copyright"', 'p class="legal"'],
    "side": ["aside", 'div class="sidebar"', 'div class="widget related"', 'section class="related-posts"'],
    "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="alert"', 'section class="notice"'],
    "advert": ['div class="ad"', 'div class="ads"', 'ins class="adsbygoogle"', 'div class="sponsored"', 'aside class="promo"'],
    "form": ["form", 'form class="newsletter"', 'div class="subscribe-form"', 'form id="search"'],
    "comment": ['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="reader-comments"'],
}
_CONTENT = ["article", "main", 'div class="post-content"', 'div id="content"', 'div class="article-body"', "section", "div"]
_BLOCK = ["p", "p", "p", "p", "div", "li", "h2", "h3", "blockquote", "td", "pre"]


def _tag(opening: str, inside: str, label: str = "") -> str:
    name = opening.split()[0]
    return f"<{opening}{f' {MARK}="{label}"' if label else ''}>{inside}</{name}>"


def render(rng: random.Random, blocks: list[str], texts: list[str]) -> str:
    """A page with ``blocks`` as its content, and parts made of ``texts`` around and inside."""
    clip = lambda n: " ".join(html.escape(rng.choice(texts)).split()[:n]) if texts else ""

    def part(kind: str) -> str:
        links = "".join(_tag("li", _tag('a href="#"', clip(rng.randint(1, 3)))) for _ in range(rng.randint(2, 7)))
        prose = "".join(_tag(rng.choice(["p", "p", "li", "div"]), clip(rng.randint(5, 60))) for _ in range(rng.randint(1, 4)))
        inside = {
            "menu": _tag("ul", links),
            "header": _tag("h2", clip(3)) + rng.choice(["", _tag("p", clip(8)), _tag("ul", links)]),
            "footer": "&copy; " + clip(4) + " &middot; " + clip(rng.randint(3, 20)),
            "side": _tag("h3", clip(3)) + rng.choice([_tag("ul", links), prose]),
            "notice": rng.choice([clip(25), _tag("p", clip(25)), prose]),
            "advert": rng.choice([clip(12), _tag("p", clip(12)), _tag('a href="#"', clip(8))]),
            "form": _tag("label", clip(2)) + "<input>" + rng.choice(["", _tag("p", clip(15))]),
            "comment": _tag("h3", clip(2)) + prose,
        }[kind]
        return _tag(rng.choice(_PARTS[kind]), inside, "0")

    some = lambda *kinds: [part(k) for k in kinds if rng.random() < 0.6]
    body = []
    for i, block in enumerate(blocks):
        if i and rng.random() < 0.05:
            body.append(part(rng.choice(["advert", "side", "form", "notice"])))
        name, inside = rng.choice(_BLOCK), html.escape(block)
        if rng.random() < 0.2:
            inside = _tag(rng.choice(["b", "em", "span", 'a href="#"']), inside[: len(inside) // 3 + 1].rsplit("&", 1)[0]) + inside
        wrap = {"li": "<ul>%s</ul>", "td": "<table><tr>%s</tr></table>"}.get(name, "%s")
        body.append(wrap % _tag("h1" if not i and rng.random() < 0.7 else name, inside))
    head = rng.choice(["%s", "%s", "<header>%s</header>"]) % body[0] if body else ""
    tail = some("comment") if rng.random() < 0.4 else []
    content = _tag(rng.choice(_CONTENT), head + "".join(body[1:] + tail), "1")
    page = some("header", "menu", "notice", "advert") + [content] + some("comment", "side", "advert", "form", "footer", "notice")
    whole = "".join(page)
    for wrapper in rng.choice([[], ["div"], ['div class="container"', "div"], ['div id="page"', 'div class="row"', "div"]]):
        whole = _tag(wrapper, whole)
    return f"<html><head><title>{clip(4)}</title></head><body>{whole}</body></html>"


def own_labels(page: Page) -> list[int] | None:
    """1 for the one ``article`` or ``main`` and what is in it, apart from other parts of a page
    inside; None if there is none, or more than one."""
    found = [n for n, tag in enumerate(page.tag) if tag in ("article", "main")]
    if not found or any(n >= page.end[found[0]] for n in found):
        return None
    out = [0] * len(page.tag)
    out[found[0] : page.end[found[0]]] = [1] * (page.end[found[0]] - found[0])
    for n in range(found[0], page.end[found[0]]):
        if page.tag[n] in ("nav", "aside", "form", "footer"):
            out[n : page.end[n]] = [0] * (page.end[n] - n)
    return out


def marked_labels(page: Page) -> list[int]:
    out = [0] * len(page.tag)
    for n in range(1, len(out)):
        mark = attributes(page.raw[n]).get(MARK) if MARK in page.raw[n] else None
        out[n] = out[page.parent[n]] if mark is None else int(mark)
    return out


def labelled_pages(sources: list[str], renderings: int = RENDERINGS) -> tuple[list[Page], list[list[int]]]:
    """The pages that label themselves, and renderings of them."""
    pages, labels, contents, texts = [], [], [], []
    for page in map(Page, sources):
        own = own_labels(page)
        if own is not None:
            pages.append(page)
            labels.append(own)
            contents.append(blocks_text(page, own).split("\n"))
            texts += blocks_text(page, [not y for y in own]).split("\n") + contents[-1][:3]
    rng, texts = random.Random(12), [t for t in texts if t]
    for blocks in contents:
        blocks = [b for b in blocks if b]
        for _ in range(renderings):
            shown = _short_lines(rng, blocks) if blocks and rng.random() < 0.3 else blocks
            pages.append(Page(render(rng, shown, texts)))
            labels.append(marked_labels(pages[-1]))
    return pages, labels


def _short_lines(rng: random.Random, blocks: list[str]) -> list[str]:
    """Content that reads like a list or a poem: many blocks of few words, some again and again."""
    out = []
    for _ in range(rng.randint(5, 80)):
        words = rng.choice(blocks).split()
        out.append(" ".join(words[: rng.randint(1, 4)]) if not out or rng.random() < 0.7 else out[-1])
    return out


def train(pages: DataFrame, at_most: int = TRAIN_PAGES, steps: int = STEPS) -> np.ndarray:
    """Weights fitted in one task on the picked pages: those with the least hashes."""

    def fit(batches):
        sources = [x for b in batches for x in b.column("html").to_pylist()]
        found, labels = labelled_pages(sources)
        weights = html_model.train(html_model.Forest(found), np.array([y for page in labels for y in page], np.int64), steps)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tolist()]}, pa.schema([("weights", pa.list_(pa.float64()))]))

    rows = pages.select(whole_text("html").alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    picked = rows.orderBy(F.xxhash64("html"), "html").limit(at_most)
    found = picked.mapInArrow(fit, "weights array<double>").collect()
    return np.array(found[0]["weights"]) if found else html_model.start_weights()


def main_texts(sources: list[str], weights: np.ndarray) -> list[str]:
    """The main text of each page; a text is kept by its own probability."""
    pages = [Page(s) for s in sources]
    forest = html_model.Forest(pages)
    sure = html_model.sum_product(forest, weights)[1][:, 1] >= AT_LEAST
    return [blocks_text(p, sure[a:b].tolist()) for p, a, b in zip(pages, forest.first[:-1], forest.first[1:])]


def extract(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html).

    White space of a block becomes single spaces, blocks are joined by line breaks; a ``br`` is
    white space. A null or empty page, or one without content, has an empty text. Null ids and
    urls, and repeated rows, stay as they are; further columns play no part; an empty table
    gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # of fixed size
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in text_slices(batches, "html"):
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

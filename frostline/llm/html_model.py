"""A graphical model on the tree of a page: which nodes are main content.

Every node has a label, content or not. Its own evidence (tag, words in its class and id, how
much text it holds and how much of that is linked) gives a score for content; every edge has a
potential per kind of child, labels of parent and child. Sums of products are passed up the tree
and down again, which gives the exact probability of each label on a tree. All pages of a batch
are one forest, worked through level by level with array operations.

Weights maximise the likelihood of labelled pages; the gradient is the difference of observed
counts and those the marginals expect.
"""

from __future__ import annotations

import re

import numpy as np

from frostline.llm.html_tree import TEXT, Page, attributes

# Tags told apart, and words of class, id and role that name a part of a page.
TAGS = (
    "#page html body #text article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre "
    "figure figcaption header footer nav aside form label fieldset a span b strong i em address details center ins other"
).split()
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar banner branding logo",
    "footer": "footer copyright colophon legal contentinfo imprint",
    "side": "sidebar aside widget related rail recommended complementary trending popular",
    "notice": "cookie cookies consent notice alert gdpr popup modal warning disclaimer toast",
    "advert": "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion",
    "form": "form newsletter subscribe search login signup signin poll",
    "comment": "comment comments commentlist disqus reply replies respond discussion reviews reader",
    "share": "share social sharing tags byline meta",
    "content": "article content post entry main story text articlebody body-text prose",
}
TAG_NO = {t: i for i, t in enumerate(TAGS)}
HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
_WORDS = re.compile(r"[a-z]+")

# Groups of features: each node has one feature of every group, and any of the hints.
CHARS = (1, 25, 80, 250, 1000)
LINKED = (0.001, 0.3, 0.7)
SHARE = (0.02, 0.1, 0.3, 0.6)
STOPS = (0.001, 0.04)
_GROUPS = [len(TAGS), len(CHARS) + 1, len(LINKED) + 1, len(SHARE) + 1, len(STOPS) + 1]
_FIRST = np.concatenate([[0], np.cumsum(_GROUPS)])
HINT_FIRST = int(_FIRST[-1])
N_FEATURES = HINT_FIRST + len(HINTS) + 1  # the last one is always there
EDGES = ("text", "inline", "block", "part")
PARTS = set("#page html body article main section div header footer nav aside form fieldset details".split())
INLINE = set("a span b strong i em ins label".split())
N_WEIGHTS = N_FEATURES + 4 * len(EDGES)


def _edge(tag: str) -> int:
    return 0 if tag == TEXT else 3 if tag in PARTS else 1 if tag in INLINE or tag not in TAG_NO else 2


def hint_bits(raw: str) -> int:
    if not raw:
        return 0
    named = attributes(raw)
    words = _WORDS.findall(" ".join(named.get(k, "") for k in ("class", "id", "role")).lower())
    bits = 0
    for w in words:
        if w in HINT_OF:
            bits |= 1 << HINT_OF[w]
    return bits


class Forest:
    """The nodes of several pages: features, edges, and their order by depth."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        shift = np.repeat(self.first[:-1], sizes)
        parent = np.concatenate([np.zeros(0, np.int64), *(np.array(p.parent, np.int64) for p in pages)])
        self.parent = np.where(parent < 0, -1, parent + shift)
        end = np.concatenate([np.zeros(0, np.int64), *(np.array(p.end, np.int64) for p in pages)]) + shift
        n = len(self.parent)
        flat = [(t, x, link, raw) for p in pages for t, x, link, raw in zip(p.tag, p.text, p.linked, p.raw)]
        tag = np.array([TAG_NO.get(t, len(TAGS) - 1) for t, *_ in flat], np.int64)
        self.edge = np.array([_edge(t) for t, *_ in flat], np.int64)
        own = np.array([len(x.strip()) if x else 0 for _, x, *_ in flat], np.float64)
        stop = np.array([sum(map(x.count, ".!?")) if x else 0 for _, x, *_ in flat], np.float64)
        word = np.array([x.count(" ") + 1 if x else 0 for _, x, *_ in flat], np.float64)
        linked = own * np.array([link for _, _, link, _ in flat], np.float64)
        bits = np.array([hint_bits(raw) for *_, raw in flat], np.int64)
        inside = [self._inside(v, end) for v in (own, linked, stop, word)]
        chars, links, stops, words = inside
        page = np.repeat(np.maximum(chars[self.first[:-1]], 1), sizes) if n else chars
        cuts = [
            tag,
            np.searchsorted(CHARS, chars, "right"),
            np.searchsorted(LINKED, links / np.maximum(chars, 1), "right"),
            np.searchsorted(SHARE, chars / page, "right"),
            np.searchsorted(STOPS, stops / np.maximum(words, 1), "right"),
        ]
        self.features = np.stack([c + _FIRST[k] for k, c in enumerate(cuts)], axis=1)
        hinted = [np.flatnonzero(bits >> k & 1) for k in range(len(HINTS))]
        self.hinted = np.concatenate(hinted)  # nodes with a hint, and its feature
        self.hint = np.repeat(np.arange(len(HINTS)) + HINT_FIRST, [len(h) for h in hinted])
        self.levels = self._levels()

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = weights[self.features].sum(axis=1) + weights[N_FEATURES - 1]
        return out + np.bincount(self.hinted, weights[self.hint], len(out))

    def counts(self, share: np.ndarray) -> np.ndarray:
        """Sum of the features over all nodes, each counted by its share."""
        out = np.zeros(N_FEATURES)
        for k in range(self.features.shape[1]):
            out += np.bincount(self.features[:, k], share, N_FEATURES)
        out += np.bincount(self.hint, share[self.hinted], N_FEATURES)
        out[-1] = share.sum()
        return out

    @staticmethod
    def _inside(values: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[:-1]

    def _levels(self) -> list[np.ndarray]:
        depth = [0] * len(self.parent)
        for i, p in enumerate(self.parent.tolist()):  # parents come first
            if p >= 0:
                depth[i] = depth[p] + 1
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    """log(exp(x) + exp(y)) of the two entries along an axis."""
    return np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))


def sum_product(forest: Forest, weights: np.ndarray):
    """(log of the sum over all labellings, marginals (n, 2), edge marginals (n, 2, 2)).

    Edge marginals are by labels of parent and child; those of roots are zero.
    """
    n = len(forest.parent)
    local = np.stack([np.zeros(n), forest.scores(weights)], axis=1)
    theta = weights[N_FEATURES:].reshape(len(EDGES), 2, 2)[forest.edge]
    below = local.copy()  # evidence of a node and of everything under it
    up = np.zeros((n, 2))  # message to the parent, by the parent's label
    for level in reversed(forest.levels[1:]):
        up[level] = _log_sum(theta[level] + below[level][:, None, :], 2)
        at = forest.parent[level]
        family = np.flatnonzero(np.diff(at, prepend=-1))  # a level is in page order: children lie together
        below[at[family]] += np.add.reduceat(up[level], family)
    roots = forest.levels[0] if forest.levels else np.zeros(0, np.int64)
    total = float(_log_sum(below[roots], 1).sum()) if n else 0.0
    full, pairs = below.copy(), np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        p = forest.parent[level]
        joint = (full[p] - up[level])[:, :, None] + theta[level]
        full[level] = below[level] + _log_sum(joint, 1)
        joint = joint + below[level][:, None, :]
        pairs[level] = np.exp(joint - _log_sum(_log_sum(joint, 2), 1)[:, None, None])
    return total, np.exp(full - _log_sum(full, 1)[:, None]) if n else full, pairs


def start_weights() -> np.ndarray:
    """Weights before training, to which the fit is drawn where labelled pages say nothing."""
    w = np.zeros(N_WEIGHTS)
    for name, value in (("article", 2), ("main", 2), ("nav", -3), ("header", -1), ("footer", -2), ("aside", -2), ("form", -2)):
        w[TAG_NO[name]] = value
    for k, name in enumerate(HINTS):
        w[HINT_FIRST + k] = 1.5 if name == "content" else -2
    w[N_FEATURES:] = np.tile([1.0, -1.0, -1.0, 1.0], len(EDGES))
    return w


def train(forest: Forest, labels: np.ndarray, steps: int = 150, rate: float = 0.1, pull: float = 2e-6) -> np.ndarray:
    """Weights by Adam on the likelihood per node, with a pull towards the start."""
    start = start_weights()
    w, n = start.copy(), len(labels)
    if not n:
        return w
    child = np.flatnonzero(forest.parent >= 0)
    seen = forest.counts(labels.astype(float))
    pair_no = forest.edge[child] * 4 + labels[forest.parent[child]] * 2 + labels[child]
    seen_pairs = np.bincount(pair_no, minlength=4 * len(EDGES)).astype(float)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, marginal, pairs = sum_product(forest, w)
        want_pairs = [np.bincount(forest.edge[child], pairs[child, a, b], len(EDGES)) for a in (0, 1) for b in (0, 1)]
        want_pairs = np.stack(want_pairs, axis=1).reshape(-1)
        grad = np.concatenate([seen - forest.counts(marginal[:, 1]), seen_pairs - want_pairs]) / n - pull * (w - start)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w

"""Pages as trees of elements and texts, in flat lists that are cheap to compute with."""

from __future__ import annotations

import html
import re

# Fixed values of HTML: elements without content, elements whose content is no markup, elements
# that start a block of text, and what an opening tag closes that was left open.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in "script style textarea title xmp iframe noembed noframes".split()}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option "
    "p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_PARAGRAPH = BLOCKS - {"button", "caption", "head", "html", "body", "legend", "optgroup", "option", "select", "svg", "td", "th", "tr"}
# Text in these is never shown as text of a page.
UNSEEN = {"head", "noscript", "template", "svg", "button", "select", "datalist", "object", "canvas", "audio", "video"}
TEXT = "#text"

_TOKEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|!--|[!?/][^>]*+>)")
_UNENDED = re.compile(r"<[A-Za-z!?/]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


class Page:
    """Nodes in page order: ``parent`` (-1 for the root), ``tag``, ``end`` (one past the last
    node inside), ``raw`` attributes; for texts ``text``, ``block`` and ``linked``."""

    def __init__(self, source: str):
        self.parent, self.tag, self.end, self.raw = [-1], ["#page"], [0], [""]
        self.text, self.block, self.linked = [None], [0], [False]
        self._open, self._count = [0], {"#page": 1}
        self._blocks_open: list[int] = []  # depths of open blocks
        self._at_block, self._break, self._unseen = 0, False, 0
        self._read(source)
        while self._open:
            self.end[self._open.pop()] = len(self.tag)

    def _read(self, source: str) -> None:
        at, size, quotes = 0, len(source), True
        last = source.rfind(">")  # a tag that begins after it never ends, and is dropped
        while at < size:
            m = _TOKEN.search(source, at) if at <= last else _UNENDED.search(source, at)
            if m is None:
                return self._put_text(source[at:])
            if m.start() > at:
                self._put_text(source[at : m.start()])
            at = m.end()
            if m.re is _UNENDED:
                return
            if m[2] is None:
                if m[0] == "<!--":
                    stop = source.find("-->", at)
                    at = size if stop < 0 else stop + 3
                continue
            name, raw = m[2].lower(), m[3]
            if m[1]:
                self._close(name)
                continue
            if quotes and raw and (raw.count('"') % 2 or raw.count("'") % 2):  # a > inside a value
                mark = '"' if raw.count('"') % 2 else "'"
                stop = source.find(mark, at)
                quotes = stop >= 0
                after = source.find(">", stop) if quotes else -1
                if after >= 0 and "<" not in source[at:stop]:
                    raw, at = source[m.start(3) : after], after + 1
            self._start(name, raw)
            if name in RAW:
                end = RAW[name].search(source, at)
                if end is None:
                    return
                at = end.start()

    def _add(self, tag: str, raw: str, text: str | None) -> int:
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.end.append(len(self.tag))
        self.raw.append(raw)
        self.text.append(text)
        self.block.append(self._at_block)
        self.linked.append(self._count.get("a", 0) > 0)
        return len(self.tag) - 1

    def _put_text(self, text: str) -> None:
        if self._unseen:
            return
        text = html.unescape(text) if "&" in text else text
        self._add(TEXT, "", "\n" + text if self._break else text)
        self._break = False

    def _pop(self) -> None:
        n = self._open.pop()
        name = self.tag[n]
        self.end[n] = len(self.tag)
        self._count[name] -= 1
        if name in UNSEEN:
            self._unseen -= 1
        if name in BLOCKS:
            self._blocks_open.pop()
            self._at_block, self._break = self._at_block + 1, False

    def _close(self, name: str) -> None:
        if not self._count.get(name):
            if name in BLOCKS:
                self._at_block, self._break = self._at_block + 1, False
            return
        if name not in BLOCKS:  # an inline element doesn't end the blocks inside it
            inner = self._blocks_open[-1] if self._blocks_open else 0
            k = len(self._open) - 1
            while k > inner and self.tag[self._open[k]] != name:
                k -= 1
            if k <= inner:
                return
        while self.tag[self._open[-1]] != name:
            self._pop()
        self._pop()

    def _start(self, name: str, raw: str) -> None:
        if name in ENDS_PARAGRAPH and self._count.get("p"):
            self._close("p")
        if name == "a" and self._count.get("a"):
            self._close("a")
        if name in CLOSES:
            ends, walls = CLOSES[name]
            while any(self._count.get(n) for n in ends):
                top = next((t for t in (self.tag[n] for n in reversed(self._open)) if t in ends or t in walls), None)
                if top is None or top in walls:
                    break
                self._close(top)
        if name == "br":
            self._break = True
        if name == "hr":
            self._at_block += 1
        if name in VOID:
            return
        if name in BLOCKS:
            self._at_block, self._break = self._at_block + 1, False
            self._blocks_open.append(len(self._open))
        n = self._add(name, raw, None)
        self._open.append(n)
        self._count[name] = self._count.get(name, 0) + 1
        if name in UNSEEN:
            self._unseen += 1


def blocks_text(page: Page, kept) -> str:
    """The kept text nodes: white space of a block as single spaces, one block per line."""
    out, parts, block = [], [], None
    for n, text in enumerate(page.text):
        if text is not None and kept[n]:
            if page.block[n] != block:
                out.append(" ".join("".join(parts).split()))
                parts, block = [], page.block[n]
            parts.append(text)
    out.append(" ".join("".join(parts).split()))
    return "\n".join(x for x in out if x)

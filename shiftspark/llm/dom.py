"""A small, forgiving HTML reader: elements, their parents and the text between tags.

Tags that are never closed, or closed twice, and files that end anywhere are
read as browsers do: a new paragraph ends the open one, an end tag closes what
is open inside its element, a comment or a script without an end takes the rest,
and a tag cut off by the end of the file is dropped.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option
p pre section select summary table tbody td textarea tfoot th thead title tr ul""".split())
ENDS_P = BLOCK - frozenset("body br head html noscript optgroup option script select style tbody td template textarea tfoot th thead title tr".split())
#: An open element of these ends when one of its list begins, unless an element of the last list lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
_P_STOPS = frozenset({"table", "td", "th", "button", "object", "template"})
#: An end tag of an inline element doesn't close these.
_BOUNDS = frozenset("article aside body div footer form header html main nav section table td th".split())
_P_BOUNDS = _P_STOPS | _BOUNDS

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label|itemprop|data-y)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


@dataclass
class Page:
    """Elements in page order (0 is the page itself) and text pieces as (element, text)."""
    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    text: list[tuple[int, str]] = field(default_factory=list)


class _Open:
    """The open elements, outermost first; where those of a name stand is known, so no tag walks them."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], ["#page"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.nodes) > depth:
            self.places[self.names.pop()].pop()
            self.nodes.pop()

    def last(self, names: Iterable[str]) -> int:
        """Depth of the innermost element of these names; 0 without one."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def first_after(self, names: Iterable[str], depth: int) -> int:
        """Depth of the outermost element of these names inside ``depth``; 0 without one."""
        found = []
        for n in names:
            at = self.places.get(n, ())
            k = bisect_right(at, depth)
            if k < len(at):
                found.append(at[k])
        return min(found, default=0)


def attributes(raw: str) -> dict[str, str]:
    """The attributes that describe an element's role."""
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)}


def parse(html: str | None) -> Page:
    page = Page()
    if not html:
        return page
    text = page.text
    open_ = _Open()
    i, n = 0, len(html)
    while i < n:
        j = html.find("<", i)
        if j < 0:
            j = n
        if j > i:
            text.append((open_.nodes[-1], html[i:j]))
        if j >= n:
            break
        m = _TAG.match(html, j)
        if m is None:
            nxt = html[j + 1:j + 2]
            if nxt == "!" or nxt == "?" or nxt == "/" and not html[j + 2:j + 3].isalpha():
                if html.startswith("<!--", j):
                    k = j + 4 if html.startswith((">", "->"), j + 4) else html.find("-->", j + 4)
                    end = html.find(">", k) + 1 if k >= 0 else n
                else:
                    end = html.find(">", j) + 1 or n
                i = end or n
            elif nxt.isalpha() or nxt == "/":
                end = html.find(">", j) + 1          # quotes that never close; or cut off
                if not end:
                    break
                m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", html[j:end])
                if m is None:
                    i = end
                    continue
                i = _element(page, open_, html, m, end)
            else:
                text.append((open_.nodes[-1], "<"))
                i = j + 1
            continue
        i = _element(page, open_, html, m, m.end())
    return page


def _element(page: Page, open_: _Open, html: str, m: re.Match, end: int) -> int:
    """Take one tag; where reading goes on."""
    name = m[2].lower()
    if m[1]:
        at = open_.last((name,))
        if not at and name in ("br", "p"):
            _add(page, open_, name, "", False)
        elif at and (name in BLOCK or open_.last(_BOUNDS) <= at):
            open_.cut(at)
        return end
    if name in ENDS_P:
        at = open_.last(("p",))
        if at > open_.last(_P_BOUNDS):
            open_.cut(at)
    if name in CLOSES:
        ends, stops = CLOSES[name]
        at = open_.first_after(ends, open_.last(stops))
        if at:
            open_.cut(at)
    raw = m[3]
    _add(page, open_, name, raw, name not in VOID and not (raw.endswith("/") and name not in BLOCK))
    if name in RAW:
        close = re.compile(f"</{name}[\\s/>]", re.I).search(html, end)
        stop = close.start() if close else len(html)
        if stop > end:
            page.text.append((len(page.tag) - 1, html[end:stop]))
        return stop
    return end


def _add(page: Page, open_: _Open, name: str, raw: str, stays: bool) -> None:
    page.tag.append(name)
    page.parent.append(open_.nodes[-1])
    page.attrs.append(raw)
    # A place where words part, even if the element has no text.
    if name in BLOCK:
        page.text.append((len(page.tag) - 1, ""))
    if stays:
        open_.push(len(page.tag) - 1, name)


def joined(page: Page, keep) -> str:
    """Text of the elements for which ``keep`` (a sequence of truth values) is true.

    Character references are decoded; a run of white space, also between blocks,
    is one space; inline elements do not part words.
    """
    blocks = _block_of(page)
    out: list[str] = []
    last = -1
    for node, t in page.text:
        if blocks[node] != last or not t:
            out.append(" ")
            last = blocks[node]
        if t and keep[node]:
            out.append(entities.unescape(t) if "&" in t else t)
    return " ".join("".join(out).split())


def _block_of(page: Page) -> list[int]:
    """The nearest block element around each element, or itself."""
    out = [0] * len(page.tag)
    for i in range(1, len(out)):
        out[i] = i if page.tag[i] in BLOCK else out[page.parent[i]]
    return out


NOT_SHOWN = frozenset("script style noscript template head title iframe xmp noembed noframes textarea select option svg".split())


def visible_text(html: str | None) -> str:
    """All text that a reader sees, without markup; empty for null."""
    page = parse(html)
    shown = [True] * len(page.tag)
    for i in range(1, len(shown)):
        shown[i] = shown[page.parent[i]] and page.tag[i] not in NOT_SHOWN
    return joined(page, shown)

"""Main text of a page by a tree-structured graphical model of its elements.

Every element has one of three states: boilerplate, content, or mixed (it only
holds both, like the body).  The model has one factor for each element, from its
tag, its class and id words, how much of its text is links, how long its text is
and so on, and one for each pair of parent and child.  Messages pass up from the
leaves to the root and down again (sum-product); on a tree the resulting
marginals are exact.  The text of elements whose boilerplate marginal is below
one half is kept.

Both factors are learned from labelled pages, which ``labelled_pages`` writes
from a grammar of page layouts: ``pages`` of them (a bound of the fit).  Element
factors are a multinomial logistic regression, pair factors the smoothed
log-ratio of joint and independent frequencies of the states.

Messages of all pages of a batch pass together, level by level of the trees.
Null and empty html gives empty text; so does a page without content.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.common import map_batches, read_table
from shiftspark.llm.dom import Page, attributes, joined, parse

BOILERPLATE, CONTENT, MIXED = 0, 1, 2
#: Never content, whatever the model says: what no reader sees, and form controls (a form itself may hold the whole page).
NEVER = frozenset("script style noscript template head title iframe xmp noembed noframes textarea select option button svg input label nav".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def features(page: Page) -> list[list[str]]:
    """Names of the features that hold for each element."""
    n = len(page.tag)
    own, links, stops, copy = [0] * n, [0] * n, [0] * n, [False] * n
    in_link = [False] * n
    kids = [0] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parent[i]] or page.tag[i] == "a"
        kids[page.parent[i]] += 1
    for node, t in page.text:
        t = t.strip()
        if t and page.tag[node] not in NEVER:
            own[node] += len(t)
            if in_link[node]:
                links[node] += len(t)
            stops[node] += t.count(". ") + t.count(", ") + t.endswith((".", "!", "?"))
            copy[node] = copy[node] or "&copy;" in t or "©" in t
    direct = own[:]
    total, linked, ends = own[:], links, stops
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        total[p] += total[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
    out = []
    named: list[frozenset] = []          # words of the class, id, role ... of each element
    for i in range(n):
        tag, p = page.tag[i], page.parent[i]
        hidden, own_words = False, set()
        if page.attrs[i]:
            a = attributes(page.attrs[i])
            for k in ("class", "id", "role", "aria-label", "itemprop"):
                if k in a:
                    own_words.update(_WORD.findall(_CAMEL.sub(" ", a[k]).lower()))
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "")
        named.append(frozenset(own_words))
        f = ["any", f"tag={tag}", f"own={_bin(direct[i], (1, 20, 60, 200))}", f"len={_bin(total[i], (1, 30, 100, 300, 1000))}",
             f"link={_bin(linked[i] / max(1, total[i]), (0.01, 0.3, 0.7))}", f"stops={_bin(ends[i], (1, 3, 10))}",
             f"kids={_bin(kids[i], (1, 3, 10))}"]
        if p >= 0:
            f += [f"up={page.tag[p]}", f"in={page.tag[p]}>{tag}"]
        if copy[i]:
            f.append("copyright")
        if tag in ("h1", "p", "article", "main", "section", "div", "td", "form"):
            f.append(f"{tag}len={_bin(total[i], (1, 30, 100, 300))}")
        f += ["w=" + w for w in own_words]
        if hidden:
            f.append("hidden")
        if p >= 0:
            f += ["upw=" + w for w in named[p]]
            if page.parent[p] >= 0:
                f.append("upup=" + page.tag[page.parent[p]])
                f += ["upupw=" + w for w in named[page.parent[p]]]
        out.append(f)
    return out


@dataclass
class TreeModel:
    names: dict[str, int]
    weight: np.ndarray                   # features x states
    pair: np.ndarray                     # parent state x child state, log

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """Of every element of every page, the probability of each state."""
        ids, count, parent, size = [], [], [], []
        base = 0
        for page in pages:
            for f in features(page):
                known = [self.names[x] for x in f if x in self.names]
                ids += known
                count.append(len(known))
            parent += [base + p if p >= 0 else -1 for p in page.parent]
            size.append(len(page.tag))
            base += len(page.tag)
        up = np.array(parent)
        owner = np.repeat(np.arange(base), count)
        unary = np.stack([np.bincount(owner, self.weight[ids, s], base) for s in range(3)], 1)
        split = np.cumsum(size)[:-1]
        return np.split(sum_product(unary, self.pair, up), split)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(unary: np.ndarray, pair: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Exact marginals on a forest; ``parent`` comes before its children, -1 for roots."""
    n = len(parent)
    depth = np.zeros(n, np.int64)
    for i in range(n):
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    inside = unary.astype(float).copy()          # own factor and what the children say
    told = np.zeros_like(inside)                 # what each child told its parent
    for level in reversed(levels[1:]):
        told[level] = _lse(inside[level][:, None, :] + pair[None], 2)
        np.add.at(inside, parent[level], told[level])
    belief = inside.copy()
    for level in levels[1:]:
        p = parent[level]
        belief[level] += _lse((belief[p] - told[level])[:, :, None] + pair[None], 1)
    belief -= _lse(belief, 1)[:, None] if n else 0
    return np.exp(belief)


# --- labelled pages ---------------------------------------------------------

_ROLES = {
    "nav": ("nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu pagination pager toc links", ("nav", "div", "ul", "div")),
    "header": ("header masthead topbar banner site logo branding head title top hero", ("header", "div", "header")),
    "footer": ("footer copyright bottom legal colophon foot credits", ("footer", "div", "footer")),
    "aside": ("sidebar side aside widget related popular trending recommended rail more tags toplist archive", ("aside", "div", "section", "aside")),
    "notice": ("cookie cookies consent notice gdpr alert popup modal newsletter subscribe privacy warning message overlay paywall announcement disclaimer", ("div", "section", "aside", "p")),
    "ad": ("ad ads advert advertisement sponsored sponsor promo promoted adsense adsbygoogle adbox commercial banner partner", ("div", "aside", "section", "p", "ins", "span")),
    "form": ("search login signup subscribe form contact newsletter register poll", ("form", "form", "div")),
    "comments": ("comments comment commentlist replies reply discussion respond disqus responses thread reader readers feedback reviews", ("section", "div", "ol", "div", "ul", "aside")),
    "share": ("share social sharing follow buttons tools print", ("div", "ul", "p")),
    "hidden": ("hidden offscreen template", ("div", "noscript", "template")),
}
_MAIN = "content main article post entry body story text page single maincontent articlebody postbody entrycontent prose"
_WRAP = "wrapper container page site outer layout row grid wrap app root inner column col"


class _Writer:
    """Writes one random page; ``data-y`` holds each element's state."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        w = ["".join(r.choice("aeionrtsldmu") for _ in range(r.randint(1, 9))) for _ in range(max(1, n))]
        for i in range(len(w)):
            if r.random() < 0.1:
                w[i] += r.choice(".,.,!?")
        return " ".join(w).capitalize()

    def el(self, tag: str, y: int, inner: str, names: str = "", chance: float = 0.5) -> str:
        r, a = self.r, ""
        if names and r.random() < chance:
            w = r.choice(names.split())
            a = f' {r.choice(("class", "id", "class"))}="{w if r.random() < 0.6 else w + r.choice("-_ ") + r.choice(("box", "list", "area", "item", "block", w))}"'
        return f'<{tag} data-y="{y}"{a}>{inner}</{tag}>'

    def inline(self, text: str, y: int) -> str:
        r = self.r
        if r.random() < 0.35:
            k = r.choice(("a", "b", "i", "em", "strong", "span", "code", "a"))
            href = ' href="/x"' if k == "a" else ""
            extra = f'<{k} data-y="{y}"{href}>{self.words(r.randint(1, 4))}</{k}>'
            text = r.choice((f"{text} {extra}", f"{extra} {text}", f"{text} {extra} {self.words(5)}."))
        return text + (f'<br data-y="{y}">' if r.random() < 0.1 else "")

    def links(self, y: int, n: int) -> str:
        a = [f'<a data-y="{y}" href="/x">{self.words(self.r.randint(1, 3))}</a>' for _ in range(n)]
        if self.r.random() < 0.6:
            return self.el("ul", y, "".join(self.el("li", y, x) for x in a))
        return self.r.choice((" ", " | ", "")).join(a)

    def role(self, role: str) -> str:
        r = self.r
        names, tags = _ROLES[role]
        tag = r.choice(tags)
        sure = tag in ("div", "section", "p", "ul", "ol", "span", "ins")
        # What stands around an article can be as long as its paragraphs.
        n_words = lambda a, b: r.randint(20, 120) if r.random() < 0.3 else r.randint(a, b)
        para = lambda a, b: self.el("p", 0, self.inline(self.words(n_words(a, b)), 0))
        if role == "nav":
            plain = r.random() < 0.15
            items = [self.words(n_words(1, 5)) if plain else f'<a data-y="0" href="/x">{self.words(r.randint(1, 3))}</a>' for _ in range(r.randint(1, 9))]
            inner = "".join(self.el("li", 0, x) for x in items) if tag == "ul" else self.links(0, r.randint(2, 9))
        elif role == "header":
            inner = r.choice((self.el("h1", 0, self.words(r.randint(1, 6))), self.el("p", 0, self.words(r.randint(1, 12))), self.words(r.randint(1, 8)),
                              self.el("span", 0, self.words(3)), self.role("nav"), self.el("h2", 0, self.words(4)) + self.links(0, 3)))
        elif role == "footer":
            inner = r.choice((f"&copy; {self.words(r.randint(1, 25))}", para(2, 25), self.words(n_words(2, 30)), self.links(0, 4) + self.words(4), f"{self.words(5)} &middot; {self.words(12)}"))
        elif role == "aside":
            inner = r.choice((self.el("h3", 0, self.words(2)) + self.links(0, r.randint(1, 6)), para(3, 40), self.words(n_words(2, 25)), para(5, 30) + para(5, 30),
                              self.el("ul", 0, self.el("li", 0, self.words(n_words(2, 20))) + self.el("li", 0, self.words(n_words(2, 20))))))
        elif role == "form":
            inner = f'<label data-y="0">{self.words(2)}</label><input data-y="0" name="q"><button data-y="0">{self.words(1)}</button>' + (para(2, 15) if r.random() < 0.4 else "")
        elif role == "comments":
            one = lambda: self.el(r.choice(("div", "li", "article", "p")), 0, r.choice((
                para(2, 40), self.el("span", 0, self.words(2)) + para(2, 40), self.words(r.randint(2, 30)), self.el("b", 0, self.words(1)) + " " + self.words(15))), "comment reply author response", 0.6)
            inner = (self.el("h3", 0, self.words(2)) if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 5)))
        elif role == "share":
            inner = self.links(0, r.randint(1, 5))
        else:
            inner = r.choice((self.words(n_words(1, 30)), para(2, 40), para(2, 40) + para(2, 40), para(3, 20) + f'<button data-y="0">{self.words(1)}</button>', f'<a data-y="0" href="/x">{self.words(5)}</a>'))
        return self.el(tag, 0, inner, names, 1.0 if sure or tag == "aside" and role != "aside" else 0.4)

    def article(self) -> str:
        r, parts = self.r, []
        if r.random() < 0.7:
            title = self.el(r.choice(("h1", "h1", "h2")), 1, self.words(r.randint(1, 10)), "title headline entry", 0.3)
            parts.append(self.el("header", 1, title) if r.random() < 0.12 else title)
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            k = r.random()
            if k < 0.72:
                parts.append(self.el("p", 1, self.inline(self.words(r.choice((1, 2, 6, 20, 50, 120))), 1), "lead intro text first", 0.05))
            elif k < 0.80:
                parts.append(self.el(r.choice(("h2", "h3", "h4")), 1, self.words(r.randint(1, 7))))
            elif k < 0.87:
                linked = 0.9 if r.random() < 0.35 else 0.1      # a reading list, or a list that may hold a link
                parts.append(self.el(r.choice(("ul", "ol")), 1, "".join(
                    self.el("li", 1, f'<a data-y="1" href="/x">{self.words(r.randint(1, 6))}</a>' if r.random() < linked
                            else self.inline(self.words(r.randint(1, 20)), 1)) for _ in range(r.randint(1, 6)))))
            elif k < 0.91:
                parts.append(self.el("blockquote", 1, r.choice((self.el("p", 1, self.words(20)), self.words(20)))))
            elif k < 0.94:
                rows = "".join(self.el("tr", 1, "".join(self.el("td", 1, self.words(r.randint(1, 4))) for _ in range(3))) for _ in range(3))
                parts.append(self.el("table", 1, rows))
            elif k < 0.97:
                parts.append(self.el("figure", 1, '<img data-y="1" src="x">' + self.el("figcaption", 1, self.words(8))))
            else:
                parts.append(self.el(r.choice(("pre", "div", "section")), 1, self.words(25)))
            if r.random() < 0.12:
                parts.append(self.role(r.choice(("ad", "aside", "share", "notice", "form", "ad", "comments"))))
        if r.random() < 0.08:
            parts.append(self.role("footer"))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        inner = self.article()
        shape = r.random()
        if shape < 0.45:
            main = self.el("article", 1, inner, _MAIN, 0.3)
        elif shape < 0.62:
            main = self.el("main", 1, inner, _MAIN, 0.3)
        elif shape < 0.9:
            main = self.el(r.choice(("div", "section", "div")), 1, inner, _MAIN, 0.85)
        else:
            main = inner
        if r.random() < 0.25 and shape < 0.9:
            extra = "".join(self.role(r.choice(("comments", "aside", "share", "form"))) for _ in range(r.randint(0, 2)))
            main = self.el(r.choice(("main", "div")), 2 if extra else 1, main + extra, _MAIN + " " + _WRAP, 0.6)
        kinds = list(_ROLES)
        before = [self.role(k) for k in r.sample(["nav", "header", "ad", "notice", "form", "aside", "hidden", "share"], r.randint(0, 4))]
        after = [self.role(k) for k in r.sample([k for k in kinds if k != "header"], r.randint(0, 5))]
        body = "".join(before) + main + "".join(after)
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = self.el("div", 2, body, _WRAP, 0.8)
        if r.random() < 0.12:                    # one form around the whole page, as some servers write it
            state = '<input data-y="0" type="hidden" name="state" value="x">' * r.randint(0, 3)
            body = self.el("form", 2, state + body, "aspnetForm form1 mainform form Form pageform adminForm", 0.8)
            if r.random() < 0.3:
                body = self.el("div", 2, body, _WRAP, 0.8)
        if r.random() < 0.3:                     # markup as careless people write it
            body = re.sub(r"</(p|li)>", lambda m: m[0] if r.random() < 0.5 else "", body)
        return (f'<!DOCTYPE html><html data-y="2"><head data-y="0"><title data-y="0">{self.words(4)}</title>'
                f'<style data-y="0">p{{}}</style></head><body data-y="2">{body}<script data-y="0">x()</script></body></html>')


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[Page, np.ndarray]]:
    """``n`` pages of the layout grammar with the state of each element."""
    for k in range(n):
        page = parse(_Writer(seed * 1_000_003 + k).page())
        state = [MIXED]
        for i in range(1, len(page.tag)):
            m = re.search(r'data-y="(\d)"', page.attrs[i])
            state.append(int(m[1]) if m else state[page.parent[i]])
        yield page, np.array(state)


def train(pages: int = 1500, epochs: int = 250, l2: float = 1e-4, seed: int = 11) -> TreeModel:
    """Element factors by logistic regression, pair factors from counts."""
    names: dict[str, int] = {}
    ids, count, states, pair = [], [], [], np.ones((3, 3))
    marginal = np.ones(3)
    for page, y in labelled_pages(pages, seed):
        for f in features(page):
            got = [names.setdefault(x, len(names)) for x in f]
            ids += got
            count.append(len(got))
        states.append(y)
        up = np.array(page.parent)[1:]
        np.add.at(pair, (y[up], y[1:]), 1)
        np.add.at(marginal, y[1:], 1)
    y = np.concatenate(states)
    ids, owner = np.array(ids), np.repeat(np.arange(len(y)), count)
    w, grown = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-8)
    hot = np.eye(3)[y]
    for _ in range(epochs):
        z = np.stack([np.bincount(owner, w[ids, s], len(y)) for s in range(3)], 1)
        prob = np.exp(z - _lse(z, 1)[:, None])
        d = (prob - hot) / len(y)
        g = np.stack([np.bincount(ids, d[owner, s], len(names)) for s in range(3)], 1) + l2 * w / len(names)
        grown += g * g
        w -= 0.5 * g / np.sqrt(grown)
    joint = pair / pair.sum()
    of_child, of_parent = joint.sum(axis=0), joint.sum(axis=1)
    return TreeModel(names, w, np.log(joint / of_parent[:, None] / of_child[None]))


def extract(pages: list[str | None], model: TreeModel) -> list[str]:
    """Main text of each page."""
    parsed = [parse(h) for h in pages]
    out = []
    for page, prob in zip(parsed, model.marginals(parsed), strict=True):
        keep = (prob[:, BOILERPLATE] < 0.5).tolist()
        hidden = [False] * len(keep)
        for i in range(1, len(keep)):
            hidden[i] = hidden[page.parent[i]] or page.tag[i] in NEVER
            keep[i] = keep[i] and not hidden[i]
        out.append(joined(page, keep))
    return out


def extract_main_text(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars of every row, in one pass without a shuffle."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            text = extract(part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return (map_batches(rows, run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
            .withColumnsRenamed({"id": id_col, "url": url_col}))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_main_text(read_table(spark, sf_dir, "pages"), train())

"""The HTML reader takes time in proportion to the page, however its tags nest."""

import random
import time

import pytest

from shiftspark.llm import dom

NESTED = {
    "nested div, end of p": "<div></p>" * 110_000, "nested b, end of i": "<b></i>" * 150_000, "inline without ends": "<b>" * 200_000 + "</i>" * 200_000,
    "double quotes never closed": '<a "' * 250_000, "single quotes": "<a '>" * 200_000, "a name without end": "<" + "a" * 1_000_000,
    "tags in tags": "<a<" * 300_000, "paragraphs": "<p>" * 300_000, "list items": "<div><li>" * 110_000,
}


@pytest.mark.parametrize("page", NESTED.values(), ids=NESTED.keys())
def test_a_megabyte_of_nested_or_broken_tags(page):
    t = time.process_time()
    dom.visible_text(page)
    assert time.process_time() - t < 4


def outline(html):
    p = dom.parse(html)
    return [(t, p.tag[up]) for t, up in zip(p.tag[1:], p.parent[1:])]


def test_what_tags_close():
    assert outline("<div><p>a<p>b<div>c</p>") == [("div", "#page"), ("p", "div"), ("p", "div"), ("div", "div"), ("p", "div")]
    assert outline("<ul><li>a<ul><li>b</ul><li>c") == [("ul", "#page"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]
    assert outline("<table><tr><td>a<td>b<tr><td>c") == [("table", "#page"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert outline("<b><div></b><i>x") == [("b", "#page"), ("div", "b"), ("i", "div")]      # an inline end does not close a block
    assert outline("<b><i></b><u>x") == [("b", "#page"), ("i", "b"), ("u", "#page")]


def test_open_elements_are_found_by_name():
    r, names = random.Random(1), "abcd"
    o, plain = dom._Open(), ["#page"]
    for node in range(1, 3000):
        if r.random() < 0.6:
            n = r.choice(names)
            o.push(node, n)
            plain.append(n)
        else:
            k = r.randint(1, len(plain))
            o.cut(k)
            del plain[k:]
        some = r.sample(names, 2)
        assert o.last(some) == max((i for i, n in enumerate(plain) if n in some), default=0)
        depth = r.randint(0, len(plain))
        assert o.first_after(some, depth) == min((i for i, n in enumerate(plain) if n in some and i > depth), default=0)

"""Broken pages in linear time, inline hints, details, and layouts that training has not seen."""

import time

import pytest

from weftgraph.llm import html_extract, html_training
from weftgraph.llm.html_dom import parse


@pytest.mark.parametrize(
    "start, each, more",
    [
        ("", "<div>", "</section>"), ("<b><div>", "<i>", "</b>"), ("<section><table><tr><td>", "<div>", "</section>"), ("<ul><li><ul>", "<div>", "<li>"),
        ("", '<a x=">', '<a x="'), ("", "<a ", ""), ("", "<!--", ""), ("<table>", "<tr><td>", "</p>"), ("", "</", "<"),
    ],
)
def test_time_grows_with_the_page(start, each, more):
    times = []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        parse(start + each * n + more * n)
        times.append(time.perf_counter() - began)
    assert times[1] < 5 and times[1] < 40 * max(times[0], 0.02)


def test_end_tags_close_what_they_belong_to():
    shape = lambda page: [(b.tag, b.parent, [t for _, t in b.segments]) for b in parse(page)[1:]]
    assert shape("<div><p>a</section>b</div>c") == [("div", 0, []), ("p", 1, ["ab"])]
    assert shape("<b><div>x</b>y</div>") == [("div", 0, ["xy"])]
    assert shape("<div><table><tr><td>a</div>b</table>c") == [("div", 0, ["c"]), ("table", 1, []), ("tr", 2, []), ("td", 3, ["ab"])]
    assert shape("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("ul", 0, []), ("li", 1, ["a"]), ("ul", 2, []), ("li", 3, ["b"]), ("li", 3, ["c"]), ("li", 1, ["d"])]
    assert shape("<table><tr><td>a<tr><td>b<table><tr><td>c</table>d</table>") == [
        ("table", 0, []), ("tr", 1, []), ("td", 2, ["a"]), ("tr", 1, []), ("td", 4, ["b", "d"]), ("table", 5, []), ("tr", 6, []), ("td", 7, ["c"]),
    ]


def test_inline_elements_and_details():
    model = html_extract.default_model()
    page = (
        '<nav><a href=/>home</a></nav><article><p>One two three, four.</p><p>Keep <span style="display:none">gone</span>this, <span class="share">Share me now</span> and '
        '<a href=x class="link">that</a> <em class="x">too</em>.</p><details><summary>More on it.</summary><p>Prose in details goes on and on. It is long.</p></details></article>'
    )
    assert html_extract.main_texts([page], model) == ["One two three, four. Keep this, and that too. More on it. Prose in details goes on and on. It is long."]


@pytest.mark.parametrize("held", [(0, 1, 2), (8, 9)])
def test_layouts_that_training_lacks(held):
    model = html_extract.train(html_training.labelled_pages(500, layouts=[k for k in range(10) if k not in held]))
    wrong, total = html_extract.judged(html_training.labelled_pages(200, seed=77, layouts=held), model)
    assert wrong < 0.015 * total

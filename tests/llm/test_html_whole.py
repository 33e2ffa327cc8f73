"""Article text around and inside elements that are not plain HTML blocks."""

import pytest

from weftgraph.llm import html_extract
from weftgraph.llm.html_dom import parse

A, B = "The first part of it is here, and it goes on for a while.", "The second part follows, after the picture, and ends here."


def texts(page):
    return " ".join(t for _, t in sorted(s for b in parse(page) for s in b.segments))


@pytest.mark.parametrize("inner", ["<svg viewBox='0 0 1 1'/>", "<svg/>", "<math/>", "<svg>", "<svg><svg><text>no</text></svg>", "<object data=x>", "<canvas id=c>", "<noscript>", "<template>", "<svg><text>no</text><svg><text>no</text></svg><text>no</text></svg>", "<math><mspace/><annotation>no</annotation></math>"])
def test_no_article_text_is_lost(inner):
    page = f"<html><body><article><h1>Title</h1><p>{A}</p>{inner}<p>{B}</p></article><footer><p>(c) me</p></footer></body></html>"
    assert html_extract.main_texts([page], html_extract.default_model()) == [f"Title {A} {B}"]


def test_text_inside():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></math> holds</p>") == "so x=1 holds"
    assert [b.tag for b in parse("<p>so <math><mi>x</mi></math> holds</p>")] == ["#root", "p"]
    assert texts("<p>a</p><xmp>1 <b>&amp; 2</xmp><p>b</p>") == "a 1 <b>&amp; 2 b" and texts("<xmp>a <i>") == "a <i>"
    for name in ("object", "canvas", "noscript"):
        assert texts(f"<p>a</p><{name}><p>fallback</p></{name}><p>b</p>") == "a fallback b"
    assert texts("<script>x</script>a<style>y</style>b<svg><title>t</title></svg>c") == "abc"


@pytest.mark.parametrize("name", ["object", "canvas", "noscript", "xmp"])
def test_prose_inside_an_article_is_kept(name):
    inner = B if name == "xmp" else f"<p>{B}</p>"
    page = f"<html><body><article><h1>Title</h1><p>{A}</p><{name}>{inner}</{name}><p>{A}</p></article><footer><p>(c) me</p></footer></body></html>"
    assert html_extract.main_texts([page], html_extract.default_model()) == [f"Title {A} {B} {A}"]

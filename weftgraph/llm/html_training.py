"""Labelled pages from which the extraction model is trained, built from page layouts.

A block carries data-y="1" if it is content and "0" if not; blocks without it are as their parents.
The words are invented, so that the model learns structure and not vocabulary.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

_SYLLABLES = "ka lo mi ren ta su vel or an pi dor es ti gan hu ser wo la be ni".split()


class _Page:
    def __init__(self, seed: int, layouts: Sequence[int] | None = None) -> None:
        self.r, self.layouts = random.Random(seed), layouts

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, least: int = 5, most: int = 18) -> str:
        words = [self.word() + ("," if self.r.random() < 0.12 else "") for _ in range(self.r.randint(least, most))]
        return " ".join(words).capitalize().rstrip(",") + self.r.choice([".", ".", ".", "!", "?"])

    def odd(self) -> str:
        """Repeated words, words without punctuation, cells and symbols, as raw pages hold them."""
        words = [self.word() for _ in range(self.r.randint(1, 30))]
        mark = self.r.choice(["", "%%%", "!!", "***"])
        return self.some(" ".join([words[0]] * len(words)), " ".join(words), " | ".join(words), " ".join(w + mark for w in words), words[0].capitalize() + ".")

    def prose(self) -> str:
        if self.r.random() < 0.18:
            return self.odd()
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))
        if self.r.random() < 0.3:
            text = f'{text} <a href="/{self.word()}">{self.word()} {self.word()}</a> {self.sentence()}'
        if self.r.random() < 0.25:
            text = f"<b>{self.word()}</b> {text}"
        if self.r.random() < 0.06:
            text += f' <span class="{self.some("share", "ad", "promo", "related", "tags", "social", "sponsored")}" data-y="0">{self.some(self.sentence(1, 6), self.link())}</span>'
        return text

    def link(self) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, 3)))}</a>'

    def links(self, n: int | None = None) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n or self.r.randint(3, 9))) + "</ul>"

    def some(self, *options: str) -> str:
        return self.r.choice(options)

    # content ------------------------------------------------------------------
    def block(self) -> str:
        x = self.r.random()
        if x < 0.62:
            return f"<p>{self.prose()}</p>"
        if x < 0.68:
            return f"<p>{self.word()}.</p>"
        if x < 0.76:
            return f"<h{(k := self.r.randint(2, 4))}>{self.sentence(2, 6)}</h{k}>"
        if x < 0.83:
            items = "".join(f"<li>{self.sentence(2, 9)}</li>" for _ in range(self.r.randint(2, 5)))
            return self.some(f"<ul>{items}</ul>", f"<ol>{items}</ol>")
        if x < 0.88:
            return f"<blockquote><p>{self.prose()}</p></blockquote>"
        if x < 0.92:
            rows = "".join(f"<tr><th>{self.word()}</th><td>{self.sentence(2, 6)}</td></tr>" for _ in range(self.r.randint(2, 4)))
            return f"<table>{rows}</table>"
        if x < 0.95:
            return f"<figure><img src=x><figcaption>{self.sentence(3, 8)}</figcaption></figure>"
        if x < 0.97:
            return f"<pre>{self.sentence()}\n{self.sentence()}</pre>"
        return f"<div>{self.prose()}</div>"

    def content(self) -> str:
        body = [self.block() for _ in range(self.r.choice([0, 1, 2, 4, 7, 12]))]
        if self.r.random() < 0.5:
            body.insert(0, f"<p>{self.prose()}</p>")
        for _ in range(self.r.choice([0, 0, 0, 1, 2])):
            body.insert(self.r.randint(0, len(body)), self.inner_noise())
        if self.r.random() < 0.25 and len(body) > 3:
            body[1:3] = [f"<section>{''.join(body[1:3])}</section>"]
        if self.r.random() < 0.2:
            body = [f'<div class="{self.some("row", "inner", "wrap", "a1")}">{"".join(body)}</div>']
        title = self.some(f"<h1>{self.sentence(2, 8)}</h1>", f"<h1>{self.sentence(2, 8)}</h1>", f"<header><h1>{self.sentence(2, 8)}</h1></header>", f"<h2>{self.sentence(2, 8)}</h2>", "")
        inner = title + "".join(body)
        if not inner:
            inner = f"<p>{self.prose()}</p>"
        layouts = (
            f'<article data-y="1">{inner}</article>',
            f'<article data-y="1">{inner}</article>',
            f'<article class="post" data-y="1">{inner}</article>',
            f'<main><article data-y="1">{inner}</article></main>',
            f'<main data-y="1">{inner}</main>',
            f'<div class="{self.some("content", "article-body", "entry-content", "post-content", "story", "main-text")}" data-y="1">{inner}</div>',
            f'<div id="{self.some("content", "main", "article")}" data-y="1">{inner}</div>',
            f'<div role="main" data-y="1">{inner}</div>',
            f'<section data-y="1">{inner}</section>' if len(body) > 2 else f'<article data-y="1">{inner}</article>',
            f'<div data-y="1">{inner}</div>' if len(body) > 2 else f'<article data-y="1">{inner}</article>',
        )
        return self.some(*(layouts if self.layouts is None else [layouts[k] for k in self.layouts]))

    def inner_noise(self) -> str:
        return self.some(
            f'<div class="{self.some("ad", "advert", "sponsored", "promo", "ads")}" data-y="0">{self.some(self.sentence(), f"<p>{self.prose()}</p>")}</div>',
            f'<div class="{self.some("share", "social", "related", "share-buttons", "tags")}" data-y="0">{self.some(self.links(), self.link() + " " + self.link())}</div>',
            f'<aside data-y="0">{self.some(self.links(), f"<p>{self.prose()}</p>", self.sentence())}</aside>',
            f'<form data-y="0"><p>{self.sentence(3, 8)}</p><input name=x><button>{self.word()}</button></form>',
            f'<div class="newsletter" data-y="0"><p>{self.sentence()}</p></div>',
            f'<nav data-y="0">{self.links()}</nav>',
        )

    # the rest ------------------------------------------------------------------
    def comments(self) -> str:
        one = lambda: f'<{self.some("p", "div")}>{self.prose()}</p>'
        each = [self.some(f'<li class="comment"><p>{self.prose()}</p></li>', f'<div class="comment"><b>{self.word()}</b><p>{self.prose()}</p></div>', f"<article><p>{self.prose()}</p></article>", one()) for _ in range(self.r.randint(1, 5))]
        inner = f"<h3>{self.sentence(1, 3)}</h3>" * (self.r.random() < 0.6) + "".join(each)
        return self.some(
            f'<section class="comments" data-y="0">{inner}</section>',
            f'<div id="comments" data-y="0">{inner}</div>',
            f'<ol class="commentlist" data-y="0">{inner}</ol>',
            f'<div class="reader-comments" data-y="0">{inner}</div>',
            f'<div class="comment-section" data-y="0">{inner}</div>',
        )

    def around(self) -> tuple[str, str]:
        r, before, after = self.r, [], []
        text = lambda: self.some(self.sentence(), f"<p>{self.prose()}</p>", f"<p>{self.sentence()}</p>", self.links())
        before.append(self.some(f"<nav>{self.links()}</nav>", f'<div class="{self.some("menu", "navbar", "nav", "navigation")}">{self.links()}</div>', f'<ul class="menu">{self.links()}</ul>', f'<div id="nav">{self.link()} | {self.link()}</div>', f"<ul>{self.links()}</ul>", ""))
        if r.random() < 0.5:
            before.insert(0, self.some(f"<header>{self.sentence(1, 5)}</header>", f'<header><div class="logo">{self.word()}</div>{self.links(3)}</header>', f"<header><h1>{self.sentence(1, 3)}</h1><p>{self.sentence(3, 8)}</p></header>", f'<div class="header">{text()}</div>', f'<div id="header"><h2>{self.word()}</h2></div>'))
        if r.random() < 0.5:
            before.append(f'<div class="{self.some("ad", "ads", "advert", "banner-ad", "sponsor", "promo", "advertisement")}">{text()}</div>')
        if r.random() < 0.35:
            (before if r.random() < 0.5 else after).append(self.some(f'<div class="{self.some("cookie-notice", "notice", "consent", "alert", "cookie", "popup", "banner cookie")}">{text()}</div>', f'<div role="alert">{self.sentence()}</div>', f'<div id="cookie-banner"><p>{self.sentence()}</p><button>{self.word()}</button></div>', f"<dialog><p>{self.sentence()}</p></dialog>"))
        if r.random() < 0.4:
            (before if r.random() < 0.4 else after).append(self.some(f"<aside>{text()}{text()}</aside>", f'<div class="{self.some("sidebar", "side", "widget", "right-rail")}"><h3>{self.word()}</h3>{text()}</div>', f'<aside class="sidebar"><h2>{self.sentence(1, 3)}</h2>{self.links()}<p>{self.prose()}</p></aside>'))
        if r.random() < 0.3:
            (before if r.random() < 0.4 else after).append(self.some(f"<form><label>{self.sentence(1, 4)}</label><input><button>{self.word()}</button></form>", f'<form class="search"><p>{self.sentence(2, 6)}</p><select><option>{self.word()}<option>{self.word()}</select></form>', f'<div class="newsletter"><form><p>{self.prose()}</p></form></div>'))
        if r.random() < 0.25:
            after.append(f'<div class="{self.some("related", "share", "recommended", "social", "more")}"><h4>{self.word()}</h4>{self.links()}</div>')
        if r.random() < 0.4:
            after.append(self.comments())
        if r.random() < 0.85:
            after.append(self.some(f"<footer>&copy; {self.word()}.example &middot; {self.sentence()} {self.sentence()}</footer>", f"<footer><p>{self.sentence()}</p>{self.links(3)}</footer>", f'<div class="footer">{self.sentence()} {self.link()}</div>', f'<div id="footer"><p>&copy; {self.sentence()}</p></div>', f"<footer>{self.links()}<p>{self.prose()}</p></footer>"))
        return "".join(before), "".join(after)

    def page(self) -> str:
        before, after = self.around()
        middle = self.content()
        if self.r.random() < 0.3:
            middle = f'<div class="{self.some("container", "wrapper", "layout", "page", "x")}" data-y="0">{middle}</div>'
        body = f"{before}{middle}{after}"
        if self.r.random() < 0.2:
            body = f'<div id="{self.some("page", "wrap", "root")}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.sentence(2, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int = 700, seed: int = 1, layouts: Sequence[int] | None = None) -> list[str]:
    """n pages; `layouts` restricts them to some of the ten wrappers of content, to hold others out."""
    return [_Page(seed * 100_000 + k, layouts).page() for k in range(n)]

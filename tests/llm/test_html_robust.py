"""Broken markup takes time in proportion, and names of elements do not cost an article its text."""

import random
import re
import time
from html import unescape
from html.parser import HTMLParser

import pytest

from colonnade.llm import html


def said(page):
    return html.text_of(html.tree(page))


@pytest.mark.parametrize("piece", ["a <b ", "<a '", '<a "', "<b></i>x", "<a<a", "<", "</", "</a", "<!--", "<![CDATA[", "<a b=\"'", "<p><b>", "<b><div></div>", "<dt></dt><div>", "<i><div></i>", "<li><ul>", "<td>", "<script>", "<a href=x", "<a '\"", "&amp;&", "</b>"])
def test_broken_markup_is_read_in_proportion(piece):
    took = []
    for n in (1 << 18, 1 << 20):
        page = piece * (n // len(piece))
        start = time.process_time()
        list(html.candidates(html.tree(page)))
        took.append(time.process_time() - start)
        said(page)
    assert took[1] < 8 * took[0] + 1 and took[1] < 12, took


LONG = "This is running text of the article which says what it has to say in whole sentences."


@pytest.mark.parametrize("page", [
    *(f'<article><h2 id="{n}">Word</h2><p>{LONG}</p></article>' for n in ("ads", "related", "notice")),
    f'<article><h2>Word</h2><section class="login"><p>{LONG}</p></section></article>', f"<article><p>Word <label>x</label></p><p>{LONG}</p></article>", f"<article><p>Word <math><mi>x</mi></math></p><p>{LONG}</p></article>",
    f"<article><p>Word</p><noscript><p>{LONG}</p></noscript></article>",
    *(f'<body><div class="{n}"><h1>Word</h1><p>{LONG}</p></div></body>' for n in ("side-effects", "notice-of-award", "share-price-news", "content ad-free", "page login-enabled", "banner", "main header")),
    f'<div id="comment-on-policy"><p>Word</p><p>{LONG}</p></div>', f'<p>Word</p><div class="side-effects"><p>{LONG}</p></div>',
])
def test_names_do_not_cost_text(page):
    assert "Word" in said(page) and LONG in said(page)


@pytest.mark.parametrize("page", [
    f"<article><p>{LONG}</p>{{}}</article>", f"<div><p>{LONG}</p></div>{{}}",
])
@pytest.mark.parametrize("box", ['<div class="comments"><p>Gone gone, I like it very much and write at length about it here.</p></div>', '<div id="sidebar"><p>Gone</p></div>', '<div class="my-sidebar-x">Gone</div>', '<div class="share-buttons"><a href=x>Gone</a></div>', '<section class="related"><a href=x>Gone one</a> <a href=y>Gone two</a></section>', '<div class="ad">Gone</div>', '<div class="cookie-notice">Gone</div>', '<div role="search">Gone</div>', "<nav>Gone</nav>", "<form>Gone</form>"])
def test_what_is_not_the_article_goes(page, box):
    assert said(page.replace("{}", box)) == LONG


class Plain(HTMLParser):
    """Blocks of pages of known elements by the standard library's parser; classes in `off` are left out."""

    def __init__(self, off):
        super().__init__(convert_charrefs=False)
        self.off, self.depth, self.blocks, self.run = off, 0, [], []

    def flush(self):
        text = re.sub(r"\s+", " ", unescape("".join(self.run)).replace(" ", " ")).strip()
        self.blocks += [text] * bool(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if self.depth or tag in ("nav", "footer") or dict(attrs).get("class") in self.off:
            self.depth += 1
        elif tag not in ("a", "b", "i"):
            self.flush()

    def handle_endtag(self, tag):
        if self.depth:
            self.depth -= 1
        elif tag not in ("a", "b", "i"):
            self.flush()

    def handle_data(self, data):
        if not self.depth:
            self.run.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_pages_without_article_and_with_templates_equal_another_parser(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["&amp;", "&#233;", "a &lt; b", "&nbsp;"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def block(depth):
        kind = rng.choice(["p", "p", "div", "section", "ul", "h2"]) if depth else rng.choice(["p", "h2"])
        if kind in ("div", "section"):
            return f"<{kind}>" + "".join(block(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{text(4)}</li>" for _ in range(3)) + "</ul>"
        return f"<{kind}>{text(12)} <b>{text(2)}</b> <a href='/x'>{text(1)}</a></{kind}>"

    pages = []
    for i in range(60):
        host = f"http://h{i % 3}.example/{i}"
        top = f"<div class=top{i % 3}><span>Site {i % 3}</span><i>same on all pages</i></div>"
        own = "".join(block(2) for _ in range(rng.randrange(2, 6)))
        pages.append((i, host, f"<html><body>{top}<nav><ul><li>menu</li></ul></nav><div class='sidebar'><p>{text(5)}</p></div>{own}<div class='text side-effects'><p>{text(9)}</p></div><footer>{text(3)}</footer></body></html>"))
    pages.append((None, None, None))
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), keep=["page_id"]).collect()}
    assert got[None] == ""
    for i, _, page in pages[:-1]:
        p = Plain({"sidebar", f"top{i % 3}"})
        p.feed(page)
        p.close()
        p.flush()
        assert got[i] == "\n\n".join(p.blocks), page

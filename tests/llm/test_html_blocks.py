"""The line-block extractor against a slow reference, and pages that HTML allows."""

import re
from html.parser import HTMLParser

import pytest

from sitelens.llm import htmltext

CONTAINERS = {"div", "section", "table", "td"}
DROPPED = {"nav", "footer", "head", "script", "style", "aside"}


class _Slow(HTMLParser):
    """Lines of a page whose tags are all closed but for <p>, <b> and <br>: (text, linked characters, in article)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.linked, self.hidden, self.main, self.link, self.head = [], "", 0, [], 0, 0, 0
        self.divs = []
        self.feed(page)
        self.close()
        self.new()

    def new(self, empty=0):
        if line := " ".join(self.text.split()):
            self.lines.append((line, 0 if 2 * self.linked > len(self.text) and not self.head else len(line), self.main > 0))
        self.text, self.linked = "", 0
        self.lines += [("", 0, self.main > 0)] * empty

    def handle_starttag(self, tag, attrs):
        drop = tag in DROPPED or dict(attrs).get("class") in ("ad", "notice")
        if self.hidden:
            if tag not in ("br", "p", "b", "meta", "img"):
                self.hidden.append(tag)
        elif drop:
            self.new(1)
            self.hidden.append(tag)
        elif tag in ("article", "main"):
            self.new(3)
            self.main += 1
        elif tag in CONTAINERS:
            self.new(1)
        elif tag == "a":
            self.link += 1
        elif tag != "b":
            self.new()
            self.head += tag == "h1"

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif tag in ("article", "main"):
            self.new(3)
            self.main -= 1
        elif tag in CONTAINERS:
            self.new(1)
        elif tag == "a":
            self.link -= 1
        elif tag != "b":
            self.new()
            self.head -= tag == "h1"

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
            self.linked += len(data) * (self.link > 0)


def slow_text(page):
    lines = _Slow(page).lines
    inside = any(t and m for t, _, m in lines)
    if inside:
        return "\n".join(t for t, _, m in lines if t and m)
    if not any(w for _, w, _ in lines):
        return "\n".join(t for t, _, _ in lines if t)
    sums = [sum(w for _, w, _ in lines[max(0, i - 2) : i + 1]) for i in range(len(lines))]
    out, i = [], 0
    while i < len(lines):
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < len(lines) and sums[end]:
            end += 1
        if max(sums[i:end]) >= 0.2 * max(sums):
            last = max(k for k in range(i, end) if lines[k][1]) + 1
            while last < end and lines[last][0]:
                last += 1
            out += [t for t, _, _ in lines[i:last] if t]
        i = end
    return "\n".join(out)


def _variants(page):
    plain = re.sub(r"(</?)article\b", r"\1div", page)
    yield page
    yield plain
    # containers in containers, an advert inside, boilerplate that no name gives away
    yield plain.replace("<footer>", "</div></div><div><div><p>").replace("</footer>", "</p></div></div>").replace('<div class="ad">', "<div><div><div>").replace("<h1>", "</div></div><div><h1>").replace("<p>", '<div class="ad">Buy</div><p>', 2)
    yield plain.replace("nav>", "div>")


def test_pages_against_the_slow_reference(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    assert pages
    for page in pages:
        plain, *others = (slow_text(p) for p in _variants(page))
        assert [htmltext.main_text(p) for p in _variants(page)] == [plain, *others]
        assert others[0] == plain  # the windows alone find the article


def test_windows_decide(monkeypatch, spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    hidden = [list(_variants(p))[2] for p in pages]
    before = [htmltext.main_text(p) for p in hidden]
    monkeypatch.setattr(htmltext, "stretches", lambda w, *_: [(0, len(w))])
    assert sum(a != htmltext.main_text(p) for a, p in zip(before, hidden, strict=True)) > len(pages) // 2
    page = "<div><p>Text of it.</p></div><div></div><div></div><div><a>Links</a> <a>only</a></div><div></div><div></div><div><p>More text.</p></div>"
    assert htmltext.main_text(page) == "Text of it.\nLinks only\nMore text."
    monkeypatch.undo()
    assert htmltext.main_text(page) == "Text of it.\nMore text."


def test_windows_decide_where_nothing_is_named(spark, monkeypatch):
    """The given pages without attributes and sectioning names: line weights alone choose, and choose less than everything."""
    pages = [re.sub(r"<(\w+)[^>]*>", r"<\1>", re.sub(r"(</?)(?:article|main|nav|aside|footer|header|section)\b[^>]*", r"\1div", r["html"])) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]]
    found = [htmltext.main_text(p) for p in pages]
    assert found == [slow_text(p) for p in pages]
    monkeypatch.setattr(htmltext, "stretches", lambda w, *_: [(0, len(w))])
    assert sum(a != htmltext.main_text(p) for a, p in zip(found, pages, strict=True)) > len(pages) // 2


LONG = "A sentence of the article that is long enough to weigh something. " * 15


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>T</title><body><p>Hello world text.</p>", "Hello world text."),
        ("<title>T</title><meta charset=utf-8><p>No head at all", "No head at all"),
        ("<head><title>T</title>Bare text", "Bare text"),
        ("<article><p class='notice'>n<p>Bar text<p>Baz text</article>", "Bar text\nBaz text"),
        ("<ul><li class=ad>Buy<li>First<li>Second</ul>", "First\nSecond"),
        ("<table><tr><td class=sidebar>s<td>cell<tr><td>two<tr class=menu><td>m</table>", "cell\ntwo"),
        ("<dl><dt>Term<dd class=ad>Buy<dt>Other<dd>Meaning</dl>", "Term\nOther\nMeaning"),
        ("<div><nav>Home<div>deep</div></div><p>After an unclosed nav", "After an unclosed nav"),
        ("<p title=it's>He said don't go</p><p>Second line</p>", "He said don't go\nSecond line"),
        ("<p title=\"a > b\" data-x='c > d'>Quoted</p>", "Quoted"),
        ("<p data-class='ad' title=' class=ad '>Kept</p>", "Kept"),
        ("<article><p class='social-history'>A</p><div class='stock-search-results'>B</div><p class='readers'>C</p></article>", "A\nB\nC"),
        ("<div class='ad-slot'>x</div><div id=siteFooter>x</div><div class='left sidebar2'>x</div><ol class='comments-area'><li>x</ol><div role=search>x</div><p>Text</p>", "Text"),
        ("<p>Para one</p><div><a>only links</a></div><p>Para two</p>", "Para one\nPara two"),
        ("<h1><a href=x>A linked title</a></h1><p>Text</p>", "A linked title\nText"),
        ("<a href=x>Everything</a> <a href=y>is linked</a>", "Everything is linked"),
        (f"<div><p>{LONG}</p></div><div class=ad>x</div><div><p>{LONG[:330]}</p></div>", f"{LONG.strip()}\n{LONG[:330].strip()}"),
        (f"<div><div><p>Unnamed notice.</p></div></div><div><p>{LONG}</p></div><div><div>Made by x</div></div>", LONG.strip()),
        (f"<div><p>{LONG}</p></div></div></section><section><div><p>{LONG}</p></div>", f"{LONG.strip()}\n{LONG.strip()}"),
        ("<article><p>One</p><aside>x</aside><p>two<br/>three</p><div/>four</article>", "One\ntwo\nthree\nfour"),
        ('<div class="ad"/>x <p>y', "x\ny"),
        ("a < b and <3 &lt;p&gt; <!-> c", "a < b and <3 <p> c"),
        ("<p>one</p></div></p></li></table></nav>two", "one\ntwo"),
        ("<article>x</article><!-- <p>never closed", "x"),
        ("<article><p>Intro text</p><ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul><p>After</p></article>", "Intro text\none\ntwo\nthree\nfour\nAfter"),
        ("<article><p>Intro text</p><p><a href=x>A last linked paragraph</a></p></article>", "Intro text\nA last linked paragraph"),
        ("<article><p class='search'>We searched the valley.</p><h2 class='menu'>The menu</h2><div class='menu'><a>x</a></div></article>", "We searched the valley.\nThe menu"),
        ("<form id=aspnetForm><div class=menu><a>x</a></div><h1>Title</h1><p>The page.</p><form><input><p>mail</p></form></form>", "Title\nThe page."),
        ("<p>The page.</p><form><p>Your mail</p><input></form>", "The page."),
        ("<svg><title>t</title><text>x</text></svg><object>y</object><p>z", "z"),
    ],
)
def test_pages(page, text):
    assert htmltext.main_text(page) == text


def test_ties_are_kept_alike():
    block = "<div><div><p>Same weight.</p></div></div>"
    assert htmltext.main_text(block * 3) == "\n".join(["Same weight."] * 3)


def test_very_long_pages():
    body = "".join(f"<p class=c{i}>Paragraph number {i} &amp; its text.<b>" for i in range(60_000))
    text = htmltext.main_text(f"<nav>{'<li><a>x</a>' * 1000}</nav><article>{body}</article><footer>f</footer>")
    assert text.count("\n") == 59_999 and text.startswith("Paragraph number 0 & its text.")
    for page in ("<div>" * 200_000 + "x", "<p><button>" + "<div><b>" * 100_000 + "</i>", '<p a="' * 50_000, "<" * 500_000, "<a " + "=" * 500_000):
        htmltext.main_text(page)

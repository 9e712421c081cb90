"""Whole pages as sites make them, with the exact text expected, and the path
ratios recomputed in plain Python."""

from __future__ import annotations

import random
import re
import time
from collections import defaultdict

import pytest

from flowlab.llm import html_extract as hx

A = "The river rose for three days, and on the fourth it reached the lower bridge, which had stood since 1880."
B = "Nobody in the village had seen such a flood; the oldest of them, a miller, remembered only one that came close."
C = "When the water fell at last, the fields were grey with mud, and the work of cleaning began before noon."
LONG = "A long remark, written by a visitor, that goes on about the flood and about much else besides, line after line. " * 4
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>"
P3 = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A}\n{B}\n{C}"
ITEMS = [f"Item {i}" for i in range(12)]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("name", [
    "comment-list", "comment-body", "comments-area", "user-comments", "reader-comments", "site-footer", "page-footer",
    "cookie-banner", "ad-slot", "adsbygoogle", "main-nav", "left-sidebar", "newsletter-signup", "widget-area", "commentList",
    "SiteFooter", "js-ad", "share_buttons", "related-posts", "top-menu", "breadcrumb-trail", "social-links", "login-box",
    "sponsored-content", "ad", "ads2", "sidebar_right", "notice--info", "legal", "search"])
def test_foreign_text_in_compound_names(name):
    for attribute in ("class", "id"):
        for tag in ("div", "ol", "section"):
            box = f"<{tag} {attribute}='{name}'><p>{LONG}</p></{tag}>"
            assert hx.main_text(page(f"{MENU}<div class=post>{P3}</div>{box}")) == TEXT
            assert hx.main_text(page(f"{MENU}{box}<article>{P3}{box}</article>")) == TEXT


@pytest.mark.parametrize("name", [
    "has-comments", "with-sidebar", "no-sidebar", "sidebar-layout", "content-sidebar-wrap", "side-by-side", "commentary",
    "category-social", "tag-menu", "adapter", "header-less", "shared", "navy", "footnote", "entry-header", "loads", "admin",
    "cookies-enabled", "no-ads", "promoted"])
def test_harmless_names(name):
    assert hx.main_text(page(f"{MENU}<div class='{name}'>{P3}</div>")) == TEXT


TEMPLATES = {
    "blog, list and headings in the article": (
        f"<article><h1>Flood</h1><h2>First days</h2><h3>Monday</h3><p>{A}</p><ul>" + "".join(f"<li>{x}" for x in ITEMS)
        + f"</ul><p>{B}</p></article>", "\n".join(["Flood", "First days", "Monday", A, *ITEMS, B])),
    "table of twenty rows": (
        f"<article><p>{A}</p><table><tr><th>Day<th>Level" + "".join(f"<tr><td>{i}<td>{i * 3} m" for i in range(20))
        + f"</table><p>{B}</p></article>",
        "\n".join([A, "Day", "Level", *[x for i in range(20) for x in (str(i), f"{i * 3} m")], B])),
    "poem in divs": (
        f"<main><p>{A}</p><div class=poem>" + "".join(f"<div>Line {i} of it</div>" for i in range(12)) + f"</div><p>{B}</p></main>",
        "\n".join([A, *[f"Line {i} of it" for i in range(12)], B])),
    "paragraphs inside links": (
        f"<div class=post><p><a href=/a>{A}</a></p><p><a href=/b>{B}</a></p><p>{C}</p></div>", TEXT),
    "the whole article in a div named legal": (f"{MENU}<div class=legal>{P3}</div>", TEXT),
    "everything in a wrapper with a telling name": (
        f"<div class='page-header-wide'><div class=header><p>{LONG}</p></div><div class=text>{P3}</div><div class=sidebar><p>{LONG}</p></div>"
        f"<div class=footer><p>{LONG}</p></div></div>", TEXT),
    "a wrapper named legal beside a sidebar": (
        f"{MENU}<div class=legal>{P3}<p>{A}</p></div><div class=sidebar><p>{A}</p></div><div id=comments><p>{LONG}</p></div>", f"{TEXT}\n{A}"),
    "a page class of a fixed header": (f"<div class='site header-fixed'><h1>Flood</h1>{P3}<div class=promo>{LONG}</div></div>", f"Flood\n{TEXT}"),
    "the whole article in a form": (f"{MENU}<form action=/x>{P3}<input></form>", TEXT),
    "blog theme": (
        f"<div id=page class='site'><header id=masthead class=site-header><h1>My blog</h1></header>{MENU}<div id=content "
        f"class='site-content with-sidebar'><div id=primary class=content-area><div class='post-12 post type-post category-news'>"
        f"<div class=entry-header><h1 class=entry-title>Flood</h1></div><div class=entry-content>{P3}</div></div>"
        f"<div id=comments class=comments-area><h2>2 thoughts</h2><ol class=comment-list><li class=comment><div class=comment-body>"
        f"<p>{LONG}</p></div></ol></div></div><div id=secondary class=widget-area><p>{LONG}</p></div></div>"
        f"<footer class=site-footer><p>All rights reserved, since 2001.</p></footer></div>", "Flood\n" + TEXT),
    "forum": (
        f"<div class=breadcrumbs><a href=/>Board</a> &gt; <a href=/f>Floods</a></div><div class=thread><div class=message><p>{A}</p>"
        f"</div><div class=message><p>{B}</p></div><div class=message><blockquote>{C}</blockquote><p>{A}</p></div></div>"
        f"<div class=pagination><a href=2>2</a><a href=3>3</a></div>", "\n".join([A, B, C, A])),
    "shop": (
        f"<div class=topbar>Free delivery, today only.</div><div class=product><h1>Pump</h1><div class=description>{P3}</div><dl>"
        f"<dt>Weight<dd>12 kg<dt>Power<dd>900 W</dl></div><div class=related-products><p>{LONG}</p></div>"
        f"<form><label>Amount</label><select><option>1<option>2</select><button>Buy</button></form>",
        "\n".join(["Pump", TEXT, "Weight", "12 kg", "Power", "900 W"])),
    "documentation": (
        f"<div class=sidebar><ul><li><a href=a>Start</a><li><a href=b>Guide</a></ul></div><main><h1>Pump API</h1><p>{A}</p><pre>"
        f"pump.start(\n  level=3)</pre><h2>Levels</h2><p>{B}</p><figure><img src=x><figcaption>The pump, opened</figcaption></figure>"
        f"<details><summary>More</summary><p>{C}</p></details></main>",
        "\n".join(["Pump API", A, "pump.start( level=3)", "Levels", B, "The pump, opened", "More", C])),
    "quote in an unquoted value": (f"<p class=it's>{A}</p><p>It didn't end; {B}</p><p>{C}</p>", f"{A}\nIt didn't end; {B}\n{C}"),
    "quote in a tag": (f"<div ' id=x><p title=\"a > b\">{A}</p><p data-x='it is \"so\"'>{B}</p></div>", f"{A}\n{B}"),
    "attribute without end": (f"<p>{A}</p><p class=\"open>{B}</p>", f"{A}\n{B}"),
    "angle brackets in the text": (f"<p>{A} 1 < 2, a <3 b; x<i>y</i> z.</p><p>{B}</p>", f"{A} 1 < 2, a <3 b; xy z.\n{B}"),
    "character references": (f"<p>{A} Caf&eacute; &amp; &lt;b&gt; &#8212; &#x41; &nbsp;&notit;</p><p>{B}</p>", f"{A} Café & <b> — A ¬it;\n{B}"),
    "scripts and comments": (
        f"<p>{A}<!-- <p>no</p> --></p><script>document.write('<p>{LONG}</p>')</script><p>{B}</p><style>x{{}}</style><!-- {LONG}", f"{A}\n{B}"),
    "hidden parts": (f"<div><p>{A}</p><p hidden>{LONG}</p><div style='display:none'>{LONG}</div><span aria-hidden=true>{LONG}</span><p>{B}</p></div>",
                     f"{A}\n{B}"),
    "old tables": (
        f"<table><tr><td class=menu><a href=/>Home</a></td><td><font size=2><p>{A}<p>{B}<p>{C}</font></td></tr></table>", TEXT),
    "no end tags": (f"<article><h1>Flood<p>{A}<p>{B}<ul><li>one<li>two</ul><p>{C}", f"Flood\n{A}\n{B}\none\ntwo\n{C}"),
    "upper case": (f"<DIV CLASS=POST><P>{A}</P><P>{B}</P></DIV><DIV CLASS='SITE-FOOTER'><P>{LONG}</P></DIV>", f"{A}\n{B}"),
    "text in a div with line breaks": (f"{MENU}<div class=text>{A}<br>{B}<br/>{C}</div>", f"{A} {B} {C}"),
    "notices and adverts between the paragraphs": (
        f"<div class=story><p>{A}</p><div class=ad-slot><p>{LONG}</p></div><p>{B}</p><aside><p>{LONG}</p></aside><div role=alert>{LONG}</div>"
        f"<p>{C}</p></div>", TEXT),
    "two articles": (f"<main><article><h2>One</h2><p>{A}</p></article><article><h2>Two</h2><p>{B}</p></article></main>", f"One\n{A}\nTwo\n{B}"),
    "a short article and long comments": (
        f"<article><h1>Note</h1><p>Closed today.</p></article><section id=comments><p>{LONG}</p><p>{LONG}</p></section>", "Note\nClosed today."),
    "nothing but a menu": (MENU, ""),
    "lists of references": (
        f"<article><p>{A}</p><p>{B}</p><ol><li><a href=1>Report of 1880</a><li><a href=2>The bridge</a></ol></article>",
        f"{A}\n{B}\nReport of 1880\nThe bridge"),
}


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_templates(name):
    body, want = TEMPLATES[name]
    assert hx.main_text(page(body)) == want


@pytest.mark.parametrize("body", [
    "<div>x" * 100_000, "<div><p>" + "<b>" * 100_000 + "t" + "<hr>" * 50_000, "</span>" * 100_000 + "<div>" * 100_000 + "</span>" * 100_000,
    "<ul><li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<p " + "a='" * 100_000, "<" * 200_000, "<!" * 100_000, "<a b" * 100_000,
    "<div class='" + "ad-" * 100_000 + "'>x</div>", "<p " + "x = " * 100_000 + ">", "<td>" * 50_000 + "x", "&amp" * 200_000])
def test_long_and_nested_pages_take_linear_time(body):
    start = time.monotonic()
    hx.main_text(body)
    assert time.monotonic() - start < 12


def plain_ratios(found, paths):
    """The fused ratios by path text, block after block."""
    by = defaultdict(list)
    for b in found:
        by[b.path].append(b)

    def ratio(p, count):
        return sum(map(count, by[p])) / len(by[p])

    def marks(b):
        return len(re.findall(r"[.,;:!?…、。！，？¿¡|\"'()-]", b.text))
    text = {p: ratio(p, lambda b: len(b.text)) for p in by}
    mark = {p: (sum(map(marks, by[p])) + 0.1) / len(by[p]) for p in by}

    def smooth(x):
        line = [x[b.path] for b in found]
        seen = defaultdict(list)
        for i, b in enumerate(found):
            before, after = line[max(i - 1, 0)], line[min(i + 1, len(line) - 1)]
            seen[b.path].append(0.25 * before + 0.5 * line[i] + 0.25 * after)
        return {p: max(x[p], sum(v) / len(v)) for p, v in seen.items()}
    text, mark = smooth(text), smooth(mark)
    return {p: (text[p] * mark[p]) ** 0.5 * (2 if re.search("article|main", paths.text(p)) else 1) for p in by}


def plain_listed(found):
    by = defaultdict(list)
    for b in found:
        by[b.path].append(b)
    return {p for p, bs in by.items() if sum(b.link_chars for b in bs) > 0.8 * sum(len(b.text) for b in bs)
            and sum(len(b.text) for b in bs) / len(bs) < 40}


def test_ratios_recomputed():
    rng = random.Random(3)
    words = ["flood", "river,", "mud.", "a", "1880;", "bridge", "miller!"]
    for _ in range(150):
        def text():
            return " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))

        def piece(depth):
            kind = rng.random()
            if kind < 0.4 or depth > 3:
                return f"<p>{text()}</p>"
            if kind < 0.6:
                return "<ul>" + "".join(f"<li><a href=x>{text()[:rng.randint(3, 60)]}</a>" for _ in range(3)) + "</ul>"
            tag = rng.choice(["div", "article", "section", "div class=x", "main"])
            return f"<{tag}>" + "".join(piece(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{tag.split()[0]}>"
        paths, found = hx.blocks(page("".join(piece(0) for _ in range(4))))
        want, listed = plain_ratios(found, paths), plain_listed(found)
        fused, flags = hx.fused_ratios(found, paths)
        assert all(abs(fused[p] - v) < 1e-9 for p, v in want.items()) and {p for p in want if flags[p]} == listed
        top = max((v for p, v in want.items() if p not in listed), default=0)
        near = {p for p, v in want.items() if abs(v - 0.15 * top) < 1e-9}
        assert hx.content_paths(found, paths) - near == {p for p, v in want.items() if v >= 0.15 * top and p not in listed} - near


def test_rows_of_any_kind(spark):
    schema = "page_id long, url string, html string, text string, n int, k0 string, path int"
    rows = [(1, "u", page(P3), "t", 1, "k", 2), (1, "u", page(P3), "t", 1, "k", 2), (None, None, None, None, None, None, None),
            (3, "v", "", "", 0, "", 0)]
    got = hx.extract(spark.createDataFrame(rows, schema), keep=["url"]).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(x) for x in [(1, "u", TEXT), (1, "u", TEXT), (None, None, ""), (3, "v", "")])
    assert hx.extract(spark.createDataFrame([], schema)).count() == 0

"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of
block tags (with class and id names; a path is a number that knows its
parent).  Text length and punctuation are aggregated per path, the ratios are
smoothed along the page and fused (those inside <article> or <main> count
double), and the paths above a threshold are the content.

A content path speaks for the section that holds it: the nearest <article> or
<main>, else the nearest container, widened while what comes along is little
and no list of links.  Headings, lists, tables and lines of a section follow
it, whatever their own ratio.  Elements that never hold the article (menus,
headers, footers, sidebars, notices, adverts, forms, comments) are left out by
tag, role and the words of their names, but such a rule may not leave a page
without text: where nothing that reads like prose remains, names are forgiven.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the elements of HTML by role
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
          "sup", "time", "tt", "u", "var", "wbr"}
NEVER = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas",
         "object", "applet", "audio", "video", "map", "fieldset"}
ARTICLE = {"article", "main"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form",
            "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
            "table", "ul"}
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}}
# fixed values: words of class names and ids; a name is cut at signs, digits and case changes
NAME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "adsbygoogle",
              "sponsor", "sponsors", "sponsored", "promo", "promos", "banner", "banners", "nav", "navs", "navbar", "navigation",
              "menu", "menus", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "footer", "header", "masthead",
              "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "popup",
              "modal", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
              "recommend", "recommended", "recommendations", "pagination", "pager", "widget", "widgets", "copyright",
              "disclaimer"}
WHOLE_NAMES = {"side", "aside", "foot", "search", "overlay", "legal", "skip", "promotion", "promotions"}
COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "replies", "disqus"}
HARMLESS_BEFORE = {"has", "have", "with", "without", "no", "not", "non", "show", "shows", "hide", "hides", "is", "enable",
                   "enabled", "disable", "disabled", "category", "cat", "tag", "tags", "type", "format", "status", "term",
                   "topic", "template", "theme"}
HARMLESS_AFTER = {"layout", "fixed", "sticky", "enabled", "disabled", "open", "closed", "visible", "hidden", "free", "less", "ready"}
TITLE_WORDS = {"entry", "post", "article", "story", "content", "section", "chapter", "title"}      # before "header"
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}

# flow text: these follow the section that holds them
TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
             "tr", "td", "th", "caption", "colgroup", "blockquote", "figure", "figcaption", "pre", "address", "details",
             "summary", "center", "hgroup", "header"}
LISTED = {t for t in CLOSES_ITSELF} | {t for held in HOLDS.values() for t in held}

# attributes as the standard scans them: a quote is special only right after "="; one without its other half is a character
_ATTR = re.compile(r"""[\s/]*+(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)?+))?+""")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"
                    + re.sub(r"\((?![?])", "(?:", _ATTR.pattern) + r")*+)[\s/]*+(?:>|\Z)", re.S)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…、。！，？¿¡|\"'()-]")

SMOOTH = (0.25, 0.5, 0.25)
THRESHOLD = 0.15          # share of the strongest path's fused ratio
WEIGHT = 2                # factor of the fused ratio inside <article> or <main>
LINKS, SHORT = 0.8, 40    # a list of links: that share of a path's text in links, blocks shorter than this
TINY = 4                  # mean characters of a container's own lines below which they are no text
WIDEN = 0.3               # a section takes its parent in where that adds at most this share of its text

NAMED, COMMENT, STRUCTURE, NEVER_SHOWN = 1, 2, 3, 4       # why an element is left out, by how hard that is


def name_mark(name: str) -> int:
    """0, NAMED or COMMENT for a class name or id."""
    if name.lower() in WHOLE_NAMES:
        return NAMED
    words = [w.lower() for w in _WORDS.findall(name)]
    for i, w in enumerate(words):
        if w not in NAME_WORDS and w not in COMMENT_WORDS:
            continue
        if set(words[:i]) & HARMLESS_BEFORE or set(words[i + 1:]) & HARMLESS_AFTER:
            continue
        if w == "header" and set(words[:i]) & TITLE_WORDS or w.startswith("sidebar") and {"content", "main"} & set(words):
            continue
        return COMMENT if w in COMMENT_WORDS else NAMED
    return 0


class Paths:
    """Interned root-to-leaf paths: parent (lower number), tag, and whether an
    <article> or <main> holds it."""

    def __init__(self):
        self.parent, self.tag, self.article = [0], [""], [-1]
        self._known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, tag: str, label: str) -> int:
        key = (parent, label)
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.article.append(at if tag in ARTICLE else self.article[parent])
        return at

    def text(self, at: int) -> str:
        out = []
        while at:
            out.append(self.tag[at])
            at = self.parent[at]
        return "/".join(reversed(out))


@dataclass
class Block:
    path: int
    mark: int
    text: str
    link_chars: int
    wrap: int           # path of the outermost element that a name marks (0: none)
    named: int          # how many such elements hold the block


def attributes(inside: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name, each with its whole value; the first of a name counts."""
    found: dict[str, str] = {}
    for a in _ATTR.finditer(inside):
        found.setdefault(a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or "")
    return found


def element_mark(tag: str, attrs: dict[str, str], in_article: bool) -> tuple[list[str], int]:
    """Class names and id of an element, and why it is left out (0: it isn't)."""
    names: list[str] = []
    mark = STRUCTURE if tag in NEVER and not (tag == "header" and in_article) else NEVER_SHOWN if tag == "head" else 0
    for key, value in attrs.items():
        if key in ("class", "id"):
            names += html.unescape(value).split()
        elif key == "role" and value.strip().lower() in ROLES:
            mark = max(mark, STRUCTURE)
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            mark = NEVER_SHOWN
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            mark = NEVER_SHOWN
    if tag not in ("html", "body", "article", "main"):
        mark = max([mark, *map(name_mark, names)])
    return names, mark


class Parser:
    """One pass over a page.  Every step on the stack of open elements is
    amortised: entries know the nearest block and the nearest list or table
    element below them, and how many of a tag are open is counted."""

    def __init__(self):
        self.paths, self.blocks = Paths(), []
        # tag, path, mark, index of the nearest block-level entry, of the nearest entry in LISTED, wrap, named
        self.stack: list[tuple[str, int, int, int, int, int, int]] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.links = 0                  # open <a>
        self.link_chars = 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                _, path, mark, _, _, wrap, named = self.stack[-1] if self.stack else ("", 0, 0, -1, -1, 0, 0)
                self.blocks.append(Block(path, mark, text, self.link_chars, wrap, named))
            self.parts, self.link_chars = [], 0

    def add(self, text: str) -> None:
        if text and not (self.stack and self.stack[-1][2] == NEVER_SHOWN):
            self.parts.append(text)
            if self.links:
                self.link_chars += len(text.strip())

    def close(self, upto: int) -> None:
        """Close the entries from ``upto`` on."""
        while len(self.stack) > upto:
            tag = self.stack[-1][0]
            if tag not in INLINE:
                self.flush()
            self.stack.pop()
            self.open[tag] -= 1
            self.links -= tag == "a"

    def push(self, tag: str, inside: str) -> None:
        _, path, mark, block, listed, wrap, named = self.stack[-1] if self.stack else ("", 0, 0, -1, -1, 0, 0)
        own = 0
        if tag not in INLINE:
            names, own = element_mark(tag, attributes(inside), self.paths.article[path] >= 0)
            path = self.paths.child(path, tag, tag + ("." + "-".join(names) if names else ""))
            block = len(self.stack)
        elif inside:
            own = element_mark(tag, attributes(inside), True)[1]
        wrap = wrap or (path if own == NAMED else 0)
        self.stack.append((tag, path, max(mark, own), block, len(self.stack) if tag in LISTED else listed, wrap,
                           named + (own == NAMED)))
        self.open[tag] += 1
        self.links += tag == "a"

    def start(self, tag: str, inside: str) -> None:
        if tag in CLOSES_P and self.stack and self.stack[-1][3] >= 0 and self.stack[self.stack[-1][3]][0] == "p":
            self.close(self.stack[-1][3])
        if tag in CLOSES_ITSELF and any(self.open[t] for t in CLOSES_ITSELF[tag]):
            at = self.stack[-1][4] if self.stack else -1
            while at >= 0 and self.stack[at][0] not in HOLDS[tag]:
                if self.stack[at][0] in CLOSES_ITSELF[tag]:
                    self.close(at)
                    break
                at = self.stack[at - 1][4] if at else -1
        if tag not in INLINE:
            self.flush()
        if tag not in VOID:
            self.push(tag, inside)

    def end(self, tag: str) -> None:
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.close(at)

    def page(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if m is None:
                self.add(page[at:])
                break
            self.add(page[at:m.start()])
            at = m.end()
            tag = (m.group(2) or "").lower()
            if not tag:
                continue
            if m.group(1):
                self.end(tag)
            elif tag in RAW:                            # their text isn't markup: go on after the end tag
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
                self.flush()
            elif tag == "br" or tag == "wbr":
                self.add(" " if tag == "br" else "")
            elif tag in SHAPES and m.group(0).endswith("/>"):
                continue
            else:
                self.start(tag, m.group(3))
        self.close(0)
        self.flush()


SHAPES = {"path", "circle", "rect", "line", "polygon", "use"}


def blocks(page: str) -> tuple[Paths, list[Block]]:
    """Paths and text blocks, in page order, of all that a page shows."""
    parser = Parser()
    parser.page(page)
    return parser.paths, parser.blocks


def fused_ratios(found: list[Block], paths: Paths) -> tuple[np.ndarray, np.ndarray]:
    """(fused ratio of every path, whether it is a list of links).

    Per path: characters a block and punctuation a block, both smoothed along
    the page (a path keeps its own ratio at least), the geometric mean of the
    two, doubled inside <article> or <main>."""
    size = len(paths.parent)
    n, chars, marks, links = (np.zeros(size) for _ in range(4))
    line = np.array([b.path for b in found])
    for b in found:
        n[b.path] += 1
        chars[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        links[b.path] += b.link_chars
    some = np.maximum(n, 1)
    text_ratio, mark_ratio = chars / some, np.where(n > 0, (marks + 0.1) / some, 0)

    def smooth(x: np.ndarray) -> np.ndarray:
        wide = np.convolve(np.pad(x[line], 1, mode="edge"), SMOOTH, mode="valid")
        return np.maximum(x, np.bincount(line, wide, size) / some)

    weight = np.where(np.array(paths.article) >= 0, WEIGHT, 1)
    listed = (links > LINKS * np.maximum(chars, 1)) & (text_ratio < SHORT)
    return np.sqrt(smooth(text_ratio) * smooth(mark_ratio)) * weight, listed


def content_paths(found: list[Block], paths: Paths) -> set[int]:
    """Paths whose fused ratio is above the threshold and that aren't lists of links."""
    fused, listed = fused_ratios(found, paths)
    used = {b.path for b in found}
    top = max((fused[p] for p in used if not listed[p]), default=0.0)
    return {p for p in used if fused[p] >= THRESHOLD * top and not listed[p]}


def select(found: list[Block], paths: Paths) -> list[Block]:
    """The blocks of the content paths and what follows them in their sections."""
    if not found:
        return []
    content = content_paths(found, paths)
    _, listed = fused_ratios(found, paths)
    size, parent, tag = len(paths.parent), paths.parent, paths.tag
    chars, n, link_lists = np.zeros(size), np.zeros(size), np.zeros(size)
    for b in found:
        chars[b.path] += len(b.text)
        n[b.path] += 1
        link_lists[b.path] += listed[b.path]
    mean = chars / np.maximum(n, 1)
    for p in range(size - 1, 0, -1):                    # totals of everything below a path
        chars[parent[p]] += chars[p]
        link_lists[parent[p]] += link_lists[p]
    top = list(range(size))                             # the widest section of a container
    for p in range(1, size):
        q = parent[p]
        little = chars[q] - chars[p] <= WIDEN * chars[p] and link_lists[q] == link_lists[p]
        if tag[q] not in ("", "html", "body") and tag[p] not in ("html", "body", *ARTICLE) and little:
            top[p] = top[q]
    holder = [0] * size                                 # nearest container that is no flow text
    for p in range(1, size):
        holder[p] = holder[parent[p]] if tag[p] in TEXT_TAGS and parent[p] else p
    sections = {paths.article[p] if paths.article[p] >= 0 else top[holder[p]] for p in content}
    # below a section: 1 outside, 2 by flow text only, 3 by containers too (never below the page itself)
    state = [0] * size
    for p in range(size):
        above = state[parent[p]] if p else 0
        whole = tag[p] in ("", "html", "body")
        if p in sections:
            state[p] = 2 if whole or above != 3 else 3
        elif above and (tag[p] in TEXT_TAGS or above == 3):
            state[p] = above
        elif above == 2 and not any(tag[q] in ("", "html", "body") for q in (parent[p],)):
            state[p] = 3
    out = []
    for b in found:
        p = b.path
        follows = state[p] == 2 or state[p] == 3 and (tag[p] in TEXT_TAGS or mean[p] >= TINY and not listed[p])
        if p in content or follows:
            out.append(b)
    return out


def is_prose(b: Block) -> bool:
    return bool(len(b.text) >= SHORT and _PUNCTUATION.search(b.text) and b.link_chars <= LINKS * len(b.text))


def reads_like_prose(found: list[Block], paths: Paths) -> bool:
    """Some block looks like a sentence, or stands in an <article> or <main>."""
    return any(paths.article[b.path] >= 0 or is_prose(b) for b in found)


def main_blocks(page: str) -> list[Block]:
    """The selected blocks.  Where those without a mark don't read like prose,
    the named element with most prose is taken for a wrapper of the page: what
    only it marks comes in, what is marked again inside it stays out."""
    paths, found = blocks(page)
    plain = [b for b in found if not b.mark]
    kept = select(plain, paths)
    if reads_like_prose(kept, paths):
        return kept
    prose: Counter[int] = Counter()
    for b in found:
        if b.mark == NAMED and b.named == 1 and is_prose(b):
            prose[b.wrap] += len(b.text)
    wrapper = max(prose, key=lambda w: (prose[w], -w), default=0)
    forgiven = select([b for b in found if not b.mark or wrapper and b.mark == NAMED and b.named == 1 and b.wrap == wrapper], paths)
    if not reads_like_prose(forgiven, paths):
        forgiven = select([b for b in found if b.mark <= NAMED], paths)
    if reads_like_prose(forgiven, paths) or not kept:
        kept = forgiven
    return kept or select(found, paths)


def main_text(page: str) -> str:
    return "\n".join(b.text for b in main_blocks(page))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
            keep: list[str] | None = None) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``text`` of every row; null or empty
    html gives an empty text.  Repeated rows are kept, other columns ignored, an
    empty table gives no rows.  Pages of any length and nesting take time and
    memory in proportion to their length."""
    keep = [id_col, *(keep or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())],
                                              [*batch.schema.names[:-1], "text"])

    inner = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner)],
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner) + ", text string"
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, inner)], "text")

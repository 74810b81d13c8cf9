"""Main-text extraction from HTML by text-to-tag ratio.

The standard library's streaming parser emits events.  Each block of text is
one line with its characters, its tags and its place in the element tree.
Containers that HTML marks as menus, headers, footers, sidebars, forms,
scripts or styles are skipped with all they hold.

A class or id marks a container as one of these, or as a notice, an advert or
reader comments, if the word is the whole name or its head noun: `top-menu`
and `menu-list`, not `with-sidebar` or `menu-open`.  <article> and <main> are
never skipped by a name.  As names may mislead, clusters over all lines (see
below) decide: a named container stays if it holds more of the content than
the rest of the page, or any <article> or <main>, and if it doesn't stand
outside one that has text itself; comments stay only if nothing else has
content.

On the remaining lines the text-to-tag ratio is smoothed with a Gaussian and
parted in two clusters by a threshold; lines of the upper cluster are content.
Without <article> and <main> the region is the smallest container that holds
all of the content.  Where some of these hold content, each of them is in the
region, and so is the innermost container of content that lies in none.  All
lines of the region are the text: a short paragraph between long ones stays.

White space in a line becomes one space; lines are joined by two newlines.
<br> and table cells part words, not lines.

Defined cases: null, empty and textless pages give an empty text; unclosed
and stray tags are accepted (an end tag closes what it encloses, a new block
closes an open paragraph); a form around the article is no form; one row is
returned per input row.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, pick

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SKIP_TAGS = frozenset("head title script style noscript template iframe object svg canvas nav header footer aside form menu "
                      "dialog button select textarea input label datalist".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words that mark a container to skip as a class or id or its head noun; SKIP_NAMES only as a whole class or id.
SKIP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                       "consent gdpr notice popup modal newsletter subscribe sidebar menu nav navbar navigation breadcrumb "
                       "breadcrumbs footer comment comments disqus share sharing social related recommended".split())
SKIP_NAMES = frozenset("header site-header page-header masthead topbar site-footer respond".split())
COMMENTS = frozenset("comment comments disqus".split())
#: Words after the head noun that only tell the container's shape or place, and words that make a name a state of the page.
SHAPES = frozenset("area articles bar block blocks body bottom box button buttons col column container content count feed form group "
                   "holder icon icons image inner item items left link links list main module news outer panel posts primary right "
                   "row secondary section signup slot stories text title top unit widget widgets wrap wrapper".split())
STATES = frozenset("with without has no not hide hidden show".split())
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("html body article main section div td center table tbody".split())
CLOSED_BY_SAME = frozenset("li dt dd tr td th option".split())
SIGMA, RADIUS = 1.0, 2
_WORDS = re.compile(r"[a-z0-9]+")


def _skipped(tag: str, attrs: list) -> bool:
    if tag in SKIP_TAGS:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name == "role" and value.lower() in SKIP_ROLES:
            return True
    return False


def _named(tag: str, attrs: list) -> str | None:
    """The word by which a class or id marks the element as one to skip."""
    if tag in ("html", "body") or tag in MAIN:
        return None
    for attr, value in attrs:
        for name in (value or "").lower().split() if attr in ("class", "id") else ():
            if name in SKIP_NAMES:
                return name
            words = _WORDS.findall(name)
            head = next((w for w in reversed(words) if w not in SHAPES and not w.isdigit()), None)
            if head in SKIP_WORDS and STATES.isdisjoint(words):
                return head
    return None


class _Lines(HTMLParser):
    """Collects lines: (pieces of text, each with the named containers that hold it; number of tags; containers from the root)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, tuple]], int, tuple]] = []
        self.kinds = {0: "root"}
        self.named: list[tuple[str, bool]] = []  # the words that mark them, and whether <article> or <main> holds them
        self.stack: list[tuple[str, int, bool, tuple]] = [("root", 0, False, ())]  # tag, container, skipped, named containers
        self.path: tuple = (0,)
        self.parts: list[tuple[str, tuple]] = []
        self.tags = 0

    def flush(self):
        if self.parts:
            self.lines.append((self.parts, self.tags, self.path))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if any(x[0] == "p" for x in self.stack[-8:]):
                self.close_to("p", stop=CONTAINERS)
        elif tag in ("br", "td", "th"):
            self.parts.append((" ", ()))
        if tag in CLOSED_BY_SAME:
            self.close_to(tag, stop=frozenset(("ul", "ol", "dl", "table", "select")))
        self.tags += 1
        if tag in VOID:
            return
        skipped = self.stack[-1][2]
        if skipped and tag in MAIN:
            skipped = self.skipped_but_forms()
        skipped = skipped or _skipped(tag, attrs)
        node, names = self.stack[-1][1], self.stack[-1][3]
        if not skipped and (word := _named(tag, attrs)):
            names += (len(self.named),)
            self.named.append((word, any(x[0] in MAIN for x in self.stack)))
        if tag in CONTAINERS:
            node = len(self.kinds)
            self.kinds[node] = tag
            self.path += (node,)
        self.stack.append((tag, node, skipped, names))

    def skipped_but_forms(self) -> bool:
        """Whether some element that is no form starts to skip."""
        return any(s and not before[2] and t != "form" for before, (t, _, s, _) in zip(self.stack, self.stack[1:]))

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        self.close_to(tag)

    def close_to(self, tag, stop=frozenset()):
        """Closes the innermost open `tag` and what it holds."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if any(x[0] in BLOCK for x in self.stack[i:]):
                    self.flush()
                del self.stack[i:]
                while self.path[-1] != self.stack[-1][1]:
                    self.path = self.path[:-1]
                return
            if self.stack[i][0] in stop:
                return

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.parts.append((data, self.stack[-1][3]))

    def unknown_decl(self, data):
        pass


def content_lines(ratios: list[float]) -> np.ndarray:
    """Smoothed ratios in the upper of two clusters."""
    offsets = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-offsets**2 / (2 * SIGMA**2))
    smooth = np.convolve(ratios, kernel, "full")[RADIUS:-RADIUS] / np.convolve(np.ones(len(ratios)), kernel, "full")[RADIUS:-RADIUS]
    cut = smooth.mean()
    while (smooth > cut).any():
        new = (smooth[smooth > cut].mean() + smooth[smooth <= cut].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return smooth >= min(cut, smooth.max())


def _region(paths: list[tuple], kinds: dict[int, str]) -> set[int]:
    """The containers that hold all content, given the containers of its lines."""
    main = [next((n for n in path if kinds[n] in MAIN), None) for path in paths]
    if any(n is not None for n in main):
        return {path[-1] if n is None else n for n, path in zip(main, paths)}
    return {[n for n, *others in zip(*paths) if all(n == o for o in others)][-1]}


def _texts(lines: list, stays: set[int]) -> list[tuple[str, int, tuple, tuple]]:
    """(text, tags, containers, named containers of the first piece) of the lines with text outside named containers that don't stay."""
    out = []
    for parts, tags, path in lines:
        held = [(t, names) for t, names in parts if stays.issuperset(names)]
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            out.append((text, tags, path, next(names for t, names in held if t.strip())))
    return out


def _content(lines: list) -> list:
    return [x for x, c in zip(lines, content_lines([len(x[0]) / max(1, x[1]) for x in lines])) if c]


def _staying(parser: _Lines) -> set[int]:
    """The named containers that are no menu, advert and so on, by the content that they hold."""
    every = set(range(len(parser.named)))
    lines = _texts(parser.lines, every)
    if not every or not lines:
        return set()
    content = _content(lines)
    total, held = sum(len(x[0]) for x in content), dict.fromkeys(every, 0)
    inside, holds_main, main_outside = set(), set(), False
    for _, _, path, names in lines:
        if any(parser.kinds[n] in MAIN for n in path):
            main_outside |= not names
            inside.update(n for n in names if parser.named[n][1])
            holds_main.update(n for n in names if not parser.named[n][1])
    for text, _, _, names in content:
        for n in names:
            held[n] += len(text)
    return {n for n in every if (n in inside or not main_outside) and
            (held[n] == total or parser.named[n][0] not in COMMENTS and (2 * held[n] > total or n in holds_main))}


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = _texts(parser.lines, _staying(parser))
    if not lines:
        return ""
    region = _region([path for _, _, path, _ in _content(lines)], parser.kinds)
    return "\n\n".join(text for text, _, path, _ in lines if not region.isdisjoint(path))


def _extract_batches(batches):
    for b in batches:
        texts = [extract(h) for h in b.column("html").to_pylist()]
        yield {"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()),
               "n_chars": [len(t) for t in texts]}


def extract_main_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    d = pick(pages, page_id=page_id, url=url, html=html)
    kind = {c: d.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return arrow_map(d, _extract_batches, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")

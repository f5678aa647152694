"""Main text of web pages: text-to-tag ratios, Gaussian smoothing, threshold clustering.

One pass of the standard library's streaming parser turns a page into *lines*: the text
between two block-level tags, with the number of tags met since the line before and the
containers it stands in. A line's ratio is its characters per tag. Ratios are smoothed
with a Gaussian over neighbouring lines, so that a short paragraph between long ones is
lifted and a lone long menu entry is lowered. What names a container as menu, header,
footer, aside, form, advert, notice or comments (its element, or words of its class, id
or role) is a feature, not a verdict: it weighs the smoothed ratios of all lines inside
(``FIRM`` for elements and whole class names, ``LOOSE`` for parts of compound names and
forms). So do two more features, both ``LOOSE``: a line that is mostly link, and one that
stands outside of the page's ``article`` or ``main``. Lines whose weighed ratio reaches the threshold (their standard deviation)
are *content*; the others are not.

From the content lines follow
* which named containers go: those in which less than half of the characters are content
  and which hold less than half of the page's content. So a wrapper that happens to be
  named ``with-sidebar``, or a form around the whole page, stays;
* the region: the innermost container with at least ``MOST`` of the content's characters
  and of its lines. If it lies in an ``article`` or ``main``, the innermost of those is
  returned with all its lines, however short. Else (content spread over several articles,
  or pages without any) the articles that hold content, the containers that hold content
  lines themselves and what stands between the region's first and last content line,
  without lists of links.

Element content that isn't text of the page (``UNSEEN``: head, scripts, styles, input
fields, ...) is no line at all.

Character references are decoded; white space inside a block becomes one space; blocks
are joined by one space in page order.

Edge cases: null, empty or text-free html gives an empty text; unclosed and stray end
tags are tolerated (an end tag closes the nearest open container of its name, or
nothing); very long and very deep pages are taken whole in linear time; repeated rows
each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, table

# HTML's element names by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset(
    "article aside body center details dialog div dl fieldset figure footer form head header main menu nav ol section table template "
    "noscript iframe object svg canvas select button textarea title ul blockquote".split()
)
UNSEEN = frozenset("head template noscript iframe object svg canvas select button textarea title".split())
NAMED = frozenset("nav header footer aside menu dialog".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header footer masthead cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe "
    "signup login comment comments disqus respond reply replies related recommended share sharing social widget pagination pager "
    "complementary contentinfo search alert alertdialog dialog form".split()
)
SIGMA, RADIUS = 1.5, 4
#: Weights of lines in named containers, and the least that nested ones come to.
FIRM, LOOSE, LEAST = 1 / 16, 1 / 4, 1 / 256
#: Of the content's characters and lines, that make a container the region.
MOST = 0.8
#: A line is a link, and a container without content a list of links, if so much of its text is in links.
LINKS = 0.6
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
_WORDS = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Lines(HTMLParser):
    """Collects (text, tags before it, container, characters in links) per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.places: list[int] = []
        self.linked: list[int] = []
        #: Container tree: parent, element, and weight of each (1: not named); 0 is the page.
        self.parent, self.names, self.weights = [0], ["html"], [1.0]
        self.open = [0]
        self.count: Counter[str] = Counter()
        self.unseen = 0  # open containers whose content isn't seen
        self.links = 0  # open links
        self.seen = 0
        self.parts: list[str] = []
        self.in_links = 0
        self.raw = ""

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.texts.append(text)
                self.tags.append(self.seen)
                self.places.append(self.open[-1])
                self.linked.append(min(self.in_links, len(text)))
                self.seen = 0
            self.in_links = 0

    def handle_starttag(self, tag, attrs):
        self.seen += 1
        if tag in BLOCKS:
            self.flush()
        if tag in ("script", "style"):
            self.raw = tag
            return
        if tag == "a":
            self.links += 1
        if tag not in CONTAINERS:
            return
        self.flush()
        self.parent.append(self.open[-1])
        self.names.append(tag)
        self.weights.append(weight(tag, attrs))
        self.open.append(len(self.parent) - 1)
        self.count[tag] += 1
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        # a slash on an element that isn't void has no meaning in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.seen += 1
        if tag in ("script", "style"):
            self.raw = ""
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS or tag in CONTAINERS:
            self.flush()
        if self.count[tag]:
            name = ""
            while name != tag:
                name = self.names[self.open.pop()]
                self.count[name] -= 1
                self.unseen -= name in UNSEEN

    def handle_data(self, data):
        if not self.raw and not self.unseen:
            self.parts.append(data)
            if self.links:
                self.in_links += len(data.strip())


def weight(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """1 for a container that nothing names as boilerplate; FIRM or LOOSE by what names it."""
    if tag in ("body", "html", "article", "main"):
        return 1.0
    out = FIRM if tag in NAMED else LOOSE if tag == "form" else 1.0
    for name, value in attrs:
        if not value or name not in ("class", "id", "role"):
            continue
        for word in value.split():
            if word.lower() in BOILERPLATE:
                return FIRM
            if not BOILERPLATE.isdisjoint(_WORDS.findall(word.lower())) or not BOILERPLATE.isdisjoint(x.lower() for x in _SPLIT.findall(word)):
                out = min(out, LOOSE)
    return out


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Convolution with the Gaussian; at the ends its weights are scaled to sum to one."""
    ones = np.convolve(np.ones(len(ratios)), _KERNEL)[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, _KERNEL)[RADIUS : RADIUS + len(ratios)] / ones


def content_lines(texts: list[str], tags: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """Marks the lines whose smoothed text-to-tag ratio, weighed, reaches the threshold."""
    sizes = np.fromiter(map(len, texts), np.float64, len(texts))
    weights = np.ones(len(texts)) if weights is None else weights
    s = smoothed(sizes / np.maximum(np.array(tags, np.float64), 1)) * weights
    return s >= min(float(s.std()), float(s.max()))


def extract_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    if not p.texts:
        return ""
    parent, n = p.parent, len(p.parent)
    # parents come before their children, so one pass down and one pass up see the whole tree
    main = [name in ("article", "main") for name in p.names]
    weights, within, above = [1.0] * n, [False] * n, [0] * n
    for k in range(1, n):
        weights[k] = max(LEAST, weights[parent[k]] * p.weights[k])
        within[k] = main[k] or within[parent[k]]
        above[k] = k if main[k] else above[parent[k]]  # the innermost article or main
    outside = LOOSE if any(within[x] for x in p.places) else 1.0
    of_line = [weights[x] * (1.0 if within[x] else outside) * (LOOSE if a > LINKS * len(t) else 1.0) for x, t, a in zip(p.places, p.texts, p.linked, strict=True)]
    content = content_lines(p.texts, p.tags, np.array(of_line)).tolist()
    size, held, linked = [0] * n, [0] * n, [0] * n
    for x, text, c, a in zip(p.places, p.texts, content, p.linked, strict=True):
        size[x] += len(text)
        linked[x] += a
        held[x] += len(text) * c
    for k in range(n - 1, 0, -1):
        for total in (size, held, linked):
            total[parent[k]] += total[k]
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[parent[k]] or (p.weights[k] < 1 and 2 * held[k] < size[k] and 2 * held[k] < held[0])
    if all(gone[x] for x, c in zip(p.places, content, strict=True) if c):
        gone = [False] * n
    # what is gone takes its content along
    chars, lines, own = [0] * n, [0] * n, [False] * n
    for x, text, c in zip(p.places, p.texts, content, strict=True):
        if c and not gone[x]:
            chars[x] += len(text)
            lines[x] += 1
            own[x] = True
    for k in range(n - 1, 0, -1):
        for total in (chars, lines):
            total[parent[k]] += total[k]
    region = max(k for k in range(n) if chars[k] >= MOST * chars[0] and lines[k] >= MOST * lines[0])
    inside = [k == (above[region] or region) for k in range(n)]
    for k in range(1, n):
        inside[k] |= inside[parent[k]]
    if above[region]:
        keep = [inside[x] and not gone[x] for x in p.places]
    else:
        for k in range(1, n):
            gone[k] |= gone[parent[k]] or (not held[k] and not within[k] and linked[k] > LINKS * size[k])
            own[k] |= bool(main[k] and chars[k]) or (within[k] and own[parent[k]] and within[parent[k]])
        at = [i for i, (x, c) in enumerate(zip(p.places, content, strict=True)) if c and inside[x] and not gone[x]]
        first, last = (at[0], at[-1]) if at else (0, -1)
        keep = [inside[x] and (own[x] or first <= i <= last) and not gone[x] for i, x in enumerate(p.places)]
    return " ".join(t for t, k in zip(p.texts, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row."""

    def run(html):
        texts = list(map(extract_text, html.to_pylist()))
        return texts, list(map(len, texts))

    return mapped(pages.select("page_id", "url", "html"), ["html"], run, "text string, n_chars long", ["page_id", "url"])


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

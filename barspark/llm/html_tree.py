"""A page as a tree of block elements with their text, and the features of each block."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no part of the page as read.
UNSEEN = frozenset("head script style noscript template iframe object svg math select option textarea button canvas audio video".split())
#: Elements that may stand in the head; the first other one, and any text outside them, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What an opening element closes, up to the first element that holds it.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Groups of tags and of attribute words (of class, id and role) that features count.
TAGS = ("p", "div section", "li dt dd", "h1 h2 h3 h4 h5 h6", "article main", "nav menu", "aside", "header", "footer", "form fieldset", "table tr td th tbody thead", "ul ol dl", "blockquote pre figure figcaption")
TOKENS = (
    "article content post entry story text body main prose",
    "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager",
    "header masthead banner branding logo",
    "footer copyright legal colophon",
    "sidebar aside rail related recommended recommendations widget popular trending",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "comment comments reply replies discussion disqus respond",
    "cookie cookies consent notice alert gdpr popup modal overlay",
    "form subscribe newsletter signup login search share social follow",
)
WORDS = re.compile(r"[a-z]+")
TAG_GROUP = {t: k for k, group in enumerate(TAGS) for t in group.split()}
TOKEN_GROUP = {t: k for k, group in enumerate(TOKENS) for t in group.split()}
N_FEATURES = len(TAGS) + 2 * len(TOKENS) + 17


#: A tag that the page ends in is dropped, as browsers do.
UNENDED = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")


class Page(HTMLParser):
    """Blocks in page order (parents first) and segments of text, each inside one block."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.attrs, self.truth = ["html"], [-1], [frozenset()], [None]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.links = self.unseen = 0
        self.segments: list[tuple[int, list[str]]] = []
        self.own, self.linked, self.inside = [0], [0], [0]
        self.fresh = True
        self.feed(UNENDED.sub("", html))
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in VOID:
            self.fresh = self.fresh or tag in ("br", "hr")
            return
        if tag not in INLINE:
            if tag in CLOSES:
                ends, holders = CLOSES[tag]
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k][0] in holders:
                        break
                    if self.open[k][0] in ends.split():
                        self._pop(k)
                        break
            else:
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k][0] == "p":
                        self._pop(k)
                        break
                    if self.open[k][0] not in INLINE:
                        break
        block = self.open[-1][1]
        if tag in INLINE:
            self.inside[block] += 1
            self.links += tag == "a"
        else:
            words = set()
            truth = self.truth[block]
            for name, value in attrs:
                if name in ("class", "id", "role"):
                    words.update(TOKEN_GROUP[w] for w in WORDS.findall((value or "").lower()) if w in TOKEN_GROUP)
                elif name == "data-main":
                    truth = value == "1"
            self.tags.append(tag)
            self.parents.append(block)
            self.attrs.append(frozenset(words))
            self.truth.append(truth)
            for counts in (self.own, self.linked, self.inside):
                counts.append(0)
            block = len(self.tags) - 1
            self.fresh = True
            self.unseen += tag in UNSEEN
        self.open.append((tag, block))

    def _end_head(self) -> None:
        """End a head that is the innermost open element: its end tag may be left out."""
        if self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)

    def _pop(self, upto: int) -> None:
        for tag, _ in self.open[upto:]:
            self.links -= tag == "a"
            self.unseen -= tag in UNSEEN
            self.fresh = self.fresh or tag not in INLINE
        del self.open[upto:]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if self.unseen:
            return
        block = self.open[-1][1]
        if self.fresh or not self.segments or self.segments[-1][0] != block:
            if data.isspace():
                return
            self.segments.append((block, []))
            self.fresh = False
        self.segments[-1][1].append(data)
        n = len(data)
        self.own[block] += n
        if self.links:
            self.linked[block] += n


def block_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features (blocks x N_FEATURES) and characters of text in each subtree."""
    n = len(page.tags)
    size, link, tags, depth = page.own.copy(), page.linked.copy(), [1 + k for k in page.inside], [0] * n
    children, commas = [0] * n, [0] * n
    for block, parts in page.segments:
        commas[block] += sum(p.count(",") + p.count(".") for p in parts)
    place = [0] * n
    for k in range(1, n):
        up = page.parents[k]
        depth[k] = depth[up] + 1
        place[k] = children[up]
        children[up] += 1
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        size[up] += size[k]
        link[up] += link[k]
        tags[up] += tags[k]
        commas[up] += commas[k]
    siblings: dict[tuple[int, str], int] = {}
    kin_size: dict[tuple[int, str], int] = {}
    for k in range(n):
        key = page.parents[k], page.tags[k]
        siblings[key] = siblings.get(key, 0) + 1
        kin_size[key] = kin_size.get(key, 0) + size[k]
    x = np.zeros((n, N_FEATURES))
    a, b = len(TAGS), len(TAGS) + len(TOKENS)
    whole, seen = max(size[0], 1), 0
    before = [0] * n
    for k in range(n):
        before[k] = seen
        seen += page.own[k]
    for k in range(n):
        row, up, tag = x[k], page.parents[k], page.tags[k]
        if tag in TAG_GROUP:
            row[TAG_GROUP[tag]] = 1
        for t in page.attrs[k]:
            row[a + t] = 1
        if up >= 0:  # what stands above: attribute words and kinds of elements
            row[b : b + len(TOKENS)] = np.maximum(x[up, a : a + len(TOKENS)], x[up, b : b + len(TOKENS)])
        rest = row[b + len(TOKENS) :]
        if up >= 0:
            above = x[up, b + len(TOKENS) :]
            rest[0] = above[0] or page.tags[up] in ("article", "main")
            rest[1] = above[1] or page.tags[up] in ("nav", "menu", "aside", "header", "footer", "form")
            rest[2] = above[2] or page.tags[up] in ("ul", "ol", "dl", "table")
            rest[3] = size[k] / max(size[up], 1)
            rest[4] = place[k] / children[up]
            rest[5] = siblings[up, tag]
            rest[6] = kin_size[up, tag] / siblings[up, tag]
        rest[7] = depth[k]
        rest[8] = size[k]
        rest[9] = page.own[k]
        rest[10] = link[k] / max(size[k], 1)
        rest[11] = size[k] / tags[k]
        rest[12] = size[k] / whole
        rest[13] = children[k]
        rest[14] = commas[k] / max(size[k], 1)
        rest[15] = before[k] / whole
        rest[16] = tags[k]
    return x, np.array(size)

"""Main text of web pages from parser events and text-to-tag ratios."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadwright.llm.common import mapped

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements that never hold text of the article.
NEVER = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
#: Elements that are never left out for their class, id or role; an article only for one that is such a word as a whole, or a reader's comment.
SAFE = frozenset("body html main".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of a class or id that name what surrounds an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs cc comment comments commentlist consent cookie cookies cookiebar disqus dock footer gdpr header login masthead menu menubar modal nav navbar"
    " navigation newsletter notice notices pager paginate pagination popup promo promotion promoted recommended register related replies respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription teaser toolbar topbar widget widgets".split()
)
#: What may follow such a word in a class or id that means the same: `ad-slot`, `comment-list`; anything else may, as in `search-engines`, be a subject.
PARTS = frozenset(
    "area articles bar block body box button buttons column container content first form group holder icons inner item items last left link links list main top bottom panel post posts right row section slot stories text thread title top unit wrap wrapper zone"
    " big compact fixed full horizontal inline large leaderboard medium mini narrow overlay small sticky tall vertical wide window".split())
#: Words of an article's class that make it a reader's comment.
COMMENT = frozenset("comment comments commentlist reply replies".split())
#: What stands before `header` where it is the article's own.
OWN = frozenset("article blog content entry news page post single story title".split())
#: What says that a class is about the layout or the subject: `has-sidebar`, `with-menu`, `category-ads`.
LAYOUT = frozenset("category format has no status tag topic type with without".split())
#: Blocks of running text, which are kept at the edges of a text where they stand beside its paragraphs.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt figcaption td th".split())
#: Elements that only hold others of a list, table or heading.
HOLDERS = frozenset("ul ol dl table tbody thead tr li td th dd dt blockquote figure header hgroup".split())
#: Blocks whose text is no menu even if all of it is a link.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: The share of a line's characters in links and the length up to which it is one of a menu, and the characters for a tag of a line that is text whatever cluster it is in.
LINKED, SHORT, TEXT = 0.6, 100, 60
#: The shares of the selected characters that an article or main holds if it is the page's: the innermost with the first, else the one with most if that is the second.
MOST, LEAST = 0.6, 1 / 3
#: Blocks of an article whose short lines are kept at its ends if they end as a sentence does.
PLAIN, SENTENCE = frozenset("div section article main".split()), tuple(".!?…:;\"'”’»)")
#: How a line of rights begins.
RIGHTS = re.compile(r"(©|\(c\)|copyright\b|all rights reserved\b)", re.IGNORECASE).match
#: Half the width of the smoothing kernel, in lines, and its deviation.
REACH, SIGMA = 2, 1.0


def _words(name: str) -> list[str]:
    """The words of a class or id, without numbers."""
    return [w for w in re.split(r"[^a-z]+", name.lower()) if w]


def _named_around(name: str, inside: bool) -> bool:
    """Whether one class or id names what surrounds an article: as a whole, by its last word before words of PARTS, or by its first before these."""
    words = _words(name)
    if not words or LAYOUT.intersection(words):
        return False
    while len(words) > 1 and words[-1] in PARTS and words[-1] not in AROUND:
        words.pop()
    if words[-1] in ("header", "masthead") and (inside or OWN.intersection(words)):
        return False
    return words[-1] in AROUND or words[0] in AROUND and PARTS.issuperset(words[1:])


def _names(attrs: list[tuple[str, str | None]]) -> list[str]:
    return [one for name, value in attrs if name in ("class", "id") and value for one in value.split()]


def _surrounds(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form, script, style or reader comment. inside: an article, a main or a post is open."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    if tag in SAFE:
        return False
    if tag == "article":
        return any(len(w := _words(n)) == 1 and w[0] in AROUND or w and w[0] in COMMENT and PARTS.issuperset(w[1:]) for n in _names(attrs))
    if any(_named_around(one, inside) for one in _names(attrs)):
        return True
    return any(name == "role" and value and value.lower().strip() in ROLES for name, value in attrs)


class Lines(HTMLParser):
    """Collects a page's lines: runs of text between block elements, each with its number of tags, its element and its share in links.

    Elements are numbered as they open, so a subtree is a run of numbers. What a line needs of the elements above it is
    handed down as they open, and open elements are looked up by tag, so that depth costs nothing.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.last = ["#page"], [0]  # by number; the last number of the subtree
        self.parents = [0]
        self.block = [0]  # the innermost block at or above
        self.holder = [0]  # the innermost block at or above that is no list or table
        self.root = [0]  # the innermost article or main at or above
        self.open = [0]  # numbers of the open elements
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self.out = 0  # how deep the first open element that surrounds the article stands, or 0
        self.own: list[int] = []  # depths of open articles, mains and elements named like a post
        self.pieces: list[str] = []
        self.size = self.count = self.linked = 0  # characters, tags, and characters in links of this line
        self.lines: list[tuple[str, int, int, float]] = []

    def flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.lines.append((text, self.count, self.open[-1], self.linked / max(1, self.size)))
            self.pieces = []
        self.size = self.count = self.linked = 0

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.open) > depth:
            number = self.open.pop()
            self.last[number] = len(self.tags) - 1
            self.depths[self.tags[number]].pop()
        while self.own and self.own[-1] >= depth:
            self.own.pop()
        if self.out >= depth:
            self.out = 0

    def depth_of(self, tag: str, stop: frozenset | tuple = ()) -> int:
        """How deep the innermost open element of a tag stands; 0 if there is none or one of stop stands inside it."""
        found = self.depths[tag][-1] if self.depths.get(tag) else 0
        return 0 if any(self.depths.get(t) and self.depths[t][-1] > found for t in stop) else found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            if tag != "br" and (depth := self.depth_of("p", ("button", "td", "th", "table", "div", "article", "section", "body"))):
                self.cut(depth)
            same = {"li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dd": ("dl",), "dt": ("dl",), "option": ("select",)}.get(tag)
            if same and (depth := self.depth_of(tag, same)):
                self.cut(depth)
        self.count += 1
        if tag in VOID:
            return
        above, number = self.open[-1], len(self.tags)
        self.tags.append(tag)
        self.last.append(number)
        self.parents.append(above)
        self.block.append(number if tag in BLOCK else self.block[above])
        self.holder.append(number if tag in BLOCK and tag not in HOLDERS else self.holder[above])
        self.root.append(number if tag in ("article", "main") else self.root[above])
        self.open.append(number)
        depth = len(self.open) - 1
        self.depths.setdefault(tag, []).append(depth)
        if not self.out and _surrounds(tag, attrs, bool(self.own)):
            self.out = depth
        if tag in ("article", "main") or tag in ("div", "section") and any((w := _words(n)) and (w[0] in OWN or w[-1] in OWN) for n in _names(attrs)):
            self.own.append(depth)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tags[self.open[-1]] == tag and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        if tag in BLOCK:
            self.flush()
        if tag not in VOID and (depth := self.depth_of(tag)):
            self.cut(depth)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections such as `<![if x]>` are comments."""
        return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if not self.out:
            size = len(data.strip())
            self.pieces.append(data)
            self.size += size
            self.linked += size if self.depths.get("a") else 0


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Each line's ratio as a Gaussian mean over its neighbours."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[REACH:-REACH]
    return np.convolve(ratios, kernel, "full")[REACH:-REACH] / weight


def threshold(values: np.ndarray) -> float:
    """The midpoint between the means of two clusters of the values; never above the largest."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        upper = values >= min((low + high) / 2, values.max())
        now = float(values[~upper].mean()) if not upper.all() else low, float(values[upper].mean())
        if now == (low, high):
            break
        low, high = now
    return min((low + high) / 2, float(values.max()))


def ratios(lines: list[tuple]) -> np.ndarray:
    return np.array([len(line[0]) / max(1, line[1]) for line in lines])


def clusters(lines: list[tuple]) -> np.ndarray:
    """Which lines are in the upper of two clusters of the logarithms of the smoothed ratios of characters to tags, so that one very long paragraph is not a cluster of its own."""
    values = np.log(smoothed(ratios(lines)))
    return values >= threshold(values)


def _article(page: Lines, upper: np.ndarray) -> int:
    """The number of the article or main that holds the selected lines; 0 if none does."""
    held = dict.fromkeys((n for n, tag in enumerate(page.tags) if tag in ("article", "main")), 0)
    whole = 0
    for i in np.flatnonzero(upper):
        size = len(page.lines[i][0])
        whole += size
        if root := page.root[page.lines[i][2]]:
            held[root] += size
    for n in sorted(held, reverse=True):  # inner ones before those around them
        if outer := page.root[page.parents[n]]:
            held[outer] += held[n]
    if most := [n for n, size in held.items() if size and size >= MOST * whole]:
        return max(most)
    best = max(held, key=lambda n: (held[n], n), default=0)
    return best if best and held[best] >= LEAST * whole > 0 else 0


def main_text(html: str | None) -> str:
    """The article of a page as one string; empty for null, for an empty page and for one without an article's text.

    Parser events give lines; those of surrounding elements (menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, reader comments) are left out. The others have a ratio of characters to tags; the ratios are smoothed
    and their logarithms split into two clusters. An article or main that holds most of the upper cluster bounds the text;
    without one the whole page does. Inside these bounds the text goes from the first to the last line that is of the upper
    cluster, by its own ratio or as running text, or TEXT characters a tag. Between them all is kept but lines of menus and, without an article, of rights. At both ends running text
    beside it is kept too: paragraphs, headings and list items, in an article also other lines that end as a sentence does;
    without one, such as stand in the same element as a selected line. Time and memory grow with the page's length, however
    deep or broken it is.
    """
    page = Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    if not page.lines:
        return ""
    menu = np.array([share >= LINKED and len(text) < SHORT and page.tags[page.block[at]] not in PROSE for text, _, at, share in page.lines])
    upper, limit = clusters(page.lines) & ~menu, threshold(np.log(smoothed(ratios(page.lines))))
    root = _article(page, upper)
    within = np.array([root <= line[2] <= page.last[root] for line in page.lines]) if root else np.ones(len(page.lines), bool)
    lines, menu, upper = [line for line, there in zip(page.lines, within) if there], menu[within], upper[within]

    keep = np.array([bool(root) or not (m or RIGHTS(line[0])) for m, line in zip(menu, lines)])
    blocks = [page.block[line[2]] for line in lines]
    running = np.array([page.tags[b] in RUNNING for b in blocks])
    own = ratios(lines)
    dense = np.log(own) >= limit  # not by its neighbours alone
    text = keep & (upper & (running | dense) | (own >= TEXT))
    if not text.any():
        text = keep = keep if keep.any() else np.ones(len(lines), bool)
    if root:
        near = keep & (running | np.array([page.tags[b] in PLAIN and line[0].endswith(SENTENCE) for b, line in zip(blocks, lines)]))
    else:
        beside = [page.holder[page.parents[b]] for b in blocks]  # the element that holds a line's block, past lists and tables
        homes = {beside[i] for i in np.flatnonzero(text)}
        near = keep & running & np.array([b in homes for b in beside])
    places = np.flatnonzero(text)
    first, last = places[0], places[-1]
    while first and near[first - 1]:
        first -= 1
    while last + 1 < len(lines) and near[last + 1]:
        last += 1
    return " ".join(lines[i][0] for i in range(first, last + 1) if keep[i])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages without the html, with text (main_text of the whole page) and n_chars, its code points.

    A null or empty page has empty text; repeated pages are read each; an empty table gives an empty one; columns named
    text and n_chars are replaced. One page at a time is held in a task, so a very long page costs its own length.
    """

    def make():
        def read(htmls: list[str | None]) -> list[pa.Array]:
            texts = [main_text(x) for x in htmls]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return read

    return mapped(pages, html, {"text": "string", "n_chars": "long"}, make, [c for c in pages.columns if c != html])

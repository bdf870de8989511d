"""Main text of HTML pages by text-to-tag ratios of lines.

The events of the standard library's parser cut a page into lines at block elements. Each line has a ratio of
characters outside links to tags; the ratios are smoothed by a Gaussian and split into two clusters by a threshold.

Lines of the upper cluster show where the article is: every ``article`` or ``main`` if one of them holds such a line,
or else the lowest element above single paragraphs and lists that holds them all, each with the headings and paragraphs
beside it and beside the elements around it. All lines of that region return, short ones too, but for

* what a tag, a role or an unmistakable name says is no article (menus, footers, adverts, forms, scripts, comments);
* elements whose name only suggests it (sharing, related, notice, header), unless they hold a line of the upper cluster;
* runs of nothing but links outside of articles, where none of their lines is in the upper cluster.

A name counts as a whole: ``site-header`` is one, ``social-sciences``, ``login-guide`` and ``article-header`` are not.
Every step is linear in the size of the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.llm.common import read_table

SIGMA = 1.0
RADIUS = 2
ROUNDS = 20
MENU_LINKS = 3
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
BOILER_TAGS = frozenset(
    "head title script style noscript template nav footer aside form button select textarea iframe svg object canvas "
    "dialog menu fieldset".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Names of elements that are no article, and names that only suggest it.
SURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr alert popup "
    "modal overlay newsletter subscribe sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "topbar comment comments disqus respond replies widget toolbar pagination pager paywall".split()
)
LIKELY_NAMES = frozenset("notice notices signup header share sharing social related recommended skip login".split())
#: What may stand beside such a word in a name, and what only beside words of what belongs to an article.
AROUND = frozenset(
    "site page main top bottom left right list box bar container wrapper wrap block section area button buttons link links "
    "icon icons inner outer item items group primary secondary form panel column col row global mobile desktop sticky fixed "
    "floating small large unit slot text js the".split()
)
OWNERS = frozenset("article post entry user reader posts articles stories content".split())
OWNED = frozenset("comment comments replies share sharing nav navigation related recommended ad ads social".split())
REGIONS = ("article", "main")
BESIDE_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
LEAF_TAGS = BESIDE_TAGS | frozenset("li dt dd ul ol dl pre blockquote figure figcaption address td th tr".split())
KEEPS_PARAGRAPH_OPEN = INLINE | VOID - {"hr"}
KEPT, LIKELY, SURE = range(3)


def name_says(name: str) -> int:
    """Whether one class or id names boilerplate for sure, likely, or not."""
    parts = [p for p in name.lower().replace("_", "-").split("-") if p and not p.isdigit()]
    found = [p for p in parts if p in SURE_NAMES or p in LIKELY_NAMES]
    owned = any(p in OWNED for p in found)
    if not found or any(p not in AROUND and p not in found and not (owned and p in OWNERS) for p in parts):
        return KEPT
    return SURE if any(p in SURE_NAMES for p in found) else LIKELY


def says_boilerplate(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> int:
    """Whether an element by its tag, role, class or id is no part of an article."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return SURE
    names = [n for k, v in attributes if k in ("class", "id") and v for n in v.split()]
    if tag in REGIONS or tag in ("html", "body"):
        return SURE if any(n.lower() in ("comment", "comments", "reply", "advertisement") for n in names) else KEPT
    for key, value in attributes:
        if key == "role" and value and value.lower() in BOILER_ROLES:
            return SURE
        if key == "hidden" or (key == "aria-hidden" and value and value.lower() == "true"):
            return SURE
    said = max(map(name_says, names), default=KEPT)
    return KEPT if tag in ("header", "h1", "h2") and in_article else said


class Line(NamedTuple):
    """Text, tags since the line before, letters and number of its links, and the elements it is in."""

    text: str
    tags: int
    linked: int
    links: int
    element: int
    dropped: bool
    likely: int
    in_article: bool


class Open(NamedTuple):
    """An open element: its number (that of the block around it if inline), and what it says of its text."""

    tag: str
    element: int
    dropped: bool
    likely: int
    in_article: bool


class Lines(HTMLParser):
    """Collects the lines of a page and the tree of its block elements, which are numbered from the top."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Open("", 0, False, -1, False)]
        self.shut: list[bool] = [False]  # inline elements closed before those inside them
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.count = self.linked = self.links = 0

    def _end_line(self) -> None:
        if self.text:
            words = "".join(self.text).split()
            if words:
                top = self.stack[-1]
                self.lines.append(Line(" ".join(words), max(1, self.count), self.linked, self.links, *top[1:]))
                self.count = 0
            self.text, self.linked, self.links = [], 0, 0

    def _push(self, entry: Open) -> None:
        self.places.setdefault(entry.tag, []).append(len(self.stack))
        if entry.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(entry)
        self.shut.append(False)

    def _cut(self, place: int) -> None:
        """Close everything from a place of the stack on, and what was closed below it."""
        while len(self.stack) > max(place, 1) or (len(self.stack) > 1 and self.shut[-1]):
            at = len(self.stack) - 1
            if not self.shut[-1]:
                self.places[self.stack[-1].tag].pop()
            if self.blocks[-1] == at:
                self.blocks.pop()
            self.stack.pop(), self.shut.pop()

    def handle_starttag(self, tag: str, attributes: list) -> None:
        top = self.stack[-1]
        self.count += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in INLINE:
            said = says_boilerplate(tag, attributes, top.in_article) if attributes and not top.dropped else KEPT
            if said == SURE:
                self._end_line()
            if tag == "a":
                self.links += 1
            if tag not in VOID:
                self._push(top._replace(tag=tag, dropped=top.dropped or said == SURE))
            return
        self._end_line()
        if tag not in KEEPS_PARAGRAPH_OPEN and self.stack[self.blocks[-1]].tag == "p":
            self._cut(self.blocks[-1])
            top = self.stack[-1]
        if tag in VOID:
            return
        said = KEPT if top.dropped else says_boilerplate(tag, attributes, top.in_article)
        self.parents.append(top.element)
        self.tags.append(tag)
        number = len(self.tags) - 1
        likely = number if said == LIKELY and top.likely < 0 else top.likely
        self._push(Open(tag, number, top.dropped or said == SURE, likely, top.in_article or tag in REGIONS))

    def handle_endtag(self, tag: str) -> None:
        self.count += 1
        places = self.places.get(tag)
        if tag not in INLINE:
            self._end_line()
            if places:
                self._cut(places[-1])
            return
        if not places or places[-1] < self.blocks[-1]:
            return
        at = places.pop()
        if self.stack[at].dropped != self.stack[at - 1].dropped:
            self._end_line()
        if at == len(self.stack) - 1:
            places.append(at)
            self._cut(at)
        else:
            self.shut[at] = True

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.places.get("a"):
            self.linked += sum(map(len, data.split()))

    def close(self) -> None:
        super().close()
        self._end_line()


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Lines of the upper of two clusters of smoothed ratios."""
    at = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(at**2) / (2 * SIGMA**2))
    smooth = np.convolve(ratios, kernel)[RADIUS:-RADIUS] / np.convolve(np.ones(len(ratios)), kernel)[RADIUS:-RADIUS]
    level = np.log1p(smooth)
    threshold = (level.min() + level.max()) / 2
    for _ in range(ROUNDS):
        upper = level > threshold
        if upper.all() or not upper.any():
            return np.ones(len(ratios), dtype=bool)
        moved = (level[upper].mean() + level[~upper].mean()) / 2
        if moved == threshold:
            break
        threshold = moved
    return level > threshold


def core_lines(ratios: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Lines of the upper cluster that are nearer to it by their own ratio too, not only by that of their neighbours."""
    if chosen.all():
        return chosen
    own = np.log1p(ratios)
    core = chosen & (own >= (own[chosen].mean() + own[~chosen].mean()) / 2)
    return core if core.any() else chosen


def _menus(lines: list[Line], chosen: np.ndarray) -> set[int]:
    """Lines of runs of nothing but links outside of articles, none of which is in the upper cluster."""
    found: set[int] = set()
    run: list[int] = []
    for k in range(len(lines) + 1):
        if k < len(lines) and lines[k].links and not lines[k].in_article and 10 * lines[k].linked >= 9 * sum(map(len, lines[k].text.split())):
            run.append(k)
            continue
        if sum(lines[i].links for i in run) >= MENU_LINKS and not chosen[run].any():
            found.update(run)
        run = []
    return found


def _regions(page: Lines, lines: list[Line], chosen: np.ndarray) -> set[int]:
    """Elements whose lines make up the article."""
    held = [0] * len(page.tags)
    for line, content in zip(lines, chosen):
        held[line.element] += int(content)
    total = sum(held)
    for e in range(len(held) - 1, 0, -1):  # elements follow those they are in
        held[page.parents[e]] += held[e]
    lowest = max((e for e, n in enumerate(held) if n == total), default=0)
    for tag in REGIONS:
        regions = {e for e, t in enumerate(page.tags) if t == tag}
        if any(held[e] for e in regions):
            return regions | _beside(page, lowest, lines)
    while page.tags[lowest] in LEAF_TAGS:
        lowest = page.parents[lowest]
    return {lowest} | _beside(page, lowest, lines)


def _beside(page: Lines, element: int, lines: list[Line]) -> set[int]:
    """Headings and paragraphs right in an element or in one that it lies in."""
    around = set()
    while element >= 0:
        around.add(element)
        element = page.parents[element]
    return {i.element for i in lines if page.tags[i.element] in BESIDE_TAGS and page.parents[i.element] in around}


def main_text(html: str | None) -> str:
    """Text of the article of a page; empty for a null or a page without text."""
    page = Lines()
    page.feed(html or "")
    page.close()
    if not page.lines:
        return ""
    ratios = np.array([0.0 if i.dropped else max(0, len(i.text) - i.linked) / i.tags for i in page.lines])
    chosen = core_lines(ratios, content_lines(ratios))
    upheld = {i.likely for i, content in zip(page.lines, chosen) if content and not i.dropped}
    menus = _menus(page.lines, chosen)
    stays = [k for k, i in enumerate(page.lines) if not i.dropped and (i.likely < 0 or i.likely in upheld) and k not in menus]
    lines = [page.lines[k] for k in stays]
    regions = _regions(page, lines, chosen[stays])
    inside = [False] * len(page.tags)
    for e, parent in enumerate(page.parents):
        inside[e] = e in regions or (parent >= 0 and inside[parent])
    return " ".join(i.text for i in lines if inside[i.element])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(1)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), sizes], ["row", "text", "n_chars"])


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``row`` (the other columns), ``text`` and ``n_chars`` of every page.

    Each page is read on its own and whole, however long or deeply nested it is. A null page and one without
    text give an empty text. Repeated rows each return, other columns of any name are kept inside ``row``, and an empty
    table gives an empty result.
    """
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_column]
    source = pages.select(F.struct(*others).alias("row"), html_column)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return source.mapInArrow(_extract, T.StructType([source.schema["row"], *fields]))


def op9_text_regions(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("row.page_id", "row.url", "text", "n_chars")

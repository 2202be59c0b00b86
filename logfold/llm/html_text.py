"""HTML extraction (7): parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams its events into lines: a line is the text between two block boundaries, with the
number of tags met in it, whether it stands in links, and the sectioning element (region) around it. Subtrees that are
never content by their tag (scripts, menus, ...) give no lines. Those set aside by role, form or a whole class or id name
(comments, cookie-notice, siteHeader, but not has-sidebar or social-science) give none either, unless the page's only
article or main element stands in them, or a form holds most of the page, or nothing else has any text. Each line's ratio of
characters to tags, without link text, is smoothed by a Gaussian over its neighbours; two-means clustering of the ratios'
logarithms gives the page's threshold. A region is content if its lines pass it, articles and main elements before any
other region; a content region keeps all its lines, long or short, in page order, but for regions inside it (lists, parts)
of MENU lines or more that are nothing but links and mostly stay below the threshold with their neighbours: menus.

Null and empty pages, and pages without any text, give an empty text. Character references are decoded, white space in a
line becomes one space, lines are joined by an empty line. Unclosed and stray tags are taken as browsers do: a block closes
an open paragraph, and an end tag closes all that it encloses. Very long pages are read whole. Repeated rows are each
returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from heapq import heapify, heappop, heappush
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from logfold.llm.common import arrow_map, table

# Fixed element names.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("head script style noscript template svg math canvas iframe object audio video nav footer aside button select textarea menu dialog".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
_SPACES = frozenset("br td th option wbr".split())
_REGIONS = frozenset("article main section div body td".split())
_LISTS = frozenset("ul ol dl nav table p".split())
#: What an end tag of the second kind doesn't reach through.
_WALLS = frozenset("article main section td table ul ol div".split())
_STRAY = frozenset("p li a b i em strong span".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus share sharing social related recommended footer masthead newsletter subscribe subscription signup login popup modal overlay widget pager pagination toolbar".split())
_KEPT = frozenset("html body article main".split())
_ARTICLE_NAMES = frozenset("comment comments ad sponsored promo".split())
_OUTER_NAMES = _NAMES | {"header"}
#: Words that go with those names in compounds.
_BESIDE = frozenset("site page main top bottom left right primary secondary global header container wrapper wrap inner outer box block area zone list lists item items link links bar slot unit section post posts entry article articles story stories button buttons icon icons form google text x jp wp js sticky mobile desktop".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SIGMA = 1.0
#: Lines of a region that are nothing but links, to be a menu.
MENU = 3


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether one of the white-space separated names is of names, alone or in a compound of such words only."""
    for name in value.split():
        words = {x.lower() for x in _NAME.findall(name)}
        if words & names and words <= names | _BESIDE:
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines: text, tags, link characters and region."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.aside: list[int] = []  # per line, the innermost element set aside around it, 0 for none
        self.asides: list[tuple[int, bool]] = [(0, False)]  # the one around each, and whether it is a form
        self.regions: list[tuple[str, int]] = [("body", 0)]  # tag and the region around it
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, skipped, region, set aside
        self.open: defaultdict[str, list[int]] = defaultdict(list)  # per tag, its places in the stack
        self.walls: list[int] = []  # places of the elements that stray end tags don't close
        self.within: defaultdict[int, list[int]] = defaultdict(list)  # per element set aside, regions of the open elements in it
        self.parts: list[tuple[int, str, int]] = []  # set aside, text, link characters
        self.tags = 0

    @property
    def _skipped(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    @property
    def _aside(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def _region(self, aside: int) -> int:
        """The region at this place for text of an element set aside, or of none."""
        if self.within[aside]:
            return self.within[aside][-1]
        return self.stack[-1][2] if aside and self.stack else 0

    def _break(self) -> None:
        if self.parts:
            for aside in dict.fromkeys(x for x, *_ in self.parts):
                text = " ".join("".join(t for x, t, _ in self.parts if x == aside).split())
                if text:
                    self.lines.append((text, self.tags, sum(n for x, _, n in self.parts if x == aside), self._region(aside)))
                    self.aside.append(aside)
                    self.tags = 0
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in _BLOCKS:
            self._break()
            if self.open["p"] and self.open["p"][-1] >= len(self.stack) - 8:
                self._close("p")
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self._close("li")
        elif tag in _SPACES:
            self.parts.append((self._aside, " ", 0))
        if tag in _VOID:
            return
        skipped = self._skipped or tag in _SKIPPED or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs if tag not in _KEPT)
        aside = self._aside
        if not skipped and (tag == "form" or self._boilerplate(tag, attrs)):
            self.asides.append((aside, tag == "form"))
            aside = len(self.asides) - 1
        region = self.stack[-1][2] if self.stack else 0
        if (tag in _REGIONS or tag in _LISTS) and not skipped:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.open[tag].append(len(self.stack))
        if tag in _WALLS:
            self.walls.append(len(self.stack))
        self.within[aside].append(region)
        self.stack.append((tag, skipped, region, aside))

    def _boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _KEPT:
            return tag == "article" and any(_named(v, _ARTICLE_NAMES) for k, v in attrs if k in ("class", "id") and v)
        inside = bool(self.open["article"] or self.open["main"])
        if tag == "header" and not inside:
            return True
        for k, v in attrs:
            if v and (k == "role" and v.lower() in _ROLES or k in ("class", "id") and _named(v, _NAMES if inside else _OUTER_NAMES)):
                return True
        return False

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        at = self.open[tag][-1]
        if tag in _STRAY and self.walls and self.walls[-1] > at:
            return  # an inline or stray end tag doesn't close the element around it
        if any(t in _BLOCKS for t, *_ in self.stack[at:]):
            self._break()
        while len(self.stack) > at:
            closed, *_, aside = self.stack.pop()
            self.open[closed].pop()
            self.within[aside].pop()
            if closed in _WALLS:
                self.walls.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _SPACES:
            self.parts.append((self._aside, " ", 0))
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self._skipped:
            self.parts.append((self._aside, data, len(data.strip()) if self.open["a"] else 0))

    def settle(self) -> None:
        """Takes out the lines of the elements set aside, but for those that hold the main text; their tags count for the
        next line that stays."""
        if any(self.aside):
            back = self._restored()
            kept, tags = [], 0
            stays = [True]
            for k, (outer, _) in enumerate(self.asides[1:], 1):
                stays.append(stays[outer] and k in back)
            for (text, n, linked, region), x in zip(self.lines, self.aside):
                tags += n
                if stays[x]:
                    kept.append((text, tags, linked, region))
                    tags = 0
            self.lines = kept

    def _restored(self) -> set[int]:
        """The elements set aside whose lines stay."""
        own = [False]  # per region, whether it is or stands in an article or main element
        for tag, outer in self.regions[1:]:
            own.append(tag in ("article", "main") or own[outer])
        total = [0] * len(self.asides)
        ringed = [0] * len(self.asides)
        for (text, *_, region), x in zip(self.lines, self.aside):
            total[x] += len(text)
            ringed[x] += own[region] * len(text)
        live, live_ringed = total[0], ringed[0]
        for k in range(len(total) - 1, 0, -1):  # inner before outer
            total[self.asides[k][0]] += total[k]
            ringed[self.asides[k][0]] += ringed[k]
        if live_ringed:
            return set()
        tops = range(1, len(total))
        best = max(tops, key=lambda k: (ringed[k], -k))  # the outermost of equals
        if not ringed[best]:
            best = max(tops, key=lambda k: (total[k], -k))
            if live and not (self.asides[best][1] and 2 * total[best] > total[0]):
                return set()
        chain, at = set(), best
        while at:
            chain.add(at)
            at = self.asides[at][0]
        # down to the text, through wrappers set aside inside of it
        wanted = {x for (*_, region), x in zip(self.lines, self.aside) if own[region] or not ringed[best]}
        inner = defaultdict(list)
        for k in tops:
            inner[self.asides[k][0]].append((-ringed[k], -total[k], k))
        near = [x for k in chain for x in inner[k] if x[-1] not in chain]
        heapify(near)
        met = bool(wanted & chain)
        while not met and near:
            at = heappop(near)[-1]
            chain.add(at)
            met = at in wanted
            for x in inner[at]:
                heappush(near, x)
        return chain


def lines_of(html: str) -> _Lines:
    p = _Lines()
    p.feed(html)
    p.close()
    p._break()
    p.settle()
    return p


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbours; at the ends over those that are there."""
    if len(ratios) < 2:
        return ratios
    reach = int(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, w)[reach : reach + n] / np.convolve(np.ones(n), w)[reach : reach + n]


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters of the values' logarithms."""
    x = np.log1p(values)
    low, high = x.min(), x.max()
    for _ in range(20):
        cut = (low + high) / 2
        up = x > cut
        if not up.any() or up.all():
            break
        low, high = x[~up].mean(), x[up].mean()
    return float(np.expm1((low + high) / 2)) if high > low else float(values.min())


def extract(html: str | None) -> str:
    """The main text of one whole page."""
    if not html:
        return ""
    page = lines_of(html)
    if not page.lines:
        return ""
    ratio = np.array([max(len(t) - linked, 0) / max(tags, 1) for t, tags, linked, _ in page.lines])
    value = smoothed(ratio)
    cut = threshold(value)
    passes = (value >= cut) & (ratio >= cut / 2) & (ratio > 0)  # not by its neighbours alone
    parent = [p for _, p in page.regions]
    ring: list[int | None] = [None]  # per region, the outermost article or main element around it
    home = [0]  # and the innermost region around it that isn't a list
    for k, (tag, outer) in enumerate(page.regions[1:], 1):
        ring.append(k if ring[outer] is None and tag in ("article", "main") else ring[outer])
        home.append(home[outer] if tag in _LISTS else k)
    where = [ring[r] for *_, r in page.lines]
    chosen = {w for w, ok in zip(where, passes) if ok and w is not None} or {w for w in where if w is not None}
    if chosen:
        kept = [w in chosen for w in where]
    else:
        content = {home[r] for (*_, r), ok in zip(page.lines, passes) if ok}
        kept = [home[r] in content for *_, r in page.lines]
    # regions of nothing but links that the smoothed ratios leave below the threshold are menus, wherever they stand
    n, links, least = ([0] * len(parent) for _ in range(3))
    for (text, _, linked, r), ok in zip(page.lines, value >= cut):
        n[r] += 1
        links[r] += linked > 0 and 10 * linked >= 9 * len(text.replace(" ", ""))
        least[r] += not ok
    for k in range(len(parent) - 1, 0, -1):
        for x in (n, links, least):
            x[parent[k]] += x[k]
    menu = [False]
    for k in range(1, len(parent)):
        menu.append(menu[parent[k]] or n[k] >= MENU and n[k] == links[k] and 2 * least[k] > n[k] and page.regions[k][0] not in ("article", "main"))
    return "\n\n".join(t for (t, *_, r), k in zip(page.lines, kept) if k and not menu[r])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batch: pa.RecordBatch) -> dict:
        out = [extract(x) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": out, "n_chars": [len(x) for x in out]}

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(chosen, run, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

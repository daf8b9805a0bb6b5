"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

One pass of the standard library's streaming parser gives lines (a block element's text each) with their
count of tags and their container. The text-to-tag ratios are smoothed over neighbouring lines and split into two
clusters by a threshold; lines that elements or names tell to be boilerplate (menus, page headers and footers,
sidebars, notices, adverts, forms, reader comments) count as without text. The content region is the innermost
container that holds the most of the high cluster's text: containers are followed from the page inwards as long as
one child has nearly all of it, and the region is widened to the article it is part of, to blocks beside it whose text
is mostly in the high cluster, and to the page's heading. Every line of the region that isn't boilerplate is kept, short
ones too, so that no part of an article is dropped for its looks; what stands outside goes, however it is named.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, texts

# Elements of HTML by what they do to the text.
SILENT = frozenset("script style template iframe object svg canvas audio video head title select textarea datalist".split())
BOILERPLATE = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that a new one of the given kind closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Words of class, id, role and label that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget footer header masthead toolbar complementary contentinfo search "
    "comment comments disqus respond replies reply reader discussion related recommended recommendations share sharing social follow subscribe subscription newsletter signup login toc hidden".split()
)
#: Words that add nothing to a name: one that has others than these and MARKS tells of something else, like share-price.
PLAIN = frozenset("a area bar block body bottom box button buttons container content cta form global group html icons id inner item items left link links list main outer panel primary row right secondary section site slot text top unit user wrap wrapper x".split())
#: Marks that articles use for parts of their own; within one they tell boilerplate only of text that is mostly links.
OWN = frozenset("notice notices notification alert banner overlay header toc search widget complementary promotion reader respond reply replies discussion related recommended recommendations follow".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
#: Gaussian smoothing of the ratios: standard deviation in lines.
SIGMA = 1.0
#: Clusters of ratios whose means are within this factor are one.
CLOSE = 2.0
#: A container is entered if it has this share of its parent's text in the high cluster.
SHARE = 0.9
#: An element in an article is content, whatever its name, if it has this share of the article's text in the high cluster; named for readers' comments, this one.
MOST, MOST_COMMENTS = 0.75, 0.95
COMMENTS = frozenset("comment comments disqus respond replies reply reader".split())
#: A block beside the region is part of it if this share of its text is in the high cluster.
BESIDE = 0.5


@dataclass(slots=True)
class Open:
    """An open element."""

    tag: str
    container: int
    silent: bool
    excluded: bool
    named: int  # the innermost element about it whose name tells boilerplate; -1: none
    within: bool  # an article or main element
    nested: bool  # an article, main or section element
    linked: bool
    scope: int  # the innermost article or main element; -1: none
    pressed: bool  # in a button


class Lines(HTMLParser):
    """Parser events to lines: text, tags, whether excluded, container. Containers are numbered in page order.

    Work is linear in the page: open elements are counted by name since the last block, names that tell boilerplate
    and containers are linked to what encloses them.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int]] = []
        self.kinds, self.parents, self.last = [""], [0], [0]
        self._stack = [Open("", 0, False, False, -1, False, False, False, -1, False)]
        self._open: list[Counter] = [Counter()]  # inline elements by name, for each open block
        self._blocks: Counter = Counter()  # open blocks by name
        self._named: list[dict] = []  # elements whose names tell boilerplate
        self._lines: list[int] = []  # innermost named element of each line
        self._articles: list[int] = []  # innermost named element about each article or main element without such a name
        self._scopes: list[int] = []  # of each article or main element, the one about it
        self._line_scopes: list[int] = []
        self._text: list[str] = []
        self.links: list[int] = []  # characters in links of each line
        self._tags = self._pressed = self._linked = 0

    def _break(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        if text:
            at = self._stack[-1]
            # a line of buttons alone is a control; one within a sentence is a word of it
            controls = self._pressed and self._pressed == len(_SPACE.sub("", text))
            self.lines.append((text, self._tags, at.excluded or bool(controls), at.container))
            self._lines.append(at.named)
            self._line_scopes.append(at.scope)
            self.links.append(self._linked)
            self._tags = 0
        self._pressed = self._linked = 0
        self._text.clear()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._break()
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES:
            self._close_implied(CLOSES[tag])
        at = self._stack[-1]
        excluded, named, container = at.excluded, at.named, at.container
        hidden, found = self._hidden(attrs), self._marks(attrs, at.within)
        if tag in ("article", "main") and not found and not hidden:
            self._articles.append(named)
            # content starts here, though a menu or header before it was left open
            excluded = excluded and any(x.excluded and x.tag not in BOILERPLATE for x in self._stack)
        elif hidden and tag not in ("html", "body"):
            excluded = True
        elif tag in BOILERPLATE and not (tag == "header" and at.nested):
            excluded = True
        if found and (tag not in BOILERPLATE or (tag == "header" and at.nested)) and tag not in ("html", "body"):
            self._named.append({"own": at.within and found <= OWN, "most": MOST_COMMENTS if found & COMMENTS else MOST, "text": 0, "links": 0, "high": 0, "about": named, "scope": at.scope})
            named = len(self._named) - 1
        if tag in BLOCKS:
            self._blocks[tag] += 1
            self._open.append(Counter())
            if tag != "p":
                self.kinds.append(tag)
                self.parents.append(container)
                self.last.append(0)
                container = len(self.kinds) - 1
        else:
            self._open[-1][tag] += 1
        within, scope = at.within or tag in ("article", "main"), at.scope
        if tag in ("article", "main"):
            self._scopes.append(scope)
            scope = len(self._scopes) - 1
        self._stack.append(Open(tag, container, at.silent or tag in SILENT, excluded, named, within, within or at.nested or tag == "section", at.linked or tag == "a", scope, at.pressed or tag == "button"))

    @staticmethod
    def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _NO_DISPLAY.search(value)) for name, value in attrs)

    @staticmethod
    def _marks(attrs: list[tuple[str, str | None]], within: bool) -> set[str]:
        """Marks in names that consist of marks and plain words only. The header of an article (``within``) is part of it."""
        marks: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id", "role", "aria-label") and value:
                for token in value.split():
                    words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                    found = MARKS & words
                    if found and found | PLAIN >= words and not (within and found == {"header"}):
                        marks |= found
        return marks

    def _pop(self) -> None:
        x = self._stack.pop()
        if x.tag in BLOCKS:
            self._blocks[x.tag] -= 1
            self._open.pop()
            if x.tag != "p":
                self.last[x.container] = len(self.kinds) - 1
        else:
            self._open[-1][x.tag] -= 1

    def _close_implied(self, kinds: set[str]) -> None:
        """End the open block if it is of these kinds, and those of them that enclose it directly; inline elements in them end too."""
        depth = len(self._stack) - 1 - self._open[-1].total()
        if depth and self._stack[depth].tag in kinds:
            while len(self._stack) > depth:
                self._pop()
            self._close_implied(kinds)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._break()
        # an inline element doesn't end a block
        if (self._blocks if tag in BLOCKS else self._open[-1])[tag] > 0:
            while self._stack[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        at = self._stack[-1]
        if not at.silent:
            self._text.append(data)
            if at.pressed:
                self._pressed += len(_SPACE.sub("", data))
            if at.linked:
                self._linked += len(data)
            if at.linked and at.named >= 0:
                self._named[at.named]["links"] += len(data)

    def _judge(self) -> None:
        """Exclude lines of named elements, but for those that rather hold content.

        These are the elements about all article and main elements of the page, parts of an article whose name an
        article may use (OWN) unless mostly links, and parts that hold most of an article's text in the high cluster.
        """
        scopes = [0] * len(self._scopes)
        for (text, _, excluded, _), k, scope, on in zip(self.lines, self._lines, self._line_scopes, clusters(self.lines).tolist(), strict=True):
            if excluded:
                continue
            if scope >= 0 and on:
                scopes[scope] += len(text)
            if k >= 0:
                self._named[k]["text"] += len(text)
                self._named[k]["high"] += len(text) * on
        for k in range(len(scopes) - 1, -1, -1):
            if self._scopes[k] >= 0:
                scopes[self._scopes[k]] += scopes[k]
        for x in reversed(self._named):  # inner ones come later
            if x["about"] >= 0:
                for what in ("text", "links", "high"):
                    self._named[x["about"]][what] += x[what]
        about: Counter = Counter()
        for k in self._articles:
            if k >= 0:
                about[k] += 1
        for k in range(len(self._named) - 1, -1, -1):
            if self._named[k]["about"] >= 0:
                about[self._named[k]["about"]] += about[k]
        told: list[bool] = []
        for k, x in enumerate(self._named):
            most = x["scope"] >= 0 and x["high"] >= x["most"] * scopes[x["scope"]] > 0 and 2 * x["links"] < x["text"]
            holds = (self._articles and about[k] == len(self._articles)) or (x["own"] and 2 * x["links"] < x["text"]) or most
            told.append(not holds or (x["about"] >= 0 and told[x["about"]]))
        self.lines = [(text, tags, excluded or (k >= 0 and told[k]), c) for (text, tags, excluded, c), k in zip(self.lines, self._lines, strict=True)]

    def finish(self) -> None:
        self.close()
        self._break()
        while len(self._stack) > 1:
            self._pop()
        self.last[0] = len(self.kinds) - 1
        self._judge()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian-weighted means of neighbouring ratios; weights at the ends are normed to what is there."""
    if not len(ratios):
        return ratios
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(ratios, weights)[reach : reach + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), weights)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Two clusters of a line: the midpoint of their means, moved until it stays (at most 50 times). Clusters whose means
    are within a factor of CLOSE are one, and its least value is the threshold."""
    t = float(values.mean())
    for _ in range(50):
        low, high = values[values < t], values[values >= t]
        if not len(low) or not len(high) or high.mean() < CLOSE * low.mean():
            return float(values.min())
        new = (low.mean() + high.mean()) / 2
        if abs(new - t) < 1e-9:
            return t
        t = float(new)
    return t


def _path(parents: list[int], c: int) -> list[int]:
    """Containers from the page down to ``c``."""
    out = [c]
    while out[-1]:
        out.append(parents[out[-1]])
    return out[::-1]


def clusters(lines: list[tuple[str, int, bool, int]]) -> np.ndarray:
    """Which lines are in the high cluster of smoothed text-to-tag ratios; excluded ones count as without text and never are."""
    if not lines:
        return np.zeros(0, bool)
    level = smooth(np.array([0.0 if excluded else len(text) / max(1, tags) for text, tags, excluded, _ in lines]))
    return (level >= threshold(level)) & ~np.array([x[2] for x in lines])


def region_of(parser: Lines, lines: list[tuple[str, int, bool, int]], high: np.ndarray, links: list[int]) -> np.ndarray:
    """Which of ``lines`` (those that aren't boilerplate) are content, told by the high cluster among them.

    The core is the innermost container with nearly all of the cluster's text. A page that marks an article up keeps
    all of it; elsewhere, and beside an article within a main element, blocks beside the core on the way out are
    content if most of their text is in the cluster, and so are lines between what is. Blocks of links before all text of
    the cluster or after it are none.
    """
    kinds, parents, last = parser.kinds, parser.parents, parser.last
    held, whole, linked = (np.zeros(len(kinds), np.int64) for _ in range(3))
    for (text, _, _, c), on, n in zip(lines, high.tolist(), links, strict=True):
        whole[c] += len(text)
        linked[c] += n
        held[c] += len(text) * on
    for c in range(len(kinds) - 1, 0, -1):  # children come after their parents
        held[parents[c]] += held[c]
        whole[parents[c]] += whole[c]
        linked[parents[c]] += linked[c]
    best = np.zeros(len(kinds), np.int64)  # of each container, the child that holds most
    for c in range(len(kinds) - 1, 0, -1):
        if kinds[c] not in HEADINGS and (not best[parents[c]] or held[c] >= held[best[parents[c]]]):
            best[parents[c]] = c
    core = 0
    while best[core] and held[best[core]] >= SHARE * held[core] > 0:
        core = int(best[core])
    above = _path(parents, core)
    # a page that marks its content up tells the whole region of which the cluster is a part
    core = next((c for kind in ("article", "main") for c in above if kinds[c] == kind), core)
    edge = next((c for kind in ("main", "article") for c in above if kinds[c] == kind), 0)
    at = np.array([c for _, _, _, c in lines], np.int64)
    kept = (at >= core) & (at <= last[core])
    # smoothing lifts a link beside long text, so the first and the last line of the text are told without links
    some = np.flatnonzero(kept & high & np.array([2 * n < len(text) for (text, *_), n in zip(lines, links, strict=True)], bool))
    if kinds[core] not in ("article", "main") and len(some):
        c = core + 1
        while c <= last[core]:
            if held[c] >= BESIDE * whole[c] or 2 * linked[c] <= whole[c]:
                c += 1
                continue
            # a block of links, the outermost
            own = (at >= c) & (at <= last[c])
            if not own[some[0] : some[-1] + 1].any():
                kept &= ~own
            c = last[c] + 1
    way = {core}  # from the core out to the edge
    while core != edge and edge not in way:
        way.add(parents[min(way)])
    for c in range(edge + 1, last[edge] + 1):  # blocks beside the way, each in one piece
        if c not in way and parents[c] in way and parents[c] != core and kinds[c] not in HEADINGS and held[c] >= max(1, BESIDE * whole[c]):
            kept |= (at >= c) & (at <= last[c])
    # lines of the containers on the way: of the cluster, or between what is kept
    loose = np.isin(at, [c for c in way if c != core]) | np.array([kinds[c] in HEADINGS and parents[c] in way for c in at.tolist()], bool)
    kept |= loose & high & (at >= edge) & (at <= last[edge])
    some = np.flatnonzero(kept)
    if len(some):
        kept[some[0] : some[-1] + 1] |= loose[some[0] : some[-1] + 1]
    # the heading may stand before the region: it is taken, with the lead between them
    headed = [(kinds[c], k) for k, (_, _, _, c) in enumerate(lines) if kinds[c] in HEADINGS]
    if headed and kinds[core] not in ("article", "main") and len(some):
        top = min(k for k, _ in headed)
        if not any(k == top and kept[j] for k, j in headed):
            j = next(j for k, j in headed if k == top)
            kept[min(j, some[0]) : max(j, some[-1]) + 1] = True
    return kept


def extract(html: str) -> str:
    """The main text of a page; '' if it has none."""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    keep = [not x[2] for x in parser.lines]
    lines = [x for x, k in zip(parser.lines, keep, strict=True) if k]
    if not lines:
        return ""
    content = region_of(parser, lines, clusters(parser.lines)[keep], [n for n, k in zip(parser.links, keep, strict=True) if k])
    return " ".join(text for (text, *_), k in zip(lines, content.tolist(), strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(x) for x in texts(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null or empty html, and pages with boilerplate only, give an empty text; repeated rows are kept, with equal texts.
    Pages of any length are read whole, in time linear in it. Of lines with equal ratios all are in one cluster; of
    containers that hold as much text the first is taken. An empty table gives an empty result. No shuffle: one pass over the scan.
    """
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

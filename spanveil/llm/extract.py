"""Main text of web pages, by the distribution of text over line blocks.

Markup is stripped to lines: one per block or line break, an empty one at each
edge of a container, and the text of menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments blanked out. A line weighs as many
characters as it has outside of links, or nothing if links prevail. Weights are
summed over windows of ``WINDOW`` lines; a region of text begins where the sum
surges above a threshold and ends where it dives to nothing. The heaviest region
is the article. Lines that blanked markup cut off from it belong to it if they
stand in the same container. Where a page marks its article with an element
(``article``, ``main``, the role or property of that name), the lines in it are
lifted above the threshold and all others blanked, so that surge and dive are
its edges.

Null and empty pages, and pages without a line of text, have an empty text.
Markup may be cut off or unbalanced: elements end with their parents, what a
script, style, title or comment that never ends holds is no text, and a menu or
other boilerplate that never ends does not swallow a marked article. Everything
is kept as it stands, however long; repeated pages are rows of their own.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.tables import slices

WINDOW = 3
# Characters in a window that make a surge; half the densest window if that is less.
SURGE = 86

# Element names of the markup language, by what they do to text.
RAW = "script|style|title|textarea|iframe|xmp|noembed|noframes"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img picture source".split()
)
CONTAINERS = frozenset("html body div section article main center td th details".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul body".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements whose text is never the article's.
DROPPED = frozenset(
    "head nav header footer aside form menu dialog noscript template button select option datalist fieldset svg math "
    "object canvas audio video map applet".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
# Words of class names and ids that say the same.
NOTED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot adunit sponsor sponsors "
    "sponsored promo promos promotion promoted nav navbar navigation navi menu menus menubar submenu breadcrumb "
    "breadcrumbs pagination pager header masthead topbar banner footer colophon copyright sidebar sidebars "
    "widget widgets cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal "
    "overlay newsletter subscribe subscription signup signin login comment comments commentlist discussion disqus "
    "respond responses reply replies share sharing social related recommended recommendations teaser teasers toolbar "
    "search searchbox skip".split()
)
# Words beside which "header" or "banner" means the article's own, and words that turn a name into its absence or mere presence.
OWN = frozenset("article post entry story content title".split())
TURNING = frozenset("has no without with is not".split())

_QUOTED = r"""(?:[^<>"']++|"[^"]{0,4000}+"|'[^']{0,4000}+'|["'])*+"""
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z<>][^>]*+(?:>|\Z)|</>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])(?P<opened>{_QUOTED})(?:\Z|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z))"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attributes>{_QUOTED})(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _noted(names: str) -> bool:
    """Whether a class list or id names something that is not the article."""
    for name in names.split():
        words = {w.lower() for w in WORDS.findall(name)}
        found = words & NOTED
        if words & OWN:
            found -= {"header", "banner"}
        if found and not words & TURNING:
            return True
    return False


class Element:
    """An open or past element: what it is, and whether its text counts."""

    __slots__ = ("name", "parent", "dropped", "marked", "holds", "closed", "weight")

    def __init__(self, name: str, parent: int) -> None:
        self.name, self.parent = name, parent
        self.dropped = self.marked = self.holds = self.closed = False
        self.weight = 0


class Page:
    """The lines of a page, with the elements that they stand in."""

    def __init__(self, source: str) -> None:
        self.elements = [Element("", -1)]
        # Of each line: its text, its characters in links, its element, its container.
        self.lines: list[tuple[str, int, int, int]] = []
        self.stack, self.boxes, self.inline = [0], [0], [Counter()]
        self.open: Counter = Counter()
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0
        place = 0
        for token in TOKEN.finditer(source):
            if token.start() > place:
                self._text(source[place : token.start()])
            place = token.end()
            name = token["name"]
            if name is None:
                continue
            name = name.lower()
            if token["end"]:
                self._end(name)
            else:
                self._start(name, token["attributes"])
        if place < len(source):
            self._text(source[place:])
        self._flush()

    def _text(self, piece: str) -> None:
        if "&" in piece:
            piece = html.unescape(piece)
        self.pieces.append(piece)
        if self.links:
            self.linked += len(piece)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.lines.append((text, min(self.linked, len(text)), self.stack[-1], self.boxes[-1]))
            self.pieces, self.linked = [], 0

    def _edge(self) -> None:
        """An empty line, at the edge of a container."""
        self.lines.append(("", 0, self.stack[-1], self.boxes[-1]))

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "hr":
            self._flush()
        if name in VOID:
            return
        if name == "body" and self.open["head"]:
            self._pop("head")
        if name in CLOSES_P and self.open["p"]:
            self._pop("p")
        inline = name in INLINE
        if not inline:
            self._flush()
        element = Element(name, self.stack[-1])
        if name in DROPPED:
            element.dropped = True
        element.marked = name in ("article", "main")
        if attributes and not attributes.isspace():
            self._judge(element, attributes)
        self.elements.append(element)
        at = len(self.elements) - 1
        self.open[name] += 1
        if inline:
            self.inline[-1][name] += 1
            self.links += name == "a"
        else:
            self.inline.append(Counter())
            if name in CONTAINERS:
                self._edge()
                self.boxes.append(at)
        self.stack.append(at)

    def _judge(self, element: Element, attributes: str) -> None:
        name = element.name
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), values[0] or values[1] or values[2]
            if key in ("class", "id"):
                if name not in HEADINGS and name not in ("html", "body", "main") and _noted(value):
                    element.dropped, element.marked = True, False
            elif key == "role":
                element.dropped |= value.lower() in ROLES
                element.marked |= value.lower() in ("main", "article") and not element.dropped
            elif key == "itemprop":
                element.marked |= value.lower() == "articlebody"
            elif key == "hidden" or "display:none" in value.replace(" ", "").lower():
                element.dropped = name not in ("html", "body")

    def _end(self, name: str) -> None:
        if not self.open[name] or (name in INLINE and not self.inline[-1][name]):
            return
        self._pop(name)

    def _pop(self, name: str) -> None:
        """Ends the innermost open element of this name, and all in it."""
        while True:
            element = self.elements[self.stack[-1]]
            if element.name in INLINE:
                self.inline[-1][element.name] -= 1
                self.links -= element.name == "a"
            else:
                self._flush()
                self.inline.pop()
            at = self.stack.pop()
            if self.boxes[-1] == at:
                self.boxes.pop()
                self._edge()
            self.open[element.name] -= 1
            if element.name == name:
                element.closed = True
                return

    def text(self) -> str:
        return self._chosen(True) or self._chosen(False)

    def _chosen(self, trusting: bool) -> str:
        """The article's lines, joined. Not ``trusting``: boilerplate that never ends is none."""
        elements = self.elements
        for element in reversed(elements[1:]):
            if element.holds or (element.marked and not element.dropped):
                elements[element.parent].holds = True
        gone = [False] * len(elements)
        marked = [-1] * len(elements)
        own_head = [False] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            # The outermost article that it lies in, or else the outermost main element.
            marked[i] = marked[e.parent]
            out = e.dropped
            if out and e.holds and (not e.closed or e.name not in DROPPED):
                out = False
            if out and not e.closed and not trusting:
                out = False
            if out and e.name == "header" and marked[e.parent] >= 0:
                out, own_head[i] = False, True
            own_head[i] |= own_head[e.parent]
            gone[i] = gone[e.parent] or out
            if e.marked and not gone[i] and (marked[i] < 0 or (e.name == "article" and elements[marked[i]].name != "article")):
                marked[i] = i
        weights = np.zeros(len(self.lines) + WINDOW, dtype=np.int64)
        shown = []
        for n, (text, linked, at, _) in enumerate(self.lines):
            # Of an article's own header only headings are text.
            kept = bool(text) and not gone[at] and (not own_head[at] or self._heading(at))
            shown.append(kept)
            if kept and 2 * linked <= len(text):
                weights[n] = len(text) - linked
        homes = {marked[line[2]] for line, kept in zip(self.lines, shown) if kept} - {-1}
        articles = {i for i in homes if elements[i].name != "main"}
        if len(articles or homes) == 1:
            # One article is marked: its lines alone, however short, make surge and dive.
            home = (articles or homes).pop()
            inside = np.array([kept and self._at_home(line[2], marked, home) for line, kept in zip(self.lines, shown)])
            weights[: len(inside)] = np.where(inside, weights[: len(inside)] + SURGE, 0)
            regions = _regions(weights)
            chosen = [n for n in range(regions[0][0], regions[-1][1]) if inside[n]]
            return " ".join(self.lines[n][0] for n in chosen)
        regions = _regions(weights)
        if not regions:
            return " ".join(line[0] for line, kept in zip(self.lines, shown) if kept and marked[line[2]] >= 0)
        first, last = max(regions, key=lambda r: (int(weights[r[0] : r[1]].sum()), -r[0]))
        sums: Counter = Counter()
        for n in range(first, last):
            sums[marked[self.lines[n][2]]] += int(weights[n])
        home, most = max(sums.items(), key=lambda s: s[1])
        if home >= 0 and 2 * most >= int(weights[first:last].sum()):
            chosen = [n for n, kept in enumerate(shown) if kept and marked[self.lines[n][2]] == home]
        else:
            chosen = self._unmarked(weights, shown, regions, first, last)
        return " ".join(self.lines[n][0] for n in chosen)

    def _at_home(self, at: int, marked: list[int], home: int) -> bool:
        """In the article, or a top heading beside it in the main element around it."""
        if marked[at] == home:
            return True
        main = marked[at]
        return main >= 0 and self.elements[main].name == "main" and self._heading(at, "h1") and main in self._parents(home)

    def _parents(self, at: int) -> set[int]:
        out = set()
        while at > 0:
            at = self.elements[at].parent
            out.add(at)
        return out

    def _heading(self, at: int, *names: str) -> bool:
        while at > 0 and self.elements[at].name in INLINE:
            at = self.elements[at].parent
        return self.elements[at].name in (names or HEADINGS)

    def _unmarked(self, weights: np.ndarray, shown: list[bool], regions: list[tuple[int, int]], first: int, last: int) -> list[int]:
        """Lines of the heaviest region, and what stands in its container or likewise beside it."""
        elements, lines = self.elements, self.lines
        for n in range(first, last):
            elements[lines[n][3]].weight += int(weights[n])
        total = int(weights[first:last].sum())
        # Weights of containers with all inside; children stand behind their parents.
        for e in reversed(elements[1:]):
            elements[e.parent].weight += e.weight
        box = max(range(len(elements)), key=lambda i: (10 * elements[i].weight >= 9 * total, i))
        within = [False] * len(elements)
        within[box] = True
        for i, e in enumerate(elements[1:], 1):
            within[i] |= within[e.parent] and i > box
        mean = total / max(1, int((weights[first:last] > 0).sum()))

        # Short lines of other containers at either edge of the region are no part of it.
        def foreign(n: int) -> bool:
            return not within[lines[n][2]] and weights[n] < SURGE / 2 and not self._heading(lines[n][2])

        while first < last and foreign(first):
            first += 1
        while first < last and foreign(last - 1):
            last -= 1
        chosen = {n for n in range(first, last) if shown[n]}
        chosen |= {n for n, kept in enumerate(shown) if kept and lines[n][3] == box}
        for begin, end in regions:
            some = weights[begin:end][weights[begin:end] > 0]
            inside = all(within[lines[n][2]] for n in range(begin, end) if shown[n])
            if inside and 3 * some.mean() >= mean:
                chosen |= {n for n in range(begin, end) if shown[n]}
        return sorted(chosen)


def _regions(weights: np.ndarray) -> list[tuple[int, int]]:
    """Spans of lines from each surge to the dive after it; the last ``WINDOW`` weights are zeros."""
    sums = np.convolve(weights, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]
    top = int(sums.max(initial=0))
    if not top:
        return []
    least = min(SURGE, top / 2)
    surges, dives = np.flatnonzero((sums > least) & (weights > 0)), np.flatnonzero(sums == 0)
    found, place = [], 0
    while True:
        n = np.searchsorted(surges, place)
        if n == len(surges):
            return found
        begin = int(surges[n])
        place = int(dives[np.searchsorted(dives, begin)])
        found.append((begin, place))


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of every page, with the main ``text`` and ``n_chars``, its code points. One pass, no exchange."""
    fields = [pages.schema[c] for c in keep]
    names = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, len(names)):
            texts = [main_text(source) for source in piece.column(len(names)).to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], *columns], names=[*names, "text", "n_chars"])

    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)), "text string", "n_chars long"])
    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(run, schema).toDF(*keep, "text", "n_chars")

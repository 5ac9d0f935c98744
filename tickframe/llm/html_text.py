"""Main text of web pages from parser events, by text-to-tag ratio.

The standard library's streaming parser gives events; each block of text becomes a line,
with the number of tags met since the line before.  A line's ratio is its characters (``FULL`` at most, for this only) over its tags;
ratios are smoothed along the page with a Gaussian and split into two clusters by a threshold
(two means).  Lines above it, smoothed and by themselves, are content; the others are not, yet they aren't dropped for
that: an article has short paragraphs too.

Content lines choose the region: the outermost article that holds at least half of their text, else such a main element, else
the innermost element that holds all of them, widened to what encloses it while that adds running text, not lists of
links.  Within the region every line counts, but for rows of links where no article or main element bounds it.

Elements and names are hints, which content lines overrule.  An element is hinted as boilerplate by what it is (navigation, headers
outside an article, footers, asides, forms and the like) or by words in its class, id or role (adverts, menus, sidebars, notices, shares,
comments).  Hinted elements go, unless no article or main element and hardly any content line is left then: the one that holds most content is
no boilerplate, such as a form around the page or a layout named after its sidebar.  Scripts, styles and other
elements that aren't text never count.

Defined results: null and empty pages have no text; a page without tags is all text; unclosed and
stray tags end where their enclosing element does; pages of any length are read whole; rows are extracted one by one, so that
repeated rows give equal texts and an empty table an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .runtime import map_columns, text_or_empty

#: Elements, by the HTML standard: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Never text.
SILENT = frozenset("head title script style noscript template svg math iframe object canvas audio video".split())
#: Boilerplate by what they are.
HINTED = frozenset("nav footer aside form button select textarea dialog menu".split())
#: Words in class, id or role that name boilerplate; the second set only outside an article.
NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|widgets?|footers?|comments?|disqus|repl(?:y|ies)|respond|cookies?|"
    r"consent|gdpr|notices?|alerts?|popups?|modals?|overlays?|newsletters?|subscri(?:be|ption)|shares?|sharing|social|related|recommend(?:ed|ations?)|toolbars?|pagination|pager|contentinfo|complementary|search|dialog)(?:$|[_-])",
    re.I,
)
HEAD_NAMES = re.compile(r"(?:^|[_-])(?:headers?|masthead|banners?)(?:$|[_-])", re.I)
#: A layout's class such as "page with-sidebar" says what stands beside.
BESIDE = ("with-", "has-", "no-", "is-")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that an opening one closes, where authors leave the end out.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("article section div main body table ul ol dl td th blockquote aside nav footer header form".split())
#: What may be the content region.
REGIONS = frozenset("article section main div body td html".split())
SIGMA = 1.0
#: Shares: of content text that hints must leave; that makes an article or main element the region; of links in a row of links.
LEFT, MOST, LINKS = 0.05, 0.5, 0.8
#: Characters from which a line counts as running text in full, so that one huge line isn't a cluster of its own.
FULL = 500
BY_NAME, BY_ELEMENT = 1, 2


class Line:
    """A block's text in pieces, each with the innermost hinted element around it (0: none), and where the block stands."""

    __slots__ = ("pieces", "chars", "tags", "linked", "region", "content")

    def __init__(self, pieces: list[tuple[str, int]], chars: int, tags: int, linked: int, region: int):
        self.pieces, self.chars, self.tags, self.linked, self.region, self.content = pieces, chars, tags, linked, region, False


class Lines(HTMLParser):
    """Collects the lines of a page.  Regions and hinted elements are numbered as they open and know the one around
    them (0: none), so that any depth of nesting costs what the page is long."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, never text, hinted, region
        self.tags = self.silent = self.links = self.linked = self.articles = 0
        self.regions, self.region_around, self.region = [""], [0], 0
        self.hints, self.hint_around, self.hinted = [0], [0], 0
        self.pieces: list[tuple[str, int]] = []

    def flush(self) -> None:
        if not self.pieces:
            self.linked = 0
            return
        chars = len(" ".join("".join(data for data, _ in self.pieces).split()))
        if chars:
            self.lines.append(Line(self.pieces, chars, max(1, self.tags), min(chars, self.linked), self.region))
            self.tags = 0
        self.pieces, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in CLOSES.get(tag, ()):
                self.close_from(i)
            elif name in SCOPES:
                break
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        hint, is_region, silent = self.hint(tag, attrs), tag in REGIONS, tag in SILENT
        if is_region:
            self.regions.append(tag)
            self.region_around.append(self.region)
            self.region = len(self.regions) - 1
        if hint:
            self.hints.append(hint)
            self.hint_around.append(self.hinted)
            self.hinted = len(self.hints) - 1
        self.silent += silent
        self.links += tag == "a"
        self.articles += tag == "article"
        self.open.append((tag, silent, bool(hint), is_region))

    def hint(self, tag: str, attrs) -> int:
        if tag in HINTED or (tag == "header" and not self.articles):
            return BY_ELEMENT
        if tag in ("html", "body", "main"):
            return 0
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return BY_ELEMENT
            if key in ("class", "id", "role") and value:
                for name in CAMEL.sub("-", value).split():
                    if not name.startswith(BESIDE) and (NAMES.search(name) or (not self.articles and HEAD_NAMES.search(name))):
                        return BY_NAME
        return 0

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def closed(self, element: tuple[str, bool, bool, bool]) -> None:
        tag, silent, hinted, is_region = element
        self.silent -= silent
        self.links -= tag == "a"
        self.articles -= tag == "article"
        if hinted:
            self.hinted = self.hint_around[self.hinted]
        if is_region:
            self.region = self.region_around[self.region]

    def close_from(self, i: int) -> None:
        self.flush()
        for element in reversed(self.open[i:]):
            self.closed(element)
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                if any(hinted or silent or name in BLOCK for name, silent, hinted, _ in self.open[i + 1 :]) or tag in BLOCK:
                    self.close_from(i)
                else:
                    self.closed(self.open.pop(i))
                return
            if name in SCOPES and tag not in SCOPES and tag not in ("html", "head"):
                return

    def handle_data(self, data):
        if not self.silent:
            self.pieces.append((data, self.hinted))
            if self.links:
                self.linked += len(data)


def smooth(values: np.ndarray) -> np.ndarray:
    reach = int(3 * SIGMA)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(values, reach, mode="edge")
    return np.convolve(padded, bell / bell.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between the means of two clusters; two means in one dimension."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low) or not len(high):
            return cut
        moved = float(low.mean() + high.mean()) / 2
        if abs(moved - cut) < 1e-9:
            break
        cut = moved
    return cut


def content_lines(lines: list[Line]) -> list[bool]:
    """Which lines are in the upper cluster, smoothed and by themselves."""
    ratios = np.array([min(line.chars, FULL) / line.tags for line in lines])
    smoothed = smooth(ratios)
    cut = threshold(smoothed) - 1e-9
    found = (smoothed >= cut) & (ratios >= cut)
    return (found if found.any() else smoothed >= cut).tolist()


def _sums(values: list[float], around: list[int]) -> list[float]:
    """Of each element with all that lies in it."""
    for i in range(len(values) - 1, 0, -1):
        values[around[i]] += values[i]
    return values


def _inside(chosen: set[int], around: list[int]) -> list[bool]:
    """Whether each element is one of those chosen or lies in one."""
    out = [False] * len(around)
    for i in range(1, len(around)):
        out[i] = i in chosen or out[around[i]]
    return out


def _gone(page: Lines) -> list[bool]:
    """Of hinted elements, those that go: all, where an article or main element outside of them has text; else all but
    those without which hardly any content line is left."""
    bounded = _inside({i for i, name in enumerate(page.regions) if name in ("article", "main")}, page.region_around)
    if not any(bounded) and len(page.hints) == 1:
        return [False]
    standing = set(range(1, len(page.hints)))
    mass = [0.0] * len(page.hints)
    for line in page.lines:
        if line.content:
            for data, hint in line.pieces:
                mass[hint] += len(data)
    own = list(mass)
    mass, total = _sums(mass, page.hint_around), sum(mass)
    while standing:
        gone = _inside(standing, page.hint_around)
        if any(bounded[line.region] and not all(gone[hint] for data, hint in line.pieces if not data.isspace()) for line in page.lines):
            break
        if sum(n for n, out in zip(own, gone) if not out) >= LEFT * total > 0:
            break
        best = min(standing, key=lambda i: (-mass[i], page.hints[i], i))
        if not mass[best]:
            break
        # those around it and in it with the same content stand or fall with it
        within, outer = _inside({best}, page.hint_around), best
        while outer and mass[outer] == mass[best]:
            standing.discard(outer)
            outer = page.hint_around[outer]
        standing -= {i for i in standing if within[i] and mass[i] == mass[best]}
    return _inside(standing, page.hint_around)


def _bounds(page: Lines, strong: list[Line]) -> int:
    """The outermost article, else main element, that holds most of the content lines' text; 0 without one."""
    for name in ("article", "main"):
        outer = [0] * len(page.regions)
        for i in range(1, len(outer)):
            outer[i] = outer[page.region_around[i]] or (i if page.regions[i] == name else 0)
        mass = [0.0] * len(page.regions)
        for line in strong:
            mass[outer[line.region]] += line.chars
        total, mass[0] = sum(mass), -1
        best = max(range(len(mass)), key=mass.__getitem__)
        if best and mass[best] >= MOST * total:
            return best
    return 0


def _innermost(page: Lines, lines: list[Line], strong: list[Line]) -> int:
    """The innermost element that holds all content lines, widened while that adds running text; 0 is the page."""
    held, chars, linked = ([0.0] * len(page.regions) for _ in range(3))
    for line in strong:
        held[line.region] += 1
    for line in lines:
        chars[line.region] += line.chars
        linked[line.region] += line.linked
    for values in (held, chars, linked):
        _sums(values, page.region_around)
    region = max(i for i in range(len(held)) if held[i] == len(strong))
    outer = page.region_around[region]
    while outer and page.regions[outer] not in ("body", "html") and linked[outer] - linked[region] <= (1 - LINKS) * (chars[outer] - chars[region]):
        region, outer = outer, page.region_around[outer]
    return region


def _without_link_rows(lines: list[Line]) -> list[Line]:
    """Lines but for rows of three or more neighbours that are links and no content."""
    out, row = [], []
    for line in [*lines, None]:
        if line is not None and not line.content and line.linked >= LINKS * line.chars:
            row.append(line)
            continue
        if len(row) < 3:
            out += row
        row = []
        if line is not None:
            out.append(line)
    return out


def extract(html: str) -> str:
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    for line, is_content in zip(page.lines, content_lines(page.lines)):
        line.content = is_content
    gone = _gone(page)
    lines = [line for line in page.lines if not all(gone[hint] for data, hint in line.pieces if not data.isspace())]
    if not lines:
        return ""
    strong = [line for line in lines if line.content] or lines
    region = _bounds(page, strong)
    bounded = bool(region)
    region = region or _innermost(page, lines, strong)
    inside = _inside({region}, page.region_around) if region else [True] * len(page.regions)
    found = [line for line in lines if inside[line.region]]
    texts = (" ".join("".join(data for data, hint in line.pieces if not gone[hint]).split()) for line in (found if bounded else _without_link_rows(found)))
    return "\n".join(text for text in texts if text)


def extract_pages(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, kept columns, text)`` of every page."""
    names = [id_column, *keep]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names), "text string"])
    return map_columns(pages, [*(pages[c] for c in names), text_or_empty(pages, html_column).alias("html")], schema, lambda *columns: (*columns[:-1], [extract(h) for h in columns[-1]]))

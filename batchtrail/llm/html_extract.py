"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard-library parser streams its events; every block element ends a
line.  A line knows its text, the tags seen in it, the containers it stands in
and whether it lies inside boilerplate markup.  The ratio of text to tags per
line is smoothed with a Gaussian over the neighbouring lines; lines above the
spread of the smoothed ratios are content lines, and neighbouring ones of one
container form a cluster.  The articles are the content region if they hold most
of the cluster weight, else the main elements if they do, else the innermost
container around all clusters: its lines (not only those above the threshold,
since an article also has short paragraphs) are the main text, together with
the clusters outside it that are dense without their neighbours' help.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Element names of the HTML standard by role, and words that name page furniture in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table
tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("article body div main section td".split())
FURNITURE = frozenset("""aside audio button canvas datalist dialog footer form head iframe input label map menu nav noframes noscript object
option script search select style svg template textarea title video""".split())
SIDE_WORDS = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
disclaimer disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo
promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget alert complementary
contentinfo search signup teaser""".split())
ARTICLE_WORDS = frozenset("comment reply teaser related ad promo".split())
# words that make a phrase a state of the page and no name of a part: "has-sidebar", "comments-open"
STATE_BEFORE, STATE_AFTER = frozenset("no has with without is not hide show".split()), frozenset("open closed enabled disabled none free off on".split())
CLOSED_BY = {name: frozenset(by.split()) for name, by in {
    "p": "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
         "nav ol p pre section table ul",
    "head": "body main article div header nav section p h1 table ul ol form",
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody tfoot", "td": "td th tr", "th": "td th tr", "option": "option optgroup",
}.items()}

SIGMA = 1.0
RADIUS = 2
#: Furniture by its element (never content), and none.
HARD, NONE = -1, 0


def names_furniture(value: str, words: frozenset[str] = SIDE_WORDS) -> bool:
    """Whether one of the phrases of a class, id or role names page furniture; "no-sidebar" and "comments-open" are states."""
    for phrase in value.split():
        parts = [w.lower() for w in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", phrase) if w]
        if any(w in words for w in parts) and not (len(parts) > 1 and (parts[0] in STATE_BEFORE or parts[-1] in STATE_AFTER)):
            return True
    return False


class Line:
    """Text, the tags in it, its innermost container and its innermost furniture (``HARD``, ``NONE`` or a number)."""
    __slots__ = ("text", "tags", "at", "side")

    def __init__(self, text: str, tags: int, at: int, side: int):
        self.text, self.tags, self.at, self.side = text, tags, at, side


class LineParser(HTMLParser):
    """Collects lines; unclosed elements end where their parent ends.

    Only block elements end a line; text of furniture inside a line is left out of
    it.  Containers and furniture named by words are numbered in the order of
    their start and know their parent, so that a page costs time in proportion to
    its length however deep it is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds, self.parents = [""], [0]  # containers; 0 is the page
        self.side_parents, self.lifted, self.forms = [0], [False], [False]  # furniture named by words, and forms
        self._stack: list[tuple[str, int, int, bool]] = []  # name, container, furniture, in furniture inside a line
        self._open: Counter[str] = Counter()
        self._parts: list[str] = []
        self._place: tuple[int, int] | None = None  # container and furniture where the line began
        self._tags = 0

    # -- events

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            elif tag == "hr":
                self._end_line()
            self._tags += 1
            return
        while self._stack and tag in CLOSED_BY.get(self._stack[-1][0], ()):
            self._leave()
        if tag in BLOCKS:
            self._end_line()
        self._tags += 1
        at, side, dropped = self._stack[-1][1:] if self._stack else (0, NONE, False)
        if tag in CONTAINERS:
            self.kinds.append(tag)
            self.parents.append(at)
            at = len(self.kinds) - 1
        if side != HARD:
            own = self._furniture(tag, attrs)
            if own and tag not in BLOCKS:
                dropped = True
            elif own == HARD:
                side = HARD
            elif own:
                self.side_parents.append(side)
                self.lifted.append(False)
                self.forms.append(tag == "form")
                side = len(self.lifted) - 1
            elif tag in ("main", "article"):
                self._lift(tag, side)
        self._stack.append((tag, at, side, dropped))
        self._open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "<div/>" opens a div, as browsers read it

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "br":
            self._add(" ")
        if not self._open[tag]:
            if tag in BLOCKS:
                self._end_line()
            return
        while self._stack[-1][0] != tag:
            self._leave()
        self._leave()

    def handle_data(self, data: str) -> None:
        self._add(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A malformed or open "<![" section is a comment up to the next ">", as browsers read it."""
        try:
            after = super().parse_marked_section(i, report)
        except AssertionError:
            after = -1
        if after < 0:
            end = self.rawdata.find(">", i + 3)
            after = end + 1 if end >= 0 else len(self.rawdata)
        return after

    # -- lines

    def _add(self, data: str) -> None:
        if self._stack and self._stack[-1][3]:
            return
        if self._place is None:
            self._place = self._stack[-1][1:3] if self._stack else (0, NONE)
        self._parts.append(data)

    def _leave(self) -> None:
        name = self._stack[-1][0]
        if name in BLOCKS:
            self._end_line()
        self._open[name] -= 1
        self._stack.pop()

    def _furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """``HARD`` for furniture by its element, 1 for furniture by its words and forms, else ``NONE``."""
        if tag == "form":
            return 1
        if tag in FURNITURE or tag == "header" and not (self._open["article"] or self._open["main"]):
            return HARD
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return HARD
        if tag in ("html", "body", "main"):
            return NONE
        words = ARTICLE_WORDS if tag == "article" else SIDE_WORDS
        return int(any(names_furniture(v, words) for k, v in attrs if v and k in ("class", "id", "role")))

    def _lift(self, tag: str, side: int) -> None:
        """Furniture around the main element, and a form around an article, is a wrapper of the page."""
        while side > 0 and not self.lifted[side] and (tag == "main" or self.forms[side]):
            self.lifted[side] = True
            side = self.side_parents[side]

    def _end_line(self) -> None:
        text = " ".join("".join(self._parts).split())
        self._parts.clear()
        if text:
            self.lines.append(Line(text, self._tags, *self._place))
        self._place = None
        self._tags = 0

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines

    def depths(self) -> list[int]:
        """Number of furniture elements around each line that are no wrappers; -1 for furniture by element."""
        depth = [0]
        for number in range(1, len(self.lifted)):
            depth.append(depth[self.side_parents[number]] + (not self.lifted[number]))
        return [HARD if x.side == HARD else depth[x.side] for x in self.lines]


def parse_lines(html: str) -> LineParser:
    parser = LineParser()
    parser.feed(html)
    parser.finish()
    return parser


def smoothed(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing; at the ends the kernel is renormalised."""
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        part = kernel[lo - i + radius:hi - i + radius]
        out.append(sum(a * b for a, b in zip(values[lo:hi], part)) / sum(part))
    return out


def clusters(lines: list[Line], ratios: list[float], cut: float, is_side: list[bool] | None = None) -> list[list[int]]:
    """Runs of neighbouring lines of one innermost container whose smoothed ratio reaches ``cut``; side lines end a run."""
    out: list[list[int]] = []
    is_side = [x.side != NONE for x in lines] if is_side is None else is_side
    for i, line in enumerate(lines):
        if is_side[i] or ratios[i] < cut:
            continue
        if out and out[-1][-1] == i - 1 and lines[i - 1].at == line.at:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def main_text(html: str | None, sigma: float = SIGMA, radius: int = RADIUS) -> str:
    """The main text, blocks joined by a newline; empty for null or empty pages and for pages without text.

    Where everything stands inside furniture named by words or inside forms, that
    with the fewest of these around it is the page.
    """
    if not html:
        return ""
    page = parse_lines(html)
    lines, depths = page.lines, page.depths()
    level = min((d for d in depths if d != HARD), default=0)
    is_side = [d != level for d in depths]
    own = [0.0 if side else len(x.text) / max(1, x.tags) for x, side in zip(lines, is_side)]
    ratios = smoothed(own, sigma, radius)
    body = [i for i, side in enumerate(is_side) if not side]
    if not body:
        return ""
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    cut = min(spread, max(ratios[i] for i in body))
    found = clusters(lines, ratios, cut, is_side)
    sizes = [sum(len(lines[i].text) for i in c) for c in found]
    total, weight = sum(sizes), [0] * len(page.kinds)
    for cluster, size in zip(found, sizes):
        weight[lines[cluster[0]].at] += size
    for number in range(len(weight) - 1, 0, -1):  # a container comes after its parent
        weight[page.parents[number]] += weight[number]
    inside: list[bool] = []
    for kind in ("article", "main"):
        inside = [False]
        for number in range(1, len(weight)):
            inside.append(inside[page.parents[number]] or page.kinds[number] == kind and weight[number] > 0)
        if 2 * sum(size for c, size in zip(found, sizes) if inside[lines[c[0]].at]) > total:
            break
        inside = []
    if not inside:
        # without a named region: the innermost container that no cluster lies outside of
        around = max((n for n in range(1, len(weight)) if weight[n] == total), default=0) if found else 0
        if not around:
            return "\n".join(lines[i].text for i in body)
        inside = [False]
        for number in range(1, len(weight)):
            inside.append(number == around or inside[page.parents[number]])
    # a cluster that only the smoothing lifts over the threshold is a neighbour of content, no content of its own
    dense = {i for c in found if any(own[i] >= cut for i in c) for i in c}
    return "\n".join(lines[i].text for i in body if i in dense or inside[lines[i].at])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every row in ``out``; null or empty html gives the empty text.

    All columns are kept (one called like ``out`` is replaced); repeated rows and
    null ids keep their rows; an empty table gives none.
    """
    @pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None).astype(object)

    return pages.withColumn(out, text(F.coalesce(F.col(html_col), F.lit(""))))

"""Main text of web pages: parser events become lines, lines of a high text-to-tag ratio show where the content is.

One pass of the standard library's parser over a page gives its lines (the text of a block) with the characters, tags and
link characters of each, and the containers they lie in. The ratio of text to tags of the lines is smoothed by a Gaussian
and split in two by the threshold that separates its values best (2-means on a logarithmic scale). From the page down, the
walk then goes into the container that holds nearly all text of the content lines, and every line of the region where it
stops is kept, short paragraphs included. Lines in menus, headers, footers, sidebars, notices, adverts, forms and comments
carry no weight and are left out, by their elements, roles and class names, or as lists that are links alone.

Pages are rows of their own: no shuffle, and a page's size is all that a task holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.storage import bound_batches

BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
#: Blocks that hold other blocks, in which the walk can stop.
CONTAINERS = BLOCKS - set("address caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li option p pre summary tr".split())
CELLS = {"td", "th"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template title textarea select option button svg math iframe object canvas audio video head".split())
SIDE = {"nav", "footer", "aside", "dialog", "menu", "search"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status tooltip".split())
#: Parts of class names and ids that tell what isn't the article.
NAMES = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disclaimer disqus discussion footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar tracking widget".split())
#: Class names of whole pages and articles may hold these parts, as in no-sidebar or with-comments.
NEGATED = set("no without with has hide is open enable enabled disable".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Elements that end where another one like them begins.
ALIKE = {"li", "dt", "dd", "tr", "option"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Share of the content lines' text for which the walk enters a container.
NEARLY_ALL = 0.7
SIGMA = 1.0


@dataclass(slots=True)
class Line:
    """A block's text, its tags and link characters, the containers around it (outermost first) and whether it is inside something that isn't content."""

    parts: list[str] = field(default_factory=list)
    tags: int = 0
    link: int = 0
    path: tuple[int, ...] | None = None
    side: tuple[int, ...] = ()
    heading: bool = False
    text: str = ""


@dataclass(slots=True)
class Open:
    """An open element: the containers, and the things that aren't content, down to it."""

    tag: str
    path: tuple[int, ...] = (0,)
    side: tuple[int, ...] = ()
    heading: bool = False


class Lines(HTMLParser):
    """Streams a page's events into lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = [Open("#page")]
        self.lines: list[Line] = []
        self.kinds: list[str] = ["page"]
        self.line = Line()
        self.silent = self.links = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed, so nothing counts them."""
        return j

    def _break(self) -> None:
        line = self.line
        if line.parts:
            line.text = " ".join("".join(line.parts).split())
            if line.text:
                self.lines.append(line)
                self.line = Line()
            else:
                self.line = Line(tags=line.tags)

    def _is_side(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in SIDE or tag == "form" or tag == "header":
            return True
        if attrs.get("role", "") in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
            return True
        if tag in ("html", "body", "main") or not ("class" in attrs or "id" in attrs):
            return False
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            parts = {p.lower() for p in _PART.findall(name)}
            if not parts.isdisjoint(NAMES) and parts.isdisjoint(NEGATED) and (tag != "article" or not parts.isdisjoint(("comment", "comments", "reply", "related", "teaser", "promo"))):
                return True
        return False

    def _close(self, at: int) -> None:
        for o in self.stack[at:]:
            self.silent -= o.tag in SILENT
            self.links -= o.tag == "a"
            if o.tag in BLOCKS:
                self._break()
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        stack = self.stack
        if tag in BLOCKS:
            self._break()
            for i in range(len(stack) - 1, 0, -1):  # some elements end by themselves where a block begins, as far as the container around them
                kind = stack[i].tag
                if kind == "p" or kind == tag and tag in ALIKE or kind in HEADINGS or tag == "body" and kind == "head":
                    self._close(i)
                    break
                if kind in CONTAINERS and kind != "head":
                    break
            if tag in ("article", "main"):  # a menu or a title bar that was never closed ends here
                at = next((i for i, o in enumerate(stack) if o.tag in ("nav", "header", "head", "title")), None)
                if at is not None:
                    self._close(at)
        elif tag == "br" or tag in CELLS:
            self.line.parts.append(" ")
        self.line.tags += 1
        if tag in VOID:
            return
        around, path, side = stack[-1], stack[-1].path, stack[-1].side
        apart = self._is_side(tag, dict(attrs)) if attrs or tag in SIDE or tag in ("form", "header") else False
        if apart or tag in CONTAINERS:
            number = len(self.kinds)
            self.kinds.append(tag)
            path = (*path, number) if tag in CONTAINERS else path
            side = (*side, number) if apart else side
        stack.append(Open(tag, path, side, around.heading or tag in HEADINGS))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        for i in range(len(self.stack) - 1, 0, -1):
            kind = self.stack[i].tag
            if kind == tag:
                self._close(i)
                return
            if kind in CONTAINERS and tag not in CONTAINERS:
                return  # an end without a start inside this container

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        line = self.line
        if line.path is None and not data.isspace():
            o = self.stack[-1]
            line.path, line.side, line.heading = o.path, o.side, o.heading
        line.parts.append(data)
        if self.links:
            line.link += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._break()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios under a Gaussian of the lines around, weighted to the page's ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The value between the two clusters (of values in order) with the least squares inside; the least value if there is but one."""
    x = np.sort(values)
    if len(x) < 2 or x[0] == x[-1]:
        return float(x[0])
    n = np.arange(1, len(x))
    left, all_ = np.cumsum(x)[:-1], x.sum()
    between = left**2 / n + (all_ - left) ** 2 / (len(x) - n)
    between[x[1:] == x[:-1]] = -np.inf
    at = int(np.argmax(between))
    return float((x[at] + x[at + 1]) / 2)


def _pages(lines: list[Line], kinds: list[str]) -> set[int]:
    """Of the things that aren't content by name those that are the page: something around an article, or a form around nearly all text."""
    total, inside, around = 0, Counter(), set()
    for x in lines:
        total += len(x.text)
        for s in x.side:
            inside[s] += len(x.text)
            if any(p > s and kinds[p] in ("article", "main") for p in x.path):
                around.add(s)
    return {s for s in inside if kinds[s] not in SIDE and kinds[s] != "header" and (s in around or kinds[s] == "form" and inside[s] >= NEARLY_ALL * total)}


def main_lines(lines: list[Line], kinds: list[str]) -> list[Line]:
    """The lines of the content region, in page order."""
    page = _pages(lines, kinds) if any(x.side for x in lines) else set()
    apart = [[s for s in x.side if s not in page] for x in lines]
    linked: dict[int, list[int]] = {}
    for x in lines:  # lists and boxes that are links alone are menus, whatever they are called
        for p in x.path[1:]:
            if kinds[p] in ("ul", "ol", "div", "table", "dl", "section"):
                sums = linked.setdefault(p, [0, 0, 0])
                sums[0] += len(x.text)
                sums[1] += min(x.link, len(x.text))
                sums[2] += x.link > 0
    menus = {p for p, (all_, link, n) in linked.items() if n > 1 and link >= 0.8 * all_}
    side = [bool(s) or not menus.isdisjoint(x.path) for s, x in zip(apart, lines, strict=True)]
    kept = [i for i, s in enumerate(side) if not s]
    if not kept:
        return []
    weight = np.array([0.0 if s else len(x.text) - min(x.link, len(x.text)) for s, x in zip(side, lines, strict=True)])
    ratio = smoothed(np.log1p(weight / np.maximum(1, [x.tags for x in lines])))
    least = threshold(ratio[kept])
    content = [i for i in kept if ratio[i] >= least] or kept
    region, depth = 0, 0
    while True:
        held: Counter[int] = Counter()
        total = 0
        for i in content:
            x = lines[i]
            if depth < len(x.path) and x.path[depth] == region:
                total += len(x.text)
                if depth + 1 < len(x.path):
                    held[x.path[depth + 1]] += len(x.text)
        below = held.most_common(1)
        named = [p for p in held if kinds[p] in ("article", "main")]
        if len(named) == 1 and 2 * held[named[0]] >= total:
            below = [(named[0], total)]
        if not below or below[0][1] < NEARLY_ALL * total or kinds[region] == "article":
            break
        region, depth = below[0][0], depth + 1
    # of a header inside the region the headings stay
    own = kinds[region] not in ("page", "html", "body")
    return [x for x, s, other in zip(lines, apart, side, strict=True) if region in x.path and (not other or own and x.heading and s and all(kinds[p] == "header" and p > region for p in s))]


def main_text(html: str | None) -> str:
    """Blocks of the article, white space (as str.split has it) inside each turned into one space, joined by an empty line."""
    parser = Lines()
    parser.feed(html or "")
    return "\n\n".join(x.text for x in main_lines(parser.finish(), parser.kinds))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages(page_id, url, html); other columns are ignored.

    Whole pages are read, whatever their length. A null or empty html, and a page without an article, has an empty text.
    Nulls in page_id and url stay; rows that repeat have equal results. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

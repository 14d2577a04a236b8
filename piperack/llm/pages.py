"""HTML extraction: the main text of a page by the ratio of text to tags, from the standard library's parser events.

A page is read as a stream of events. Text between the boundaries of block elements is a line; its ratio is the length
of its text outside links, by the tags since the line before. Ratios are smoothed over neighbouring lines by a Gaussian
kernel and cut in two by clustering their logarithms around two means. The lines of the upper cluster are seeds: they
choose the region, the innermost container that holds most of their text; an article or main element on that way is
taken as it is. Everything in the region that is not furniture is the text, so short paragraphs stay beside long ones.
Outside articles only the siblings of seeds and the heading before them are taken.

Furniture has no ratio and is never text: elements for menus, footers, sidebars, forms, scripts, styles and the like,
headers outside the article, and elements whose role, class or id says notice, advert, comments and so on. What is
only named so is kept if it wraps the article itself; white space, character references and markup never stay.

Cases: null, empty and unreadable pages have an empty text and 0 characters; a page without text outside furniture
has an empty text; cut-off pages are read to their end, and an incomplete tag, comment or script there is no text; a tag
whose quote never ends gives up its quote; pages of any length are read whole; repeated rows give repeated rows, an
empty table an empty one; output columns replace columns of the same names, other columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piperack.llm.textcut import text_rows

#: Characters fed to the parser at once, spread of the kernel in lines, share of the seeds' text that a container needs to be entered.
FEED, SPREAD, HOLDS = 1 << 20, 1.0, 0.9
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote figcaption summary td th tr tbody thead tfoot table ul ol dl figure address".split())
#: Elements that are never part of an article, and those that are only so by what they hold.
DROPPED = frozenset("aside button canvas datalist dialog embed fieldset footer head iframe map menu nav noscript object script search select style svg template textarea title".split())
NAMED = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adslot alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr header login masthead menu"
    " menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies respond share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription topbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: What an element's start ends, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}
PARAGRAPH, NOT_PARAGRAPH = {"p"}, BLOCKS - {"p"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG = re.compile(r"(<[^<>]*>)")
HARD, SOFT = 2, 1  # furniture by what it is, and by its name only


class PageLines(HTMLParser):
    """Lines of a page: pieces of text with their elements, ratios' parts, and the tree of block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.flags = ["#page"], [-1], [0]  # by element
        self.stack: list[tuple[str, int]] = [("#page", 0)]
        self.open: dict[str, int] = defaultdict(int)
        self.lines: list[list[tuple[str, int, bool]]] = []
        self.counts: list[int] = []
        self.line: list[tuple[str, int, bool]] = []
        self.seen = 0

    def read(self, page: str) -> PageLines:
        for at in range(0, len(page), FEED):
            self.feed(page[at : at + FEED])
        rest, self.rawdata = self.rawdata, ""
        if rest and not self.cdata_elem:
            if not rest.startswith("<"):
                self.handle_data(unescape(rest))
            elif not rest.startswith("<!--"):  # a tag that never ends: the rest is read tag by tag, by the nearest brackets
                for k, part in enumerate(_TAG.split(rest)):
                    if k % 2:
                        self.feed(part)
                        self.rawdata = ""
                        self.clear_cdata_mode()
                    elif k:
                        self.handle_data(unescape(part.partition("<")[0]))
        self._end_line()
        return self

    def updatepos(self, i: int, j: int) -> int:
        return j  # places within the page aren't asked for

    def _end_line(self) -> None:
        if self.line:
            if not all(text.isspace() for text, _, _ in self.line):
                self.lines.append(self.line)
                self.counts.append(self.seen)
                self.seen = 0
            self.line = []

    def _close(self, names: set[str], stops: set[str] | frozenset[str] = frozenset()) -> None:
        """Ends the innermost open element of these names, if one is open, and what is open within it."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at][0] in names:
                for name, _ in self.stack[at:]:
                    self.open[name] -= 1
                del self.stack[at:]
                return
            if self.stack[at][0] in stops:
                return

    def _flag(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in DROPPED:
            return HARD
        inside = self.open["article"] or self.open["main"]
        if tag == "header":
            return 0 if inside else SOFT
        if tag == "form":
            return SOFT
        found = 0
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                return HARD
            if name == "role" and value.lower() in ROLES:
                return HARD
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                for each in value.split():
                    words = [w.lower() for w in _WORD.findall(each)]
                    if any(w in NAMED and not (w == "header" and inside) for w in words) and not {"has", "with", "no", "without"} & set(words):
                        found = SOFT
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.seen += 1
        if tag in BLOCKS:
            self._end_line()
            if self.open["p"]:
                self._close(PARAGRAPH, NOT_PARAGRAPH)
        elif tag == "br":
            self.line.append((" ", self.stack[-1][1], False))
        if tag in ENDS:
            names, stops = ENDS[tag]
            if any(self.open[n] for n in names):
                self._close(names, stops)
        elif tag == "a" and self.open["a"]:
            self._close({"a"}, BLOCKS)
        elif tag == "body" and self.open["head"]:
            self._close({"head"})
        elif tag in ("main", "article") and self.open["nav"]:
            self._close({"nav"})
        if tag in VOID:
            return
        flag, node = self._flag(tag, attrs), self.stack[-1][1]
        if tag in BLOCKS or flag:
            self.tags.append(tag)
            self.parents.append(node)
            self.flags.append(flag)
            node = len(self.tags) - 1
        self.stack.append((tag, node))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self.seen += 1
        if tag in BLOCKS:
            self._end_line()
        if self.open[tag] and tag != "html" and tag != "body":
            self._close({tag})

    def handle_data(self, data: str) -> None:
        if data:
            self.line.append((data, self.stack[-1][1], self.open["a"] > 0))


def smoothed(ratios: np.ndarray, spread: float = SPREAD) -> np.ndarray:
    """Gaussian means over neighbours; what a kernel has beyond the page's ends counts for nothing."""
    reach = int(np.ceil(3 * spread))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / spread) ** 2)
    whole = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[whole] / np.convolve(np.ones(len(ratios)), kernel)[whole]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values are in the upper of two clusters around two means; all that are above zero if they are alike."""
    low, high = values.min(), values.max()
    if high - low < 1e-9:
        return values > 0
    for _ in range(50):
        upper = values > (low + high) / 2
        means = values[~upper].mean(), values[upper].mean()
        if means == (low, high):
            break
        low, high = means
    return upper


def main_blocks(page: str | None) -> list[str]:
    """The blocks of a page's main text, in page order, their white space turned into single spaces."""
    if not page:
        return []
    read = PageLines().read(page)
    tags, parents, flags = read.tags, read.parents, list(read.flags)
    titled, holds = [tag == "h1" for tag in tags], [tag == "main" for tag in tags]
    for node in range(len(tags) - 1, 0, -1):  # what wraps the article: a main element, or an article with a title
        holds[node] = holds[node] or tags[node] == "article" and titled[node] and not flags[node]
        if flags[node] != HARD:
            holds[parents[node]] |= holds[node]
            titled[parents[node]] |= titled[node] and not (flags[node] and tags[node] != "form")
    gone, article = [False] * len(tags), [-1] * len(tags)
    for node in range(1, len(tags)):
        soft = flags[node] == SOFT and not (tags[node] != "header" and holds[node] or tags[node] == "form" and titled[node])
        gone[node] = gone[parents[node]] or flags[node] == HARD or soft
        article[node] = node if tags[node] in ("article", "main") and article[parents[node]] < 0 else article[parents[node]]
    blocks, places, ratios, linked = [], [], [], []
    for line, seen in zip(read.lines, read.counts, strict=True):
        kept = [(text, node, link) for text, node, link in line if not gone[node]]
        text = " ".join("".join(text for text, _, _ in kept).split())
        if text:
            own = sum(len(x) for x, _, link in kept if not link)
            blocks.append(text)
            places.append(min(node for _, node, _ in kept))  # the outermost: the line's own block
            linked.append(own < sum(len(x) for x, _, _ in kept) / 2)
        else:
            own = 0
            blocks.append("")
            places.append(0)
            linked.append(True)
        ratios.append(own / max(1, seen))
    if not any(blocks):
        return []
    full = np.array([bool(b) for b in blocks])
    seeds = upper_cluster(smoothed(np.log1p(np.array(ratios)))) & full & ~np.array(linked)
    if not seeds.any():
        seeds = full & ~np.array(linked)
    if not seeds.any():
        seeds = full
    weight = [0] * len(tags)
    for block, place, seed in zip(blocks, places, seeds, strict=True):
        weight[place] += len(block) * int(seed)
    for node in range(len(tags) - 1, 0, -1):
        weight[parents[node]] += weight[node]
    heaviest = [0] * len(tags)
    for node in range(1, len(tags)):
        above = parents[node]
        if not heaviest[above] or weight[node] > weight[heaviest[above]]:
            heaviest[above] = node
    region = 0
    while tags[region] not in ("article", "main"):
        inner = heaviest[region]
        chief = tags[inner] in ("article", "main") and 2 * weight[inner] > weight[region]
        if not inner or tags[inner] in LEAVES or not chief and weight[inner] < HOLDS * weight[region]:
            break
        region = inner
    within = [False] * len(tags)
    within[region] = True
    for node in range(region + 1, len(tags)):
        within[node] = within[parents[node]]
    if tags[region] in ("article", "main"):
        return [b for b, place in zip(blocks, places, strict=True) if b and within[place]]

    def container(node: int) -> int:
        while tags[node] in LEAVES:
            node = parents[node]
        return node

    around = {container(place) for place, seed in zip(places, seeds, strict=True) if seed and within[place]}
    taken = [bool(b) and within[p] and (bool(s) or not link and container(p) in around) for b, p, s, link in zip(blocks, places, seeds, linked, strict=True)]
    if not any(taken):
        return []
    first = taken.index(True)
    if not any(tags[p] == "h1" for p, t in zip(places, taken, strict=True) if t):  # the title before the region
        for k in range(first - 1, -1, -1):
            if blocks[k] and tags[places[k]] == "h1":
                taken[k] = True
                break
    return [b for b, t in zip(blocks, taken, strict=True) if t]


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns with text, the main text of the whole page, and n_chars, its code points."""

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return pa.array([" ".join(main_blocks(page)) for page in text_rows(column)], pa.string())

    return pages.select(*keep, texts(html).alias("text")).withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams events; block elements cut the page into lines, each with its
text length and the number of tags that stand in it. The ratio of text to tags of each line is
smoothed with a Gaussian over its neighbours, and a threshold clusters the lines into content and
the rest; runs of content lines are the content regions. What a page says of itself goes into this and
does not stand beside it:

- Elements that never hold an article (menus, page headers and footers, adverts, forms, reader comments, by
  element or by an unmistakable word in role, id or class) are ruled out before, and no neighbour's
  ratio is smoothed with theirs.
- Lines in ``article`` or ``main`` get the page's mean ratio on top of their own before smoothing, and
  lines beside them have to reach the mean. Marks are not heeded where the text beside them is more
  than PRIOR times theirs, as on a page whose only marked element is a teaser.
- Words that may mean an article's own part (legal, search, related, share, ...) rule a line out only
  where it is mostly links, or where it is unmarked and below the mean.

Cases: null, empty or text-less html gives ''; broken nesting is tolerated (a closing tag closes up
to its own opening tag, or is ignored) in time linear in the page; unclosed script or style content is
dropped; page_id and url pass through, nulls included; repeated rows give repeated rows; very long pages
are read whole; an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import mapped

SIGMA = 1.5
#: Kernel weights reach this many lines to either side.
REACH = 4
#: Marks are heeded unless the text beside them is more than so many times theirs.
PRIOR = 2
#: Lines whose smoothed ratio is above this share of (mean - spread) are content.
SHARE = 0.5
#: So many characters a tag, smoothed, are content on any page.
CLEAR_RATIO = 9

SKIP = frozenset("script style noscript template head title iframe object embed svg canvas select option textarea button audio video map math".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset(("article", "main"))
#: Words in id, class or role, compared whole: unmistakable ones, and ones that an article may use of its parts.
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login comment comments disqus reply replies pagination pager complementary contentinfo".split())
DOUBTFUL_WORDS = frozenset("banner menu side aside foot header alert form search share sharing social related recommended widget toolbar copyright legal dialog".split())
WORD = re.compile(r"[a-z]+")
WHITE = re.compile(r"\s+")


#: How an element bears on the text in it.
CLEAR, DOUBTFUL, OUT = 0, 1, 2


def _bearing(tag: str, attrs: list[tuple[str, str | None]], marked: bool) -> int:
    if tag in OUTSIDE or (tag == "header" and not marked):  # an article's own header holds its title
        return OUT
    found = CLEAR
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in ("body", "html"):
            words = WORD.findall(value.lower())
            if not OUTSIDE_WORDS.isdisjoint(words):
                return OUT
            if not DOUBTFUL_WORDS.isdisjoint(words):
                found = DOUBTFUL
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return OUT
        elif name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return OUT
    return found


class Line(NamedTuple):
    text: str
    tags: int
    doubtful: bool
    marked: bool
    linked: int  # characters in links


class _Lines(HTMLParser):
    """Cuts a page into lines; those in ruled-out elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, bool]] = []  # tag, and what it adds: skipped, bearing, marked
        self.open: dict[str, list[int]] = {}  # places of each tag in the stack
        self.blocks: list[int] = []  # places of block elements that no inline end tag closes
        self.skip = self.doubtful = self.out = self.marked = self.links = 0
        self.lines: list[Line] = []
        self.ruled_out = 0  # lines
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0

    def cut(self) -> None:
        if self.text:
            line = WHITE.sub(" ", "".join(self.text)).strip()
            if line:
                if self.out:
                    self.ruled_out += 1
                else:
                    self.lines.append(Line(line, self.tags, self.doubtful > 0, self.marked > 0, self.linked))
                self.tags = 0
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        # a second <p> or <li> ends an open one, so that broken pages don't nest without bound
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
            self._pop()
        adds = (tag, tag in SKIP, _bearing(tag, attrs, self.marked > 0), tag in MARKED)
        if any(adds[1:]):
            self.cut()
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK and tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(adds)
        self._add(adds, 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.cut()
        self.tags += 1

    def _add(self, adds: tuple[str, bool, int, bool], n: int) -> None:
        tag, skip, bearing, marked = adds
        self.skip += n * skip
        self.doubtful += n * (bearing == DOUBTFUL)
        self.out += n * (bearing == OUT)
        self.marked += n * marked
        self.links += n * (tag == "a")

    def _pop(self) -> None:
        adds = self.stack[-1]
        if any(adds[1:]):
            self.cut()
        self.stack.pop()
        self.open[adds[0]].pop()
        if adds[0] in BLOCK and adds[0] != "p":
            self.blocks.pop()
        self._add(adds, -1)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        at = self.open.get(tag)
        if not at or tag in VOID:
            return
        # an inline closing tag does not reach over a block element
        if tag not in BLOCK and tag not in SKIP and self.blocks and self.blocks[-1] > at[-1]:
            return
        last = at[-1]
        while len(self.stack) > last:
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(REACH + 1)]


def _smooth(x: list[float]) -> list[float]:
    out = []
    for i in range(len(x)):
        total = weight = 0.0
        for j in range(max(0, i - REACH), min(len(x), i + REACH + 1)):
            w = _KERNEL[abs(i - j)]
            total += w * x[j]
            weight += w
        out.append(total / weight)
    return out


def regions(lines: list[Line], ruled_out: int = 0) -> list[bool]:
    """Which lines are content. Ruled-out lines count as lines without text where the ratios are summed up."""
    ratio = [max(0, len(x.text) - 2 * x.linked) / (1 + x.tags) for x in lines]
    every = max(1, len(lines) + ruled_out)
    mean = sum(ratio) / every
    own = lambda marked: sum(len(x.text) - x.linked for x in lines if x.marked == marked)
    heeded = own(True) > 0 and PRIOR * own(True) >= own(False)
    smooth = _smooth([r + mean if heeded and x.marked else r for x, r in zip(lines, ratio, strict=True)])
    middle = sum(smooth) / every
    spread = math.sqrt((sum((x - middle) ** 2 for x in smooth) + ruled_out * middle**2) / every)
    threshold = min(CLEAR_RATIO, max(0.0, middle - spread) * SHARE)
    content = []
    for x, r, s in zip(lines, ratio, smooth, strict=True):
        weak = r < mean and not (heeded and x.marked) and (heeded or x.doubtful)
        content.append(s > threshold and 2 * x.linked <= len(x.text) and not weak)
    return content


def extract(html: str | None) -> str:
    """The article's text: its blocks in page order, joined by one space."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    return " ".join(x.text for x, kept in zip(parser.lines, regions(parser.lines, parser.ruled_out), strict=True) if kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars, one row a page."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x) for x in b.column("html").to_pylist()]
        return pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    return mapped(rows, run, "page_id bigint, url string, text string, n_chars bigint")

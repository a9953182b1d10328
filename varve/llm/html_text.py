"""Main text of HTML pages: parser events become lines, lines get text-to-tag ratios, smoothed ratios above a threshold are content.

A line's ratio is its characters (those of links count LINK_WEIGHT) over its tags, on a log scale, times the weights of the parts it stands in: elements
such as nav and footer, and class names that such parts often have, lower it, main elements raise it, and where a page has one, lines beside it are lowered.
No name or element of a visible part sets a ratio to 0, and a part that holds most of the page's text without links isn't lowered at all, so a theme's class names
on a wrapper lose nothing. The ratios are smoothed by a Gaussian over the lines of a part, not across its border, and those that reach THRESHOLD of the
page's spread are the content regions, whose lines are joined in page order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Elements that never have content, elements that stand inside a line, elements whose text is no text of the page, elements of parts beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("audio button canvas head iframe math noscript object option script select style svg template textarea title video".split())
BESIDE = frozenset("aside dialog fieldset footer form menu nav".split())
BESIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id names of parts beside the article, words that such parts and parts of articles share, and words by which a name tells a state.
BESIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot adbox breadcrumb breadcrumbs comment comments commentlist respond reply replies disqus consent cookie cookies cookiebar gdpr footer masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup sidebar sponsor sponsored subscribe toolbar".split())
DOUBTFUL_WORDS = frozenset("banner header promo promotion recommended related share sharing signup skip social widget widgets".split())
STATE_WORDS = frozenset("closed disabled enabled fixed has no non off open sticky with without".split())
MAIN = frozenset(("article", "main"))
#: Elements that end a line but need no place of their own, unless their attributes say something.
LEAF = frozenset(("p", "li", "dt", "dd", "td", "th", "tr"))
#: Standard deviation of the Gaussian in lines, and the share of the ratios' spread (their deviation, or a third of their maximum if that is more) that the smoothed ratio of content reaches.
SIGMA = 1.0
THRESHOLD = 0.25
#: Weights of a line's ratio: in a main element, beside it where there is one, in a part beside the article, under a doubtful name; of a link's characters.
IN_MAIN, BESIDE_MAIN, PART, DOUBTFUL, LINK_WEIGHT = 1.5, 0.1, 0.02, 0.5, 0.1
#: Share of the page's text without links above which a part is no part beside the article.
MOST = 0.5
#: Comments, declarations and the like, after raw elements, in which they are text.
_NOT_MARKUP = re.compile(r"(<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b.*?(?:</\2|\Z))|<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?", re.DOTALL | re.IGNORECASE)
_WORDS = re.compile(r"[_-]+")


def _name_words(names: str) -> set[str]:
    """Words of class or id names, but for names that tell a state, such as has-sidebar or comments-off."""
    out: set[str] = set()
    for name in names.lower().split():
        words = set(_WORDS.split(name))
        if words.isdisjoint(STATE_WORDS):
            out |= words
    return out


class Lines(HTMLParser):
    """Collects (text, ratio, part, main) per line; a line ends where a block element begins or ends. parts: weight, parent and text without links of each part
    that lowers its lines; part 0 is the page. Linear in the page's length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, int, bool]] = []
        self.parts: list[list[float]] = [[1.0, 0, 0.0]]
        self.open: list[tuple[str, bool, bool, bool]] = []  # tag, unseen, part, main
        self.at: dict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
        self.within = [0]  # open parts
        self.unseen = self.main = self.tags = self.links = 0
        self.text: list[str] = []
        self.weighed = self.plain = 0.0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, float(np.log2(1 + self.weighed / max(1, self.tags))), self.within[-1], self.main > 0))
            self.tags = 0
        self.text, self.weighed = [], 0.0

    def _push(self, tag: str, unseen: bool, weight: float, main: bool) -> None:
        self.at[tag].append(len(self.open))
        self.open.append((tag, unseen, weight < 1, main))
        self.unseen += unseen
        self.main += main
        if weight < 1:
            self.parts.append([weight, self.within[-1], -self.plain])
            self.within.append(len(self.parts) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            self.tags += 1
            self.links += tag == "a"
            if not attrs or tag in VOID:
                return
        words = {w for k, v in attrs if k in ("class", "id") and v for w in _name_words(v)}
        unseen, beside = tag in UNSEEN, tag in BESIDE or not words.isdisjoint(BESIDE_WORDS)
        doubtful = tag == "header" or not words.isdisjoint(DOUBTFUL_WORDS)
        for k, v in attrs:
            v = v or ""
            beside = beside or k == "hidden" or (k == "role" and v.lower() in BESIDE_ROLES) or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in v.replace(" ", ""))
        if tag == "header" and not self.main:  # the page's header; an article's own holds its title
            beside = True
        if tag in MAIN or tag in ("body", "html"):  # a theme's class names on the whole page say nothing about it
            beside = doubtful = False
        if tag in INLINE and not beside:
            return
        self.end_line()
        self.tags += tag not in INLINE
        if tag in VOID:
            return
        main = tag in MAIN or any((k == "itemprop" and v == "articleBody") or (k == "role" and v in ("main", "article")) for k, v in attrs)
        if unseen or beside or doubtful or main or tag not in LEAF:
            self._push(tag, unseen, PART if beside else DOUBTFUL if doubtful else 1.0, main)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        self.links = max(0, self.links - (tag == "a"))
        if not self.at[tag]:
            self.tags += 1
            if tag not in INLINE:
                self.end_line()
            return
        at = self.at[tag][-1]
        if tag not in MAIN and any(self.at[m] and self.at[m][-1] > at for m in MAIN):  # a stray end tag doesn't close the article
            return
        self.end_line()
        self.tags += 1
        while len(self.open) > at:
            self._pop()

    def _pop(self) -> None:
        name, unseen, part, main = self.open.pop()
        self.at[name].pop()
        self.unseen -= unseen
        self.main -= main
        if part:
            self.parts[self.within.pop()][2] += self.plain

    def close(self) -> None:
        super().close()
        self.end_line()
        while self.open:
            self._pop()

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.text.append(data)
        size = len(data.strip())
        self.weighed += size * (LINK_WEIGHT if self.links else 1)
        self.plain += 0 if self.links else size

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each part its weight, those of the parts around it included, and the innermost part at or around it that counts: one without most of the page's text."""
        weight, counts = np.ones(len(self.parts)), np.zeros(len(self.parts), np.int64)
        for i, (own, around, text) in enumerate(self.parts):
            if i:
                counted = text <= MOST * self.plain
                weight[i] = weight[around] * (own if counted else 1.0)
                counts[i] = i if counted else counts[around]
        return weight, counts


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def parsed(html: str) -> Lines:
    parser = Lines()
    html = _NOT_MARKUP.sub(lambda m: m[1] or "", html)
    cut = html.rfind(">") + 1  # what looks like a tag behind the last `>` is none
    parser.feed(html[:cut] + re.sub(r"</?[a-zA-Z].*", "", html[cut:], count=1, flags=re.DOTALL))
    parser.close()
    return parser


def main_text(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """Lines of the content regions, white space within a line as one space, joined by one space.

    A line is content if its smoothed ratio reaches threshold times the spread of the page's ratios, at most their maximum, so that a page of equal lines is kept."""
    page = parsed(html) if html else None
    if page is None or not page.lines:
        return ""
    ratio, part, main = (np.array([x[i] for x in page.lines]) for i in (1, 2, 3))
    weight, counts = page.places()
    own_weight = weight[part]
    some_main = bool((main & (own_weight >= DOUBTFUL)).any())
    own = ratio * own_weight * np.where(main, IN_MAIN, BESIDE_MAIN if some_main else 1.0)
    region, smooth = 2 * counts[part] + main, np.zeros(len(own))
    order = np.argsort(region, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
        smooth[at] = smoothed(own[at], sigma)
    spread = max(float(own.std()), float(own.max()) / 3)
    keep = smooth >= min(threshold * spread, float(smooth.max()))
    return " ".join(page.lines[i][0] for i in np.flatnonzero(keep))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Null, empty and text-free pages give an empty text. Repeated rows are extracted each. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", F.col("html").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")

"""Main text of web pages from parser events and smoothed text-to-tag ratios.

The standard-library parser's events are cut into lines, one per block element. A line's
text-to-tag ratio is its characters per tag; the logarithms of the ratios are smoothed with a Gaussian and
split into two clusters by a threshold between their means. The outermost element that declares the page's
content (``article``, ``main`` or that role) and holds most of the dense lines is the content region, with all
that is nested in it; its siblings belong to it unless they are sparse. Without one, the region spans the dense
lines and the lines between them, and the text blocks and the containers of dense lines outside of that.
Lines inside navigation, headers, footers, side bars, forms, adverts, notices and comments are never content. Inside
a content element a class or id counts as such a name only if all its parts do (``share-price`` does not), and names
that articles use as well (``WEAK``) hide an element only if most of its text lies in lines that are not dense.

Cases: NULL or empty html, or a page without content, gives ''. Unclosed and stray tags are
closed by their parents. Equal rows are each extracted; an empty table gives no rows; other
columns are ignored. Nothing is cut off, whatever the page's length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.base import arrow, register, table

# Element names of HTML and common names of page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg canvas object iframe audio video math".split())
FURNITURE = frozenset("nav footer aside form menu button select textarea dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CONTENT = frozenset("article main".split())
SPARSE = 15  # characters outside links per tag
TEASERS = frozenset("comment comments reply related teaser ad ads advert promo sponsored".split())
NAMES = re.compile(
    r"(?:^|[_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget\w*|footer|header|masthead|"
    r"cookie\w*|consent|gdpr|notice\w*|notification\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|"
    r"comments?|commentlist|discussion|replies|disqus\w*|related|recommend\w*|pagination|pager|copyright|disclaimer|toolbar|search\w*)(?:$|[_-])",
    re.I,
)
# Inside content: names of furniture, those of them that articles use as well, and what goes with them in compounds.
WEAK = frozenset("alert banner copyright disclaimer discussion footer header notice notices notification overlay recommend recommended recommendations related search share sharing side social".split())
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr login masthead menu modal nav navbar navigation "
    "newsletter pager pagination popup promo promotion replies sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
BESIDE = frozenset("area articles bar block bottom box btn button buttons container content form icon icons inner item items left link links list main media outer panel post posts right section slot stories top unit wrap wrapper".split())


def named(name: str) -> int:
    """Whether a class or id inside content is one of furniture: 0 no, 1 perhaps, 2 yes."""
    parts = [p for p in re.split(r"[_-]+", name.lower()) if p and not p.isdigit()]
    if not all(p in WEAK or p in STRONG or p in BESIDE for p in parts):
        return 0
    return 2 if STRONG.intersection(parts) else int(bool(WEAK.intersection(parts)))


class Lines(HTMLParser):
    """Collects lines: text, number of tags, whether page furniture, outermost content element, container, characters in links, weakly named element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Name, hidden, furniture (by its name only: 1, by element or role: 2), outermost content element, block, in a link, weak.
        self.stack: list[tuple[str, bool, int, int, int, bool, int]] = []
        self.blocks: list[int] = []  # places of block elements in the stack
        self.open: list[dict[str, int]] = [{}]  # names of open inline elements behind each of them, and before the first
        self.names: dict[str, int] = {}  # names of open block elements
        self.elements = self.weak = 0
        self.above = [0]  # the block around each block; 0 is the page
        self.lines: list[tuple[str, int, bool, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _state(self) -> tuple[bool, int, int]:
        return self.stack[-1][1:4] if self.stack else (False, 0, -1)

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, furniture, content = self._state()
            self.lines.append((text, self.tags, furniture > 0, content, self.above[self.stack[-1][4] if self.stack else 0], self.linked, self.stack[-1][6] if self.stack else 0))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._cut()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.stack:
                self._close_open(tag)
        elif tag in ("br", "wbr", "img"):
            self.parts.append(" " if tag == "br" else "")
        self.tags += 1
        if tag in VOID:
            return
        hidden, furniture, content = self._state()
        values = {k: v or "" for k, v in attrs}
        inside, weak = content >= 0, self.stack[-1][6] if self.stack else 0
        role = values.get("role", "").lower()
        names = f"{values.get('class', '')} {values.get('id', '')}".split()
        if tag in CONTENT or role in CONTENT:
            # What a page declares as its content is not furniture for the name of a wrapper.
            if furniture < 2 and not inside:
                furniture = 0
            if not furniture and not inside:
                self.elements += 1
                content = self.elements
            if TEASERS.intersection(n.lower() for n in names):
                furniture = 2
        elif tag in FURNITURE or role in ROLES or (tag == "header" and not inside):
            furniture = 2
        elif inside:
            own = max(map(named, names), default=0)
            furniture = 2 if own == 2 else furniture
            if own == 1 and not weak:
                self.weak += 1
                weak = self.weak
        elif tag not in ("html", "body") and any(NAMES.search(n) for n in names if not n.lower().startswith(("has-", "with-", "no-", "without-"))):
            furniture = max(furniture, 1)
        hidden = hidden or tag in HIDDEN or "hidden" in values
        block, link = (self.stack[-1][4], self.stack[-1][5]) if self.stack else (0, False)
        if tag not in INLINE:
            self.above.append(block)
            block = len(self.above) - 1
            self.blocks.append(len(self.stack))
            self.open.append({})
            self.names[tag] = self.names.get(tag, 0) + 1
        else:
            self.open[-1][tag] = self.open[-1].get(tag, 0) + 1
        self.stack.append((tag, hidden, furniture, content, block, link or tag == "a", weak))

    def _pop(self, size: int) -> None:
        """Close all elements but the first ``size``."""
        while len(self.stack) > size:
            name = self.stack.pop()[0]
            if name in INLINE:
                self.open[-1][name] -= 1
            else:
                self.blocks.pop()
                self.open.pop()
                self.names[name] -= 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_open(self, tag):
        """A new paragraph, item or cell ends an open one of its kind in the same container."""
        ends = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}[tag]
        for at in reversed(self.blocks):
            name = self.stack[at][0]
            if name in ends:
                self._pop(at)
                return
            if name not in ("td", "th"):
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._cut()
        self.tags += 1
        # What is not open is not looked for, so stray tags cost nothing however deep the page is.
        if (self.open[-1] if tag in INLINE else self.names).get(tag, 0):
            self._pop(next(at for at in range(len(self.stack) - 1, -1, -1) if self.stack[at][0] == tag))

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)
            if self.stack and self.stack[-1][5]:
                self.linked += len(" ".join(data.split()))

    def close(self):
        super().close()
        self._cut()


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a window of three sigma; the kernel is scaled to what lies inside."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """Cut between two clusters: the mean of their means, from the overall mean."""
    cut = float(values.mean())
    for _ in range(rounds):
        high, low = values[values >= cut], values[values < cut]
        if not len(high) or not len(low):
            break
        before, cut = cut, (float(high.mean()) + float(low.mean())) / 2
        if abs(before - cut) < 1e-9:
            break
    return cut


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by empty lines."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    sizes = np.array([len(text) for text, *_ in lines], float)
    furniture = np.array([line[2] for line in lines])
    tags = np.maximum(1, [line[1] for line in lines])
    plain = np.maximum(0, sizes - [line[5] for line in lines])  # characters outside links
    # Logarithms, as one very long paragraph would else set the cut for all others.
    smooth = smoothed(np.log1p(np.where(furniture, 0.0, sizes / tags)))
    dense = (smooth >= threshold(smooth)) & ~furniture
    weak = np.array([line[6] for line in lines])
    if weak.any():
        whole, thick = np.bincount(weak, sizes), np.bincount(weak, np.where(dense & (plain * 2 >= sizes), sizes, 0))
        furniture = furniture | ((weak > 0) & (thick * 2 < whole)[weak])
        dense &= ~furniture
    inside: dict[int, np.ndarray] = {}  # weight, characters outside links and tags of each outermost content element
    for at, (_, _, _, content, *_) in enumerate(lines):
        if content >= 0 and not furniture[at]:
            inside[content] = inside.get(content, 0) + np.array([sizes[at] * (1 + dense[at]), plain[at], tags[at]])
    if inside:
        # Several content elements: unmarked teasers are links and short texts among many tags.
        most = max(weight for weight, *_ in inside.values())
        chosen = {k for k, (weight, own, n) in inside.items() if weight >= 0.5 * most or own >= SPARSE * n}
        kept = [line[0] for at, line in enumerate(lines) if line[3] in chosen and not furniture[at]]
    else:
        text = ~furniture & (plain * 2 >= sizes)
        # Lists of links beside a long line are no ends of the region, unless the page has nothing else.
        places = np.flatnonzero(dense & text if (dense & text).any() else dense)
        region = np.zeros(len(lines), bool)
        if len(places):
            region[places[0] : places[-1] + 1] = True
        # Blocks of text belong to it wherever they are, and what shares a container with dense lines.
        solid = text & (plain >= SPARSE * tags)
        around = np.zeros(len(parser.above), bool)
        around[[lines[at][4] for at in np.flatnonzero(dense & text | solid)]] = True
        for block, above in enumerate(parser.above):
            around[block] |= around[above]
        region |= solid | text & around[[line[4] for line in lines]]
        kept = [lines[at][0] for at in np.flatnonzero(region & ~furniture)]
    return "\n\n".join(kept)


def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py()) for page in pages], pa.string())


def page_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page."""
    found = pages.select(F.col(key), F.col(url), arrow(_extract, "string")(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@register("op8_html_text")
def op8_html_text(spark, folder):
    """Main text of every page."""
    return page_texts(table(spark, folder, "pages"))

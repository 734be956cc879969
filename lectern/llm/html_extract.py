"""Main-text extraction from HTML by flat text blocks and a decision tree.

A page is cut into a flat list of text blocks at block-level tags, in one pass forward. Elements that are menus, headers, footers,
sidebars or forms by HTML itself (or are hidden, or hold reader comments) go with what is in them. Each other block is described
by its word count and link density, those of its neighbours, what class names hint at, and whether it stands in a main element;
a decision tree, grown from the small labelled table below, tells which blocks are the article. Successive blocks of links within
a main element, such as a bibliography's, are described by their mean and by what stands before and after all of them, and are
kept or dropped together. Nothing is dropped or capped otherwise.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What follows a tag's name up to its end; quotes count where a value begins. Possessive, so that nothing is tried twice.
REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
# Element names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math textarea select button title canvas audio video noframes".split())
FURNITURE_TAGS = frozenset("nav aside footer form menu dialog head fieldset".split())
MAIN_TAGS = frozenset(("article", "main"))
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies".split())
FURNITURE_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs consent cookie cookies gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus sidebar sidebars rail footer masthead topbar toolbar share sharing social sponsor sponsored sponsors promo promos promotion promoted paywall pagination pager".split())
#: Words that name parts of articles as well: an article's own header, sections on related work or with a discussion.
DOUBTFUL_WORDS = frozenset("header related recommended recommendations discussion widget widgets skip".split())
MAIN_WORDS = frozenset("article articlebody content main maincontent post entry story".split())
WORD_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
# What an element says of its text: nothing, perhaps furniture, furniture by a class name, furniture by HTML (or comments).
PLAIN, DOUBTFUL, HINTED, CERTAIN = range(4)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    hint: int
    main: bool

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0

    @property
    def is_plain_link(self) -> bool:
        """Mostly links, in a main element, with nothing else that speaks against it."""
        return self.main and self.hint == PLAIN and 2 * self.link_words >= self.words > 0


def _says(tag: str, attrs: str, inside_main: bool) -> tuple[int, bool]:
    """What an element says of its text, and whether it is main content."""
    hint = CERTAIN if tag in FURNITURE_TAGS or tag == "header" and not inside_main else PLAIN
    main = tag in MAIN_TAGS
    if attrs.strip("/ "):
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("class", "id") and tag not in ("html", "body"):
                words = {x.lower() for x in WORD_PARTS.findall(value)}
                if words & COMMENT_WORDS:
                    hint = CERTAIN
                elif not main and words & FURNITURE_WORDS:
                    hint = max(hint, HINTED)
                elif not main and words & DOUBTFUL_WORDS:
                    hint = max(hint, DOUBTFUL)
                elif hint == PLAIN and words & MAIN_WORDS:
                    main = True
            elif name == "role":
                hint = CERTAIN if value.lower() in FURNITURE_ROLES else hint
                main |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*+:\s*+none", value, re.I):
                hint = CERTAIN
    return hint, main


class _Element:
    """An open block element with the inline elements that are open in it."""

    __slots__ = ("hint", "inline", "main", "names", "outer", "tag")

    def __init__(self, tag: str, hint: int = PLAIN, main: bool = False, outer: list[int] | None = None):
        self.tag, self.hint, self.main, self.outer = tag, hint, main, outer
        self.inline: list[tuple[str, int]] = []
        self.names: Counter[str] = Counter()


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): text, open and end tags, in one pass: each character is looked at a bounded number of times.
    As in browsers, a tag that the page ends within is nothing, and a comment that isn't closed goes to the end."""
    closers: dict[str, re.Pattern] = {}
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = COMMENT_END.search(page, lt + 2 if page.startswith(("<!-->", "<!--->"), lt) else lt + 4)
            at = end.end() if end else n
        elif after in ("!", "?") or after == "/" and not NAME.match(page, lt + 2):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        elif after == "/" or NAME.match(page, lt + 1):
            name = NAME.match(page, lt + 1 + (after == "/"))
            rest = REST.match(page, name.end())
            if not rest:
                return
            at, tag = rest.end(), name[0].lower()
            yield ("end" if after == "/" else "open"), tag, rest[1]
            if after != "/" and tag in RAW and not (rest[1].endswith("/") and tag in ("svg", "math")):
                if tag not in closers:
                    closers[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)
                end = closers[tag].search(page, at)
                at = end.end() if end else n
        else:
            yield "text", "<", ""
            at = lt + 1


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; unclosed, stray and misnested tags are put up with as browsers do, roughly."""
    out: list[Block] = []
    stack = [_Element("")]
    n_open: Counter[str] = Counter()
    parts: list[tuple[str, bool, int]] = []
    hints, within, state = [0] * 4, [0] * 4, [0, 0]  # open block and inline elements by what they say; those that are main, links

    def worst(counts: list[int]) -> int:
        return next((k for k in (CERTAIN, HINTED, DOUBTFUL) if counts[k]), PLAIN)

    def flush() -> None:
        """The text so far as a block; what inline elements say is furniture is a block of its own behind it."""
        for level in sorted({x[2] for x in parts}):
            own = [x for x in parts if x[2] == level]
            words = "".join(x[0] for x in own).split()
            if words:
                links = sum(len(x[0].split()) for x in own if x[1])
                out.append(Block(" ".join(words), len(words), min(links, len(words)), max(level, worst(hints)), state[0] > 0))
        parts.clear()

    def pop_inline() -> None:
        tag, hint = stack[-1].inline.pop()
        stack[-1].names[tag] -= 1
        within[hint] -= 1
        state[1] -= tag == "a"

    def pop() -> None:
        while stack[-1].inline:
            pop_inline()
        x = stack.pop()
        n_open[x.tag] -= 1
        state[0] -= x.main
        if x.outer is not None:
            hints[DOUBTFUL], hints[HINTED] = x.outer
        hints[x.hint] -= 1

    for kind, tag, attrs in _tokens(page):
        if kind == "text":
            parts.append((html.unescape(tag), state[1] > 0, worst(within)))
        elif tag in RAW:
            if tag not in INLINE:
                flush() if kind == "end" else parts.append((" ", False, worst(within)))
        elif tag in INLINE:
            if kind == "end":
                if stack[-1].names[tag]:
                    while stack[-1].inline[-1][0] != tag:
                        pop_inline()
                    pop_inline()
            elif tag == "br":
                parts.append((" ", False, worst(within)))
            elif tag not in VOID:
                if tag == "a" and stack[-1].names["a"]:  # a link within a link ends it
                    while stack[-1].inline[-1][0] != "a":
                        pop_inline()
                    pop_inline()
                hint = _says(tag, attrs, state[0] > 0)[0]
                stack[-1].inline.append((tag, hint))
                stack[-1].names[tag] += 1
                within[hint] += 1
                state[1] += tag == "a"
        elif kind == "end":
            flush()
            if n_open[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
        else:
            flush()
            while stack[-1].tag == "p":  # a new block ends an open paragraph
                pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
                pop()
            if tag not in VOID:
                hint, main = _says(tag, attrs, state[0] > 0)
                hints[hint] += 1
                outer = None
                if main and not state[0]:  # class names of what is around an article, as of layouts, say nothing of it
                    outer, hints[DOUBTFUL], hints[HINTED] = hints[DOUBTFUL : HINTED + 1], 0, 0
                stack.append(_Element(tag, hint, main, outer))
                n_open[tag] += 1
                state[0] += main
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "hint", "main")
# The labelled table. Columns as in FEATURES (hint: 0 none, 1 doubtful, 2 a furniture class; main: 0 no such element
# on the page, 1 outside of it, 2 inside), then 1 for article text.
LABELLED = """
1   1.0 0   0.0 1   1.0  2 1 0
1   1.0 1   1.0 1   1.0  2 1 0
2   1.0 1   1.0 8   0.0  2 1 0
8   0.0 1   1.0 10  0.0  2 1 0
25  0.0 2   1.0 12  0.0  2 1 0
6   0.1 80  0.0 0   0.0  2 1 0
9   0.0 5   0.0 0   0.0  2 1 0
40  0.0 60  0.0 12  0.0  2 2 0
7   0.0 90  0.0 55  0.0  2 2 0
3   0.3 20  0.0 30  0.0  2 2 0
30  0.0 50  0.0 40  0.0  2 2 0
1   1.0 1   1.0 1   1.0  2 0 0
3   1.0 2   1.0 4   1.0  2 0 0
12  0.0 3   1.0 60  0.0  2 0 0
45  0.0 80  0.0 9   0.0  2 0 0
60  0.0 20  0.0 30  0.0  2 0 0
30  0.0 0   0.0 50  0.0  2 0 0
10  0.0 40  0.0 60  0.0  2 0 0
26  0.0 35  0.0 0   0.0  2 0 0
7   0.0 12  0.0 33  0.0  2 0 0
5   0.0 0   0.0 2   1.0  0 1 0
20  0.0 8   0.0 9   0.0  0 1 0
60  0.0 7   0.0 30  0.0  0 1 0
1   1.0 1   1.0 1   1.0  0 1 0
9   0.1 120 0.0 0   0.0  0 1 0
30  0.0 60  0.0 0   0.0  0 1 0
12  0.0 45  0.0 20  0.0  0 1 0
4   0.0 90  0.0 50  0.0  0 1 0
70  0.0 40  0.0 80  0.0  0 1 0
15  0.0 0   0.0 60  0.0  0 1 0
6   0.0 5   0.0 0   0.0  0 1 0
25  0.2 30  0.0 1   0.0  0 1 0
2   0.0 70  0.0 33  0.0  0 1 0
45  0.1 50  0.0 42  0.0  0 1 0
1   0.0 33  0.0 1   0.0  0 1 0
120 0.0 2   0.0 65  0.0  0 1 0
80  0.0 9   0.0 90  0.1  0 1 0
18  0.0 20  0.0 36  0.0  0 1 0
1   0.0 8   0.0 50  0.0  0 2 1
8   0.0 9   0.0 70  0.0  0 2 1
10  0.0 8   0.0 2   0.0  0 2 1
2   0.0 60  0.0 1   0.0  0 2 1
1   0.0 2   0.0 90  0.0  0 2 1
120 0.0 10  0.0 75  0.0  0 2 1
75  0.1 120 0.0 9   0.0  0 2 1
300 0.0 4   0.0 2   0.0  0 2 1
33  0.2 40  0.0 25  0.1  0 2 1
6   0.5 50  0.0 45  0.0  0 2 1
3   1.0 60  0.0 70  0.0  0 2 1
12  1.0 45  0.0 30  0.0  0 2 1
5   0.0 3   1.0 40  0.0  0 2 1
2   0.0 1   0.0 6   0.0  0 2 1
90  0.0 0   0.0 0   0.0  0 2 1
1   0.0 0   0.0 0   0.0  0 2 1
40  0.0 3   0.0 5   1.0  0 2 1
8   0.0 0   0.0 2   1.0  0 2 1
2   0.0 9   0.0 14  0.9  0 2 1
4   0.0 30  0.2 6   0.0  0 2 1
11  0.0 12  0.1 5   0.0  0 2 1
3   0.0 2   1.0 4   0.3  0 2 1
7   0.3 8   0.6 9   0.7  0 2 1
15  0.1 3   0.9 1   1.0  0 2 1
2   0.5 20  0.4 12  0.2  0 2 1
22  0.6 70  0.7 3   0.5  0 2 1
50  0.4 2   0.8 26  0.1  0 2 1
9   0.8 15  0.3 18  0.9  0 2 1
1   1.0 0   0.0 1   1.0  0 0 0
2   1.0 2   1.0 3   1.0  0 0 0
4   1.0 3   1.0 60  0.0  0 0 0
3   0.9 4   0.8 2   0.7  0 0 0
8   0.8 30  0.0 7   0.9  0 0 0
15  0.7 6   1.0 9   0.8  0 0 0
4   0.0 2   1.0 3   1.0  0 0 0
6   0.0 3   1.0 2   0.9  0 0 0
5   0.0 4   0.8 3   1.0  0 0 0
20  0.6 25  0.1 14  0.7  0 0 0
60  0.0 5   0.0 45  0.0  0 0 1
45  0.1 60  0.0 50  0.0  0 0 1
30  0.0 45  0.0 3   1.0  0 0 1
25  0.0 3   1.0 40  0.0  0 0 1
120 0.2 8   0.0 90  0.1  0 0 1
7   0.0 50  0.0 40  0.0  0 0 1
3   0.0 45  0.0 60  0.0  0 0 1
1   0.0 30  0.0 2   0.0  0 0 1
2   0.0 1   0.0 40  0.0  0 0 1
9   0.0 0   0.0 55  0.0  0 0 1
80  0.0 0   0.0 0   0.0  0 0 1
6   0.0 0   0.0 0   0.0  0 0 1
50  0.0 90  0.0 70  0.0  0 0 1
3   0.0 120 0.0 8   0.0  0 0 1
10  0.0 75  0.1 60  0.0  0 0 1
28  0.0 2   1.0 35  0.0  0 0 1
40  0.1 3   0.9 4   0.0  0 0 1
14  0.3 60  0.0 35  0.0  0 0 1
18  0.0 40  0.0 2   0.9  0 0 1
200 0.0 2   0.0 1   1.0  0 0 1
200 0.0 2   0.0 3   1.0  0 0 1
90  0.0 0   0.0 4   1.0  0 0 1
60  0.1 5   0.0 8   1.0  0 0 1
35  0.0 3   0.0 1   1.0  0 0 1
26  0.2 1   0.0 2   0.9  0 0 1
45  0.0 3   1.0 2   1.0  0 0 1
80  0.2 1   1.0 1   1.0  0 0 1
30  0.1 12  0.9 6   0.8  0 0 1
90  0.0 60  0.0 45  0.0  2 0 1
120 0.1 45  0.0 80  0.0  2 0 1
85  0.0 150 0.0 50  0.1  2 0 1
200 0.0 90  0.0 110 0.0  2 0 1
100 0.0 40  0.1 70  0.0  2 0 1
90  0.0 1   1.0 2   1.0  2 0 0
40  0.0 50  0.0 60  0.0  2 0 0
35  0.0 80  0.0 45  0.0  2 0 0
50  0.1 45  0.0 90  0.0  2 0 0
110 0.7 60  0.0 45  0.0  2 0 0
15  0.0 90  0.0 120 0.0  2 0 0
5   0.0 1   1.0 7   0.0  2 1 0
8   0.0 1   1.0 12  0.0  2 1 0
90  0.0 60  0.0 70  0.0  2 1 0
90  0.0 60  0.0 70  0.0  2 2 0
2   1.0 3   1.0 2   1.0  0 2 0
1   1.0 1   1.0 1   1.0  0 2 0
3   1.0 2   1.0 4   1.0  0 2 0
4   1.0 4   1.0 3   1.0  0 2 0
2   1.0 90  0.0 3   1.0  0 2 1
3   1.0 2   1.0 0   0.0  0 2 0
2   1.0 40  0.0 2   1.0  0 2 1
1   1.0 2   1.0 0   0.0  0 2 0
12  1.0 9   1.0 14  1.0  0 2 1
10  0.9 12  1.0 11  0.9  0 2 1
20  0.8 15  0.9 18  1.0  0 2 1
6   0.6 5   0.7 8   0.5  0 2 1
2   1.0 30  0.0 60  0.0  0 2 1
1   1.0 80  0.0 45  0.0  0 2 1
3   1.0 0   0.0 70  0.0  0 2 1
4   0.0 90  0.0 3   1.0  0 2 1
1   0.0 6   1.0 40  0.0  1 2 1
2   0.0 0   0.0 60  0.0  1 2 1
7   0.0 5   0.0 4   0.0  1 2 1
9   0.0 1   1.0 80  0.0  1 2 1
4   0.2 9   0.0 70  0.0  1 2 1
3   0.5 8   0.0 90  0.0  1 2 1
2   0.0 75  0.0 60  0.0  1 2 1
60  0.0 2   0.0 45  0.0  1 2 1
45  0.1 60  0.0 30  0.0  1 2 1
30  0.0 45  0.0 2   0.0  1 2 1
80  0.2 50  0.0 0   0.0  1 2 1
1   0.0 90  0.0 3   1.0  1 2 0
2   0.0 60  0.0 6   1.0  1 2 0
3   0.0 45  0.0 4   0.9  1 2 0
6   1.0 2   0.0 5   1.0  1 2 0
8   1.0 6   1.0 0   0.0  1 2 0
4   0.9 5   1.0 7   1.0  1 2 0
12  0.8 3   0.0 9   1.0  1 2 0
2   0.0 0   0.0 3   1.0  1 0 0
1   0.0 0   0.0 1   1.0  1 0 0
5   0.0 2   0.0 1   1.0  1 0 0
3   1.0 1   0.0 4   1.0  1 0 0
6   0.9 3   1.0 5   1.0  1 0 0
9   0.0 2   1.0 70  0.0  1 0 1
60  0.0 4   0.0 50  0.0  1 0 1
40  0.1 60  0.0 30  0.0  1 0 1
2   0.0 60  0.0 45  0.0  1 0 1
25  0.0 8   0.0 60  0.0  1 0 1
1   0.0 0   0.0 1   1.0  1 1 0
2   0.0 0   0.0 5   0.0  1 1 0
40  0.0 20  0.0 30  0.0  1 1 0
60  0.1 90  0.0 45  0.0  1 1 0
4   1.0 3   1.0 5   1.0  1 1 0
120 0.0 0   0.0 90  0.0  2 0 1
150 0.1 3   0.0 120 0.0  2 0 1
100 0.0 90  0.0 0   0.0  2 0 1
180 0.0 110 0.1 2   1.0  2 0 1
90  0.0 0   0.0 2   1.0  2 0 0
3   1.0 1   0.0 0   0.0  0 2 1
2   1.0 55  0.0 0   0.0  0 2 1
4   1.0 2   0.0 30  0.0  0 2 1
2   1.0 1   0.0 4   1.0  0 2 1
5   1.0 70  0.0 3   1.0  0 2 1
2   1.0 0   0.0 0   0.0  0 2 1
3   1.0 80  0.0 25  0.0  0 2 1
1   1.0 6   0.0 5   1.0  0 2 1
2   1.0 0   0.0 30  0.0  0 2 0
1   1.0 0   0.0 2   0.0  0 2 0
3   1.0 3   1.0 2   0.0  0 2 0
3   1.0 2   1.0 60  0.0  0 2 0
2   1.0 0   0.0 5   0.0  0 2 0
1   1.0 4   1.0 8   0.0  0 2 0
1   0.0 0   0.0 200 0.0  0 2 1
2   0.0 0   0.0 40  0.0  0 2 1
1   0.0 0   0.0 2   0.0  0 2 1
2   0.0 0   0.0 60  0.1  0 2 1
1   0.0 0   0.0 3   1.0  0 2 1
2   1.0 200 0.0 1   1.0  2 2 0
1   1.0 2   1.0 0   0.0  2 2 0
2   1.0 150 0.0 0   0.0  2 2 0
3   0.0 180 0.0 90  0.0  2 2 0
4   1.0 130 0.0 40  0.0  2 2 0
5   0.0 150 0.0 2   1.0  2 1 0
"""


def grow(x: np.ndarray, y: np.ndarray, depth: int = 16):
    """A decision tree by Gini impurity: a share of ones, or (feature, threshold, tree up to it, tree above it)."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            cost = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (left, ~left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(t), left)
    if best is None:
        return float(y.mean())
    _, f, t, left = best
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree, row) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def labelled() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return table[:, :-1], table[:, -1]


def trained():
    return grow(*labelled())


def held_out_accuracy(columns: tuple[int, ...] = tuple(range(len(FEATURES))), folds: int = 10) -> float:
    """The share of labelled blocks that trees grown from the other folds get right, by the given columns of FEATURES alone."""
    x, y = labelled()
    x, fold = x[:, columns], np.arange(len(y)) % folds
    right = 0
    for k in range(folds):
        tree = grow(x[fold != k], y[fold != k])
        right += sum(decide(tree, row) == (label == 1) for row, label in zip(x[fold == k], y[fold == k], strict=True))
    return right / len(y)


def extract(page: str | None, tree) -> str:
    """The article of one page."""
    found = blocks(page or "")
    # A marker that holds less running text than stands outside of furniture and markers, as one of a byline, marks no article.
    text = [sum(b.words - b.link_words for b in found if b.hint < HINTED and b.main == side) for side in (False, True)]
    has_main = any(b.main for b in found) and text[True] >= text[False]
    kept: list[str] = []
    k = 0
    while k < len(found):
        b, end = found[k], k + 1
        if has_main and b.is_plain_link:  # a list of links within the article stays or goes as one
            while end < len(found) and found[end].is_plain_link:
                end += 1
        run, words = found[k:end], sum(x.words for x in found[k:end])
        before, after = found[k - 1] if k else None, found[end] if end < len(found) else None
        k = end
        if b.hint == CERTAIN:
            continue
        density = sum(x.link_words for x in run) / words if words else 0.0
        row = (words / len(run), density, before.words if before else 0, before.link_density if before else 0.0, after.words if after else 0, after.link_density if after else 0.0, b.hint, (2 if b.main else 1) if has_main else 0)
        if decide(tree, row):
            kept += [x.text for x in run]
    return "\n\n".join(kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per input row: id_col, url_col, text (empty if the page has none or is null or empty), n_chars (code points).

    Repeated rows and null identifiers are extracted like any other; other columns are ignored. A page of any length is read as a
    whole, in linear time."""
    tree = trained()
    schema = pa.schema([("i", pa.int64()), ("u", pa.string()), ("text", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i, u, h in zip(*(b.column(k) for k in range(3)), strict=True):
                    text = extract(h.as_py(), tree)
                    yield i.as_py(), u.as_py(), text, len(text)

        return batched(rows(), schema)

    src = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    return src.mapInArrow(run, "i long, u string, text string, n long").select(F.col("i").alias(id_col), F.col("u").alias(url_col), "text", F.col("n").alias("n_chars"))

"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block.  A line's weight is the length of its text, and ``SURGE`` more for a
paragraph that ends like a sentence; lines of menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, and (outside articles) lines that are mostly links weigh nothing.  Weights are summed over sliding windows of
``WINDOW`` lines: the text surges where a window reaches the threshold and dives where windows are empty again, and the
lines with weight between a surge and its dive, back to the last empty window, are the main text.  ``article`` and
``main`` elements surge where they open and dive where they close; what is outside has to surge by itself, so that menus
without a listed name don't come along with the article beside them.  A short line between two blocks that weigh nothing
belongs to the surge beside it: it is kept if main text stands in the same element, a heading also if main text stands
anywhere in the element that holds it.

Reader comments stay comments whatever elements they are made of: an ``article`` with a comment's name, or inside an
element whose name says nothing but comments, opens no main text.

A listed class, id or role voids blocks only: none that holds more than half of the page's unlinked text, not the header
of an article, and inside an article no paragraph, heading, list item or cell, and a container only if its name consists
of listed and neutral words (``related-posts``, but not ``related-work``).  An inline element with a listed name voids a
line that has no other text, and never a part of a sentence.

Defined results: null and empty pages give an empty text; cut-off pages are read as far as they go; whole pages are
read, whatever their length; null ids are carried along, ties and repeated rows are read once for each row, empty tables
give empty results, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
LINK_SHARE = 0.6

# Element names, class and id words, and roles.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices popup modal overlay newsletter subscribe signup "
    "social share sharing related recommended comment comments disqus replies respond pagination pager widget copyright login".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
NEUTRAL = frozenset(
    "area articles bar block bottom box button buttons container content fixed global icon icons inline inner item items left link links "
    "list main news outer page post posts primary right secondary section site slot sticky stories text top unit wrap wrapper".split()
)
PLAIN = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
FLOW = frozenset("p li blockquote pre td th tr tbody dt dd figcaption summary".split())
SENTENCE_ENDS = tuple(".!?…")
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
ABOUT = frozenset("has no non not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BY_TAG, BY_WORD, BY_COMMENT_WORD, BY_COMMENT_NAME = 1, 2, 3, 4

_UNSEEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)(?:>|\Z)")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


def _names_comments(attributes: str) -> bool:
    """Whether a class or id consists of comment words and neutral ones."""
    for name, *values in _NAMES.findall(attributes):
        if name.lower() != "role":
            for part in "".join(values).lower().split():
                words = set(_WORD.findall(part))
                if words & COMMENTS and words <= COMMENTS | NEUTRAL:
                    return True
    return False


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if attributes and tag not in ("html", "body", "main") and tag not in FLOW and tag not in HEADINGS and _names_comments(attributes):
        return BY_COMMENT_NAME
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return BY_TAG
    if tag in PLAIN or tag == "header" or not attributes or in_article and tag in FLOW:
        return 0
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role":
            words = set(_WORD.findall(value))
            found = words & ROLES
        else:
            # "content-with-sidebar", "no-ads": what follows tells about the page, not about the element
            names = [set(takewhile(lambda w: w not in ABOUT, _WORD.findall(part))) for part in value.split()]
            if in_article:
                names = [x - {"header"} for x in names if x <= WORDS | NEUTRAL]
            found = set().union(*names) & WORDS
        if found:
            return BY_COMMENT_WORD if found & COMMENTS else BY_WORD
    return 0


def _voided(marks: list[tuple[int, int]], held: list[tuple[int, int]]) -> list[bool]:
    """Which elements with a listed class, id or role weigh nothing: those inside another such element, and those with
    at most half of the page's unlinked text.  Reader comments don't count, unless there is hardly any other text.

    ``marks`` has each element's kind and the one around it (-1: none), ``held`` an element and its unlinked text.
    """
    comment = [kind >= BY_COMMENT_WORD for kind, _ in marks]
    for i, (_, around) in enumerate(marks):
        comment[i] |= around >= 0 and comment[around]
    own = sum(size for i, size in held if i < 0 or not comment[i])
    if own < SURGE:
        comment, own = [False] * len(marks), sum(size for _, size in held)
    sizes = [0] * len(marks)
    for i, size in held:
        if i >= 0 and not comment[i]:
            sizes[i] += size
    for i in range(len(marks) - 1, -1, -1):
        if marks[i][1] >= 0:
            sizes[marks[i][1]] += sizes[i]
    void = [2 * size <= own for size in sizes]
    for i, (_, around) in enumerate(marks):
        void[i] |= around >= 0 and void[around]
    return void


class Line(NamedTuple):
    """A block's text, its weight, whether an article holds it, whether it is a heading, and the elements that hold it
    (numbers, the innermost last; paragraphs, headings and the like don't count)."""

    text: str
    weight: int
    inside: bool
    heading: bool
    holders: tuple[int, ...]


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order."""
    page = _UNSEEN.sub(" ", page)
    out: list[tuple] = []  # text, can be main text, in an article, mark around it, unlinked text, prose, heading, holders
    holders: list[tuple[str, int]] = []  # the containers that are open: name and number
    containers = 0
    runs: list[str] = []
    links = length = quiet = in_article = in_link = 0
    block = ""  # the block that the line began with
    inline, inline_depth, inline_blocks = "", 0, 0  # the listed inline element that is open, how many of its name are, and blocks within it
    skip, depth, within = "", 0, 0  # the boilerplate element that is open, how many of its name are, and the marks around it
    marks: list[tuple[int, int]] = []  # elements with a listed word: kind and the mark around it
    opened: list[list] = []  # those that are open: name, how many of the name are, number of the mark
    by_name: dict[str, list[list]] = {}

    def flush() -> None:
        nonlocal runs, links, length, quiet
        text = " ".join("".join(runs).split())
        if text:
            linked = not in_article and links > LINK_SHARE * max(length, 1)
            void = bool(skip) or quiet == length
            prose = block == "p" and text.endswith(SENTENCE_ENDS) and text.count(" ") > 1
            around = holders[:-1] if holders and holders[-1][0] == block else holders  # a container's own text stands in what holds it
            mark = opened[-1][2] if opened else -1
            out.append((text, not void and not linked, in_article > 0, mark, 0 if void else length - links, prose, block in HEADINGS, tuple(n for _, n in around)))
        runs, links, length, quiet = [], 0, 0, 0

    def say(raw: str) -> None:
        nonlocal links, length, quiet
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            runs.append(text)
            size = len("".join(text.split()))
            length += size
            links += size * (in_link > 0)
            quiet += size * (inline != "")

    def leave() -> list:
        nonlocal skip, depth
        mark = opened.pop()
        by_name[mark[0]].pop()
        if skip and within > len(opened):
            skip, depth = "", 0
        return mark

    at = 0
    for m in _TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            runs.append(" ")
        kind = 0 if closing or tag in EMPTY or attributes.endswith("/") else _kind(tag, attributes, in_article > 0)
        if tag not in BLOCKS and tag not in BOILERPLATE:
            if inline:
                inline_depth += (tag == inline) * (-1 if closing else 1)
                if not inline_depth:
                    inline = ""
            elif kind:
                inline, inline_depth, inline_blocks = tag, 1, 0
            continue
        if inline:
            inline_blocks += -1 if closing else tag not in EMPTY
            if inline_blocks < 0:
                inline = ""
        same = by_name.get(tag)
        remarks = any(marks[mark[2]][0] == BY_COMMENT_NAME for mark in opened)
        flush()
        block = "" if closing else tag
        if tag not in FLOW and tag not in HEADINGS and tag not in EMPTY and not attributes.endswith("/"):
            if not closing:
                containers += 1
                holders.append((tag, containers))
            elif any(name == tag for name, _ in holders):
                while holders.pop()[0] != tag:
                    pass
        if closing:
            if skip == tag:
                depth -= 1
                if not depth:
                    skip = ""
            if same:
                same[-1][1] -= 1
                if not same[-1][1]:
                    mark = same[-1]
                    while leave() is not mark:
                        pass
            if tag in ("article", "main") and in_article and not remarks:
                in_article -= 1
            continue
        if tag in ("article", "main") and not remarks and kind != BY_COMMENT_NAME:
            in_article += 1
            while opened:
                leave()
            skip, depth, inline = "", 0, ""
            same = None
        else:
            while opened and opened[-1][0] in ("p", "li"):
                leave()
            same = by_name.get(tag)
        whole = not attributes.endswith("/")
        if same:
            same[-1][1] += whole
        if skip:
            depth += skip == tag and whole
        elif kind == BY_TAG:
            skip, depth, within = tag, 1, len(opened)
        elif kind:
            marks.append((kind, opened[-1][2] if opened else -1))
            opened.append([tag, 1, len(marks) - 1])
            if same:
                same[-1][1] -= 1
            by_name.setdefault(tag, []).append(opened[-1])
    say(page[at:])
    flush()
    void = _voided(marks, [(x[3], x[4]) for x in out])
    return [
        Line(text, (len(text) + SURGE * prose) * (good and (i < 0 or not void[i])), inside, heading, around)
        for text, good, inside, i, _, prose, heading, around in out
    ]


def _surges(weight: list[int], threshold: int) -> Iterator[range]:
    """Lines between a surge and its dive, back to the last empty window."""
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    at = 0
    while at < len(weight):
        end = at
        while end < len(weight) and sums[end]:
            end += 1
        if end > at and max(sums[at:end]) >= threshold:
            yield range(at, end)
        at = end + 1


def main_text(page: str) -> str:
    lines = lines_of(page)
    outside = [x.weight * (not x.inside) for x in lines]
    kept = {i for i, x in enumerate(lines) if x.inside and x.weight}
    # without an article the fullest window surges, however small
    largest = max((sum(outside[i : i + WINDOW]) for i in range(len(lines))), default=0)
    threshold = SURGE if kept else max(1, min(SURGE, largest))
    kept |= {i for at in _surges(outside, threshold) for i in at if outside[i]}
    own = {x.holders[-1] if x.holders else 0 for i, x in enumerate(lines) if i in kept}
    above = {0}.union(*(lines[i].holders for i in kept))
    for i, x in enumerate(lines):
        if x.weight and (x.holders[-1] if x.holders else 0) in (above if x.heading else own):
            kept.add(i)
    return "\n".join(x.text for i, x in enumerate(lines) if i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

A page is read once into blocks: pieces of text that no block-level tag
interrupts, each with its path of elements from the root. Per path, the text
length and punctuation of its blocks are set against their number, fused with
the share of linked text and with what elements say of themselves (``nav``,
``class="comments"``, ``article``), and smoothed along the page between paths
that lie close in the tree. Paths above a share of the best one are content;
the smallest element around them is the article, and all its blocks that are
no furniture belong to the text, short ones and headings too.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A path is content from this share of the best path's score on.
LEAST_SHARE = 0.3
# Among content, a block with more linked text than this is none.
MOST_LINKED = 0.7
# What a path outside of declared content counts, where a page declares some.
UNDECLARED = 0.001
# Blocks before and after that smooth a block's score, and the fall-off by steps in the tree.
REACH, STEPS = 2, 2.0

_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)"""
)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*+:\s*+none", re.I)
_SENTENCE = re.compile(r"[.,;:!?…。、，！？؟،]")

_set = lambda words: frozenset(words.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
INLINE = _set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd link mark meta param q rp rt"
    " ruby s samp small source span strike strong sub sup time track tt u var wbr"
)
FURNITURE_TAGS = _set(
    "nav footer aside form menu dialog noscript template svg math button select option datalist object applet audio"
    " video canvas map head frameset"
)
FURNITURE_ROLES = _set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar")
FURNITURE_NAMES = _set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising sponsor"
    " sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe share"
    " sharing social comment comments disqus reply replies respond footer header masthead related recommended widget"
    " toolbar pagination pager login signup search skip form"
)
CONTENT_NAMES = _set("article post entry story content title headline")
DECLARED_TAGS = _set("article main")
# A tag that opens ends these of its own list or table.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",),
    "thead": ("tr", "thead", "tbody"), "tbody": ("tr", "thead", "tbody"), "tfoot": ("tr", "thead", "tbody"),
}
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
TEXT_TAGS = HEADINGS | _set("p pre blockquote li dt dd ul ol dl figure figcaption caption tr td th tbody table")
LISTS, CELLS = _set("ul ol dl table"), _set("table td th button")
TABLE = _set("table thead tbody tfoot tr td th button")


class _Element:
    __slots__ = ("tag", "parent", "path", "furniture", "declared", "declares")

    def __init__(self, tag, parent, path, furniture, declares):
        self.tag, self.parent, self.path = tag, parent, path
        self.furniture, self.declares = furniture, declares
        # Whether the element lies in one that declares to hold the content.
        self.declared = declares or (parent is not None and parent.declared)


class _Open:
    """The open block elements. Inline elements end no block and are not kept.

    Counts per list and per table cell say whether an element is open before
    it is looked for, so that looking costs what it closes.
    """

    def __init__(self):
        self.stack = [_Element("", None, _Path(), False, False)]
        self.counts, self.lists, self.cells = Counter(), [Counter()], [Counter()]

    def push(self, element: _Element) -> None:
        tag = element.tag
        self.stack.append(element)
        for counts in (self.counts, self.lists[-1], self.cells[-1]):
            counts[tag] += 1
        if tag in LISTS:
            self.lists.append(Counter())
        if tag in CELLS:
            self.cells.append(Counter())

    def close(self, tag: str, counts: Counter) -> None:
        """Ends the innermost element of a tag, if ``counts`` knows one, and all in it."""
        if not counts[tag]:
            return
        found = ""
        while found != tag:
            found = self.stack.pop().tag
            if found in LISTS:
                self.lists.pop()
            if found in CELLS:
                self.cells.pop()
            for kept in (self.counts, self.lists[-1], self.cells[-1]):
                kept[found] -= 1


class _Path:
    """A path of labels from the root; equal paths of a page are one object."""

    __slots__ = ("parent", "depth", "below", "n", "chars", "marks", "linked", "weight")

    def __init__(self, parent=None):
        self.parent, self.below = parent, {}
        self.depth = parent.depth + 1 if parent else 0
        self.n = self.chars = self.marks = self.linked = 0
        self.weight = 0.0


def _traits(tag: str, said: str, parent: _Element) -> tuple[str, bool, bool]:
    """Label in the path, whether the element is furniture, whether it declares content."""
    furniture, declares, label = parent.furniture, tag in DECLARED_TAGS, tag
    if tag in FURNITURE_TAGS or (tag == "header" and not parent.declared):
        furniture = True
    if said and not said.isspace():
        names: set[str] = set()
        for name, value in _ATTRIBUTE.findall(said):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                label += "." + value
                names.update(w.lower() for w in _TOKEN.findall(value))
            elif name == "role":
                furniture |= value.lower() in FURNITURE_ROLES
                declares |= value.lower() == "main"
            elif name == "itemprop":
                declares |= value == "articleBody"
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                furniture = True
            elif name == "style" and _HIDDEN.search(value):
                furniture = True
        if tag not in ("html", "body", "article", "main") or names & {"comment", "comments"}:
            hits = names & FURNITURE_NAMES
            # The headline of an article may stand in its header.
            furniture |= bool(hits - {"header"} if names & CONTENT_NAMES else hits)
    return label, furniture, declares


def read_blocks(page: str) -> list[tuple[str, int, _Element]]:
    """``(raw text, linked characters, element)`` of each block, in page order."""
    tree, blocks = _Open(), []
    stack = tree.stack
    text: list[str] = []
    linked, link = 0, False
    low, at, tags = page.lower(), 0, _TAG
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            start = len(page)
        if start > at:
            text.append(page[at:start])
            linked += start - at if link else 0
        if start == len(page):
            break
        after = page[start + 1 : start + 2]
        if after in ("!", "?") or (after == "/" and not page[start + 2 : start + 3].isalpha()):
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            at = len(page) if end < 0 else end + len(mark)
            continue
        if after != "/" and not (after.isascii() and after.isalpha()):
            text.append("<")
            at = start + 1
            continue
        m = tags.match(page, start)
        if m is None:
            # A quote that never ends: from here on a tag ends at its first ">".
            tags = _PLAIN_TAG
            m = tags.match(page, start)
            if m is None:
                break
        at = m.end()
        tag, opens = m[2].lower(), not m[1]
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = opens
            continue
        if text:
            blocks.append(("".join(text), linked, stack[-1]))
            text, linked = [], 0
        if not opens:
            tree.close(tag, tree.counts if tag in TABLE else tree.cells[-1])
            continue
        if tag in RAW:
            end = low.find("</" + tag, at)
            end = page.find(">", end) if end >= 0 else -1
            at = len(page) if end < 0 else end + 1
            continue
        tree.close("p", tree.cells[-1])
        for ended in CLOSES.get(tag, ()):
            tree.close(ended, tree.lists[-1])
        if tag in VOID:
            continue
        parent = stack[-1]
        label, furniture, declares = _traits(tag, m[3], parent)
        path = parent.path.below.get(label)
        if path is None:
            path = parent.path.below[label] = _Path(parent.path)
        tree.push(_Element(tag, parent, path, furniture, declares))
    if text:
        blocks.append(("".join(text), linked, stack[-1]))
    return blocks


def _apart(a: _Path, b: _Path) -> int:
    """Steps from one path to the other through the tree, at most ``4 * STEPS``."""
    steps = 0
    while a is not b and steps < 4 * STEPS:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def _around(elements: list[_Element]) -> _Element:
    """The innermost element around all of these."""
    below: dict[_Element, set[_Element]] = {}
    for e in elements:
        while e.parent is not None:
            beside = below.setdefault(e.parent, set())
            known = bool(beside)
            beside.add(e)
            e = e.parent
            if known:
                break
    wanted = set(elements)
    while e.parent is not None:
        e = e.parent
    while e not in wanted and len(below[e]) == 1:
        (e,) = below[e]
    return e


def _inside(element: _Element, known: dict[_Element, bool]) -> bool:
    """Whether an element lies in the one that ``known`` maps to true; answers are kept there."""
    trail = []
    while element is not None and element not in known:
        trail.append(element)
        element = element.parent
    answer = element is not None and known[element]
    known.update(dict.fromkeys(trail, answer))
    return answer


def main_blocks(page: str) -> list[str]:
    """Blocks of the main text of a page, in page order."""
    blocks = []
    for raw, linked, element in read_blocks(page):
        said = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if said and not element.furniture:
            blocks.append((said, min(1.0, linked / len(raw)), element))
    if not blocks:
        return []
    declared = any(e.declared for _, _, e in blocks)
    paths: dict[_Path, list[bool]] = {}
    for said, linked, e in blocks:
        p = e.path
        p.n += 1
        p.chars += len(said)
        p.marks += len(_SENTENCE.findall(said))
        p.linked += linked * len(said)
        paths.setdefault(p, []).append(e.declared)
    for p, inside in paths.items():
        p.weight = p.chars / p.n * (1 + p.marks / p.n) * (1 - p.linked / p.chars) ** 2
        if declared and not any(inside):
            p.weight *= UNDECLARED
    order = [e.path for _, _, e in blocks]
    smooth: dict[_Path, list[float]] = {}
    for i, p in enumerate(order):
        total = share = 0.0
        for q in order[max(0, i - REACH) : i + REACH + 1]:
            w = math.exp(-((_apart(p, q) / STEPS) ** 2) / 2)
            total, share = total + w * q.weight, share + w
        smooth.setdefault(p, []).append(total / share)
    # Furniture by its ratio stays so beside a long text: smoothing lifts a path at most to its double.
    score = {p: min(sum(v) / len(v), 2 * p.weight) for p, v in smooth.items()}
    best = max(score.values())
    chosen = [i for i, p in enumerate(order) if score[p] >= LEAST_SHARE * best]
    top = _around([blocks[i][2] for i in chosen])
    # The article is a container, and where one is declared, that one.
    while top.parent is not None and (not top.declares if top.declared else top.tag in TEXT_TAGS):
        top = top.parent
    # Where nothing is declared: what stands from the title to the last content, and what
    # goes on behind it close by in the tree (a list, a last quotation).
    first, last, known, out = chosen[0], chosen[-1], {top: True}, []
    titles = [i for i in range(first) if blocks[i][2].tag == "h1" and _inside(blocks[i][2], known)]
    if titles:
        first = titles[-1]
    while first and blocks[first - 1][2].tag in HEADINGS:
        first -= 1
    for i, (said, linked, e) in enumerate(blocks):
        between = first <= i <= last and linked <= MOST_LINKED
        on = i == last + 1 and linked <= MOST_LINKED and e.tag in TEXT_TAGS and _apart(e.path, order[last]) <= 2 * STEPS
        wanted = top.declared or score[e.path] >= LEAST_SHARE * best or between or on
        last += on
        if wanted and _inside(e, known):
            out.append(said)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *rest, pages = (batch.column(i) for i in range(batch.num_columns))
        texts = ["\n".join(main_blocks(page)) if page else "" for page in pages.to_pylist()]
        columns = [*rest, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text", "n_chars"])


def main_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns ``keep``, the main ``text`` of each page, and ``n_chars``, its code points.

    One row per row of ``pages``, no shuffle. Character references are
    decoded; white space inside a block (as Unicode defines it, and ``<br>``)
    becomes one space; blocks are joined by one line feed. A null or empty page
    and one of furniture alone have an empty text. Null and repeated keys are
    kept as they are; other columns are not read, so they may have any name.
    """
    rows = pages.select(*keep, F.col(page).cast("string").alias("_page"))
    fields = pages.select(*keep).schema.fields
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(_extract, schema)

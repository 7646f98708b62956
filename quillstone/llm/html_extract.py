"""Main-text extraction by tag-path ratios.

A page is read into text blocks, each with the tag path from the root to its element (tag names with classes). For every
path the text length and the punctuation of all its blocks are added up; their ratios to the path's number of blocks are
fused, damped by the share of link text, smoothed along the page with a Gaussian and compared with a threshold from their
spread. Names of classes, ids and roles that are made of layout words only ("sidebar", "cookie-notice") take a path's score
away; they are one input of the score, no switch of their own. The blocks of the paths above the threshold mark the content;
the element that holds most of it is the content node. In it, blocks stay whose path's score is not next to nothing (menus,
marked parts), so that headings and short paragraphs stay.

Reading takes steps in proportion to the page, however deep or broken it is: elements know their nearest ancestors of the
kinds that start tags end, paths are hashed step by step, and weights are added up from the last element to the first.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import bounded_batches, slices

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--|!\[CDATA\[|[!?/]))")
_REST = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text; the first ones hold no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form noscript template svg math object canvas select button menu dialog audio video map datalist fieldset label".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends, up to the nearest of the elements after it; and the group of elements that are looked at for it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}, 1), "dt": ({"dt", "dd"}, {"dl"}, 2), "dd": ({"dt", "dd"}, {"dl"}, 2), "tr": ({"tr", "td", "th"}, {"table"}, 3),
    "td": ({"td", "th"}, {"table", "tr"}, 3), "th": ({"td", "th"}, {"table", "tr"}, 3), "option": ({"option"}, {"select"}, 4),
}
#: Elements of each group; the first one's are those up to which a block ends an open paragraph.
GROUPS = [{"p", "table", "td", "th", "button"}, *[{t for same, outer, k in ENDS.values() if k == g for t in same | outer} for g in (1, 2, 3, 4)]]
#: Words in names of classes, ids and roles that mark boilerplate if the rest of the name is such words or layout words.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar sidenav menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments commentlist reply replies respond disqus discussion notice notices cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination pager login search "
    "skip masthead copyright alert toast overlay teaser outbrain taboola contentinfo complementary dialog feedback".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons card cell center col column container content desktop fixed form global group header heading holder "
    "icon icons inline inner item items js left line link links list main message mobile page panel post posts primary reader readers region right row "
    "secondary section short site slot small sticky tag tags text title top unit user users view wp wrap wrapper".split()
)
CONTENT = frozenset(("article", "main"))
#: Elements that can hold an article; of others the one around them does.
HOLDERS = CONTENT | frozenset("body center div html section td th".split())
#: Width of the smoothing, in blocks; share of the best score below which a block of the content node goes; share of the
#: marked text from which an article element is the content node; share of link text that makes a path a menu.
WIDTH, LEAST, MOST, MENU = 1.0, 0.004, 0.5, 0.9
#: Pages read at a time.
ROWS = 64


class Element:
    __slots__ = ("tag", "path", "parent", "dropped", "marked", "inside", "block", "near", "depth", "weight", "kept")

    def __init__(self, tag: str, key: str, parent: Element | None, dropped: bool, marked: bool):
        up = parent
        self.tag, self.parent, self.path = tag, parent, hash((up.path, key)) if up else 0
        self.dropped, self.marked = dropped, marked or bool(up and up.marked)
        self.inside = tag in CONTENT or bool(up and up.inside)
        self.block = self if tag in BLOCKS or up is None else up.block
        self.near = tuple(self if tag in g else n for g, n in zip(GROUPS, up.near)) if up else (None,) * len(GROUPS)
        self.depth, self.weight, self.kept = up.depth + 1 if up else 0, 0.0, False


def _named(value: str) -> bool:
    """Whether one of these names is made of boilerplate and layout words."""
    for name in value.split():
        words = [t.lower() for t in _TOKEN.findall(name) if len(t) > 1]
        if all(t in BOILERPLATE or t in LAYOUT for t in words) and any(t in BOILERPLATE for t in words):
            return True
    return False


def _read(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is hidden, whether its names mark it as boilerplate, and its classes as part of the path."""
    hidden, marked, shown = False, False, ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            hidden = True
        elif name in ("class", "id", "role"):
            shown += "." + re.sub(r"\d+", "", value)
            marked |= tag not in ("html", "body", "main") and _named(value)
    return hidden, marked, shown


Block = tuple[str, int, Element]


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks in page order: (text, characters of it that are link text, innermost block element); all elements."""
    root = Element("", "", None, False, False)
    stack, elements, out, text, links, at = [root], [root], [], [], 0, 0
    count: dict[str, int] = {}  # open elements of each tag
    last, unclosed = page.rfind(">"), False

    def flush():
        nonlocal links
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((words, min(links, len(words)), stack[-1].block))
            text.clear()
            links = 0

    def add(raw: str):
        nonlocal links
        if raw and not stack[-1].dropped:
            text.append(raw)
            if any(e.tag == "a" for e in stack[-4:]):
                links += len(raw.strip())

    def close(index: int):
        if any(e.tag in BLOCKS for e in stack[index:]):
            flush()
        for e in stack[index:]:
            count[e.tag] -= 1
        del stack[index:]

    while m := _OPEN.search(page, at):
        if m.end() > last and m[3] != "!--":
            break  # no tag ends any more: the rest is text
        add(page[at : m.start()])
        if m[3]:
            end = -1
            if m[3] == "!--":
                end = page.find("-->", m.end() - 2)
                at = end + 3 if end >= 0 else len(page)
                continue
            if m[3] == "![CDATA[" and not unclosed:
                end = page.find("]]>", m.end())
                unclosed = end < 0
            if end >= 0:
                add(entities.escape(page[m.end() : end]))
                at = end + 3
            else:
                at = page.find(">", m.end()) + 1
            continue
        tag = m[2].lower()
        rest = _REST.match(page, m.end())
        at = rest.end() if rest else page.find(">", m.end()) + 1
        attributes = page[m.end() : at - 1]
        if m[1]:
            if count.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            add(" ")
            continue
        if tag in VOID:
            flush() if tag == "hr" else add(" ")
            continue
        if tag in BLOCKS:
            p = stack[-1].near[0]
            if p is not None and p.tag == "p":
                close(p.depth)
            flush()
        if tag in ENDS:
            same, outer, group = ENDS[tag]
            found, e = None, stack[-1].near[group]
            while e is not None and e.tag not in outer:
                found = e if e.tag in same else found
                e = e.parent.near[group]
            if found is not None:
                close(found.depth)
        if count.get("head") and (tag == "body" or (tag in BLOCKS and tag not in ("head", "html"))):
            close(next(i for i, e in enumerate(stack) if e.tag == "head"))
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        up = stack[-1]
        hidden, marked, classes = _read(tag, attributes)
        e = Element(tag, tag + classes, up, up.dropped or hidden or tag in DROPPED or (tag == "header" and not up.inside), marked)
        stack.append(e), elements.append(e)
        count[tag] = count.get(tag, 0) + 1
    add(page[at:])
    flush()
    return out, elements


def ratios(found: list[Block]) -> np.ndarray:
    """The score of each block: its path's ratio, smoothed along the page."""
    paths: dict[int, list[float]] = {}
    keys = [e.path for *_, e in found]
    for key, (text, link, _) in zip(keys, found):
        s = paths.setdefault(key, [0.0, 0.0, 0.0, 0.0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += link
        s[3] += 1
    fused = {k: (1 - link / length) * math.log1p(length / n) * (1 + math.log1p(marks / n)) * math.log1p(length) for k, (length, marks, link, n) in paths.items()}
    r = np.array([fused[k] for k in keys])
    reach = math.ceil(2 * WIDTH)
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * WIDTH * WIDTH))
    near = np.convolve(np.pad(r, reach, mode="edge"), weights / weights.sum(), "valid")
    smooth: dict[int, list[float]] = {}
    for k, v in zip(keys, near):
        smooth.setdefault(k, []).append(v)
    menu = {k for k, (length, _, link, n) in paths.items() if n > 1 and link >= MENU * length}
    score = {k: 0.0 if k in menu else (fused[k] + sum(v) / len(v)) / 2 for k, v in smooth.items()}
    return np.array([0.0 if e.marked else score[e.path] for *_, e in found])


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by newlines; empty if it has none."""
    found, elements = blocks(page or "")
    found = [b for b in found if not b[2].dropped]
    if not found:
        return ""
    score = ratios(found)
    chosen = score >= min(score.max(), max(score.mean() - score.std(), 0.35 * score.max()))
    for (text, link, e), picked in zip(found, chosen):
        e.weight += picked * (len(text) - link)
    for e in reversed(elements[1:]):
        e.parent.weight += e.weight
    total = elements[0].weight
    # the article element with most of the content; of those with as much, the innermost, which is the last
    best = max(((e.weight, k) for k, e in enumerate(elements) if e.tag in CONTENT and not e.marked), default=(0, 0))
    heading = -1
    if total and best[0] >= MOST * total:
        node = elements[best[1]]
        for e in elements:  # and its like beside it
            e.kept = e.parent is not None and (e.parent.kept or (e.parent is node.parent and e.tag == node.tag))
    else:
        # without one: the innermost holder of all chosen blocks, and the heading before the first of them
        node = elements[0]
        for e in elements[1:]:
            if e.parent is node and total and e.weight == total:
                node = e
        while node.parent is not None and node.tag not in HOLDERS:
            node = node.parent
        for e in elements:
            e.kept = e is node or (e.parent is not None and e.parent.kept)
        first = int(np.flatnonzero(chosen)[0])
        heading = max((i for i in range(first) if found[i][2].tag in ("h1", "h2", "h3") and score[i] > 0), default=-1)
    stays = score >= LEAST * score.max()
    return "\n".join(text for i, (text, _, e) in enumerate(found) if i == heading or (e.kept and stays[i]))


def extract(df: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``df`` with the main text of column ``html`` in ``name`` and its code points in n_chars, without the column ``html``.

    Null and empty pages have an empty text. Columns named like the new ones are replaced, others pass through; repeated
    rows give repeated rows; an empty table gives an empty table. Pages are read whole, whatever their length.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (html, name, "n_chars")]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(name, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in slices(batches, ROWS):
            texts = [main_text(p) for p in b.column(len(kept)).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), sizes], names=[*kept, name, "n_chars"])

    return source.mapInArrow(run, schema)

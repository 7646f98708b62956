"""Chunks of a Markdown document: sections whole where they fit, else greedily packed blocks, else split blocks.

Everything that is packed (items of a list, rows of a table, blocks of a quote, of a section, sibling sections) is packed
by the same rule: in order, as many as fit; one that alone is too large stands apart and is split by its own kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Protocol

from .blocks import parse
from .nodes import Node, content_size, from_units, plain_text, root, units
from .normalise import preprocess
from .options import Options
from .sections import flatten, hierarchy, is_section, section_size
from .serialise import serialise
from .textsplit import SPACE, plain_list, plain_paragraph, split_plain, split_text

_EDGES = re.compile(rf"\A[{SPACE}]+|[{SPACE}]+\Z")
BLANK = frozenset("\t\n\v\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B))))


def trim(text: str) -> str:
    """``text`` without white space around it, as ECMAScript sees white space."""
    return _EDGES.sub("", text)


def cap(text: str, most: int) -> list[str]:
    """``text`` (as UTF-16 units) in pieces of at most ``most``, cut at the last white space in the final fifth of a piece if
    there is any. A character of two units is not cut in two."""
    if most < 1:
        raise ValueError("the limit must be 1 or more")
    out, start, end = [], 0, len(text)
    while end - start > most:
        cut = next((i for i in range(start + most - 1, start + int(most * 0.8) - 1, -1) if text[i] in BLANK), None)
        spaced = cut is not None
        if not spaced:
            cut = start + most
            if "\ud800" <= text[cut - 1] <= "\udbff" and "\udc00" <= text[cut] <= "\udfff":
                cut = cut - 1 if most > 1 else cut + 1
        if piece := trim(text[start:cut]):
            out.append(piece)
        start = cut
        if spaced:  # what is left is trimmed at both ends
            while start < end and text[start] in BLANK:
                start += 1
            while end > start and text[end - 1] in BLANK:
                end -= 1
    return [*out, text[start:end]] if end > start else out


def cap_all(texts: list[str], most: int) -> list[str]:
    """``cap`` over a list; texts within the limit, empty ones too, stay as they are."""
    return [p for t in texts for p in ([t] if len(t) <= most else cap(t, most))]


def packed(items: list, size: Callable, limit: float) -> Iterator[tuple[list, bool]]:
    """Runs of items that fit together, in order, and (with True) single items that do not fit at all."""
    run, total = [], 0
    for item in items:
        n = size(item)
        if run and total + n > limit:
            yield run, False
            run, total = [], 0
        if n > limit:
            yield [item], True
        else:
            run.append(item)
            total += n
    if run:
        yield run, False


#: Kinds of blocks that have a way of their own to be split; all others are split as text.
ELEMENTS = ("list", "table", "blockquote", "code")


class NodeSplitter(Protocol):
    """How blocks of one kind are split: called with a block that is above the limit and the ``Splitter`` at work (its
    ``options``, ``limit``, and ``split`` and ``pieces`` for what the block holds); gives the nodes it falls into, in order.
    A node that is still above the limit stays so. It runs on workers, so it must be picklable."""

    def __call__(self, node: Node, splitter: Splitter) -> Iterable[Node]: ...


class Splitter:
    """Splits trees under one set of options. Results are root nodes whose ``crumbs`` are the headings above them.
    ``own`` maps kinds of blocks to splitters that are used instead of the ones here."""

    def __init__(self, options: Options, own: Mapping[str, NodeSplitter] | None = None):
        self.options, self.limit, self.own = options, options.limit, own or {}

    def pieces(self, node: Node) -> list[Node]:
        """The parts of one block by the splitter of its kind; a block that fits is its only part."""
        if content_size(node) <= self.limit:
            return [node]
        if node.type in self.own:
            return list(self.own[node.type](node, self))
        return getattr(self, "_" + node.type)(node) if node.type in ELEMENTS else self._text(node)

    def element(self, kind: str, text: str) -> list[str]:
        """The pieces of a text whose first block is of this kind (list, table, blockquote or code)."""
        blocks = parse(units(text)).children
        if kind not in ELEMENTS or not blocks or blocks[0].type != kind:
            raise ValueError(f"the text is no {kind}")
        return [from_units(m) for n in getattr(self, "_" + kind)(blocks[0]) if (m := trim(serialise(n)))]

    # -- sections

    def split(self, blocks: list[Node]) -> list[Node]:
        out: list[Node] = []
        for section in hierarchy(blocks):
            if section_size(section) <= self.limit:
                out.append(self._chunk([section], ()))
            else:
                out += self._section(section, ())
        return out

    @staticmethod
    def _chunk(nodes: list[Node], crumbs: tuple) -> Node:
        made = root(flatten(nodes))
        made.crumbs = crumbs
        return made

    def _section(self, section: Node, crumbs: tuple) -> Iterator[Node]:
        """A section that does not fit: its own content with as many of the first subsections as fit, or by itself in
        pieces; then the other subsections."""
        below = (*crumbs, section.heading) if section.heading else crumbs
        own = [c for c in section.children if not is_section(c)]
        kids = [c for c in section.children if is_section(c)]
        total = (content_size(section.heading) if section.heading else 0) + sum(map(content_size, own))
        taken = 0
        if total <= self.limit:
            while taken < len(kids) and total + section_size(kids[taken]) <= self.limit:
                total += section_size(kids[taken])
                taken += 1
        if taken:
            head = [section.heading] if section.heading else []
            yield self._chunk([*head, *own, *kids[:taken]], crumbs)
        else:
            yield from self._blocks(section.heading, own, crumbs, below)
        yield from self._siblings(kids[taken:], below)

    def _siblings(self, sections: list[Node], crumbs: tuple) -> Iterator[Node]:
        for run, large in packed(sections, section_size, self.limit):
            if large:
                yield from self._section(run[0], crumbs)
            else:
                yield self._chunk(run, crumbs)

    def _blocks(self, heading: Node | None, blocks: list[Node], crumbs: tuple, below: tuple) -> Iterator[Node]:
        """Heading and blocks of one section. A chunk that holds the heading has only those above it as crumbs."""
        if heading is not None:
            if not blocks:
                yield from self._block(heading, crumbs)
                return
            if content_size(heading) > self.limit:
                if self.options.splittable("heading", lambda: content_size(heading)):
                    yield from self._block(heading, crumbs)
                else:
                    yield self._chunk([heading], crumbs)
                heading = None
        for run, large in packed([*([heading] if heading is not None else []), *blocks], content_size, self.limit):
            if large:
                yield from self._block(run[0], below)
            else:
                yield self._chunk(run, crumbs if run[0] is heading else below)

    def _block(self, node: Node, crumbs: tuple) -> Iterator[Node]:
        for part in self.pieces(node):
            made = part.copy() if part.type == "root" else root([part])
            made.crumbs = crumbs
            yield made

    # -- blocks that do not fit

    def _text(self, node: Node) -> list[Node]:
        """Scored text splitting; the pieces are Markdown already and are kept as they are."""
        return [root([Node("html", value=piece)]) for piece in split_text(node, self.options)]

    def _whole(self, node: Node) -> bool:
        return not self.options.splittable(node.type, lambda: content_size(node))

    def _list(self, node: Node) -> list[Node]:
        """Lists of items that fit, numbered on; of an item that does not, the first piece stays an item."""
        if self._whole(node):
            return [node]
        out: list[Node] = []
        number, done = node.first or 1, 0
        for run, large in packed(node.children, content_size, self.limit):
            part = node.copy(children=run, first=number + done if node.ordered else node.first)
            done += len(run)
            if not large:
                out.append(part)
                continue
            for i, piece in enumerate(self.split(run[0].children)):
                if piece.children:
                    out.append(piece if i else part.copy(children=[run[0].copy(children=piece.children)]))
        return out

    def _table(self, node: Node) -> list[Node]:
        """Tables of rows that fit, each under the header row; a row that does not, as a table for each of its cells."""
        if self._whole(node) or not node.children:
            return [node] if node.children else []
        head, *rows = node.children
        out: list[Node] = []
        for run, large in packed(rows, content_size, self.limit):
            if not large:
                out.append(node.copy(children=[head, *run]))
                continue
            for i, cell in enumerate(run[0].children):
                title = Node("tableRow", head.children[i : i + 1])
                small = content_size(cell) <= self.limit
                contents = [cell.children] if small else [p.children for p in self.split(cell.children) if p.children]
                out += [node.copy(children=[title, Node("tableRow", [cell.copy(children=c)])]) for c in contents]
        return out

    def _blockquote(self, node: Node) -> list[Node]:
        """Quotes of blocks that fit; of a block that does not, a quote for each piece."""
        if self._whole(node):
            return [node]
        out: list[Node] = []
        for run, large in packed(node.children, content_size, self.limit):
            if large:
                out += [node.copy(children=p.children) for p in self.split(run) if p.children]
            else:
                out.append(node.copy(children=run))
        return out

    def _code(self, node: Node) -> list[Node]:
        return [node] if self._whole(node) else self._text(node)


def parsed(text: str, options: Options) -> Node:
    return preprocess(parse(units(text)), options)


def chunks(text: str | None, options: Options, own: Mapping[str, NodeSplitter] | None = None) -> list[tuple[str, list[tuple[str, int]]]]:
    """(chunk, breadcrumbs as (heading text, depth)) of a document, in order; null and blank ones have none."""
    if not text:
        return []
    out = []
    for markdown, headings in whole_chunks(units(text), options, own=own):
        crumbs = [(from_units(plain_text(h)), h.depth) for h in headings]
        pieces = cap(markdown, options.max_raw_size) if options.max_raw_size is not None and len(markdown) > options.max_raw_size else [markdown]
        out += [(from_units(p), crumbs) for p in pieces]
    return out


def list_chunks(first: int | None, items: list[str], options: Options) -> list[str] | None:
    """The chunks of a flat list of plain texts, as the tree splitter makes them; None if it needs a tree."""
    total = sum(map(len, items))
    if any(r.transform for r in options.rules.values()):
        return None
    if total <= options.limit:
        runs = [items]
    elif max(map(len, items)) > options.limit or not options.splittable("list", lambda: total):
        return None
    else:
        runs = [run for run, _ in packed(items, len, options.limit)]
        first = None if first is None else first or 1
    if first is None:
        return ["\n".join(["* " + item for item in run]) for run in runs]
    number, out = first, []
    for run in runs:
        out.append("\n".join([f"{n}. {item}" for n, item in enumerate(run, number)]))
        number += len(run)
    return out


def whole_chunks(text: str, options: Options, shortcut: bool = True, own: Mapping[str, NodeSplitter] | None = None) -> Iterator[tuple[str, tuple]]:
    """(Markdown, headings above) of each chunk, before the raw cap. Plain paragraphs and flat lists need no tree (``shortcut``)."""
    if shortcut and not own and (flat := plain_list(text)) and (found := list_chunks(*flat, options)):
        for markdown in found:
            yield trim(markdown), ()
        return
    body = plain_paragraph(text) if shortcut and "paragraph" not in (own or {}) else None
    if body is not None:
        found = [(piece, ()) for piece in ([body] if len(body) <= options.limit else split_plain(body, options))]
    else:
        found = [(serialise(n), n.crumbs) for n in Splitter(options, own).split(preprocess(parse(text), options).children)]
    for markdown, crumbs in found:
        if markdown := trim(markdown):
            yield markdown, crumbs

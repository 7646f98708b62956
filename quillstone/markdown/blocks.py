"""Block structure of Markdown (CommonMark with tables, task lists and footnotes).

Lines are read once. An open block decides whether a line continues it; what is left of the line may open further blocks;
the rest is text of the innermost one. Leaves keep their lines with source offsets, which the inline pass maps back to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .inlines import Inlines, Source, normalise_label, parse_definition
from .nodes import MAX_NESTING, Node

_LINE_END = re.compile(r"\r\n|\n|\r")
_THEMATIC = re.compile(r"(?:\*[ \t]*){3,}$|(?:_[ \t]*){3,}$|(?:-[ \t]*){3,}$")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_ATX_END = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_BULLET = re.compile(r"[*+-](?=[ \t]|$)")
_ORDERED = re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
_FOOTNOTE = re.compile(r"\[\^([^\s\[\]^][^\s\[\]]*|[^\s\[\]])\]:[ \t]*")
_TASK = re.compile(r"\[([ \txX])\](?=[ \t\n])[ \t\n]")
_TAG_NAME = r"[A-Za-z][A-Za-z0-9-]*"
_ATTR = r"""(?:[ \t\n]+[A-Za-z_:][A-Za-z0-9_.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
#: The element names that open an HTML block of the sixth kind.
_HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|"
    "frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|"
    "tbody|td|tfoot|th|thead|title|tr|track|ul"
)
_HTML_OPEN = [
    re.compile(r"<(?:script|pre|textarea|style)(?:[\s>]|$)", re.I), re.compile(r"<!--"), re.compile(r"<\?"), re.compile(r"<![A-Za-z]"), re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{_HTML_NAMES})(?:\s|/?>|$)", re.I), re.compile(rf"(?:<{_TAG_NAME}{_ATTR}*[ \t]*/?>|</{_TAG_NAME}[ \t]*>)[ \t]*$"),
]
_HTML_CLOSE = [re.compile(r"</(?:script|pre|textarea|style)>", re.I), re.compile(r"-->"), re.compile(r"\?>"), re.compile(r">"), re.compile(r"\]\]>")]
_DELIMITERS = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


class Block:
    """An open or closed block: its kind, children, and for leaves the lines as (text, source offset)."""

    def __init__(self, kind: str, parent: Block | None, at: int, **fields):
        self.kind, self.parent, self.start, self.end = kind, parent, at, at
        self.level: int = parent.level + 1 if parent else 0
        self.children: list[Block] = []
        self.lines: list[tuple[str, int]] = []
        self.open = True
        self.blank_inside = self.blank_last = False
        self.__dict__.update(fields)


class _Line:
    """A line and how much of it has been read; a tab may have been read in part."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.pos, self.column, self.partial = text, at, 0, 0, 0

    def look(self) -> None:
        """Find the next character that is no space or tab."""
        i, column = self.pos, self.column
        while i < len(self.text) and self.text[i] in " \t":
            column += 4 - column % 4 if self.text[i] == "\t" else 1
            i += 1
        self.next, self.next_column = i, column
        self.indent = column - self.column
        self.blank = i >= len(self.text)

    def skip(self, columns: int) -> None:
        """Read so many columns of white space."""
        while columns > 0 and self.pos < len(self.text):
            c = self.text[self.pos]
            if c == "\t":
                width = 4 - self.column % 4
                if width > columns:
                    self.column += columns
                    self.partial = width - columns
                    return
                columns -= width
                self.column += width
            elif c == " ":
                columns -= 1
                self.column += 1
            else:
                return
            self.partial = 0
            self.pos += 1

    def to(self, pos: int) -> None:
        """Read up to an offset within the line (which holds no tab that matters)."""
        self.column += self.next_column - self.column if pos >= self.next else 0
        self.column += pos - max(self.pos, self.next) if pos >= self.next else pos - self.pos
        self.pos, self.partial = pos, 0

    def rest(self) -> tuple[str, int]:
        if self.partial:
            return " " * self.partial + self.text[self.pos + 1 :], self.at + self.pos
        return self.text[self.pos :], self.at + self.pos


_CONTAINERS = ("root", "blockquote", "list", "listItem", "footnoteDefinition")


class Blocks:
    """Parses a whole text into a tree of ``Block``s and then of nodes."""

    def __init__(self, text: str):
        self.text = text
        self.doc = Block("root", None, 0)
        self.tip = self.doc
        self.definitions: dict[str, tuple] = {}
        self.footnotes: set[str] = set()

    def parse(self) -> Node:
        if "]:" in self.text:  # labels are known only when all is read
            held = list(self._closed())[::-1]
            children = []
            while held:
                children.append(self._node(held.pop()))
        else:
            children = [self._node(b) for b in self._closed()]
        return Node("root", children, start=0, end=len(self.text))

    def nodes(self) -> Iterator[Node]:
        """The blocks at the top in order, each made once it is closed and not held here: memory grows with the largest of
        them, not with the text. Where there may be labels, the text is read for them first."""
        if "]:" in self.text:
            labels = Blocks(self.text)
            for _ in labels._closed():
                pass
            self.definitions, self.footnotes = labels.definitions, labels.footnotes
        for block in self._closed():
            yield self._node(block)

    def _closed(self) -> Iterator[Block]:
        """Read all lines; gives the blocks at the top that nothing can change any more."""
        at, text = 0, self.text
        while at < len(text):
            m = _LINE_END.search(text, at)
            stop, following = m.span() if m else (len(text), len(text))
            self._line(_Line(text[at:stop].replace("\0", "�"), at))
            at = following
            while len(self.doc.children) > 1 and not self.doc.children[0].open:
                yield self.doc.children.pop(0)
        while self.tip:
            self._close(self.tip)
        yield from self.doc.children

    # -- reading lines

    def _line(self, line: _Line) -> None:
        block = self.doc
        while block.children and block.children[-1].open:
            child = block.children[-1]
            line.look()
            going = self._continues(child, line)
            if going is None:  # the line ended the block
                return
            if not going:
                break
            block = child
        matched, leaf = block, block.kind in ("code", "html", "table")
        if block.kind == "paragraph":
            leaf = False
        while not leaf:
            line.look()
            opened = self._open(block, line, matched)
            if opened is None:
                break
            matched = block = opened
            if block.kind not in _CONTAINERS:
                leaf = True
                if block.kind in ("heading", "thematicBreak"):
                    return
                if block.kind == "code" and block.fence:
                    return
        line.look()
        if self.tip is not matched and self.tip.kind == "paragraph" and not line.blank and not leaf:
            self._extend(self.tip, line)  # lazy continuation
            return
        self._close_down_to(matched)
        if line.blank:
            self._blank(matched, line)
            if matched.kind in ("code", "html"):
                self._add(matched, line)
            return
        if matched.kind in _CONTAINERS:
            holder = matched.parent if matched.kind == "list" else matched
            self._close_down_to(holder)
            self._note_gap(holder)
            matched = holder
        for up in self._up(matched):
            up.blank_last = False
        if leaf:
            self._add(matched, line)
        elif matched.kind == "paragraph":
            self._extend(matched, line)
        else:
            paragraph = self._new("paragraph", matched, line.at + line.next)
            self._extend(paragraph, line)

    def _up(self, block: Block | None):
        while block:
            yield block
            block = block.parent

    def _blank(self, block: Block, line: _Line) -> None:
        """Remember blank lines where they may make a list or item loose."""
        if block.kind == "code" and block.open or block.kind == "html" and block.open:
            return
        for up in self._up(block):
            up.blank_last = True

    def _note_gap(self, container: Block) -> None:
        """A child is about to open after a blank line."""
        if container.kind == "listItem" and container.children and container.blank_last:
            container.blank_inside = True
        elif container.kind == "list" and container.children and container.children[-1].blank_last:
            container.blank_inside = True

    def _continues(self, block: Block, line: _Line) -> bool | None:
        kind = block.kind
        if kind == "blockquote":
            if line.indent <= 3 and not line.blank and line.text[line.next] == ">":
                line.to(line.next + 1)
                if line.pos < len(line.text) and line.text[line.pos] in " \t":
                    line.skip(1)
                return True
            return False
        if kind == "list":
            return True
        if kind == "listItem":
            if line.blank:
                if not block.children:
                    return False
                line.to(line.next)
                return True
            if line.indent >= block.content:
                line.skip(block.content)
                return True
            return False
        if kind == "footnoteDefinition":
            if line.blank:
                return True
            if line.indent >= 4:
                line.skip(4)
                return True
            return False
        if kind == "code":
            if block.fence:
                if line.indent <= 3 and not line.blank:
                    m = re.match(rf"({re.escape(block.fence[0])}{{{len(block.fence)},}})[ \t]*$", line.text[line.next :])
                    if m:
                        block.end = line.at + len(line.text)
                        block.closed = True
                        self._close_down_to(block)
                        self._close(block)
                        return None
                line.skip(min(line.indent, block.offset))
                return True
            if line.indent >= 4:
                line.skip(4)
                return True
            if line.blank:
                line.to(line.next)
                return True
            return False
        if kind == "html":
            return not (line.blank and block.condition >= 5)
        if kind == "paragraph":
            return not line.blank
        if kind == "table":
            return not line.blank and not self._interrupts(line)
        return False

    def _interrupts(self, line: _Line) -> bool:
        """Whether another block starts here (used to end a table)."""
        if line.indent >= 4:
            return False
        rest = line.text[line.next :]
        fence = _FENCE.match(rest)
        html = next((i for i, p in enumerate(_HTML_OPEN) if p.match(rest)), 6)
        return bool(rest[0] == ">" or _ATX.match(rest) or fence or _THEMATIC.match(rest) or html < 6 or _BULLET.match(rest) or _ORDERED.match(rest))

    def _open(self, block: Block, line: _Line, matched: Block) -> Block | None:
        """Open the block that starts here, if any, below ``block``."""
        if line.blank:
            return None
        paragraph = block if block.kind == "paragraph" else None
        lazy = self.tip.kind == "paragraph" and self.tip is not block
        if line.indent >= 4:
            if paragraph or lazy or self.tip.kind == "paragraph":
                return None
            block = block.parent if block.kind == "list" else block
            self._close_down_to(block)
            self._note_gap(block)
            line.skip(4)
            return self._new("code", block, line.at + line.pos, fence=None, offset=0, info="")
        rest, at = line.text[line.next :], line.at + line.next
        c = rest[0]
        holder = paragraph.parent if paragraph else block
        deep = holder.level >= MAX_NESTING
        if c == ">" and not deep:
            new = self._start("blockquote", holder, at)
            line.to(line.next + 1)
            if line.pos < len(line.text) and line.text[line.pos] in " \t":
                line.skip(1)
            return new
        if c == "#" and (m := _ATX.match(rest)):
            new = self._start("heading", holder, at, depth=len(m[1]))
            body = rest[m.end() :]
            body = _ATX_END.sub("", body).rstrip(" \t")
            new.lines.append((body, at + m.end()))
            new.end = line.at + len(line.text.rstrip(" \t"))
            self._close(new)
            return new
        if c in "`~" and (m := _FENCE.match(rest)):
            new = self._start("code", holder, at, fence=m[1] or m[3], offset=line.indent, info=(m[2] if m[1] else m[4]).strip(" \t"), closed=False)
            new.end = line.at + len(line.text)
            return new
        if c == "<":
            kind = next((i for i, p in enumerate(_HTML_OPEN) if p.match(rest)), None)
            if kind is not None and (kind < 6 or (not paragraph and not lazy)):
                return self._start("html", holder, line.at + line.next, condition=kind)
        if paragraph and c in "=-" and paragraph.lines and (m := _SETEXT.match(rest)) and paragraph is self.tip:
            self._take_definitions(paragraph)
            if paragraph.lines:
                paragraph.kind, paragraph.depth = "heading", 1 if m[1][0] == "=" else 2
                last, offset = paragraph.lines[-1]
                paragraph.lines[-1] = (last.rstrip(" \t"), offset)
                paragraph.end = line.at + len(line.text)
                self._close(paragraph)
                return paragraph
        if c in "*_-" and _THEMATIC.match(rest):
            new = self._start("thematicBreak", holder, at)
            new.end = line.at + len(line.text)
            self._close(new)
            return new
        if paragraph and paragraph is self.tip and ("|" in rest or ":" in rest or "-" in rest) and _DELIMITERS.match(rest) and self._table(paragraph, line, rest):
            return holder.children[-1]
        if c == "[" and not paragraph and not lazy and (m := _FOOTNOTE.match(rest)):
            self.footnotes.add(normalise_label(m[1]))
            new = self._start("footnoteDefinition", holder, at, label=m[1])
            line.to(line.next + m.end())
            return new
        return None if deep else self._list_item(block, paragraph, holder, line, rest, at)

    def _list_item(self, block, paragraph, holder, line, rest, at) -> Block | None:
        m = _BULLET.match(rest)
        ordered = None if m else _ORDERED.match(rest)
        m = m or ordered
        if not m:
            return None
        after = rest[m.end() :]
        empty = not after.strip(" \t")
        if paragraph and (empty or (ordered and int(ordered[1]) != 1)):
            return None
        marker = ordered[2] if ordered else m[0]
        own = holder if holder.kind == "list" else None
        if own is None or own.marker != marker or own.ordered != bool(ordered):
            if own is not None:
                self._close_down_to(own)
                holder = own.parent
                self._close(own)
            own = self._start("list", holder, at, marker=marker, ordered=bool(ordered), first=int(ordered[1]) if ordered else None)
        indent = line.indent
        item = self._start("listItem", own, at, content=0)
        line.to(line.next + m.end())
        line.look()
        if line.blank or line.indent > 4:
            item.content = indent + m.end() + 1
            if not line.blank:
                line.skip(1)
        else:
            item.content = indent + m.end() + line.indent
            line.skip(line.indent)
        return item

    def _table(self, paragraph: Block, line: _Line, delimiters: str) -> bool:
        """Turn the paragraph's last line and this delimiter row into a table, if their columns agree."""
        head, at = paragraph.lines[-1]
        marks = [c.strip(" \t") for c, _ in cells(delimiters, 0)]
        if len(cells(head, at)) != len(marks) or not any(marks) or ("|" not in head and "|" not in delimiters and ":" not in delimiters):
            return False
        if len(paragraph.lines) == 1 and len(marks) == 1 and "|" not in delimiters and ":" not in delimiters:
            return False
        holder = paragraph.parent
        paragraph.lines.pop()
        if paragraph.lines:
            paragraph.end = sum(map(len, paragraph.lines[-1][:1])) + paragraph.lines[-1][1]
            self._close(paragraph)
        else:
            holder.children.remove(paragraph)
            self.tip = holder
        align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((m[:1] == ":", m[-1:] == ":" and len(m) > 1)) for m in marks]
        table = self._new("table", holder, at, align=align)
        table.lines.append((head, at))
        table.end = line.at + len(line.text)
        table.skip_line = True
        return True

    # -- building blocks

    def _start(self, kind: str, holder: Block, at: int, **fields) -> Block:
        self._close_down_to(holder)
        while holder.kind == "list" and kind != "listItem":
            up = holder.parent
            self._close(holder)
            holder = up
        self._note_gap(holder)
        for up in self._up(holder):
            up.blank_last = False
        return self._new(kind, holder, at, **fields)

    def _new(self, kind: str, parent: Block, at: int, **fields) -> Block:
        if parent.kind == "list" and kind != "listItem":
            up = parent.parent
            self._close_down_to(parent)
            self._close(parent)
            self._note_gap(up)
            parent = up
        new = Block(kind, parent, at, **fields)
        parent.children.append(new)
        self.tip = new
        return new

    def _add(self, block: Block, line: _Line) -> None:
        if getattr(block, "skip_line", False):
            block.skip_line = False
            return
        text, at = line.rest()
        block.lines.append((text, at))
        if text.strip(" \t") or block.kind != "code":
            block.end = line.at + len(line.text)
        if block.kind == "html" and block.condition < 5 and _HTML_CLOSE[block.condition].search(text):
            self._close(block)

    def _extend(self, paragraph: Block, line: _Line) -> None:
        paragraph.lines.append((line.text[line.next :], line.at + line.next))
        paragraph.end = line.at + len(line.text.rstrip(" \t"))

    def _close_down_to(self, block: Block) -> None:
        while self.tip is not block:
            self._close(self.tip)

    def _close(self, block: Block) -> None:
        block.open = False
        if block.kind == "paragraph":
            self._take_definitions(block)
            if not block.lines:
                block.parent.children = [c for c in block.parent.children if c is not block]
        if block.parent and block.parent.end < block.end:
            block.parent.end = block.end
        if self.tip is block:
            self.tip = block.parent

    def _take_definitions(self, paragraph: Block) -> None:
        """Move link definitions at the paragraph's start into blocks of their own."""
        while paragraph.lines and paragraph.lines[0][0].startswith("["):
            body = "\n".join(t for t, _ in paragraph.lines)
            found = parse_definition(body)
            if not found:
                return
            label, url, title, end = found
            key = normalise_label(label)
            self.definitions.setdefault(key, (url, title))
            first = paragraph.lines[0][1]
            used = body[:end].rstrip("\n").count("\n") + 1
            last, at = paragraph.lines[used - 1]
            holder = paragraph.parent
            new = Block("definition", holder, first, label=label, url=url, title=title)
            new.open, new.end = False, at + len(last.rstrip(" \t"))
            holder.children.insert(holder.children.index(paragraph), new)
            del paragraph.lines[:used]
            if paragraph.lines:
                paragraph.start = paragraph.lines[0][1]

    # -- nodes

    def _node(self, block: Block) -> Node:
        kind, at = block.kind, {"start": block.start, "end": block.end}
        if kind in ("blockquote",):
            return Node(kind, [self._node(c) for c in block.children], **at)
        if kind == "list":
            spread = block.blank_inside
            return Node("list", [self._node(c) for c in block.children], ordered=block.ordered, first=block.first, spread=spread, **at)
        if kind == "listItem":
            return self._item(block, at)
        if kind == "footnoteDefinition":
            return Node(kind, [self._node(c) for c in block.children], label=block.label, identifier=normalise_label(block.label).lower(), **at)
        if kind == "paragraph":
            return Node(kind, self._inline(block.lines), **at)
        if kind == "heading":
            return Node(kind, self._inline(block.lines), depth=block.depth, **at)
        if kind == "thematicBreak":
            return Node(kind, **at)
        if kind == "definition":
            return Node(kind, label=block.label, identifier=normalise_label(block.label).lower(), url=block.url, title=block.title, **at)
        if kind == "html":
            lines = [t for t, _ in block.lines]
            while lines and not lines[-1].strip(" \t"):
                lines.pop()
            return Node(kind, value="\n".join(lines), **at)
        if kind == "code":
            return self._code(block, at)
        return self._rows(block, at)

    def _inline(self, lines: list[tuple[str, int]]) -> list[Node]:
        return Inlines(Source(lines), self.definitions, self.footnotes).parse()

    def _item(self, block: Block, at: dict) -> Node:
        checked = None
        children = block.children
        first = children[0] if children else None
        if first is not None and first.kind == "paragraph" and (m := _TASK.match("\n".join(t for t, _ in first.lines))):
            checked = m[1] in "xX"
            text, offset = first.lines[0]
            if len(text) > 3:
                first.lines[0] = (text[4:].lstrip(" \t"), offset + 4 + len(text[4:]) - len(text[4:].lstrip(" \t")))
            else:
                del first.lines[0]
            first.start = first.lines[0][1] if first.lines else first.start
        return Node("listItem", [self._node(c) for c in children], spread=block.blank_inside, checked=checked, **at)

    def _code(self, block: Block, at: dict) -> Node:
        lines = [t for t, _ in block.lines]
        if not block.fence:
            while lines and not lines[-1].strip(" \t"):
                lines.pop()
            return Node("code", value="\n".join(lines), lang=None, meta=None, **at)
        info = Inlines.unescape(block.info)
        lang, _, meta = info.partition(" ") if " " in info else info.partition("\t")
        return Node("code", value="\n".join(lines), lang=lang or None, meta=meta.strip(" \t") or None, **at)

    def _rows(self, block: Block, at: dict) -> Node:
        rows = []
        for text, offset in block.lines:
            found = cells(text, offset)
            if rows:
                found = found[: len(block.align)]
            made = []
            for body, start in found:
                lead = len(body) - len(body.lstrip(" \t"))
                source = Source([(body.strip(" \t"), start + lead)], table=True)
                made.append(Node("tableCell", Inlines(source, self.definitions, self.footnotes).parse(), start=start, end=start + len(body)))
            rows.append(Node("tableRow", made, start=offset, end=offset + len(text)))
        return Node("table", rows, align=list(block.align), **at)


def cells(row: str, at: int) -> list[tuple[str, int]]:
    """The cells of a table row, with their offsets; an escaped pipe does not part cells."""
    start = len(row) - len(row.lstrip(" \t"))
    end = len(row.rstrip(" \t"))
    if start < end and row[start] == "|":
        start += 1
    out, i, begin = [], start, start
    while i < end:
        if row[i] == "\\" and i + 1 < end:
            i += 2
            continue
        if row[i] == "|":
            out.append((row[begin:i], at + begin))
            begin = i + 1
        i += 1
    if begin < end and (row[begin:end].strip(" \t") or not out):
        out.append((row[begin:end], at + begin))
    return out


def parse(text: str) -> Node:
    """The syntax tree of a Markdown text (as UTF-16 units)."""
    return Blocks(text).parse()

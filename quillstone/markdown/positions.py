"""Plain text of parsed Markdown with a map from its positions back to the Markdown."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from .nodes import Node

#: Elements whose closing syntax belongs to the text before it.
WRAPPERS = ("emphasis", "strong", "delete", "link")


@dataclass
class Segment:
    """Plain [plain_start, plain_end) stands for Markdown [md_start, md_end), inside an element [node_start, node_end);
    ``chars`` has the Markdown offset of each character where the two differ in length (escapes)."""

    plain_start: int
    plain_end: int
    md_start: int
    md_end: int
    node_start: int | None = None
    node_end: int | None = None
    chars: list[int] | None = None

    def after(self) -> int:
        """Where the Markdown goes on behind this segment: past the syntax that closes its element."""
        return self.node_end if self.node_end is not None and self.node_end > self.md_end else self.md_end


@dataclass
class PlainMap:
    markdown: str
    plain: str = ""
    segments: list[Segment] = field(default_factory=list)

    def literal(self) -> bool:
        """Whether plain and Markdown positions are the same: one text without escapes from the start."""
        if len(self.segments) != 1:
            return False
        s = self.segments[0]
        return s.chars is None and s.md_start == 0 and s.after() == s.plain_end

    def locate(self, pos: int) -> int:
        """The Markdown position of a plain position. A position between two segments belongs to the first; past the last
        and before the first, the distance is kept."""
        found = self.segments
        if not found:
            return pos
        i = bisect_left(found, pos, key=lambda s: s.plain_end)
        if i == len(found):
            return found[-1].after() + pos - found[-1].plain_end if pos > found[-1].plain_end else found[-1].after()
        s = found[i]
        if pos == s.plain_end:
            return s.after()
        if pos > s.plain_start:
            offset = pos - s.plain_start
            return s.md_start + (s.chars[offset] if s.chars and offset < len(s.chars) else offset)
        if i and found[i - 1].plain_end >= pos:
            return found[i - 1].after()
        return s.md_start if pos == s.plain_start else max(0, s.md_start - (s.plain_start - pos)) if not i else found[i - 1].after()


def _aligned(shown: str, value: str) -> list[int]:
    """For each character of ``value`` its offset in the Markdown ``shown``, which may hold escapes."""
    out, at = [], 0
    for c in value:
        while at < len(shown):
            if shown[at] == "\\" and at + 1 < len(shown) and shown[at + 1] == c:
                at += 1
                break
            if shown[at] == c:
                break
            at += 1
        out.append(min(at, len(shown)))
        at += 1
    return out


def plain_map(tree: Node, markdown: str) -> PlainMap:
    """Texts, code, image descriptions and line breaks of the tree in order, with the white space between them; html and
    unresolved images have no plain text."""
    made = PlainMap(markdown)
    parts: list[str] = []
    length = last = 0

    def add(text: str, start: int, end: int, outer: tuple, chars=None) -> None:
        nonlocal length
        made.segments.append(Segment(length, length + len(text), start, end, *(outer or (None, None)), chars))
        parts.append(text)
        length += len(text)

    def visit(node: Node, outer: tuple) -> None:
        nonlocal last
        if node.start is None:
            for child in node.children or ():
                visit(child, outer)
            return
        if node.children is not None:
            if node.type in WRAPPERS:
                outer = (node.start, node.end) if not outer else (min(outer[0], node.start), max(outer[1], node.end))
            for child in node.children:
                visit(child, outer)
            return
        if node.type not in ("text", "inlineCode", "code", "image", "break"):
            return
        gap = markdown[last : node.start]
        if gap and gap.isspace():
            add(gap, last, node.start, ())
        shown = markdown[node.start : node.end]
        if node.type == "text":
            add(node.value, node.start, node.end, outer, None if len(shown) == len(node.value) else _aligned(shown, node.value))
        elif node.type == "inlineCode":
            at = shown.find(node.value)
            if node.value and at >= 0:
                add(node.value, node.start + at, node.start + at + len(node.value), (node.start, node.end))
        elif node.type == "code":
            at = shown.find("\n")
            if node.value and at >= 0:
                add(node.value, node.start + at + 1, node.start + at + 1 + len(node.value), ())
        elif node.type == "image":
            if node.alt:
                add(node.alt, node.start + 2, node.start + 2 + len(node.alt), (node.start, node.end))
        else:
            add("\n", node.start, node.end, outer)
        last = node.end

    visit(tree, ())
    made.plain = "".join(parts)
    return made

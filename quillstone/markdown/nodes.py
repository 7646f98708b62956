"""The Markdown syntax tree: one node class, and the measures taken on it."""

from __future__ import annotations

PHRASING = frozenset("text emphasis strong delete inlineCode break html link linkReference image imageReference footnoteReference".split())

#: Blocks and formatting nested deeper than this are text: no real document goes so far, and a hostile one must not end a job.
MAX_NESTING = 100


class Node:
    """``type`` and whatever fields that type has; ``children`` is None for leaves, ``start``/``end`` are source offsets."""

    def __init__(self, type: str, children: list | None = None, **fields):
        self.type = type
        self.children = children
        self.value = self.start = self.end = None
        self.crumbs = ()
        self.__dict__.update(fields)
        self._size = None

    def copy(self, **fields) -> Node:
        """A shallow copy with other fields."""
        new = Node.__new__(Node)
        new.__dict__.update(self.__dict__)
        new._size = None
        new.__dict__.update(fields)
        return new

    def __repr__(self) -> str:
        shown = {k: v for k, v in self.__dict__.items() if k not in ("type", "children", "start", "end", "crumbs", "_size") and v is not None}
        return f"{self.type}{shown or ''}{self.children if self.children is not None else ''}"


def root(children: list[Node]) -> Node:
    return Node("root", children)


def tree_of(nodes: Node | list[Node]) -> Node:
    """A root around a node or nodes; a root is its own."""
    if isinstance(nodes, Node):
        return nodes if nodes.type == "root" else root([nodes])
    return root(list(nodes))


def walk(node: Node):
    """The node and everything below it, in document order."""
    yield node
    for child in node.children or ():
        yield from walk(child)


def plain_text(node: Node) -> str:
    """The text a reader sees: values and image descriptions, without separators."""
    if node.children is not None:
        return "".join(map(plain_text, node.children))
    if node.type in ("image", "imageReference"):
        return node.alt or ""
    return node.value or ""


def content_size(node: Node) -> int:
    """Length of the plain text, in UTF-16 units (texts are kept as such units, see ``units``); remembered on the node."""
    if node._size is None:
        node._size = sum(map(content_size, node.children)) if node.children is not None else len(plain_text(node))
    return node._size


def units(text: str) -> str:
    """``text`` with every character beyond the basic plane as two surrogates, so that lengths and offsets count UTF-16."""
    if text.isascii() or max(text) <= "￿":
        return text
    raw = text.encode("utf-16-le", "surrogatepass")
    return "".join(chr(raw[i] | raw[i + 1] << 8) for i in range(0, len(raw), 2))


def from_units(text: str) -> str:
    """The reverse of ``units``; a lone surrogate becomes U+FFFD."""
    if text.isascii():
        return text
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

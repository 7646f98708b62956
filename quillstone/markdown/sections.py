"""The heading hierarchy: a flat list of blocks as a forest of sections."""

from __future__ import annotations

from .nodes import Node, content_size


def section(depth: int = 0, heading: Node | None = None, children: list[Node] | None = None) -> Node:
    """A section; depth 0 without heading holds blocks that no heading governs."""
    return Node("section", [] if children is None else children, depth=depth, heading=heading)


def is_section(node: Node | None) -> bool:
    return node is not None and node.type == "section"


def hierarchy(blocks: list[Node]) -> list[Node]:
    """Top-level sections. A heading's section holds what follows up to a heading of its depth or less, or up to and with
    the first thematic break, which closes all open sections; blocks that no heading governs are gathered in sections of
    depth 0."""
    top: list[Node] = []
    open_: list[Node] = []
    for block in blocks:
        if block.type == "heading":
            while open_ and open_[-1].depth >= block.depth:
                open_.pop()
            new = section(block.depth, block)
            (open_[-1].children if open_ else top).append(new)
            open_.append(new)
        elif open_:
            open_[-1].children.append(block)
            if block.type == "thematicBreak":
                open_ = []
        elif top and top[-1].heading is None:
            top[-1].children.append(block)
        else:
            top.append(section(children=[block]))
    return top


def flatten(nodes: list[Node]) -> list[Node]:
    """Sections turned back into their headings and blocks, in document order."""
    out: list[Node] = []
    for n in nodes:
        if is_section(n):
            out += [n.heading] if n.heading else []
            out += flatten(n.children)
        else:
            out.append(n)
    return out


def section_size(node: Node) -> int:
    """Content size of a section (heading and everything below) or of a node."""
    if not is_section(node):
        return content_size(node)
    return (content_size(node.heading) if node.heading else 0) + sum(map(section_size, node.children))

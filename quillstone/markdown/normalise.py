"""Changes made to a tree before splitting: references written out in place, then transforms."""

from __future__ import annotations

from .nodes import Node, walk
from .options import FORMATTING, REMOVE, Options


def inline_references(tree: Node, options: Options) -> Node:
    """Replace references to definitions by links and images where the rules ask for inline style. Of definitions with the
    same identifier the last counts; used ones at the top level go, unused ones and unresolved references stay."""
    wanted = {kind + "Reference": kind for kind in ("link", "image") if (r := options.rules.get(kind)) and r.style == "inline"}
    known = {n.identifier.lower(): n for n in walk(tree) if n.type == "definition"} if wanted else {}
    if not known:
        return tree
    used = set()

    def visit(node: Node) -> None:
        for i, child in enumerate(node.children or ()):
            if child.type in wanted and (target := known.get(child.identifier.lower())):
                used.add(child.identifier.lower())
                node.children[i] = child.copy(type=wanted[child.type], url=target.url, title=target.title)
            visit(node.children[i])

    visit(tree)
    if used:
        tree.children = [n for n in tree.children if n.type != "definition" or n.identifier.lower() not in used]
    return tree


def apply_transforms(tree: Node, options: Options) -> Node:
    """Offer every node with a transform for its kind to it, in document order: a node replaces it, ``REMOVE`` drops it,
    None keeps it. A formatting transform stands in for strong, emphasis and delete. What replaces a node is not offered
    again, but what is below it is."""
    transforms = {k: r.transform for k, r in options.rules.items() if r.transform}
    if "formatting" in transforms:
        shared = transforms.pop("formatting")
        transforms = {k: shared for k in FORMATTING} | transforms
    if not transforms:
        return tree

    def visit(node: Node) -> None:
        i = 0
        while i < len(node.children or ()):
            child = node.children[i]
            if child.type in transforms:
                made = transforms[child.type](child, node, i, tree)
                if made is REMOVE:
                    del node.children[i]
                    continue
                if made:
                    node.children[i] = made
            visit(child)
            i += 1

    visit(tree)
    for n in walk(tree):
        n._size = None
    return tree


def preprocess(tree: Node, options: Options) -> Node:
    return apply_transforms(inline_references(tree, options), options) if options.rules else tree

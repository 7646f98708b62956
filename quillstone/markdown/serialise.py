"""Markdown text of a syntax tree, in one normal form: ``*`` bullets and emphasis, ATX headings, fenced code, resource links.

Text is escaped only where it would otherwise be read as markup. Which characters are unsafe where is a table of rules; a
rule names a character, what may stand before and after it, the constructs it matters in, and whether only at a line's start.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .nodes import PHRASING, Node, plain_text, units

#: Constructs in which inline markup is not read.
_SPANS = ("autolink", "destinationLiteral", "destinationRaw", "reference", "titleQuote", "titleApostrophe")
_CODE_INFO = ("codeLang", "codeMeta")
_NO_AUTOLINK = ("autolink", "link", "image", "label")

#: Fixed values: (character, before, after, constructs or None for all, constructs in which it is safe, only at a line's start).
RULES = [
    ("\t", "", r"[\r\n]", ("phrasing",), (), False),
    ("\t", r"[\r\n]", "", ("phrasing",), (), False),
    ("\t", "", "", ("codeLang",), (), False),
    ("\r", "", "", (*_CODE_INFO, "destinationLiteral", "headingAtx", "tableCell"), (), False),
    ("\n", "", "", (*_CODE_INFO, "destinationLiteral", "headingAtx", "tableCell"), (), False),
    (" ", "", r"[\r\n]", ("phrasing",), (), False),
    (" ", r"[\r\n]", "", ("phrasing",), (), False),
    (" ", "", "", ("codeLang",), (), False),
    ("!", "", r"\[", ("phrasing",), _SPANS, False),
    ('"', "", "", ("titleQuote",), (), False),
    ("#", "", "", None, (), True),
    ("#", "", r"(?:[\r\n]|$)", ("headingAtx",), (), False),
    ("&", "", "[#A-Za-z]", ("phrasing",), (), False),
    ("'", "", "", ("titleApostrophe",), (), False),
    ("(", "", "", ("destinationRaw",), (), False),
    ("(", r"\]", "", ("phrasing",), _SPANS, False),
    (")", r"\d+", "", None, (), True),
    (")", "", "", ("destinationRaw",), (), False),
    ("*", "", r"(?:[ \t\r\n*])", None, (), True),
    ("*", "", "", ("phrasing",), _SPANS, False),
    ("+", "", r"(?:[ \t\r\n])", None, (), True),
    ("-", "", r"(?:[ \t\r\n-])", None, (), True),
    (".", r"\d+", r"(?:[ \t\r\n]|$)", None, (), True),
    ("<", "", "[!/?A-Za-z]", None, (), True),
    ("<", "", "[!/?A-Za-z]", ("phrasing",), _SPANS, False),
    ("<", "", "", ("destinationLiteral",), (), False),
    ("=", "", "", None, (), True),
    (">", "", "", None, (), True),
    (">", "", "", ("destinationLiteral",), (), False),
    ("[", "", "", None, (), True),
    ("[", "", "", ("phrasing",), _SPANS, False),
    ("[", "", "", ("label", "reference"), (), False),
    ("\\", "", r"[\r\n]", ("phrasing",), (), False),
    ("]", "", "", ("label", "reference"), (), False),
    ("_", "", "", None, (), True),
    ("_", "", "", ("phrasing",), _SPANS, False),
    ("`", "", "", None, (), True),
    ("`", "", "", _CODE_INFO, (), False),
    ("`", "", "", ("phrasing",), _SPANS, False),
    ("~", "", "", None, (), True),
    # tables, strikethrough, footnotes, autolink literals
    ("@", r"[+\-.\w]", r"[\-.\w]", ("phrasing",), _NO_AUTOLINK, False),
    (".", "[Ww]", r"[\-.\w]", ("phrasing",), _NO_AUTOLINK, False),
    (":", "[ps]", r"\/", ("phrasing",), _NO_AUTOLINK, False),
    ("~", "", "", ("phrasing",), _SPANS, False),
    ("|", "", r"[\t :-]", None, (), True),
    ("|", "", "", ("tableCell",), (), False),
    (":", "", "-", None, (), True),
    ("-", "", "[:|-]", None, (), True),
]

_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]")
_BACKSLASH = re.compile(r"\\(?=[!-/:-@\[-`{-~])")


def _compiled(rule: tuple) -> re.Pattern:
    char, before, after, _, _, at_break = rule
    start = r"[\r\n][\t ]*" if at_break else ""
    lead = f"({start}{f'(?:{before})' if before else ''})" if start or before else "()"
    return re.compile(f"{lead}{re.escape(char)}{f'(?:{after})' if after else ''}", re.A)


@lru_cache(maxsize=512)
def _rules_for(stack: frozenset) -> tuple[re.Pattern, list]:
    """The rules that hold inside the constructs of ``stack``, and a pattern that finds any of their characters."""
    held = [r for r in RULES if (r[3] is None or stack & set(r[3])) and not stack & set(r[4])]
    return re.compile("[" + re.escape("".join(sorted({r[0] for r in held}))) + "]"), [(r, _compiled(r)) for r in held]


class Serialiser:
    def __init__(self):
        self.stack: list[str] = []
        self.bullet = self.last_bullet = ""
        self.parents: list[Node] = []

    # -- text

    def safe(self, text: str, before: str = "", after: str = "") -> str:
        """``text`` escaped for the present constructs, between the characters ``before`` and ``after``."""
        value = before + text + after
        some, rules = _rules_for(frozenset(self.stack))
        start, end = len(before), len(before) + len(text)
        if not some.search(value):
            return self._backslashes(text, after)
        found: dict[int, list[bool]] = {}
        for (char, lead, tail, _, _, at_break), pattern in rules:
            if char not in value:
                continue
            i = 0
            while m := pattern.search(value, i):
                at = m.end(1)
                flags = found.setdefault(at, [True, True])
                flags[0] &= bool(lead) or at_break
                flags[1] &= bool(tail)
                i = m.end() if m.end() > m.start() else m.end() + 1
        out, last = [], start
        places = sorted(found)
        for k, at in enumerate(places):
            if at < start or at >= end:
                continue
            lead, tail = found[at]
            # a rule that looks at its neighbour is settled by escaping that neighbour
            if at + 1 < end and k + 1 < len(places) and places[k + 1] == at + 1 and tail and found[at + 1] == [False, False]:
                continue
            if k and places[k - 1] == at - 1 and lead and found[at - 1] == [False, False]:
                continue
            if last != at:
                out.append(self._backslashes(value[last:at], "\\"))
            last = at
            if _PUNCTUATION.match(value[at]):
                out.append("\\")
            else:
                out.append(f"&#x{ord(value[at]):X};")
                last += 1
        out.append(self._backslashes(value[last:end], after))
        return "".join(out)

    @staticmethod
    def _backslashes(text: str, after: str) -> str:
        """Backslashes that would escape what follows are doubled."""
        if "\\" not in text:
            return text
        whole = text + after
        return "".join("\\\\" if c == "\\" and _BACKSLASH.match(whole, i) else c for i, c in enumerate(text))

    def phrasing(self, parent: Node, before: str, after: str) -> str:
        out: list[str] = []
        children = parent.children
        for i, child in enumerate(children):
            if i + 1 < len(children):
                follow = self._peek(children[i + 1])
            else:
                follow = after
            if out and before in "\r\n" and child.type == "html":
                # a line that starts with html would be a block of its own
                out[-1] = re.sub(r"(\r?\n|\r)\Z", " ", out[-1])
                before = " "
            out.append(self.inline(child, before, follow))
            before = out[-1][-1:] or before
        return "".join(out)

    def _peek(self, node: Node) -> str:
        first = {"emphasis": "*", "strong": "*", "delete": "~", "inlineCode": "`", "image": "!", "imageReference": "!", "link": "[", "linkReference": "[", "footnoteReference": "[", "html": "<"}.get(node.type)
        return first if first is not None else self.inline(node, "", "")[:1]

    def inside(self, *constructs: str):
        return _Inside(self.stack, constructs)

    def inline(self, node: Node, before: str, after: str) -> str:
        kind = node.type
        if kind == "text":
            return self.safe(node.value, before, after)
        if kind in ("emphasis", "strong", "delete"):
            mark = {"emphasis": "*", "strong": "**", "delete": "~~"}[kind]
            with self.inside(kind):
                return mark + self.phrasing(node, mark[0], mark[0]) + mark
        if kind == "inlineCode":
            return self._code_span(node)
        if kind == "break":
            return " " if "headingAtx" in self.stack or "tableCell" in self.stack else "\\\n"
        if kind == "html":
            return node.value or ""
        if kind == "image":
            with self.inside("image"):
                with self.inside("label"):
                    alt = self.safe(node.alt or "", "[", "]")
                return f"![{alt}]({self._destination(node)})"
        if kind == "link":
            with self.inside("link"):
                with self.inside("label"):
                    body = self.phrasing(node, "[", "](")
                return f"[{body}]({self._destination(node)})"
        if kind in ("linkReference", "imageReference"):
            return self._reference(node)
        if kind == "footnoteReference":
            with self.inside("footnoteReference", "reference"):
                return "[^" + self._label(node, "[^") + "]"
        return self.flow(node)

    def _code_span(self, node: Node) -> str:
        value = node.value or ""
        fence = "`"
        while re.search(rf"(?:^|[^`]){fence}(?:[^`]|$)", value):
            fence += "`"
        if re.search(r"[^ \r\n]", value) and ((re.match(r"[ \r\n]", value) and re.search(r"[ \r\n]\Z", value)) or value[0] == "`" or value[-1] == "`"):
            value = f" {value} "
        # line endings that would start a block become spaces
        _, rules = _rules_for(frozenset(self.stack))
        for (_, _, _, _, _, at_break), pattern in rules:
            if at_break and "\n" in value:
                value = "".join(" " if c == "\n" and any(m.start() == i for m in pattern.finditer(value)) else c for i, c in enumerate(value))
        if "tableCell" in self.stack:
            value = value.replace("|", "\\|")
        return fence + value + fence

    def _destination(self, node: Node) -> str:
        url, title = node.url or "", node.title
        if (not url and title) or re.search(r"[\0- \x7f]", url):
            with self.inside("destinationLiteral"):
                shown = "<" + self.safe(url, "<", ">") + ">"
        else:
            with self.inside("destinationRaw"):
                shown = self.safe(url, "(", " " if title else ")")
        if title:
            with self.inside("titleQuote"):
                shown += ' "' + self.safe(title, '"', '"') + '"'
        return shown

    @staticmethod
    def _identifier(node: Node) -> str:
        return node.label if node.label else node.identifier or ""

    def _label(self, node: Node, before: str) -> str:
        return self.safe(self._identifier(node), before, "]")

    def _reference(self, node: Node) -> str:
        image = node.type == "imageReference"
        with self.inside(node.type, "label"):
            body = self.safe(node.alt or "", "[", "]") if image else self.phrasing(node, "[", "]")
        kept, self.stack = self.stack, []
        with self.inside("reference"):
            label = self._label(node, "[")
        self.stack = kept
        mark = "!" if image else ""
        if node.kind == "full" or not body or body != label:
            return f"{mark}[{body}][{label}]"
        return f"{mark}[{body}]" + ("[]" if node.kind == "collapsed" else "")

    # -- blocks

    def flow(self, node: Node) -> str:
        return getattr(self, "_" + node.type.lower())(node)

    def _root(self, node: Node) -> str:
        if any(c.type in PHRASING for c in node.children):
            # html is inline among inline nodes, a block among blocks
            if any(c.type in PHRASING and c.type != "html" for c in node.children) or len(node.children) == 1:
                with self.inside("phrasing"):
                    return self.phrasing(node, "\n", "\n")
        return self.blocks(node)

    def blocks(self, parent: Node) -> str:
        out: list[str] = []
        self.parents.append(parent)
        for i, child in enumerate(parent.children):
            if child.type != "list":
                self.last_bullet = ""
            out.append(self.flow(child) if child.type not in PHRASING or child.type == "html" else self._loose_inline(child))
            if i + 1 < len(parent.children):
                out.append("\n" * (1 + self._gap(child, parent.children[i + 1], parent)))
        self.parents.pop()
        return "".join(out)

    def _loose_inline(self, child: Node) -> str:
        with self.inside("phrasing"):
            return self.inline(child, "\n", "\n")

    @staticmethod
    def _gap(left: Node, right: Node, parent: Node) -> int:
        spread = getattr(parent, "spread", None)
        if spread is None or (left.type == "paragraph" and right.type in ("paragraph", "definition")):
            return 1
        return 1 if spread else 0

    def _paragraph(self, node: Node) -> str:
        with self.inside("paragraph", "phrasing"):
            return self.phrasing(node, "\n", "\n")

    def _heading(self, node: Node) -> str:
        if node.depth < 3 and plain_text(node) and self._has_line_end(node):
            with self.inside("headingSetext", "phrasing"):
                body = self.phrasing(node, "\n", "\n")
            return body + "\n" + ("=" if node.depth == 1 else "-") * (len(body) - max(body.rfind("\r"), body.rfind("\n")) - 1)
        marks = "#" * node.depth
        with self.inside("headingAtx", "phrasing"):
            body = self.phrasing(node, "# ", "\n")
        if body[:1] in ("\t", " "):
            body = f"&#x{ord(body[0]):X};" + body[1:]
        return f"{marks} {body}" if body else marks

    def _has_line_end(self, node: Node) -> bool:
        return any((c.value and ("\n" in c.value or "\r" in c.value)) or c.type == "break" or (c.children and self._has_line_end(c)) for c in node.children)

    def _thematicbreak(self, node: Node) -> str:
        return "***"

    def _html(self, node: Node) -> str:
        return node.value or ""

    def _blockquote(self, node: Node) -> str:
        with self.inside("blockquote"):
            return "\n".join(f"> {line}" if line else ">" for line in self.blocks(node).split("\n"))

    def _code(self, node: Node) -> str:
        value, fence = node.value or "", "```"
        while fence in value:
            fence += "`"
        with self.inside("codeLang"):
            info = self.safe(node.lang, fence, " ") if node.lang else ""
        if node.lang and node.meta:
            with self.inside("codeMeta"):
                info += " " + self.safe(node.meta, " ", "\n")
        return f"{fence}{info}\n{value}\n{fence}" if value else f"{fence}{info}\n{fence}"

    def _definition(self, node: Node) -> str:
        with self.inside("definition", "label"):
            label = self._label(node, "[")
        url, title = node.url or "", node.title
        if not url or re.search(r"[\0- \x7f]", url):
            with self.inside("destinationLiteral"):
                shown = "<" + self.safe(url, "<", ">") + ">"
        else:
            with self.inside("destinationRaw"):
                shown = self.safe(url, " ", " " if title else "\n")
        if title:
            with self.inside("titleQuote"):
                shown += ' "' + self.safe(title, '"', '"') + '"'
        return f"[{label}]: {shown}"

    def _footnotedefinition(self, node: Node) -> str:
        with self.inside("footnoteDefinition", "label"):
            head = "[^" + self._label(node, "[^") + "]:"
        with self.inside("footnoteDefinition"):
            body = self.blocks(node).split("\n") if node.children else []
        return head + "".join((" " if not i else "\n") + (line if not i or not line else "    " + line) for i, line in enumerate(body))

    def _list(self, node: Node) -> str:
        bullet, other = (".", ")") if node.ordered else ("*", "-")
        differs = bool(self.parents) and self.last_bullet == bullet
        if not node.ordered and any(item.children and item.children[0].type == "thematicBreak" for item in node.children):
            differs = True
        if differs:
            bullet = other
        kept, self.bullet = self.bullet, bullet
        with self.inside("list"):
            self.parents.append(node)
            out: list[str] = []
            for i, item in enumerate(node.children):
                mark = f"{(node.first if node.first is not None else 1) + i}{bullet}" if node.ordered else bullet
                self.last_bullet = ""
                out.append(self._listitem(item, mark))
                if i + 1 < len(node.children):
                    out.append("\n\n" if node.spread else "\n")
            self.parents.pop()
        self.last_bullet, self.bullet = bullet, kept
        return "".join(out)

    def _listitem(self, node: Node, mark: str = "*") -> str:
        with self.inside("listItem"):
            body = self.blocks(node)
        if getattr(node, "checked", None) is not None and node.children and node.children[0].type == "paragraph":
            body = ("[x] " if node.checked else "[ ] ") + body
        lines = body.split("\n")
        pad = " " * (len(mark) + 1)
        first = f"{mark} {lines[0]}" if lines[0] else mark
        return "\n".join([first, *(pad + line if line else "" for line in lines[1:])])

    def _table(self, node: Node) -> str:
        rows = []
        with self.inside("table"):
            for row in node.children:
                with self.inside("tableRow"):
                    rows.append([self._tablecell(c) for c in row.children])
        width = max(map(len, rows), default=0)
        align = list(getattr(node, "align", None) or [])
        marks = {"left": ":-", "right": "-:", "center": ":-:"}
        lines = [self._row(r, width) for r in rows]
        lines.insert(1, self._row([marks.get(align[i] if i < len(align) else None, "-") for i in range(width)], width))
        return "\n".join(lines)

    @staticmethod
    def _row(found: list[str], width: int) -> str:
        return "|" + "|".join(f" {c} " if c else "  " for c in [*found, *[""] * (width - len(found))]) + "|"

    def _tablecell(self, node: Node) -> str:
        with self.inside("tableCell", "phrasing"):
            return self.phrasing(node, "|", "|")

    def _tablerow(self, node: Node) -> str:
        with self.inside("tableRow"):
            return self._row([self._tablecell(c) for c in node.children], len(node.children))


class _Inside:
    def __init__(self, stack: list[str], constructs: tuple[str, ...]):
        self.stack, self.constructs = stack, constructs

    def __enter__(self):
        self.stack.extend(self.constructs)

    def __exit__(self, *_):
        del self.stack[-len(self.constructs) :]


def serialise(node: Node) -> str:
    """The Markdown of a node, with a line ending at its end (none for an empty tree)."""
    s = Serialiser()
    if node.type in PHRASING:
        text = s._loose_inline(node) if node.type != "html" else node.value or ""
    elif node.type == "listItem":
        text = s._listitem(node)
    elif node.type == "tableCell":
        text = s._tablecell(node)
    else:
        text = s.flow(node)
    return text if not text or text.endswith("\n") else text + "\n"


def raw_size(source: str | Node | None) -> int:
    """Length of a text, or of the stretch of source that a node was read from, or else of its Markdown."""
    if not source:
        return 0
    if isinstance(source, str):
        return len(units(source))
    return source.end - source.start if source.start is not None and source.end is not None else len(serialise(source))

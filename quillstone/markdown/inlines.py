"""Inline structure of Markdown: code spans, links, emphasis, autolinks and the rest, with source offsets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from html.entities import html5

from .nodes import MAX_NESTING, Node, plain_text, units

ESCAPABLE = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])|(&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});)")
_ANGLE_URL = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x20]*)>")
_ANGLE_MAIL = re.compile(r"<([a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*)>")
_ATTR = r"""(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_HTML = re.compile(rf"<[A-Za-z][A-Za-z0-9-]*{_ATTR}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)
_FOOTNOTE = re.compile(r"\[\^([^\s\[\]]+)\]")
_SPECIAL = re.compile(r"[\\`*_~\[\]<&@]|(?<=[ \t])\n|!(?=\[)|:(?=//)|[wW](?=[wW]{2}\.)")
_WWW = re.compile(r"www\.[^\s<]*", re.I)
_HTTP = re.compile(r"https?://[^\s<]*", re.I)
_MAIL_BEFORE = re.compile(r"[A-Za-z0-9.+_-]+\Z")
_MAIL_AFTER = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")


def normalise_label(label: str) -> str:
    """The form in which link labels are compared."""
    return " ".join(label.split()).casefold().upper()


def unescape(text: str) -> str:
    """Backslash escapes and character references resolved."""
    if "\\" not in text and "&" not in text:
        return text
    return _ESCAPE.sub(lambda m: m[1] or reference(m[2]), text)


def reference(text: str) -> str:
    """What a character reference stands for; itself if it has no meaning."""
    if text[1] == "#":
        code = int(text[3:-1], 16) if text[2] in "xX" else int(text[2:-1])
        bad = code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or code < 9 or code == 11 or 13 < code < 32 or 126 < code < 160
        made = "�" if bad else chr(code)
    else:
        made = html5.get(text[1:], text)
    return units(made)


class Source:
    """The text of a leaf block, joined from its lines, and where each character was in the document."""

    def __init__(self, lines: list[tuple[str, int]], table: bool = False):
        kept = [(t.lstrip(" \t") if i else t, at + (len(t) - len(t.lstrip(" \t")) if i else 0)) for i, (t, at) in enumerate(lines)]
        if kept:
            last, at = kept[-1]
            kept[-1] = (last.rstrip(" \t"), at)
        self.text = "\n".join(t for t, _ in kept)
        self.starts, self.offsets = [], []
        n = 0
        for t, at in kept:
            self.starts.append(n)
            self.offsets.append(at)
            n += len(t) + 1
        self.removed: list[int] = []
        if table and "\\|" in self.text:  # in a table an escaped pipe is a pipe, even in code
            self.removed = [m.start() - i for i, m in enumerate(re.finditer(r"\\\|", self.text))]
            self.text = self.text.replace("\\|", "|")

    def at(self, pos: int) -> int:
        if self.removed:
            pos += bisect_right(self.removed, pos - 1)
        i = max(0, bisect_right(self.starts, pos) - 1)
        return self.offsets[i] + pos - self.starts[i] if self.offsets else pos


def parse_destination(text: str, i: int) -> tuple[str, int] | None:
    if i < len(text) and text[i] == "<":
        j = i + 1
        while j < len(text) and text[j] not in "<>\n":
            j += 2 if text[j] == "\\" else 1
        return (unescape(text[i + 1 : j]), j + 1) if j < len(text) and text[j] == ">" else None
    depth, j = 0, i
    while j < len(text):
        c = text[j]
        if c == "\\" and j + 1 < len(text) and text[j + 1] in ESCAPABLE:
            j += 2
            continue
        if c in " \t\n" or ord(c) < 32 or c == "\x7f":
            break
        if c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        j += 1
    return None if depth else (unescape(text[i:j]), j)


def parse_title(text: str, i: int) -> tuple[str, int] | None:
    if i >= len(text) or text[i] not in "\"'(":
        return None
    end = ")" if text[i] == "(" else text[i]
    j = i + 1
    while j < len(text) and text[j] != end:
        if text[j] == "(" and end == ")":
            return None
        j += 2 if text[j] == "\\" else 1
    return (unescape(text[i + 1 : j]), j + 1) if j < len(text) else None


def _space(text: str, i: int) -> int:
    """Past white space with at most one line ending."""
    lines = 0
    while i < len(text) and text[i] in " \t\n":
        lines += text[i] == "\n"
        if lines > 1:
            break
        i += 1
    return i


def parse_definition(text: str) -> tuple[str, str, str | None, int] | None:
    """(label, url, title, end) of a link definition at the start of ``text``."""
    m = _LABEL.match(text)
    if not m or not m[1].strip() or not text.startswith(":", m.end()) or m[1].startswith("^"):
        return None
    i = _space(text, m.end() + 1)
    if i >= len(text):
        return None
    found = parse_destination(text, i)
    if not found or found[1] == i:
        return None
    url, after = found
    i = _space(text, after)
    title = parse_title(text, i) if i > after else None
    if title:
        line = re.compile(r"[ \t]*(?:\n|\Z)").match(text, title[1])
        if line:
            return unescape(m[1]), url, title[0], line.end()
    line = re.compile(r"[ \t]*(?:\n|\Z)").match(text, after)
    return (unescape(m[1]), url, None, line.end()) if line else None


def _punctuation(c: str) -> bool:
    return c in ESCAPABLE or (not c.isascii() and unicodedata.category(c)[0] in "PS")


class Inlines:
    """Parses the text of one leaf block. Nodes carry offsets into the block's text until they are mapped at the end."""

    unescape = staticmethod(unescape)

    def __init__(self, source: Source, definitions: dict, footnotes: set):
        self.source, self.text, self.definitions, self.footnotes = source, source.text, definitions, footnotes
        self.out: list[Node] = []
        self.runs: list[dict] = []
        self.brackets: list[dict] = []
        self.late = False

    def parse(self) -> list[Node]:
        text, i = self.text, 0
        while i < len(text):
            m = _SPECIAL.search(text, i)
            if not m:
                self._text(i, len(text))
                break
            j = m.start()
            if j > i:
                self._text(i, j)
            i = self._special(text[j], j)
        self._emphasis(0)
        if self.late:
            self.out = self._literals(self._finish(self.out, False))
        nodes = self._finish(self.out)
        if nodes and nodes[-1].type == "break":
            nodes.pop()
        return nodes

    def _text(self, i: int, j: int, value: str | None = None) -> Node:
        node = Node("text", value=self.text[i:j] if value is None else value, start=i, end=j)
        self.out.append(node)
        return node

    def _special(self, c: str, i: int) -> int:
        text = self.text
        if c == "\n":
            return self._line_end(i)
        if c == "\\":
            if i + 1 < len(text) and text[i + 1] == "\n":
                self.out.append(Node("break", start=i, end=i + 2))
                return i + 2
            if i + 1 < len(text) and text[i + 1] in ESCAPABLE:
                self._text(i, i + 2, text[i + 1])
                return i + 2
        elif c == "`":
            return self._code(i)
        elif c in "*_~":
            return self._run(c, i)
        elif c == "[":
            return self._bracket(i, False)
        elif c == "!":
            if text.startswith("[", i + 1):
                return self._bracket(i, True)
        elif c == "]":
            return self._close_bracket(i)
        elif c == "<":
            return self._angle(i)
        elif c == "&":
            m = _ENTITY.match(text, i)
            if m and (made := reference(m[0])) != m[0]:
                self._text(i, m.end(), made)
                return m.end()
        else:
            end = self._literal(c, i)
            if end:
                return end
        self._text(i, i + 1)
        return i + 1

    def _line_end(self, i: int) -> int:
        j = i
        last = self.out[-1] if self.out else None
        if last is not None and last.type == "text" and last.end == i:
            stripped = last.value.rstrip(" \t")
            trailing = last.value[len(stripped) :]
            if trailing:
                last.value, last.end = stripped, last.end - len(trailing)
                if not stripped:
                    self.out.pop()
                if trailing.endswith("  ") and "\t" not in trailing[-2:]:
                    self.out.append(Node("break", start=last.end if stripped else i - len(trailing), end=i + 1))
                    return i + 1
        self._text(j, j + 1)
        return i + 1

    def _code(self, i: int) -> int:
        text = self.text
        j = i
        while j < len(text) and text[j] == "`":
            j += 1
        size, k = j - i, j
        while (k := text.find("`", k)) >= 0:
            end = k
            while end < len(text) and text[end] == "`":
                end += 1
            if end - k == size:
                value = text[j:k].replace("\n", " ")
                if value[0] == value[-1] == " " and value.strip(" "):
                    value = value[1:-1]
                self.out.append(Node("inlineCode", value=value, start=i, end=end))
                return end
            k = end
        self._text(i, j)
        return j

    def _run(self, c: str, i: int) -> int:
        text, j = self.text, i
        while j < len(text) and text[j] == c:
            j += 1
        before, after = text[i - 1] if i else "\n", text[j] if j < len(text) else "\n"
        space_before, space_after = before.isspace(), after.isspace()
        mark_before, mark_after = _punctuation(before), _punctuation(after)
        left = not space_after and (not mark_after or space_before or mark_before)
        right = not space_before and (not mark_before or space_after or mark_after)
        node = self._text(i, j)
        if c == "~":
            if j - i > 2:
                return j
            can_open, can_close = left, right
        elif c == "_":
            can_open, can_close = left and (not right or mark_before), right and (not left or mark_after)
        else:
            can_open, can_close = left, right
        self.runs.append({"char": c, "node": node, "count": j - i, "size": j - i, "open": can_open, "close": can_close})
        return j

    def _emphasis(self, bottom: int) -> None:
        """Pair the delimiter runs from ``bottom`` on, then forget them.

        Nodes move one by one to ``left``; a run that closes takes what is behind its opener there into a new node, so each
        node is handled about once however long the text is."""
        runs = self.runs[bottom:]
        del self.runs[bottom:]
        if not runs:
            return
        first = self._index(runs[0]["node"])
        pending = self.out[first:]
        del self.out[first:]
        run_of = {id(r["node"]): r for r in runs}
        left: list[Node] = []
        openers: list[dict] = []
        floors: dict[tuple, int] = {}  # openers below these have been tried for such a closer
        for node in pending:
            run = run_of.get(id(node))
            if run is None:
                left.append(node)
                continue
            kind = (run["char"], run["open"], run["size"] if run["char"] == "~" else run["size"] % 3)
            while run["close"] and run["count"]:
                k = next((k for k in range(len(openers) - 1, floors.get(kind, 0) - 1, -1) if self._pairs(openers[k], run)), None)
                if k is None:
                    floors[kind] = len(openers)
                    break
                opener = openers[k]
                use = run["size"] if run["char"] == "~" else 2 if opener["count"] >= 2 and run["count"] >= 2 else 1
                start = opener["node"]
                inner = left[opener["at"] + 1 :]
                height = 1 + max((getattr(n, "height", 0) for n in inner), default=0)
                if height > MAX_NESTING:
                    break
                del left[opener["at"] + 1 :]
                left.append(Node("delete" if run["char"] == "~" else "strong" if use == 2 else "emphasis", inner, start=start.end - use, end=node.start + use, height=height))
                start.value, start.end = start.value[:-use], start.end - use
                node.value, node.start = node.value[use:], node.start + use
                opener["count"] -= use
                run["count"] -= use
                del openers[k + bool(opener["count"]) :]
                floors = {c: min(n, len(openers)) for c, n in floors.items()}
            left.append(node)
            run["at"] = len(left) - 1
            if run["open"] and run["count"]:
                openers.append(run)
        self.out += left

    @staticmethod
    def _pairs(opener: dict, closer: dict) -> bool:
        if opener["char"] != closer["char"]:
            return False
        if closer["char"] == "~":
            return opener["size"] == closer["size"]
        # runs that could do both pair only if their lengths do not add up to a multiple of three, or both are one
        odd = (opener["close"] or closer["open"]) and (opener["size"] + closer["size"]) % 3 == 0
        return not odd or (opener["size"] % 3 == 0 and closer["size"] % 3 == 0)

    def _index(self, node: Node) -> int:
        return next(k for k in range(len(self.out) - 1, -1, -1) if self.out[k] is node)

    def _bracket(self, i: int, image: bool) -> int:
        text = self.text
        if not image and text.startswith("^", i + 1) and (m := _FOOTNOTE.match(text, i)) and normalise_label(m[1]) in self.footnotes:
            self.out.append(Node("footnoteReference", label=m[1], identifier=m[1].lower(), start=i, end=m.end()))
            return m.end()
        size = 2 if image else 1
        node = self._text(i, i + size)
        self.brackets.append({"node": node, "image": image, "runs": len(self.runs), "active": True, "after": i + size})
        return i + size

    def _close_bracket(self, i: int) -> int:
        if not self.brackets:
            self._text(i, i + 1)
            return i + 1
        opener = self.brackets.pop()
        if not opener["active"]:
            self._text(i, i + 1)
            return i + 1
        found = self._resource(i + 1)
        fields: dict = {}
        if found:
            fields, end = {"url": found[0], "title": found[1]}, found[2]
        else:
            inner = self.text[opener["after"] : i]
            m = _LABEL.match(self.text, i + 1)
            label, kind, end = inner, "shortcut", i + 1
            if m:
                kind, end = ("full", m.end()) if m[1].strip() else ("collapsed", m.end())
                label = m[1] if kind == "full" else inner
                if kind == "collapsed" and m[1]:
                    kind, end, label = "shortcut", i + 1, inner
            key = normalise_label(label)
            nested = kind != "full" and re.search(r"(?<!\\)[\[\]]", inner)
            if not key or key not in self.definitions or nested or len(label) > 999:
                self._text(i, i + 1)
                return i + 1
            fields = {"label": unescape(label), "identifier": " ".join(label.split()).lower(), "kind": kind}
        a = self._index(opener["node"])
        self._emphasis(opener["runs"])
        children = self.out[a + 1 :]
        start = opener["node"].start
        if opener["image"]:
            alt = "".join(map(plain_text, children))
            node = Node("image" if found else "imageReference", alt=alt, start=start, end=end, **fields)
        else:
            height = 1 + max((getattr(n, "height", 0) for n in children), default=0)
            node = Node("link" if found else "linkReference", self._finish(children, False), start=start, end=end, height=height, **fields)
            for b in self.brackets:
                if not b["image"]:
                    b["active"] = False
        self.out[a:] = [node]
        return end

    def _resource(self, i: int) -> tuple[str, str | None, int] | None:
        """(url, title, end) of ``(url "title")``."""
        text = self.text
        if not text.startswith("(", i):
            return None
        j = _space(text, i + 1)
        if text.startswith(")", j):
            return "", None, j + 1
        found = parse_destination(text, j)
        if not found:
            return None
        url, j = found
        k = _space(text, j)
        title = None
        if k > j and (got := parse_title(text, k)):
            title, k = got
            k = _space(text, k)
        return (url, title, k + 1) if text.startswith(")", k) else None

    def _angle(self, i: int) -> int:
        text = self.text
        for pattern, prefix in ((_ANGLE_URL, ""), (_ANGLE_MAIL, "mailto:")):
            if m := pattern.match(text, i):
                inner = Node("text", value=m[1], start=i + 1, end=m.end() - 1)
                self.out.append(Node("link", [inner], url=prefix + m[1], title=None, start=i, end=m.end()))
                return m.end()
        if m := _HTML.match(text, i):
            self.out.append(Node("html", value=m[0], start=i, end=m.end()))
            return m.end()
        self._text(i, i + 1)
        return i + 1

    # -- autolink literals

    def _literal(self, c: str, i: int) -> int | None:
        text = self.text
        if self.brackets:  # perhaps inside a link; what is not is found at the end
            self.late = True
            return None
        if c in "wW":
            before = text[i - 1] if i else ""
            if before and not (before.isspace() or before in "*_~([]"):
                return None
            m = _WWW.match(text, i)
            return self._autolink(i, m, "http://") if m and self._domain(text[i : m.end()], True) else None
        if c == ":":
            for scheme in ("https", "http"):
                start = i - len(scheme)
                if start >= 0 and text[start:i].lower() == scheme and text.startswith("//", i + 1):
                    before = text[start - 1] if start else ""
                    if before and before.isalpha():
                        continue
                    m = _HTTP.match(text, start)
                    if m and self._domain(text[i + 3 : m.end()], False) and self._take_back(start, i):
                        return self._autolink(start, m, "")
            return None
        before = _MAIL_BEFORE.search(text, 0, i)
        after = _MAIL_AFTER.match(text, i + 1)
        if not before or not after:
            return None
        end = after.end()
        while end > i and not (text[end - 1].isalnum()):
            end -= 1
        if end <= i + 1 or "." not in text[i + 1 : end] or text[end - 1] in "-_" or text[end - 1].isdigit():
            return None
        start = before.start()
        if start and text[start - 1] == "/":
            return None
        if not self._take_back(start, i):
            return None
        body = text[start:end]
        self.out.append(Node("link", [Node("text", value=body, start=start, end=end)], url="mailto:" + body, title=None, start=start, end=end))
        return end

    def _take_back(self, start: int, i: int) -> bool:
        """Cut the text nodes already made for [start, i), if nothing else was."""
        k = len(self.out)
        while k and self.out[k - 1].start >= start:
            k -= 1
            if self.out[k].type != "text" or self.out[k].value != self.text[self.out[k].start : self.out[k].end]:
                return False
        if k and self.out[k - 1].end > start:
            node = self.out[k - 1]
            if node.type != "text" or len(node.value) != node.end - node.start:
                return False
            node.value, node.end = node.value[: start - node.start], start
            if not node.value:
                k -= 1
        gone = self.out[k:]
        del self.out[k:]
        if gone:
            self.runs = [r for r in self.runs if not any(r["node"] is g for g in gone)]
            self.brackets = [b for b in self.brackets if not any(b["node"] is g for g in gone)]
        return True

    @staticmethod
    def _domain(text: str, www: bool) -> bool:
        """A domain: labels of letters, digits, hyphens, underscores (none in the last two), with a dot after www."""
        m = re.match(r"[^\s<!\"#$%&'()*+,/:;=?@\[\\\]^`{|}~]+", text)
        if not m:
            return False
        domain = m[0].rstrip(".")
        labels = domain.split(".")
        return bool(domain) and (len(labels) > 1 or not www) and not any("_" in x for x in labels[-2:])

    def _autolink(self, start: int, m: re.Match, prefix: str) -> int:
        body = m[0]
        while body:
            if body[-1] in "!\"'),.:;?*_~]":
                if body[-1] == ")" and body.count(")") <= body.count("("):
                    break
                body = body[:-1]
            elif body[-1] == ";" or (tail := re.search(r"&[A-Za-z0-9]+;\Z", body)):
                body = body[: tail.start()]
            else:
                break
        end = start + len(body)
        self.out.append(Node("link", [Node("text", value=body, start=start, end=end)], url=prefix + body, title=None, start=start, end=end))
        return end

    def _literals(self, nodes: list[Node]) -> list[Node]:
        """Autolink literals in texts that turned out not to be inside a link."""
        out: list[Node] = []
        for n in nodes:
            if n.children is not None and n.type not in ("link", "linkReference"):
                n.children = self._literals(n.children)
            if n.type != "text" or n.value != self.text[n.start : n.end]:
                out.append(n)
                continue
            inner = Inlines(Source([]), {}, set())
            inner.text, i = self.text[: n.end], n.start
            while i < n.end and (m := re.compile(r"@|:(?=//)|[wW](?=[wW]{2}\.)").search(inner.text, i)):
                if m.start() > i:
                    inner._text(i, m.start())
                end = inner._literal(m[0], m.start())
                if not end:
                    inner._text(m.start(), m.start() + 1)
                i = end or m.start() + 1
            inner._text(i, n.end)
            out += inner.out
        return out

    # -- finishing

    def _finish(self, nodes: list[Node], last: bool = True) -> list[Node]:
        """Merge neighbouring texts; with ``last``, also map offsets to the document."""
        out: list[Node] = []
        for n in nodes:
            if n.type == "text":
                if not n.value:
                    continue
                if out and out[-1].type == "text":
                    out[-1].value += n.value
                    out[-1].end = n.end
                    continue
            elif n.children is not None:
                n.children = self._finish(n.children, False)
            out.append(n)
        if last:
            self._map(out)
        return out

    def _map(self, nodes: list[Node]) -> None:
        at = self.source.at
        for n in nodes:
            n.start, n.end = at(n.start), at(n.end - 1) + 1 if n.end > n.start else at(n.end)
            if n.children is not None:
                self._map(n.children)

"""Splitting text at scored boundaries: sentences before clauses before words, balanced halves before lopsided ones."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from .blocks import parse
from .nodes import Node, content_size, walk
from .options import Options
from .positions import plain_map
from .serialise import serialise

#: White space as ECMAScript has it, boundary weights, and penalties for boundaries inside an element.
SPACE = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SENTENCE, CLAUSE, COMMA, DASH, FALLBACK, WORD_PUNCTUATION, CHARACTER = 100, 70, 40, 30, 10, 5, 1
PENALTIES = {"link": 50, "linkReference": 50, "image": 50, "imageReference": 50, "inlineCode": 50, "emphasis": 30, "strong": 30, "delete": 30}
#: The kinds of boundaries; a boundary is the end of a match in the plain text.
PATTERNS = [
    ("period_newline", SENTENCE, re.compile(r"\.(?=\n)")),
    ("period_sentence", SENTENCE, re.compile(rf"[.?!]+[{SPACE}]+(?=[A-Z])")),
    ("question_exclamation", SENTENCE, re.compile(rf"[?!]+(?=[{SPACE}]|\Z)")),
    ("colon_semicolon", CLAUSE, re.compile(rf"[:;](?=[{SPACE}])")),
    ("bracket_pairs", CLAUSE, re.compile(r"\([^)]*\)[.?!]?|\[[^\]]*\][.?!]?|\{[^}]*\}[.?!]?")),
    ("quote_pairs", CLAUSE, re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`|´[^´]*´")),
    ("line_break", CLAUSE, re.compile(r"\n")),
    ("comma", COMMA, re.compile(rf",(?=[{SPACE}])")),
    ("dashes", DASH, re.compile(rf"[{SPACE}][–—-][{SPACE}]")),
    ("period_fallback", FALLBACK, re.compile(r"\.")),
    ("whitespace", FALLBACK, re.compile(rf"[{SPACE}]+")),
]
_LIST_MARKER = re.compile(rf"[{SPACE}]*(?:[0-9]+|[A-Za-z]+)")
_WORD = re.compile(rf"[^{SPACE}]+")
_WORD_PUNCTUATION = frozenset("-/._:")
#: Anything that could make a fragment more than lines of text; without it, a fragment need not be parsed to be measured.
_MARKUP = re.compile(r"[\\`*_~\[\]<&@|#>=\t\r\0\v\f]|://|[wW]{3}\.|\n *\n|  \n|^ *(?:[-+:]|[0-9]{1,9}[.)])|^ {4}", re.M)
_OPENING = re.compile(r"\n* {4}|[ \n]*(?:[-+:]|[0-9]{1,9}[.)])")
#: What the serialiser would escape in a text without any of the above.
_ESCAPED = re.compile(r"&[#A-Za-z]|[Ww]\.[-.\w]|[ps]:/", re.A)

#: A flat list, with an item a line that starts with a letter and ends in no blank, and what would make more than text of an item.
_PLAIN_LIST = re.compile(r"(?:[0-9]{1,9}(?P<end>[.)])|(?P<bullet>[-+])) [^\W\d_](?:[^\n]*[^ \n])?(?:\n(?:[0-9]{1,9}(?P=end)|(?P=bullet)) [^\W\d_](?:[^\n]*[^ \n])?)*\n*\Z")
_IN_ITEM = re.compile(r"[\\`*_~\[\]<&@|#>=\t\r\0\v\f]|://|[wW]{3}\.|[Ww]\.[-.\w]|[ps]:/", re.A)


class Range(NamedTuple):
    start: int
    end: int
    type: str
    penalty: float


class Boundary(NamedTuple):
    md: int
    plain: int
    type: str
    weight: int
    score: float


def fragment_size(text: str) -> int:
    """Content size of a piece of Markdown, as it reads on its own."""
    if not text:
        return 0
    if _MARKUP.search(text):
        return content_size(parse(text))
    return len("\n".join(line.strip(" ") for line in text.strip(" \n").split("\n"))) if "\n" in text else len(text.strip(" "))


def balance_bonus(first: float, second: float) -> int:
    """0 for nothing, up to 20 for equal halves (below 0 if a half is negative); halves round up."""
    total = first + second
    return math.floor(min(first, second) / total * 40 + 0.5) if total else 0


def merge_ranges(ranges: list[Range]) -> list[Range]:
    """Overlapping ranges as one, with the highest penalty and the first one's type."""
    out: list[Range] = []
    for r in sorted(ranges, key=lambda r: r.start):
        if out and r.start < out[-1].end:
            last = out[-1]
            out[-1] = Range(last.start, max(last.end, r.end), last.type, max(last.penalty, r.penalty))
        else:
            out.append(r)
    return out


def clip_ranges(ranges: list[Range], start: int, end: int) -> list[Range]:
    """The parts of the ranges inside [start, end), counted from its start."""
    return [Range(max(r.start, start) - start, min(r.end, end) - start, r.type, r.penalty) for r in ranges if r.start < end and r.end > start]


def penalised_ranges(tree: Node, options: Options) -> list[Range]:
    """Where boundaries cost something: inside links, images, code and formatting; without bound if they may not be split."""
    found = []
    for node in walk(tree):
        if node.start is None or node.type == "root":
            continue
        if not options.splittable(node.type, lambda n=node: content_size(n)):
            found.append(Range(node.start, node.end, node.type, math.inf))
        elif node.type in PENALTIES:
            found.append(Range(node.start, node.end, node.type, PENALTIES[node.type]))
    return merge_ranges(found)


def score_boundary(position: int, weight: float, ranges: list[Range]) -> float:
    """The weight less the highest penalty of the ranges that the position is strictly inside of."""
    return weight - max((r.penalty for r in ranges if r.start < position < r.end), default=0)


def _sentence_ends(pattern: re.Pattern, plain: str):
    """Matches not behind a list marker at the very start; a refused match is tried again one character on."""
    at = 0
    while m := pattern.search(plain, at):
        if _LIST_MARKER.fullmatch(plain, 0, m.start()):
            at = m.start() + 1
        else:
            yield m.end()
            at = m.end()


def pattern_ends(plain: str):
    """(type, weight, end) of every match of every pattern, in the patterns' order."""
    for name, weight, pattern in PATTERNS:
        ends = _sentence_ends(pattern, plain) if name == "period_sentence" else (m.end() for m in pattern.finditer(plain))
        for end in ends:
            yield name, weight, end


def word_ends(plain: str, options: Options):
    """Boundaries inside words, if the word rule lets them be split: behind punctuation, or anywhere in ones too long."""
    rule = options.rules.get("word")
    if rule is None or rule.split not in ("allow-split", "size-split"):
        return
    least = (rule.size or 0) if rule.split == "size-split" else 0
    for m in _WORD.finditer(plain):
        size = m.end() - m.start()
        if size <= least:
            continue
        anywhere = size > max(least, options.limit)
        for at in range(m.start() + 1, m.end()):
            if plain[at - 1] in _WORD_PUNCTUATION:
                yield "word_punct", WORD_PUNCTUATION, at
            elif anywhere:
                yield "character", CHARACTER, at


def boundaries(tree: Node, markdown: str, options: Options) -> tuple[list[Boundary], int]:
    """All boundaries that may be used, best score first, and the length of the plain text."""
    mapping, ranges = plain_map(tree, markdown), penalised_ranges(tree, options)
    locate = mapping.locate if not mapping.literal() else int
    starts = [r.start for r in ranges]  # ranges do not overlap: at most one is around a position
    found = []
    for name, weight, plain in (*pattern_ends(mapping.plain), *word_ends(mapping.plain, options)):
        md = locate(plain)
        near = bisect_left(starts, md)
        score = score_boundary(md, weight, ranges[near - 1 : near]) if near else weight
        if score > -math.inf:
            found.append(Boundary(md, plain, name, weight, score))
    return sorted(found, key=lambda b: (-b.score, b.md)), len(mapping.plain)


def _cuts(text: str, table: np.ndarray, size: float, limit: float, measure: Callable[[str], int] = fragment_size):
    """Pieces of a text: cut at the best boundary, then what is still too large at boundaries of no greater weight.

    ``table`` has a row (md, plain, weight, score) for each boundary, best score first."""
    table = table[:, np.argsort(table[0], kind="stable")]  # a stretch's boundaries are a slice; of one place the best comes first
    left = [(0, len(text), 0, size, table)]  # base: the plain position that a stretch's plain positions count from
    while left:
        low, high, base, size, table = left.pop()
        if size > limit:
            i, j = table[0].searchsorted(low, "right"), table[0].searchsorted(high, "left")
        if size <= limit or i >= j:
            yield text[low:high]
            continue
        inside = table[:, i:j]
        first = inside[1] - base
        total = inside[3] + np.floor(np.minimum(first, size - first) / size * 40 + 0.5)
        equals = (total == total.max()).nonzero()[0]
        md, plain, weight, _ = inside[:, equals[inside[3, equals].argmax()] if len(equals) > 1 else equals[0]].tolist()  # of equals the best score, then the first
        lower = inside[2] <= weight
        table, md = inside if lower.all() else inside[:, lower], int(md)
        left.append((md, high, plain, measure(text[md:high]), table))
        left.append((low, md, base, measure(text[low:md]), table))


def plain_paragraph(text: str) -> str | None:
    """A document that is one paragraph of plain text, in normal form; None if it may be more (or is blank)."""
    if _MARKUP.search(text) or _ESCAPED.search(text):
        return None
    body = text.strip(" \n")
    if "\n" in body:
        body = "\n".join(line.strip(" ") for line in body.split("\n"))
    return body if body.strip() else None


def plain_list(text: str) -> tuple[int | None, list[str]] | None:
    """The first number (None: bullets) and the items of a document that is one flat list of plain texts; None if it may be
    something else."""
    if not text or text[0] not in "0123456789-+" or not (m := _PLAIN_LIST.match(text)) or _IN_ITEM.search(text):
        return None
    lines = text.rstrip("\n").split("\n")
    return None if m["bullet"] else int(lines[0].split(m["end"], 1)[0]), [line.split(" ", 1)[1] for line in lines]


def _plain_size(part: str) -> int:
    """``fragment_size`` of a piece of a plain paragraph: only its start can read as something else than text."""
    return fragment_size(part) if _OPENING.match(part) else len(part.strip(" \n"))


def split_plain(body: str, options: Options) -> list[str]:
    """``split_text`` of a plain paragraph, without making a tree of it."""
    ends, weights = [], []
    for name, weight, pattern in PATTERNS:
        found = list(_sentence_ends(pattern, body)) if name == "period_sentence" else [m.end() for m in pattern.finditer(body)]
        ends += found
        weights += [weight] * len(found)
    for _, weight, end in word_ends(body, options):
        ends.append(end)
        weights.append(weight)
    at, weight = np.array(ends, float), np.array(weights, float)
    order = np.lexsort((at, -weight))
    at, weight = at[order], weight[order]
    return list(_cuts(body + "\n", np.array([at, at, weight, weight]), len(body), options.limit, _plain_size))


def split_text(node: Node, options: Options) -> list[str]:
    """The Markdown of ``node`` in pieces whose content fits, where boundaries allow; pieces are not trimmed."""
    markdown = serialise(node)
    tree = parse(markdown)
    found, size = boundaries(tree, markdown, options)
    table = np.array([(b.md, b.plain, b.weight, b.score) for b in found], float).reshape(-1, 4).T
    return list(_cuts(markdown, table, size, options.limit))


__all__ = ["Boundary", "Range", "balance_bonus", "boundaries", "clip_ranges", "fragment_size", "merge_ranges", "pattern_ends", "penalised_ranges", "plain_list", "plain_paragraph", "split_plain", "score_boundary", "split_text", "word_ends"]

"""Options of the chunker: sizes, and for each kind of element how it may be split, styled and transformed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from enum import Enum

FORMATTING = ("strong", "emphasis", "delete")
#: The kinds of elements that rules are given for.
KINDS = ("link", "image", *FORMATTING, "formatting", "list", "table", "blockquote", "code", "inlineCode", "heading", "word")
NEVER, ALLOW, BY_SIZE = "never-split", "allow-split", "size-split"


@dataclass(frozen=True)
class Rule:
    """``split``: never-split, allow-split, size-split (then ``size``: only larger ones) or None; ``style``: inline,
    preserve or None (links and images); ``transform``: (node, parent, index, root) -> node, None to keep, ``REMOVE``."""

    split: str | None = None
    size: int | None = None
    style: str | None = None
    transform: Callable | None = None



class Removal(Enum):
    """What a transform returns to remove its node (an enum, so that it stays itself on its way to a worker)."""

    REMOVE = "remove"


REMOVE = Removal.REMOVE

#: The default rules.
DEFAULT_RULES: Mapping[str, Rule] = {"link": Rule(NEVER, style="inline"), "image": Rule(NEVER, style="inline"), "word": Rule(NEVER)}


def rule_of(value) -> Rule:
    """A rule from a ``Rule``, the name of a split rule, or a mapping with split (a name or {rule, size}), style, transform."""
    if isinstance(value, Rule):
        return value
    if isinstance(value, str):
        return Rule(value)
    split, size = value.get("split"), value.get("size")
    if isinstance(split, Mapping):
        split, size = split["rule"], split.get("size")
    return Rule(split, size, value.get("style"), value.get("transform"))


@dataclass(frozen=True)
class Options:
    """``chunk_size`` limits the plain text of a chunk, times ``max_overflow_ratio`` (1 at least); ``max_raw_size`` limits its
    Markdown. Given rules replace the default ones altogether; ``rules={}`` means no rules."""

    chunk_size: float
    max_overflow_ratio: float | None = None
    max_raw_size: int | None = None
    rules: Mapping[str, object] = field(default_factory=lambda: dict(DEFAULT_RULES))

    def __post_init__(self):
        object.__setattr__(self, "max_overflow_ratio", max(1.0, self.max_overflow_ratio if self.max_overflow_ratio is not None else 1.0))
        rules = dict(DEFAULT_RULES) if self.rules is None else {k: rule_of(v) for k, v in self.rules.items() if v}
        unknown = set(rules) - set(KINDS)
        if unknown:
            raise ValueError(f"no such rules: {sorted(unknown)}")
        object.__setattr__(self, "rules", rules)
        if self.max_raw_size is not None and self.max_raw_size < 1:
            raise ValueError("max_raw_size must be 1 or more")

    @property
    def limit(self) -> float:
        """The most plain text a chunk may hold."""
        return self.chunk_size * self.max_overflow_ratio

    def rule(self, kind: str) -> Rule | None:
        """The rule with a say in splitting ``kind``; strong, emphasis and delete fall back to formatting."""
        own = self.rules.get(kind)
        if (own is None or own.split is None) and kind in FORMATTING:
            own = self.rules.get("formatting")
        return own if own is not None and own.split is not None else None

    def splittable(self, kind: str, size: Callable[[], int]) -> bool:
        """Whether an element of this kind, whose content size ``size`` gives, may be split."""
        rule = self.rule(kind)
        if rule is None or rule.split == ALLOW:
            return True
        return rule.split == BY_SIZE and size() > (rule.size or 0)

"""Column functions: measures and scores on built-in functions, and Arrow-batched ones that parse Markdown."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..markdown import chunking, positions, serialise, textsplit
from ..markdown.blocks import parse
from ..markdown.nodes import from_units, units
from ..markdown.nodes import plain_text as tree_text
from ..markdown.options import Options

#: ECMAScript white space as a Java character class.
JS_SPACE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

BLANK = "".join(sorted(chunking.BLANK))


def raw_size(text: Column) -> Column:
    """Length in UTF-16 units; null counts as 0."""
    return F.coalesce((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"), F.lit(0))


def trim(text: Column) -> Column:
    """Without ECMAScript white space at either end."""
    return F.trim(text, F.lit(BLANK))


def balance_bonus(first: Column, second: Column) -> Column:
    """0 if there is nothing, up to 20 for equal halves; halves round up."""
    total = first + second
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(F.least(first, second) / total * 40 + 0.5)).cast("int")


def score_boundary(position: Column, weight: Column, ranges: Column) -> Column:
    """``weight`` less the highest penalty of the ranges (structs of start, end, penalty) strictly around ``position``."""
    around = F.filter(ranges, lambda r: (position > r["start"]) & (position < r["end"]))
    return weight - F.coalesce(F.array_max(F.transform(around, lambda r: r["penalty"].cast("double"))), F.lit(0.0))


#: Stands for the second unit of a character beyond the basic plane while such a text is cut (a noncharacter of Unicode).
_SECOND = "\ufdd0"


def raw_cap(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` UTF-16 units, cut at the last white space of a piece's final fifth if there is any, with
    built-in functions, in steps in proportion to the text. Null stays null; a text without pieces gives an empty array.

    One pattern reads piece after piece: all of what is left if that is short enough, else up to such white space (which is
    skipped), else a full piece. Characters of two units are read as themselves and a mark that no piece begins with."""
    if most < 1:
        raise ValueError("the limit must be 1 or more")
    if most < 6:  # less than two places to look for white space at
        return raw_cap_units(text, F.lit(most))
    soft = int(most * 0.8)
    full = [f".{{{most}}}(?!{_SECOND})", f".{{{most - 1}}}(?!{_SECOND})"]
    pattern = "|".join([f".{{1,{most}}}\\z", f".{{{soft},{most - 1}}}{JS_SPACE}+", *full])
    wide = "[\\x{10000}-\\x{10FFFF}]"
    marked = F.when(text.rlike(wide), F.regexp_replace(text, f"({wide})", f"$1{_SECOND}")).otherwise(text)
    read = lambda t: F.regexp_extract_all(t, F.lit(f"(?s)(?:{pattern})"), F.lit(0))
    # from the first cut at white space on, what is left has none at its end; without such a cut it stays as it is
    shorter = _bound(read(F.rtrim(marked, F.lit(BLANK))), lambda found: F.when(F.exists(found, lambda m: m.rlike(f"{JS_SPACE}\\z")), found))
    return _bound(F.coalesce(shorter, read(marked)), _pieces(most))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(most: int) -> Callable[[Column], Column]:
    """Cut pieces are trimmed and dropped if empty; the rest after the last cut is neither, but for white space at its end
    after a cut at white space."""

    def shown(found: Column) -> Column:
        rest = lambda m, i: (i == F.size(found) - 1) & (F.char_length(m) <= most)
        spaced = F.exists(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda m: m.rlike(f"{JS_SPACE}\\z"))
        ended = lambda m: F.when(spaced, F.rtrim(m, F.lit(BLANK))).otherwise(m)
        made = F.transform(found, lambda m, i: F.replace(F.when(rest(m, i), ended(m)).otherwise(trim(m)), F.lit(_SECOND), F.lit("")))
        return F.filter(made, lambda m: m != "")

    return shown


@F.pandas_udf(T.IntegerType())
def content_size(text: pd.Series) -> pd.Series:
    """Length of the text a reader sees, in UTF-16 units; null counts as 0."""
    return text.map(lambda t: textsplit.fragment_size(units(t)) if t else 0).astype("int32")


@F.pandas_udf(T.StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """What a reader sees, without markup; null stays null."""
    return text.map(lambda t: None if t is None else from_units(tree_text(parse(units(t)))))


@F.pandas_udf(T.StringType())
def normalise(text: pd.Series) -> pd.Series:
    """Markdown in normal form; null stays null."""
    return text.map(lambda t: None if t is None else from_units(serialise.serialise(parse(units(t)))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def raw_cap_units(text: pd.Series, most: pd.Series) -> pd.Series:
    """``raw_cap`` for any text, counting UTF-16 units; null stays null."""
    return pd.Series([None if t is None else [from_units(p) for p in chunking.cap(units(t), int(n))] for t, n in zip(text, most)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("weight", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def pattern_boundaries(text: pd.Series) -> pd.Series:
    """The boundaries of every pattern in a plain text."""
    return text.map(lambda t: [{"type": n, "weight": w, "end": e} for n, w, e in textsplit.pattern_ends(units(t or ""))])


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def pattern_counts(text: pd.Series) -> pd.Series:
    """How many boundaries of each kind a plain text has; kinds that it has none of are left out."""
    return text.map(lambda t: dict(Counter(n for n, _, _ in textsplit.pattern_ends(units(t or "")))))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("penalty", T.DoubleType())])))
def penalised_ranges(text: pd.Series) -> pd.Series:
    """The merged ranges inside which a cut costs something, without rules."""
    options = Options(1, rules={})
    return text.map(lambda t: [{"type": r.type, "start": r.start, "end": r.end, "penalty": float(r.penalty)} for r in textsplit.penalised_ranges(parse(units(t or "")), options)])


@F.pandas_udf(T.IntegerType())
def markdown_position(text: pd.Series, plain: pd.Series) -> pd.Series:
    """The Markdown position of a position in the plain text."""
    return pd.Series([None if t is None or p is None else positions.plain_map(parse(units(t)), units(t)).locate(int(p)) for t, p in zip(text, plain)])

"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every five-word shingle is hashed once; the hash's high bits name one of ``BINS`` bins and each bin keeps its least hash.
An empty bin draws bins by hashing (bin, attempt) until it meets one that is filled and copies that: uniform over the filled
bins, independent for each empty bin and the same in two documents as long as they meet filled bins alike (optimal
densification). The fingerprint packs the ``BITS`` low-order bits of each bin; likeness is the share of equal bins,
corrected for the chance of 2^-BITS that different values agree.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import lowest

SHINGLE, BINS, BITS = 5, 128, 8
#: Draws of an empty bin, after which (with few bins filled) the filled bin of least hash with it is taken.
DRAWS = 24
#: Rows that one range of ids should hold, the most ranges (each is a task's worth of the ordered pass), rows looked at for
#: the bounds of a range, and how many of the bounds are looked at together.
ROWS_PER_RANGE, MAX_RANGES, SAMPLE_PER_RANGE, BOUNDS_BLOCK = 4000, 1 << 16, 16, 256

_SHIFT = 64 - (BINS - 1).bit_length()


def _bin(h: Column) -> Column:
    """The bin of a hash, ascending with the (signed) hash."""
    return F.shiftright(h, _SHIFT).cast("int") + BINS // 2


def with_bins(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the ``BITS`` low-order bits of each bin of ``text`` (signed) in column ``name``; none without words.

    A text of fewer than five words is one shingle. Null counts as empty. Equal texts have equal bins.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    df = df.select(*kept, words.alias("_w"))
    n = F.size("_w")
    shingles = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(SHINGLE)]))
    hashes = F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64(F.array_join("_w", " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*kept, F.sort_array(hashes).alias("_h"))
    least = F.filter("_h", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("_h", i - 1))))
    df = df.select(*kept, F.when(F.size("_h") > 0, least).otherwise(F.col("_h")).alias("_m"))
    # all bins in order, empty ones null: before each least hash as many nulls as bins were passed over
    none = F.lit(None).cast("bigint")
    before = lambda i: F.coalesce(_bin(F.get("_m", i - 1)), F.lit(-1))
    filled = F.transform("_m", lambda m, i: F.concat(F.array_repeat(none, _bin(m) - before(i) - 1), F.array(m)))
    spread = F.flatten(F.concat(filled, F.array(F.array_repeat(none, BINS - 1 - before(F.size("_m"))))))
    df = df.select(*kept, "_m", spread.alias("_d"))

    def value(own: Column, k: Column) -> Column:
        drawn = [F.get("_d", F.xxhash64(k, F.lit(attempt)).bitwiseAND(BINS - 1).cast("int")) for attempt in range(DRAWS)]
        nearest = F.array_min(F.transform("_m", lambda m: F.struct(F.xxhash64(k, _bin(m)).alias("r"), m.alias("m"))))["m"]
        return F.coalesce(own, *drawn, nearest)

    low = F.transform("_d", lambda d, k: (value(d, k).bitwiseAND((1 << BITS) - 1) - (1 << (BITS - 1))).cast("tinyint"))
    return df.select(*kept, F.when(F.size("_m") > 0, low).otherwise(F.array().cast("array<tinyint>")).alias(name))


def packed(bins: Column) -> Column:
    """The fingerprint that ``bins`` make: 2 hex digits a bin, or "" for a text without words."""
    digits = F.split(F.lit(",".join(f"{b:02x}" for b in range(1 << BITS))), ",")
    return F.array_join(F.transform(bins, lambda b: F.get(digits, b.cast("int") + (1 << (BITS - 1)))), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` in column ``name``; see ``with_bins`` and ``packed``."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return with_bins(df, text, "_bins").select(*kept, packed(F.col("_bins")).alias(name))


def unpacked(fingerprint: Column) -> Column:
    """The bins of a fingerprint."""
    step = BITS // 4
    digits = F.sequence(F.lit(1), F.length(fingerprint) - step + 1, F.lit(step))
    read = F.transform(digits, lambda i: (F.conv(F.substring(fingerprint, i, F.lit(step)), 16, 10).cast("int") - (1 << (BITS - 1))).cast("tinyint"))
    return F.when(fingerprint != "", read).otherwise(F.array().cast("array<tinyint>"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two texts by their bins, 0 to 1; two texts without words are alike."""
    chance = 2.0**-BITS
    share = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)).cast("double") / BINS
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def _order(column: str, kind: T.DataType) -> Column:
    """What ids are ordered by: whole numbers as such, all others as text."""
    return F.col(column).cast("long" if isinstance(kind, T.IntegralType) else "string")


def _places(values: list, kind: str) -> Column:
    """A constant array of places, from one literal however long it is."""
    return F.from_json(F.lit(json.dumps([None if v is None else {"k": v[0], "h": v[1]} for v in values])), f"array<struct<k:{kind},h:bigint>>")


def _count_below(x: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending ``cuts`` are less than ``x``: first whole blocks of them, then within one."""
    if not cuts:
        return F.lit(0)
    blocks = F.size(F.filter(_places(cuts[BOUNDS_BLOCK - 1 :: BOUNDS_BLOCK], kind), lambda c: c < x))
    return blocks * BOUNDS_BLOCK + F.size(F.filter(F.slice(_places(cuts, kind), blocks * BOUNDS_BLOCK + 1, BOUNDS_BLOCK), lambda c: c < x))


def with_next(df: DataFrame, key: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows in descending ``key`` order (after the last: the first).

    Whole-number keys are ordered as such, all others as text. Null keys come last; rows of equal key follow each other in
    order of a hash of the column ``tie`` (the first of ``columns``, if not given), the only other column that the passes
    for the ranges' bounds compute. Rows are placed by key and hash, and ranges of places are handled apart: each gets a
    copy of the row that follows its last one, so nothing is ordered in one task, not even the rows of one key, and rows
    are shuffled once. (Only rows equal in key and ``tie`` have one place and stay together.)
    """
    kind = "bigint" if isinstance(df.schema[key].dataType, T.IntegralType) else "string"
    df = df.withColumn("_k", F.struct(_order(key, df.schema[key].dataType).alias("k"), F.xxhash64(tie or columns[0]).alias("h")))
    n = df.select(key).count()
    ranges = max(1, min(MAX_RANGES, ceil(n / ROWS_PER_RANGE)))
    comparable = (lambda k: k) if kind == "bigint" else str.encode  # Spark compares the bytes of strings
    place = lambda r: (r["k"] is not None, r["k"] is not None and comparable(r["k"]), r["h"])
    cuts: list = []
    if ranges > 1:
        # places by a hash, some SAMPLE_PER_RANGE * ranges of them, each once however many rows have it
        few = df.select("_k").where(lowest(F.xxhash64("_k"), SAMPLE_PER_RANGE * ranges / n)).distinct().select("_k.k", "_k.h").collect()
        drawn = sorted(few, key=place)
        cuts = [(drawn[at]["k"], drawn[at]["h"]) for at in sorted({i * len(drawn) // ranges for i in range(1, ranges)})] if drawn else []
    df = df.withColumn("_range", _count_below(F.col("_k"), cuts, kind))
    # one row a range: bounded
    heads = sorted(((r["_range"], r["head"]) for r in df.groupBy("_range").agg(F.max("_k").alias("head")).collect()), key=lambda r: r[0])
    head, above = [None] * (len(cuts) + 1), [-1] * (len(cuts) + 1)
    for (r, k), following in zip(heads, [*heads[1:], None]):
        head[r], above[r] = (k["k"], k["h"]), following[0] if following else heads[0][0]  # the last one's head follows the very last row
    numbers = F.split(F.lit(",".join(map(str, above))), ",").cast("array<int>")
    here = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy"))
    there = F.struct(F.get(numbers, F.col("_range")).alias("r"), F.lit(1).alias("copy"))
    homes = F.when(F.col("_k").eqNullSafe(F.get(_places(head, kind), F.col("_range"))), F.array(here, there)).otherwise(F.array(here))
    dealt = df.withColumn("_home", F.explode(homes))
    order = Window.partitionBy("_home.r").orderBy("_home.copy", F.desc("_k"))
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where("_home.copy = 0").drop("_k", "_range", "_home")


def compare(df: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    The edited text replaces the last floor(n_chars / 3) code points by the first as many (or all) of the next document.
    Null texts are empty; repeated ids follow each other in order of a hash; null ids come last; ids may be of any simple
    type (whole numbers are ordered as such, others as text); a single row is its own next; an empty table gives no rows.
    Only doc_id and text are read, so other columns cannot clash.
    """
    docs = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = with_next(with_bins(docs, "text", "bins"), "doc_id", ["text", "bins"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), "bins", "next_bins", edited.alias("edited"))
    docs = with_bins(docs, "edited", "edited_bins")
    own, other, following = F.col("bins"), F.col("edited_bins"), F.col("next_bins")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(own).alias("fingerprint"), packed(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next"),
    )

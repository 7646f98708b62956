"""BPE encoding and decoding with forced-boundary splitting.

A position between two neighbouring symbols is a *forced boundary* if that pair of symbols occurs inside no token of
the vocabulary: no merge can ever span it, so the text may be cut there, its fragments encoded independently and the
ids concatenated, with exactly the result of encoding the whole. White space and the pre-tokenizer's cuts are such
boundaries too. Fragments repeat often, so they are encoded once per worker and kept in bounded caches.

Texts are cut at white space first. Where a piece has unusual characters, the library's normalizer and pre-tokenizer are
run on that piece; its words are then cut at forced boundaries of their byte symbols like all others, whatever the script.

The vocabulary file is a parameter (a tokenizers JSON file with a BPE model); it is read on each worker.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Kept, bounded_batches, slices

#: Entries of each of the two generations of the caches: of white-space-separated pieces (and the words in them), of pieces
#: with unusual characters, and of fragments. Rows encoded at a time, and symbols from which a fragment is merged by a heap.
PIECES_KEPT, ODD_KEPT, FRAGMENTS_KEPT, ROWS, LONG = 350_000, 50_000, 20_000, 64, 64

#: Pieces with these characters (controls, or anything from U+0300 on, where normalisation and Unicode versions matter,
#: and the dotted capital I, which lower-cases to two characters) are normalised by the tokenizers library itself.
UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9fİ\u0300-\U0010ffff]")
#: White space at which texts with unusual characters are cut: nothing is composed, reordered or matched across it.
SPACE = re.compile("[ \t\n\r]+")

#: The pre-tokenizer's pattern for texts without unusual characters (numbers there: digits, superscripts, fractions).
PRE_TOKEN = re.compile("'(?:s|t|re|ve|m|ll|d)|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\w\\s]|_)+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


NEVER = 1 << 62


class ForcedBoundaryBPE:
    """Encoder and decoder for a lower-casing, word-ended byte-level BPE vocabulary in tokenizers JSON."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = self._token_strings(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        alphabet = self.alphabet = byte_alphabet()
        self.model = self.library.model
        self.inner = [vocab.get(c) for c in alphabet]
        self.final = [vocab.get(c + self.suffix) for c in alphabet]
        self.joined = self._pairs_inside(vocab, alphabet)
        # the same for ASCII words, as strings of two characters: inside a word, and at its end
        ascii_ = range(33, 127)
        self.inside = {chr(a) + chr(b) for a in ascii_ for b in ascii_ if (self.inner[a], self.inner[b]) in self.joined}
        self.closing = {chr(a) + chr(b) for a in ascii_ for b in ascii_ if (self.inner[a], self.final[b]) in self.joined}
        # only the known kind of pipeline is encoded here; any other is left to the library
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.known = steps == ["NFC", "Replace", "Lowercase"] and split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and None not in self.inner + self.final
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.fragments = Kept(self._merge, FRAGMENTS_KEPT)
        self.pieces = Kept(self._piece, PIECES_KEPT)
        self.odd = Kept(self._odd, ODD_KEPT)

    @staticmethod
    def _token_strings(spec: dict) -> list[str]:
        by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        return [by_id.get(i, "") for i in range(max(by_id) + 1)]

    def _pairs_inside(self, vocab: dict, alphabet: list[str]) -> set[tuple[int, int]]:
        """Symbol pairs that some token has inside; every other pair is a forced boundary."""
        pairs = set()
        for token in vocab:
            ended = bool(self.suffix) and token.endswith(self.suffix) and token != self.suffix
            body = token[: -len(self.suffix)] if ended else token
            symbols = [vocab.get(c) for c in body[:-1]] + [vocab.get(body[-1] + self.suffix if ended else body[-1])] if body else []
            pairs.update(zip(symbols, symbols[1:]))
        return pairs

    def _merge(self, symbols: tuple[int, ...]) -> bytes:
        """Byte-pair merges of one fragment, lowest rank and leftmost first; ids as little-endian 32-bit integers."""
        if len(symbols) > LONG:
            return self._merge_long(symbols)
        parts, rank = list(symbols), self.merges.get
        ranks = [rank(pair, NEVER) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [best & 0xFFFFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return array("I", parts).tobytes()

    def _merge_long(self, symbols: tuple[int, ...]) -> bytes:
        """The same with a heap of mergeable pairs over a linked list, in n log n steps."""
        parts: list[int | None] = [*symbols, None]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := self.merges.get(pair)) is not None]
        heapify(heap)
        while heap:
            r, i, pair = heappop(heap)
            j = after[i]
            if (parts[i], parts[j] if j < len(parts) else None) != pair:
                continue  # merged with another neighbour since
            parts[i], parts[j], after[i] = r & 0xFFFFFFFF, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(parts) and (r := self.merges.get(near := (parts[left], parts[after[left]]))) is not None:
                    heappush(heap, (r, left, near))
        return array("I", [x for x in parts if x is not None]).tobytes()

    def cut(self, raw: bytes) -> list[tuple[int, ...]]:
        """The symbols of one pre-token (its UTF-8 form), cut at its forced boundaries."""
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]
        out, start = [], 0
        for i, pair in enumerate(zip(symbols, symbols[1:]), 1):
            if pair not in self.joined:
                out.append(tuple(symbols[start:i]))
                start = i
        return [*out, tuple(symbols[start:])]

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            return self._word(piece)
        words = PRE_TOKEN.findall(piece)
        return self._word(piece) if words == [piece] else b"".join(map(self.pieces.__getitem__, words))

    def _odd(self, piece: str) -> bytes:
        """A piece with unusual characters: what the library's normalizer and pre-tokenizer make of it, word by word."""
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return b"".join(self._fragments(bytes(map(self.byte_of.__getitem__, w)), w) for w, _ in words)

    def _word(self, word: str) -> bytes:
        """One pre-token's ids."""
        if word.isascii():
            pairs = [*map(add, word, word[1:])]
            if not pairs or (pairs.pop() in self.closing and self.inside.issuperset(pairs)):  # no forced boundary
                return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        raw = word.encode()
        return self._fragments(raw, word if word.isascii() else "".join(map(self.alphabet.__getitem__, raw)))

    def _fragments(self, raw: bytes, shown: str) -> bytes:
        """The ids of a pre-token's fragments; ``shown`` is its byte-level form. The model adds the word-end suffix to what
        it encodes, so only a word's last fragment can go to it; the others are merged here."""
        *inner, last = self.cut(raw)
        ids = array("I", [t.id for t in self.model.tokenize(shown[-len(last) :])]).tobytes()
        return b"".join([*map(self.fragments.__getitem__, inner), ids]) if inner else ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.known or any(t in text for t in self.added):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if UNUSUAL.search(text):
            return b"".join(self.odd[p] if UNUSUAL.search(p) else b"".join(map(self.pieces.__getitem__, p.lower().split())) for p in SPACE.split(text) if p)
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives where the file has no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with a column of the token ids of the whole ``text`` and, if asked for, one of the text decoded from them.

    Null and empty texts give an empty array; other columns pass through unchanged (existing columns named like the new
    ones are replaced); repeated rows are encoded alike; an empty table gives an empty table. Decoding here, rather than by
    ``decode`` afterwards, saves a second worker in each task and a second trip of the ids.
    """
    bounded_batches(df.sparkSession)
    new = [ids, *[decoded] * bool(decoded)]
    kept = [c for c in df.columns if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, *[T.StructField(c, t) for c, t in zip(new, (T.ArrayType(T.IntegerType()), T.StringType()))]])

    def run(batches):
        bpe = codec(path)
        for b in slices(batches, ROWS):
            parts = [bpe.encode(t) for t in b.column(kept.index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)])
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            if decoded:
                made.append(pa.array([bpe.decode(np.frombuffer(p, "<u4").tolist()) for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*kept, *new])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that its token ids stand for; a null array gives a null text, an empty one an empty text."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != decoded]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        bpe = codec(path)
        for b in slices(batches, ROWS):
            texts = [None if x is None else bpe.decode(x) for x in b.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*kept, decoded])

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per document: token count, SHA-256 of its ids as text, SHA-256 of the decoded text."""
    coded = encode(df.select("doc_id", "text"), path, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.translate(F.col("ids").cast("string"), "[],", ""), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

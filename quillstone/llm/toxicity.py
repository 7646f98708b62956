"""Toxic passages by maximum-scoring segments.

Each word has a log-odds score between toxic and clean documents under a Dirichlet prior; rare words take that of their
longest frequent prefix, and scores that are not significant count as zero. Every word also pays a small drift, so that a
random text's running sum falls. A linear-time scan finds all maximal segments of that sum. Under the clean word
distribution the best segment follows an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)); the segments'
excess over what a text of n words reaches by chance is summed and a logistic curve, fitted on labelled documents kept
apart from the counts, turns it into the score.

The model is fitted on the driver on at most ``PER_CLASS`` labelled documents of each class; everything else sees all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Kept, bounded_batches, crc_fold, labelled_sample, release

#: Bound of the labelled sample, of each class.
PER_CLASS = 2500
#: Documents that a word or prefix must be in to be tested, the likelihood-ratio statistic (chi-squared, one degree of
#: freedom) and the log-odds that a score must reach. So many words are tested that chance alone reaches a statistic of
#: 20: below ``FULL_G`` a score counts in proportion, so that it takes several such words to make a passage.
LEAST_DOCUMENTS, LEAST_G, FULL_G, LEAST_ODDS, PRIOR, DRIFT, PREFIXES = 4, 11.0, 25.0, math.log(5), 0.5, 0.05, (5, 4)
#: Near copies in the sample count once: texts sharing at least half of this many MinHash values of word triples.
SKETCH = 6
#: Document folds: labels of fold ``HELD_OUT`` are never learned from.
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: A passage is significant if fewer than this many like it are expected in a clean text of its length.
E_VALUE = 0.05
PIECES_KEPT = 150_000

WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    """Word and prefix scores (word -> score; "pre" + "*" -> score; zeros are words known to be neutral), which of them have
    weak support, the extreme-value parameters and the logistic curve."""

    units: dict[str, float] = field(default_factory=dict)
    weak: set[str] = field(default_factory=set)
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0

    def unit(self, w: str) -> str | None:
        """The word itself or its longest prefix, whichever has a score first."""
        return next((u for u in (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n)) if u in self.units), None)

    def word(self, w: str) -> float:
        return self.units.get(self.unit(w), 0.0)

    def piece(self, piece: str) -> float:
        """The score, before drift, of what stands between two white spaces."""
        return sum(map(self.word, WORD.findall(piece)))

    def scores(self, pieces: list[str], of: Callable[[str], float] | None = None) -> list[float]:
        """The scores of a document's pieces; ``of`` is ``piece``, perhaps from a cache. A piece with weak support counts
        once: saying it again makes it no likelier."""
        found = list(map(of or self.piece, pieces))
        if self.weak and any(found):
            seen = set()
            for i, (piece, s) in enumerate(zip(pieces, found)):
                if s > 0 and all(self.unit(w) in self.weak for w in WORD.findall(piece) if self.word(w) > 0):
                    if piece in seen:
                        found[i] = 0.0
                    seen.add(piece)
        return found

    def segments(self, scores: list[float]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score) of the words' scores less the drift, in linear time: each
        candidate has a link to the nearest one before it with a smaller sum on its left, and a link once followed is
        never followed again."""
        done: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
        total, last = 0.0, -1
        for i, s in enumerate(scores):
            if s <= DRIFT:
                if s:
                    total += s
                continue
            total -= DRIFT * (i - last - 1)
            start, left, last = i, total, i
            total = right = left + s - DRIFT
            j = len(done) - 1
            while True:
                while j >= 0 and done[j][2] >= left:
                    j = done[j][4]
                if j < 0 or done[j][3] >= right:
                    break
                start, _, left, _, link = done[j]
                del done[j:]
                j = link
            done.append((start, i + 1, left, right, j))
        return [(a, b, right - left) for a, b, left, right, _ in done]

    def excess(self, segments: list, words: int) -> float:
        """Sum of the significant segments' excess, in nats, over what chance reaches; else the best one's shortfall."""
        chance = math.log(max(self.k * max(words, 1), 1e-300))
        over = [self.lam * s - chance for *_, s in segments]
        return sum(x for x in over if x > 0) or max(over, default=-chance - 1)

    def probability(self, x: float) -> float:
        z = self.slope * max(-50.0, min(50.0, x)) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def expected(self, score: float, words: int) -> float:
        """How many segments of this score a clean text of so many words is expected to have."""
        return self.k * max(words, 1) * math.exp(-self.lam * score)


def distinct(sample: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample without copies and near copies, so that a group of them does not pass for many witnesses."""
    seen: list[dict[int, int]] = [{} for _ in range(SKETCH)]
    out = []
    for text, y in dict(sample).items():
        words = text.lower().split()
        grams = {zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))}
        h = np.fromiter(grams, np.uint64, len(grams))
        least = [int(((h * np.uint64(2 * 0x9E3779B97F4A7C15 % (1 << 32) * k + 0x5BD1E995)) % np.uint64((1 << 61) - 1)).min()) for k in range(1, SKETCH + 1)]
        match = Counter(s[v] for s, v in zip(seen, least) if v in s)
        if not match or max(match.values()) < SKETCH // 2:
            out.append((text, y))
            for s, v in zip(seen, least):
                s.setdefault(v, len(out))
    return out


def fit(sample: list[tuple[str, int]], toxic_share: float = 0.5) -> Model:
    """Fit on (text, label) pairs: two thirds give the scores, the rest the calibration; ``toxic_share`` is that of all
    labelled documents. Without both classes the score is the sample's share of label 1 (0 without labels)."""
    n = [sum(y == c for _, y in sample) for c in (0, 1)]
    model = Model()
    if not all(n):
        share = (n[1] + 0.001) / (sum(n) + 0.002) if sum(n) else 0.001
        model.offset = math.log(share / (1 - share))
        return model
    halves: tuple[list, list] = ([], [])
    for text, y in distinct(sample):
        halves[zlib.crc32(text.encode("utf-8", "surrogatepass")) % 3 == 0].append((text.lower(), y))  # words are made when needed: they take many times the room
    learn, tune = halves if halves[1] else (halves[0], halves[0])
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    size = [1, 1]
    for text, y in learn:
        units = set(WORD.findall(text))
        counts[y].update(units | {w[:k] + "*" for w in units for k in PREFIXES if len(w) > k})
        size[y] += 1
    base = math.log(size[1] / size[0])
    for unit in counts[0].keys() | counts[1].keys():
        a, b = counts[1][unit], counts[0][unit]
        if a + b >= LEAST_DOCUMENTS:
            share = size[1] / sum(size)
            odds = math.log((a + PRIOR * share) / (b + PRIOR * (1 - share))) - base
            g = 2 * sum(x * math.log(x / ((a + b) * p)) for x, p in ((a, share), (b, 1 - share)) if x)
            model.units[unit] = odds * min(1.0, g / FULL_G) if odds >= LEAST_ODDS and g >= LEAST_G else 0.0
            if model.units[unit] and g < FULL_G:
                model.weak.add(unit)
    # words that no tested unit covers keep score 0; neutral words are kept only where a scored prefix would cover them
    hot = {u for u, s in model.units.items() if s}
    model.units = {u: s for u, s in model.units.items() if s or any(u[:k] + "*" in hot for k in PREFIXES)}
    _calibrate(model, learn, tune)
    drawn = sum(y for _, y in tune) / len(tune)
    clip = lambda p: math.log(min(0.99, max(0.01, p)) / (1 - min(0.99, max(0.01, p))))
    model.offset += clip(toxic_share) - clip(drawn)
    return model


def _calibrate(model: Model, learn: list, tune: list) -> None:
    clean = Counter(model.word(w) for text, y in learn + tune if not y for w in WORD.findall(text))
    positive = [s for s in model.units.values() if s > 0]
    if positive:
        clean[float(np.mean(positive))] += 0.5  # the Dirichlet prior's share of words not yet seen in clean text
    s = np.array([k - DRIFT for k in clean], float)
    p = np.array(list(clean.values()), float)
    p /= p.sum()
    low, high = 1e-3, 20.0
    if positive:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if float(p @ np.exp(np.minimum(mid * s, 700))) > 1 else (mid, high)
        model.lam = max(low, 1e-3)
    found = [(model.segments(model.scores(words)), len(words), y) for words, y in ((WORD.findall(text), y) for text, y in tune)]
    best = [(max((x[2] for x in segs), default=0.0), n) for segs, n, y in found if not y] or [(0.0, 1)]
    model.k = len(best) / max(1e-9, sum(max(n, 1) * math.exp(-model.lam * b) for b, n in best))
    x = np.array([max(-50.0, min(50.0, model.excess(segs, n))) for segs, n, _ in found])
    y = np.array([c for *_, c in found], float)
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):  # Newton steps with a weak ridge
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (q - y) + 0.1 * w
        hessian = (design * (q * (1 - q))[:, None]).T @ design + 0.1 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    model.slope, model.offset = float(max(w[0], 0.0)), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    seen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_fold("doc_id", FOLDS) != HELD_OUT))
    share = seen.agg(F.avg("toxic")).first()[0]
    return fit(labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS), 0.5 if share is None else float(share))


PASSAGE = "array<struct<start:int,end:int,score:double,e_value:double>>"


def detect(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("score", "predicted", "passages")) -> DataFrame:
    """``df`` with score (0 to 1), predicted (score >= 0.3) and passages: the significant segments as word ranges.
    ``names`` are those of the new columns.

    A null or empty text has no passages and the score of no evidence. Columns named like the new ones are replaced;
    other columns pass through; repeated rows score alike; an empty table gives an empty table.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    new = list(names)
    kept = [c for c in df.columns if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(new, ("double", "int", PASSAGE))]])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        scores_of = Kept(m.piece, PIECES_KEPT).__getitem__
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for b in batches:
            out, where = [], []
            for t in b.column(kept.index(text)).to_pylist():
                words = (t or "").lower().split()
                scores = m.scores(words, scores_of)
                segments = m.segments(scores) if any(scores) else []
                out.append(m.probability(m.excess(segments, len(words))))
                where.append([{"start": i, "end": j, "score": s, "e_value": e} for i, j, s in segments if (e := m.expected(s, len(words))) < E_VALUE])
            score = np.array(out, float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(where, kind)], names=[*kept, *new])
        del scores_of
        release()

    return source.mapInArrow(run, schema)

"""Quality classifier: supervised subword embeddings.

A document is the sequence of its white-space pieces, with a marker after a piece that repeats the one before. Every piece
has the average of the learned vectors of its own hash bucket and of those of its character n-grams; a document has the
average over its pieces, and a softmax layer on that gives the score. Vectors and layer are trained by stochastic gradient
descent in numpy, on the driver, on at most ``PER_CLASS`` labelled documents of each class. Every epoch goes over the whole
text of each of them: its pieces are shuffled and cut into parts of at most ``PIECES_A_STEP``, each an example whose weight
is its share of the document. The average and the layer are linear, so scoring needs one number a bucket; every document is
scored over its whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import Kept, bounded_batches, labelled_sample, release

#: Bound of the labelled sample, of each class.
PER_CLASS = 1000
BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 16, (2, 3, 4)
BATCH, RATE, PIECES_A_STEP, SEED = 32, 0.5, 512, 7
#: Epochs: as many as give this number of examples, between the least and the most.
EXAMPLES, EPOCHS = 3000, (2, 7)
#: Document folds: labels of fold ``HELD_OUT`` are never learned from.
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
#: Entries of each generation of the scoring caches of pieces and of n-grams.
PIECES_KEPT, GRAMS_KEPT = 150_000, 100_000
#: Pieces of more characters are not cached; their n-grams are hashed as arrays, so many characters (or n-grams) at a time.
LONG, SLAB = 80, 1 << 16
#: Documents of more n-grams in a step are added up by bucket first (no document without long pieces has so many).
MANY = PIECES_A_STEP * (1 + len(GRAMS) * (LONG + 1))
REPEATED = "\x00same"


def parts(piece: str) -> list[str]:
    """A piece and its character n-grams."""
    if piece == REPEATED:
        return [piece]
    body = f"<{piece}>"
    return [piece, *[body[i : i + n] for n in GRAMS for i in range(len(body) - n + 1)]]


def bucket(part: str) -> int:
    return 0 if part == REPEATED else 1 + zlib.crc32(part.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


def buckets(piece: str) -> list[int]:
    return list(map(bucket, parts(piece)))


_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (_CRC & np.uint32(1)))


def long_buckets(piece: str) -> Iterator[np.ndarray]:
    """The ``buckets`` of a long piece in arrays of bounded size: CRC-32 of the UTF-8 form, for all n-grams at once."""
    yield np.array([bucket(piece)])
    body = f"<{piece}>"
    for at in range(0, len(body), SLAB):
        c = np.frombuffer(body[at : at + SLAB + max(GRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        two, three, four = c >= 0x80, c >= 0x800, c >= 0x10000
        first = np.select([four, three, two], [0xF0 | c >> 18, 0xE0 | c >> 12, 0xC0 | c >> 6], c)
        steps = [(None, first), *[(there, 0x80 | (c >> shift & 0x3F)) for there, shift in ((four, 12), (three, 6), (two, 0)) if there.any()]]
        state = np.full(len(c), 0xFFFFFFFF, np.uint32)
        for n in range(1, max(GRAMS) + 1):
            last = min(SLAB, len(c) - n + 1)
            if last <= 0:
                break
            state = state[:last]
            for there, byte in steps:
                new = _CRC[(state ^ byte[n - 1 : n - 1 + last]) & 0xFF] ^ (state >> 8)
                state = new if there is None else np.where(there[n - 1 : n - 1 + last], new, state)
            if n in GRAMS:
                yield 1 + (~state % np.uint32(BUCKETS - 1)).astype(np.int64)


def pieces(text: str | None) -> list[str]:
    words = (text or "").split()
    return [x for i, w in enumerate(words) for x in ((w, REPEATED) if i and words[i - 1] == w else (w,))]


@dataclass
class Model:
    """A number for each bucket, and the offset of the logit."""

    weights: np.ndarray
    offset: float

    def piece(self, piece: str) -> float:
        return float(self.weights[buckets(piece)].mean())


def fit(sample: list[tuple[str, int]]) -> Model:
    """Train on (text, label) pairs. Without both classes the score is the share of label 1 (one half without labels)."""
    n = [sum(y == c for _, y in sample) for c in (0, 1)]
    if not all(n):
        share = (n[1] + 0.001) / (sum(n) + 0.002)
        return Model(np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    layer[:, 1] = 1e-2
    # every distinct piece once: its buckets lie at [first, first + size) of one array
    number: dict[str, int] = {}
    docs = [(np.array([number.setdefault(w, len(number)) for w in p], np.int32), y) for text, y in sample if (p := pieces(text))]
    gram = Kept(bucket, GRAMS_KEPT).__getitem__
    size = np.array([1 if w == REPEATED else 1 + sum(max(0, len(w) + 3 - n) for n in GRAMS) for w in number], np.int64)
    first = np.cumsum(size) - size
    table = np.empty(size.sum(), np.int32)
    for w, at, n in zip(number, first.tolist(), size.tolist()):
        if len(w) > LONG:
            for ids in long_buckets(w):
                table[at : at + len(ids)] = ids
                at += len(ids)
        else:
            own, *grams = parts(w)
            table[at : at + n] = [bucket(own), *map(gram, grams)]
    del number

    def totals(drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of the drawn pieces of a document and their weights."""
        piece, times = np.unique(drawn, return_counts=True)
        n = size[piece]
        ends, weight, sums = np.cumsum(n), times / n / len(drawn), np.zeros(BUCKETS)
        for at in range(0, int(ends[-1]), SLAB * 16):
            place = np.arange(at, min(int(ends[-1]), at + SLAB * 16))
            which = np.searchsorted(ends, place, "right")
            sums += np.bincount(table[first[piece[which]] + place - (ends - n)[which]], weight[which], BUCKETS)
        some = np.flatnonzero(sums)
        return some, sums[some].astype(np.float32)

    cut = [max(1, -(-len(p) // PIECES_A_STEP)) for p, _ in docs]
    epochs = min(EPOCHS[1], max(EPOCHS[0], -(-EXAMPLES // max(1, sum(cut)))))
    steps, done = max(1, epochs * sum(cut)), 0
    balance = np.array([len(docs) / (2 * max(1, sum(y == c for _, y in docs))) for c in (0, 1)], np.float32)
    for _ in range(epochs):
        for p, _ in docs:
            rng.shuffle(p)
        order = rng.permutation(np.repeat(np.arange(len(docs)), cut))
        turn = np.zeros(len(docs), np.int64)
        for at in range(0, len(order), BATCH):
            batch, drawn = [docs[i] for i in order[at : at + BATCH]], []
            for i in order[at : at + BATCH]:  # the document's next part
                p = docs[i][0]
                drawn.append(p[turn[i] * len(p) // cut[i] : (turn[i] + 1) * len(p) // cut[i]])
                turn[i] += 1
            part = np.array([1 / cut[i] for i in order[at : at + BATCH]], np.float32)
            many = {k: totals(p) for k, p in enumerate(drawn) if size[p].sum() > MANY}
            few = np.array([k for k in range(len(batch)) if k not in many], np.int64)
            hidden = np.zeros((len(batch), DIMENSIONS), np.float32)
            if len(few):
                counts = np.array([len(drawn[k]) for k in few])
                piece = np.concatenate([drawn[k] for k in few])
                n = size[piece]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids = table[np.repeat(first[piece], n) + within]
                owner = np.repeat(np.repeat(few, counts), n)
                weight = np.repeat(1 / n / np.repeat(counts, counts), n).astype(np.float32)
                hidden[few] = np.add.reduceat(vectors[ids] * weight[:, None], np.searchsorted(owner, few))
            for k, (some, share) in many.items():
                hidden[k] = share @ vectors[some]
            y = np.array([c for _, c in batch])
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (balance[y] * part)[:, None]
            rate = np.float32(RATE * (1 - done / steps))
            grad = p @ layer.T
            layer -= rate * hidden.T @ p / len(batch) * 4
            bias -= rate * p.mean(0)
            if len(few):
                by_bucket = np.argsort(ids, kind="stable")
                found = ids[by_bucket]
                starts = np.flatnonzero(np.diff(found, prepend=-1))
                step = weight[by_bucket, None] * grad[owner[by_bucket]]
                vectors[found[starts]] -= rate * 4 * np.add.reduceat(step, starts)
            for k, (some, share) in many.items():
                vectors[some] -= rate * 4 * share[:, None] * grad[k]
            done += len(batch)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS))


def score(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` with score (0 to 1, of label 1) and predicted (score >= 0.5). ``names`` are those of the new columns.

    Null and empty texts get the score of no evidence. Columns named like the new ones are replaced; other columns pass
    through; repeated rows score alike; an empty table gives an empty table.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    new = list(names)
    kept = [c for c in df.columns if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.IntegerType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value

        weight = m.weights.tolist()
        gram = Kept(lambda part: weight[bucket(part)], GRAMS_KEPT).__getitem__

        def weigh(piece: str) -> float:
            if len(piece) > LONG:
                total = count = 0
                for ids in long_buckets(piece):
                    total, count = total + float(m.weights[ids].sum(dtype=np.float64)), count + len(ids)
                return total / count
            own, *grams = parts(piece)
            return (weight[bucket(own)] + sum(map(gram, grams))) / (1 + len(grams))

        of = Kept(weigh, PIECES_KEPT, LONG).__getitem__
        repeated = m.piece(REPEATED)
        for b in batches:
            out = []
            for t in b.column(kept.index(text)).to_pylist():
                words = (t or "").split()
                again = sum(map(eq, words, words[1:]))
                mean = (sum(map(of, words)) + again * repeated) / max(1, len(words) + again)
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, mean + m.offset)))))
            s = np.array(out, float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*kept, *new])
        del of, gram, weight, weigh
        release()

    return source.mapInArrow(run, schema)

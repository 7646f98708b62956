"""Sequence packing by minimum bin slack.

Each task tokenises its documents, cuts whole windows off long ones and keeps the remaining lengths in a bounded pool.
A window is filled by a bitset subset-sum over the multiset of pooled lengths: bit s of an integer says that some
choice of pieces sums to s, each length enters with its count by binary splitting, and backtracking through the stored
bitsets gives how many pieces of each length make the sum closest to the capacity. Any slack left is closed by cutting
one more piece. What is left at the end of a task goes into sequences whose lengths are powers of two, which need no
padding. There is no shuffle; memory is bounded by the pool, and a task that is run again gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import codec
from .util import bounded_batches

WINDOW, END_ID = 2048, 1
#: Windows' worth of tokens gathered before any is filled, and left in the pool while more documents come.
POOL_HIGH, POOL_LOW = 192, 96
#: Sequence ids are the task's number times this, plus the sequence's number within the task.
SEQUENCES_PER_TASK = 1 << 40


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length (ascending ``lengths`` with ``counts``) sum closest to ``capacity`` from below."""
    reachable, mask, layers = 1, (1 << (capacity + 1)) - 1, []
    for n in reversed(lengths):
        left = min(counts[n], capacity // n)
        layers.append((n, reachable))
        step = 1
        while left > 0:
            take = min(step, left)
            reachable |= (reachable << (n * take)) & mask
            left -= take
            step *= 2
        if reachable >> capacity & 1:
            break
    total, chosen = reachable.bit_length() - 1, {}
    for n, before in reversed(layers):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            chosen[n] = k
    return chosen


class Packer:
    """Fills windows from a bounded pool; a piece is (key, start, ids as bytes of 4 each, the document's length)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.pool, self.lengths, self.total = window, {}, [], 0
        self.rows, self.sequence = [], 0

    def add(self, key, ids: bytes) -> None:
        n, whole = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, whole, self.window):
            self._emit([(key, start, ids[4 * start : 4 * (start + self.window)], n)])
        if n > whole:
            self._keep((key, whole, ids[4 * whole :], n))
        if self.total > POOL_HIGH * self.window:
            while self.total > POOL_LOW * self.window:
                self._fill()

    def finish(self) -> None:
        while self.total >= self.window:
            self._fill()
        rest = [p for n in reversed(self.lengths) for p in self.pool[n]]
        for bit in reversed(range(self.total.bit_length())):
            if self.total >> bit & 1:
                self._emit(self._cut_off(rest, 1 << bit))
        self.pool, self.lengths, self.total = {}, [], 0

    @staticmethod
    def _cut_off(rest: list, size: int) -> list:
        """Take pieces of ``size`` ids together off the front of ``rest``, cutting the last if need be."""
        taken = []
        while size:
            key, start, ids, n = rest.pop(0)
            if len(ids) // 4 > size:
                rest.insert(0, (key, start + size, ids[4 * size :], n))
                ids = ids[: 4 * size]
            taken.append((key, start, ids, n))
            size -= len(ids) // 4
        return taken

    def _keep(self, piece) -> None:
        n = len(piece[2]) // 4
        if n not in self.pool:
            self.pool[n] = []
            insort(self.lengths, n)
        self.pool[n].append(piece)
        self.total += n

    def _take(self, n: int):
        piece = self.pool[n].pop()
        if not self.pool[n]:
            del self.pool[n]
            del self.lengths[bisect_left(self.lengths, n)]
        self.total -= n
        return piece

    def _fill(self) -> None:
        chosen = best_fill(self.lengths, {n: len(v) for n, v in self.pool.items()}, self.window)
        pieces = [self._take(n) for n, k in chosen.items() for _ in range(k)]
        slack = self.window - sum(n * k for n, k in chosen.items())
        if slack and self.lengths:  # every piece left is longer than the slack, or it would have been chosen
            key, start, ids, n = self._take(self.lengths[bisect_right(self.lengths, slack)])
            pieces.append((key, start, ids[: 4 * slack], n))
            self._keep((key, start + slack, ids[4 * slack :], n))
        self._emit(pieces)

    def _emit(self, pieces: list) -> None:
        offset = 0
        filled = sum(len(p[2]) // 4 for p in pieces)
        for key, start, ids, n in pieces:
            self.rows.append((key, start, len(ids) // 4, ids, n, self.sequence, offset, filled))
            offset += len(ids) // 4
        self.sequence += 1


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: key, start, length, ids (bytes, little-endian 32-bit), doc_tokens, sequence_id,
    offset, sequence_tokens (ids in the sequence; padding is ``window`` less that, none at a power of two).

    A null or empty text is the end id alone. Repeated rows and null keys are packed as rows of their own; only ``key``
    and ``text`` are read, so other columns cannot clash; an empty table gives no sequences.
    """
    bounded_batches(df.sparkSession)
    source = df.select(F.col(key), F.col(text))
    kind = source.schema[0].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long").fields])
    end = end_id.to_bytes(4, "little")

    def run(batches):
        bpe, packer, key_type = codec(path), Packer(window), None
        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK

        def out():
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [key_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 4]
            cols[5] = [first + s for s in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(k, bpe.encode(t) + end)
            if packer.rows:
                yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return source.mapInArrow(run, schema)


def pieces(df: DataFrame, path: str) -> DataFrame:
    """The packed pieces with a checksum of their ids in place of the ids."""
    return pack(df, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")

"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of hashed five-word shingles. Equal sets (by a digest of 128 bits) are one class, named by the row number
of the row that stands for it. Classes that agree on a band of MinHash values are candidates; their signatures are compared
a few values at a time, and a pair is dropped as soon as the posterior probability (uniform prior) that its similarity
reaches the threshold falls below ``TOLERANCE``. The surviving pairs' components are small and tight; within each, the
similarity of all pairs is computed exactly from the texts.

No step emits all pairs of a group: kernels return, per class, how many documents it links to and one edge towards its
component. Large buckets and components are cut into blocks that are compared block against block, so that a task holds
two blocks at most and a row travels once for each block of its group. Within a bucket only connections matter, so its
classes are visited from neighbour to neighbour: a bucket of near copies takes a comparison or so for each of them.
"""

from __future__ import annotations

import re
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components, groups, representative, resolve, roots
from .util import Kept, Scratch, bounded_batches, release

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: The first ``HASHES`` of all MinHash values are compared in steps; all are in bands. A pair of similarity THRESHOLD shares
#: no band with a probability below TOLERANCE: (1 - 0.8**5)**40 = 1.3e-7.
HASHES, BANDS, ROWS, STEP = 128, 40, 5, 16
VALUES = BANDS * ROWS
#: Classes in a block of signatures; classes and characters in a block of texts; rows of a table that may be broadcast.
SIGNATURES, BLOCK, BLOCK_CHARS, BROADCAST_ROWS = 1 << 15, 4096, 1 << 24, 400_000
#: Groups of more classes than this are dealt out to several tasks, in up to so many blocks before blocks grow to ``BLOCK``.
FINE_BLOCK, FINE_BLOCKS = 128, 16
#: Pairs compared at a time, and classes of a shingle up to which its pairs are counted one by one.
SLAB, FEW = 1 << 20, 16
PIECES_KEPT = 100_000

WORD = re.compile(r"[^\W_]+")
_RANDOM = np.random.default_rng(20)
_A = _RANDOM.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_BAND = _RANDOM.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_SALT = _RANDOM.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed word shingles; the words' hashes are kept per white-space-separated piece, in a bounded cache."""

    def __init__(self):
        self.of = Kept(lambda piece: b"".join(xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass")) for w in WORD.findall(piece)), PIECES_KEPT).__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of the text's shingles; the whole text is one shingle if it has fewer words."""
        words = np.frombuffer(b"".join(map(self.of, (text or "").lower().split())), np.uint64)
        if not len(words):
            return words
        size = min(SHINGLE, len(words))
        last = len(words) - size + 1
        h = np.full(last, size, np.uint64)
        for i in range(size):
            h = h * _P + words[i : i + last]
        return np.unique(_mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """``VALUES`` MinHash values."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        least = np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(1))
    return least


@cache
def least_matches() -> tuple[tuple[int, int], ...]:
    """After each STEP of values: how many must agree for the similarity to be THRESHOLD with probability >= TOLERANCE.

    With a uniform prior the similarity is Beta(1 + m, 1 + n - m) after m agreements of n, and its upper tail is a
    binomial sum: P(Binomial(n + 1, THRESHOLD) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, need = 0.0, n + 1
        for m in range(n + 1):
            tail += comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= TOLERANCE:
                need = m
                break
        out.append((n, need))
    return tuple(out)


def prune(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows of ``values`` that survive the incremental comparison."""
    agree = np.zeros(len(i), np.int32)
    for n, need in least_matches():
        part = values[:, n - STEP : n]
        agree += (part[i] == part[j]).sum(1, dtype=np.int32)
        keep = agree >= need
        if not keep.all():
            i, j, agree = i[keep], j[keep], agree[keep]
        if not len(i):
            break
    return i, j


def connected(values: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
    """For each row of ``values`` the least row that surviving pairs connect it to; with ``block`` (0 or 1 a row), only
    pairs of rows of different blocks count. Rows not yet reached are compared with the newly reached ones, until none is."""
    label, left = np.arange(len(values)), np.arange(len(values))
    while len(left):
        first, left = left[0], left[1:]
        todo = [np.array([first])]
        while todo and len(left):
            front = todo.pop()
            step = max(1, SLAB // len(left))
            if len(front) > step:
                todo.append(front[step:])
                front = front[:step]
            i, j = np.repeat(front, len(left)), np.tile(left, len(front))
            if block is not None:
                other = block[i] != block[j]
                i, j = i[other], j[other]
            reached = np.unique(prune(values, i, j)[1])
            if len(reached):
                label[reached] = first
                left = np.setdiff1d(left, reached, assume_unique=True)
                todo.append(reached)
    return label


def sketch(df: DataFrame, text: str) -> DataFrame:
    """``df`` with rid (a row number), digest (of the shingle set; null without words), chars, sig and bands."""
    kept = df.schema.fields
    source = df.withColumn("rid", F.monotonically_increasing_id())
    schema = T.StructType([*kept, *T._parse_datatype_string("rid long, digest binary, chars long, sig binary, bands array<long>").fields])
    at = df.columns.index(text)

    def run(batches):
        shingle = Shingler()
        for b in batches:
            digests, chars, sigs, bands = [], [], [], []
            for t in b.column(at).to_pylist():
                s = shingle(t)
                chars.append(len(t or ""))
                if not len(s):
                    digests.append(None), sigs.append(None), bands.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                v = signature(s)
                sigs.append((_mix(v[:HASHES]) >> np.uint64(48)).astype(np.uint16).tobytes())
                bands.append(_mix((v.reshape(BANDS, ROWS) * _BAND).sum(1) + _SALT).view(np.int64))
            made = [pa.array(c, k) for c, k in zip((digests, chars, sigs, bands), (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)
        del shingle
        release()

    return source.mapInArrow(run, schema)


def _dealt(rows: DataFrame, blocks: Column, key: str) -> DataFrame:
    """A copy of each row for every pair of blocks that its own block is in; one copy if the group is one block."""
    rows = rows.withColumn("parts", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("here", F.least("block", "_other")).withColumn("there", F.greatest("block", "_other")).drop("_other")
    order = [key, "here", "there"]
    return rows.repartition(*order).sortWithinPartitions(*order, "cls")


def likely_edges(classes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components join all classes with a surviving candidate pair."""
    banded = classes.select("cls", F.explode("bands").alias("value"))
    shared = banded.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    members = banded.join(shared, "value").join(classes.select("cls", "sig"), "cls")
    dealt = _dealt(members, F.ceil(F.col("n") / SIGNATURES), "value").select("value", "here", "there", "block", "cls", "sig")

    def run(batches):
        a, b, held = [], [], 0
        for (_, here, there), rows in groups(batches, ["value", "here", "there"]):
            if rows.num_rows < 2:
                continue
            values = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            ids = rows.column("cls").to_numpy()
            label = connected(values, None if here == there else rows.column("block").to_numpy() == there)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            if len(moved):
                a.append(ids[moved]), b.append(ids[label[moved]])
                held += len(moved)
            if held >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])
                a, b, held = [], [], 0
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def intersections(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``first`` with the sets ``second`` (the same array, or disjoint ones).

    The pairs of a shingle that few sets hold are counted one by one; the shingles that many hold make a table of zeros
    and ones, some thousands at a time, whose product counts them."""
    same = first is second
    which = first if same else np.concatenate([first, second])
    every = np.concatenate([sets[k] for k in which])
    owner = np.repeat(np.arange(len(which), dtype=np.int32), [len(sets[k]) for k in which])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.array([], int)
    counts = np.diff(np.append(starts, len(every)))
    n, m = len(first), len(second)
    out = np.zeros(n * m, np.float32)
    for d in range(2, FEW + 1):
        at = starts[counts == d]
        for slab in range(0, len(at), SLAB // d):
            held = owner[at[slab : slab + SLAB // d, None] + np.arange(d)]
            for p in range(d):
                for q in range(p + 1, d):
                    a, b = held[:, p].astype(np.int64), held[:, q].astype(np.int64)
                    if not same:
                        cross = (a < n) & (b >= n)
                        a, b = a[cross], b[cross] - n
                    code, times = np.unique(a * m + b, return_counts=True)
                    out[code] += times
    out = out.reshape(n, m)
    many = np.flatnonzero(counts > FEW)
    for slab in range(0, len(many), 2048):
        part = many[slab : slab + 2048]
        table = np.zeros((len(which), len(part)), np.float32)
        for k, g in enumerate(part):
            table[owner[starts[g] : starts[g] + counts[g]], k] = 1
        out += np.triu(table @ table.T, 1) if same else table[:n] @ table[n:].T
    return out + out.T if same else out


def verified(texts: DataFrame) -> DataFrame:
    """(cls, links, root, settled): for each linked class of a block pair, documents linked in it, the least class it is
    connected to, and whether its component has no other block."""

    def run(batches):
        shingle = Shingler()
        for (_, here, there), rows in groups(batches, ["component", "here", "there"]):
            ids, copies, block = (rows.column(c).to_numpy() for c in ("cls", "copies", "block"))
            first = np.flatnonzero(block == here)
            second = first if here == there else np.flatnonzero(block == there)
            if not len(first) or not len(second):
                continue
            sets = [shingle(t.as_py()) for t in rows.column("text")]
            sizes = np.array([len(s) for s in sets])
            common = intersections(sets, first, second)
            del sets
            links, i, j = np.zeros(len(ids), np.int64), [], []
            for at in range(0, len(first), 512):
                part = first[at : at + 512]
                union = sizes[part][:, None] + sizes[second][None, :] - common[at : at + 512]
                u, v = np.nonzero(common[at : at + 512] * 5 >= union * 4)  # similarity >= 4/5, in whole numbers
                u, v = part[u], second[v]
                u, v = u[u != v], v[u != v]
                links += np.bincount(u, copies[v], len(ids)).astype(np.int64)
                if here != there:
                    links += np.bincount(v, copies[u], len(ids)).astype(np.int64)
                root = roots(len(ids), u, v)  # of this part: all that its rows are connected to
                some = np.flatnonzero(root != np.arange(len(ids)))
                i.append(some), j.append(root[some])
            some = np.flatnonzero(links)
            if len(some):
                root = roots(len(ids), np.concatenate(i), np.concatenate(j))
                settled = pa.array([rows.column("parts")[0].as_py() == 1] * len(some))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(links[some], pa.int64()), pa.array(ids[root[some]], pa.int64()), settled], names=["cls", "links", "root", "settled"])
        del shingle
        release()

    return texts.mapInArrow(run, "cls long, links long, root long, settled boolean")


def linked(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with rid and the columns that ``resolve`` adds; other columns of ``df`` must not have the names used here."""
    bounded_batches(df.sparkSession)
    scratch = Scratch()
    rows = scratch.table(sketch(df, text), "sketches")
    grouped = rows.where("digest is not null").groupBy("digest")
    classes = grouped.agg(representative(key, "rid").alias("rep"), F.count("*").alias("copies"), F.max("chars").alias("chars"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = scratch.table(classes.withColumn("cls", F.col("rep.rid")), "classes")
    near = components(likely_edges(classes), scratch)
    near = near.join(classes.select("cls", "copies", "chars"), F.col("node") == F.col("cls")).select("cls", F.col("root").alias("component"), "copies", "chars")
    near = scratch.table(near, "near")
    fine = F.least(F.ceil(F.count("*") / FINE_BLOCK), F.lit(FINE_BLOCKS))
    sizes = near.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), fine, F.ceil(F.sum("chars") / BLOCK_CHARS)).alias("_blocks"))
    placed = near.join(sizes, "component").select("cls", "component", "copies", "_blocks")
    if near.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    texts = rows.select("rid", F.col(text).alias("text")).join(placed, F.col("rid") == F.col("cls"))
    found = scratch.table(verified(_dealt(texts, F.col("_blocks"), "component").select("component", "here", "there", "parts", "block", "cls", "copies", "text")), "links")
    out = resolve(rows.drop("chars", "sig", "bands"), classes, found, key, scratch)
    scratch.close(rows, scratch.tables[-1][0])  # the result reads the sketches and what resolve wrote last
    return out


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (least id of the documents with the same shingles), n_links (other documents with a
    similarity of 0.8 or more), component_id (least id reachable by links), kept (the row has that id).

    A link at 0.80 exactly is missed with a probability of 9e-6 (1.3e-7 by the bands, the rest by pruning), less above.

    Rows count by themselves, whatever their id: repeated rows are documents, and an id that comes with several texts
    links each of them. Null, empty and wordless texts have no shingles, link with nothing and keep their own id. A null
    id is kept; a class of null ids has a null class_id. Only ``key`` and ``text`` are read, so other columns cannot
    clash; an empty table gives no rows.
    """
    out = linked(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    return out.select("doc_id", "class_id", "n_links", "component_id", "kept")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row of least id stays (nulls come last; of several
    rows with that id, one), with all its columns. Rows without words are no copies of each other and stay, each of them."""
    names = [f"c{k}" for k in range(len(df.columns))]  # of no name used on the way
    out = linked(df.toDF(*names), names[df.columns.index(key)], names[df.columns.index(text)])
    return out.where("chosen").select(*names).toDF(*df.columns)
